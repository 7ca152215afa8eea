"""Dense, keyword and hybrid search as DataFrame plans.

Chunks are rows (_id, field, chunk_idx, chunk, embedding); documents are rows with _id and fields.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.functions.scoring import ScoreModifiers, modified
from tessera.operators import lexical
from tessera.operators.lexical import KeywordQuery

#: Limits of a request.
MOST_LIMIT, MOST_OFFSET, MOST_TOGETHER = 1000, 10_000, 10_000


def check_page(limit: int, offset: int) -> None:
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if not whole(limit) or not 0 < limit <= MOST_LIMIT:
        raise ValueError(f"limit is a whole number from 1 to {MOST_LIMIT}")
    if not whole(offset) or not 0 <= offset <= MOST_OFFSET:
        raise ValueError(f"offset is a whole number from 0 to {MOST_OFFSET}")
    if limit + offset > MOST_TOGETHER:
        raise ValueError(f"limit and offset are {MOST_TOGETHER} together at most")


def page(scored: DataFrame, limit: int, offset: int = 0, *, score: str = "_score", key: str = "_id") -> DataFrame:
    """The rows of one page: by score, ties by key."""
    check_page(limit, offset)
    order = [F.desc(score), F.asc(key)]
    return scored.orderBy(*order).limit(limit) if not offset else scored.orderBy(*order).offset(offset).limit(limit)


def ranked(rows: DataFrame, *, score: str = "_score", key: str = "_id", name: str = "rank") -> DataFrame:
    """A page's rows with their place from 1 on; only for what a limit has cut."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(F.desc(score), F.asc(key))))


def _scored(chunks: DataFrame, query: Sequence[float], metric: str, fields: Sequence[str] | None) -> DataFrame:
    if fields is not None:
        chunks = chunks.where(F.col("field").isin(*fields)) if fields else chunks.where(F.lit(False))
    score = V.closeness(metric, V.doubles("embedding"), V.literal(query))
    return chunks.where(F.col("embedding").isNotNull()).select("_id", "field", "chunk_idx", "chunk", score.alias("s"))


def tensor_scores(chunks: DataFrame, query: Sequence[float], *, metric: str = "prenormalized-angular", fields: Sequence[str] | None = None) -> DataFrame:
    """(_id, field, _score, chunk): of each document and field its nearest chunk; equal ones by place."""
    scored = _scored(chunks, query, metric, fields)
    best = scored.groupBy("_id", "field").agg(F.max(F.struct(F.col("s"), (-F.col("chunk_idx")).alias("at"), "chunk")).alias("best"))
    return best.select("_id", "field", F.col("best.s").alias("_score"), F.col("best.chunk").alias("chunk"))


def nearest_documents(scores: DataFrame) -> DataFrame:
    """(_id, _score, _highlights): of each document its nearest field, with that field's chunk as the highlight."""
    best = scores.groupBy("_id").agg(F.max(F.struct(F.col("_score"), F.col("field"), F.col("chunk"))).alias("best"))
    return best.select("_id", F.col("best._score").alias("_score"), F.array(F.create_map("best.field", "best.chunk")).alias("_highlights"))


def tensor_search(
    chunks: DataFrame, query: Sequence[float], *, docs: DataFrame | None = None, metric: str = "prenormalized-angular", fields: Sequence[str] | None = None, where: Column | None = None,
    modifiers: ScoreModifiers | None = None, limit: int = 10, offset: int = 0, strict: bool = True,
) -> DataFrame:
    """(_id, _score, _highlights[, fields of docs]) of one page, exactly.

    `where` filters documents before any is ranked.  Modifiers change the scores of what was retrieved: of
    each field the limit + offset nearest documents.
    """
    check_page(limit, offset)
    if where is not None:
        if docs is None:
            raise ValueError("a filter needs documents")
    scored = _scored(chunks, query, metric, fields).select("_id", "field", "s")
    if where is not None:
        # Scores move to the filtered ids, not vectors; the best of each document is then where its id is.
        scored = scored.join(docs.where(where).select("_id"), "_id", "left_semi")

    def with_highlights(ids: DataFrame) -> DataFrame:
        """What was found, with chunks: only scores are shuffled before the limit, chunks after it.  `ids` are a few pages of rows at most."""
        mine = chunks.join(F.broadcast(ids.select("_id")), "_id", "left_semi")
        return nearest_documents(tensor_scores(mine, query, metric=metric, fields=fields))

    if modifiers is None:
        cut = with_highlights(page(scored.groupBy("_id").agg(F.max("s").alias("_score")), limit, offset))
        return cut if docs is None else cut.join(docs, "_id")
    if docs is None:
        raise ValueError("modifiers need documents")
    names = list(fields) if fields is not None else [x[0] for x in chunks.select("field").distinct().collect()]
    if not names:
        return nearest_documents(tensor_scores(chunks, query, metric=metric, fields=[])).join(docs, "_id")
    by_field = [scored.where(F.col("field") == x).groupBy("_id").agg(F.max("s").alias("_score")) for x in names]
    wanted = reduce(DataFrame.unionByName, [x.orderBy(F.desc("_score"), "_id").limit(limit + offset).select("_id") for x in by_field]).distinct()
    joined = with_highlights(wanted).join(docs, "_id")
    return page(joined.withColumn("_score", modified(joined, F.col("_score"), modifiers, strict=strict)), limit, offset)


def lexical_search(
    docs: DataFrame, query: str, fields: Sequence[str], *, aggregator: str = "sum", df_scope: str = "fields", where: Column | None = None, modifiers: ScoreModifiers | None = None,
    limit: int = 10, offset: int = 0, strict: bool = True,
) -> DataFrame:
    """`docs` with _score and empty _highlights, of one page."""
    scored = lexical.bm25(docs, KeywordQuery.of(query), fields, aggregator=aggregator, df_scope=df_scope, candidates=where)
    scored = scored.withColumn("_score", modified(scored, F.col("_score"), modifiers, strict=strict))
    return page(scored, limit, offset).withColumn("_highlights", F.array().cast("array<map<string,string>>"))


def scored_page(docs: DataFrame, scores: DataFrame, *, where: Column | None = None, modifiers: ScoreModifiers | None = None, limit: int = 10, offset: int = 0, strict: bool = True) -> DataFrame:
    """As lexical_search, from (_id, _score): only ids and scores move before the limit, and the page's documents are joined after it."""
    check_page(limit, offset)
    if modifiers is not None:
        joined = (docs if where is None else docs.where(where)).join(scores, "_id")
        scores = joined.select("_id", modified(joined, F.col("_score"), modifiers, strict=strict).alias("_score"))
    elif where is not None:
        scores = scores.join(docs.where(where).select("_id"), "_id", "left_semi")
    found = page(scores, limit, offset)
    hits = docs.join(F.broadcast(found), "_id")  # one page
    return hits.withColumn("_highlights", F.array().cast("array<map<string,string>>")).orderBy(F.desc("_score"), "_id")


@dataclass(frozen=True)
class Hybrid:
    """How the two arms are put together, and what each has for itself; what is allowed with what."""

    retrieval: str = "disjunction"
    ranking: str = "rrf"
    alpha: float = 0.5
    rrf_k: int = 60
    tensor_attributes: Sequence[str] | None = None
    keyword_attributes: Sequence[str] | None = None
    tensor_modifiers: ScoreModifiers | None = None
    keyword_modifiers: ScoreModifiers | None = None

    def __post_init__(self):
        if self.retrieval not in ("disjunction", "tensor", "lexical") or self.ranking not in ("rrf", "tensor", "lexical"):
            raise ValueError("unknown retrieval or ranking method")
        if (self.retrieval == "disjunction") != (self.ranking == "rrf"):
            raise ValueError("disjunction goes with rrf, and rrf with disjunction")
        if not 0 <= self.alpha <= 1:
            raise ValueError("alpha is from 0 to 1")
        if not isinstance(self.rrf_k, int) or self.rrf_k < 0:
            raise ValueError("rrf_k is a whole number from 0 on")
        arms = ("tensor", "lexical") if self.retrieval == "disjunction" else (self.retrieval, self.ranking)
        if self.tensor_attributes is not None and "tensor" not in arms or self.keyword_attributes is not None and "lexical" not in arms:
            raise ValueError("attributes go with an arm that is in use")
        if self.tensor_modifiers and self.ranking == "lexical" or self.tensor_modifiers and "tensor" not in arms or self.keyword_modifiers and "lexical" not in arms:
            raise ValueError("modifiers go with an arm that is in use, those of the tensor arm with its ranking")


@dataclass(frozen=True)
class CustomVector:
    """A query by a vector; `content` is the text of the keyword arm."""

    vector: Sequence[float]
    content: str | None = None


def reciprocal_ranks(tensor: DataFrame | None, keyword: DataFrame | None, *, alpha: float = 0.5, k: int = 60, limit: int | None = None) -> DataFrame:
    """(_id, _score, _tensor_score, _lexical_score): alpha / (k + rank) of one page and (1 - alpha) / (k + rank) of the other; ties by _id.

    Without `limit` as many rows as the longer page has.  An arm that is None is not in the plan.
    """
    arms = []
    for rows, weight, name in ((tensor, alpha, "tensor"), (keyword, 1 - alpha, "lexical")):
        if rows is not None:
            arms.append(ranked(rows.select("_id", "_score")).select("_id", F.col("_score").alias(f"_{name}_score"), (F.lit(float(weight)) / (k + F.col("rank"))).alias(f"{name}_part")))
        else:
            arms.append(None)
    if arms[0] is None or arms[1] is None:
        only = arms[0] if arms[0] is not None else arms[1]
        missing = "lexical" if arms[1] is None else "tensor"
        joined = only.withColumns({f"_{missing}_score": F.lit(None).cast("double"), f"{missing}_part": F.lit(0.0)})
    else:
        joined = arms[0].join(arms[1], "_id", "full_outer")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    fused = joined.select("_id", (zero("tensor_part") + zero("lexical_part")).alias("_score"), "_tensor_score", "_lexical_score")
    if limit is None:
        counts = F.greatest(F.count("_tensor_score").over(Window.partitionBy()), F.count("_lexical_score").over(Window.partitionBy()))
        return ranked(fused.withColumn("most", counts)).where(F.col("rank") <= F.col("most")).drop("most", "rank")
    return fused.orderBy(F.desc("_score"), "_id").limit(limit)


def hybrid_search(
    docs: DataFrame, chunks: DataFrame, query: str | None, vector: Sequence[float], *, keyword_fields: Sequence[str], tensor_fields: Sequence[str] | None = None, hybrid: Hybrid | None = None, metric: str = "prenormalized-angular",
    where: Column | None = None, tensor_modifiers: ScoreModifiers | None = None, keyword_modifiers: ScoreModifiers | None = None, limit: int = 10, offset: int = 0,
) -> DataFrame:
    """(_id, _score, _tensor_score, _lexical_score) of one page.

    Disjunction fuses both arms' pages by reciprocal ranks.  Otherwise one arm retrieves limit + offset
    documents and the other one's score ranks them: BM25, 0 where nothing matches, or closeness.
    """
    hybrid = hybrid or Hybrid()
    check_page(limit, offset)
    keyword_fields, tensor_fields = hybrid.keyword_attributes or keyword_fields, hybrid.tensor_attributes or tensor_fields
    keyword_modifiers, tensor_modifiers = keyword_modifiers or hybrid.keyword_modifiers, tensor_modifiers or hybrid.tensor_modifiers
    if not isinstance(query, str) and (hybrid.retrieval, hybrid.ranking) != ("tensor", "tensor"):
        raise ValueError("the keyword arm takes a text")

    def tensor(limit, offset, modifiers=tensor_modifiers):
        return tensor_search(chunks, vector, docs=docs, metric=metric, fields=tensor_fields, where=where, modifiers=modifiers, limit=limit, offset=offset).select("_id", "_score")

    def keyword(limit, offset, modifiers=keyword_modifiers):
        return lexical_search(docs, query, keyword_fields, where=where, modifiers=modifiers, limit=limit, offset=offset).select("_id", "_score")

    if hybrid.retrieval == "disjunction":
        return reciprocal_ranks(tensor(limit, offset) if hybrid.alpha > 0 else None, keyword(limit, offset) if hybrid.alpha < 1 else None, alpha=hybrid.alpha, k=hybrid.rrf_k, limit=limit)
    if hybrid.retrieval == hybrid.ranking:
        rows, other = (tensor(limit, offset), "_lexical_score") if hybrid.ranking == "tensor" else (keyword(limit, offset), "_tensor_score")
        own = "_tensor_score" if hybrid.ranking == "tensor" else "_lexical_score"
        return rows.withColumns({own: F.col("_score"), other: F.lit(None).cast("double")}).select("_id", "_score", "_tensor_score", "_lexical_score")
    none = F.lit(None).cast("double")
    if hybrid.retrieval == "tensor":
        first = tensor(limit + offset, 0, None).select("_id")
        paged = docs.join(F.broadcast(first), "_id", "left_semi")  # limit + offset ids at most
        matched = lexical.bm25(docs, KeywordQuery.of(query), keyword_fields, within=paged).select("_id", F.col("_score").alias("found"))
        rows = paged.join(matched, "_id", "left").withColumn("_score", F.coalesce("found", F.lit(0.0)))
        rows = rows.withColumn("_score", modified(rows, F.col("_score"), keyword_modifiers))
        return page(rows, limit, offset).select("_id", "_score", none.alias("_tensor_score"), F.col("_score").alias("_lexical_score"))
    first = keyword(limit + offset, 0).select("_id")
    first = F.broadcast(first)  # limit + offset ids at most
    near = nearest_documents(tensor_scores(chunks.join(first, "_id", "left_semi"), vector, metric=metric, fields=tensor_fields))
    rows = docs.join(first, "_id", "left_semi").join(near, "_id", "left").withColumn("_score", F.coalesce("_score", F.lit(0.0)))
    rows = rows.withColumn("_score", modified(rows, F.col("_score"), tensor_modifiers))
    return page(rows, limit, offset).select("_id", "_score", F.col("_score").alias("_tensor_score"), none.alias("_lexical_score"))


def projected(hits: DataFrame, attributes: Sequence[str] | None, *, strict: bool) -> DataFrame:
    """Only the wanted fields, and always _id and what search added; unknown names are an error if `strict`."""
    if attributes is None:
        return hits
    unknown = [x for x in attributes if x not in hits.columns]
    if unknown and strict:
        raise ValueError(f"no such fields: {', '.join(unknown)}")
    always = {"_id", "_score", "_tensor_score", "_lexical_score", "_highlights", "rank"}
    return hits.select(*(x for x in hits.columns if x in always or x in attributes))


def tensor_facets(chunks: DataFrame) -> DataFrame:
    """(_id, _tensor_facets): all chunks of a document with their vectors, by field and place."""
    rows = chunks.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("field", "chunk_idx", "chunk", "embedding"))).alias("all"))
    return rows.select("_id", F.transform("all", lambda x: F.struct(x["field"].alias("field"), x["chunk"].alias("chunk"), x["embedding"].alias("_embedding"))).alias("_tensor_facets"))
