"""Keyword search from an inverted index that is written once and read by term.

The index of a table of documents has two parts: *terms* (bucket, field, term, _id, tf, dl, places), dealt by term into buckets,
and *lengths* (field, documents, length), one row for each field.  Texts are cut when the index is made; a query reads
the rows of its own terms, which Parquet finds by bucket and by term, and moves a row for each document that has one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators.lexical import AGGREGATORS, B, K1, KeywordQuery, with_tokens, words_of

#: Buckets of terms; a query reads as many as it has terms.
BUCKETS = 16


def bucket_of(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index_terms(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(bucket, field, term, _id, tf, dl, places) of `docs` (_id, fields); to be written partitioned by bucket and sorted by term."""
    tokened = with_tokens(docs.select("_id", *(F.col(f"`{x}`") for x in fields)), fields)
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("field"), F.col(f"tokens_{x}").alias("tokens")) for x in fields)))
    words = tokened.select("_id", each.alias("e")).select("_id", "e.field", F.size("e.tokens").cast("long").alias("dl"), F.posexplode("e.tokens").alias("place", "term"))
    rows = words.groupBy("field", "term", "_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.array_sort(F.collect_list("place")).alias("places"))
    return rows.select(bucket_of("term").alias("bucket"), "field", "term", "_id", "tf", "dl", "places")


def index_lengths(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, documents, rows, length): all documents, those that have the field, and its words in them together."""
    tokened = with_tokens(docs, fields)
    sums = tokened.agg(F.count("*").alias("n"), *(y for k, x in enumerate(fields) for y in (F.count(F.col(f"`{x}`")).alias(f"r{k}"), F.coalesce(F.sum(F.when(F.col(f"`{x}`").isNotNull(), F.size(f"tokens_{x}"))), F.lit(0)).alias(f"l{k}"))))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("field"), F.col("n").alias("documents"), F.col(f"r{k}").alias("rows"), F.col(f"l{k}").cast("long").alias("length")) for k, x in enumerate(fields))))
    return sums.select(each.alias("e")).select("e.*")


def with_words(docs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """`docs` with _words, the number of words of each field; null where the field is."""
    sizes = [F.when(F.col(f"`{x}`").isNotNull(), F.size(X.tokens(F.col(f"`{x}`")))) if x in docs.columns else F.lit(None).cast("int") for x in fields]
    return docs.withColumn("_words", F.array(*sizes) if sizes else F.array().cast("array<int>"))


def lengths_of_words(counted: DataFrame, fields: Sequence[str]) -> DataFrame:
    """As index_lengths, from (_words, sign): rows of sign -1 are taken off, so that the lengths of several changes add up."""
    of = lambda k, x: F.coalesce(F.sum(F.when(F.col("_words")[k].isNotNull(), F.col("sign") * x)), F.lit(0)).cast("long")
    sums = counted.agg(F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("n"), *(y for k, _ in enumerate(fields) for y in (of(k, F.lit(1)).alias(f"r{k}"), of(k, F.col("_words")[k]).alias(f"l{k}"))))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("field"), F.col("n").alias("documents"), F.col(f"r{k}").alias("rows"), F.col(f"l{k}").alias("length")) for k, x in enumerate(fields))))
    return sums.select(each.alias("e")).select("e.*")


def _phrase(places: dict[str, F.Column], words: Sequence[str]):
    """Whether a place of the first word has the others after it."""
    return F.exists(places[words[0]], lambda p: reduce(lambda a, b: a & b, [F.array_contains(places[w], p + k) for k, w in enumerate(words) if k], F.lit(True)))


def index_search(terms: DataFrame, lengths: DataFrame, query: str | KeywordQuery, fields: Sequence[str], *, aggregator: str = "sum") -> DataFrame:
    """(_id, _score) of all documents that match, as lexical.bm25 has them with `df_scope` fields.

    `*` alone and queries without words have no terms to read: the one is the table itself, the others are empty, which
    is an error here and no row.
    """
    if aggregator not in AGGREGATORS:
        raise ValueError(f"unknown aggregator {aggregator!r}; one of {', '.join(AGGREGATORS)}")
    query = KeywordQuery.of(query) if isinstance(query, str) else query
    if query.everything:
        raise ValueError("all documents are not read from an index")
    fields = list(dict.fromkeys(fields))
    asked = [w for x in (*query.optional, *query.required) for w in words_of(x)]
    words = list(dict.fromkeys(asked))
    buckets = [r[0] for r in terms.sparkSession.createDataFrame([(w,) for w in words], "w string").select(bucket_of("w")).distinct().collect()] if words else []
    rows = terms.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*words) & F.col("field").isin(*fields)) if words else terms.where(F.lit(False))
    sizes = {x["field"]: x for x in lengths.where(F.col("field").isin(*fields)).collect()}
    total = max((x["documents"] for x in sizes.values()), default=0)
    mine = lambda f, w: (F.col("field") == f) & (F.col("term") == w)
    by_id = rows.groupBy("_id").agg(
        *(F.coalesce(F.max(F.when(mine(f, w), F.col("tf"))), F.lit(0)).cast("double").alias(f"tf_{i}_{j}") for i, f in enumerate(fields) for j, w in enumerate(words)),
        *(F.max(F.when(F.col("field") == f, F.col("dl"))).alias(f"dl_{i}") for i, f in enumerate(fields)),
        *(F.coalesce(F.first(F.when(mine(f, w), F.col("places")), ignorenulls=True), F.array().cast("array<int>")).alias(f"at_{i}_{j}") for i, f in enumerate(fields) for j, w in enumerate(words) if any(w in words_of(x) for x in _phrases(query))),
    )
    has = lambda j: reduce(lambda a, b: a | b, [F.col(f"tf_{i}_{j}") > 0 for i in range(len(fields))])
    counts = by_id.agg(*(F.count_if(has(j)).alias(f"d{j}") for j in range(len(words)))).first() if words else []

    def contains(phrase: str):
        parts = words_of(phrase)
        if not parts:
            return F.lit(False)
        if len(parts) == 1:
            return has(words.index(parts[0]))
        return reduce(lambda a, b: a | b, [_phrase({w: F.col(f"at_{i}_{words.index(w)}") for w in parts}, parts) for i in range(len(fields))])

    tests = [contains(x) for x in query.required]
    if query.optional:
        tests.append(reduce(lambda a, b: a | b, [contains(x) for x in query.optional]))
    found = by_id.where(reduce(lambda a, b: a & b, tests) if tests else F.lit(False))
    scores = []
    for i, f in enumerate(fields):
        mean = sizes[f]["length"] / sizes[f]["rows"] if f in sizes and sizes[f]["rows"] else 1.0
        score = F.lit(0.0)
        for w in asked:
            j = words.index(w)
            tf = F.col(f"tf_{i}_{j}")
            idf = F.log(F.lit(1 + (total - counts[j] + 0.5) / (counts[j] + 0.5)))
            score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.coalesce(F.col(f"dl_{i}"), F.lit(0)) / F.lit(float(mean or 1.0))))
        scores.append(score)
    score = F.greatest(*scores) if aggregator == "max" and len(scores) > 1 else reduce(lambda a, b: a + b, scores)
    return found.select("_id", (score / len(fields) if aggregator == "avg" else score).alias("_score"))


def _phrases(query: KeywordQuery) -> list[str]:
    return [x for x in (*query.required, *query.optional) if len(words_of(x)) > 1]
