"""A query for each operator over a folder of tables, with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.functions.interpolation import mean_vectors
from tessera.functions.scoring import ScoreModifiers
from tessera.operators import documents as D
from tessera.operators import embedding as E
from tessera.operators import lexical as L
from tessera.operators import inverted as I
from tessera.operators import search as S
from tessera.operators.approximate import approximate_search, projections
from tessera.operators.boxes import best_boxes
from tessera.operators.cells import Cells, cell_search, dealt, measured
from tessera.operators.recommend import recommend
from tessera.operators.rerank import rerank
from tessera.plans.filters import inferred_filter, structured_filter
from tessera.plans.spec import Field, IndexSpec
from tessera.streaming.upserts import arrivals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _embeddings(spark, folder) -> DataFrame:
    return _table(spark, folder, "embeddings").withColumn("_id", F.col("vec_id").cast("string"))


def _chunks(spark, folder) -> DataFrame:
    return _embeddings(spark, folder).select("_id", F.lit("v").alias("field"), F.lit(0).alias("chunk_idx"), F.concat(F.lit("label "), "label").alias("chunk"), "embedding")


def _vector(spark, folder, vec_id: int) -> list[float]:
    """One row's vector: a literal of the plan."""
    return [float(x) for x in _embeddings(spark, folder).where(F.col("vec_id") == vec_id).first()["embedding"]]


def _rounded(hits: DataFrame, *names: str) -> DataFrame:
    return hits.select("_id", F.round("_score", 6).alias("score"), *names)


_E = "e AS (SELECT vec_id::VARCHAR AS _id, vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_Q = "q AS (SELECT v AS u FROM e WHERE vec_id = 0)"
_NORM = "sqrt(list_sum(list_transform({0}, lambda x: x * x)))"
_CLOSE = {
    "prenormalized-angular": "1 / (2 - list_dot_product(v, u))",
    "angular": f"1 / (1 + acos(greatest(-1, least(1, list_dot_product(v, u) / ({_NORM.format('v')} * {_NORM.format('u')})))))",
    "euclidean": "1 / (1 + sqrt(list_sum(list_transform(list_zip(v, u), lambda p: (p[1] - p[2]) * (p[1] - p[2])))))",
    "dotproduct": "list_dot_product(v, u)",
}


def _top(metric: str) -> str:
    return f"WITH {_E}, {_Q} SELECT _id, round({_CLOSE[metric]}, 6) AS score FROM e, q ORDER BY {_CLOSE[metric]} DESC, _id LIMIT 10"


def _metric_query(metric: str):
    def run(spark, folder):
        return _rounded(S.tensor_search(_chunks(spark, folder), _vector(spark, folder, 0), metric=metric, limit=10))

    run.__name__ = f"tensor_topk_{metric.replace('-', '_')}"
    query(_top(metric))(run)


for _metric in _CLOSE:
    _metric_query(_metric)


@query("""
SELECT s_suppkey::VARCHAR AS _id, round(1 / (1 + 2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin((radians(48.0) - radians((s_suppkey % 90)::DOUBLE)) / 2), 2)
  + cos(radians((s_suppkey % 90)::DOUBLE)) * cos(radians(48.0)) * pow(sin((radians(11.0) - radians((s_nationkey * 7 - 80)::DOUBLE)) / 2), 2))))), 9) AS score FROM supplier
""")
def metric_geodegrees(spark, folder):
    place = F.array((F.col("s_suppkey") % 90).cast("double"), (F.col("s_nationkey") * 7 - 80).cast("double"))
    return _table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("_id"), F.round(V.closeness("geodegrees", place, V.literal([48.0, 11.0])), 9).alias("score"))


@query("SELECT p_partkey::VARCHAR AS _id, round(1 / (1 + bit_count(xor(p_size::INTEGER, 21)) + bit_count(xor((p_partkey % 256)::INTEGER, 170)))::DOUBLE, 6) AS score FROM part")
def metric_hamming(spark, folder):
    bits = F.array(F.col("p_size").cast("double"), (F.col("p_partkey") % 256).cast("double"))
    return _table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("_id"), F.round(V.closeness("hamming", bits, V.literal([21, 170])), 6).alias("score"))


@query(f"WITH {_E}, {_Q} SELECT _id, round({_CLOSE['prenormalized-angular']}, 6) AS score FROM e, q WHERE label IN (1, 3) AND vec_id BETWEEN 10 AND 400 ORDER BY {_CLOSE['prenormalized-angular']} DESC, _id LIMIT 10")
def tensor_topk_filtered(spark, folder):
    docs = _embeddings(spark, folder).select("_id", "vec_id", "label")
    where = structured_filter(docs, "label IN (1, 3) AND vec_id:[10 TO 400]")
    return _rounded(S.tensor_search(_chunks(spark, folder), _vector(spark, folder, 0), docs=docs, where=where, limit=10))


@query(f"WITH {_E}, {_Q} SELECT _id, round({_CLOSE['prenormalized-angular']}, 6) AS score FROM e, q ORDER BY {_CLOSE['prenormalized-angular']} DESC, _id LIMIT 7 OFFSET 14")
def tensor_paginated(spark, folder):
    return _rounded(S.tensor_search(_chunks(spark, folder), _vector(spark, folder, 0), limit=7, offset=14))


@query(f"WITH {_E}, {_Q} SELECT label::VARCHAR AS _id, round(max({_CLOSE['prenormalized-angular']}), 6) AS score FROM e, q GROUP BY label")
def chunk_to_doc_max(spark, folder):
    chunks = _embeddings(spark, folder).select(F.col("label").cast("string").alias("_id"), F.lit("v").alias("field"), F.col("vec_id").cast("int").alias("chunk_idx"), F.lit("").alias("chunk"), "embedding")
    return S.tensor_scores(chunks, _vector(spark, folder, 0)).select("_id", F.round("_score", 6).alias("score"))


@query(f"""WITH {_E}, {_Q}, f AS (SELECT (vec_id // 2)::VARCHAR AS _id, CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS field, {_CLOSE['prenormalized-angular']} AS s, vec_id FROM e, q),
b AS (SELECT _id, field, max(s) AS s FROM f GROUP BY ALL)
SELECT _id, round(max(s), 6) AS score, arg_max(field, s) AS field FROM b GROUP BY _id""")
def field_max_reduction(spark, folder):
    chunks = _embeddings(spark, folder).select(F.expr("string(vec_id div 2)").alias("_id"), F.when(F.col("label") < 5, "low").otherwise("high").alias("field"), F.col("vec_id").cast("int").alias("chunk_idx"), F.col("_id").alias("chunk"), "embedding")
    best = S.nearest_documents(S.tensor_scores(chunks, _vector(spark, folder, 0), fields=["low", "high"]))
    return best.select("_id", F.round("_score", 6).alias("score"), F.get(F.map_keys(F.get("_highlights", F.lit(0))), F.lit(0)).alias("field"))


@query()
def tensor_topk_approximate(spark, folder):
    """By random projections; recall is tested."""
    model, index = projections(_chunks(spark, folder))
    return _rounded(approximate_search(model, index, _vector(spark, folder, 0), explored=300))


def _cells(spark, folder, metric: str) -> Cells:
    rows, centres = dealt(_chunks(spark, folder), metric=metric, cells=32)
    return Cells.of_rows(rows, measured(rows, centres, metric), metric)


@query(_top("euclidean"))
def tensor_topk_cells(spark, folder):
    """Exact, by the cells that can hold a row of the page."""
    return _rounded(cell_search(_cells(spark, folder, "euclidean"), _vector(spark, folder, 0)))


@query(f"WITH {_E}, {_Q} SELECT _id, round({_CLOSE['angular']}, 6) AS score FROM e, q WHERE label IN (1, 3) ORDER BY {_CLOSE['angular']} DESC, _id LIMIT 5 OFFSET 10")
def tensor_cells_filtered_page(spark, folder):
    docs = _embeddings(spark, folder).select("_id", "label")
    where = structured_filter(docs, "label IN (1, 3)")
    return _rounded(cell_search(_cells(spark, folder, "angular"), _vector(spark, folder, 0), docs=docs, where=where, limit=5, offset=10))


@query("SELECT 'none' AS _id, 0.0::DOUBLE AS score WHERE false")
def tensor_no_fields(spark, folder):
    return _rounded(S.tensor_search(_chunks(spark, folder), _vector(spark, folder, 0), fields=[]))


def _mean_sql(parts: str, tail: str = "") -> str:
    """Top 10 by the normalised mean of weight * vector; `parts` selects (vec_id, w)."""
    return f"""WITH {_E}, parts(vec_id, w) AS ({parts}), x AS (SELECT unnest(range(1, len(v) + 1)) AS p, unnest(list_transform(v, lambda y: y * w)) AS y FROM e JOIN parts USING (vec_id)),
m AS (SELECT p, sum(y) / (SELECT count(*) FROM parts) AS y FROM x GROUP BY p), r AS (SELECT list(y ORDER BY p) AS z FROM m),
q AS (SELECT list_transform(z, lambda y: y / {_NORM.format('z')}) AS u FROM r)
SELECT _id, round({_CLOSE['prenormalized-angular']}, 6) AS score FROM e, q {tail} ORDER BY {_CLOSE['prenormalized-angular']} DESC, _id LIMIT 10"""


@query(_mean_sql("VALUES (0, 2.0::DOUBLE), (1, 1.0::DOUBLE), (2, -0.5::DOUBLE)"))
def weighted_multi_query(spark, folder):
    v = E.query_vector([(_vector(spark, folder, k), w) for k, w in ((0, 2.0), (1, 1.0), (2, -0.5))], dimensions=64)
    return _rounded(S.tensor_search(_chunks(spark, folder), v))


@query(_mean_sql("VALUES (5, 1.0::DOUBLE), (6, 0.25::DOUBLE)"))
def context_vectors(spark, folder):
    v = E.embed_query(None, E.NoModel(64), context=[(_vector(spark, folder, 5), 1.0), (_vector(spark, folder, 6), 0.25)])
    return _rounded(S.tensor_search(_chunks(spark, folder), v))


@query(_mean_sql("VALUES (9, 1.0::DOUBLE)"))
def custom_vector_query(spark, folder):
    v = E.query_vector([(_vector(spark, folder, 9), 1.0)], dimensions=64)
    return _rounded(S.tensor_search(_chunks(spark, folder), v))


@query(_mean_sql("VALUES (3, 1.0::DOUBLE), (4, 3.0::DOUBLE)", "WHERE vec_id NOT IN (3, 4)"))
def recommend_lerp(spark, folder):
    return _rounded(recommend(_chunks(spark, folder), {"3": 1.0, "4": 3.0}, method="lerp"))


@query(_mean_sql("VALUES (3, 1.0::DOUBLE), (4, 1.0::DOUBLE), (7, 1.0::DOUBLE)", "WHERE vec_id NOT IN (3, 4, 7)"))
def recommend_nlerp(spark, folder):
    return _rounded(recommend(_chunks(spark, folder), ["3", "4", "7"], method="nlerp"))


@query(_mean_sql("VALUES (3, 1.0::DOUBLE), (4, 1.0::DOUBLE)"))
def recommend_with_inputs(spark, folder):
    return _rounded(recommend(_chunks(spark, folder), {"3": 1.0, "4": 1.0}, method="lerp", exclude=False))


@query(_mean_sql("VALUES (3, 2.0::DOUBLE)", "WHERE vec_id NOT IN (3, 8)"))
def recommend_exclude_inputs(spark, folder):
    return _rounded(recommend(_chunks(spark, folder), {"3": 2.0, "8": 0.0}, method="slerp"))


@query(f"""WITH {_E}, a AS (SELECT v AS a FROM e WHERE vec_id = 3), b AS (SELECT v AS b FROM e WHERE vec_id = 4),
g AS (SELECT a, b, acos(list_dot_product(a, b) / ({_NORM.format('a')} * {_NORM.format('b')})) AS g FROM a, b),
z AS (SELECT list_transform(list_zip(a, b), lambda p: (sin(0.25 * g) * p[1] + sin(0.75 * g) * p[2]) / sin(g)) AS z FROM g),
q AS (SELECT list_transform(z, lambda y: y / {_NORM.format('z')}) AS u FROM z)
SELECT _id, round({_CLOSE['prenormalized-angular']}, 6) AS score FROM e, q WHERE vec_id NOT IN (3, 4) ORDER BY {_CLOSE['prenormalized-angular']} DESC, _id LIMIT 10""")
def recommend_slerp(spark, folder):
    return _rounded(recommend(_chunks(spark, folder), {"3": 1.0, "4": 3.0}))


@query(f"WITH {_E} SELECT _id, list_transform(v, lambda x: round(x / {_NORM.format('v')}, 5)) AS unit FROM e")
def normalize_vectors(spark, folder):
    return _embeddings(spark, folder).select("_id", F.transform(V.normalised(V.doubles("embedding")), lambda x: V.rounded(x, 5)).alias("unit"))


_COMBO = f"""WITH {_E}, parts AS (SELECT (vec_id // 3)::VARCHAR AS doc, ['a', 'b', 'c'][vec_id % 3 + 1] AS field, [0.5, 0.3, 0.2][vec_id % 3 + 1]::DOUBLE AS w, v FROM e),
x AS (SELECT doc, unnest(range(1, 65)) AS p, unnest(list_transform(v, lambda y: y * w)) AS y FROM parts),
m AS (SELECT doc, p, sum(y) / count(*) AS y FROM x GROUP BY ALL), r AS (SELECT doc, list(y ORDER BY p) AS z FROM m GROUP BY doc)
SELECT doc AS _id, round(z[1] / {_NORM.format('z')}, 5) AS first, round(z[64] / {_NORM.format('z')}, 5) AS last FROM r"""


@query(_COMBO)
def multimodal_combination(spark, folder):
    field = F.get(F.array(*map(F.lit, "abc")), (F.col("vec_id") % 3).cast("int"))
    parts = _embeddings(spark, folder).select(F.expr("string(vec_id div 3)").alias("_id"), field.alias("field"), "embedding")
    made = E.combined(parts, {"a": 0.5, "b": 0.3, "c": 0.2}, name="abc")
    return made.select("_id", V.rounded(F.get("embedding", F.lit(0)), 5).alias("first"), V.rounded(F.get("embedding", F.lit(63)), 5).alias("last"))


@query(f"WITH {_E}, x AS (SELECT label, unnest(range(0, 64)) AS p, unnest(v) AS y FROM e) SELECT label, p::INTEGER AS part, round(avg(y), 5) AS mean FROM x GROUP BY ALL")
def mean_vector_by_group(spark, folder):
    means = mean_vectors(_embeddings(spark, folder), ["label"])
    return means.select("label", F.posexplode("embedding").alias("part", "m")).select("label", "part", V.rounded(F.col("m"), 5).alias("mean"))


# -- keywords


def _documents(spark, folder) -> DataFrame:
    return _table(spark, folder, "documents").withColumn("_id", F.col("doc_id").cast("string"))


def _parts(spark, folder) -> DataFrame:
    return _table(spark, folder, "part").withColumn("_id", F.col("p_partkey").cast("string"))


def _tokens_sql(field: str) -> str:
    return rf"list_filter(string_split_regex(lower({field}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _bm25_sql(table: str, key: str, fields: list[str], terms: list[str], how: str = "sum", scope: str = "fields", matched: str | None = None, tail: str = "", where: str = "true", only_scores: bool = False) -> str:
    """BM25 in SQL: statistics over the whole table, one column for each field and term."""
    toks = ", ".join(f"{_tokens_sql(f)} AS t{k}" for k, f in enumerate(fields))
    stats = ["count(*)::DOUBLE AS n"] + [f"avg(len(t{k})) FILTER ({f} IS NOT NULL) AS l{k}" for k, f in enumerate(fields)]
    for j, term in enumerate(terms):
        has = [f"list_contains(t{k}, '{term}')" for k in range(len(fields))]
        stats += [f"count(*) FILTER ({' OR '.join(has)})::DOUBLE AS d{j}_{k}" for k in range(len(fields))] if scope == "fields" else [f"count(*) FILTER ({h})::DOUBLE AS d{j}_{k}" for k, h in enumerate(has)]
    scores = []
    for k in range(len(fields)):
        tf = "len(list_filter(t{k}, lambda x: x = '{t}'))::DOUBLE"
        scores.append(" + ".join(f"ln(1 + (n - d{j}_{k} + 0.5) / (d{j}_{k} + 0.5)) * {tf.format(k=k, t=t)} * 2.2::DOUBLE / ({tf.format(k=k, t=t)} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t{k}) / l{k}))" for j, t in enumerate(terms)))
    score = f"greatest({', '.join(scores)})" if how == "max" and len(scores) > 1 else " + ".join(f"({s})" for s in scores)
    score = f"({score}) / {len(fields)}" if how == "avg" else score
    matched = matched or " OR ".join(f"list_contains(t{k}, '{t}')" for k in range(len(fields)) for t in terms)
    body = f"t AS (SELECT *, {toks} FROM {table}), s AS (SELECT {', '.join(stats)} FROM t), b AS (SELECT {key}::VARCHAR AS _id, {score} AS raw FROM t, s WHERE ({matched}) AND ({where}))"
    return body if only_scores else f"WITH {body} SELECT _id, round(raw, 6) AS score FROM b {tail}"


_BY_SCORE = "ORDER BY raw DESC, _id LIMIT {0}"


@query(_bm25_sql("documents", "doc_id", ["text"], ["idiot", "nicht", "that"], tail=_BY_SCORE.format(20)))
def bm25_single_field(spark, folder):
    return _rounded(S.lexical_search(_documents(spark, folder), "idiot nicht that", ["text"], limit=20))


def _part_query(how: str):
    def run(spark, folder):
        return _rounded(L.bm25(_parts(spark, folder), L.KeywordQuery.of("red steel brass"), ["p_name", "p_type"], aggregator=how))

    run.__name__ = f"bm25_{how}_fields"
    query(_bm25_sql("part", "p_partkey", ["p_name", "p_type"], ["red", "steel", "brass"], how))(run)


for _how in L.AGGREGATORS:
    _part_query(_how)


@query(_bm25_sql("part", "p_partkey", ["p_name", "p_type"], ["red", "steel"], scope="field"))
def bm25_df_by_field(spark, folder):
    return _rounded(L.bm25(_parts(spark, folder), L.KeywordQuery.of("red steel"), ["p_name", "p_type"], df_scope="field"))


@query(_bm25_sql("documents", "doc_id", ["text"], ["by", "the", "that"], matched="list_contains(t0, 'the') AND list_contains(t0, 'that') AND list_contains(t0, 'by')"))
def lexical_required_terms(spark, folder):
    return _rounded(L.bm25(_documents(spark, folder), L.KeywordQuery.of('by "the" "that"'), ["text"]))


@query(_bm25_sql("documents", "doc_id", ["text"], ["of", "the"], matched="contains(' ' || array_to_string(t0, ' ') || ' ', ' of the ')"))
def lexical_phrase(spark, folder):
    return _rounded(L.bm25(_documents(spark, folder), L.KeywordQuery.of('"of the"'), ["text"]))


@query("SELECT doc_id::VARCHAR AS _id, 0.0::DOUBLE AS score FROM documents")
def lexical_wildcard(spark, folder):
    return _rounded(L.bm25(_documents(spark, folder), L.KeywordQuery.of("*"), ["text"]))


@query("SELECT doc_id::VARCHAR AS _id, 0.0::DOUBLE AS score FROM documents WHERE false")
def lexical_empty(spark, folder):
    return _rounded(L.bm25(_documents(spark, folder), L.KeywordQuery.of('""'), ["text"]))


@query(_bm25_sql("documents", "doc_id", ["text"], ["that", "with"], where="lang = 'en' AND n_chars BETWEEN 100 AND 2000", tail=_BY_SCORE.format(25)))
def lexical_filtered(spark, folder):
    docs = _documents(spark, folder)
    return _rounded(S.lexical_search(docs, "that with", ["text"], where=structured_filter(docs, "lang:en AND n_chars:[100 TO 2000]"), limit=25))


@query(f"""WITH t AS (SELECT p_partkey, unnest([{{'f': 'p_name', 't': {_tokens_sql('p_name')}}}, {{'f': 'p_type', 't': {_tokens_sql('p_type')}}}]) AS s FROM part), x AS (SELECT p_partkey, s.f AS field, unnest(s.t) AS term, len(s.t) AS dl FROM t)
SELECT field, term, p_partkey::VARCHAR AS _id, count(*) AS tf, dl FROM x GROUP BY ALL""")
def postings(spark, folder):
    return L.postings(_parts(spark, folder), ["p_name", "p_type"]).select("field", "term", "_id", "tf", "dl")


# -- filters


def _filter_query(name: str, table: str, key: str, text: str, sql: str):
    def run(spark, folder):
        docs = _table(spark, folder, table)
        return docs.where(structured_filter(docs, text)).select(key)

    run.__name__ = name
    query(f"SELECT {key} FROM {table} WHERE {sql}")(run)


_filter_query("filter_equality", "orders", "o_orderkey", "o_orderstatus:F AND o_orderpriority:(1-URGENT)", "o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
_filter_query("filter_range_open", "customer", "c_custkey", "c_acctbal:[5000.5 TO *] OR c_acctbal:[* TO -500]", "c_acctbal >= 5000.5 OR c_acctbal <= -500")
_filter_query("filter_in", "part", "p_partkey", "p_size IN (1, 7, 15) AND NOT p_brand IN (Brand#11, (Brand#23))", "p_size IN (1, 7, 15) AND p_brand NOT IN ('Brand#11', 'Brand#23')")
_filter_query("filter_nested", "customer", "c_custkey", "c_mktsegment:BUILDING AND (c_nationkey:3 OR (c_nationkey:[10 TO 12] AND NOT c_acctbal:[0 TO 1000])) OR c_custkey:17", "c_mktsegment = 'BUILDING' AND (c_nationkey = 3 OR (c_nationkey BETWEEN 10 AND 12 AND NOT c_acctbal BETWEEN 0 AND 1000)) OR c_custkey = 17")
_filter_query("filter_escaped", "part", "p_partkey", r"p_brand:Brand\#11 AND p_size:[1 TO 20]", "p_brand = 'Brand#11' AND p_size BETWEEN 1 AND 20")


@query("SELECT c_custkey FROM customer WHERE NOT coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END = 'BUILDING', false)")
def filter_not_null_semantics(spark, folder):
    docs = _table(spark, folder, "customer").withColumn("segment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    return docs.where(structured_filter(docs, "NOT segment:BUILDING")).select("c_custkey")


@query("SELECT p_partkey FROM part WHERE list_contains(string_split(p_type, ' '), 'STEEL') AND p_size > 25 OR list_contains(string_split(p_type, ' '), 'COPPER') AND p_size <= 25")
def filter_array_and_bool(spark, folder):
    docs = _table(spark, folder, "part").withColumns({"words": F.split("p_type", " "), "large": F.col("p_size") > 25})
    return docs.where(structured_filter(docs, "words:STEEL AND large:True OR words:COPPER AND large:false")).select("p_partkey")


@query("SELECT c_custkey::VARCHAR AS _id FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey BETWEEN 5 AND 9 OR c_custkey = 4")
def filter_inferred_fields(spark, folder):
    flat = D.flattened(_table(spark, folder, "customer").withColumn("_id", F.col("c_custkey").cast("string")))
    return flat.where(inferred_filter("c_mktsegment:MACHINERY AND c_nationkey:[5 TO 9] OR _id:4")).select("_id")


# -- score modifiers


@query("SELECT p_partkey::VARCHAR AS _id, round((2.0::DOUBLE * p_size) * 1.0::DOUBLE + (0.5::DOUBLE * p_retailprice - p_size), 6) AS score FROM part")
def score_modifiers_mult_add(spark, folder):
    docs = _parts(spark, folder)
    m = ScoreModifiers.of({"multiply_score_by": [{"field_name": "p_size", "weight": 2}], "add_to_score": [{"field_name": "p_retailprice", "weight": 0.5}, {"field_name": "p_size", "weight": -1}]})
    return docs.select("_id", V.rounded(S.modified(docs, F.lit(1.0), m), 6).alias("score"))


@query("SELECT p_partkey::VARCHAR AS _id, round(CASE WHEN p_size % 2 = 0 THEN 10.0 * p_size ELSE 1.0 END * 0.5 + CASE WHEN p_size % 5 = 0 THEN -3.0 * p_size ELSE 0.0 END, 6)::DOUBLE AS score FROM part")
def score_modifiers_missing_field(spark, folder):
    docs = _parts(spark, folder).withColumns({"even": F.when(F.col("p_size") % 2 == 0, F.col("p_size")), "fifth": F.when(F.col("p_size") % 5 == 0, F.col("p_size"))})
    return docs.select("_id", V.rounded(S.modified(docs, F.lit(0.5), ScoreModifiers({"even": 10.0}, {"fifth": -3.0})), 6).alias("score"))


@query("SELECT event_id::VARCHAR AS _id, round(coalesce(2.0 * json_extract(props, '$.k')::DOUBLE, 1.0) * 3.0 + value, 6)::DOUBLE AS score FROM events")
def score_modifiers_map(spark, folder):
    docs = _table(spark, folder, "events").withColumns({"_id": F.col("event_id").cast("string"), "props": F.from_json("props", "map<string,double>")})
    return docs.select("_id", V.rounded(S.modified(docs, F.lit(3.0), ScoreModifiers({"props.k": 2.0}, {"value": 1.0})), 6).alias("score"))


@query(f"""WITH {_E}, {_Q}, near AS (SELECT _id, label, {_CLOSE['prenormalized-angular']} AS s FROM e, q ORDER BY s DESC, _id LIMIT 20)
SELECT _id, round(label * 0.5 * s + 10.0 * label, 6)::DOUBLE AS score FROM near ORDER BY label * 0.5 * s + 10.0 * label DESC, _id LIMIT 20""")
def tensor_search_modified(spark, folder):
    docs = _embeddings(spark, folder).select("_id", "label")
    return _rounded(S.tensor_search(_chunks(spark, folder), _vector(spark, folder, 0), docs=docs, modifiers=ScoreModifiers({"label": 0.5}, {"label": 10.0}), limit=20))


# -- hybrid search: documents and vectors with one id


def _both(spark, folder) -> tuple[DataFrame, DataFrame]:
    return _documents(spark, folder), _chunks(spark, folder)


def _hybrid(spark, folder, how: S.Hybrid, **options) -> DataFrame:
    docs, chunks = _both(spark, folder)
    chunks = chunks.join(docs.select("_id"), "_id", "left_semi")
    hits = S.hybrid_search(docs, chunks, "that with from", _vector(spark, folder, 0), keyword_fields=["text"], hybrid=how, **options)
    return hits.select("_id", F.round("_score", 6).alias("score"), F.round("_tensor_score", 6).alias("tensor_score"), F.round("_lexical_score", 6).alias("lexical_score"))


_B = _bm25_sql("documents", "doc_id", ["text"], ["that", "with", "from"], only_scores=True)
_ARMS = f"""{_E}, {_Q}, n AS (SELECT _id, {_CLOSE['prenormalized-angular']} AS s FROM e, q WHERE vec_id IN (SELECT doc_id FROM documents)), {_B},
a AS (SELECT *, row_number() OVER (ORDER BY s DESC, _id) AS r FROM n QUALIFY r <= 10), k AS (SELECT *, row_number() OVER (ORDER BY raw DESC, _id) AS r FROM b QUALIFY r <= 10)"""


def _rrf_sql(alpha: float, k: int) -> str:
    arms = {0.0: "SELECT _id, NULL::DOUBLE AS s, raw, NULL::BIGINT AS ra, r AS rk FROM k", 1.0: "SELECT _id, s, NULL::DOUBLE AS raw, r AS ra, NULL::BIGINT AS rk FROM a"}
    both = arms.get(alpha, "SELECT coalesce(a._id, k._id) AS _id, s, raw, a.r AS ra, k.r AS rk FROM a FULL JOIN k ON a._id = k._id")
    score = f"coalesce({alpha}::DOUBLE / ({k} + ra), 0) + coalesce({1 - alpha}::DOUBLE / ({k} + rk), 0)"
    return f"WITH {_ARMS}, f AS ({both}) SELECT _id, round({score}, 6) AS score, round(s, 6) AS tensor_score, round(raw, 6) AS lexical_score FROM f ORDER BY {score} DESC, _id LIMIT 10"


@query(_rrf_sql(0.5, 60))
def hybrid_rrf(spark, folder):
    return _hybrid(spark, folder, S.Hybrid())


@query(_rrf_sql(0.3, 10))
def hybrid_rrf_weighted(spark, folder):
    return _hybrid(spark, folder, S.Hybrid(alpha=0.3, rrf_k=10))


@query(_rrf_sql(0.0, 60))
def hybrid_rrf_alpha0(spark, folder):
    return _hybrid(spark, folder, S.Hybrid(alpha=0.0))


@query(_rrf_sql(1.0, 60))
def hybrid_rrf_alpha1(spark, folder):
    return _hybrid(spark, folder, S.Hybrid(alpha=1.0))


@query(f"WITH {_ARMS} SELECT k._id, round(coalesce(s, 0), 6) AS score, round(coalesce(s, 0), 6) AS tensor_score, NULL::DOUBLE AS lexical_score FROM k LEFT JOIN n USING (_id)")
def hybrid_lexical_tensor(spark, folder):
    return _hybrid(spark, folder, S.Hybrid("lexical", "tensor"))


@query(f"WITH {_ARMS} SELECT a._id, round(coalesce(raw, 0), 6) AS score, NULL::DOUBLE AS tensor_score, round(coalesce(raw, 0), 6) AS lexical_score FROM a LEFT JOIN b USING (_id)")
def hybrid_tensor_lexical(spark, folder):
    return _hybrid(spark, folder, S.Hybrid("tensor", "lexical"))


@query(f"WITH {_ARMS} SELECT _id, round(raw, 6) AS score, NULL::DOUBLE AS tensor_score, round(raw, 6) AS lexical_score FROM k")
def hybrid_lexical_lexical(spark, folder):
    return _hybrid(spark, folder, S.Hybrid("lexical", "lexical"))


@query(f"WITH {_ARMS} SELECT _id, round(s, 6) AS score, round(s, 6) AS tensor_score, NULL::DOUBLE AS lexical_score FROM a")
def hybrid_tensor_tensor(spark, folder):
    return _hybrid(spark, folder, S.Hybrid("tensor", "tensor"))


# -- chunks


def _split_sql(table: str, key: str, units: str, length: int, step: int, glue: str) -> str:
    return f"""WITH u AS (SELECT {key}, text, {units} AS u FROM {table}), w AS (SELECT {key}, CASE WHEN trim(text) = '' THEN [' '] WHEN length(text) <= 1 THEN [text]
  ELSE list_filter(list_transform(range(0, len(u), {step}), lambda i: array_to_string(u[i + 1 : i + {length}], '{glue}')), lambda x: trim(x) <> '') END AS c FROM u)
SELECT {key}, chunk_idx::INTEGER AS chunk_idx, chunk FROM (SELECT {key}, unnest(range(0, len(c))) AS chunk_idx, unnest(c) AS chunk FROM w)"""


def _split(spark, folder, table: str, key: str, **options) -> DataFrame:
    rows = _table(spark, folder, table)
    return rows.select(key, F.posexplode(X.split_text(F.col("text"), **options)).alias("chunk_idx", "chunk"))


@query(_split_sql("benchmark", "item_id", "list_filter(string_split(text, ''), lambda x: x <> '')", 40, 30, ""))
def split_character(spark, folder):
    return _split(spark, folder, "benchmark", "item_id", by="character", length=40, overlap=10)


@query(_split_sql("documents", "doc_id", r"regexp_extract_all(text, '([\p{L}\p{N}]+(?:[''’.,-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}])', 1)", 50, 40, " "))
def split_word(spark, folder):
    return _split(spark, folder, "documents", "doc_id", by="word", length=50, overlap=10)


@query(_split_sql("conversations", "conv_id", r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')", 2, 2, " "))
def split_sentence(spark, folder):
    return _split(spark, folder, "conversations", "conv_id", by="sentence", length=2, overlap=0)


@query(_split_sql("documents", "doc_id", r"string_split(text, chr(10) || chr(10))", 1, 1, " "))
def split_passage(spark, folder):
    return _split(spark, folder, "documents", "doc_id", by="passage", length=1, overlap=0)


@query("""WITH w AS (SELECT event_id, abs(value) AS d, unnest(range(0, greatest(1, ceil((abs(value) - 3.0) / 17.0))::BIGINT)) AS k FROM events)
SELECT event_id, round(least(k * 17.0::DOUBLE, greatest(d - 20, 0)), 6) AS start, round(least(least(k * 17.0::DOUBLE, greatest(d - 20, 0)) + 20, d), 6) AS stop FROM w""")
def media_time_windows(spark, folder):
    rows = _table(spark, folder, "events").select("event_id", F.explode(X.time_windows(F.abs("value"), length=20, overlap=3)).alias("w"))
    return rows.select("event_id", F.round(F.col("w")["start"], 6).alias("start"), F.round(F.least(F.col("w")["start"] + 20, F.col("w")["end"]), 6).alias("stop"))


@query("""WITH g AS (SELECT p_partkey, p_size * 10 AS w, p_size * 6 AS h FROM part), c AS (SELECT p_partkey, w, h, unnest(range(0, 10)) AS k FROM g)
SELECT p_partkey, k::INTEGER AS box, round(CASE WHEN k = 0 THEN 0 ELSE w * ((k - 1) % 3) / 3.0 END, 6)::DOUBLE AS left_edge, round(CASE WHEN k = 0 THEN h ELSE h * ((k - 1) // 3 + 1) / 3.0 END, 6)::DOUBLE AS bottom_edge FROM c""")
def image_grid(spark, folder):
    boxes = _table(spark, folder, "part").select("p_partkey", F.posexplode(X.grid_boxes(F.col("p_size") * 10, F.col("p_size") * 6, rows=3, columns=3)).alias("box", "b"))
    return boxes.select("p_partkey", "box", F.round("b.left", 6).alias("left_edge"), F.round("b.bottom", 6).alias("bottom_edge"))


@query("SELECT page_id, CASE WHEN regexp_matches(lower(url), '^([a-z][a-z0-9+.-]*://|/)\\S*\\.(jpg|jpeg|png|gif|webp|bmp|tif|tiff)([?#]\\S*)?$') THEN 'image' ELSE 'text' END AS kind FROM pages")
def modality_of_urls(spark, folder):
    return _table(spark, folder, "pages").select("page_id", X.modality(F.col("url")).alias("kind"))


# -- documents


@query("""WITH b AS (SELECT c_custkey % 100 AS k, c_name AS name, c_custkey AS pos FROM customer), l AS (SELECT k, name FROM b QUALIFY row_number() OVER (PARTITION BY k ORDER BY pos DESC) = 1)
SELECT k::VARCHAR AS _id, name FROM l UNION ALL SELECT s_suppkey::VARCHAR, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM l)""")
def upsert_last_wins(spark, folder):
    batch = _table(spark, folder, "customer").select((F.col("c_custkey") % 100).cast("string").alias("_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("pos"))
    old = _table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("_id"), F.col("s_name").alias("name"))
    return D.upsert(old, D.last_of_each(batch).drop("pos"))


def _patched(spark, folder):
    docs = _table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("_id"), "s_name", "s_acctbal")
    patches = _table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("s_acctbal"))
    return D.partial_update(docs, patches)


@query("""SELECT s_suppkey::VARCHAR AS _id, s_name, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END, s_acctbal) AS s_acctbal
FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey""")
def partial_update(spark, folder):
    return _patched(spark, folder)[0]


@query("SELECT c_custkey::VARCHAR AS _id, CASE WHEN s_suppkey IS NULL THEN 404 ELSE 200 END AS status FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def partial_update_status(spark, folder):
    return _patched(spark, folder)[1]


@query("SELECT n_nationkey AS pos, (n_nationkey * 13)::VARCHAR AS _id, s_name, s_suppkey IS NOT NULL AS _found FROM nation LEFT JOIN supplier ON s_suppkey = n_nationkey * 13")
def get_by_ids_found_flag(spark, folder):
    ids = _table(spark, folder, "nation").select(F.col("n_nationkey").alias("pos"), (F.col("n_nationkey") * 13).cast("string").alias("_id"))
    docs = _table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("_id"), "s_name")
    return D.get_documents(docs, ids).select("pos", "_id", "s_name", "_found")


@query("SELECT s_suppkey::VARCHAR AS _id FROM supplier WHERE s_suppkey NOT IN (SELECT n_nationkey * 2 FROM nation)")
def delete_by_ids(spark, folder):
    docs = _table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("_id"))
    ids = _table(spark, folder, "nation").select((F.col("n_nationkey") * 2).cast("string").alias("_id"))
    return D.delete_documents(docs, ids)[0]


@query("SELECT count(*) FILTER (c_acctbal >= 0 AND c_name <> '') AS success, count(*) FILTER (NOT (c_acctbal >= 0 AND c_name <> '')) AS failure, 0::BIGINT AS error FROM customer")
def add_response_counts(spark, folder):
    docs = _table(spark, folder, "customer").withColumn("_id", F.col("c_custkey").cast("string"))
    return D.responses(D.validated(docs, {"negative": F.col("c_acctbal") >= 0, "no name": F.length("c_name") > 0}))


@query("""SELECT vec_id::VARCHAR AS _id, 'v' AS field, 0 AS chunk_idx, CASE WHEN vec_id % 4 = 0 THEN 'new' ELSE 'label ' || label END AS chunk, vec_id % 4 <> 0 AS kept FROM embeddings""")
def reuse_unchanged_embeddings(spark, folder):
    old = _chunks(spark, folder)
    new = old.withColumn("chunk", F.when(F.col("_id").cast("long") % 4 == 0, "new").otherwise(F.col("chunk")))
    return D.reuse_embeddings(new, old).select("_id", "field", "chunk_idx", "chunk", F.col("embedding").isNotNull().alias("kept"))


@query("SELECT (SELECT count(*) FROM documents) AS number_of_documents, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS number_of_vectors")
def index_stats(spark, folder):
    return D.index_stats(_documents(spark, folder), _chunks(spark, folder))


@query("SELECT label::VARCHAR AS _id, count(*) AS vectors FROM embeddings GROUP BY label")
def vector_count(spark, folder):
    return _embeddings(spark, folder).groupBy(F.col("label").cast("string").alias("_id")).agg(F.count("embedding").alias("vectors"))


@query(f"""WITH {_E}, {_Q}, s AS (SELECT (vec_id // 5)::VARCHAR AS _id, vec_id, {_CLOSE['prenormalized-angular']} AS s FROM e, q)
SELECT _id, round(max(s), 6) AS score, arg_max(vec_id, s)::VARCHAR AS highlight FROM s GROUP BY _id""")
def highlights(spark, folder):
    chunks = _embeddings(spark, folder).select(F.expr("string(vec_id div 5)").alias("_id"), F.lit("v").alias("field"), (F.col("vec_id") % 5).cast("int").alias("chunk_idx"), F.col("vec_id").cast("string").alias("chunk"), "embedding")
    best = S.nearest_documents(S.tensor_scores(chunks, _vector(spark, folder, 0)))
    return best.select("_id", F.round("_score", 6).alias("score"), F.get("_highlights", F.lit(0))["v"].alias("highlight"))


@query("SELECT (vec_id // 5)::VARCHAR AS _id, count(*)::INTEGER AS facets, array_to_string(list(vec_id ORDER BY vec_id), ',') AS chunks FROM embeddings GROUP BY ALL")
def tensor_facets(spark, folder):
    chunks = _embeddings(spark, folder).select(F.expr("string(vec_id div 5)").alias("_id"), F.lit("v").alias("field"), (F.col("vec_id") % 5).cast("int").alias("chunk_idx"), F.col("vec_id").cast("string").alias("chunk"), "embedding")
    return S.tensor_facets(chunks).select("_id", F.size("_tensor_facets").alias("facets"), F.array_join(F.transform("_tensor_facets", lambda x: x["chunk"]), ",").alias("chunks"))


_CHUNKED = _split_sql("documents", "doc_id", r"list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '')", 2, 2, " ")


@query(f"""WITH h AS ({_bm25_sql("documents", "doc_id", ["text"], ["that", "with"], tail="ORDER BY raw DESC, _id LIMIT 30").replace("round(raw, 6) AS score", "raw")}), c AS ({_CHUNKED}),
s AS (SELECT doc_id, len(list_intersect({_tokens_sql('chunk')}, ['that', 'with', 'from'])) / 3.0::DOUBLE AS s FROM c WHERE trim(chunk) <> '')
SELECT h._id, round(max(s), 6) AS score, round(max(s) * any_value(raw), 6) AS multiplied, round(max(s) + any_value(raw), 6) AS added FROM h JOIN s ON h._id = s.doc_id::VARCHAR GROUP BY h._id""")
def rerank_chunks(spark, folder):
    hits = S.lexical_search(_documents(spark, folder), "that with", ["text"], limit=30)
    best = rerank(hits, ["text"], query="that with from")
    return best.select("_id", F.round("_score", 6).alias("score"), F.round("_multiplied", 6).alias("multiplied"), F.round("_added", 6).alias("added"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def arrivals_by_window(spark, folder):
    return arrivals(_table(spark, folder, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query()
def embed_texts(spark, folder):
    """Chunks of conversations with vectors of the hash embedder."""
    docs = _table(spark, folder, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("_id"), "text")
    return E.embedded(E.chunked(docs, ["text"]), E.HashEmbedder(16)).select("_id", "chunk_idx", F.round(F.aggregate(V.doubles("embedding"), F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


# -- an inverted index that searches read


def _from_index(rows: DataFrame, fields: list[str], text: str, **options) -> DataFrame:
    return _rounded(I.index_search(I.index_terms(rows, fields), I.index_lengths(rows, fields), text, fields, **options))


@query(_bm25_sql("documents", "doc_id", ["text"], ["idiot", "nicht", "that"]))
def index_search_terms(spark, folder):
    return _from_index(_documents(spark, folder), ["text"], "idiot nicht that")


@query(_bm25_sql("documents", "doc_id", ["text"], ["of", "the"], matched="contains(' ' || array_to_string(t0, ' ') || ' ', ' of the ')"))
def index_search_phrase(spark, folder):
    return _from_index(_documents(spark, folder), ["text"], '"of the"')


@query(_bm25_sql("part", "p_partkey", ["p_name", "p_type"], ["red", "steel", "brass"], "max"))
def index_search_max_fields(spark, folder):
    return _from_index(_parts(spark, folder), ["p_name", "p_type"], "red steel brass", aggregator="max")


@query(_bm25_sql("(SELECT *, p_name || ' ' || p_type AS all_text FROM part)", "p_partkey", ["all_text"], ["red", "steel"]))
def lexical_one_field_of_all_text(spark, folder):
    """Keyword search where all text of a document is one field."""
    return _rounded(L.bm25(_parts(spark, folder).withColumn("all_text", F.concat_ws(" ", "p_name", "p_type")), L.KeywordQuery.of("red steel"), ["all_text"]))


@query(f"""WITH {_bm25_sql("part", "p_partkey", ["p_name"], ["red", "steel"], only_scores=True)}, m AS (SELECT _id, raw * 0.5 * p_size - 2.0 * p_size AS s FROM b JOIN part ON _id = p_partkey::VARCHAR)
SELECT _id, round(s, 6)::DOUBLE AS score FROM m ORDER BY s DESC, _id LIMIT 20""")
def lexical_search_modified(spark, folder):
    """Modified scores may be below zero and stay so."""
    return _rounded(S.lexical_search(_parts(spark, folder), "red steel", ["p_name"], modifiers=ScoreModifiers({"p_size": 0.5}, {"p_size": -2.0}), limit=20))


@query(f"""WITH {_B}, m AS (SELECT _id, raw * 0.01 * n_chars AS s FROM b JOIN documents ON _id = doc_id::VARCHAR)
SELECT _id, round(s, 5) AS score, NULL::DOUBLE AS tensor_score, round(s, 5) AS lexical_score FROM m ORDER BY s DESC, _id LIMIT 10""")
def hybrid_keyword_modifiers(spark, folder):
    hits = _hybrid(spark, folder, S.Hybrid("lexical", "lexical", keyword_modifiers=ScoreModifiers({"n_chars": 0.01})))
    return hits.select("_id", F.round("score", 5).alias("score"), "tensor_score", F.round("lexical_score", 5).alias("lexical_score"))


@query("SELECT p_partkey::VARCHAR AS _id, round(3.0 * p_size * 2.0 - 4.0 * p_retailprice, 6)::DOUBLE AS score FROM part")
def score_modifiers_repeated(spark, folder):
    """Of a field that is named twice the last weight counts; unknown fields are nothing unless asked for."""
    m = ScoreModifiers.of({"multiply_score_by": [{"field_name": "p_size", "weight": 9}, {"field_name": "p_size", "weight": 3}, {"field_name": "absent"}], "add_to_score": [{"field_name": "p_retailprice", "weight": -4}]})
    docs = _parts(spark, folder)
    return docs.select("_id", V.rounded(S.modified(docs, F.lit(2.0), m, strict=False), 6).alias("score"))


# -- rules: what a request may be


def _told(spark, cases: dict[str, Callable[[], object]]) -> DataFrame:
    """(request, accepted) by whether a request raises a ValueError."""

    def accepted(run) -> bool:
        try:
            run()
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(name, accepted(run)) for name, run in cases.items()], "request string, accepted boolean")


def _told_sql(good: list[str], bad: list[str]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{x}', {str(ok).lower()})" for rows, ok in ((good, True), (bad, False)) for x in rows) + ") AS t(request, accepted)"


_PAGES = {"1 0": (1, 0), "1000 9000": (1000, 9000), "0 0": (0, 0), "1001 0": (1001, 0), "1 -1": (1, -1), "1000 9001": (1000, 9001), "1.5 0": (1.5, 0), "true 0": (True, 0)}


@query(_told_sql(["1 0", "1000 9000"], ["0 0", "1001 0", "1 -1", "1000 9001", "1.5 0", "true 0"]))
def page_rules(spark, folder):
    return _told(spark, {name: lambda x=x: S.check_page(*x) for name, x in _PAGES.items()})


_ARMS_OF = [(a, b) for a in ("disjunction", "tensor", "lexical") for b in ("rrf", "tensor", "lexical")]


@query(_told_sql(["disjunction rrf", "tensor tensor", "tensor lexical", "lexical tensor", "lexical lexical"], ["disjunction tensor", "disjunction lexical", "tensor rrf", "lexical rrf", "alpha 2", "rrf_k -1", "keyword attributes of tensor"]))
def hybrid_rules(spark, folder):
    more = {"alpha 2": {"alpha": 2}, "rrf_k -1": {"rrf_k": -1}, "keyword attributes of tensor": {"retrieval": "tensor", "ranking": "tensor", "keyword_attributes": ["text"]}}
    return _told(spark, {f"{a} {b}": lambda a=a, b=b: S.Hybrid(a, b) for a, b in _ARMS_OF} | {name: lambda x=x: S.Hybrid(**x) for name, x in more.items()})


_FILTERS = ["c_custkey:1", "c_custkey:[1 TO *]", "NOT c_name:x", "_id:1", "c_custkey:x", "c_custkey:[* TO *]", "c_acctbal IN (1)", "c_phone:1", "c_custkey:1 AND", "(c_custkey:1", "c_mktsegment:A"]


@query(_told_sql(_FILTERS[:4], _FILTERS[4:]))
def filter_rules(spark, folder):
    docs = _table(spark, folder, "customer").withColumn("_id", F.col("c_custkey").cast("string"))
    return _told(spark, {x: lambda x=x: structured_filter(docs, x, filterable={"c_custkey", "c_name", "c_acctbal"}) for x in _FILTERS})


@query(_told_sql(["text", "weighted texts", "context", "texts and context"], ["nothing", "text and context", "short vector", "65 vectors", "no model"]))
def query_rules(spark, folder):
    made, v = E.HashEmbedder(4), [1.0, 0.0, 0.0, 0.0]
    return _told(spark, {
        "text": lambda: E.embed_query("a", made), "weighted texts": lambda: E.embed_query({"a": 1.0, "b": -2.0}, made), "context": lambda: E.embed_query(None, E.NoModel(4), context=[(v, 1.0)]), "texts and context": lambda: E.embed_query({"a": 1.0}, made, context=[(v, 1.0)]),
        "nothing": lambda: E.embed_query(None, made), "text and context": lambda: E.embed_query("a", made, context=[(v, 1.0)]), "short vector": lambda: E.embed_query(None, made, context=[([1.0], 1.0)]), "65 vectors": lambda: E.embed_query(None, made, context=[(v, 1.0)] * 65), "no model": lambda: E.embed_query("a", E.NoModel(4)),
    })


@query(_told_sql(["one", "a zero weight"], ["none", "all zero", "absent"]))
def recommend_rules(spark, folder):
    chunks = _chunks(spark, folder)
    return _told(spark, {"one": lambda: recommend(chunks, ["1"]), "a zero weight": lambda: recommend(chunks, {"1": 1.0, "2": 0.0}), "none": lambda: recommend(chunks, []), "all zero": lambda: recommend(chunks, {"1": 0.0}), "absent": lambda: recommend(chunks, ["no"])})


_GROWN = [("known", "text", "filter"), ("t", "text", "lexical_search,filter"), ("n", "long", "filter,score_modifier"), ("b", "bool", "filter"), ("l", "array<text>", "filter"), ("m", "map<text, double>", "score_modifier")]


@query("SELECT * FROM (VALUES " + ", ".join(str(x) for x in _GROWN) + ") AS t(field, kind, features)")
def grown_schema(spark, folder):
    docs = spark.createDataFrame([], "_id string, known string, t string, n bigint, b boolean, l array<string>, m map<string,double>")
    spec = IndexSpec("grown", (Field("known", "text", ("filter",)),)).grown(docs)
    return spark.createDataFrame([(x.name, x.kind, ",".join(x.features)) for x in spec.fields], "field string, kind string, features string")


# -- more of documents, chunks and vectors


@query("SELECT c_custkey::VARCHAR AS _id, c_name, 1.5::DOUBLE AS _score FROM customer")
def projected_fields(spark, folder):
    hits = _table(spark, folder, "customer").withColumns({"_id": F.col("c_custkey").cast("string"), "_score": F.lit(1.5)})
    return S.projected(hits, ["c_name", "absent"], strict=False)


@query("SELECT c_custkey::VARCHAR AS _id, c_name, c_nationkey::VARCHAR AS nation, c_acctbal > 0 AS positive FROM customer")
def document_round_trip(spark, folder):
    """Fields to maps by kind, and back."""
    docs = _table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("_id"), "c_name", "c_nationkey", (F.col("c_acctbal") > 0).alias("positive"))
    back = lambda path: F.get_json_object("document", path)
    return D.unflattened(D.flattened(docs)).select("_id", back("$.short_strings.c_name").alias("c_name"), back("$.ints.c_nationkey").alias("nation"), back("$.bools.positive").cast("boolean").alias("positive"))


@query("SELECT label, arg_min(embedding, vec_id)[1]::DOUBLE AS first, arg_min(embedding, vec_id)[64]::DOUBLE AS last FROM embeddings GROUP BY label")
def cls_pooling(spark, folder):
    first = E.pooled(_embeddings(spark, folder), ["label"], how="cls", place="vec_id")
    return first.select("label", F.get("embedding", F.lit(0)).cast("double").alias("first"), F.get("embedding", F.lit(63)).cast("double").alias("last"))


@query(f"SELECT item_id, chunk_idx, 'passage: ' || chunk AS embedded, chunk AS stored FROM ({_split_sql('benchmark', 'item_id', 'list_filter(string_split(text, chr(0)), lambda x: x <> chr(0))', 1, 1, ' ')})")
def chunk_prefix(spark, folder):
    rows = _split(spark, folder, "benchmark", "item_id", by="passage", length=1, overlap=0)
    return rows.select("item_id", "chunk_idx", X.prefixed(F.col("chunk"), X.resolve_prefix(None, "passage: ", "model: ")).alias("embedded"), F.col("chunk").alias("stored"))


@query("""SELECT p_partkey, k::INTEGER AS box, round(p_size * 5.0 * (k % 1 + 0.5), 6)::DOUBLE AS left_edge, round(p_size * 3.0 * 1.5, 6)::DOUBLE AS bottom_edge FROM part, (VALUES (5)) AS v(k)""")
def image_grid_overlapping(spark, folder):
    """The box between the four of a grid."""
    boxes = _table(spark, folder, "part").select("p_partkey", F.posexplode(X.overlapping_boxes(F.col("p_size") * 10, F.col("p_size") * 6, rows=2, columns=2)).alias("box", "b"))
    return boxes.where("box = 5").select("p_partkey", "box", F.round("b.left", 6).alias("left_edge"), F.round("b.bottom", 6).alias("bottom_edge"))


@query("""WITH b AS (SELECT p_brand, p_partkey, p_size AS w, 51 - p_size AS h, p_retailprice AS s FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY s DESC, p_partkey) AS r FROM b WHERE w * h >= 300 AND greatest(w::DOUBLE / h, h::DOUBLE / w) <= 3.0)
SELECT p_brand, r::INTEGER - 1 AS place, s AS score FROM k WHERE r <= 5""")
def boxes_kept(spark, folder):
    """Boxes by brand: large enough, not too long, the five best."""
    box = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), F.col("p_size").cast("double").alias("right"), (51 - F.col("p_size")).cast("double").alias("bottom"), F.col("p_retailprice").alias("score"))
    rows = _table(spark, folder, "part").select("p_brand", "p_partkey", box.alias("box"))
    return best_boxes(rows, ["p_brand"], ties=["p_partkey"], least_area=300, most_ratio=3.0, top=5).select("p_brand", "place", F.col("box.score").alias("score"))


def _slerp_sql(second: float) -> str:
    """Three vectors: two meet in the middle, and what they give meets the third at `second`."""
    arc = lambda a, b, g, t, name: f"list_transform(list_zip({a}, {b}), lambda p: (sin({1 - t} * {g}) * p[1] + sin({t} * {g}) * p[2]) / sin({g})) AS {name}"
    angle = lambda a, b: f"acos(list_dot_product({a}, {b}) / ({_NORM.format(a)} * {_NORM.format(b)}))"
    return f"""WITH {_E}, abc AS (SELECT x.v AS a, y.v AS b, z.v AS c FROM e x, e y, e z WHERE x.vec_id = 3 AND y.vec_id = 4 AND z.vec_id = 5), g AS (SELECT *, {angle('a', 'b')} AS g FROM abc), ab AS (SELECT c, {arc('a', 'b', 'g', 0.5, 'm')} FROM g),
h AS (SELECT *, {angle('m', 'c')} AS h FROM ab), z AS (SELECT {arc('m', 'c', 'h', second, 'z')} FROM h), q AS (SELECT list_transform(z, lambda y: y / {_NORM.format('z')}) AS u FROM z)
SELECT _id, round({_CLOSE['prenormalized-angular']}, 6) AS score FROM e, q WHERE vec_id NOT IN (3, 4, 5) ORDER BY {_CLOSE['prenormalized-angular']} DESC, _id LIMIT 10"""


@query(_slerp_sql(0.5))
def recommend_slerp_three(spark, folder):
    return _rounded(recommend(_chunks(spark, folder), ["3", "4", "5"]))


@query(_slerp_sql(1 / 3))
def recommend_slerp_sequential(spark, folder):
    return _rounded(recommend(_chunks(spark, folder), ["3", "4", "5"], method="slerp-sequential"))


@query("SELECT c_custkey::VARCHAR AS _id, c_custkey % 3 <> 0 AS named, CASE WHEN c_custkey % 3 <> 0 THEN 0 ELSE 64 END AS id_length FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'made', false, 64 FROM customer WHERE c_custkey % 3 = 0")
def ids_of_rows_without_one(spark, folder):
    """Every row keeps its id or gets one of its own that depends on the row and the batch."""
    batch = _table(spark, folder, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string")).alias("_id"), "c_mktsegment")
    made = D.with_ids(batch, "batch-1").groupBy("_id").count().where("count = 1")
    long = F.length("_id") == 64
    return made.select(F.when(long, "made").otherwise(F.col("_id")).alias("_id"), (~long).alias("named"), F.when(long, 64).otherwise(0).alias("id_length"))
