import pytest

from tessera.functions.scoring import ScoreModifiers
from tessera.operators import search as S
from tessera.operators.lexical import KeywordQuery, bm25
from tessera.operators.recommend import given_weights, interest, recommend
from tessera.operators.rerank import rerank

DOGS = [("doc1", "dogs"), ("doc2", "puppies"), ("doc3", "canines"), ("doc4", "huskies"), ("doc5", "four-legged animals"), ("doc6", "hot dogs"), ("doc7", "dogs is a word"), ("doc8", "something something dogs"), ("doc9", "dogs random words"), ("doc10", "dogs dogs dogs")]
OTHERS = [("doc11", "dogs but wrong field"), ("doc12", "puppies puppies"), ("doc13", "canines canines")]


@pytest.fixture(scope="module")
def dogs(spark):
    return spark.createDataFrame([(k, t, None) for k, t in DOGS] + [(k, None, t) for k, t in OTHERS], "_id string, one string, two string").cache()


def test_bm25_goldens(dogs):
    found = {x["_id"]: round(x["_score"], 7) for x in S.lexical_search(dogs, "dogs", ["one", "two"]).collect()}
    assert found == {"doc10": 0.9099117, "doc1": 0.8034327, "doc6": 0.6482633, "doc9": 0.5433286, "doc8": 0.5433286, "doc11": 0.5181658, "doc7": 0.4676326}


def test_bm25_aggregators(dogs):
    scores = {how: {x["_id"]: x["_score"] for x in bm25(dogs, KeywordQuery.of("dogs"), ["one", "two"], aggregator=how).collect()} for how in ("sum", "avg", "max")}
    assert all(abs(scores["avg"][k] * 2 - v) < 1e-12 and abs(scores["max"][k] - v) < 1e-12 for k, v in scores["sum"].items())
    with pytest.raises(ValueError):
        bm25(dogs, KeywordQuery.of("dogs"), ["one"], aggregator="min")


@pytest.mark.parametrize(
    ("text", "required", "optional"),
    [
        ('just a "string"', ["string"], ["just", "a"]), ('"go"od"', [], ["go", "od"]), ('""', [], []), ('"term 1" "term "2 "term 3"', ["term 1", "term 3"], ["term", "2"]), ('a "b', [], ["a", "b"]),
        (r"say \"hi\" now", [], ["say", '"hi"', "now"]), ('"x" "x"', ["x", "x"], []), ("", [], []), ("*", [], ["*"]), ('"a b" c', ["a b"], ["c"]),
    ],
)
def test_keyword_queries(text, required, optional):
    query = KeywordQuery.of(text)
    assert (list(query.required), list(query.optional)) == (required, optional)


def test_required_and_optional(dogs):
    ids = lambda q: {x["_id"] for x in bm25(dogs, KeywordQuery.of(q), ["one", "two"]).collect()}
    assert ids('"hot dogs"') == {"doc6"} and ids('"dogs" word random') == {"doc7", "doc9"} and ids('"dogs hot"') == set() and len(ids("*")) == 13 and ids("") == set()
    with pytest.raises(TypeError):
        KeywordQuery.of(3)


def test_reciprocal_ranks_golden(spark):
    rows = lambda names: spark.createDataFrame([(x, 1.0 - k / 10) for k, x in enumerate(names)], "_id string, _score double")
    tensor, keyword = rows(["t1", "t2", "t3", "t4", "b1", "b2"]), rows(["l1", "l2", "l3", "b1", "b2"])
    assert [x["_id"] for x in S.reciprocal_ranks(tensor, keyword).orderBy("_score", ascending=False).orderBy(S.F.desc("_score"), "_id").collect()] == ["b1", "b2", "l1", "t1", "l2", "t2"]
    assert [x["_id"] for x in S.reciprocal_ranks(tensor, None, alpha=1.0, limit=10).collect()] == ["t1", "t2", "t3", "t4", "b1", "b2"]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame([(str(k), f"dogs number {k}" if k % 2 else "cats", float(k)) for k in range(12)], "_id string, text string, boost double").cache()
    chunks = spark.createDataFrame([(str(k), f, j, f"{f}{j} of {k}", [1.0, (k + j) / 10]) for k in range(12) for f in ("a", "b") for j in range(2) if (f, j) != ("b", 1)], "_id string, field string, chunk_idx int, chunk string, embedding array<float>").cache()
    return docs, chunks


def test_pages_make_the_whole(index):
    docs, chunks = index
    whole = [x["_id"] for x in S.tensor_search(chunks, [1.0, 0.5], metric="angular", limit=12).orderBy(S.F.desc("_score"), "_id").collect()]
    pages = [x["_id"] for k in range(0, 12, 4) for x in S.tensor_search(chunks, [1.0, 0.5], metric="angular", limit=4, offset=k).orderBy(S.F.desc("_score"), "_id").collect()]
    assert whole == pages and len(whole) == 12


def test_nearest_chunk_is_the_highlight(index):
    best = {x["_id"]: x["_highlights"] for x in S.tensor_search(index[1], [1.0, 0.6], metric="euclidean", fields=["a"], limit=12).collect()}
    assert best["5"] == [{"a": "a1 of 5"}] and best["6"] == [{"a": "a0 of 6"}]


def test_alpha_ends_are_the_arms(index):
    docs, chunks = index
    run = lambda **o: [x["_id"] for x in S.hybrid_search(docs, chunks, "dogs", [1.0, 0.5], keyword_fields=["text"], metric="angular", hybrid=S.Hybrid(**o), limit=5).collect()]
    near = [x["_id"] for x in S.tensor_search(chunks, [1.0, 0.5], metric="angular", limit=5).orderBy(S.F.desc("_score"), "_id").collect()]
    words = [x["_id"] for x in S.lexical_search(docs, "dogs", ["text"], limit=5).collect()]
    assert run(alpha=1.0) == near and run(alpha=0.0) == words
    assert set(run(retrieval="tensor", ranking="lexical")) == set(near) and set(run(retrieval="lexical", ranking="tensor")) == set(words)


@pytest.mark.parametrize("bad", [{"retrieval": "tensor"}, {"ranking": "lexical"}, {"alpha": 2}, {"rrf_k": -1}, {"retrieval": "x", "ranking": "rrf"}])
def test_hybrid_rules(bad):
    with pytest.raises(ValueError):
        S.Hybrid(**bad)


@pytest.mark.parametrize("page", [(0, 0), (1001, 0), (1, -1), (1000, 9500), (True, 0), (1.5, 0)])
def test_page_rules(page):
    with pytest.raises(ValueError):
        S.check_page(*page)


def test_modifiers_change_what_was_retrieved(index):
    docs, chunks = index
    hits = S.tensor_search(chunks, [1.0, 0.5], docs=docs, metric="angular", fields=["a"], modifiers=ScoreModifiers({"boost": 100.0}), limit=3).collect()
    near = {x["_id"] for x in S.tensor_search(chunks, [1.0, 0.5], metric="angular", fields=["a"], limit=3).collect()}
    assert {x["_id"] for x in hits} == near and hits[0]["boost"] == max(x["boost"] for x in hits)


def test_recommend(index):
    docs, chunks = index
    assert "3" not in {x["_id"] for x in recommend(chunks, {"2": 1.0, "3": 0.0}, metric="angular", limit=12).collect()}
    assert len(recommend(chunks, ["2"], exclude=False, metric="angular", limit=12).collect()) == 12
    for bad in ([], {"1": 0.0}):
        with pytest.raises(ValueError):
            given_weights(bad)
    with pytest.raises(ValueError):
        interest(chunks, ["99"])


def test_projection(index):
    docs, _ = index
    hits = S.lexical_search(docs, "dogs", ["text"])
    assert S.projected(hits, ["boost", "nothing"], strict=False).columns == ["_id", "boost", "_score", "_highlights"]
    with pytest.raises(ValueError):
        S.projected(hits, ["nothing"], strict=True)


def test_rerank(index):
    docs, _ = index
    hits = S.lexical_search(docs, "dogs", ["text"])
    best = rerank(hits, ["text"], scorer=lambda texts: [float(x.split()[-1]) for x in texts]).collect()
    assert [x["_id"] for x in best] == ["11", "9", "7", "5", "3", "1"] and best[0]["_highlights"] == [{"text": "dogs number 11"}]
    with pytest.raises(ValueError):
        rerank(hits, ["nothing"], query="dogs")


def test_approximate_search_finds_most(spark, tables):
    from tessera.plans import queries

    exact = {x["_id"] for x in queries.QUERIES["tensor_topk_prenormalized_angular"](spark, tables).collect()}
    near = {x["_id"] for x in queries.QUERIES["tensor_topk_approximate"](spark, tables).collect()}
    assert len(near) == 10 and len(exact & near) >= 8
