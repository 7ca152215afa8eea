import pytest
from pyspark.sql import functions as F

from tessera.operators import documents as D
from tessera.operators import embedding as E
from tessera.operators.search import Hybrid
from tessera.plans.spec import Field, IndexSpec
from tessera.sources.indexes import Indexes
from tessera.streaming.upserts import stream_into


@pytest.fixture
def indexes(spark, tmp_path):
    return Indexes(spark, str(tmp_path / "indexes"))


SPEC = IndexSpec("my-index", (Field("title", "text", ("lexical_search", "filter")), Field("year", "int", ("filter", "score_modifier"))), ("title",), mode="structured", dimensions=16)


def batch(spark, *rows):
    return spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "pos int, _id string, title string, year int")


def test_life_of_an_index(spark, indexes):
    indexes.create_index(SPEC)
    with pytest.raises(ValueError):
        indexes.create_index(SPEC)
    told = {x["pos"]: (x["_id"], x["status"]) for x in indexes.add_documents("my-index", batch(spark, ("a", "old", 1), ("b", "dogs bark. cats sleep. birds sing.", 2), ("a", "new dogs", 3), ("", "bad", 4))).collect()}
    assert told == {1: ("b", 200), 2: ("a", 200), 3: ("", 400)}
    assert {x["_id"]: x["title"] for x in indexes.documents("my-index").collect()} == {"a": "new dogs", "b": "dogs bark. cats sleep. birds sing."}
    assert tuple(indexes.stats("my-index").first()) == (2, 3)
    found = [(x["_id"], x["_found"]) for x in indexes.get_documents("my-index", ["b", "z", "a"]).collect()]
    assert found == [("b", True), ("z", False), ("a", True)]
    assert {x["_id"]: x["status"] for x in indexes.update_documents("my-index", spark.createDataFrame([("a", 9), ("q", 1)], "_id string, year int")).collect()} == {"a": 200, "q": 404}
    assert indexes.get_document("my-index", "a").first()["year"] == 9
    with pytest.raises(ValueError):
        indexes.update_documents("my-index", spark.createDataFrame([("a", "x")], "_id string, title string"))
    assert [x["_id"] for x in indexes.search("my-index", "dogs", method="LEXICAL", filter="year:[5 TO *]").collect()] == ["a"]
    top = indexes.search("my-index", "new dogs", limit=1).first()
    assert top["_id"] == "a" and abs(top["_score"] - 1) < 1e-6 and top["_highlights"] == [{"title": "new dogs"}]
    assert indexes.search("my-index", "dogs", method="HYBRID", hybrid=Hybrid()).count() == 2
    assert [x["_id"] for x in indexes.recommend("my-index", ["a"]).collect()] == ["b"]
    assert {x["status"] for x in indexes.delete_documents("my-index", ["a", "zz"]).collect()} == {200}
    assert tuple(indexes.stats("my-index").first()) == (1, 2)
    assert indexes.delete_all_documents("my-index") == 1 and tuple(indexes.stats("my-index").first()) == (0, 0)
    assert indexes.list_indexes().count() == 1
    indexes.delete_index("my-index")
    assert indexes.list_indexes().count() == 0
    with pytest.raises(KeyError):
        indexes.settings("my-index")


def test_hybrid_query_forms_and_arms(spark, indexes):
    from tessera.functions.scoring import ScoreModifiers
    from tessera.operators.search import CustomVector

    fields = (*SPEC.fields, Field("note", "text", ("lexical_search",)))
    indexes.create_index(IndexSpec("my-index", fields, ("title", "note"), mode="structured", dimensions=16))
    rows = [(0, "a", "red dogs", 1, "quiet None"), (1, "b", "blue cats", 50, "red red"), (2, "c", "red fish", 9, "none")]
    indexes.add_documents("my-index", spark.createDataFrame(rows, "pos int, _id string, title string, year int, note string"))

    def ids(q, hybrid, **options):
        return [x["_id"] for x in indexes.search("my-index", q, method="HYBRID", hybrid=hybrid, **options).collect()]

    tensor, keyword, turned = Hybrid("tensor", "tensor"), Hybrid("lexical", "lexical"), Hybrid("lexical", "tensor")
    vector = indexes.embed("my-index", ["red dogs"]).first()["embedding"]
    for hybrid in (Hybrid(), keyword, turned, Hybrid("tensor", "lexical")):
        for q in (None, {"red": 1.0}, CustomVector(vector)):
            with pytest.raises(ValueError):
                ids(q, hybrid, context=[(vector, 1.0)])
    with pytest.raises(ValueError):
        ids(None, tensor)
    assert ids(None, tensor, context=[(vector, 1.0)])[0] == ids({"red dogs": 1.0}, tensor)[0] == ids(CustomVector(vector), tensor)[0] == "a"
    assert ids(CustomVector(vector, "cats"), keyword) == ["b"] and ids(CustomVector(vector, "red"), turned)[0] == "a"
    assert set(ids("red", Hybrid("lexical", "lexical", keyword_attributes=["title"]))) == {"a", "c"}
    assert ids("red", Hybrid("lexical", "lexical", keyword_attributes=["note"])) == ["b"]
    assert ids("red", Hybrid("lexical", "lexical", keyword_modifiers=ScoreModifiers({"year": 100.0})))[0] == "b"
    assert ids("red", Hybrid("lexical", "tensor", keyword_modifiers=ScoreModifiers({"year": 100.0})), limit=1) == ["b"]
    assert ids("quiet None", Hybrid("tensor", "tensor", tensor_attributes=["note"]))[0] == "a"
    assert ids("red dogs", Hybrid("tensor", "tensor", tensor_modifiers=ScoreModifiers(add={"year": 1.0})))[0] == "b"
    with pytest.raises(ValueError):
        ids("red", Hybrid(keyword_attributes=["year"]))
    for method, options in (("tensor", {"keyword_attributes": ["title"]}), ("lexical", {"tensor_attributes": ["title"]}), ("tensor", {"keyword_modifiers": ScoreModifiers({"year": 1.0})}), ("lexical", {"tensor_modifiers": ScoreModifiers({"year": 1.0})})):
        with pytest.raises(ValueError):
            Hybrid(method, method, **options)


def test_keyword_search_reads_the_index(spark, indexes, capsys):
    """The inverted index gives what a scan of the documents gives, and the scan is not in its plan before the page."""
    from tessera.functions.scoring import ScoreModifiers
    from tessera.operators.search import lexical_search

    fields = (*SPEC.fields, Field("note", "text", ("lexical_search",)))
    indexes.create_index(IndexSpec("my-index", fields, (), mode="structured", dimensions=16))
    rows = [(k, f"d{k}", " ".join(f"w{(k * j) % 7}" for j in range(k % 5 + 1)), k, None if k % 3 else f"w{k % 4} w1 w2") for k in range(40)]
    indexes.add_documents("my-index", spark.createDataFrame(rows, "pos int, _id string, title string, year int, note string"))
    docs = indexes.documents("my-index")
    for q in ("w1 w3", '"w1 w2"', '"w1" w0', "w1 w1", "absent", '""', "*"):
        for options in ({}, {"modifiers": ScoreModifiers({"year": 2.0}, {"year": 0.1})}, {"where": docs["year"] > 20}):
            wanted = lexical_search(docs, q, ["title", "note"], limit=100, **options)
            named = {"score_modifiers": options.get("modifiers"), "filter": "year:[21 TO *]" if "where" in options else None}
            found = indexes.search("my-index", q, method="LEXICAL", limit=100, **named)
            assert {x["_id"]: round(x["_score"], 9) for x in found.collect()} == {x["_id"]: round(x["_score"], 9) for x in wanted.collect()}
    assert [x["_id"] for x in indexes.search("my-index", "w1", method="LEXICAL", limit=3, searchable_attributes=["title"]).collect()] == [x["_id"] for x in lexical_search(docs, "w1", ["title"], limit=3).collect()]
    with pytest.raises(ValueError):
        indexes.search("my-index", "w1", method="LEXICAL", approximate=False)
    indexes.search("my-index", "w1", method="LEXICAL").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_grown_fields_of_all_kinds(spark, indexes):
    indexes.create_index(IndexSpec("kinds", dimensions=8))
    indexes.add_documents("kinds", spark.createDataFrame([(0, "a", 5, True, ["x"], {"k": 1.5})], "pos int, _id string, n bigint, b boolean, l array<string>, m map<string,double>"))
    indexes.add_documents("kinds", spark.createDataFrame([(0, None, "t"), (1, None, "t")], "pos int, _id string, t string"), token="one")
    indexes.add_documents("kinds", spark.createDataFrame([(0, None, "t"), (1, None, "t")], "pos int, _id string, t string"), token="one")
    assert indexes.documents("kinds").count() == 3 and indexes.documents("kinds").where("n = 5 and b and l[0] = 'x' and m['k'] = 1.5").count() == 1
    assert [x["_id"] for x in indexes.search("kinds", "*", method="LEXICAL", filter="n:[5 TO *] AND b:true").collect()] == ["a"]


def test_bad_vectors_and_mappings(spark, indexes):
    fields = (Field("t", "text"), Field("u", "text"), Field("both", "multimodal_combination", dependent_fields={"t": 0.5, "u": 0.5}), Field("v", "custom_vector"))
    indexes.create_index(IndexSpec("mixed", fields, ("both", "v"), mode="structured", dimensions=2))
    kinds = "pos int, _id string, t string, u string, v struct<content:string,vector:array<float>>"
    rows = spark.createDataFrame([(0, "a", "x", "y", ("c", [0.0, 0.0])), (1, "b", "x", "y", ("c", [3.0, 4.0])), (2, "c", "x", "y", ("c", [1.0, None]))], kinds)
    assert {x["_id"]: x["status"] for x in indexes.add_documents("mixed", rows).collect()} == {"a": 400, "b": 200, "c": 400}
    of = lambda: indexes.chunks("mixed").where("field = 'both'").first()["embedding"]
    even = of()
    indexes.add_documents("mixed", rows, mappings={"both": {"t": 1.0, "u": 0.0}})
    assert of() != even and max(abs(a - b) for a, b in zip(of(), indexes.embed("mixed", ["x"]).first()["embedding"], strict=True)) < 1e-6
    with pytest.raises(ValueError):
        indexes.add_documents("mixed", rows, mappings={"both": {"v": 1.0}})


def test_growing_schema(spark, indexes):
    indexes.create_index(IndexSpec("grows", tensor_fields=("text",), dimensions=8))
    indexes.add_documents("grows", spark.createDataFrame([(0, "a", "one")], "pos int, _id string, text string"))
    indexes.add_documents("grows", spark.createDataFrame([(0, "b", "two", "x")], "pos int, _id string, text string, more string"))
    assert {x["_id"]: x["more"] for x in indexes.documents("grows").collect()} == {"a": None, "b": "x"}
    assert indexes.settings("grows").with_feature("lexical_search") == ["text", "more"]


def test_existing_vectors_are_used(spark, indexes):
    class Counted(E.HashEmbedder):
        def __call__(self, texts):
            if "kept" in texts:
                raise ValueError("embedded again")
            return super().__call__(texts)

    spec = IndexSpec("reuse", (Field("text", "text"),), ("text",), mode="structured", dimensions=8)
    indexes.create_index(spec)
    rows = lambda *x: spark.createDataFrame([(k, *y) for k, y in enumerate(x)], "pos int, _id string, text string")
    indexes.add_documents("reuse", rows(("a", "kept"), ("b", "old")))
    indexes.embedders["hash"] = Counted(8)
    indexes.add_documents("reuse", rows(("a", "kept"), ("b", "new")), reuse=True)
    assert indexes.chunks("reuse").where("embedding is not null").count() == 2


def test_custom_and_combined_vectors(spark, indexes):
    fields = (Field("t", "text"), Field("u", "text"), Field("both", "multimodal_combination", dependent_fields={"t": 0.7, "u": 0.3}), Field("v", "custom_vector"))
    indexes.create_index(IndexSpec("mixed", fields, ("both", "v"), mode="structured", dimensions=4))
    rows = spark.createDataFrame([(0, "a", "x", "y", ("c", [3.0, 0.0, 4.0, 0.0])), (1, "b", "x", None, None), (2, "c", None, None, ("bad", [1.0]))], "pos int, _id string, t string, u string, v struct<content:string,vector:array<float>>")
    assert {x["_id"]: x["status"] for x in indexes.add_documents("mixed", rows).collect()} == {"a": 200, "b": 200, "c": 400}
    found = {(x["_id"], x["field"]): x["embedding"] for x in indexes.chunks("mixed").collect()}
    assert set(found) == {("a", "both"), ("b", "both"), ("a", "v")} and [round(x, 6) for x in found["a", "v"]] == [0.6, 0.0, 0.8, 0.0]
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in found.values())


def test_spec_rules():
    assert IndexSpec.from_json(SPEC.to_json()) == SPEC
    for bad in (
        lambda: Field("_id", "text"), lambda: Field("a", "money"), lambda: Field("a", "text", ("score_modifier",)), lambda: Field("a", "int", ("lexical_search",)), lambda: Field("a", "multimodal_combination"),
        lambda: Field("a", "text", ("sort",)), lambda: Field("1a", "text"), lambda: IndexSpec("bad name"), lambda: IndexSpec("x", (Field("v", "custom_vector"),)), lambda: IndexSpec("x", (Field("a", "text"), Field("a", "int"))), lambda: IndexSpec("x", distance_metric="far"),
    ):
        with pytest.raises(ValueError):
            bad()


def test_map_fields_change_by_key(spark):
    docs = spark.createDataFrame([("a", {"x": 1, "y": 2}), ("b", None)], "_id string, m map<string,int>")
    patches = spark.createDataFrame([("a", {"y": 5, "z": 6}), ("b", {"q": 1})], "_id string, m map<string,int>")
    assert {x["_id"]: x["m"] for x in D.partial_update(docs, patches)[0].collect()} == {"a": {"x": 1, "y": 5, "z": 6}, "b": {"q": 1}}


def test_patches_that_share_a_key(spark):
    docs = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "_id string, n int, t string")
    patches = spark.createDataFrame([(2, "a", 7, None), (0, "a", 5, "first"), (1, "q", 1, "z"), (3, "q", 1, "z")], "pos int, _id string, n int, t string")
    updated, status = D.partial_update(docs, patches)
    assert sorted(map(tuple, updated.collect())) == [("a", 7, "first"), ("b", 2, "y")]
    assert sorted(map(tuple, status.collect())) == [("a", 200), ("q", 404)]
    assert sorted(map(tuple, D.partial_update(docs, patches.select("_id"))[0].collect())) == [("a", 1, "x"), ("b", 2, "y")]


def test_stream_of_batches(spark, indexes, tmp_path):
    indexes.create_index(SPEC)
    source = str(tmp_path / "in")
    batch(spark, ("a", "one", 1), ("a", "two", 2), ("b", "three", 3)).coalesce(1).write.parquet(source)
    stream_into(indexes, "my-index", spark.readStream.schema("pos int, _id string, title string, year int").parquet(source), str(tmp_path / "state")).awaitTermination()
    assert {x["_id"]: x["title"] for x in indexes.documents("my-index").collect()} == {"a": "two", "b": "three"}


def test_windowed_arrivals_as_a_stream(spark, tables):
    from tessera.streaming.upserts import arrivals

    events = spark.read.parquet(f"{tables}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{tables}/event[s].parquet")
    query = arrivals(stream).writeStream.format("memory").queryName("seen").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("seen").agg(F.sum("n")).first()[0] == events.count() == arrivals(events).agg(F.sum("n")).first()[0]


def test_embedders(spark):
    made = E.HashEmbedder(8)
    assert (made(["a", "b"])[0] == made(["a"])[0]).all() and made([]).shape == (0, 8)
    with pytest.raises(ValueError):
        E.NoModel(8)(["a"])
    with pytest.raises(ValueError):
        E.query_vector([([1.0], 1.0)], dimensions=2)
    with pytest.raises(ValueError):
        E.embed_query("text", made, context=[([0.0] * 8, 1.0)])
    v = E.embed_query({"a": 2.0, "b": -1.0}, made)
    assert abs(sum(x * x for x in v) - 1) < 1e-9


def test_changes_write_their_own_rows_only(spark, indexes):
    """Any row of changes gives what whole rewrites give, to reads, counts and both kinds of search; a change doesn't write the rest."""
    import random

    from tessera.operators.search import lexical_search

    indexes.create_index(SPEC)
    random.seed(5)
    title = lambda: " ".join(random.choice(["red", "blue", "dogs", "cats", "fish"]) for _ in range(random.randint(1, 5)))
    held = {f"d{k}": (title(), k) for k in range(80)}
    indexes.add_documents("my-index", batch(spark, *((k, *v) for k, v in held.items())))
    whole = indexes._state("my-index").version
    for step in range(5):
        keys = random.sample(sorted(held), 2)
        if step == 1:
            indexes.delete_documents("my-index", [*keys, "absent"])
            held = {k: v for k, v in held.items() if k not in keys}
        elif step == 2:
            indexes.update_documents("my-index", spark.createDataFrame([(k, 900) for k in (*keys, "absent")], "_id string, year int"))
            held |= {k: (held[k][0], 900) for k in keys}
        else:
            new = {k: (title(), 100 + step) for k in (*keys, f"n{step}")}
            indexes.add_documents("my-index", batch(spark, *((k, *v) for k, v in new.items())))
            held |= new
        state = indexes._state("my-index")
        assert state.base == whole and spark.read.parquet(indexes._folder("my-index", "documents", state.version)).count() <= 3
        docs = indexes.documents("my-index")
        assert {x["_id"]: (x["title"], x["year"]) for x in docs.collect()} == held
        assert {(x["_id"], x["chunk"]) for x in indexes.chunks("my-index").collect()} == {(k, v[0]) for k, v in held.items()}
    for q in ("red dogs", '"blue cats"', "fish fish"):
        found = {x["_id"]: round(x["_score"], 9) for x in indexes.search("my-index", q, method="LEXICAL", limit=100).collect()}
        assert found and found == {x["_id"]: round(x["_score"], 9) for x in lexical_search(docs, q, ["title"], limit=100).collect()}
    assert {x["_id"] for x in indexes.search("my-index", "red", limit=100).collect()} == {*held}
    indexes.compact("my-index")
    state = indexes._state("my-index")
    assert state.base == state.version and {x["_id"]: (x["title"], x["year"]) for x in indexes.documents("my-index").collect()} == held
    for k in range(4):  # half as many changed rows as the whole version has: all is written anew
        indexes.add_documents("my-index", batch(spark, *((f"d{j}", "new", k) for j in range(20))))
    assert indexes._state("my-index").base > state.version and indexes.documents("my-index").count() == len({*held} | {f"d{j}" for j in range(20)})
