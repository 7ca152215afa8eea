import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import interpolation as I
from tessera.functions import text as X
from tessera.functions import vectors as V
from tessera.functions.scoring import ScoreModifiers, modified


def test_interpolation_goldens():
    half = np.sqrt(2) / 2
    assert np.allclose(I.lerp([[1, 0, 0], [0, 1, 0]], [0.5, 0.5]), [0.5, 0.5, 0])
    assert np.allclose(I.lerp([[1, 2], [3, 4]], [1, 3]), [2.5, 3.5])
    assert np.allclose(I.nlerp([[1, 0, 0], [0, 1, 0]], [0.5, 0.5]), [half, half, 0])
    assert np.allclose(I.slerp([[1, 0, 0], [0, 1, 0]], [0.5, 0.5]), [half, half, 0])
    assert np.allclose(I.slerp([[1, 0, 0], [0, 1, 0]], [0.5, 0.5], sequential=True), [half, half, 0])
    assert np.allclose(I.slerp([[1, 1], [2, 2]], [1, 1]), [1.5, 1.5])
    assert np.allclose(I.slerp([[3, 4]], [7]), [3, 4])


@pytest.mark.parametrize(("method", "vectors", "weights"), [("lerp", [[1, 0], [0, 1]], [1, -1]), ("nlerp", [[1, 0], [-1, 0]], [1, 1]), ("slerp", [[0, 0], [0, 1]], [1, 1]), ("lerp", [], []), ("slerp", [[1, 0], [0, 1]], [1]), ("lerp", [[1], [1, 2]], [1, 1]), ("cubic", [[1]], [1])])
def test_interpolation_errors(method, vectors, weights):
    with pytest.raises(ValueError):
        I.interpolate(method, vectors, weights)


@given(st.lists(st.lists(st.floats(-10, 10), min_size=3, max_size=3), min_size=1, max_size=6), st.floats(0.1, 5))
@settings(max_examples=50, deadline=None)
def test_equal_weights_are_the_mean(vectors, weight):
    assert np.allclose(I.lerp(vectors, [weight] * len(vectors)), np.mean(vectors, axis=0))


def test_distances(spark):
    row = spark.range(1).select(
        *(F.round(V.closeness(m, V.literal(a), V.literal(b)), 6).alias(m) for m, a, b in (
            ("euclidean", [0, 3], [4, 0]), ("angular", [1, 0], [0, 2]), ("dotproduct", [1, 2], [3, 4]), ("prenormalized-angular", [1, 0], [0.6, 0.8]), ("hamming", [255, 1], [0, 1]), ("geodegrees", [0, 0], [0, 0]),
        )),
        V.normalised(V.literal([0, 0])).alias("zero"),
    ).first()
    assert row["euclidean"] == round(1 / 6, 6) and row["angular"] == round(1 / (1 + np.pi / 2), 6) and row["dotproduct"] == 11.0
    assert row["prenormalized-angular"] == round(1 / 1.4, 6) and row["hamming"] == round(1 / 9, 6) and row["geodegrees"] == 1.0 and row["zero"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        V.closeness("manhattan", V.literal([1]), V.literal([1]))


@pytest.mark.parametrize(
    ("text", "by", "length", "overlap", "chunks"),
    [
        ("short", "character", 4, 1, ["shor", "rt"]), ("short", "character", 4, 2, ["shor", "ort"]), ("short", "character", 4, 3, ["shor", "hort", "ort", "rt"][:2]), ("", "sentence", 2, 0, [" "]), ("x", "word", 2, 0, ["x"]), (None, "word", 2, 0, []),
        ("One. Two! Three? Four", "sentence", 2, 0, ["One. Two!", "Three? Four"]), ("a b\n\nc d", "passage", 1, 0, ["a b", "c d"]), ("the quick, brown fox", "word", 2, 1, ["the quick", "quick ,", ", brown", "brown fox", "fox"][:4]),
    ],
)
def test_split(spark, text, by, length, overlap, chunks):
    frame = spark.createDataFrame([(text,)], "t string")
    found = frame.select(X.split_text(F.col("t"), by=by, length=length, overlap=overlap).alias("c")).first()["c"]
    assert found[: len(chunks)] == chunks


@pytest.mark.parametrize("by", X.UNITS)
def test_texts_are_cut_once(spark, by):
    """Not once for each window, which is work that grows with the square of a text."""
    unit = {"character": "x", "word": "x ", "sentence": "x. ", "passage": "x\n\n"}[by]
    frame = spark.createDataFrame([(unit * 2000,)], "t string").select(X.split_text(F.col("t"), by=by, length=50, overlap=10).alias("c"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(" if by == "word" else "split(") == 1
    chunks = frame.first()["c"]
    assert len(chunks) == 50 and chunks[0].count("x") == 50 and chunks[-1].count("x") == 40


@pytest.mark.parametrize(("text", "chunks"), [("\n\t\n", []), ("a-" * 20000 + "b c", ["a-" * 20000 + "b c"]), ("’a’’b", ["’ a ’ ’ b"])])
def test_words_of_odd_texts(spark, text, chunks):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(X.split_text(F.col("t"), by="word", length=50, overlap=10).alias("c")).first()["c"] == chunks


def test_modifiers(spark):
    frame = spark.createDataFrame([("a", 3.0, None, {"k": 2.0}), ("b", None, 1.0, None), ("c", 0.0, -1.0, {})], "_id string, m double, a double, d map<string,double>")
    score = lambda x, **o: {r["_id"]: r["s"] for r in frame.select("_id", modified(frame, F.lit(1.0), x, **o).alias("s")).collect()}
    assert score(ScoreModifiers({"m": 10.0})) == {"a": 30.0, "b": 1.0, "c": 0.0}
    assert score(ScoreModifiers({}, {"a": 5.0})) == {"a": 1.0, "b": 6.0, "c": -4.0}
    assert score(ScoreModifiers({"m": -10.0}))["a"] == -30.0
    assert score(ScoreModifiers({"d.k": 2.0})) == {"a": 4.0, "b": 1.0, "c": 1.0}
    assert score(ScoreModifiers({"none": 2.0}), strict=False)["a"] == 1.0
    assert ScoreModifiers.of({"add_to_score": [{"field_name": "a"}, {"field_name": "a", "weight": 2}]}).add == {"a": 2.0}
    for bad in ({}, {"multiply_score_by": []}, {"add_to_score": [{"field_name": "_id"}]}, {"boost": []}):
        with pytest.raises(ValueError):
            ScoreModifiers.of(bad)
    with pytest.raises(ValueError):
        modified(frame, F.lit(1.0), ScoreModifiers({"none": 1.0}))


def test_media_windows_and_boxes(spark):
    row = spark.range(1).select(X.time_windows(F.lit(25.0), length=10, overlap=3).alias("w"), X.time_windows(F.lit(4.0), length=10, overlap=3).alias("s"), X.grid_boxes(F.lit(90), F.lit(60), rows=1, columns=3).alias("b"), X.modality(F.lit("https://x.y/z.PNG?a=1")).alias("m"), X.modality(F.lit("a.png b")).alias("t")).first()
    assert [tuple(x) for x in row["w"]] == [(0.0, 10.0), (7.0, 17.0), (14.0, 24.0), (15.0, 25.0)] and [tuple(x) for x in row["s"]] == [(0.0, 4.0)]
    assert len(row["b"]) == 4 and tuple(row["b"][0]) == (0.0, 0.0, 90.0, 60.0) and tuple(row["b"][3]) == (60.0, 0.0, 90.0, 60.0) and row["m"] == "image" and row["t"] == "text"
    assert X.resolve_prefix(None, "index: ", "model: ") == "index: " and X.resolve_prefix("", "index: ", None) == ""


def test_boxes_that_overlap_a_better_one_go(spark):
    from pyspark.sql import functions as F

    from tessera.functions.text import kept_boxes

    boxes = [(0.0, 0.0, 10.0, 10.0, 0.5), (1.0, 0.0, 11.0, 10.0, 0.9), (20.0, 0.0, 30.0, 10.0, 0.1), (0.0, 0.0, 1.0, 1.0, 1.0), (0.0, 0.0, 100.0, 2.0, 1.0)]
    frame = spark.createDataFrame([(boxes,), ([],)], "b array<struct<left:double,top:double,right:double,bottom:double,score:double>>")
    rows = frame.select(kept_boxes(F.col("b"), least_area=50, most_ratio=3, most_overlap=0.5).alias("k")).collect()
    assert [[x["score"] for x in r["k"]] for r in rows] == [[0.9, 0.1], []]


def test_boxes_of_large_groups(spark, capsys):
    """The best of a group's boxes are found without the group in one row, and as kept_boxes finds them."""
    from tessera.operators.boxes import best_boxes
    from tessera.plans import queries

    box = F.struct(F.lit(0.0).alias("left"), F.lit(0.0).alias("top"), (F.col("id") % 23).cast("double").alias("right"), (F.col("id") % 29).cast("double").alias("bottom"), F.when(F.col("id") > 9, F.col("id") % 101).cast("double").alias("score"))
    rows = spark.range(0, 3000, 1, 3).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("k"), "id", box.alias("box"))
    found = best_boxes(rows, ["k"], ties=["id"], least_area=50, most_ratio=3.0, top=4).select("k", "place", "id")
    whole = rows.where("id > 9").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("id", "box"))).alias("b"))
    b = F.transform("b", lambda x: x["box"].withField("id", x["id"]))
    wanted = whole.select("k", F.posexplode(X.kept_boxes(b, least_area=50, most_ratio=3.0, top=4)).alias("place", "x")).select("k", "place", "x.id")
    assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect())) and found.count() == 28
    queries.boxes_kept(spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan and "collect_list" not in plan


def test_boxes_are_compared_with_the_kept_ones_only(spark):
    """50,000 boxes that don't overlap: comparing each with all better ones is work that grows with the square."""
    box = lambda k: F.struct(k.cast("double").alias("left"), F.lit(0.0).alias("top"), (k + 1).cast("double").alias("right"), F.lit(1.0).alias("bottom"), (-k).cast("double").alias("score"))
    boxes = F.transform(F.sequence(F.lit(0), F.lit(49_999)), box)
    row = spark.range(1).select(boxes.alias("b")).select(X.kept_boxes(F.col("b"), most_overlap=0.5, top=3).alias("few"), F.size(X.kept_boxes(F.col("b"))).alias("all")).first()
    assert [x["left"] for x in row["few"]] == [0.0, 1.0, 2.0] and row["all"] == 50_000


def test_rows_get_the_same_id_again(spark):
    from tessera.operators.documents import with_ids

    frame = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), ("x", "a")], "_id string, t string")
    first, again, other = ({x["_id"] for x in with_ids(frame.repartition(n), token).collect()} for n, token in ((1, "k"), (3, "k"), (2, "l")))
    assert first == again and len(first) == 4 and first & other == {"x"}
