import pytest

from tessera.plans.filters import FilterError, inferred_filter, structured_filter

ROWS = [
    ("1", 1, "2", True, ["x", "hello world"], 1.5, {"k": 3}),
    ("2", 2, "How's it going?", False, ["y"], -2.0, {"k": -1}),
    ("3", None, None, None, None, None, None),
    ("4", 4, "1, 2, 3", True, [], 0.0, {}),
    ("5", 5, "", False, ["x"], 9.0, {"j": 1}),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "_id string, a int, `My Field-` string, flag boolean, list array<string>, f double, m map<string,int>").cache()


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("a:1", "1"), ("a:[2 TO 4]", "24"), ("a:[* TO 2]", "12"), ("a:[2 to *]", "245"), ("f:[-2.5 TO 0]", "24"),
        (r"My\ Field\-:(How's it going?)", "2"), (r"My\ Field\-:(1, 2, 3)", "4"), ("a IN (1, 4)", "14"), ("a in (1,(5))", "15"),
        ("flag:TRUE", "14"), ("NOT flag:true", "235"), ("list:x", "15"), ("list:(hello world)", "1"), ("list IN (y, x)", "125"),
        ("a:1 OR a:2 AND flag:true", "1"), ("(a:1 OR a:2) AND flag:false", "2"), ("NOT (a:1 OR a:2)", "345"), ("a:1 AND NOT flag:false OR a:5", "15"),
        ("_id:3", "3"), ("NOT a:[0 TO 100]", "3"), ("a:1 AND (flag:true OR (f:9 AND (a:4 OR a:5))) OR a:4", "14"), ("NOT NOT a:1", "1"),
    ],
)
def test_matches(docs, text, ids):
    assert "".join(sorted(x["_id"] for x in docs.where(structured_filter(docs, text)).collect())) == ids


@pytest.mark.parametrize("text", ["", " ", "a", "a:", "a:1 AND", "AND a:1", "a:1 a:2", "(a:1", "a:1)", "a:[1 TO]", "a:[* TO *]", "a:[x TO 3]", "a IN ()", "a:1 OR OR a:2", "NOT", "a:[1 2]", "b:1", "a:x", "flag:maybe", "f IN (1)", "a IN (x)", "list:[1 TO 2]"])
def test_errors(docs, text):
    with pytest.raises(FilterError):
        structured_filter(docs, text)


@pytest.mark.parametrize("text", ["a" * 10_000, "a\\ b" * 3000, "\\" * 9999, "a:(" + "x" * 9999, "a IN (" + "(b), " * 5000, "a:[" + "1 " * 9999, "(" * 5000 + "a:1", "NOT " * 5000, "a IN (" + "\\a" * 9999])
def test_long_filters_are_read_in_linear_time(docs, text):
    import time

    began = time.time()
    with pytest.raises(FilterError):
        structured_filter(docs, text)
    assert time.time() - began < 5


def test_only_filterable_fields(docs):
    with pytest.raises(FilterError):
        structured_filter(docs, "a:1", filterable={"flag"})
    assert docs.where(structured_filter(docs, "_id:1", filterable={"flag"})).count() == 1


def test_inferred_fields(spark, docs):
    from tessera.operators.documents import flattened, unflattened

    flat = flattened(docs)
    ids = lambda text: "".join(sorted(x["_id"] for x in flat.where(inferred_filter(text)).collect()))
    assert ids("a:2") == "2" and ids("list:x") == "15" and ids("flag:true") == "14" and ids("m.k:[0 TO 5]") == "1" and ids("NOT a:1 AND NOT f:[-5 TO 5]") == "35"
    assert ids(r"My\ Field\-:2 OR f:9") == "15"
    with pytest.raises(FilterError):
        inferred_filter("a IN (1)")
    assert '"x"' in {x["_id"]: x["document"] for x in unflattened(flat).collect()}["1"]
