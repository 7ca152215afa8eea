import hashlib
import random

import pytest

from tessera.llm import jaccard, substrings
from tessera.llm.graph import connected_components
from tessera.llm.jaccard import jaccard_components, region_keys
from tessera.llm.queries import op1_ngram_jaccard, op9_substring_dedup
from tessera.llm.words import words_of
from tests_llm_shared import brute_components, roots


@pytest.fixture(scope="module")
def blobs(spark):
    """Groups whose members are near an original, near each other, or in a chain; boilerplate; tiny and odd texts."""
    draw = random.Random(5)
    rows = []
    for group in range(4):
        base = [f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(30, 80))]
        chain = list(base)
        for _ in range(80):
            text = chain if group == 3 else list(base)
            for _ in range(draw.choice([1, 2, 3])):
                text[draw.randrange(len(text))] = f"z{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(text)))
    passage = " ".join(f"p{k}" for k in range(40))
    rows += [(len(rows) + k, f"{passage} {' '.join(f'q{draw.randrange(10**6)}' for _ in range(draw.randrange(0, 60)))}") for k in range(120)]
    rows += [(2000 + k, " ".join(f"v{draw.randrange(40)}" for _ in range(draw.randrange(0, 30)))) for k in range(150)]
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "one"), (3004, "ONE"), (3005, "one two"), (3006, "One  two"), (None, "one"), (rows[0][0], rows[0][1]), (3007, "x " * 30_000), (3008, "X " * 29_000)]
    return rows, spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, key string, region int").repartition(5).cache()


@pytest.mark.parametrize(("n", "num", "region_rows"), [(1, 90, 2048), (1, 80, 40), (2, 70, 2048), (3, 90, 40), (5, 80, 2048), (1, 60, 25)])
def test_components_are_exact(blobs, n, num, region_rows):
    rows, frame = blobs
    found = jaccard_components(frame, n=n, num=num, den=100, region_rows=region_rows).collect()
    assert len(found) == len(rows)
    wanted = brute_components(rows, n, num)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found if x["doc_id"] is not None} == wanted
    assert [x["component_id"] for x in found if x["doc_id"] is None] == [None]


def test_query_on_a_table(spark, tables):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert {x[0]: (x[1], x[2]) for x in op1_ngram_jaccard(spark, tables).collect()} == brute_components(rows, 3, 90)


def test_empty_table_and_bad_threshold(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_components(empty).collect() == []
    with pytest.raises(ValueError):
        jaccard_components(empty, num=0)


def test_linked_sets_share_enough_keys():
    import numpy as np

    draw = np.random.default_rng(0)
    for size in (9, 10, 15, 16, 17, 40, 100, 129, 300):
        for num in (90, 80):
            a = np.unique(draw.integers(0, 2**63, size * 2).astype(np.uint64))[:size]
            differ = size * (100 - num) // (100 + num)  # replaced shingles: at most this keeps the link
            b = np.unique(np.concatenate((a[differ:], draw.integers(0, 2**63, differ).astype(np.uint64))))
            if 100 * len(np.intersect1d(a, b)) >= num * len(np.union1d(a, b)) and differ:
                assert set(region_keys(a, num, 100).tolist()) & set(region_keys(b, num, 100).tolist())


def test_regions_that_pivots_do_not_part_stay_bounded(spark, monkeypatch):
    draw = random.Random(8)
    line = [f"p{k}" for k in range(16)]
    rows = [(k, " ".join(line + [f"q{draw.randrange(10**9)}" for _ in range(24)])) for k in range(400)]
    # linked ones among them: a word less, and a chain
    rows += [(400 + k, rows[7 * k][1].rsplit(" ", 1)[0]) for k in range(20)]
    chain = rows[399][1].split()
    for k in range(30):
        chain = [*chain[:16], *chain[18:], f"c{k}", f"d{k}"]
        rows.append((500 + k, " ".join(chain)))
    # texts of few words, in which the rarest ones are frequent, too
    rows += [(600 + k, " ".join(line + draw.sample([f"v{x}" for x in range(30)], 10))) for k in range(300)]
    real = jaccard._joined

    def bounded(num, den):
        run = real(num, den)

        def checked(batches):
            from collections import Counter

            held = list(batches)
            members = Counter(k for x in held for k in zip(x.column(1).to_pylist(), x.column(2).to_pylist(), strict=True))
            assert max(members.values(), default=0) <= 120, "a task takes too many members of a region"
            return run(iter(held))

        return checked

    monkeypatch.setattr(jaccard, "_joined", bounded)
    for n, num in ((1, 80), (2, 80)):
        found = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n=n, num=num, den=100, region_rows=50).collect()
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in found} == brute_components(rows, n, num)


def test_components_of_a_graph(spark):
    draw = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 140)] + [(5, 500 + k) for k in range(60)] + [(draw.randrange(900, 1000), draw.randrange(900, 1000)) for _ in range(60)] + [(7, 7), (None, 3)]
    found = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None]
    assert found == roots({x for e in real for x in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, window):
    seen, out = set(), {}
    for key, text in sorted((k, t) for k, t in {(k, t or "") for k, t in rows if k is not None}):
        words = words_of(text)
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            mark = hashlib.md5(b" ".join(words[k : k + window])).digest()
            if mark in seen:
                gone[k : k + window] = [True] * window
            seen.add(mark)
        out[key] = (len(words), sum(gone), substrings.plain_sha256([w for w, g in zip(words, gone, strict=True) if not g]))
    return out


@pytest.mark.parametrize(("window", "anchor"), [(5, 2), (20, 8), (12, 12), (6, 1)])
def test_repeats_are_exact(spark, window, anchor):
    draw = random.Random(3)
    rows = []
    for k in range(300):
        words = []
        while len(words) < draw.choice([0, 3, 30, 100]):
            words += [draw.choice("abcd") for _ in range(draw.randrange(1, 12))] if draw.random() < 0.3 else [f"v{draw.randrange(500)}"]
        rows.append((k, "  ".join(words)))
    for k in range(300, 450):
        a = rows[draw.randrange(300)][1].split()
        at = draw.randrange(0, len(a) + 1)
        rows.append((k, " ".join(a[at : at + draw.randrange(1, 40)] + ["q"] * draw.randrange(0, 9) + rows[draw.randrange(300)][1].split()[:25])))
    rows += [(600, None), (601, ""), (602, "z " * 500), (603, "z " * 50_000), (rows[3][0], rows[3][1])]
    frame = spark.createDataFrame([(k, t, 0) for k, t in [*rows, (None, "z " * 100)]], "doc_id long, text string, start int").repartition(4)
    found = substrings.digests(substrings.remove_repeats(frame, window=window, anchor=anchor)).collect()
    assert len(found) == len(rows) + 1
    assert {x[0]: tuple(x)[1:] for x in found if x[0] is not None} == brute_repeats(rows, window)
    assert [x["n_removed"] for x in found if x[0] is None] == [0]


def test_one_anchor_in_all_documents(spark):
    """A phrase that all documents have, in contexts that differ, is dealt by window and changes no result."""
    draw = random.Random(5)
    own = lambda n: [f"u{draw.randrange(10**9)}" for _ in range(n)]
    shared = own(30)
    rows = [(k, " ".join(own(draw.randrange(3, 30)) + (["all", "rights", "are", "reserved", "here"] if k % 50 else shared + ["all", "rights", "are", "reserved", "here"]) + own(draw.randrange(3, 30)))) for k in range(1500)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert 0 < len(substrings.hot_anchors(frame, window=20, anchor=1)) < 4096
    found = substrings.digests(substrings.remove_repeats(frame, window=20, anchor=1)).collect()
    assert {x[0]: tuple(x)[1:] for x in found} == brute_repeats(rows, 20)


def test_partitions_are_read_key_by_key():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 4, 5]
    for step in range(1, 13):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + step], pa.int64())], ["key"]) for a in range(0, 12, step)]
        parts = [x.column(0).to_pylist() for x in substrings._runs_of_keys(iter([*batches, batches[0].slice(0, 0)]))]
        assert [y for x in parts for y in x] == keys and sum(len(set(x)) for x in parts) == 5


def test_repeats_of_a_table(spark, tables):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    assert {x[0]: tuple(x)[1:] for x in op9_substring_dedup(spark, tables).collect()} == brute_repeats(rows, 20)
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        substrings.repeated_windows(spark.createDataFrame([], "doc_id long, text string"), window=3, anchor=4)
