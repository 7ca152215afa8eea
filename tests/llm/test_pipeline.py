import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import quality, secret_scan
from tests_llm_shared import brute_components, gapless, plain_base, plain_targets

COLUMNS = list(corpus_pipeline.COLUMNS)


@pytest.fixture(scope="module")
def stages(spark, tables, tmp_path_factory):
    """Every stage's rows, written and read as a job does it."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{tables}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, docs, tables)
        assert k == 4 or rows.columns == COLUMNS
        rows.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs.collect())
    return spark.read.parquet(f"{tables}/documents.parquet").collect(), out


def test_rejected_documents_go(spark, tables, stages):
    given, (kept, *_) = stages
    scores = quality.quality_scores(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
    good = {x["doc_id"] for x in scores.collect() if x["score"] >= 0.5}
    assert Counter(map(tuple, kept)) == Counter(tuple(x) for x in given if x["doc_id"] in good) and 0 < len(kept) < len(given)


def test_one_of_each_group_stays(stages):
    _, (given, kept, *_) = stages
    groups = brute_components([(x["doc_id"], x["text"]) for x in given], 5, 80)
    assert Counter(map(tuple, kept)) == Counter(tuple(x) for x in given if groups[x["doc_id"]][1] == x["doc_id"])


def test_secrets_are_replaced(stages):
    _, (_, given, kept, *_) = stages
    before = {x["doc_id"]: x for x in given}
    assert len(kept) == len(given)
    for x in kept:
        old = before[x["doc_id"]]
        assert x["text"] == secret_scan.redacted_text(old["text"]) and x["n_chars"] == len(x["text"])
        assert x["text"] == old["text"] or plain_base(old["text"]) or secret_scan.literal_spans(old["text"])
        assert not plain_base(x["text"])


def test_sources_come_to_their_targets(stages):
    _, (_, _, given, taken, _) = stages
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x["text"]))
    totals, words = Counter(), Counter()
    for x in given:
        totals[x["source"]] += size(x)
    for x in taken:
        words[x["source"]] += size(x)
    counts = Counter(map(tuple, taken))
    assert set(counts) <= set(map(tuple, given)) and max(counts.values()) <= 2
    assert all(abs(words[s] - t) <= max(0.03 * t, 150) for s, t in plain_targets(dict(totals)).items())


def test_everything_is_packed(stages):
    _, (*_, given, packed) = stages
    rows = [x.asDict() for x in packed]
    total = gapless(rows)
    ids = Counter()
    for x in rows:
        ids[x["doc_id"], x["piece"]] += 1
    assert Counter(x["doc_id"] for x in given) == Counter({d: n for (d, p), n in ids.items() if p == 0})
    assert len({x["sequence_id"] for x in rows}) <= np.ceil(total / 2048) * 1.05 + 1


def test_run_is_the_stages_in_a_row(spark, tables, stages):
    rows = corpus_pipeline.run(spark, tables).collect()
    of = lambda rows: Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in rows)
    assert of(rows) == of(stages[1][4])


def test_odd_documents_pass_all_stages(spark, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = [(1, "a b c d e f token=abcdef123", "en", "s", 5), (1, "a b c d e f token=abcdef123", "en", "s", 5), (2, None, None, None, None), (None, "x y z", "en", None, 5), (3, "", "", "", 0), (4, "word " * 30_000, "en", "s", 1)]
    docs = spark.createDataFrame([(*x, "more") for x in rows], "doc_id long, text string, lang string, source string, n_chars long, size string")
    for empty in (False, True):
        frame = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, str(tmp_path))
            if name == "n-gram Jaccard join":
                assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in frame.collect()) == ([] if empty else [(False, 1), (False, 2), (False, 3), (False, 4), (True, 0)])
        assert (frame.count() > 0) != empty
