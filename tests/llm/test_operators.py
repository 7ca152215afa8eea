import json
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, mixing, packing, quality, secret_scan, toxicity, urls
from tessera.llm.calibration import bounded, calibrated, id_remainder, isotonic
from tessera.llm.queries import oracle_sql, queries
from tests_llm_shared import gapless, plain_base, plain_targets

# -- URL filters


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_give_their_sql(spark, tables, name):
    duck = duckdb.connect()
    for table in ("documents", "pages"):
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    wanted = duck.sql(oracle_sql()[name])
    frame = queries()[name](spark, tables)
    assert sorted(frame.columns) == sorted(wanted.columns)
    assert Counter(map(tuple, frame.select(*wanted.columns).collect())) == Counter(wanted.fetchall())


@pytest.mark.parametrize("blocks", [1, 7, 1 << 16])
def test_url_rules(spark, blocks):
    """Few blocks make the filter pass nearly all: the exact join removes what it should not have."""
    listed = spark.createDataFrame([("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/es/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    cases = [
        ("http://WWW.Example.COM/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"), ("https://a.example.com/en/", "a.example.com", "/en/", "example.com/en/", "block"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
        ("http://example.com", "example.com", "", None, "allow"), ("ftp://x.net/es/a", "x.net", "/es/a", "net/es/", "block"), ("x.net/es/a", "", "", None, "allow"), (None, "", "", None, "allow"), ("://", "", "", None, "allow"), ("http://net/es", "net", "/es", None, "allow"),
        ("http://x.net?u=/es/", "x.net", "", None, "allow"), ("http://a..com/", "a..com", "/", "com/", "allow"), ("", "", "", None, "allow"),
    ]
    pages = spark.createDataFrame([(k % 7 or None, u, "x") for k, (u, *_) in enumerate(cases)] * 2, "page_id long, url string, host string")
    assert Counter(tuple(x)[1:] for x in urls.judge_urls(pages, listed, blocks=blocks).collect()) == Counter([tuple(x[1:]) for x in cases] * 2)
    assert urls.judge_urls(pages.limit(0), listed).count() == 0 and urls.judge_urls(pages, listed.limit(0)).where("verdict = 'allow'").count() == 2 * len(cases)


def test_long_lists_and_long_urls(spark):
    """The filter grows with the list up to its bound; hosts of one label, rows without a host and very long urls keep their results."""
    assert [urls.blocks_for(n) for n in (0, 1, 2, 3, 1000, 10**9)] == [1, 1, 1, 2, 512, urls.BLOCKS] and urls.blocks_for(10**9, 64) == 64
    rules = {(f"h{k}.org", f"/{k % 50}/"): "block" if k % 3 else "allow" for k in range(2000)} | {("com", "/"): "block", ("org", "/7/"): "allow", ("org", "/" + "p" * 3000): "block"}
    listed = spark.createDataFrame([(*k, v) for k, v in rules.items()], "host string, path string, verdict string")
    plain = [f"http://a.h{k}.org/{k % 60}/x" for k in range(0, 3000, 7)] + [f"http://s{k % 5}.com/{k}" for k in range(300)] + ["nothing"] * 300 + ["http://a.org/" + "p" * 1_000_000, "http://" + "b." * 200 + "org/7/"]
    pages = spark.createDataFrame(list(enumerate(plain)), "page_id long, url string")
    rows = {x["page_id"]: x for x in urls.judge_urls(pages, listed).collect()}
    assert len(rows) == len(plain)
    for k, url in enumerate(plain):
        host, _, path = url.partition("://")[2].partition("/")
        labels, path = host.split("."), "/" + path
        fits = [(".".join(labels[i:]), path[:n]) for i in range(len(labels)) for n in (1, 3, 4, 3001) if (".".join(labels[i:]), path[:n]) in rules and len(path) >= n] if host else []
        best = max(fits, key=lambda x: len(x[0] + x[1]), default=None)
        assert (rows[k]["rule"], rows[k]["verdict"]) == (("".join(best), rules[best]) if best else (None, "allow"))


# -- secrets

@pytest.mark.parametrize(
    ("text", "literals"),
    [
        ('x = "Zk93jfls02kdALs9"\npassword = x', ["Zk93jfls02kdALs9"]), ('a = "Zk93jfls02kdALs9"\nb = a\nc = b\nclient_secret = c + "q"', ["Zk93jfls02kdALs9"]), ("pwd: hunter2hunter2", ["hunter2hunter2"]), ('config["db_password"] = "s3cr3t!Pa55word"', ["s3cr3t!Pa55word"]),
        ('name = "Zk93jfls02kdALs9"', []), ("see http://a.b/c: fine", []), ('"pwd" : "<your password>"', []), ("pwd = xxxxxxxxxx1", []), ("if pwd == abcdefgh12345: pass", []), ('public_key_length: "Zk93jfls02kdALs9"', []), ("", []), (None, []),
    ],
)
def test_literals_flow_to_names(text, literals):
    assert [text[a:b] for kind, a, b in secret_scan.spans_of(text) if kind == "literal"] == literals


@pytest.mark.parametrize(
    ("text", "literals"),
    [
        ("<password>Zx9qLm22pQ7s</password>", ["Zx9qLm22pQ7s"]), ("<password>Zx9qLm22pQ7s</pass>", []), ("client_secret: >\n  Zx9qLm22pQ7s\nnext: 1", ["Zx9qLm22pQ7s"]), ("a:\n  pwd: |\n    Zx9qLm22pQ7s\n  b: Yx9qLm22pQ7s", ["Zx9qLm22pQ7s"]),
        ('db_password = """Zx9qLm22pQ7s"""', ["Zx9qLm22pQ7s"]), ("run --password Zx9qLm22pQ7s now", ["Zx9qLm22pQ7s"]), ("run --pass-file /etc/Zx9qLm22pQ7s", []), ('user.setPassword("Zx9qLm22pQ7s")', ["Zx9qLm22pQ7s"]), ('api_secret = os.getenv("X", "Zx9qLm22pQ7s")', ["Zx9qLm22pQ7s"]),
        ('pwd = os.environ.get("A") or "Zx9qLm22pQ7s"', ["Zx9qLm22pQ7s"]), ('pwd: str = "Zx9qLm22pQ7s!"', ["Zx9qLm22pQ7s!"]), ('props.put("db.pwd", "Zx9qLm22pQ7s")', ["Zx9qLm22pQ7s"]), ("Authorization: Bearer Zx9qLm22pQ7sAA", ["Zx9qLm22pQ7sAA"]), ('pwd = "Zx9qL" + "m22pQ7s"', ["Zx9qL", "m22pQ7s"]),
        ('pwd = \\\n  "Zx9qLm22pQ7s"', ["Zx9qLm22pQ7s"]), ("PRIVATE_KEY=<<EOF\nZx9qLm22pQ7sAAAA\nEOF\n", ["Zx9qLm22pQ7sAAAA"]), ("# pwd: Zx9qLm22pQ7s\n", ["Zx9qLm22pQ7s"]), ('// x = "Zx9qLm22pQ7s"\npwd = x', []), ('/* x = "Zx9qLm22pQ7s" */ pwd = x', []),
        ('conn = "Server=a;Pwd=Zx9qLm22pQ7s;"', ["Zx9qLm22pQ7s"]), ("it's the pwd=Zx9qLm22pQ7s isn't", ["Zx9qLm22pQ7s"]), ("The key of the secret (a token) passed: nobody knows it.", []), ('log("password", "is", "wrong")', []),
    ],
)
def test_forms_of_assignments(text, literals):
    assert [text[a:b] for kind, a, b in secret_scan.spans_of(text) if kind == "literal"] == literals


@pytest.mark.parametrize("part", ["pwd(", "<!-- pwd ", '/* pwd "', "<a <pwd>", "pwd: >\n", 'pwd = "a" + ', 'pwd="""', "--pwd ", "Bearer ", "<<A\npwd=", "pwd=<<A\n", "pwd='a\\\'", "\\\'pwd", "pwd" + " " * 99, "((("])
def test_long_texts_take_linear_time(part):
    import time

    text = "pwd = x; " + part * 20_000 + ")" * 20_000
    began = time.time()
    secret_scan.spans_of(text)
    assert time.time() - began < 10


def test_repeated_rows_have_repeated_literals(spark):
    frame = spark.createDataFrame([(1, "pwd = Zx9qLm22pQ7s", "x")] * 3, "doc_id long, text string, n_assign string")
    rows = secret_scan.digests(secret_scan.secret_spans(frame)).collect()
    assert [tuple(x)[:4] for x in rows] == [(1, 0, 0, 0)] * 3 and {x["spans"] for x in rows} == {"literal:6:18"}


def test_base_spans_stay(spark, tables):
    rows = [(x["doc_id"], x["text"]) for x in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    odd = ["token=token=abcdef", "secret=token: abcdef", "PASSWORD: 'abc def'", "paſſword=abcdef1", "toKen=abcdefg", "AKIA" + "A" * 15, "AKIAAKIA" + "B" * 20, "0" * 23 + "g" + "a" * 24 + "é" + "b" * 30, "api_key=" + "k" * 100_000, "=" * 5000 + '"' * 5000, "a=" * 20_000]
    for text in [t for _, t in rows] + odd:
        spans = secret_scan.spans_of(text)
        assert [x for x in spans if x[0] != "literal"] == sorted(plain_base(text), key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))
    found = {x["doc_id"]: x for x in queries()["op6_secret_scan"](spark, tables).collect()}
    for key, text in rows:
        base = sorted(plain_base(text), key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))
        assert found[key]["n_assign"] == sum(x[0] == "assign" for x in base) and found[key]["n_hex"] == sum(x[0] == "hex" for x in base)
        import hashlib

        assert found[key]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()


def test_redaction(spark):
    frame = spark.createDataFrame([(1, "a token=abcdef1234 b", "x"), (2, "clean: text", None), (None, None, None), (2, "clean: text", None)], "doc_id long, text string, spans string")
    rows = secret_scan.redact(frame)
    assert rows.columns == frame.columns and Counter(map(tuple, rows.collect())) == Counter([(1, "a [secret] b", "x"), (2, "clean: text", None), (None, None, None), (2, "clean: text", None)])
    assert secret_scan.digests(secret_scan.secret_spans(frame)).count() == 4 and secret_scan.secret_spans(frame.limit(0)).count() == 0


# -- classifiers


def test_isotonic_curve():
    x, y = isotonic(np.arange(6.0), np.array([0, 3, 1, 5, 9, 10.0]), np.full(6, 10.0))
    assert (np.diff(y) >= 0).all() and len(x) == len(y) and y[0] < 0.1 and y[-1] > 0.9


def held_out(spark, folder, name, label, of, rest):
    scores = queries()[name](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scores.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    assert scores.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert scores.where(F.col("held_out") != (id_remainder(F.col("doc_id"), of) == rest)).count() == 0 and scores.where("score < 0 or score > 1 or score is null or predicted <> int(score >= 0.5)").count() == 0
    return sum(x["predicted"] == x[label] for x in rows) / len(rows)


def test_held_out_accuracy(spark):
    assert held_out(spark, "/root/testdata/sf0.01", "op2_quality_classifier", "quality", 3, 1) >= 0.97
    assert held_out(spark, "/root/testdata/sf0.01", "op10_toxicity", "toxic", 5, 0) >= 0.95


def test_remainder_is_that_of_the_text(spark):
    rows = spark.range(50).select("id", id_remainder(F.col("id"), 3).alias("r")).collect()
    assert all(x["r"] == zlib.crc32(str(x["id"]).encode()) % 3 for x in rows)


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_documents_get_scores(spark, score):
    docs = spark.createDataFrame([(1, None, 0.1), (None, "you idiot", 0.2), (2, "", 0.3), (2, "\n\n", 0.4), (3, "w " * 200_000, 0.5)], "doc_id long, text string, score double")
    for labels in ([], [(1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1)], [(1, 1, 1)]):
        rows = score(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
        assert len(rows) == 5 and all(0 <= x["score"] <= 1 for x in rows)
    assert score(docs.limit(0), spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_grammar_of_clauses():
    lexicon = toxicity.Lexicon({}, {"grob": 3.0})
    weight = lambda text: sum(toxicity.clause_weights(toxicity.tokens_of(text), lexicon))
    assert weight("an idiot") < weight("you idiot") and weight("you are not an idiot") < weight("you idiot") and weight("he said you idiot") < weight("you idiot")
    assert weight("idiot idiot") < 2 * weight("idiot") and weight("kill it") == 0 < weight("they kill") and weight("nice day") == 0 and weight("ein grobian") == 3.0
    assert len(toxicity.clause_weights(toxicity.tokens_of("idiot. fine. moron!"), lexicon)) == 2


def test_threats_and_targets_on_both_sides():
    lexicon = toxicity.Lexicon({}, {})
    weight = lambda text: sum(toxicity.clause_weights(toxicity.tokens_of(text), lexicon))
    assert weight("I will kill you") > weight("kill it") == 0 and weight("I will kill them all") > 0 and weight("you will die") > 0 and weight("kill. you") == 0
    assert weight("idiot, you") == weight("you idiot") > weight("an idiot") > 0
    assert weight("I will not kill you") < weight("I will kill you") and weight("he said: kill you") < weight("I will kill you")
    assert 0 < weight("idiot\nyou") == weight("idiot") and weight("kill " * 50_000 + "you") > 0


def test_toxicity_agrees_with_a_plain_version(spark):
    """Learning and scoring again with dictionaries and numpy."""
    folder = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    text = {x["doc_id"]: x["text"] for x in docs.collect()}
    label = {x["doc_id"]: float(x["toxic"]) for x in labels.where("toxic is not null").collect() if x["doc_id"] in text}
    once = {(text[k] or "", y): k for k, y in sorted(label.items(), reverse=True)}.values()
    total, seen = Counter(label[k] for k in once), {0.0: Counter(), 1.0: Counter()}
    for k in once:
        seen[label[k]].update({x for x in toxicity.tokens_of(text[k]) if len(x) > 1})
    counts = {(w, True): (seen[1.0][w], seen[0.0][w]) for w in seen[0.0] | seen[1.0]}
    for (w, whole), (bad, good) in list(counts.items()):
        for n in range(toxicity.SHORTEST, min(toxicity.LONGEST, len(w) - 1) + 1) if whole else ():
            old = counts.get((w[:n], False), (0, 0))
            counts[w[:n], False] = (old[0] + bad, old[1] + good)
    entries = ({}, {})
    for (w, whole), (bad, good) in counts.items():
        least = np.log((bad + 0.5) / (total[1.0] + 1)) - np.log((good + 0.5) / (total[0.0] + 1)) - 1.64 * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
        if bad >= toxicity.LEAST_DOCS and least >= toxicity.LEAST_ODDS:
            entries[not whole][w] = least
    found = toxicity.learned(toxicity.different_texts(docs.join(labels.select("doc_id", F.col("toxic").cast("double").alias("label")), "doc_id")).join(docs.select("doc_id", "text"), "doc_id"))
    assert [set(x) for x in found] == [set(x) for x in entries] and all(abs(found[k][w] - v) < 1e-9 for k in (0, 1) for w, v in entries[k].items())
    inputs = {}
    for k, x in text.items():
        weights = toxicity.clause_weights(toxicity.tokens_of(x), toxicity.Lexicon(*entries))
        inputs[k] = [1.0, np.log1p(sum(weights)), np.log1p(max(weights, default=0.0)), np.log1p(len(toxicity.tokens_of(x)))]
    x, y, w = np.array([inputs[k] for k in label]), np.array(list(label.values())), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + toxicity.RIDGE * np.eye(4), x.T @ (y - p) - toxicity.RIDGE * w)
    rows = toxicity.toxicity_scores(docs, labels).collect()
    raw = {k: float(np.array(v) @ w) for k, v in inputs.items()}
    order = sorted(rows, key=lambda r: raw[r["doc_id"]])
    assert len(rows) == len(text) and all(a["score"] <= b["score"] + 1e-6 for a, b in zip(order, order[1:], strict=False))
    assert all(abs(r["score"] - s["score"]) < 1e-6 for r in rows for s in rows if raw[r["doc_id"]] == raw[s["doc_id"]])


def test_bounded_sample_and_curve(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") / 20_000).alias("raw"), (F.col("id") > 12_000).cast("double").alias("label"))
    assert bounded(frame, 50_000).count() == 20_000 and 800 < bounded(frame, 1000).count() < 1200
    knots, values = calibrated(frame, 0.0, 1.0)
    assert np.interp(0.3, knots, values) < 0.05 and np.interp(0.9, knots, values) > 0.95


# -- packing


def test_pieces_and_places(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [(1, None), (None, "abc"), (2, ""), (2, ""), (3, "word " * 9000), (4, "<|endoftext|> déjà vu 😀 \x00 ſ\n\n\t  x"), (5, "ab" * 3000), (6, "'s 't 12345   !!!"), (7, "  a\xa0  b\n\n c\u2028 \x1c d  "), (8, " \n "), (9, "日本 \U000323b0 テスト  \t"), (3, "a <|endoftext|> b"), (3, "<|endoftext|>")]
    texts += [(x["doc_id"] + 10, x["text"]) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    frame = spark.createDataFrame([(k, t, -1) for k, t in texts], "doc_id long, text string, item long")
    rows = [x.asDict() for x in packing.pack_documents(frame, with_ids=True).collect()]
    wanted = Counter()
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (at, n) in enumerate(packing.cuts(len(ids), 2048)):
            data = ids[at : at + n].tobytes()
            wanted[key, k, at, n, zlib.crc32(data), data] += 1
    assert Counter((x["doc_id"], x["piece"], x["start"], x["length"], x["ids_crc32"], bytes(x["ids"])) for x in rows) == wanted
    total = gapless(rows)
    assert len({x["sequence_id"] for x in rows}) <= -(-total // 2048) * 1.05 + 1
    assert packing.pack_documents(frame.limit(0)).count() == 0


def test_remembered_units_are_bounded():
    """Ids stay those of the library when what is remembered is thrown away again and again."""
    import pyarrow as pa

    encoder = packing.Encoder(packing.default_vocabulary())
    draw = np.random.default_rng(0)
    texts = ["".join(draw.choice(list("abcdeé\n .'7"), 40)) for _ in range(400)] + ["the same words"] * 50
    kept, packing.KEPT = packing.KEPT, 50
    try:
        for a in range(0, len(texts), 30):
            some = texts[a : a + 30]
            ids, bounds = encoder.batch(pa.array(some))
            assert len(encoder.units) <= 50
            assert [ids[i:j].tolist() for i, j in zip(bounds[:-1], bounds[1:], strict=True)] == [[*encoder.tokenizer.encode(x, add_special_tokens=False).ids, 0] for x in some]
    finally:
        packing.KEPT = kept


def test_groups_of_bins_stay_bounded(spark):
    """No level puts more than its share of bins into one task, and it ends where no bins can be joined."""
    items = spark.range(3000).select(F.col("id").alias("item"), (1100 + F.col("id") % 900).alias("size"))
    rows = packing.pack(items, length=2048, tasks=8, group_rows=100).collect()
    assert len(rows) == len({x["sequence_id"] for x in rows}) == 3000


@pytest.mark.parametrize("tasks", [1, 3, 40])
def test_levels_of_packing(spark, tasks):
    draw = np.random.default_rng(tasks)
    sizes = [*draw.integers(1, 2049, 3000).tolist(), *[1100] * 300, *[1] * 50]
    items = spark.createDataFrame([(k, n) for k, n in enumerate(sizes)], "item long, size long")
    rows = packing.pack(items, length=2048, tasks=tasks).join(items, "item").select("sequence_id", "offset", F.col("size").alias("length")).collect()
    assert len(rows) == len(sizes) and gapless([x.asDict() for x in rows]) == sum(sizes)
    least = packing.best_fit(np.array(sizes), 2048)[2]
    assert len({x["sequence_id"] for x in rows}) <= 1.06 * len(least) + 2


def test_cuts():
    assert packing.cuts(0, 4) == [] and packing.cuts(3, 4) == [(0, 3)] and packing.cuts(4, 4) == [(0, 4)] and packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)] and packing.cuts(8, 4) == [(0, 4), (4, 4)]


# -- mixing


@pytest.mark.parametrize("sizes", [{"a": 100}, {"a": 10, "b": 1000, "c": 5, "d": 300}, {"a": 1, "b": 1, "c": 1, "é": 7, "Z": 900, None: 40}, {"a": 0, "b": 10}])
def test_targets(spark, sizes):
    frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    found = {x["source"]: x["target"] for x in mixing.source_targets(frame).collect()}
    assert {k: round(v, 6) for k, v in found.items()} == {k: round(v, 6) for k, v in plain_targets(sizes).items()}


def test_mix_meets_its_targets(spark, tables):
    first, again = (sorted(map(tuple, queries()["op4_source_mix"](spark, tables).collect())) for _ in range(2))
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    size = {x["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", x["text"] or "")) for x in docs}
    sources = {x["doc_id"]: x["source"] for x in docs}
    totals = Counter()
    for k, n in size.items():
        totals[sources[k]] += n
    targets = plain_targets(dict(totals))
    taken = Counter()
    assert first == again and {x[0]: x[1] for x in first} == size
    for key, n, total, target, words in first:
        assert total == totals[sources[key]] and abs(target - targets[sources[key]]) < 1e-6 and words in (0, n, 2 * n)
        taken[sources[key]] += words
    assert all(abs(taken[s] - t) <= max(0.01 * t, 60) for s, t in targets.items())


def test_longer_documents_are_tilted_together(spark):
    """Rates are one function of size within a source: the tilt of the dual's solution."""
    counts = spark.createDataFrame([("a", 10, 100), ("a", 50, 40), ("a", 200, 10)], "source string, size long, docs long")
    targets = spark.createDataFrame([("a", 5000, 7000.0)], "source string, source_size long, target double")
    rates = {x["size"]: x["rate"] for x in mixing.balanced_rates(counts, targets).collect()}
    odds = {k: np.log(r / (2 - r)) / k for k, r in rates.items()}
    assert abs(sum(k * n * rates[k] for k, n in ((10, 100), (50, 40), (200, 10))) - 7000) < 1 and np.allclose(list(odds.values()), odds[10], rtol=1e-3)


def test_odd_rows_are_mixed(spark):
    rows = [(1, None, None), (2, "", "a"), (None, "a b c d", None), (3, "x y", "b"), (3, "x y", "b"), (4, "x y z", "b"), (5, "w " * 50_000, "c")] + [(100 + k, "same words here", "hot") for k in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(frame)
    assert mixed.count() == len(rows) and mixing.take_copies(frame, mixed).count() == mixed.agg(F.sum("copies")).first()[0]
    assert {x["copies"] for x in mixed.where("size = 0").collect()} == {0} and mixing.mix(frame.limit(0)).count() == 0


def test_rows_without_id_take_their_own_copies(spark):
    """Sources and sizes of rows that share a doc_id, or have none, are not mixed up."""
    rows = [(None, "w " * 100 + str(k), "a", 7, "x") for k in range(100)] + [(None, "v " * 5 + str(k), "b", 7, "y") for k in range(100)] + [(1, "same", "b", 7, "z"), (1, "other text", "a", 7, "z"), (1, "same", "b", 7, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, copies string")
    mixed = mixing.mix(frame)
    wanted, got = Counter(), Counter()
    for x in mixed.collect():
        wanted[x["doc_id"], x["source"]] += x["size"] * x["copies"]
    taken = mixing.take_copies(frame, mixed)
    assert taken.columns == frame.columns
    for x in taken.collect():
        got[x["doc_id"], x["source"]] += len(x["text"].split())
    assert got == +wanted and {x["target"] for x in mixed.where("source = 'b'").collect()} != {None}


def test_copies_agree_with_a_plain_version(spark, tables):
    """Rates by bisection of the dual, and copies by carrying the rounding error, in numpy."""
    found, sizes, targets = {}, {}, {}
    for x in mixing.mix(spark.read.parquet(f"{tables}/documents.parquet")).collect():
        sizes.setdefault(x["source"], Counter())[x["size"]] += 1
        found.setdefault(x["source"], Counter())[x["size"]] += x["copies"]
        targets[x["source"]] = x["target"]
    for source, counts in sizes.items():
        size = np.array(sorted((n for n in counts if n), reverse=True), float)
        docs = np.array([counts[int(n)] for n in size], float)
        low, high, mean = -60.0, 60.0, (size * docs).sum() / docs.sum()
        for _ in range(200):
            z = (low + high) / 2
            got = (size * docs * 2 / (1 + np.exp(-z * size / mean))).sum()
            low, high = (z, high) if got < targets[source] else (low, z)
        rate = np.full(len(size), 2.0) if targets[source] >= 2 * (size * docs).sum() else 2 / (1 + np.exp(-low * size / mean))
        owed = 0.0
        for n, d, r in zip(size, docs, rate, strict=True):
            owed += n * d * round(r, 9)
            copies = min(max(round(owed / n), 0), 2 * d)
            owed -= copies * n
            assert abs(found[source][int(n)] - copies) <= 1


# -- nearest neighbours


def brute_nearest(rows, every, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for q in ids[ids % every == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, far)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(far[j])) for j in order]
    return out


def test_recall_and_order(spark):
    rows = [(x["vec_id"], x["embedding"]) for x in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    found = {}
    for x in queries()["op7_permutation_ann"](spark, "/root/testdata/sf0.1").orderBy("query_id", "rank").collect():
        found.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    wanted = brute_nearest(rows, 100, 10)
    assert set(found) == set(wanted) and all(len(v) == 10 and v == sorted(v, key=lambda y: (y[1], y[0])) for v in found.values())
    assert sum(len({a for a, _ in found[q]} & {a for a, _ in v}) for q, v in wanted.items()) >= 0.9 * 10 * len(wanted)
    exact = {(q, a): d for q, v in brute_nearest(rows, 100, len(rows)).items() for a, d in v}
    assert all(abs(exact[q, a] - d) < 1e-12 for q, v in found.items() for a, d in v)


def test_copies_and_unusable_vectors(spark):
    draw = np.random.default_rng(0)
    hot = draw.normal(size=8)
    rows = [(k, hot.tolist() if k % 3 == 0 else draw.normal(size=8).tolist()) for k in range(900)]
    odd = [(5000, None), (5100, [0.0] * 8), (5200, [1.0] * 7 + [None]), (5300, [1.0] * 7 + [float("nan")]), (5400, [1.0] * 7 + [float("inf")]), (5500, [1.0]), (None, [1.0] * 8), rows[3]]
    frame = spark.createDataFrame([(k, v, 0) for k, v in rows + odd], "vec_id long, embedding array<float>, rank int")
    found = {}
    for x in ann.nearest(frame, block_rows=100, least=40).orderBy("query_id", "rank").collect():
        found.setdefault(x["query_id"], []).append(x["vec_id"])
    assert set(found) == set(range(0, 900, 100)) and found[0] == [3, 6, 9, 12, 15, 18, 21, 24, 27, 30] and found[300] == [0, 3, 6, 9, 12, 15, 18, 21, 24, 27]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(x)[:3] for x in ann.nearest(few).orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 100), (100, 1, 1), (100, 2, 0)]
    assert ann.nearest(few.limit(0)).columns == ["query_id", "rank", "vec_id", "score"] and ann.nearest(few.limit(0)).count() == 0 and ann.nearest(few.where("vec_id = 1")).count() == 0


def test_checkpoints_need_a_shared_folder():
    from types import SimpleNamespace

    from tessera.llm.cutting import shared_folder

    set_: list[str] = []
    session = lambda master, named: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=set_.append), conf=SimpleNamespace(get=lambda *_: named))
    with pytest.raises(ValueError):
        shared_folder(session("spark://host:7077", None))
    shared_folder(session("spark://host:7077", "/shared/a"))
    shared_folder(session("local[2]", None))
    assert set_[0] == "/shared/a" and len(set_) == 2


def test_json_of_queries_is_plain():
    assert json.dumps(sorted(queries())).count("op") >= 10
