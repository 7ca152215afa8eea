import os
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import mpeg
from tessera.llm.words import column_bytes, ngrams, slices, word_hashes, word_spans, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbZé \u0085ß \t\n\r\x0b\x0c.ſ😀"), max_size=30)), max_size=8)


@given(TEXTS)
@settings(max_examples=150, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    starts, ends, first = word_spans(data, offsets)
    wanted = [[x.encode() for x in WORD.findall(t or "")] for t in texts]
    found = [[data[a:b].tobytes() for a, b in zip(starts[lo:hi], ends[lo:hi], strict=True)] for lo, hi in zip(first[:-1], first[1:], strict=True)]
    assert found == wanted and [words_of(t) for t in texts] == wanted
    lower = [w.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")) for ws in wanted for w in ws]
    hashes = word_hashes(data, starts, ends, lower=True).tolist()
    assert len({*zip(lower, hashes, strict=True)}) == len({*lower}) == len({*hashes})
    plain = [w for ws in wanted for w in ws]
    for n in (1, 2, 3, 5, 20):
        grams = ngrams(word_hashes(data, starts, ends, lower=False), n).tolist()
        sequences = [tuple(plain[k : k + n]) for k in range(len(plain) - n + 1)]
        assert len(grams) == len(sequences) and len({*zip(sequences, grams, strict=True)}) == len({*sequences}) == len({*grams})


def test_sliced_columns_and_long_words():
    column = pa.array(["x", "a b", None, "c" * 3_000_000 + " d"]).slice(1)
    data, offsets = column_bytes(column)
    starts, ends, first = word_spans(data, offsets)
    assert first.tolist() == [0, 2, 2, 4] and len(word_hashes(data, starts, ends, lower=False)) == 4
    assert list(slices(np.array([0, 5, 5, 100, 101]), 10)) == [(0, 2), (2, 3), (3, 4)]


@given(st.binary(max_size=2000))
@settings(max_examples=80, deadline=None)
def test_streams_give_back_what_they_hold(data):
    found = mpeg.read_stream(mpeg.write_stream(data))
    frames = max(1, -(-len(data) // 576))
    assert found["payload"] == mpeg.padded(data) and found["told"] == len(data) and len(found["payload"]) == 576 * frames
    assert found["table_frames"] == frames == len(found["offsets"]) and found["samples"] == 1152 * frames and found["hertz"] == 48000
    assert found["checksums_bad"] == 0 and found["checksums_good"] == frames + 1 and found["found_again"] == 0


def test_headers_are_found_again_and_checksums_verified():
    data = os.urandom(576 * 6)
    stream = mpeg.write_stream(data)
    start = len(stream) - 6 * 672
    broken = stream[: start + 672] + b"\xff\xfbnoise" + stream[start + 672 :]
    found = mpeg.read_stream(broken)
    assert found["found_again"] == 1 and found["payload"] == data and found["offsets"][1] == start + 672 + 7
    flipped = bytearray(stream)
    flipped[start + 10] ^= 1
    assert mpeg.read_stream(bytes(flipped))["checksums_bad"] == 1
    tagged = stream + b"TAG" + bytes(125)
    assert mpeg.read_stream(tagged)["payload"] == data
    assert mpeg.read_stream(mpeg.write_stream(b"TAG" * 192))["payload"] == b"TAG" * 192
    for nothing in (b"", b"\xff", b"ID3", b"plain text, no audio at all" * 50):
        assert mpeg.read_stream(nothing)["payload"] == b"" and mpeg.read_stream(nothing)["offsets"] == []


def test_mixed_frames():
    """Other layers, rates and padding: lengths and durations by the headers."""
    frames = []
    for header in (b"\xff\xfb\x90\xc0", b"\xff\xfb\x92\xc0", b"\xff\xfd\x84\xc0", b"\xff\xf3\x80\xc0"):
        kind = header[1] << 8 | header[2]
        frames.append(header + bytes(int(mpeg._LENGTH[kind]) - 4))
    found = mpeg.read_stream(b"".join(frames))
    assert [len(x) for x in frames] == [417, 418, 384, 208] or [len(x) for x in frames][:2] == [417, 418]
    assert len(found["offsets"]) == 4 and found["samples"] == 1152 * 3 + 576


def test_durations_and_offsets_are_exact():
    assert [mpeg.seek_runs(x) for x in ([], [5], [10, 20, 30, 37], [1, 2, 4, 8, 12, 16])] == ["", "5+0*1", "10+10*3,37+0*1", "1+1*2,4+0*1,8+4*3"]
    for size in (0, 576, 5000, 200_000):
        stream = mpeg.write_stream(os.urandom(size))
        found = mpeg.read_stream(stream)
        assert found["ticks"] * 48_000 == found["samples"] * mpeg.TICKS
        again = [a + k * step for a, step, n in (map(int, re.split(r"[+*]", x)) for x in found["seek"].split(",")) for k in range(n)]
        assert again == found["offsets"] and all(stream[x : x + 4] == mpeg._HEADER for x in again)
        count, start = len(again), len(stream) - found["table_bytes"]
        assert found["table"] == "Xing" and found["table_quality"] == 100 and found["table_bytes"] == (count + 1) * 672
        wanted = [672 * (1 + k * count / 100) for k in range(100)]
        assert len(found["seek_points"]) == 100 and all(abs(a - b) <= found["table_bytes"] / 256 + 672 for a, b in zip(found["seek_points"], wanted, strict=True)) and start > 0


def test_vbri_tables_and_changing_rates():
    frame = b"\xff\xfb\x90\xc0" + bytes(413)
    table = b"VBRI" + b"\x00\x01\x00\x00\x00\x4b" + (417 * 4).to_bytes(4, "big") + (3).to_bytes(4, "big") + b"".join(x.to_bytes(2, "big") for x in (3, 2, 1, 1)) + bytes([100, 101, 102])
    first = (frame[:4] + bytes(32) + table).ljust(417, b"\x00")
    found = mpeg.read_stream(first + frame * 3)
    assert (found["table"], found["table_frames"], found["table_bytes"], found["table_quality"], found["seek_points"]) == ("VBRI", 3, 417 * 4, 75, [200, 402, 606])
    assert len(found["offsets"]) == 3 and found["ticks"] == 3 * 1152 * mpeg.TICKS // 44_100
    slow = b"\xff\xf3\x84\xc0" + bytes(int(mpeg._LENGTH[0xF384]) - 4)  # 24 kHz
    assert mpeg.read_stream(frame * 2 + slow * 2)["ticks"] == 2 * 1152 * mpeg.TICKS // 44_100 + 2 * 576 * mpeg.TICKS // 24_000
    cut = first[: 36 + 26 + 2]
    assert mpeg.read_table(cut, 0, 21)["seek_points"] == [200, 402] and mpeg.read_table(b"", 0, 21) is None


def test_null_media_and_long_texts(spark, monkeypatch):
    rows = mpeg.read(spark.createDataFrame([(1, None), (2, bytearray(b""))], "doc_id long, media binary")).collect()
    assert all(x["payload"] == b"" and x["offsets"] == [] and x["ticks"] == 0 and x["n_bytes"] is None and x["table"] is None for x in rows) and len(rows) == 2
    long = "ab " * 4_000_000
    some = mpeg.digests(mpeg.read(mpeg.store(spark.createDataFrame([(1, long), (2, "x"), (3, long)], "doc_id long, text string")))).collect()
    assert [x["n_bytes"] for x in sorted(some)] == [12_000_000, 1, 12_000_000] and len({x["payload_sha256"] for x in some}) == 2
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a" * 3000, None, "b" * 10, "c" * 3000])], ["doc_id", "text"])
    whole = pa.Table.from_batches(mpeg._stored([batch]))
    monkeypatch.setattr(mpeg, "BATCH_BYTES", 1000)
    parts = list(mpeg._stored([batch]))
    assert [len(x) for x in parts] == [1, 2, 1] and pa.Table.from_batches(parts).to_pydict() == whole.to_pydict()
    assert sum(len(x) for x in mpeg._read(parts)) == 4


@pytest.mark.parametrize("texts", [[("a", 1), (None, 2), ("", 3), ("a", 4)]])
def test_store_and_read_as_columns(spark, texts):
    frame = spark.createDataFrame([(k, t, "x") for t, k in texts] + [(None, "é" * 1000, "y")], "doc_id long, text string, media string")
    rows = {x["doc_id"]: x for x in mpeg.digests(mpeg.read(mpeg.store(frame))).collect()}
    assert rows[1].asDict() | {"doc_id": 0} == rows[4].asDict() | {"doc_id": 0} and rows[2]["media_sha256"] == rows[3]["media_sha256"]
    assert rows[2]["n_bytes"] == 0 and rows[2]["payload_bytes"] == 576 and rows[None]["n_bytes"] == 2000 and rows[2]["tail_crc32"] == mpeg.crc32(b"\xff" * 32)
    assert mpeg.read(mpeg.store(frame.limit(0))).count() == 0
