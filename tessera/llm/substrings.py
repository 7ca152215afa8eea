"""Removal of repeated word windows by relative Lempel-Ziv factors.

Every document is factored against all text that stands earlier (smaller doc_id, or earlier in the
same document), which is indexed by *reference blocks*.  Three jobs, each of which moves a row for a block instead of one for a window:

1. *Index.*  Each window of `window` words elects the smallest `anchor`-word hash inside it.  Consecutive
   windows with the same anchor are a reference block.  Equal windows elect equal anchors at equal
   places, so a window can repeat only in blocks whose anchor occurs twice.  A task sends an
   anchor at most once, and says whether it has seen it twice; further places of an anchor that a task has
   seen twice are candidates by themselves, so that no anchor is a hot key.
2. *Factors.*  A candidate block that equals an earlier reference block is one factor, whatever its length.  Where the
   blocks of an anchor differ - at the ends of factors - each window is looked up in the reference, and a factor is a run
   of windows that are found: what a greedy parse gives that looks up the windows at each factor's boundary.  Hot anchors'
   blocks are dealt by window.
3. *Removal.*  Factors that touch are joined across blocks; the words of each go.

Words, blocks and windows are compared by 64-bit hashes, not word by word: of n different windows about
n^2 / 2^65 pairs have equal hashes by accident, one in ten billion windows.

Texts are dealt by document once; both joins with them share that exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cutting import cut
from tessera.llm.words import column_bytes, mix, ngrams, pair, slices, word_hashes, word_spans

_U = np.uint64
WINDOW, ANCHOR = 20, 5
#: An anchor is hot if it holds more than this part of all blocks; so there are fewer than 1 / HOT of them, which bounds what is sent to the tasks.
HOT = 1 / 4096
#: Documents, about, in which hot anchors are looked for.  The sample decides only how blocks are dealt, no result.
HOT_SAMPLE = 20_000
_STEP = _U(0x9E3779B97F4A7C15)


def _first_lowest(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of its smallest one, the first of equals."""
    places, size = np.arange(len(values)), 1
    while size * 2 <= width:
        a, b = places[:-size], places[size:]
        places = np.where(values[a] <= values[b], a, b)
        size *= 2
    if size < width:
        shift = width - size
        a, b = places[:-shift], places[shift:]
        places = np.where(values[a] <= values[b], a, b)
    return places


def blocks(hashes: np.ndarray, first: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """The reference blocks of documents whose words start at first[k] of `hashes`.

    Arrays by block: document, first window's place in the document, number of windows, anchor hash.
    """
    count = len(hashes) - window + 1
    if count <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
    grams = ngrams(hashes, anchor)
    chosen = _first_lowest(grams, window - anchor + 1)
    document = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = np.arange(count)
    whole = document[:count] == document[window - 1 : window - 1 + count]
    start = start[whole]
    chosen, document = chosen[start], document[start]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
    cuts = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (document[1:] != document[:-1]))))
    return document[cuts], start[cuts] - first[document[cuts]], np.diff(np.append(cuts, len(start))), grams[chosen[cuts]]


def _hashed(data: np.ndarray, offsets: np.ndarray):
    """(a, b, word hashes, first word of each) of slices of the documents."""
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a])
        yield a, b, word_hashes(part, starts, ends, lower=False), first


def _anchors(window: int, anchor: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).to_numpy()
            found = [(ids[a + d], s, n, g) for a, _, h, f in _hashed(*column_bytes(batch.column(1))) for d, s, n, g in [blocks(h, f, window, anchor)]]
            if not found:
                continue
            doc, start, size, key = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(key, kind="stable")
            doc, start, size, key = doc[order], start[order], size[order], key[order]
            new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            again = np.zeros(len(key), bool)
            again[:-1] = ~new[1:]
            sure = again | ~new
            # A further place of an anchor needs no company: it goes anywhere.
            key = np.where(new, key, pair(key, mix(doc.view(_U) * _U(3) + start.astype(_U))))
            packed = (start.astype(np.int64) << 9) | (size.astype(np.int64) << 1) | sure
            for a in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)]) for x in (key.view(np.int64), doc, packed)], ["key", "doc", "block"])

    return run


def _runs_of_keys(batches):
    """Batches of a partition that is sorted by its first column, cut so that no key goes on in the next one; one key's rows are held at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if last or held and held[0].column(0)[0].as_py() != key[0]:
            head = [*held, batch.slice(0, last)] if last else held
            yield pa.Table.from_batches(head).combine_chunks()
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _repeated(batches):
    for part in _runs_of_keys(batches):
        key, doc, block = (part.column(k).to_numpy() for k in range(3))
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        chosen = twice | (block & 1 == 1)
        yield pa.RecordBatch.from_arrays([pa.array(doc[chosen]), pa.array(block[chosen] >> 1)], ["doc", "block"])


def places(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k], first[k] + 1, ... of count[k] places, of all k."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


def _listed(key: np.ndarray, doc: np.ndarray, start: np.ndarray, size: np.ndarray, sent: np.ndarray, wins: np.ndarray) -> pa.RecordBatch:
    """Rows of which each has the next sent[k] of `wins`."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sent))), pa.int32()), pa.array(wins.view(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(doc), pa.array(start), pa.array(size), lists], ["key", "doc", "start", "size", "wins"])


def _firsts(value: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the earliest of each value, and of the later ones.  One doc_id and place may stand in two rows: that is no later place."""
    order = np.lexsort((start, doc, value))
    value, doc, start = value[order], doc[order], start[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    tie = np.zeros(len(value), bool)
    tie[1:] = (doc[1:] == doc[:-1]) & (start[1:] == start[:-1]) & ~new[1:]
    return order[new], order[~new & ~tie]


def _block_rows(window: int, anchor: int, hot: np.ndarray):
    """Candidate blocks with their windows' hashes, one of each whole hash; of the others at once that they are repeats.

    Of hot anchors the windows go each by itself, and again one of each.
    """

    def run(batches):
        for batch in batches:
            ids, wanted = batch.column(0).cast(pa.int64()).to_numpy(), batch.column(2)
            listed, ends = wanted.flatten().to_numpy(), wanted.offsets.to_numpy()
            ends = ends - ends[0]
            doc, start, size, whole, key, wins = [], [], [], [], [], []
            for a, b, hashes, first in _hashed(*column_bytes(batch.column(1))):
                take = listed[ends[a] : ends[b]]
                owner = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1]))
                n, s = take & 255, take >> 8
                at = first[owner] + s
                fits = at + n + window - 1 <= first[owner + 1]  # rows of one doc_id may differ
                owner, n, s, at = owner[fits], n[fits], s[fits], at[fits]
                if not len(at):
                    continue
                power = np.cumprod(np.full(len(hashes) + 1, _STEP, _U))
                sums = np.concatenate((np.zeros(1, _U), np.cumsum(hashes * power[:-1])))
                inverse = np.cumprod(np.full(len(hashes) + 1, _U(pow(int(_STEP), -1, 1 << 64)), _U))
                whole.append(mix((sums[at + n + window - 1] - sums[at]) * inverse[at] + n.astype(_U)))
                grams, windows = ngrams(hashes, anchor), ngrams(hashes, window)
                wins.append(windows[places(at, n)])
                # the block's anchor again: the smallest one in its first window, as of all its windows
                key.append(np.min(np.lib.stride_tricks.sliding_window_view(grams, window - anchor + 1)[at], axis=1))
                doc.append(ids[a + owner])
                start.append(s)
                size.append(n)
            if not doc:
                continue
            doc, start, size, whole, key, wins = (np.concatenate(x) for x in (doc, start, size, whole, key, wins))
            at = np.cumsum(size) - size
            first, late = _firsts(whole, doc, start)
            ones = np.ones(len(late), np.int64) * size[late]
            found = [(doc[late], start[late], ones)]
            wide = np.isin(key[first], hot)
            for a in range(0, int((~wide).sum()), 1 << 15):
                some = first[~wide][a : a + (1 << 15)]
                yield _listed(key[some], doc[some], start[some], size[some], size[some], wins[places(at[some], size[some])])
            some = first[wide]
            if len(some):
                row = np.repeat(some, size[some])
                win, d = wins[places(at[some], size[some])], doc[row]
                p = start[row] + places(np.zeros(len(some), np.int64), size[some])
                once, again = _firsts(win, d, p)
                found.append((d[again], p[again], np.ones(len(again), np.int64)))
                for a in range(0, len(once), 1 << 16):
                    part = once[a : a + (1 << 16)]
                    one = np.ones(len(part), np.int64)
                    yield _listed(mix(win[part]), d[part], p[part], one, one, win[part])
            d, s, n = _runs(*(np.concatenate(x) for x in zip(*found, strict=True)))
            if len(d):
                yield _listed(mix(d.view(_U) * _U(3) + s.astype(_U)), d, s, n, np.zeros(len(d), np.int64), np.zeros(0, _U))

    return run


def _runs(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, start, size) with ranges that follow on each other in a document as one."""
    if not len(doc):
        return doc, start, size
    order = np.lexsort((start, doc))
    doc, start, size = doc[order], start[order], size[order]
    cuts = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != (start + size)[:-1]))))
    return doc[cuts], start[cuts], np.add.reduceat(size, cuts)


def _earlier(batches):
    """(doc, start, size): factors of windows that the reference blocks of their key have earlier."""
    for part in _runs_of_keys(batches):
        key, doc, start, size = (part.column(k).to_numpy() for k in range(4))
        lists = part.column(4).chunk(0) if isinstance(part.column(4), pa.ChunkedArray) else part.column(4)
        sent, wins = np.diff(lists.offsets.to_numpy()).astype(np.int64), lists.flatten().to_numpy()
        found = [(doc[sent == 0], start[sent == 0], size[sent == 0])]
        at = np.cumsum(sent) - sent
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        rows = np.flatnonzero(twice & (sent > 0))
        if len(rows):
            row = np.repeat(rows, sent[rows])
            win, d = wins[places(at[rows], sent[rows])], doc[row]
            p = start[row] + places(np.zeros(len(rows), np.int64), sent[rows])
            _, late = _firsts(win, d, p)
            found.append((d[late], p[late], np.ones(len(late), np.int64)))
        d, s, n = _runs(*(np.concatenate(x) for x in zip(*found, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(n)], ["doc", "start", "size"])


def hot_anchors(docs: DataFrame, *, window: int, anchor: int) -> np.ndarray:
    """Hashes of the anchors that hold more than `HOT` of the blocks of about `HOT_SAMPLE` documents: fewer than 1 / HOT, in order."""

    def counted(batches):
        for batch in batches:
            keys = [g for _, _, h, f in _hashed(*column_bytes(batch.column(1))) for *_, g in [blocks(h, f, window, anchor)]]
            key, count = np.unique(np.concatenate(keys) if keys else np.zeros(0, _U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(count)], ["key", "n"])

    rows = docs.count()
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(-(-rows // HOT_SAMPLE))) == 0) if rows > HOT_SAMPLE else docs
    counts = cut(sample.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([x["key"] for x in counts.where(F.col("n") > max(total * HOT, 64)).collect()], np.int64)).view(_U)


def repeated_windows(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR, dealt: DataFrame | None = None) -> DataFrame:
    """(doc, start, size): ranges of windows of `docs` (doc_id, text) that stand earlier too; a document may have several that touch.

    `dealt` are the same rows, dealt by doc_id.
    """
    if not 0 < anchor <= window or window - anchor > 200:
        raise ValueError("0 < anchor <= window <= anchor + 200 is needed")
    docs = docs.where("doc_id is not null")
    hot = hot_anchors(docs, window=window, anchor=anchor)
    found = docs.mapInArrow(_anchors(window, anchor), "key long, doc long, block long").repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "doc long, block long")
    wanted = found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("block").alias("blocks"))
    texts = (docs if dealt is None else dealt).join(wanted, "doc_id").select("doc_id", "text", "blocks")
    rows = texts.mapInArrow(_block_rows(window, anchor, hot), "key long, doc long, start long, size long, wins array<long>")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_earlier, "doc long, start long, size long")


def covered_words(count: int, starts: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """Which of `count` words the repeated windows from starts[k] to starts[k] + sizes[k] - 1 cover."""
    edge = np.zeros(count + 1, np.int64)
    sizes = np.minimum(sizes, count - window + 1 - starts)  # rows of one doc_id may differ
    starts, sizes = starts[sizes > 0], sizes[sizes > 0]
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + sizes + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


_FACTORS = "array<struct<start:long,end:long>>"
_KEPT = f"doc_id long, n_words long, factors {_FACTORS}, kept binary"


def _kept(window: int):
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            counts, factors, kept = [], [], []
            for a, b, blocks_ in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column(2).to_pylist(), strict=True):
                words = data[a:b].tobytes().split()
                counts.append(len(words))
                spans = []
                if blocks_:
                    gone = covered_words(len(words), np.array([x["start"] for x in blocks_]), np.array([x["size"] for x in blocks_]), window)
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    spans = [{"start": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()]
                    words = [x for x, y in zip(words, gone.tolist(), strict=True) if not y]
                factors.append(spans)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(factors, kinds), pa.array(kept, pa.binary())], ["doc_id", "n_words", "factors", "kept"])

    return run


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, n_words, factors, kept) for each row of `docs` (doc_id, text, ...).

    `factors` are maximal spans of words (start, end exclusive) that are covered by windows of `window`
    words that also start earlier; `kept` is UTF-8 of the other words, joined by one space.  Windows are
    judged on the input.  Null and empty texts have no words; texts shorter than a window keep
    all.  Rows with a null doc_id are compared with nothing and keep all.  Rows that repeat
    doc_id and text are one document, each row with its result; with another text under
    one doc_id, what is found at a place in either goes for both.  Other columns are ignored.
    """
    # Casts only where they are needed: a name for a column that is one already would keep the joins from sharing their exchange.
    kinds = dict(docs.dtypes)
    docs = docs.select(*(F.col(x) if kinds[x] == kind else F.col(x).cast(kind).alias(x) for x, kind in (("doc_id", "bigint"), ("text", "string"))))
    known = docs.where("doc_id is not null")
    dealt = known.repartition("doc_id")
    found = repeated_windows(known, window=window, anchor=anchor, dealt=dealt)
    found = found.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("start", "size")).alias("windows"))
    rows = dealt.join(found, "doc_id", "left").select("doc_id", "text", "windows")
    none = docs.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("array<struct<start:long,size:long>>").alias("windows"))
    return rows.unionByName(none).mapInArrow(_kept(window), _KEPT)


def digests(kept: DataFrame) -> DataFrame:
    """Counts and the kept text's sha256, from remove_repeats()."""
    removed = F.aggregate("factors", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return kept.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def plain_sha256(words: list[bytes]) -> str:
    """What digests() gives for these words, for tests."""
    return hashlib.sha256(b" ".join(words)).hexdigest()
