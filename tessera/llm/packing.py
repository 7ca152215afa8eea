"""Packing tokenised documents into fixed-length sequences by hierarchical best fit.

Level 0: every partition packs its pieces, longest first, each into the fullest bin that still takes it.
Bins that are full but for a few tokens are done.  All others go up as items: level by level groups of
partitions merge theirs by the same best fit, until one group is left or a level joins no bins any
more.  A piece's place is the sum of the offsets along its bins.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cutting import cut
from tessera.llm.words import column_bytes, slices

LENGTH = 2048
#: Partitions whose underfull bins merge in one task, and the free tokens of a bin that is done.
FAN_IN, SLACK = 8, 2
#: Items that a group of level 0 has on average, at most.
GROUP_ROWS = 200_000
END_ID = 0


#: White space that is no blank of a unit, but may stand in one run with such; in the syntax of Arrow's patterns.
OTHER_BLANK = r"[\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: Units whose ids a task remembers, and their length at most; half of them, not used for longest, go when there are more.
KEPT, KEPT_BYTES = 250_000, 64
#: Bytes of text whose units are found and looked up together.
TOGETHER = 1 << 21

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the units of documents: a unit is a run of blanks with the word that follows.

    No piece of the byte-level pattern goes on from a word into a blank, so that the ids of a text are those of its units.
    """
    blank = _BLANK[data]
    first = np.zeros(len(data), bool)
    first[1:] = blank[1:] & ~blank[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places from first[k] on, count[k] of them, of all k."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + count, count)


class Encoder:
    """The ids of texts as the tokenizers library gives them by default, without added special tokens.

    The units of many texts are made a dictionary of different ones.  The library encodes those that
    are new, joined in one string, and the lengths of the tokens tell where a unit's ids end.
    Texts with other white space than blanks, or with the string of an added token, go to the library whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        tokens = self.tokenizer.get_vocab()
        self.sizes = np.zeros(max(tokens.values()) + 1, np.int64)
        for token, k in tokens.items():
            self.sizes[k] = len(token)  # one letter for each byte
        added = [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([OTHER_BLANK, *added])
        #: What is remembered: units, their ids in one array, where they begin, how many they are, and when they were used last.
        self.units, self.flat = pa.array([], pa.large_binary()), np.zeros(0, "<u4")
        self.first, self.count, self.used, self.turn = *(np.zeros(0, np.int64) for _ in range(3)), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _made(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, one after the other, and how many each has; units that may follow on each other go to the library as one text."""
        data, offsets = column_bytes(units)
        inner = _BLANK[data[offsets[:-1]]] & ~_BLANK[data[offsets[1:] - 1]]
        count, parts = np.zeros(len(units), np.int64), []
        if inner.any():
            joined, ends = column_bytes(units.filter(pa.array(inner)))
            ids = self.whole(joined.tobytes().decode())
            count[inner] = np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), ends[1:]) + 1, prepend=0)
            parts.append((np.flatnonzero(inner), ids))
        outer = np.flatnonzero(~inner)
        if len(outer):
            found = [x.ids for x in self.tokenizer.encode_batch_fast([data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in outer.tolist()], add_special_tokens=False)]
            count[outer] = [len(x) for x in found]
            parts.append((outer, np.array([y for x in found for y in x], "<u4")))
        first = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), "<u4")
        for rows, ids in parts:
            flat[_ranges(first[rows], count[rows])] = ids
        return flat, count

    def look_up(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count) of different units, remembered or new; what is remembered stays bounded."""
        place = pc.index_in(units, self.units).fill_null(-1).to_numpy().astype(np.int64)
        self.turn += 1
        old = place >= 0
        self.used[place[old]] = self.turn
        new = units.filter(pa.array(~old))
        ids, number = self._made(new) if len(new) else (np.zeros(0, "<u4"), np.zeros(0, np.int64))
        begin = np.cumsum(number) - number
        first, count = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        first[old], count[old] = self.first[place[old]], self.count[place[old]]
        first[~old], count[~old] = len(self.flat) + begin, number
        flat = np.concatenate((self.flat, ids))
        keep = pc.less_equal(pc.binary_length(new), KEPT_BYTES).to_numpy(zero_copy_only=False)
        self.units = pa.concat_arrays([self.units, new.filter(pa.array(keep))])
        self.first, self.count = np.concatenate((self.first, len(self.flat) + begin[keep])), np.concatenate((self.count, number[keep]))
        self.used = np.concatenate((self.used, np.full(int(keep.sum()), self.turn)))
        self.flat = flat
        if len(self.units) > KEPT or len(flat) > 8 * KEPT:
            rows = np.sort(np.argsort(-self.used, kind="stable")[: KEPT // 2])
            self.units, self.used, self.flat = self.units.take(pa.array(rows)), self.used[rows], flat[_ranges(self.first[rows], self.count[rows])]
            self.count = self.count[rows]
            self.first = np.cumsum(self.count) - self.count
        return flat, first, count

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all `texts`, each with the end's, in one array, and the n + 1 places where texts begin."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = np.flatnonzero(pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False))
        data, offsets = column_bytes(texts)
        starts = unit_starts(data, offsets)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]).dictionary_encode()
        code = units.indices.to_numpy()
        flat, first, count = self.look_up(units.dictionary)
        first, count = first[code], count[code]
        # Each text's units, and the end after its last one as a unit of its own.
        before = np.searchsorted(starts, offsets[1:])
        first, count = np.insert(first, before, len(flat)), np.insert(count, before, 1)
        ids = np.append(flat, np.uint32(END_ID))[_ranges(first, count)]
        bounds = np.append(0, np.cumsum(count)[before + np.arange(len(texts))])
        if not len(odd):
            return ids, bounds
        parts = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in odd.tolist():
            parts[k] = np.append(self.whole(texts[k].as_py()), np.uint32(END_ID))
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts]))


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuts(count: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `count` ids: whole ones of `length`, and the rest in front."""
    head = count % length or length
    return [(0, min(head, count))] + [(a, length) for a in range(head, count, length)] if count else []


def _pieces(vocabulary: str, length: int, with_ids: bool):
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "ids")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches):
        encoder = _encoder(vocabulary)
        for batch in batches:
            for a, b in slices(column_bytes(batch.column(1))[1], TOGETHER):
                ids, bounds = encoder.batch(batch.column(1).slice(a, b - a))
                rows = []
                for doc, first, end in zip(batch.column(0).slice(a, b - a).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    for k, (at, n) in enumerate(cuts(end - first, length)):
                        data = ids[first + at : first + at + n].tobytes()
                        rows.append((doc, k, at, n, zlib.crc32(data), data if with_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    return run


def pieces(docs: DataFrame, *, length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each row of `docs` (doc_id, text, ...).

    A document is its ids and then id 0; a null text is empty.  Only longer documents are cut, into
    pieces of `length` ids, of which the first may be shorter.  `ids` are little-endian 32-bit numbers.
    """
    vocabulary = vocabulary or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = docs.mapInArrow(_pieces(vocabulary, length, with_ids), "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return made if with_ids else made.drop("ids")


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, and the fill of each bin: longest first, into the fullest bin that takes it.

    Bins stand in stacks by free room; the rooms that have a bin are kept sorted, at most `length` of them.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    stacks: list[list[int]] = [[] for _ in range(length + 1)]
    rooms: list[int] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            chosen = stacks[room].pop()
            if not stacks[room]:
                rooms.pop(at)
        else:
            room, chosen = length, len(fills)
            fills.append(0)
        bins[k], offsets[k] = chosen, fills[chosen]
        fills[chosen] += size
        left = room - size
        if left:
            if not stacks[left]:
                insort(rooms, left)
            stacks[left].append(chosen)
    return bins, offsets, fills


def _packed(length: int):
    """One partition's items (item, size, group, id) into bins named (task, number); `up` tells whether the bin goes on."""

    def run(frames):
        held = [x for x in frames if len(x)]  # a few groups that share a partition
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        for task, part in rows.groupby("task", sort=True):
            part = part.sort_values(["size", "item"], kind="stable")
            bins, offsets, fills = best_fit(part["size"].to_numpy(), length)
            fills = np.array(fills)
            up = length - fills > SLACK
            yield pd.DataFrame({"item": part["item"].to_numpy(), "bin": int(task) * (1 << 24) + bins, "offset": offsets, "fill": fills[bins], "up": up[bins], "task": int(task)})

    return run


_LEVEL = "item long, bin long, offset long, fill long, up boolean, task long"


def pack(items: DataFrame, *, length: int = LENGTH, tasks: int | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(item, sequence_id, offset) for items (item, size) with sizes from 1 to `length`; items are unique.

    `tasks` is the number of groups of level 0, by default the number of shuffle partitions, or
    as many more as keep groups at `group_rows` items.  Every bin with more than `SLACK` free tokens goes up;
    groups are dealt anew, at most `FAN_IN` into one and no more than `group_rows` bins for each, until one group
    has packed all that is left or a level joins no bins any more.
    """
    tasks = tasks or max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // group_rows))
    dealt = items.select("item", "size", F.pmod(F.xxhash64("item"), F.lit(tasks)).alias("task"))
    level = cut(dealt.repartition(tasks, "task").mapInPandas(_packed(length), _LEVEL))
    placed = level.select("item", F.col("bin").alias("sequence_id"), "offset", "up")
    moves = None
    depth = 0
    while tasks > 1:
        depth += 1
        rising = level.where("up").groupBy(F.col("bin").alias("item"), "task").agg(F.max("fill").alias("size"))
        rising = cut(rising)
        count = rising.count()
        tasks = max(-(-tasks // FAN_IN), -(-count // group_rows))
        rising = rising.select("item", "size", F.pmod(F.xxhash64("item", F.lit(depth)), F.lit(tasks)).alias("task"))
        # Bins of one level are told from those of others by the level's part of their number.
        level = cut(rising.repartition(tasks, "task").mapInPandas(_packed(length), _LEVEL).withColumn("bin", F.col("bin") + F.lit(depth << 56)))
        step = level.select(F.col("item").alias("from"), F.col("bin").alias("to"), F.col("offset").alias("by"))
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("from").alias("to"), F.col("to").alias("then"), F.col("by").alias("more"))
            moves = cut(moves.join(later, "to", "left").select("from", F.coalesce("then", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by")))
        if level.select("bin").distinct().count() == count:
            break
    if moves is None:
        return placed.drop("up")
    still, moved = placed.where("not up").drop("up"), placed.where("up").drop("up")
    moved = moved.join(moves.withColumnRenamed("from", "sequence_id"), "sequence_id").select("item", F.col("to").alias("sequence_id"), (F.col("offset") + F.col("by")).alias("offset"))
    return still.unionByName(moved)


def pack_documents(docs: DataFrame, *, length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece of `docs` with its place.

    Null and empty texts are documents of one id.  Rows may repeat and doc_id may be null: each
    row's pieces have their own places.  Other columns are ignored; an empty table gives no piece.
    """
    made = pieces(docs, length=length, vocabulary=vocabulary, with_ids=with_ids)
    made = cut(made.withColumn("item", F.monotonically_increasing_id()))
    whole = made.where(F.col("length") == length).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = pack(made.where(F.col("length") < length).select("item", F.col("length").alias("size")), length=length)
    return made.join(places, "item").select(*whole.columns).unionByName(whole).drop("item")
