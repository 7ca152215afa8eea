"""Exact n-gram Jaccard join in the metric space of shingle sets.

The Jaccard distance d = 1 - |x & y| / |x | y| is a metric.  The join finds all pairs of
documents within the radius r = 1 - t as a recursive metric-space join:

1. *Projection pivots.*  The hash space of shingles is dealt into g ranges, and the part of a set
   in a range is a point of that range's own subspace.  Every distinct part is a pivot, and its
   region holds the documents at distance 0 from it there.  A pair within r differs in at
   most delta = floor((1 - t) / t * smaller size) shingles, hence in at most delta ranges, so
   that among the delta + l largest parts of either set they share l regions (the same bound that
   prefix filters use), with l = 1 + delta / `SPARE`; a document in fewer shared regions than
   the smallest set that it may be linked with needs can't be linked.  g depends on the size class
   [2^c, 2^(c+1)); the sizes of a linked pair are within a factor t, so a document near a
   class's lower end is also placed in the class below: the window of the size coordinate.
2. *Document pivots.*  A region's smallest document is its pivot, and regions with the same pivot
   merge.  Every member's exact distance to pivots is computed.  Members take the nearest
   pivot as home (Voronoi regions), and go to each other pivot p with
   d(x, p) <= d(x, home) + 2r as well (triangle inequality: a partner at home with p can be
   no nearer to x than r).  Members within r of a pivot are linked to it at once, so two of them
   need no comparison of their own for components.
3. *Recursion.*  Of each Voronoi region only members farther than r from its pivot, and those
   within r of such a one along the distance to the pivot, go on, with new pivots, until
   none are left.  Where the windows of several pivots hold more than `WIDEST` times the members
   (all are about as far from each other), or few members are left, those are compared in blocks.
   Regions of up to `region_rows` members are finished inside a task; larger ones
   are dealt over tasks, each of which gets the same pivots.
4. *Rarest shingles.*  A region that is too large for a task and keeps more than `PARTED` of the members of
   the one that it comes from is not parted by pivots (many texts that share a line and are otherwise unlike).
   Its documents meet again where they share one of their rarest shingles, as many as linked sets can't
   all miss.  What is still too large for a task is compared as pairs of shares, a pair in each task, but for
   pairs of shares of the largest component that links have made so far.

Equal sets are one node from the start, so that large groups of copies cost one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.cutting import cut
from tessera.llm.graph import connected_components
from tessera.llm.words import column_bytes, mix, ngrams, pair, slices, word_hashes, word_spans

_U = np.uint64
#: Parts that may differ, for each further region that linked documents share.
SPARE = 16
#: Members of a region that one task takes, and their shingles.
REGION_ROWS, REGION_SHINGLES = 2048, 1 << 23
#: Part of a region's members up to which a region of it that is too large for a task is parted by pivots again.
PARTED = 0.5
#: Ranges for each range that may differ.
RANGES = 1.5
#: Pivots at once in regions of more members than this.
FEW, PIVOTS = 64, 8
#: Parts of a region in which its members meet its size.
PARTS = 32
#: Members and shingles at a time, in comparing what pivots don't part.
BLOCK = 512
#: Shingles that a task sends at a time.
SENT_SHINGLES = 1 << 20
#: Members of the Voronoi regions with their windows, for each member, up to which they are taken.
WIDEST = 1.5


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int, *, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document; a document of fewer words has its whole sequence."""
    for a, b in slices(offsets):
        part = data[offsets[a] : offsets[b]]
        starts, ends, first = word_spans(part, offsets[a : b + 1] - offsets[a])
        hashes = word_hashes(part, starts, ends, lower=lower)
        grams = ngrams(hashes, n)
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield pair(ngrams(hashes[lo:hi], hi - lo), np.full(1, hi - lo, _U))
            else:
                yield np.zeros(0, _U)


def _may_differ(size: int, num: int, den: int) -> int:
    """Shingles in which a set of this size and a linked set that is no smaller differ at most."""
    return size * (den - num) // num


def _class_tokens(values: np.ndarray, scrambled: np.ndarray, kind: int, num: int, den: int) -> np.ndarray:
    """The region keys of a set in size class `kind`: its delta + l largest parts, ties by hash."""
    most = (2 << kind) - 1
    differ = _may_differ(min(len(values), most), num, den)
    take = differ + 1 + differ // SPARE
    ranges = int(RANGES * (_may_differ(most, num, den) + 1))
    where = (values >> _U(32)) * _U(ranges) >> _U(32)
    cuts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    counts = np.diff(np.append(cuts, len(values)))
    names = pair(where[cuts] + _U(kind << 40), np.add.reduceat(scrambled, cuts))
    if len(cuts) < take:  # empty parts come last
        empty = np.setdiff1d(np.arange(ranges, dtype=_U), where[cuts])
        rest = np.sort(pair(empty + _U(kind << 40), np.zeros(len(empty), _U)))
        return np.concatenate((names, rest[: take - len(cuts)]))
    return names[np.lexsort((names, -counts))[:take]]


def region_keys(values: np.ndarray, num: int, den: int) -> np.ndarray:
    """The keys of all first-level regions that a set of shingles belongs to."""
    size = len(values)
    if not size or not _may_differ(size, num, den):
        return np.zeros(0, _U)
    kind, scrambled = size.bit_length() - 1, mix(values + _U(0x632BE59BD9B4E019))
    keys = [_class_tokens(values, scrambled, kind, num, den)]
    if num * size < den << kind and _may_differ((1 << kind) - 1, num, den):
        keys.append(_class_tokens(values, scrambled, kind - 1, num, den))
    return np.concatenate(keys)


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, _U).view(np.int64))


def _signatures(n: int):
    def run(batches):
        for batch in batches:
            sizes, one, two = [], [], []
            for values in shingle_sets(*column_bytes(batch.column(1)), n):
                sizes.append(len(values))
                one.append(int(np.add.reduce(mix(values + _U(1)))))
                two.append(int(np.add.reduce(mix(values + _U(2)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), _signed(one), _signed(two)], ["doc_id", "n_shingles", "h1", "h2"])

    return run


def _region_keys(n: int, num: int, den: int):
    """(key, doc, kind) of a batch of documents: 0 for a key of one of them, 1 for the first document of a key of several, 2 for the others."""

    def run(batches):
        for batch in batches:
            sets = [region_keys(values, num, den) for values in shingle_sets(*column_bytes(batch.column(1)), n)]
            keys = np.concatenate([*sets, np.zeros(0, _U)])
            docs = np.repeat(batch.column(0).to_numpy(), [len(x) for x in sets])
            order = np.argsort(keys, kind="stable")
            keys, docs = keys[order], docs[order]
            again = np.concatenate(([False], keys[1:] == keys[:-1]))[: len(keys)]
            kind = np.where(again, 2, np.concatenate((again[1:], [False]))[: len(keys)]).astype(np.int8)
            for a in range(0, len(keys), 1 << 16):
                some = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([_signed(keys[some]), pa.array(docs[some]), pa.array(kind[some])], ["key", "doc", "kind"])

    return run


def _shared_keys(batches):
    """(key, doc) of the rows of a partition whose key stands in several rows, or stood so in its batch."""
    held = [[batch.column(k).to_numpy() for k in range(3)] for batch in batches]
    if not held:
        return
    key, doc, kind = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(key)
    key, doc, kind = key[order], doc[order], kind[order]
    same = key[1:] == key[:-1]
    chosen = kind > 0
    chosen[1:] |= same
    chosen[:-1] |= same
    yield pa.RecordBatch.from_arrays([pa.array(key[chosen]), pa.array(doc[chosen])], ["key", "doc"])


def _member_sets(n: int):
    """A document's set once for each of its places, about `SENT_SHINGLES` at a time."""

    def packed(rows: list[tuple], sets: list[np.ndarray]) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), _signed(np.concatenate(sets)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, lists], ["doc", "region", "share", "pivot", "whole", "values"])

    def run(batches):
        for batch in batches:
            rows, sets, held = [], [], 0
            for doc, values, places in zip(batch.column(0).to_pylist(), shingle_sets(*column_bytes(batch.column(1)), n), batch.column(2).to_pylist(), strict=True):
                for place in places:
                    rows.append((doc, place["region"], place["share"], place["pivot"], place["whole"]))
                    sets.append(values)
                    held += len(values)
                    if held >= SENT_SHINGLES:
                        yield packed(rows, sets)
                        rows, sets, held = [], [], 0
            if rows:
                yield packed(rows, sets)

    return run


class Region:
    """The sets of one region, and exact distances between them."""

    def __init__(self, docs: np.ndarray, sets: list[np.ndarray], num: int, den: int):
        self.docs, self.num, self.den = docs, num, den
        self.sizes = np.array([len(x) for x in sets])
        self.firsts = np.cumsum(self.sizes) - self.sizes
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.width = int(self.ids.max()) + 1
        self.radius = 1 - num / den
        self.root = np.arange(len(docs))

    def common(self, marks: np.ndarray) -> np.ndarray:
        return np.add.reduceat(marks[self.ids].astype(np.int64), self.firsts)

    def to(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Every member's distance to member k, and whether they are linked."""
        marks = np.zeros(self.width, bool)
        marks[self.ids[self.firsts[k] : self.firsts[k] + self.sizes[k]]] = True
        both = self.common(marks)
        either = self.sizes + self.sizes[k] - both
        return 1 - both / either, self.den * both >= self.num * either

    def centre(self, members: np.ndarray) -> int:
        """The member nearest to the set of all shingles that half of the members have."""
        chosen = np.zeros(len(self.docs), bool)
        chosen[members] = True
        counts = np.bincount(self.ids[np.repeat(chosen, self.sizes)], minlength=self.width)
        half = 2 * counts >= len(members)
        both = self.common(half)[members]
        return int(members[np.argmax(both / (self.sizes[members] + half.sum() - both))])

    def find(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = self.root[self.root[k]]
            k = int(self.root[k])
        return k

    def link(self, k: int, others: np.ndarray) -> None:
        for x in others.tolist():
            a, b = self.find(k), self.find(x)
            if a != b:
                self.root[max(a, b)] = min(a, b)

    def voronoi(self, members: np.ndarray, pivots: list[int], link) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each pivot: its region with the windows of the others, and the distances to it of those who go on or hold others up."""
        found = [self.to(k) for k in pivots]
        far = np.stack([d[members] for d, _ in found])
        homes = far.min(axis=0)
        for k, row, (_, near) in zip(pivots, far, found, strict=True):
            link(k, members[near[members]])
            inside = (row <= homes + 2 * self.radius + 1e-12) & (members != k)
            yield k, members[inside], row[inside]

    def compare(self, members: np.ndarray) -> None:
        """Links all members that are near each other: counts of common shingles as products of 0-1 matrices, some rows and shingles at a time."""
        sizes = self.sizes[members]
        at = np.cumsum(sizes) - sizes
        ids = self.ids[np.repeat(self.firsts[members] - at, sizes) + np.arange(int(sizes.sum()))]
        owner = np.repeat(np.arange(len(members)), sizes)
        often = np.bincount(ids, minlength=self.width) > 1
        column = (np.cumsum(often) - 1)[ids]
        owner, column = owner[often[ids]], column[often[ids]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for lo in range(0, len(members), BLOCK):
            rows = slice(lo, min(lo + BLOCK, len(members)))
            both = np.zeros((rows.stop - lo, len(members)), np.float32)
            for first in range(0, int(often.sum()), BLOCK):
                a, b = np.searchsorted(column, (first, first + BLOCK))
                dense = np.zeros((len(members), BLOCK), np.float32)
                dense[owner[a:b], column[a:b] - first] = 1
                both += dense[rows] @ dense.T
            both = both.astype(np.int64)
            near = self.den * both >= self.num * (sizes[rows, None] + sizes[None] - both)
            for k in range(rows.stop - lo):
                others = np.flatnonzero(near[k, : lo + k])
                if len(others):
                    self.link(int(members[lo + k]), members[others])

    def finish(self) -> list[tuple[int, int]]:
        """Links that join just the members that the region's links join."""
        waiting = [np.arange(len(self.docs))]
        while waiting:
            members = waiting.pop()
            if len(members) < 2 or len({self.find(x) for x in members.tolist()}) == 1:
                continue
            centre = self.centre(members)
            several = [x for x in members[:: max(1, len(members) // PIVOTS)].tolist() if x != centre] if len(members) > FEW else []
            parts = list(self.voronoi(members, [centre, *several], self.link))
            wide = sum(len(rest) for _, rest, _ in parts) > WIDEST * len(members)
            for k, rest, far in parts if not wide else parts[:1]:
                if wide:
                    rest, far = members[members != k], self.to(k)[0][members[members != k]]
                beyond = far > self.radius + 1e-12
                if not beyond.any():
                    continue
                rest = rest[far >= far[beyond].min() - self.radius - 1e-9]
                if wide or len(rest) <= FEW:
                    self.compare(rest)
                else:
                    waiting.append(rest)
        return [(int(self.docs[k]), int(self.docs[self.find(k)])) for k in range(len(self.docs)) if self.find(k) != k]


def _groups(batches) -> Iterator[dict]:
    """Runs of rows of the same region and share, of batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        region, share = table["region"].to_numpy(), table["share"].to_numpy()
        cuts = np.flatnonzero((region[1:] != region[:-1]) | (share[1:] != share[:-1])) + 1
        if not len(cuts):
            continue
        ends = [0, *cuts.tolist()]
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            yield table.slice(a, b - a)
        held = table.slice(ends[-1]).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _joined(num: int, den: int):
    def run(batches):
        for table in _groups(batches):
            docs = table["doc"].to_numpy()
            docs, first = np.unique(docs, return_index=True)
            values = table["values"].combine_chunks()
            lists, starts = values.flatten().to_numpy().view(_U), values.offsets.to_numpy()
            starts = starts - starts[0]
            region = Region(docs, [lists[starts[k] : starts[k + 1]] for k in first.tolist()], num, den)
            out: list[tuple] = []
            if table["whole"][0].as_py():
                out = [(a, b, None, None, None, None, None, None) for a, b in region.finish()]
            else:
                pivots = [int(np.searchsorted(docs, x)) for x in np.unique(table["doc"].to_numpy()[table["pivot"].to_numpy(zero_copy_only=False)])]
                parent, everybody = table["region"][0].as_py(), np.arange(len(docs))

                def link(k, xs, out=out, docs=docs):
                    out.extend((int(docs[x]), int(docs[k]), None, None, None, None, None, None) for x in xs.tolist() if x != k)

                for alone, ks in ((False, pivots), (True, pivots[:1])):
                    for k, rest, far in region.voronoi(everybody, ks, link):
                        name = int(pair(np.array([parent], np.int64).view(_U) + _U(alone), np.array([docs[k]], np.int64).view(_U)).view(np.int64)[0])
                        out += [(None, None, parent, name, alone, int(docs[x]), int(region.sizes[x]), float(d)) for x, d in zip(rest.tolist(), far.tolist(), strict=True)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["a", "b", "parent", "region", "alone", "doc", "size", "far"])

    return run


def _shingles(n: int):
    """(doc, size, shingle) of a batch of documents."""

    def run(batches):
        for batch in batches:
            docs, sets, held = [], [], 0
            for doc, values in zip(batch.column(0).to_pylist(), shingle_sets(*column_bytes(batch.column(1)), n), strict=True):
                docs.append(doc)
                sets.append(values)
                held += len(values)
                if held >= SENT_SHINGLES:
                    yield sent(docs, sets)
                    docs, sets, held = [], [], 0
            if docs:
                yield sent(docs, sets)

    def sent(docs: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(x) for x in sets], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(docs, np.int64), sizes)), pa.array(np.repeat(sizes, sizes)), _signed(np.concatenate(sets))], ["doc", "size", "shingle"])

    return run


def _weight(members, shingles, rows: int):
    """How many tasks' worth these are."""
    return F.greatest(members / rows, shingles / REGION_SHINGLES)


def _part():
    return F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(PARTS))


def _region_sizes(members: DataFrame, rows: int) -> DataFrame:
    """(region, members, lead, shares) of regions of several members (region, doc, size)."""
    sizes = members.groupBy("region").agg(F.count("*").alias("members"), F.min("doc").alias("lead"), F.sum("size").alias("shingles")).where("members > 1")
    return sizes.withColumn("shares", F.ceil(_weight(F.col("members"), F.col("shingles"), rows))).drop("shingles")


def _round(docs: DataFrame, members: DataFrame, n: int, num: int, den: int, rows: int) -> DataFrame:
    """One level of the recursion over members (region, doc, size): links (a, b) and members of the next level (parent, region, alone, doc, size, far)."""
    # Sizes meet the members in parts of a region: one region may hold a third of all members.
    each = _region_sizes(members, rows).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    dealt = members.withColumn("part", _part()).join(each, ["region", "part"])
    sampled = (F.col("doc") == F.col("lead")) | (F.pmod(F.xxhash64("doc", "region"), F.ceil(F.col("members") / PIVOTS)) == 0)
    own = F.pmod(F.xxhash64("doc"), F.col("shares"))
    whole = F.col("shares") == 1
    places = dealt.withColumn("pivot", ~whole & sampled).select(
        "doc", "region", "pivot", whole.alias("whole"), F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).otherwise(F.array(own))).alias("share")
    )
    return _compared(docs, places, n, num, den)


def _compared(docs: DataFrame, places: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """What _joined() finds in the regions' shares, from places (doc, region, share, pivot, whole)."""
    wanted = places.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list(F.struct("region", "share", "pivot", "whole")).alias("places"))
    texts = docs.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "places")
    sets = texts.mapInArrow(_member_sets(n), "doc long, region long, share long, pivot boolean, whole boolean, values array<long>")
    return sets.repartition("region", "share").sortWithinPartitions("region", "share").mapInArrow(_joined(num, den), "a long, b long, parent long, region long, alone boolean, doc long, size long, far double")


def _rarest(docs: DataFrame, unparted: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(region, doc, size): documents of `unparted` (doc) that share one of their rarest shingles.

    Linked sets have at least num / den of either in common, so that they share a shingle among as many of
    either's first ones, by any one order, as may be missing and one more.
    """
    texts = docs.select("doc_id", "text").join(unparted.withColumnRenamed("doc", "doc_id"), "doc_id")
    dealt = cut(texts.mapInArrow(_shingles(n), "doc long, size long, shingle long").distinct()).withColumn("part", _part())
    # A shingle of nearly all documents is counted, and meets its count, in parts.
    each = dealt.groupBy("shingle", "part").agg(F.count("*").alias("rows"))
    several = each.groupBy("shingle").agg(F.sum("rows").alias("often")).where("often > 1")
    counted = dealt.join(each.select("shingle", "part").join(several, "shingle"), ["shingle", "part"])
    # Shingles of one document come first in the order and lead to nobody.
    sets = counted.groupBy("doc").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("often", "shingle"))).alias("shingles"))
    first = F.greatest(F.lit(0), F.size("shingles") + 1 - F.ceil(F.col("size") * num / den)).cast("int")
    shared = cut(sets.select("doc", "size", F.explode(F.slice("shingles", F.lit(1), first)).alias("x")).select("doc", "size", "x.shingle"))
    pivots = shared.groupBy("shingle", _part().alias("part")).agg(F.min("doc").alias("low"))
    lead = pivots.groupBy("shingle").agg(F.min("low").alias("region"))
    met = shared.withColumn("part", _part()).join(pivots.select("shingle", "part").join(lead, "shingle"), ["shingle", "part"])
    return met.select("region", "doc", "size").distinct()


def _share_pairs(members: DataFrame, components: DataFrame | None, rows: int) -> DataFrame:
    """(doc, region, share, pivot, whole): places where all members (region, doc, size) of a region meet that links don't join yet.

    Members of a region's largest component have shares of their own, which meet the others' shares only.
    """
    known = members.withColumn("component", F.col("doc"))
    if components is not None:
        known = members.join(components.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    known = cut(known.withColumn("part", _part()))
    each = known.groupBy("region", "component").agg(F.count("*").alias("members"), F.sum("size").alias("shingles"))
    sizes = each.groupBy("region").agg(F.max(F.struct("members", "component", "shingles")).alias("most"), F.sum("members").alias("members"), F.sum("shingles").alias("shingles"), F.count("*").alias("components"))
    small = _weight(F.col("members"), F.col("shingles"), rows) <= 1
    others = _weight(F.col("members") - F.col("most.members"), F.col("shingles") - F.col("most.shingles"), rows)
    one = F.lit(1).cast("long")
    sizes = sizes.where("components > 1").select(
        "region", F.col("most.component").alias("largest"), F.when(small, one).otherwise(F.ceil(2 * others)).alias("free"), F.when(small, one).otherwise(F.ceil(2 * _weight(F.col("most.members"), F.col("most.shingles"), rows))).alias("joined")
    )
    dealt = known.join(known.select("region", "part").distinct().join(sizes, "region"), ["region", "part"])
    inside = F.col("component") == F.col("largest")
    own = F.when(inside, F.col("free") + F.pmod(F.xxhash64("doc"), F.col("joined"))).otherwise(F.pmod(F.xxhash64("doc"), F.col("free")))
    dealt = dealt.withColumn("own", own).withColumn("all", F.col("free") + F.col("joined"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(inside, F.col("free")).otherwise(F.col("all")) - 1))).where("other <> own")
    share = F.least("own", "other") * F.col("all") + F.greatest("own", "other")
    return met.select("doc", "region", share.alias("share"), F.lit(False).alias("pivot"), F.lit(True).alias("whole"))


def jaccard_components(docs: DataFrame, *, n: int = 5, num: int = 80, den: int = 100, region_rows: int = REGION_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of `docs` (doc_id, text, ...).

    Documents link when den * |intersection| >= num * |union| of their sets of distinct n-word
    shingles (A-Z lower-cased); component_id is the smallest doc_id reachable by links.  A text
    of fewer words than n is one shingle; null, empty and blank texts have no shingle and link with
    nothing.  A null doc_id links with nothing and keeps a null component_id.  Rows that repeat
    a doc_id are one document of the graph: each keeps its own row.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    if not 0 < num <= den:
        raise ValueError("0 < num <= den is needed")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = cut(docs.mapInArrow(_signatures(n), "doc_id long, n_shingles long, h1 long, h2 long"))
    known = signed.where("doc_id is not null and n_shingles > 0")
    copies = cut(known.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("head"), F.count("*").alias("rows")))
    keyed = docs.where("doc_id is not null").mapInArrow(_region_keys(n, num, den), "key long, doc long, kind byte")
    # A batch sends one row of a key to the key's partition; its further rows are sure of company and go anywhere.
    hits = keyed.repartition(F.when(F.col("kind") == 2, F.xxhash64("key", "doc")).otherwise(F.col("key"))).mapInArrow(_shared_keys, "key long, doc long")
    heads = known.select("doc_id", "h1", "h2", "n_shingles").join(copies.where("rows > 1"), ["h1", "h2", "n_shingles"]).where("doc_id <> head").select(F.col("doc_id").alias("doc"), "head")
    hits = hits.join(heads, "doc", "left").select("key", F.coalesce("head", "doc").alias("doc")).distinct()
    hits = cut(_shared_regions(hits, "key"))
    partner = F.ceil(F.col("n_shingles") * num / den)
    needed = 1 + F.floor(F.floor(partner * (den - num) / num) / SPARE)
    often = hits.groupBy("doc").agg(F.count("*").alias("regions")).join(copies.select(F.col("head").alias("doc"), "n_shingles"), "doc").where(F.col("regions") >= needed)
    hits = hits.join(often.groupBy("doc").agg(F.max("n_shingles").alias("size")), "doc")
    pivots = hits.groupBy("key").agg(F.min("doc").alias("region"))
    members = cut(hits.join(pivots, "key").select("region", "doc", "size").distinct())
    links, unparted = None, None
    while not members.isEmpty():
        joined = cut(_round(docs, members, n, num, den, region_rows))
        found = joined.where("a is not null").select("a", "b")
        links = found if links is None else links.unionByName(found)
        radius = 1 - num / den
        onward = joined.where("a is null").select("parent", "region", "alone", "doc", "size", "far")
        wide = onward.groupBy("parent").agg(F.count_if(~F.col("alone")).alias("several"), F.count_if("alone").alias("one"))
        onward = onward.join(wide, "parent").where(F.col("alone") == (F.col("several") > WIDEST * F.col("one"))).select("parent", "region", "doc", "size", "far")
        edge = onward.where(F.col("far") > radius + 1e-12).groupBy("region").agg(F.min("far").alias("edge"))
        onward = cut(onward.join(edge, "region").where(F.col("far") >= F.col("edge") - radius - 1e-9).select("parent", "region", "doc", "size").distinct())
        before = members.groupBy(F.col("region").alias("parent")).agg(F.count("*").alias("before"))
        parents = onward.groupBy("region").agg(F.min("parent").alias("parent")).join(before, "parent")
        stuck = cut(_region_sizes(onward, region_rows).where("shares > 1").join(parents, "region").where(F.col("members") > PARTED * F.col("before")).select("region"))
        members = onward.select("region", "doc", "size")
        if not stuck.isEmpty():
            left = members.join(stuck, "region", "left_semi").select("doc")
            unparted = left if unparted is None else unparted.unionByName(left)
            members = members.join(stuck, "region", "left_anti")
    if unparted is not None:
        met = cut(_rarest(docs, cut(unparted.distinct()), n, num, den))
        places = _share_pairs(met, connected_components(links), region_rows)
        links = links.unionByName(cut(_compared(docs, places, n, num, den)).select("a", "b"))
    if links is None:
        labels = copies.withColumn("component", F.col("head"))
    else:
        labels = copies.join(connected_components(links).withColumnRenamed("node", "head"), "head", "left").withColumn("component", F.coalesce("component", "head"))
    labels = labels.select("h1", "h2", "n_shingles", "component")
    rows_of = signed.select("doc_id", "n_shingles", "h1", "h2").join(labels, ["h1", "h2", "n_shingles"], "left")
    return rows_of.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def _shared_regions(members: DataFrame, region: str) -> DataFrame:
    """Without regions of one member."""
    return members.join(members.groupBy(region).count().where("count > 1").select(region), region, "left_semi")
