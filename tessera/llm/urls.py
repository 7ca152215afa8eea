"""URL filtering with a blocked Bloom filter in front of an exact hash join.

Only DataFrame functions.  Every url names its listed candidates itself: each suffix of its host that
starts at a label, with each prefix of its path that is as long as some listed path.  A candidate
whose bits are all set in its block of the filter is a possible hit; an exact join with
the list removes the false ones; the longest listed entry decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter grows with the list: a block of 64 bits for each two entries.
ENTRIES = 2
#: Most blocks of the filter that is broadcast, two longs each: 16 MB.  Longer lists fill it, so that more false hits reach the exact join.
BLOCKS = 1 << 20
#: Bits that an entry sets in its block.
BITS = 4
#: Parts of what meets a listed entry whose host is one label, such as `com`, in the exact join.
SPREAD = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and without `://`."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url_, instr(url_, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _block(host: str, path: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(host, path), F.lit(blocks))


def _mask(host: str, path: str) -> Column:
    other = F.xxhash64(path, host)
    return reduce(lambda a, b: a.bitwiseOR(b), (F.expr(f"shiftleft(1L, CAST(shiftright(h_, {6 * k}) & 63 AS INT))") for k in range(BITS))), other


def _with_bits(frame: DataFrame, host: str, path: str, blocks: int) -> DataFrame:
    mask, other = _mask(host, path)
    return frame.withColumn("h_", other).withColumn("block_", _block(host, path, blocks)).withColumn("mask_", mask).drop("h_")


def blocks_for(entries: int, most: int = BLOCKS) -> int:
    """A power of two, at most `most` and at least 1."""
    return min(most, 1 << max(0, (entries - 1) // ENTRIES).bit_length())


def bloom_filter(listed: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(block_, bits_) of the listed (host, path); at most `blocks` rows however long the list is."""
    return _with_bits(listed.select("host", "path"), "host", "path", blocks).groupBy("block_").agg(F.bit_or("mask_").alias("bits_"))


def judge_urls(pages: DataFrame, listed: DataFrame, *, key: str = "page_id", url: str = "url", blocks: int = BLOCKS) -> DataFrame:
    """(key, host, path, rule, verdict) for each row of `pages`.

    `listed` has (host, path, verdict).  An entry fits its host and all subdomains of it if the
    url's path starts with the entry's; the longest entry gives `rule` (host and path in one)
    and `verdict`.  Without one, rule is null and the verdict is allow.  Of two verdicts for
    one entry, block counts; listed rows with a null are left out.  Null urls, and
    urls without `://`, have an empty host and path and fit nothing.  Rows may repeat and keys may be
    null or repeat: each row gets its own result.  Other columns are ignored.

    Entries whose host is a single label are met by much of the web: they are repeated `SPREAD` times and their
    possible hits dealt over the copies.  Rows without a host are dealt by their key, since no rule can meet them.
    """
    listed = listed.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    counted = listed.groupBy(F.length("path").alias("n")).count().collect()  # numbers up to the length of the longest listed path, no more
    lengths, blocks = sorted(r["n"] for r in counted), blocks_for(sum(r["count"] for r in counted), blocks)
    parsed = pages.select(F.col(key).alias("key_"), F.col(url).cast("string").alias("url_"))
    host, path = host_and_path(F.col("url_"))
    parsed = parsed.select(F.col("key_").alias(key), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_compact(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)).cast("array<string>"))
    each = parsed.select("host", "path").where("host <> ''").distinct()
    each = each.withColumn("suffix_", F.explode(suffixes)).withColumn("prefix_", F.explode(prefixes))
    possible = (
        _with_bits(each, "suffix_", "prefix_", blocks)
        .join(F.broadcast(bloom_filter(listed, blocks)), "block_")
        .where(F.col("bits_").bitwiseAND(F.col("mask_")) == F.col("mask_"))
        .select("host", "path", "suffix_", "prefix_")
    )
    wide = F.instr("suffix_", ".") == 0
    part = F.when(wide, F.pmod(F.xxhash64("host", "path"), F.lit(SPREAD)).cast("int")).otherwise(0)
    entries = listed.select(F.col("host").alias("suffix_"), F.col("path").alias("prefix_"), "verdict")
    entries = entries.withColumn("part_", F.explode(F.when(wide, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    exact = possible.withColumn("part_", part).join(entries, ["suffix_", "prefix_", "part_"])
    rule = F.concat("suffix_", "prefix_")
    ruled = exact.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), "verdict")).alias("best"))
    ruled = ruled.select("host", "path", F.lit(0).cast("long").alias("part_"), "best.rule", "best.verdict")
    dealt = parsed.withColumn("part_", F.when(F.col("host") == "", F.xxhash64(key)).otherwise(0))
    return dealt.join(ruled, ["host", "path", "part_"], "left").select(key, "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
