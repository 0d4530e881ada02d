"""URL filters: a blocked Bloom filter of listed keys, then an exact hash join for what passes it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits in a block; each key sets one bit in each word, so that a probe reads one block.
WORDS = 8
#: Blocks beyond this number are joined by their number instead of broadcast (64 bytes of bits each, 64 MB in all).
BROADCAST_BLOCKS = 1 << 20
#: Rules beyond this number are joined by a shuffle instead of broadcast.
BROADCAST_RULES = 200_000


def url_host(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty without :// or url."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(n_blocks))


def _bits(key: Column) -> list[Column]:
    """One bit for each word of the block, from six bits each of a second hash."""
    h = F.xxhash64(key, F.lit(1))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """keys(key) -> (block, w0..w7): the non-empty blocks of the filter, made by map-side combined bit_or."""
    bits = keys.select(_block(F.col("key"), n_blocks).alias("block"), *(b.alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))))
    return bits.groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)))


def filter_urls(pages: DataFrame, rules: DataFrame, bits_per_key: int = 16, default: str = "allow") -> DataFrame:
    """Judges each page's url by the longest rule that fits it.

    pages: page_id, url and any other columns, which are not read. rules: host, path, verdict. A rule fits
    its host and all subdomains where the url's path starts with the rule's path; the longest rule wins (longest
    host + path, then the longer host; of equal rules, block before allow). Returns one row for each page: page_id,
    host, path, rule (host + path or null), verdict (the rule's, else `default`). Null and malformed urls have an empty
    host and path and get no rule unless one is listed for the empty host; repeated pages are judged each on their own;
    without rules every verdict is the default.

    A url's candidate keys are its host suffixes, at label bounds and of no more labels than the longest listed host, times the prefixes of its path as long as some rule's
    path. They are probed in the blocked Bloom filter; what passes meets the exact keys in a join, which removes the
    false positives. Rules with more distinct path lengths or more labels only add candidates; a very long url costs its length.
    """
    listed = (
        rules.select(F.coalesce("host", F.lit("")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), "verdict")
        .groupBy("r_host", "r_path").agg(F.max("verdict").alias("r_verdict"))
        .withColumn("key", F.concat_ws("\n", "r_host", "r_path"))
    )
    n_labels = F.size(F.split("r_host", r"\.")).alias("n")
    sizes = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("r_path")).alias("lengths"), F.max(n_labels).alias("labels")).first()
    n_blocks = max(1, math.ceil(sizes["n"] * bits_per_key / (64 * WORDS)))
    blocks = bloom_blocks(listed, n_blocks)
    blocks = F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks

    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    # substring_index finds a suffix from the end: a host of very many labels costs its length, not its square
    depth = F.least(F.length("host") - F.length(F.replace("host", F.lit("."))) + 1, F.lit(sizes["labels"] or 1))
    suffixes = F.transform(F.sequence(F.lit(1), depth), lambda i: F.call_function("substring_index", "host", F.lit("."), -i))
    cuts = F.array(*(F.lit(n) for n in sorted(sizes["lengths"]))).cast("array<int>")
    fits = F.filter(cuts, lambda n: n <= F.length("path"))
    # each page row carries its number of copies in itself: candidates are grouped back by url, not by page
    one = urls.select("host", "path").distinct()
    candidates = (
        one.withColumn("suffix", F.explode(suffixes)).withColumn("cut", F.explode(fits))
        .select("host", "path", F.concat_ws("\n", "suffix", F.substring("path", F.lit(1), F.col("cut"))).alias("key"))
        .withColumn("block", _block(F.col("key"), n_blocks))
    )
    possible = candidates.join(blocks, "block")
    for i, bit in enumerate(_bits(F.col("key"))):
        possible = possible.filter(F.col(f"w{i}").bitwiseAND(bit) != 0)
    exact = F.broadcast(listed) if sizes["n"] <= BROADCAST_RULES else listed
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), "r_host")
    best = (
        possible.select("host", "path", "key").join(exact, "key")
        .groupBy("host", "path").agg(F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "r_verdict"), rank).alias("best"))
    )
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict")
    )
