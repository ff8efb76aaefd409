"""URL filters: host and path rules, and a list of canonical URLs behind a blocked Bloom filter.

Keys are rule strings (host suffix and path prefix) and canonical URLs. The filter is a table of 64-bit blocks: a key's
hash names its block and the bits in it, so one lookup answers for a key. Only possible hits reach the exact hash join,
which removes false positives. Work is done once per distinct URL; a hot URL or host is one row there.

The filter and the rules are broadcast while their size, counted first, is within BROADCAST_ROWS; beyond it they are
joined by shuffle. DataFrame functions only.

Defined results: a null url, or one without "://", has empty host and path, fits no rule and is not listed; null keys
of lists and rules are ignored; repeated rows each have their row; empty tables give no rows, empty lists no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
HASHES = 5
BROADCAST_ROWS = 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """After the first "://" up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One form for a page: host without a leading www. or m., path without trailing slashes; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, "^(www|m)\\.", ""), F.regexp_replace(path, "/+$", "")))


def _blocks(keys: int) -> int:
    return max(1, -(-keys * BITS_PER_KEY // 64))


def _place(key: Column, blocks: int) -> tuple[Column, Column]:
    """(block, mask): where a key's bits lie."""
    h = F.xxhash64(key)
    bits = [F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(HASHES)]
    mask = F.lit(0).cast("long")
    for b in bits:
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))
    return F.pmod(F.shiftright(h, 6 * HASHES), F.lit(blocks)), mask


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """(block, word) of the distinct column `key`."""
    block, mask = _place(F.col("key"), blocks)
    return keys.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("word"))


def possible(keys: DataFrame, table: DataFrame, blocks: int) -> DataFrame:
    """The rows whose `key` the filter may hold."""
    block, mask = _place(F.col("key"), blocks)
    marked = keys.withColumn("block", block).withColumn("mask", mask)
    small = blocks <= BROADCAST_ROWS
    return marked.join(F.broadcast(table) if small else table, "block").filter(F.col("word").bitwiseAND(F.col("mask")) == F.col("mask")).drop("block", "mask", "word")


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id, host, path, rule, verdict and whether its canonical URL is listed.

    rules: host, path (from / on), verdict. The longest rule that fits decides; else listed pages are blocked.
    listed: key, canonical URLs.
    """
    rules = rules.filter("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.min("verdict").alias("verdict")).select(F.concat("host", "path").alias("key"), F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("reach"), "verdict")
    listed = listed.filter("key IS NOT NULL").select("key").distinct()
    shapes = [(r.labels, r.reach) for r in rules.select("labels", "reach").distinct().orderBy("labels", "reach").collect()]
    n_rules = rules.count()
    blocks = _blocks(n_rules + listed.count())
    table = bloom_filter(rules.select("key").unionByName(listed), blocks)

    urls = pages.select(F.col(url_col).cast("string").alias("url")).distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # of the rules' shapes, those that the url has room for: at most its labels times its path's length
    shape = F.array(*[F.struct(F.lit(m).alias("labels"), F.lit(k).alias("reach")) for m, k in shapes]) if shapes else F.array().cast("array<struct<labels:int,reach:int>>")
    labels, reach = F.size(F.split("host", "\\.")), F.length("path")
    fits = F.filter(shape, lambda s: (s["labels"] <= labels) & (s["reach"] <= reach))
    keys = F.transform(fits, lambda s: F.struct(F.lit(False).alias("whole"), F.concat(F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substr(F.col("path"), F.lit(1), s["reach"])).alias("key")))
    keys = F.concat(keys, F.array(F.struct(F.lit(True).alias("whole"), canonical(F.col("host"), F.col("path")).alias("key"))))
    probes = urls.filter("host <> ''").select("url", F.explode(F.array_distinct(keys)).alias("k")).select("url", "k.whole", "k.key").filter("key IS NOT NULL")
    hits = possible(probes, table, blocks)

    exact = rules.select("key", F.struct(F.length("key").alias("size"), "key", "verdict").alias("rule"))
    by_rule = hits.filter("NOT whole").join(F.broadcast(exact) if n_rules <= BROADCAST_ROWS else exact.hint("shuffle_hash"), "key").groupBy("url").agg(F.max("rule").alias("rule"))
    by_list = hits.filter("whole").join(listed.hint("shuffle_hash"), "key").select("url", F.lit(True).alias("is_listed")).distinct()
    judged = urls.join(by_rule, "url", "left").join(by_list, "url", "left")
    judged = judged.select("url", "host", "path", F.col("rule.key").alias("rule"), F.coalesce("rule.verdict", F.when(F.col("is_listed"), "block").otherwise("allow")).alias("verdict"), F.coalesce("is_listed", F.lit(False)).alias("listed"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    out = rows.join(judged.filter("url IS NOT NULL"), "url", "left")
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))
