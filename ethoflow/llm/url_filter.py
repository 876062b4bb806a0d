"""URL filtering: a blocked Bloom filter, then an exact hash join.

Every listed entry is a canonical URL prefix (host without case, path) with a
verdict.  A page's URL yields the entries that could fit it: its host and each
parent domain, with each path prefix of a length that occurs in the list.  The
filter (one 256-bit block per key, eight bits set in it) lets few of them pass;
what passes meets the list in a hash join, so false positives go no further.
Of the entries that fit, the longest wins; a URL without one is allowed.

Only the filter is sent to every task.  Tasks set the bits, an aggregate joins
them by block, and the driver only lines up the blocks.  The filter has ten bits
an entry up to ``MAX_FILTER_BYTES``; of a longer list more entries share a block,
so more false positives reach the join, which stays exact.  The join's plan is
left to Spark.

Edge cases: a null URL or one without ``://`` has an empty host and path, and
no rule; an empty path fits no rule (every rule's path starts with ``/``);
repeated pages come back as often as they came; an empty list allows all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_FILTER_BYTES = 256 << 20
#: The odd multipliers of the split-block filter that Parquet specifies.
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1), "/", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash, and one bit for each of its eight words."""
    h = hashes.view(np.uint64)
    block = ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
    low = h.astype(np.uint32)
    with np.errstate(over="ignore"):
        return block, np.uint32(1) << ((low[:, None] * np.array(SALTS, dtype=np.uint32)) >> np.uint32(27))


class BlockedBloom:
    """A split-block filter over 64-bit hashes: words [block, 8]."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        block, bits = _places(hashes, len(self.words))
        return ((self.words[block] & bits) == bits).all(axis=1)


def built_filter(hashes: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> BlockedBloom:
    """The filter of the hashes in the one column: bits are set in tasks and joined by block."""
    blocks = min(max(1, -(-hashes.count() * 10 // 256)), max(1, max_bytes // 32))
    names = [f"w{i}" for i in range(8)]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, words = _places(batch.column(0).to_numpy(), blocks)
            yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array(words[:, i].astype(np.int64)) for i in range(8))], names=["block", *names])

    rows = hashes.mapInArrow(bits, "block long, " + ", ".join(f"{n} long" for n in names))
    joined = rows.groupBy("block").agg(*(F.bit_or(n).alias(n) for n in names)).toArrow()  # 32 bytes a block
    words = np.zeros((blocks, 8), dtype=np.uint32)
    at = joined.column("block").to_numpy()
    for i, n in enumerate(names):
        words[at, i] = joined.column(n).to_numpy()
    return BlockedBloom(words)


def keyed(host: Column, path: Column) -> Column:
    return F.concat(host, path)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Rows (page_id, host, path, rule, verdict) for every page.

    rules: columns host, path and verdict (``allow`` or ``block``); of entries
    with the same host and path ``block`` counts.
    """
    listed = rules.where("host is not null and path is not null").select(F.lower("host").alias("host"), "path", "verdict")
    listed = listed.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(keyed(F.col("host"), F.col("path")).alias("rule"), F.octet_length("path").alias("n"), F.char_length("path").alias("chars"), "verdict")
    bloom = built_filter(listed.select(F.xxhash64("rule").alias("h")))
    lengths = sorted(r[0] for r in listed.select("chars").distinct().collect())

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    if not lengths:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    # A host of d labels has d candidates: itself and its parent domains.
    parts = F.split("host", r"\.")
    hosts = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i)))

    def entries(n: int) -> Column:
        return F.transform(hosts, lambda h: F.when(F.char_length("path") >= n, F.concat(h, F.substring("path", 1, n))))

    fits = [entries(n) for n in lengths]
    # URLs without a host, which may be very many, meet no rule and stay out of the join.
    named = rows.where("host <> ''")
    urls = named.select("host", "path").distinct().withColumn("entry", F.explode(F.array_compact(F.flatten(F.array(*fits)))))
    sent = pages.sparkSession.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def may_hold(hashes: pd.Series) -> pd.Series:
        return pd.Series(sent.value.may_hold(hashes.to_numpy()))

    passed = urls.where(may_hold(F.xxhash64("entry")))
    hits = passed.join(listed, passed.entry == listed.rule)
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("size"), "rule", "verdict")).alias("best"))
    judged = named.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"))
    return judged.unionAll(rows.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict")))
