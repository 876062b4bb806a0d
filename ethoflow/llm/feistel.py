"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 to n-1 in the order of a hash of the row, so that the
number depends on the data alone; a keyed Feistel network over the next even
power of two, walked along its cycles until it falls below n, permutes the
numbers.  Permuted number p goes to shard p mod k, slot p div k: the shards'
row counts differ by one at most and the slots have no gap.

Numbering needs no global sort: equal rows are counted first, groups fall into
hash buckets, bucket sizes are summed (one small row a bucket), and a window gives
each group of a bucket its first number.

Edge cases: a null text has size 1 and the crc32 of the empty text; a null id
is a value like any other; identical rows get different numbers in an order
that does not matter; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets for numbering; each must fit in one task (100 TB: about 10^7 ids a bucket).
BUCKETS = 4096
ROUNDS = 6
#: Numbers that one row deals out.
SPAN = 10_000


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A keyed 64-bit mix (the finaliser constants of splitmix64)."""
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def half_bits(n: int) -> int:
    """Bits of each half of the smallest balanced domain that holds n numbers."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The permuted value of each number in 0..n-1 (a bijection of that range)."""
    half = np.uint64(half_bits(n))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while len(todo):
            left, right = out[todo] >> half, out[todo] & mask
            for r in range(ROUNDS):
                left, right = right, left ^ (_mix(right, seed * ROUNDS + r + 1) & mask)
            out[todo] = (left << half) | right
            todo = todo[out[todo] >= np.uint64(n)]  # walk on along the cycle
    return out.astype(np.int64)


def locate(number: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """(shard, slot) of one row number, without looking at any row."""
    p = int(permute(np.array([number]), n, seed)[0])
    return p % shards, p // shards


def number_rows(df: DataFrame, order: list[Column], weight: str, out: str) -> tuple[DataFrame, int]:
    """(rows with the first of ``weight`` numbers, dense from 0 in the order of the columns' hash; sum of the weights)."""
    tmp = {n: f"__ethoflow_{n}" for n in ("hash", "bucket", "before")}
    rows = df.withColumn(tmp["hash"], F.xxhash64(*order))
    rows = rows.withColumn(tmp["bucket"], F.pmod(F.col(tmp["hash"]), F.lit(BUCKETS)).cast("int"))
    counts = {r[0]: r[1] for r in rows.groupBy(tmp["bucket"]).agg(F.sum(weight)).collect()}  # BUCKETS rows at most
    before, total = [], 0
    for b in range(BUCKETS):
        before.append(total)
        total += counts.get(b, 0)
    earlier = Window.partitionBy(tmp["bucket"]).orderBy(tmp["hash"], *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(tmp["before"], F.coalesce(F.sum(weight).over(earlier), F.lit(0)))
    start = F.lit(np.array(before, dtype=np.int64))
    numbered = rows.withColumn(out, (F.get(start, F.col(tmp["bucket"])) + F.col(tmp["before"])).cast("long"))
    return numbered.drop(*tmp.values()), total


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, number, position, law, shard, slot, grown_shard).

    The law is ``rows``: counts differ by one at most.  size is the text's UTF-8
    bytes plus one; grown_shard is null, as another shard moves rows freely.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    equal = rows.groupBy("doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("n"))
    numbered, n = number_rows(equal, [F.col(c) for c in ("doc_id", "text_crc32", "size")], "n", "first")
    # A group's numbers are dealt out in spans of bounded length, so that equal rows of any number are many tasks' work.
    spans = numbered.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(SPAN).cast("long"))))
    spans = spans.repartition(F.col("first") + F.col("from"))
    number = F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + F.least(F.col("from") + SPAN, F.col("n")) - 1)).alias("number")
    single = spans.select("doc_id", "size", "text_crc32", number)

    @F.pandas_udf("long")
    def position(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    placed = single.withColumn("position", position("number"))
    return placed.select(
        "doc_id", "size", "text_crc32", "number", "position", F.lit("rows").alias("law"),
        (F.col("position") % shards).cast("int").alias("shard"), F.expr(f"position div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
