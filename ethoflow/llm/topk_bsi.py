"""Exact top-k search by inner product on a bit-sliced index.

Every component is quantised to an integer and the rows are cut into blocks.
A block's index holds, for each dimension, one bitmap (a bit for each row) for
each binary digit of the shifted component.  A query adds the slices of each
dimension, shifted by the signed digits of its own component, in carry-save
form; the sum is again a list of bitmaps, so scores of all rows of a block come
from AND, OR and XOR alone.  The best rows are then selected from the most
significant slice downward, and rows that tie at the last place are resolved by
their ids.

Queries and rows meet in lanes: a lane holds some blocks of rows for as long as
the blocks of queries pass through it, and only k rows for each query leave it.

Edge cases: vectors that are null, or hold null or non-finite components, take
no part; components of any size do (a block that holds one beyond a long has as
many slices as it needs); vectors of different lengths never meet; a null id takes no part; repeated ids are
separate candidates, none of which meets a query of the same id; fewer than k
candidates are all returned; scores are exact at any size and are compared
before those beyond a long are shown as its ends.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethoflow.llm._common import Scratch, small_batches

SCALE = 1024
#: Rows in a block of the index, and queries in a block of queries.
BLOCK_ROWS = 8192
BLOCK_QUERIES = 64
#: Blocks that a lane holds at most, on average.
LANE_BLOCKS = 64
#: Blocks of components below are quantised as longs, others as Python's integers.
PLAIN = float(1 << 45)


def quantise(rows: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles, exactly: as longs, or as Python's integers where those are too small."""
    if float(np.abs(rows).max(initial=0.0)) < PLAIN:
        return np.floor(rows * SCALE).astype(np.int64)
    # What is over 2^53 has no fraction.
    return np.array([int(x) * SCALE if abs(x) >= 1 << 53 else int(np.floor(x * SCALE)) for x in rows.ravel().tolist()], dtype=object).reshape(rows.shape)


def ordered(score: int) -> bytes:
    """The score as bytes whose order is that of the scores, of any size."""
    body = abs(score).to_bytes((abs(score).bit_length() + 7) // 8, "big")
    if score >= 0:
        return b"\x01" + len(body).to_bytes(4, "big") + body
    return b"\x00" + (0xFFFFFFFF - len(body)).to_bytes(4, "big") + bytes(255 - b for b in body)


def slices_of(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bitmaps [dimension, digit, words], low [dimension]) of an integer matrix [row, dimension]."""
    low = matrix.min(axis=0)
    shifted = matrix - low
    digits = max(1, int(shifted.max()).bit_length())
    rows = -(-len(matrix) // 64) * 64
    bits = np.zeros((matrix.shape[1], digits, rows), dtype=np.uint8)
    if matrix.dtype == object:
        size = (digits + 7) // 8
        raw = np.frombuffer(b"".join(int(x).to_bytes(size, "little") for x in shifted.ravel()), dtype=np.uint8).reshape(*shifted.shape, size)
        bits[:, :, : len(matrix)] = np.unpackbits(raw, axis=2, bitorder="little")[:, :, :digits].transpose(1, 2, 0)
    else:
        shifted = shifted.astype(np.uint64)
        for d in range(digits):
            bits[:, d, : len(matrix)] = ((shifted >> np.uint64(d)) & np.uint64(1)).T
    return np.packbits(bits, axis=2, bitorder="little").view("<u8"), low


def _signed_digits(x: int) -> list[tuple[int, int]]:
    """(position, sign) of the non-adjacent form: few digits, so few additions."""
    out, at, sign = [], 0, 1 if x >= 0 else -1
    x = abs(x)
    while x:
        if x & 1:
            digit = 2 - (x & 3)
            out.append((at, sign * digit))
            x -= digit
        x >>= 1
        at += 1
    return out


def add_slices(bitmaps: np.ndarray, query: list[int], width: int) -> np.ndarray:
    """Bitmaps of sum(query * shifted component), in two's complement of so many digits."""
    digits, words = bitmaps.shape[1], bitmaps.shape[2]
    total = np.zeros((width, words), dtype=np.uint64)
    carry = np.zeros((width, words), dtype=np.uint64)
    fixed = 0
    for d, x in enumerate(query):
        for at, sign in _signed_digits(int(x)):
            # Carry-save: three numbers become two, all digits at once.
            term = bitmaps[d]
            if sign < 0:
                # Minus a number of so many digits is its complement plus 1 minus 2 ** digits.
                term = ~term
                fixed += (1 << at) - (1 << at + digits)
            a, b = total[at:], carry[at:]
            both, one = a & b, a ^ b
            both[:digits] |= one[:digits] & term
            one[:digits] ^= term
            total[at:] = one
            carry[at] = 0
            carry[at + 1 :] = both[:-1]
    zero, ones = np.zeros(words, dtype=np.uint64), np.full(words, ~np.uint64(0))
    constant = [ones if fixed >> i & 1 else zero for i in range(width)]
    return _ripple(_ripple(total, carry), constant)


def _ripple(x, y) -> np.ndarray:
    """The sum of two numbers in bitmaps, without a carry out."""
    out, c = np.empty_like(x), np.zeros(x.shape[1], dtype=np.uint64)
    for i in range(len(x)):
        one = x[i] ^ y[i]
        out[i] = one ^ c
        c = (x[i] & y[i]) | (one & c)
    return out


def select_top(scores: np.ndarray, rows: np.ndarray, k: int, ids: np.ndarray) -> np.ndarray:
    """Row numbers of the k highest scores among the rows of a bitmap; ties go to smaller ids.

    scores: bitmaps in two's complement, least digit first.
    """
    sure, open_rows, need = np.zeros_like(rows), rows.copy(), k
    for i in range(len(scores) - 1, -1, -1):
        bit = ~scores[i] if i == len(scores) - 1 else scores[i]  # the sign: clear is higher
        higher = open_rows & bit
        n = int(np.bitwise_count(higher).sum())
        if n > need:
            open_rows = higher
        else:
            sure |= higher
            need -= n
            open_rows = open_rows & ~bit
            if not need:
                break
    out = _rows(sure)
    if need:
        ties = _rows(open_rows)  # equal in all digits
        out = np.concatenate([out, ties[np.argsort(ids[ties], kind="stable")[:need]]])
    return out


def _rows(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, b = np.nonzero(bits)
    return words[w] * 64 + b


def search(bitmaps: np.ndarray, low: list[int], ids: np.ndarray, query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
    """(vec_id, score) of the k best rows of one block."""
    top = ((1 << bitmaps.shape[1]) - 1) * sum(map(abs, query))
    width = top.bit_length() + 2
    scores = add_slices(bitmaps, query, width)
    rows = np.zeros(bitmaps.shape[2] * 64, dtype=np.uint8)
    rows[: len(ids)] = ids != query_id
    best = select_top(scores, np.packbits(rows, bitorder="little").view("<u8"), k, ids)
    shift = sum(q * x for q, x in zip(query, low))
    found = []
    for r in best.tolist():
        digits = (scores[:, r >> 6] >> np.uint64(r & 63)) & np.uint64(1)
        value = sum(int(b) << i for i, b in enumerate(digits.tolist()))
        found.append((int(ids[r]), value - (value >> (width - 1) << width) + shift))
    return found


def fit_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, vec) with components as double; unfit vectors are left out."""
    vec = F.col(vec_col)
    fit = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & (F.size(vec) > 0)
    rows = df.where(F.col(id_col).isNotNull() & vec.isNotNull()).where(fit)
    return rows.select(F.col(id_col).cast("long").alias("id"), vec.cast("array<double>").alias("vec"))


def _blocks(size: int, index: bool):
    """Packs the rows of each task into blocks of vectors of one length."""

    def pack(ids: list, vectors: list) -> dict:
        matrix = quantise(np.array(vectors, dtype=np.float64))
        out = {"dims": matrix.shape[1], "ids": np.array(ids, dtype=np.int64).tobytes()}
        if not index:
            return out | {"digits": 0, "numbers": json.dumps(matrix.tolist()), "body": b""}
        body, low = slices_of(matrix)
        return out | {"digits": body.shape[1], "numbers": json.dumps(low.tolist()), "body": body.tobytes()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}  # by length
        for frame in frames:
            for i, vec in zip(frame["id"].tolist(), frame["vec"]):
                ids, vectors = held.setdefault(len(vec), ([], []))
                ids.append(i)
                vectors.append(vec)
                if len(ids) >= size:
                    yield pd.DataFrame([pack(*held.pop(len(vec)))])
        for rest in held.values():
            yield pd.DataFrame([pack(*rest)])

    return run


#: numbers: the least components of a block of rows, or the vectors of a block of queries.
_PACKED = "dims int, digits int, ids binary, numbers string, body binary"


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best rows for each query row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    small_batches(spark)
    index = scratch.keep(fit_rows(vectors, id_col, vec_col).mapInPandas(_blocks(BLOCK_ROWS, True), _PACKED), "index")
    queries = fit_rows(vectors.where(is_query), id_col, vec_col).coalesce(max(1, spark.sparkContext.defaultParallelism // 2))
    queries = scratch.keep(queries.mapInPandas(_blocks(BLOCK_QUERIES, False), _PACKED), "queries")
    # Every block of queries goes once to every lane; a lane holds blocks of rows, as many as its memory takes where there are many.
    blocks = index.count()
    lanes = max(1, min(blocks, max(spark.sparkContext.defaultParallelism, -(-blocks // LANE_BLOCKS))))
    names = ["dims", "digits", "ids", "numbers", "body"]
    rows = index.select(F.pmod(F.xxhash64("ids"), F.lit(lanes)).cast("int").alias("lane"), F.lit(0).alias("asks"), *names)
    every = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    asked = queries.select(every, F.lit(1).alias("asks"), *names)

    def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, blocks = None, []
        for frame in frames:
            for v in frame.itertuples(index=False):
                if v.lane != lane:
                    lane, blocks = v.lane, []
                ids = np.frombuffer(v.ids, dtype=np.int64)
                if not v.asks:
                    blocks.append((v.dims, np.frombuffer(v.body, dtype="<u8").reshape(v.dims, v.digits, -1), json.loads(v.numbers), ids))
                    continue
                out = []
                for q, query in zip(ids.tolist(), json.loads(v.numbers)):
                    own = [hit for dims, bitmaps, low, names in blocks if dims == v.dims for hit in search(bitmaps, low, names, q, query, k)]
                    out += [(q, i, ordered(x), min(max(x, -(1 << 63)), (1 << 63) - 1)) for i, x in heapq.nsmallest(k, own, key=lambda h: (-h[1], h[0]))]
                if out:
                    yield pd.DataFrame(out, columns=["query_id", "vec_id", "ordered", "score"])

    met = rows.unionAll(asked).repartition(lanes, "lane").sortWithinPartitions("lane", "asks")
    found = met.mapInPandas(visit, "query_id long, vec_id long, ordered binary, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("ordered"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
