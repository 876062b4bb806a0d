"""SimHash near-duplicate detection by multi-index hashing.

Fingerprints are reduced to distinct values, every value probes small Hamming
balls around its segments, and table matches are verified by their complete
distance inside the join.  Of its verified matches a value keeps the smallest and
the largest only, by an aggregate in the join's own tasks; these links are closed
into components, and the next round looks for matches in other components, until
there are none.  So each round gives two links a value at most, however large a
cluster is, and no connection is lost.

Exactness.  64 bits fall into three segments (22, 21 and 21 bits).  Two values
that differ in at most four bits differ in at most one bit of one of the first
two segments, or agree in the third (else they would differ in at least five:
2 + 2 + 1).  So radius-1 balls on two segments and exact keys on the third find
every link.

Edge cases: null and empty texts, and texts of white space, have fingerprint
zero and link to each other; texts of under four words hash as one shingle; a
null ``doc_id`` stays in its group but never names it (a group of null ids only
has a null ``component_id``); repeated rows come back as often as they came;
columns other than the id and text are ignored; an empty table gives no rows.
``keep_one`` keeps repeated rows of the document that stays; of a group with null
ids only it keeps the text with the smallest hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoflow.llm._common import OWN, Scratch, let_go, small_batches
from ethoflow.llm.components import connected_components

WORDS = 4
SEED = 42
DISTANCE = 4
#: (first bit, bits, radius of the probed ball) of each segment, for DISTANCE 4.
SEGMENTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))


def fingerprint_of(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= WORDS:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))  # of each word, in joined
        starts = [0, *(e + 1 for e in ends[:-WORDS])]
        hashes = list(map(xxh64_intdigest, [joined[i:j] for i, j in zip(starts, ends[WORDS - 1 :])], repeat(SEED)))
    h = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for part in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, version): fp is the fingerprint's 64 bits as a signed long, version a hash of the text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            fp = np.array([fingerprint_of(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "version"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("version"))
    return rows.mapInArrow(run, "doc_id long, fp long, version long")


def _segment(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def other_matches(values: DataFrame) -> DataFrame:
    """Rows (a, b): for each distinct value a in column fp the smallest and the largest at DISTANCE or less in another group (column comp)."""
    probes, keys = [], []
    for i, (first, bits, radius) in enumerate(SEGMENTS):
        seg = _segment(F.col("fp"), first, bits)
        tag = F.lit(i << 32)
        flips = [0, *(1 << j for j in range(bits))] if radius else [0]
        probes += [seg.bitwiseXOR(F.lit(f).cast("long")).bitwiseOR(tag) for f in flips]
        keys.append(seg.bitwiseOR(tag))
    left = values.select(F.col("fp").alias("a"), F.col("comp").alias("own"), F.explode(F.array(*probes)).alias("key"))
    right = values.select(F.col("fp").alias("b"), F.col("comp").alias("other"), F.explode(F.array(*keys)).alias("key"))
    near = (F.col("l.key") == F.col("r.key")) & (F.col("own") != F.col("other")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)
    ends = left.alias("l").join(right.alias("r"), near).groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high"))
    return ends.select("a", F.explode(F.array_distinct(F.array("low", "high"))).alias("b"))


def value_groups(values: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (fp, root) of the distinct values in column fp that have a match; values with the same root are connected."""
    links = scratch.keep(other_matches(values.select("fp", F.col("fp").alias("comp"))), "links")
    # Only values with a match take part in the next rounds.
    now = scratch.keep(connected_components(links, scratch).select(F.col("node").alias("fp"), F.col("root").alias("comp")), "groups")
    while True:
        links = scratch.keep(other_matches(now), "links")
        if links.isEmpty():
            return now.select("fp", F.col("comp").alias("root"))
        ends = links.join(now.select(F.col("fp").alias("a"), F.col("comp").alias("x")), "a").join(now.select(F.col("fp").alias("b"), F.col("comp").alias("y")), "b")
        merged = connected_components(ends.select("x", "y"), scratch, "x", "y")
        now = scratch.keep(now.join(merged, now.comp == merged.node, "left").select("fp", F.coalesce("root", "comp").alias("comp")), "groups")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, fp, version, group, component_id): component_id is the smallest id reachable over links."""
    scratch = Scratch(docs.sparkSession, "simhash")
    fp = scratch.keep(fingerprints(docs, id_col, text_col), "fingerprints")
    values = scratch.keep(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "values")
    roots = value_groups(values.select("fp"), scratch)
    named = values.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("group"))
    named = scratch.keep(named, "roots")
    lowest = named.groupBy("group").agg(F.min("low").alias("component_id"))
    by_value = named.join(lowest, "group").select("fp", "group", "component_id")
    return fp.join(by_value, "fp", "left").select("doc_id", "fp", "version", "group", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest id."""
    ids = simhash_groups(docs, id_col, text_col)
    out = ids.where("doc_id is not null and doc_id > component_id").select(F.col("doc_id").alias(OWN + "id")).distinct()
    named = docs.where(F.col(id_col).isNotNull())
    kept = named.join(out, named[id_col] == out[OWN + "id"], "left_anti")
    nameless = ids.where("doc_id is null and component_id is null").groupBy("group").agg(F.min("version").alias(OWN + "version"))
    rest = docs.where(F.col(id_col).isNull())
    return kept.unionAll(rest.join(nameless, F.xxhash64(rest[text_col]) == nameless[OWN + "version"], "left_semi"))
