"""Hard-negative mining by a Voronoi-partition distributed join.

The best inner products become nearest neighbours once every row gets one more
component that brings all rows to the length of the longest, and every anchor
gets a zero there: |a - x|^2 = |a|^2 + M^2 - 2 a.x.  Rows are assigned to the
nearest of a set of pivots and packed, within a cell and by their distance from
its pivot, into blocks.  Anchors of one cell form groups.  By the triangle
inequality a block whose rows lie between two distances from its pivot can hold
rows of a given range of scores only for some anchors; Spark sends each block to
the groups that it might serve and to no others, and each group joins exactly,
in integers, with what came.

An anchor's positives are its best rows of its own label.  For each positive, its
negatives are the best rows of other labels whose score lies in a band, given as
two shares of the positive's score.  Both joins run in two steps: blocks of the
anchors' own cell first, which gives bounds that are tight enough to leave
blocks out, then the other blocks.  A task keeps the best rows of its anchors
only, so k rows an anchor (and positive) leave it.

Edge cases: rows with a null id, label or vector, an empty vector, or a null or
non-finite component take no part; vectors of different lengths never meet; rows
with the anchor's id are not among its others; repeated ids are separate rows,
and repeated anchors give their results as often; fewer rows than asked are all
returned; scores are exact at any size and are compared before those beyond a
long are shown as its ends; an empty table gives no rows; further columns, of
any name, do no harm.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ethoflow.llm._common import Scratch, small_batches

SCALE = 256
#: Rows of a block.
BLOCK_ROWS = 2048
#: Anchors of a group: cells with fewer are joined to their neighbours, cells with more are dealt to several groups.
GROUP_LEAST, GROUP_MOST = 128, 8192
#: Rows a pivot on average, and the most pivots on average; pivots are rows drawn by hash.
PIVOT_ROWS, MAX_PIVOTS = 4096, 256
#: Blocks that one task of a group reads on average, at most.
LANE_BLOCKS = 512
#: What rounding of distances may amount to, as a share of the lengths.
SLACK = 1e-9
#: Bytes of a score in an order of bytes.
WIDE = 48


def quantised(df: DataFrame, id_col: str, vec_col: str, label: Column, anchor: Column) -> DataFrame:
    """Rows (id, label, anchor, vec): whole components floor(SCALE * x), kept as double; unfit rows are left out."""
    vec = F.col(vec_col)
    fit = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & (F.size(vec) > 0)
    rows = df.where(F.col(id_col).isNotNull() & vec.isNotNull() & label.isNotNull()).where(fit)
    # The product is exact in a double (a power of two), and what is over 2^53 is whole already.
    whole = F.transform(vec, lambda x: _floor(x.cast("double") * SCALE))
    return rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), whole.alias("vec"), F.size(vec).alias("dims"))


def _floor(x: Column) -> Column:
    return F.when(F.abs(x) < float(1 << 53), F.floor(x).cast("double")).otherwise(x)


class Space:
    """Pivots and the length that all rows of one dimension are brought to."""

    def __init__(self, pivots: np.ndarray, longest: float) -> None:
        self.longest = longest
        self.points = self.lifted(pivots)

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        """Rows with their further component."""
        with np.errstate(over="ignore"):
            rest = np.sqrt(np.maximum(0.0, self.longest - (rows * rows).sum(axis=1)))
        return np.concatenate([rows, rest[:, None]], axis=1)

    def distances(self, points: np.ndarray) -> np.ndarray:
        """[row, pivot], by differences: expanding the square would lose small distances."""
        return np.stack([np.sqrt(((points - p) ** 2).sum(axis=1)) for p in self.points], axis=1)

    def of_anchors(self, rows: np.ndarray) -> np.ndarray:
        return self.distances(np.concatenate([rows, np.zeros((len(rows), 1))], axis=1))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


_FOUND = "dims int, team int, chunk int, key long, anchor long, place int, ordered binary, score long, id long"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _assigned(spaces: dict[int, Space]):
    """Rows with their cell and their distance from its pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("dims").to_numpy()
            for dims in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dims))
                space = spaces[dims]
                far = space.distances(space.lifted(_matrix(part.column("vec"))))
                cell = far.argmin(axis=1)
                yield part.append_column("cell", pa.array(cell.astype(np.int32))).append_column("far", pa.array(far[np.arange(len(far)), cell]))

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _small(rows: np.ndarray) -> tuple[str, bytes]:
    """Whole numbers in the smallest type that holds them."""
    top = float(np.abs(rows).max(initial=0.0))
    kind = next((k for k, most in (("<i1", 127), ("<i2", 32767), ("<i4", (1 << 31) - 1)) if top <= most), "<f8")
    return kind, rows.astype(kind).tobytes()


def _packed(by: tuple[str, ...], most: int | None):
    """Packs rows that come sorted into one block for each run of equal ``by``, of at most so many rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            rows = np.concatenate([h[1] for h in held])
            kind, vecs = _small(rows)
            nums, ids, labels, far = (np.concatenate([h[i] for h in held]) for i in range(2, 6))
            out = {n: [v] for n, v in zip(by, held[0][0])} | {"low": [float(far.min())], "high": [float(far.max())], "keys": [nums.tobytes()], "ids": [ids.tobytes()], "labels": [labels.tobytes()], "kind": [kind], "vecs": [vecs]}
            held.clear()
            return pa.RecordBatch.from_pydict(out, schema=_block_schema(by))

        for batch in batches:
            group = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in by], axis=1)
            cuts = np.flatnonzero((np.diff(group, axis=0) != 0).any(axis=1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)]):
                while begin < end:
                    key = tuple(group[begin].tolist())
                    if held and held[0][0] != key:
                        yield block()
                    room = end - begin if most is None else most - sum(len(h[2]) for h in held)
                    stop = min(end, begin + room)
                    part = batch.slice(begin, stop - begin)
                    held.append((key, _matrix(part.column("vec")), *(part.column(c).to_numpy() for c in ("num", "id", "label", "far"))))
                    if most is not None and stop - begin == room:
                        yield block()
                    begin = stop
        if held:
            yield block()

    return run


def _block_schema(by: tuple[str, ...]) -> pa.Schema:
    return pa.schema([*((n, pa.int32()) for n in by), ("low", pa.float64()), ("high", pa.float64()), *((n, pa.binary()) for n in ("keys", "ids", "labels")), ("kind", pa.string()), ("vecs", pa.binary())])


def _block_ddl(by: tuple[str, ...]) -> str:
    return ", ".join(f"{n} int" for n in by) + ", low double, high double, keys binary, ids binary, labels binary, kind string, vecs binary"


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products [anchor, row] of whole numbers: doubles while they hold them, else Python integers."""
    a, b = (float(np.abs(x).max(initial=0.0)) for x in (anchors, rows))
    if a * b * anchors.shape[1] < float(1 << 53):
        return (anchors @ rows.T).astype(np.int64)
    whole = [np.array([int(v) for v in x.ravel().tolist()], dtype=object).reshape(x.shape) for x in (anchors, rows)]
    return whole[0] @ whole[1].T


class Best:
    """The k best (score, id) so far; ties go to smaller ids.  The rows of a block are offered at once."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, []

    def offer(self, found: np.ndarray, ids: np.ndarray, fit: np.ndarray) -> None:
        at = np.flatnonzero(fit if len(self.held) < self.k else fit & (found >= self.held[-1][0]).astype(bool))
        if len(at) > 4 * self.k and found.dtype != object:  # the block's own k-th best bounds what can stay
            at = at[found[at] >= np.partition(found[at], len(at) - self.k)[len(at) - self.k]]
        if len(at):
            self.held = heapq.nsmallest(self.k, [*self.held, *((int(found[i]), int(ids[i])) for i in at)], key=lambda x: (-x[0], x[1]))


def band(positive: int, low: tuple[int, int], high: tuple[int, int]) -> tuple[int, int]:
    """The least and greatest whole score between two shares (numerator, denominator) of a positive's score."""
    return -(-low[0] * positive // low[1]), high[0] * positive // high[1]


def _bytes_of(score: int) -> bytes:
    return (score + (1 << 8 * WIDE - 1)).to_bytes(WIDE, "big")


def _score_of(ordered: bytes) -> int:
    return int.from_bytes(ordered, "big") - (1 << 8 * WIDE - 1)


def _joined(k: int, same: bool):
    """Joins a group's anchors, which come first, with the blocks sent to it; only the k best for each band leave."""
    schema = pa.schema([("dims", pa.int32()), ("team", pa.int32()), ("chunk", pa.int32()), ("key", pa.int64()), ("anchor", pa.int64()), ("place", pa.int32()), ("ordered", pa.binary()), ("score", pa.int64()), ("id", pa.int64())])
    floor, top = -(1 << 63), (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, best = None, {}
        keys = ids = labels = rows = asks = None

        def results() -> Iterator[pa.RecordBatch]:
            out = [(*task[:3], int(keys[i]), int(ids[i]), place, _bytes_of(x), min(max(x, floor), top), who) for (i, place), b in best.items() for x, who in b.held]
            if out:
                yield _table(out, schema)

        for batch in batches:
            for r in range(batch.num_rows):
                v = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                own_ids, own_labels = (np.frombuffer(v[n], dtype=np.int64) for n in ("ids", "labels"))
                own = np.frombuffer(v["vecs"], dtype=v["kind"]).astype(np.float64).reshape(-1, v["dims"])
                now = (v["dims"], v["team"], v["chunk"], v["lane"])
                if v["asks"] is not None:
                    yield from results()
                    task, best = now, {}
                    keys, ids, labels, rows, asks = np.frombuffer(v["keys"], dtype=np.int64), own_ids, own_labels, own, json.loads(v["asks"])
                    continue
                if now != task:
                    continue  # anchors sort first, so this group has none
                for begin in range(0, len(keys), 512):  # bounds the matrix of scores
                    found = scores(rows[begin : begin + 512], own)
                    for i, line in enumerate(found, begin):
                        if not asks[i]:
                            continue
                        alike = own_labels == labels[i]
                        fits = (own_ids != ids[i]) & (alike if same else ~alike)
                        for place, (low, high) in enumerate(asks[i]):
                            fit = fits if low is None else fits & ((line >= low) & (line <= high)).astype(bool)
                            if fit.any():
                                best.setdefault((i, place), Best(k)).offer(line, own_ids, fit)
        if task is not None:
            yield from results()

    return run


def _asked(low: tuple[int, int], high: tuple[int, int], positives: int):
    """Groups with what their anchors ask for, after the positives (None: the best of all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asks = []
            for keys, held in zip(batch.column("keys").to_pylist(), batch.column("held").to_pylist()):
                by = {}
                for h in sorted(held or (), key=lambda h: h["rank"]):
                    by.setdefault(h["key"], []).append(band(_score_of(h["ordered"]), low, high))
                asks.append(json.dumps([by.get(key, []) for key in np.frombuffer(keys, dtype=np.int64).tolist()]))
            yield batch.drop_columns(["held"]).append_column("asks", pa.array(asks, pa.string()))

    return run


def _bounds(spaces: dict[int, Space], k: int):
    """For each group and pivot, which blocks may serve: (dims, team, cell, near, wide, out).

    A block with rows between low and high from the pivot may serve if high >= near, low <= wide and high >= out.
    """
    schema = pa.schema([("dims", pa.int32()), ("team", pa.int32()), ("cell", pa.int32()), ("near", pa.float64()), ("wide", pa.float64()), ("out", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                v = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                rows = np.frombuffer(v["vecs"], dtype=v["kind"]).astype(np.float64).reshape(-1, v["dims"])
                full: dict[tuple, list[int]] = {}
                for h in v["held"] or ():
                    full.setdefault((h["key"], h["place"]), []).append(_score_of(h["ordered"]))
                least, most = np.full(len(rows), np.inf), np.full(len(rows), -np.inf)
                for i, (key, asks) in enumerate(zip(np.frombuffer(v["keys"], dtype=np.int64).tolist(), json.loads(v["asks"]))):
                    for place, (low, high) in enumerate(asks):
                        if low is not None and low > high:
                            continue
                        known = full.get((key, place), ())
                        least[i] = min(least[i], float(min(known)) if len(known) == k else -np.inf if low is None else float(low))
                        most[i] = max(most[i], np.inf if high is None else float(high))
                needed = least < np.inf
                if not needed.any():
                    continue
                space, rows, least, most = spaces[v["dims"]], rows[needed], least[needed], most[needed]
                square = (rows * rows).sum(axis=1) + space.longest
                slack = SLACK * np.sqrt(square)
                with np.errstate(invalid="ignore", over="ignore"):
                    far = np.sqrt(np.maximum(0.0, square * (1 + SLACK) - 2 * least)) + slack
                    close = np.sqrt(np.maximum(0.0, square * (1 - SLACK) - 2 * most)) - slack
                to = space.of_anchors(rows)
                near, wide, out = (to - far[:, None] - slack[:, None]).min(axis=0), (to + far[:, None] + slack[:, None]).max(axis=0), (close[:, None] - to - slack[:, None]).min(axis=0)
                yield _table([(v["dims"], v["team"], c, *map(float, x)) for c, x in enumerate(zip(near, wide, out))], schema)

    return run


def _chain(points: np.ndarray) -> list[int]:
    """Pivots in an order in which each is followed by the nearest one left."""
    left, order = set(range(len(points))), []
    while left:
        at = min(left) if not order else min(left, key=lambda j: (float(((points[j] - points[order[-1]]) ** 2).sum()), j))
        left.remove(at)
        order.append(at)
    return order


def teams(counts: dict[tuple[int, int], int], spaces: dict[int, Space], least: int) -> dict[tuple[int, int], int]:
    """The team of each (dims, cell): neighbouring cells until they have enough anchors."""
    out = {}
    for dims, space in spaces.items():
        team = held = 0
        for cell in _chain(space.points):
            out[dims, cell] = team
            held += counts.get((dims, cell), 0)
            if held >= least:
                team, held = team + 1, 0
    return out


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100),
    id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None, pivot_rows: int = PIVOT_ROWS, block_rows: int = BLOCK_ROWS, group_least: int = GROUP_LEAST,
) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    spark = vectors.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "negatives")
    rows = quantised(vectors, id_col, vec_col, F.col("label") if label is None else label, is_anchor)
    spaces = _spaces(rows, pivot_rows)
    assigned = scratch.keep(rows.mapInArrow(_assigned(spaces), "id long, label long, anchor boolean, vec array<double>, dims int, cell int, far double").withColumn("num", F.monotonically_increasing_id()), "rows")
    # A block's rows are near each other in distance from the pivot; ranges split a cell with very many rows.
    by = ("dims", "cell")
    dealt = assigned.repartitionByRange(*by, "far", "num").sortWithinPartitions(*by, "far", "num")
    blocks = scratch.keep(dealt.mapInArrow(_packed(by, block_rows), _block_ddl(by)).drop("keys"), "blocks")
    lanes = max(1, -(-blocks.count() // LANE_BLOCKS))

    anchors = assigned.where("anchor")
    counts = {(r[0], r[1]): r[2] for r in anchors.groupBy(*by).agg(F.count("*")).collect()}  # a number a cell
    team_of = teams(counts, spaces, group_least)
    of_team: dict[tuple[int, int], int] = {}
    for at, n in counts.items():
        of_team[at[0], team_of[at]] = of_team.get((at[0], team_of[at]), 0) + n
    listed = [(d, c, t, max(1, -(-of_team.get((d, t), 0) // GROUP_MOST))) for (d, c), t in team_of.items()]
    cells = F.broadcast(spark.createDataFrame(listed, "dims int, cell int, team int, chunks int"))
    groups = anchors.join(cells, [*by]).withColumn("chunk", F.pmod("num", "chunks").cast("int"))
    unit = ("dims", "team", "chunk")
    groups = groups.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(_packed(unit, None), _block_ddl(unit)).drop("low", "high")
    groups = scratch.keep(groups, "groups")
    sent = blocks.join(cells.select("dims", "cell", F.col("team").alias("home")), [*by]).withColumn("lane", F.pmod(F.xxhash64("ids", "low"), F.lit(lanes)).cast("int"))
    chunks = F.broadcast(spark.createDataFrame(sorted({(d, t, n) for d, _, t, n in listed if of_team.get((d, t))}), "dims int, team int, chunks int"))
    each_lane = F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane")
    payload = ["ids", "labels", "kind", "vecs"]

    def join(asking: DataFrame, routed: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        """routed: blocks with the team that each is sent to."""
        none = F.lit(None)
        left = asking.select(*unit, each_lane, "keys", *payload, "asks")
        right = routed.join(chunks, ["dims", "team"]).select("dims", "team", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "lane", none.cast("binary").alias("keys"), *payload, none.cast("string").alias("asks"))
        met = left.unionAll(right).repartition(*unit, "lane").sortWithinPartitions(*unit, "lane", F.col("asks").isNull())
        return scratch.keep(met.mapInArrow(_joined(k, same), _FOUND), name)

    def best(found: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("key", "place").orderBy(F.desc("ordered"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def held(found: DataFrame) -> DataFrame:
        """What each group's anchors have found, at most k for each of their bands."""
        return found.groupBy(*unit).agg(F.collect_list(F.struct("key", "place", "rank", "ordered")).alias("held"))

    def both(asking: DataFrame, k: int, same: bool, name: str) -> DataFrame:
        near = join(asking, sent.withColumn("team", F.col("home")), k, same, f"{name}-home")
        known = asking.join(held(best(near, k)), [*unit], "left")
        ddl = "dims int, team int, cell int, near double, wide double, out double"
        limits = known.mapInArrow(_bounds(spaces, k), ddl).groupBy("dims", "team", "cell").agg(F.min("near").alias("near"), F.max("wide").alias("wide"), F.min("out").alias("out"))
        limits = F.broadcast(scratch.keep(limits, f"{name}-bounds"))  # a row for each team and pivot
        routed = sent.join(limits, [*by]).where("team <> home and high >= near and low <= wide and high >= out")
        return best(near.unionAll(join(asking, routed, k, same, f"{name}-rest")), k)

    every = F.to_json(F.array_repeat(F.array(F.array(F.lit(None).cast("long"), F.lit(None).cast("long"))), (F.octet_length("keys") / 8).cast("int")))
    found = scratch.keep(both(groups.withColumn("asks", every), positives, True, "positives"), "positives")
    ddl = "dims int, team int, chunk int, keys binary, ids binary, labels binary, kind string, vecs binary, held array<struct<key:long,place:int,rank:int,ordered:binary>>"
    asking = groups.join(held(found), [*unit], "left")
    asking = scratch.keep(asking.select(*[c.split(" ")[0] for c in ddl.split(", ")]).mapInArrow(_asked(low, high, positives), ddl.rsplit(", ", 1)[0] + ", asks string"), "asking")
    other = both(asking, negatives, False, "negatives")
    chosen = found.select("key", (F.col("rank") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return other.join(chosen, ["key", "place"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _spaces(rows: DataFrame, pivot_rows: int) -> dict[int, Space]:
    """Pivots for each length of vectors: rows drawn by their hash, so many on average and one at least."""
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    draw = F.xxhash64("id", "vec")
    known = rows.groupBy("dims").agg(F.count("*").alias("n"), F.max(square).alias("longest"), F.min_by("vec", F.struct(draw, "vec")).alias("first")).collect()
    shares = {r.dims: min(r.n / pivot_rows, MAX_PIVOTS) / r.n for r in known}
    pivots = {r.dims: [r.first] for r in known}
    if known:
        share = F.create_map(*(F.lit(x) for d, s in shares.items() for x in (d, s)))[F.col("dims")]
        drawn = rows.where(F.pmod(draw, F.lit(1 << 30)) < share * float(1 << 30)).select("dims", "vec").distinct()
        for r in drawn.collect():
            pivots[r.dims].append(r.vec)
    return {r.dims: Space(np.array(sorted(set(map(tuple, pivots[r.dims]))), dtype=np.float64), r.longest) for r in known}
