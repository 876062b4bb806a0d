"""Document quality from a linear-chain conditional random field over lines.

Every non-empty line gets surface features of its own and of its neighbours; a
two-label chain (good, bad) gives each line its marginal probability by forward
and backward sums, and the mean of the marginals, weighted by line length, is
the document's quality, put on a probability scale by a logistic curve.

Only documents have labels, so the lines' labels are hidden.  Training starts
with each line under its document's label and then takes turns: the chain is
fitted to the lines' labels, and lines that the fitted chain firmly holds to be
of the other kind change over, up to half of a document's length.  So a good
document may hold bad lines, a bad one good lines, and the chain learns how
labels follow each other.

The model has about a hundred weights, fitted on the driver from a bounded sample
of labelled rows: those with the smallest hash of the id, ``MAX_TRAIN_DOCS`` at
most, and no more once they hold ``MAX_TRAIN_LINES`` lines.  Long texts take part
whole, as one chain each.  Scoring covers every row and the whole text.

Edge cases: null and empty texts, and texts of empty lines, have no line and
score the share of label 1 in the sample; a null id is never a training row; of repeated
labels the mean counts (0.5 and more is 1), of rows with the same id the one with
the smallest hash of the text; without labelled rows, or with one label only,
every score is that share (0.5 without any); a column named like the score is
replaced, other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethoflow.llm._common import OWN, let_go, small_batches

MAX_TRAIN_DOCS = 4000
MAX_TRAIN_LINES = 150_000
#: Lines of a chain that are summed in one go; blocks are joined exactly.
BLOCK = 256
STEPS, MORE_STEPS = 120, 40
#: Times that lines may change over, and how unlikely their label must be.
TURNS, UNLIKELY = 3, 0.2

# Classes of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 prose punctuation, 5 symbol, 6 space, 7 non-ASCII, 8 exclamation mark, 9 bar.
_CLASS = np.zeros(256, dtype=np.uint8)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 1), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b".,;:'\"-?()", 4), (b"#$%&*+/<=>@[\\]^_`{}~", 5), (b" \t\r\x0b\x0c", 6), (bytes(range(128, 256)), 7), (b"!", 8), (b"|", 9)):
    _CLASS[list(_chars)] = _k
_KINDS = 10
_ENDS = frozenset(b".?!\"')")

OWN_FEATURES = 18


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(features [line, OWN_FEATURES], lengths [line]) of the non-empty lines."""
    lines = [x for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n") if x.strip()]
    if not lines:
        return np.zeros((0, OWN_FEATURES), dtype=np.float32), np.zeros(0)
    sizes = np.array([len(x) for x in lines])
    kinds = _CLASS[np.frombuffer(b"".join(lines), dtype=np.uint8)]
    line_of = np.repeat(np.arange(len(lines)), sizes)
    counts = np.bincount(line_of * _KINDS + kinds, minlength=len(lines) * _KINDS).reshape(-1, _KINDS)
    share = counts / sizes[:, None]
    words = [x.split() for x in lines]
    n_words = np.array([len(w) for w in words])
    distinct = np.array([len(set(w)) for w in words]) / n_words
    steady = np.array([sum(a == b for a, b in zip(w, w[1:])) for w in words]) / n_words
    seen: set = set()
    repeated = []
    for x in lines:
        repeated.append(x in seen)
        seen.add(x)
    cased = counts[:, 1] + counts[:, 2] + 1
    out = np.empty((len(lines), OWN_FEATURES), dtype=np.float32)
    out[:, 0] = np.log1p(sizes)
    out[:, 1] = counts[:, 2] / cased
    out[:, 2:9] = share[:, 3:]
    out[:, 9] = (sizes - counts[:, 6]) / n_words / 10
    out[:, 10] = distinct
    out[:, 11] = np.log(n_words) * (1 - distinct)
    out[:, 12] = steady
    out[:, 13] = repeated
    out[:, 14] = [x.rstrip()[-1] in _ENDS for x in lines]
    out[:, 15] = [65 <= x.lstrip()[0] <= 90 or x.lstrip()[0] > 127 for x in lines]
    out[:, 16] = n_words < 4
    out[:, 17] = share[:, 5] + share[:, 8] + share[:, 9] > 0.08
    return out, sizes.astype(np.float64)


def with_neighbours(own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Features of each line, the line before and the line after (zeros at a document's ends), and two end flags."""
    n, k = own.shape
    out = np.zeros((n, 3 * k + 2), dtype=np.float64)
    first = np.zeros(n, dtype=bool)
    first[starts[starts < n]] = True
    last = np.roll(first, -1) if n else first
    out[:, :k] = own
    out[1:, k : 2 * k] = own[:-1]
    out[:-1, 2 * k : 3 * k] = own[1:]
    out[first, k : 2 * k] = 0
    out[last, 2 * k : 3 * k] = 0
    out[:, 3 * k], out[:, 3 * k + 1] = first, last
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # good against bad
    bias: float
    moves: np.ndarray  # [from, to], labels bad and good
    slope: float
    shift: float
    prior: float
    flat: bool = False

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = [line_features(t) for t in texts]
        return self.of_features(found)

    def raw(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log odds of the length-weighted mean marginal; NaN without lines."""
        sizes = np.array([len(x[1]) for x in found])
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        out = np.full(len(found), np.nan)
        if not sizes.sum():
            return out
        x = with_neighbours(np.concatenate([f[0] for f in found]), starts[sizes > 0])
        unary = ((x - self.mean) / self.scale) @ self.weights + self.bias
        good = marginals(unary, starts, sizes, self.moves)[0]
        weight = np.concatenate([f[1] for f in found])
        has = sizes > 0
        at = starts[has]
        odds = np.log(np.add.reduceat(weight * good, at) + 1e-6) - np.log(np.add.reduceat(weight * (1 - good), at) + 1e-6)
        out[has] = odds
        return out

    def of_features(self, found: list) -> np.ndarray:
        if self.flat:
            return np.full(len(found), self.prior)
        raw = self.raw(found)
        return np.where(np.isnan(raw), self.prior, _sigmoid(self.slope * raw + self.shift))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def marginals(unary: np.ndarray, starts: np.ndarray, sizes: np.ndarray, moves: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, float]:
    """(P(good) of each line, expected transitions [from, to], log of the chains' sums).

    The steps of a long chain are products of small matrices, so they may be grouped: chains are taken in blocks
    of lines, all blocks advance together for both labels that may lie outside, and then the blocks of a chain
    are joined in order.  The sums are those of whole chains.
    """
    has = sizes > 0
    starts, sizes = starts[has], sizes[has]
    phi = np.stack([np.zeros_like(unary), unary], axis=1)
    # The blocks, a chain's in order.
    per = -(-sizes // block)
    chain = np.repeat(np.arange(len(sizes)), per)
    place = np.arange(len(chain)) - np.repeat(np.cumsum(per) - per, per)
    begin = starts[chain] + place * block
    length = np.minimum(block, sizes[chain] - place * block)
    by_length = np.argsort(-length, kind="stable")
    longest = int(length.max()) if len(length) else 0
    live = np.searchsorted(-length[by_length], -np.arange(longest), side="left")  # blocks of more than t lines
    # [line, label outside the block, label of the line]
    into, onto = np.full((len(unary), 2, 2), -np.inf), np.full((len(unary), 2, 2), -np.inf)
    heads = place == 0
    for t in range(longest):
        which = by_length[: live[t]]
        at = begin[which] + t
        if t == 0:
            into[at] = np.where(heads[which][:, None, None], 0.0, moves[None]) + phi[at][:, None, :]
        else:
            before = into[at - 1]
            into[at] = phi[at][:, None, :] + np.logaddexp(before[:, :, :1] + moves[0], before[:, :, 1:] + moves[1])
    end = begin + length - 1
    onto[end] = np.where(np.eye(2, dtype=bool), 0.0, -np.inf)
    for t in range(2, longest + 1):  # lines from the block's end
        which = by_length[: live[t - 1]]
        at = end[which] - t + 1
        after = phi[at + 1][:, None, :] + onto[at + 1]  # [block, label at the block's end, label of the next line]
        onto[at] = np.logaddexp(after[:, :, :1] + moves[:, 0], after[:, :, 1:] + moves[:, 1])
    # Blocks of a chain in order, all chains together: what comes into a block, and what lies behind its end.
    left, right = np.zeros((len(chain), 2)), np.zeros((len(chain), 2))
    left[heads] = (0.0, -np.inf)  # no label comes before a chain: one way in
    by_place = np.argsort(place, kind="stable")
    rounds = np.split(by_place, np.flatnonzero(np.diff(place[by_place])) + 1) if len(place) else []
    for which in rounds[1:]:
        whole = into[end[which - 1]]
        left[which] = np.logaddexp(left[which - 1][:, :1] + whole[:, 0], left[which - 1][:, 1:] + whole[:, 1])
    for which in rounds[:0:-1]:
        whole = onto[begin[which]] + phi[begin[which]][:, None, :]  # [block, label at its end, label at its begin]
        over = np.logaddexp(whole[:, 0] + right[which][:, :1], whole[:, 1] + right[which][:, 1:])
        right[which - 1] = np.logaddexp(over[:, :1] + moves[:, 0], over[:, 1:] + moves[:, 1])
    block_of = np.repeat(np.arange(len(chain)), length)
    rows = np.repeat(begin, length) + np.arange(len(block_of)) - np.repeat(np.cumsum(length) - length, length)
    fwd, bwd = np.empty_like(phi), np.empty_like(phi)
    fwd[rows] = np.logaddexp(left[block_of][:, :1] + into[rows, 0], left[block_of][:, 1:] + into[rows, 1])
    bwd[rows] = np.logaddexp(right[block_of][:, :1] + onto[rows, 0], right[block_of][:, 1:] + onto[rows, 1])
    both = fwd + bwd
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(len(unary), dtype=bool)
    inner[starts] = False
    i = np.flatnonzero(inner)
    pair = np.zeros((2, 2))
    for a in range(2):
        for b in range(2):
            pair[a, b] = np.exp(fwd[i - 1, a] + moves[a, b] + phi[i, b] + bwd[i, b] - total[i]).sum()
    ends = starts + sizes - 1
    return good, pair, float(np.logaddexp(fwd[ends, 0], fwd[ends, 1]).sum())


def _maximised(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, theta: np.ndarray, steps: int, ridge: float) -> np.ndarray:
    """Weights of the highest likelihood of the lines' labels, by Adam from given ones."""
    starts = np.cumsum(sizes) - sizes
    inner = np.ones(len(y), dtype=bool)
    inner[starts] = False
    i = np.flatnonzero(inner)
    seen = np.bincount(2 * y[i - 1] + y[i], minlength=4).astype(np.float64)
    n = x.shape[1]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        good, pair, _ = marginals(x @ theta[:n] + theta[n], starts, sizes, theta[n + 1 :].reshape(2, 2))
        grad = np.concatenate([x.T @ (good - y), [(good - y).sum()], pair.ravel() - seen]) / len(y) + ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta


def changed_over(good: np.ndarray, document: np.ndarray, label: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Lines' labels: their document's, but for unlikely ones, the most unlikely first, up to half of its length."""
    own = np.where(label == 1, good, 1 - good)
    by = np.lexsort((own, document))
    w = np.where(own[by] < UNLIKELY, weight[by], 0.0)
    total = np.cumsum(w)
    first = np.flatnonzero(np.concatenate(([True], document[by][1:] != document[by][:-1])))
    before = np.repeat(total[first] - w[first], np.diff(np.append(first, len(by))))
    half = np.bincount(document, weights=weight)[document[by]] / 2
    y = label.copy()
    turned = by[(own[by] < UNLIKELY) & (total - before <= half)]
    y[turned] = 1 - y[turned]
    return y


def fit(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = STEPS, ridge: float = 1e-3) -> Model:
    """The chain and the lines' hidden labels in turns, then the logistic curve on the same rows."""
    prior = float(labels.mean()) if len(labels) else 0.5
    none = Model(np.zeros(1), np.ones(1), np.zeros(1), 0.0, np.zeros((2, 2)), 0.0, 0.0, prior, True)
    keep = [i for i, f in enumerate(found) if len(f[1])]
    if not keep or len(set(labels[keep].tolist())) < 2:
        return none
    found, y_doc = [found[i] for i in keep], labels[keep].astype(np.int64)
    sizes = np.array([len(f[1]) for f in found])
    x = with_neighbours(np.concatenate([f[0] for f in found]), np.cumsum(sizes) - sizes)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    document, weight = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([f[1] for f in found])
    label = y_doc[document]
    y, n = label, x.shape[1]
    theta = _maximised(x, y, sizes, np.zeros(n + 5), steps, ridge)
    for _ in range(TURNS):
        good, _, _ = marginals(x @ theta[:n] + theta[n], np.cumsum(sizes) - sizes, sizes, theta[n + 1 :].reshape(2, 2))
        new = changed_over(good, document, label, weight)
        if (new == y).all():
            break
        y = new
        theta = _maximised(x, y, sizes, theta, MORE_STEPS, ridge)
    model = Model(mean, scale, theta[:n], float(theta[n]), theta[n + 1 :].reshape(2, 2), 1.0, 0.0, prior)
    raw = model.raw(found)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton on two parameters
        p = _sigmoid(a * raw + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y_doc) * raw).sum() + 1e-2 * a, (p - y_doc).sum()])
        h = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -2, 2)
    model.slope, model.shift = float(max(a, 1e-3)), float(b)
    return model


def train(
    docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_docs: int = MAX_TRAIN_DOCS, max_lines: int = MAX_TRAIN_LINES,
) -> Model:
    """The model of a bounded sample of the rows for which ``usable`` (a condition on the id) holds."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(usable).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    sample = marks.withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(max_docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("version", F.xxhash64("text")).join(F.broadcast(sample), "id")
    lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0))
    sized = rows.groupBy("id", "order").agg(F.min(F.struct("version", lines.alias("lines"))).alias("v")).collect()  # max_docs rows at most
    chosen, total = [], 0
    for r in sorted(sized, key=lambda r: (r.order, r.id)):
        if total >= max_lines:
            break
        chosen.append((r.id, r.v.version))
        total += r.v.lines
    chosen = spark.createDataFrame(chosen, "id long, version long")
    rows = rows.join(F.broadcast(chosen), ["id", "version"]).dropDuplicates(["id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            found = [line_features(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), batch.column(2), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "own", "sizes"])

    got = rows.select("id", "text", "label").mapInArrow(run, "id long, label int, own binary, sizes binary").collect()
    got.sort(key=lambda r: r.id)
    found = [(np.frombuffer(r.own, dtype=np.float32).reshape(-1, OWN_FEATURES), np.frombuffer(r.sizes, dtype=np.float64)) for r in got]
    return fit(found, np.array([r.label for r in got], dtype=np.int64))


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = OWN + "quality") -> DataFrame:
    """The rows with the score, from 0 to 1, of the whole text."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            got = model.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
