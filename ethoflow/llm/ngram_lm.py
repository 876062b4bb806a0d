"""Interpolated modified Kneser-Ney language model over words.

Counting.  Words are counted first, by hash, and numbered in each bucket from the
most frequent one down, so that common words have small ids.  N-grams of ids are
combined in each task and dealt by their inner words: an n-gram, its context (all
but the last word) and the n-gram one shorter (all but the first) meet in one
bucket, so one shuffle serves three tables, and with trigrams the bigrams need
none of their own.  What is dealt is sorted, delta-coded and compressed, about five
bytes a trigram.  Inner words that occur in more than ``SPLIT_TOKENS`` places are
spread over several buckets by their last word; their contexts' partial sums are
added in the last step, with the words' continuation counts.

Storage.  A bucket is one file in the shared folder with sorted hash arrays: an
index over the leading bits of the hashes, the next 40 bits of each, and the
counts, mostly in one byte.  An absent n-gram meets another's counts with a chance
of about 3e-11.  Tasks that score map these files into memory (``MAX_OPEN`` at
most, the least recently used are closed), so the model never has to fit in a
process and is never sent to one.  A file is written under another name and then
renamed; its content depends on the data alone, so a repeated or lost task does no
harm.  In a store without local paths a worker maps an unlinked local copy.

Tokens: A-Z in lower case, words between ASCII white space, then one end. The
first word's context is start marks, which are never predicted.

Edge cases: null and empty texts are one end token; repeated rows count as
often as they come; an empty training set leaves the uniform distribution over
one unknown word; further columns are ignored; a null condition counts as not
for training.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethoflow.llm._arrays import Buckets, bucket_of, groups_of, key_of, key_on, packed_columns, unpacked_columns, write_bucket
from ethoflow.llm._common import Scratch, small_batches

#: Length of the n-grams.
ORDER = 3
#: Bytes of text for each bucket: about 5 * 10^6 tokens.
BUCKET_BYTES = 32 << 20
#: Distinct words that a counting task combines at once.
COMBINE_WORDS = 400_000
#: Inner words that occur more often are spread over several buckets.
SPLIT_TOKENS = 1_000_000
START, END, UNKNOWN = np.uint64(0), np.uint64(1), np.uint64(1 << 62)
_FIRST = 2  # id of the first word


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def ngrams(flat: np.ndarray, sizes: np.ndarray, order: int) -> np.ndarray:
    """The n-gram that ends at each token, [tokens, order]."""
    ends = np.ones(len(flat), dtype=bool)
    starts = np.cumsum(sizes + order - 1) - (sizes + order - 1)
    for i in range(order - 1):
        ends[starts + i] = False
    at = np.flatnonzero(ends)
    return np.stack([flat[at - order + 1 + i] for i in range(order)], axis=1)


def combined(rows: np.ndarray, counts: np.ndarray, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, sums of counts [n, columns]), ordered by inner words, last word, first word.

    size: all numbers are below it, which saves ranking them.
    """
    if not len(rows):
        return rows, counts
    k = rows.shape[1]
    columns, ranks = [*range(1, k), 0], rows
    if size is None:
        distinct, ranks = np.unique(rows, return_inverse=True)
        size, ranks = len(distinct), ranks.reshape(rows.shape)  # ranks keep the order
    bits = max(1, (size - 1).bit_length())
    if bits * k <= 64:  # they fit in one number
        key = ranks[:, columns[0]].astype(np.uint64)
        for c in columns[1:]:
            key = key << np.uint64(bits) | ranks[:, c].astype(np.uint64)
        by = np.argsort(key)
        key = key[by]
        new = key[1:] != key[:-1]
    else:
        by = np.lexsort([ranks[:, c] for c in reversed(columns)])
        new = (ranks[by[1:]] != ranks[by[:-1]]).any(axis=1)
    first = np.flatnonzero(np.concatenate(([True], new)))
    return rows[by[first]], np.add.reduceat(counts[by], first, axis=0)


@dataclass
class Local:
    """The words of a batch or bucket by a small number: their ids in order, and how often they occur in training."""

    ids: np.ndarray
    counts: np.ndarray
    splits: np.ndarray  # over how many buckets the n-grams of an inner word are spread

    def key(self, rows: np.ndarray) -> np.ndarray:
        """The hash of each row of numbers."""
        out = self.first[rows[:, 0]]
        for k in range(1, rows.shape[1]):
            out = key_on(out, self.ids[rows[:, k]])
        return out

    @cached_property
    def first(self) -> np.ndarray:
        """The hash of each word alone."""
        return key_of(self.ids[:, None])

    def split(self, owner: np.ndarray) -> np.ndarray:
        return self.splits[owner[:, 0]] if owner.shape[1] == 1 else self.splits[owner].min(axis=1)

    def place(self, owner: np.ndarray, last: np.ndarray, buckets: int) -> np.ndarray:
        """The bucket of n-grams, by their owner and last word."""
        zero = np.uint64(0)
        if owner.shape[1] == 1:
            out = bucket_of(key_on(self.first, zero), buckets)[owner[:, 0]]
        else:
            out = bucket_of(key_on(self.key(owner), zero), buckets)
        spread = np.flatnonzero(self.split(owner) > 1)
        if len(spread):
            part = self.first[last[spread]] % self.split(owner[spread])
            out[spread] = bucket_of(key_on(self.key(owner[spread]), part), buckets)
        return out


@dataclass
class Words:
    """The table of words: ids by hash, counts by id."""

    files: Buckets
    documents: int
    tokens: int
    distinct: int
    split_tokens: int

    @property
    def buckets(self) -> int:
        return self.files.buckets

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full((len(hashes), 1), UNKNOWN, dtype=np.uint64)
        for b, at in groups_of(bucket_of(hashes, self.buckets)):
            self.files.open(b).find("ids", hashes[at], out, at)
        return out[:, 0]

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training tokens of each id; the start mark counts as often as the end."""
        out = np.zeros(len(ids), dtype=np.uint64)
        out[ids < _FIRST] = self.documents
        for b, at in groups_of(np.where(ids < _FIRST, self.buckets, np.where(ids == UNKNOWN, self.buckets, (ids - np.uint64(_FIRST)) % np.uint64(self.buckets))).astype(np.int64)):
            if b < self.buckets:
                out[at] = self.files.open(b).column("counts", ((ids[at] - np.uint64(_FIRST)) // np.uint64(self.buckets)).astype(np.int64))
        return out

    def local(self, ids: np.ndarray) -> Local:
        """For distinct ids in order."""
        counts = self.counts(ids)
        step = np.uint64(self.split_tokens)
        return Local(ids, counts, np.maximum(np.uint64(1), (counts + step - np.uint64(1)) // step))

    def tokens_of(self, texts: list[str | None], order: int) -> tuple[Local, np.ndarray, np.ndarray]:
        """(words, their numbers with order - 1 starts and one end for each text, tokens of each text)."""
        split = [words_of(t) for t in texts]
        distinct = list({w for words in split for w in words})
        ids, numbers = np.unique(np.concatenate([[START, END], self.ids(hashes_of(distinct))]), return_inverse=True)
        number = dict(zip(distinct, numbers[2:].tolist()))
        flat, sizes, pad, end = [], [], [int(numbers[0])] * (order - 1), int(numbers[1])
        for words in split:
            sizes.append(len(words) + 1)
            flat += pad
            flat += map(number.__getitem__, words)
            flat.append(end)
        return self.local(ids), np.array(flat, dtype=np.int64), np.array(sizes, dtype=np.int64)


def owner_of(rows: np.ndarray) -> np.ndarray:
    """The inner words of n-grams; of bigrams, the first word."""
    return rows[:, 1:-1] if rows.shape[1] > 2 else rows[:, :1]


def _sums(c: np.ndarray) -> np.ndarray:
    """Each count's part of its context's sums: total, and n-grams of count 1, 2, 3 and more."""
    return np.stack([c, c == 1, c == 2, c >= 3], axis=1).astype(np.uint64)


_SCHEMA, _NAMES = "kind string, bucket int, body binary", ["kind", "bucket", "body"]


def _body(rows: np.ndarray, counts: np.ndarray) -> bytes:
    """Rows in the order of ``combined``, coded by columns in that order."""
    k = rows.shape[1]
    return packed_columns([rows[:, c] for c in [*range(1, k), 0]], [counts[:, i] for i in range(counts.shape[1])])


def _rows(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, counts = unpacked_columns(body)
    return np.stack([rows[-1], *rows[:-1]], axis=1), np.stack(counts, axis=1)


def _dealt(words: Local, rows: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[tuple]:
    for b, at in groups_of(words.place(owner_of(rows), rows[:, -1], buckets)):
        yield f"g{rows.shape[1]}", b, _body(words.ids[rows[at]], counts[at])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"bucket": "int32"})


def _by_bucket(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    """The rows of each bucket in turn; rows come sorted by bucket, so only one bucket is held."""
    now, held = None, []
    for frame in frames:
        for kind, b, body in frame.itertuples(index=False, name=None):
            if b != now:
                if held:
                    yield now, held
                now, held = b, []
            held.append((kind, body))
    if held:
        yield now, held


def _each_bucket(rows: DataFrame, buckets: int, how, schema: str = _SCHEMA) -> DataFrame:
    """Applies ``how`` where all rows of a bucket are, a bucket at a time; a task has one bucket."""
    return rows.repartitionById(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(how, schema)


def _seen(level: int, c: np.ndarray) -> tuple:
    n = [*(int((c == i).sum()) for i in (1, 2, 3, 4)), int((c >= 3).sum()), int(c.sum())]
    return f"d{level}", 0, np.array(n, dtype="<u8").tobytes()


def count_words(rows: DataFrame, files: Buckets) -> tuple[int, int, int]:
    """Writes the words' tables; (documents, tokens, distinct words)."""
    buckets = files.buckets

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()

        def flush() -> pd.DataFrame:
            hashes, counts = hashes_of(list(held)), np.fromiter(held.values(), dtype=np.uint64, count=len(held))
            held.clear()
            out = []
            for b, at in groups_of(bucket_of(hashes, buckets)):
                by = np.argsort(hashes[at])
                out.append(("w", b, packed_columns([hashes[at][by]], [counts[at][by]])))
            return _frame(out)

        documents = 0
        for batch in batches:
            documents += batch.num_rows
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                if len(held) >= COMBINE_WORDS:
                    yield flush()
        if held:
            yield flush()
        yield _frame([("n", 0, np.array([documents], dtype="<u8").tobytes())])

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, parts in _by_bucket(frames):
            found = [unpacked_columns(body) for kind, body in parts if kind == "w"]
            documents = sum(int(np.frombuffer(body, dtype="<u8")[0]) for kind, body in parts if kind == "n")
            hashes = np.concatenate([f[0][0] for f in found]) if found else np.zeros(0, dtype=np.uint64)
            counts = np.concatenate([f[1][0] for f in found]) if found else hashes
            hashes, counts = combined(hashes[:, None], counts[:, None])
            rank = np.argsort(np.argsort(-counts[:, 0].astype(np.int64), kind="stable"), kind="stable")
            by_rank = np.zeros((len(rank), 1), dtype=np.uint64)
            by_rank[rank] = counts
            ids = _FIRST + rank.astype(np.uint64) * np.uint64(buckets) + np.uint64(b)
            write_bucket(files.uri(b), {"ids": (hashes[:, 0], ids[:, None]), "counts": (None, by_rank)})
            yield _frame([("s", b, np.array([documents, int(counts.sum()), len(hashes)], dtype="<u8").tobytes())])

    total = np.zeros(3, dtype=object)
    for row in _each_bucket(rows.mapInArrow(_arrow(count), _SCHEMA), buckets, add).collect():  # three numbers a bucket
        total += np.frombuffer(row.body, dtype="<u8").astype(object)
    return tuple(int(x) for x in total)


def _arrow(how):
    """A function that yields pandas frames, for Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in how(batches):
            yield pa.RecordBatch.from_pandas(frame, preserve_index=False)

    return run


@dataclass
class Model:
    """What a scoring task needs to know; the counts stay in the files."""

    words: Words
    files: dict[int, Buckets]  # n-grams by order, and contexts of owners in one bucket; bigrams are with the trigrams
    sums: Buckets  # contexts of spread owners, and the words' continuation counts
    order: int
    discounts: dict[int, tuple[float, float, float]]
    ends: int  # sum of the words' continuation counts
    lambda_1: float  # weight of the uniform distribution

    @property
    def tokens(self) -> int:
        return self.words.tokens

    def discounted(self, k: int, c: np.ndarray) -> np.ndarray:
        d = np.array([0.0, *self.discounts[k]])[np.minimum(c, 3).astype(np.int64)]
        return np.maximum(c.astype(np.float64) - d, 0.0)

    def continuations(self, ids: np.ndarray) -> np.ndarray:
        """Distinct words before each word."""
        out, keys = np.zeros((len(ids), 1), dtype=np.uint64), key_of(ids[:, None])
        for b, at in groups_of(bucket_of(keys, self.sums.buckets)):
            self.sums.open(b).find("n1", keys[at], out, at)
        return out[:, 0]

    def looked_up(self, words: Local, rows: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length of n-gram: counts, and sums [n, 4] of contexts. Trigrams come with their bigrams, which lie in the same buckets."""
        k = rows.shape[1]
        lengths = (3, 2) if k == 3 else (k,)
        n = {j: np.zeros((len(rows), 1), dtype=np.uint64) for j in lengths}
        sums = {j: np.zeros((len(rows), 4), dtype=np.uint64) for j in lengths}
        context = words.key(rows[:, :-1])
        keys = {k: key_on(context, words.ids[rows[:, -1]])}
        if k == 3:
            keys[2] = words.key(rows[:, 1:])
        owner = owner_of(rows)
        spread = words.split(owner) > 1
        for b, at in groups_of(words.place(owner, rows[:, -1], self.sums.buckets)):
            part = self.files[k].open(b)
            for j in lengths:
                part.find(f"n{j}", keys[j][at], n[j], at)
            whole = at[~spread[at]]
            part.find(f"c{k}", context[whole], sums[k], whole)
        parts = np.flatnonzero(spread)  # the owner of an n-gram ends its context
        for b, at in groups_of(bucket_of(context[parts], self.sums.buckets)):
            self.sums.open(b).find(f"c{k}", context[parts[at]], sums[k], parts[at])
        if k == 3:
            sums[2] = self.words_as_contexts(words)[rows[:, 1]]
        elif k == 2:
            sums[2] = self.words_as_contexts(words)[rows[:, 0]]
        return {j: (n[j][:, 0], sums[j]) for j in lengths}

    def words_as_contexts(self, words: Local) -> np.ndarray:
        """Sums [n, 4] of each word as the context of bigrams."""
        out, alone = np.zeros((len(words.ids), 4), dtype=np.uint64), np.arange(len(words.ids))
        whole, parts = np.flatnonzero(words.splits == 1), np.flatnonzero(words.splits > 1)
        for b, at in groups_of(words.place(alone[whole, None], alone[whole], self.sums.buckets)):
            self.files[2].open(b).find("c2", words.first[whole[at]], out, whole[at])
        for b, at in groups_of(bucket_of(words.first[parts], self.sums.buckets)):
            self.sums.open(b).find("c2", words.first[parts[at]], out, parts[at])
        return out

    def probabilities(self, words: Local, rows: np.ndarray) -> np.ndarray:
        """P(last word | the words before) for rows of numbers [n, order]."""
        p = np.full(len(words.ids), self.lambda_1 / (self.words.distinct + 1))
        if self.ends:
            p += self.discounted(1, self.continuations(words.ids)) / self.ends
        p = p[rows[:, -1]]
        found: dict = {}
        for k in range(min(self.order, 3), self.order + 1):
            found |= self.looked_up(words, rows[:, -k:])
        for k in range(2, self.order + 1):
            c, sums = found[k]
            total = sums[:, 0].astype(np.float64)
            back = sums[:, 1:].astype(np.float64) @ np.array(self.discounts[k])
            p = np.where(total > 0, (self.discounted(k, c) + back * p) / np.where(total > 0, total, 1.0), p)
        return p

    def scores(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        words, flat, sizes = self.words.tokens_of(texts, self.order)
        rows = ngrams(flat, sizes, self.order)
        at, last = np.cumsum(sizes) - sizes, rows[:, -1]
        base = np.log10((words.counts.astype(np.float64) + 0.5) / (self.tokens + 0.5 * (self.words.distinct + 1)))[last]
        log_p = np.log10(self.probabilities(words, rows))
        known = (words.counts > 0).astype(np.int64)[last]
        return {"n_tokens": sizes, "n_known": np.add.reduceat(known, at), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(log_p, at)}


def discounts_of(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of n-grams seen once to four times."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return (0.5, 1.0, 1.5) if n1 or n2 or n3 else (0.0, 0.0, 0.0)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw))


def train(docs: DataFrame, usable: Column, order: int = ORDER, text_col: str = "text", split_tokens: int = SPLIT_TOKENS) -> Model:
    """Counts the rows for which ``usable`` holds, and writes the model to the shared folder."""
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(usable).select(F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    scratch = Scratch(spark, "ngrams")
    table, sums = Buckets(f"{scratch.root}/words", buckets), Buckets(f"{scratch.root}/sums", buckets)
    files = {k: Buckets(f"{scratch.root}/ngrams{k}", buckets) for k in range(min(order, 3), order + 1)}
    files.setdefault(2, files[min(order, 3)])
    documents, tokens, distinct = count_words(rows, table)
    words = Words(table, documents, tokens + documents, distinct + (documents > 0), split_tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.num_rows:
                own, flat, sizes = words.tokens_of(batch.column(0).to_pylist(), order)
                rows = ngrams(flat, sizes, order)
                rows, counts = combined(rows, np.ones((len(rows), 1), dtype=np.uint64), len(own.ids))
                yield _frame(list(_dealt(own, rows, counts, buckets)))

    def adding(level: int):
        """Adds up the n-grams of one order in each bucket, writes them and deals what follows from them."""

        def tables(own: Local, rows: np.ndarray, counts: np.ndarray, sections: dict, out: list) -> None:
            k, size = rows.shape[1], len(own.ids)
            sections[f"n{k}"] = (own.key(rows), counts)
            contexts, parts = combined(rows[:, :-1], _sums(counts[:, 0]), size)
            keys, spread = own.key(contexts), own.split(contexts[:, 1:] if k > 2 else contexts) > 1
            sections[f"c{k}"] = (keys[~spread], parts[~spread])
            keys, parts = keys[spread], parts[spread]
            for b, at in groups_of(bucket_of(keys, buckets)):
                out.append((f"c{k}", b, packed_columns([keys[at]], list(parts[at].T))))
            out.append(_seen(k, counts[:, 0]))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b, parts in _by_bucket(frames):
                out = [(kind, 0 if kind[0] == "d" else b, body) for kind, body in parts if kind != f"g{level}"]
                found = [_rows(body) for kind, body in parts if kind == f"g{level}"]
                if found:
                    ids, rows = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
                    own, rows = words.local(ids), rows.reshape(-1, level)
                    rows, counts = combined(rows, np.concatenate([f[1] for f in found]), len(ids))
                    del found
                    sections: dict = {}
                    tables(own, rows, counts, sections, out)
                    one = np.ones((len(rows), 1), dtype=np.uint64)
                    if level > 2:  # all first words of a shorter n-gram are here
                        rows, counts = combined(rows[:, 1:], one, len(ids))
                        if level > 3:
                            out += _dealt(own, rows, counts, buckets)
                        else:
                            tables(own, rows, counts, sections, out)
                    if level <= 3:
                        last, befores = combined(rows[:, -1:], one[: len(rows)], len(ids))
                        keys = own.key(last)
                        for to, at in groups_of(bucket_of(keys, buckets)):
                            out.append(("n1", to, packed_columns([keys[at]], [befores[at, 0]])))
                    write_bucket(files[level].uri(b), sections)
                for row in out:
                    yield _frame([row])

        return run

    def add_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, parts in _by_bucket(frames):
            held: dict[str, list] = {}
            for kind, body in parts:
                if kind[0] == "d":
                    yield _frame([(kind, b, body)])
                else:
                    held.setdefault(kind, []).append(unpacked_columns(body))
            sections = {}
            for kind, found in held.items():
                keys, added = combined(np.concatenate([f[0][0] for f in found])[:, None], np.concatenate([np.stack(f[1], axis=1) for f in found]))
                sections[kind] = (keys[:, 0], added)
                if kind == "n1":
                    yield _frame([_seen(1, added[:, 0])])
            write_bucket(sums.uri(b), sections)

    dealt = rows.mapInArrow(_arrow(count), _SCHEMA)
    for level in range(order, 1 if order == 2 else 2, -1):
        dealt = _each_bucket(dealt, buckets, adding(level))
    # A few numbers for each bucket and order reach the driver.
    seen: dict[str, np.ndarray] = {}
    for kind, _, body in _each_bucket(dealt, buckets, add_sums).collect():
        seen[kind] = seen.get(kind, 0) + np.frombuffer(body, dtype="<u8").astype(object)
    levels = {k: seen.get(f"d{k}", np.zeros(6, dtype=object)).tolist() for k in range(1, order + 1)}
    discounts = {k: discounts_of(v[:4]) for k, v in levels.items()}
    n1, n2, _, _, more, ends = levels[1]
    d = discounts[1]
    return Model(words, files, sums, order, discounts, int(ends), (d[0] * n1 + d[1] * n2 + d[2] * more) / ends if ends else 1.0)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, train_tokens, base_score, score) for every document."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = sent.value.scores(batch.column(1).to_pylist())
            cols = [batch.column(0), *(pa.array(got[n]) for n in ("n_tokens", "n_known", "base_score", "score"))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long"))
