"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised at byte level: A-Z become lower case and every ASCII byte
that is neither a letter nor a digit becomes a space, so a UTF-8 text keeps its
length and byte offsets map straight back to the original.  The automaton holds
all windows of ten item words; one scan of a document finds every occurrence.

The automaton is over words: it is built once, by one task, as packed arrays in
the shared folder, which all workers map (``automaton``).  Its size follows the
benchmark's, whatever that is, about 16 bytes a word and level; the documents
are scanned once, a batch of texts together.

Edge cases: null and empty texts have no words, so no hits; an item of one to
nine words is one window; items without words are ignored; a null ``item_id``
takes part in hits but not in the item list; repeated items count once; an
empty benchmark gives rows without hits; repeated documents come back as often
as they came; further columns, of any name, do no harm.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ethoflow.llm._common import OWN, Scratch, free_name, held, small_batches
from ethoflow.llm.automaton import Automaton, build

WINDOW = 10
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20

_WORD = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_NORMAL = bytes(b if b in _WORD else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SPANS = "array<struct<first_word:int,last_word:int,start:int,end:int>>"


def normalise(text: str | None) -> bytes:
    """The text as UTF-8, lower case, with a space for each byte outside words."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_NORMAL)


class Scanner:
    """The mapped automaton, and the texts of a batch scanned together."""

    def __init__(self, root: str) -> None:
        self.automaton = Automaton(root)

    def scan(self, texts: list[str | None]) -> list[tuple[int, list[int], list[tuple[int, int, int, int]]]]:
        """(words, items, spans as (first word, last word, start, end) with character offsets) of each text."""
        runs, sizes = [], []
        for text in texts:
            n = 0
            for words in pieces(normalise(text)):
                runs.append(self.automaton.numbers(words).astype(np.uint32))
                n += len(words)
            runs.append(np.zeros(1, dtype=np.uint32))  # no window reaches over a text's end
            sizes.append(n)
        starts = np.concatenate(([0], np.cumsum([n + 1 for n in sizes])))
        found = list(self.automaton.occurrences(np.concatenate(runs))) if runs else []
        out: list = [(n, [], []) for n in sizes]
        if not found:
            return out
        last, pattern = (np.concatenate([f[i] for f in found]).astype(np.int64) for i in (0, 1))
        by = np.argsort(last, kind="stable")
        last, pattern = last[by], pattern[by]
        doc = np.searchsorted(starts, last, side="right") - 1
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for part in np.split(np.arange(len(doc)), cuts):
            d = int(doc[part[0]])
            end = last[part] - starts[d] + 1
            kinds = np.unique(pattern[part])
            first = end - self.automaton.length[pattern[part]]
            out[d] = (sizes[d], self.automaton.owners(kinds), placed(texts[d], first, end))
        return out


def pieces(plain: bytes) -> Iterator[list[bytes]]:
    """The words of a normalised text, about PIECE bytes at a time."""
    at = 0
    while at < len(plain):
        cut = plain.find(b" ", at + PIECE)
        cut = cut if cut >= 0 else len(plain)
        yield plain[at:cut].split()
        at = cut


def placed(text: str | None, first: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Joined spans of words first to end - 1 with their character offsets in the text."""
    raw = np.frombuffer(normalise(text), dtype=np.uint8)
    inside = np.concatenate(([False], raw != 0x20, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)  # byte start and end of each word
    source = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    chars = np.concatenate(([0], np.cumsum((source & 0xC0) != 0x80)))  # characters before each byte
    ranges = sorted(set(zip(first.tolist(), end.tolist())))
    return merged([(a, b - 1, int(chars[edges[a, 0]]), int(chars[edges[b - 1, 1]])) for a, b in ranges])


def _scanner(root: str) -> Scanner:
    """One mapped automaton for each worker process."""
    return held(("decontaminate", root), lambda: Scanner(root))


def merged(spans: list[tuple]) -> list[tuple]:
    """Spans that touch or overlap by word number become one."""
    out: list[tuple] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), out[-1][2], max(out[-1][3], s[3]))
        else:
            out.append(s)
    return out


def compiled(benchmark: DataFrame, item_col: str, text_col: str) -> str:
    """The folder of the benchmark's automaton, written by one task (each attempt has its own folder)."""
    root = Scratch(benchmark.sparkSession, "decontaminate").root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{root}/{uuid.uuid4().hex}"
        items = ((i, normalise(t).split()) for batch in batches for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        build(own, items, WINDOW)
        yield pa.RecordBatch.from_arrays([pa.array([own])], names=["folder"])

    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    written = rows.repartition(1).mapInArrow(run, "folder string").collect()
    if not written:  # no task runs for a benchmark without rows
        build(f"{root}/empty", [], WINDOW)
        return f"{root}/empty"
    return written[0].folder


def _scanned(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str) -> tuple[DataFrame, list[str]]:
    """(the rows with n_words, items and spans under names of their own, these names)."""
    small_batches(docs.sparkSession)
    own = [free_name(docs, OWN + n) for n in ("words", "items", "spans")]
    root = compiled(benchmark, item_col, "text")
    names, at = docs.columns, docs.columns.index(text_col)
    fields = ("first_word", "last_word", "start", "end")
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([(n, pa.int32()) for n in fields]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scanner(root).scan(batch.column(at).to_pylist())
            cols = [[f[0] for f in found], [f[1] for f in found], [[dict(zip(fields, s)) for s in f[2]] for f in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*names, *own])

    more = [T.StructField(own[0], T.LongType()), T.StructField(own[1], T.ArrayType(T.LongType())), T.StructField(own[2], T._parse_datatype_string(SPANS))]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more])), own


def scan_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Rows (doc_id, n_words, n_hit, items, spans) for every document.

    spans: joined hit words, by word number and by character offset in the
    original text; items: sorted ids of the items with an occurring window.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned, (words, items, spans) = _scanned(rows, benchmark, "text", item_col)
    hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last_word"] - s["first_word"] + 1)
    return scanned.select("doc_id", F.col(words).alias("n_words"), hit.alias("n_hit"), F.col(items).alias("items"), F.col(spans).alias("spans"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The input rows in which no window of the benchmark occurs."""
    names = docs.columns
    scanned, (_, _, spans) = _scanned(docs, benchmark, text_col, item_col)
    return scanned.where(F.size(spans) == 0).select(*names)
