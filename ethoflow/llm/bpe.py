"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

A text is cut by the tokenizer's pattern; each match goes through a
finite-state transducer that reads bytes and writes tokens.  For every prefix
of the input the last token of its encoding is fixed by local checks: a token
that ends here is the last one exactly if the encoding up to its start ends in
a token that may stand before it (the merges leave the two apart).  A state of
the determinised machine holds all starts from which some token may still grow,
each with the token before it; a transition writes the last token of the prefix
it completes.  Tokens on which all starts agree are emitted, so output lags by
a bounded lookahead.  States and transitions are built when first met and kept
up to a bound; beyond it the table starts afresh.

Encoded runs of non-space characters are memoised under a bound in bytes.

Edge cases: a null text encodes like the empty one, to no ids; further columns
pass through; a column named like the output is replaced; an empty table gives
no rows; ids outside the vocabulary raise ``KeyError`` on decoding; bytes that
are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ethoflow.llm._common import held, small_batches

#: States of a worker's machine, about 400 bytes each with their transitions.
MAX_STATES = 250_000
#: The table of remembered pairs of tokens has 2 ** PAIR_BITS places of 8 bytes.
PAIR_BITS = 19
#: Bytes of each of the memo's two halves.
MEMO_BYTES = 24 << 20
#: Bytes that a run takes in the memo besides its characters and ids.
MEMO_ENTRY = 200
#: Bytes between two looks at what is settled.
LOOK = 1024
_NEVER = 1 << 60
_32, _64 = (1 << 32) - 1, (1 << 64) - 1
_SPREAD = 0x9E3779B97F4A7C15
#: Longer runs are not memoised.
MEMO_CHARS = 64

#: Fixed value: the pattern whose matches are known to keep to runs of white space and of other characters.
PROSE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode White_Space, which the pattern's \s stands for in the tokenizer's own library.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


#: Code points that became letters or numbers after Unicode 16, which the tokenizer's own library follows; first and last of each range.
_NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1),
    (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
    (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD),
    (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


class Transducer:
    """Encodes one match of the pattern, given as bytes.

    All tables are packed: the trie is one dict from (node, byte) to node, a state is a number whose starts are
    kept as bytes, and a transition is one integer, so a worker with full tables takes about 130 MB.
    """

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = words_by_rank(ranks)
        self._size = array("H", [0 if w is None else len(w) for w in self.token])
        # Order of pairs of tokens, in a table of fixed size: a pair met later may take another's place.
        self._pairs = array("Q", bytes(8 << PAIR_BITS))
        self._ends: dict[int, tuple | None] = {}
        # The trie of the vocabulary; accepting nodes carry their token, others -1.
        self._edges: dict[int, int] = {}
        self._accepts, self._depth, self._inner = array("i", [-1]), array("H", [0]), bytearray(b"\1")
        for word, rank in ranks.items():
            node = 0
            for depth, b in enumerate(word, 1):
                self._inner[node] = 1
                nxt = self._edges.get(node << 8 | b)
                if nxt is None:
                    nxt = self._edges[node << 8 | b] = len(self._accepts)
                    self._accepts.append(-1)
                    self._depth.append(depth)
                    self._inner.append(0)
                node = nxt
            self._accepts[node] = rank
        self._reset()

    def _reset(self) -> None:
        self._numbers: dict[bytes, int] = {}
        self._states: list[bytes] = []  # starts of a state, earliest first: trie node << 32 | last token before it + 1
        self._next: dict[int, int] = {}  # state << 8 | byte -> state << 32 | last token of the prefix that ends here + 1
        self._state(bytes(8))

    def _state(self, starts: bytes) -> int:
        found = self._numbers.get(starts)
        if found is None:
            found = self._numbers[starts] = len(self._states)
            self._states.append(starts)
        return found

    def _merged(self, word: bytes, stop: int = 1) -> list[bytes]:
        """What the merges make of a short word: lowest rank first, leftmost on ties."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > stop:
            rank, i = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == _NEVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spines(self, token: int) -> tuple[tuple, tuple] | None:
        """The tokens that the merges make at the left and right end of a token, from byte to whole; None if they never make it."""
        found = self._ends.get(token, 0)
        if found == 0:
            word, found = self.token[token], None
            halves = self._merged(word, 2)
            if len(word) == 1:
                found = ((token,), (token,))
            elif len(halves) == 2 and self.ranks.get(halves[0] + halves[1]) == token:
                left, right = self.ranks[halves[0]], self.ranks[halves[1]]
                if max(left, right) >= token:
                    raise ValueError(f"rank {token} is below those of its parts")
                found = ((*self._spines(left)[0], token), (*self._spines(right)[1], token))
            self._ends[token] = found
        return found

    def _apart(self, before: int, token: int) -> bool:
        """Whether the merges, in order of rank, never join a token's end and the next one's start."""
        left, right = self._spines(before), self._spines(token)
        if right is None or left is None:
            return False
        xs, ys = (*left[1], _NEVER), (*right[0], _NEVER)
        words, rank_of = self.token, self.ranks.get
        i = j = 0
        while True:
            joint = rank_of(words[xs[i]] + words[ys[j]], _NEVER)
            # On equal ranks the pair further left is merged first.
            if joint < xs[i + 1] and joint <= ys[j + 1] and joint != _NEVER:
                return False
            if xs[i + 1] == ys[j + 1] == _NEVER:
                return True
            if xs[i + 1] <= ys[j + 1]:
                i += 1
            else:
                j += 1

    def _may_follow(self, before: int, token: int) -> bool:
        """before: the last token plus 1, or 0."""
        key = before << 32 | token << 2 | 2
        at = (key * _SPREAD & _64) >> 64 - PAIR_BITS
        held = self._pairs[at]
        if held | 1 == key | 1:
            return held & 1 == 1
        found = self._apart(before - 1, token) if before else self._spines(token) is not None
        self._pairs[at] = key | found
        return found

    def _step(self, state: int, byte: int) -> int:
        grown, last = array("Q"), 0
        child_of, accepts, inner = self._edges.get, self._accepts, self._inner
        for start in memoryview(self._states[state]).cast("Q"):
            child = child_of(start >> 32 << 8 | byte)
            if child is None:
                continue
            if not last:
                token = accepts[child]
                if token >= 0 and self._may_follow(start & _32, token):
                    last = token + 1
            if inner[child]:
                grown.append(child << 32 | start & _32)
        grown.append(last)
        step = self._next[state << 8 | byte] = self._state(grown.tobytes()) << 32 | last
        return step

    def _walk(self, piece: bytes, state: int, lasts: list[int]) -> int:
        """The state after the piece; the last token of each prefix, plus 1, is added to ``lasts``."""
        known, make, put = self._next.get, self._step, lasts.append
        for byte in piece:
            step = known(state << 8 | byte) or make(state, byte)
            put(step & _32)
            state = step >> 32
        return state

    def stream(self, piece: bytes) -> Iterator[list[int]]:
        """The piece's tokens, in runs: each as soon as every way on from here agrees on it (looked at every LOOK bytes)."""
        self._bound()
        state, size, lasts = 0, self._size, []
        for at in range(0, len(piece), LOOK):
            if len(self._states) > MAX_STATES:  # the tables start afresh from the state that the piece is in
                starts = self._states[state]
                self._reset()
                state = self._state(starts)
            state = self._walk(piece[at : at + LOOK], state, lasts)
            fixed = len(lasts)
            if at + LOOK < len(piece):
                # Every token to come starts at one of these; where their pasts meet, all before is settled.
                live = {fixed - self._depth[start >> 32] for start in memoryview(self._states[state]).cast("Q")}
                while len(live) > 1:
                    furthest = max(live)
                    live.remove(furthest)
                    live.add(furthest - size[lasts[furthest - 1] - 1])
                fixed = live.pop()
            yield self._back(lasts, fixed)
            lasts = lasts[fixed:]

    def _back(self, lasts: list[int], end: int) -> list[int]:
        out, size = [], self._size
        while end:
            token = lasts[end - 1] - 1
            out.append(token)
            end -= size[token]
        out.reverse()
        return out

    def _bound(self) -> None:
        # A piece adds a few states for each of its bytes at most.
        if len(self._states) > MAX_STATES:
            self._reset()

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)  # the library looks up a whole match first
        if whole is not None:
            return [whole]
        if len(piece) > LOOK:
            return [i for run in self.stream(piece) for i in run]
        self._bound()
        known, make, state, lasts = self._next.get, self._step, 0, []
        for byte in piece:
            step = known(state << 8 | byte) or make(state, byte)
            lasts.append(step & _32)
            state = step >> 32
        return self._back(lasts, len(piece))


class Utf8Stream:
    """Incremental UTF-8 decoding: bytes come in blocks of any size.

    The state is the unfinished sequence at the end of what was fed, at most
    three bytes.
    """

    def __init__(self) -> None:
        self._tail = b""

    def feed(self, block: bytes) -> str:
        block = self._tail + block
        cut = len(block)
        for back in range(1, min(3, len(block)) + 1):
            lead = block[-back]
            if lead & 0xC0 == 0x80:
                continue  # inside a sequence
            need = 2 if lead >> 5 == 0b110 else 3 if lead >> 4 == 0b1110 else 4 if lead >> 3 == 0b11110 else 1
            if need > back:
                cut -= back
            break
        self._tail = block[cut:]
        return block[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self._tail = self._tail, b""
        return rest.decode("utf-8", "replace")


def words_by_rank(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The token of each rank; None where there is none."""
    out: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for word, rank in ranks.items():
        out[rank] = word
    return out


class Tokenizer:
    """Text to ids (packed as little-endian unsigned 32-bit) and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        space = f"[{_SPACE}]"
        own = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", space)
        self._find = regex.compile(own)
        self._newer = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _NEWER) + "]")
        # Matches of this pattern never span a border between a space run and what follows but for one leading blank;
        # of another pattern, nothing is known, and a text is one run.
        self._prose = pattern == PROSE_PATTERN
        self._runs = re.compile(f" ?[^{_SPACE}]+|{space}+(?![^{_SPACE}])|{space}+" if self._prose else "(?s:.+)").findall
        self._ranks = ranks
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._held = 0

    @cached_property
    def _words(self) -> tuple[np.ndarray, np.ndarray]:
        """The token of each rank, and whether there is one."""
        words = np.array([*words_by_rank(self._ranks), None], dtype=object)[:-1]
        return words, np.array([w is not None for w in words], dtype=bool)

    @cached_property
    def transducer(self) -> Transducer:
        return Transducer(self._ranks)  # decoding needs none

    def _pieces(self, run: str) -> list[str]:
        if run.isascii() or not self._newer.search(run):
            return self._find.findall(run)
        return [run[m.start() : m.end()] for m in self._find.finditer(self._newer.sub("\ue000", run))]

    def _encode_run(self, run: str) -> bytes:
        packed = self._older.get(run)
        if packed is None:
            # One match of the pattern, as it is for most words, needs no search for more.
            word = self._prose and (run.isalpha() or (run[0] == " " and run[1:].isalpha()))
            pieces = [run] if word else self._pieces(run)
            if len(pieces) == 1:
                ids = self.transducer.encode(run.encode("utf-8", "surrogatepass"))
            else:
                ids = [i for piece in pieces for i in self.transducer.encode(piece.encode("utf-8", "surrogatepass"))]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(run) <= MEMO_CHARS:
            if self._held >= MEMO_BYTES:
                self._older, self._memo, self._held = self._memo, {}, 0  # what is met again moves back to the younger half
            self._memo[run] = packed
            self._held += MEMO_ENTRY + len(run) + len(packed)
        return packed

    def encode(self, text: str | None) -> bytes:
        known, run, out = self._memo.get, self._encode_run, []
        for r in self._runs(text or ""):
            packed = known(r)
            if packed is None:
                packed = run(r)
                known = self._memo.get
            out.append(packed)
        return b"".join(out)

    def decode_stream(self, ids: Iterable[int], block: int = 4096) -> Iterator[str]:
        """Pieces of text, each as soon as its bytes are complete."""
        stream, (words, there) = Utf8Stream(), self._words
        rest = iter(()) if isinstance(ids, np.ndarray) else iter(ids)
        blocks = (ids[at : at + block] for at in range(0, len(ids), block)) if isinstance(ids, np.ndarray) else iter(lambda: list(islice(rest, block)), [])
        for some in map(np.asarray, blocks):
            if some.min() < 0 or some.max() >= len(words) or not there[some].all():
                raise KeyError("an id outside the vocabulary")
            yield stream.feed(b"".join(words[some].tolist()))
        yield stream.end()

    def decode(self, packed: bytes | None) -> str:
        return "".join(self.decode_stream(np.frombuffer(packed or b"", dtype="<u4")))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _tokenizer(key: str, ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """One tokenizer, with its states and memo, for each worker process."""
    return held(("bpe", key), lambda: Tokenizer(ranks, pattern))


def _mapped(df: DataFrame, source: str, new: list[tuple[T.StructField, pa.DataType]], path: str, pattern: str, how: Callable) -> DataFrame:
    """The rows with new columns, which ``how`` makes of the tokenizer and the source column's values."""
    small_batches(df.sparkSession)
    ranks = read_ranks(path)
    key = hashlib.sha256(repr((path, len(ranks), pattern)).encode()).hexdigest()
    sent = df.sparkSession.sparkContext.broadcast(ranks)
    fields = [f for f, _ in new]
    made = {f.name for f in fields}
    names = [c for c in df.columns if c not in made]
    picked = [df.columns.index(c) for c in names]
    at = df.columns.index(source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None
        for batch in batches:
            tok = tok or _tokenizer(key, sent.value, pattern)
            columns = how(tok, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in picked), *(pa.array(c, k) for c, (_, k) in zip(columns, new))], names=[*names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in names), *fields]))


def _ids(out: str) -> tuple[T.StructField, pa.DataType]:
    return T.StructField(out, T.BinaryType()), pa.binary()


def _text(out: str) -> tuple[T.StructField, pa.DataType]:
    return T.StructField(out, T.StringType()), pa.string()


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """The rows with the ids of the text, as little-endian unsigned 32-bit integers in a binary column."""
    return _mapped(df, text_col, [_ids(out)], path, pattern, lambda tok, texts: [[tok.encode(t) for t in texts]])


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """The rows with the text of packed ids."""
    return _mapped(df, ids_col, [_text(out)], path, pattern, lambda tok, ids: [[tok.decode(i) for i in ids]])


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Encoding, then decoding of the ids, in one pass: one worker process for a task instead of two."""

    def both(tok: Tokenizer, texts: list) -> list[list]:
        packed = [tok.encode(t) for t in texts]
        return [packed, [tok.decode(p) for p in packed]]

    return _mapped(df, text_col, [_ids(ids), _text(decoded)], path, pattern, both)
