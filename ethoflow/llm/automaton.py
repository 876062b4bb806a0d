"""One Aho-Corasick automaton over words, in packed arrays that every worker maps.

States are sequences of up to ``depth`` consecutive item words, numbered level by
level: the words themselves first, then pairs, and so on.  Every suffix of a
state is a state too, so a state fails to the one without its first word, which
the build knows from the word's neighbour and need not search.  Three arrays
hold the automaton, in one order of states: sorted edges (state before, word),
failure states, and the longest pattern that ends a state.  A word costs 16 bytes
a level at most.

No state looks back further than ``depth`` words.  A long run of words can hence
be cut into lanes that start ``depth`` words early, and all lanes take their steps
together; the states are those of one scan from the start.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

#: Words of a lane, and a lane's words at a time.
LANE = 256
#: Known words that a worker remembers.
MEMO = 1 << 20


def _place(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Writer:
    """Arrays written piece by piece, a file each."""

    def __init__(self, root: str) -> None:
        self.store, self.root = _place(root)
        self.store.create_dir(self.root, recursive=True)
        self.files: dict = {}
        self.kinds: dict[str, str] = {}

    def add(self, name: str, piece: np.ndarray) -> None:
        if name not in self.files:
            self.files[name], self.kinds[name] = self.store.open_output_stream(f"{self.root}/{name}"), piece.dtype.str
        self.files[name].write(piece.tobytes())

    def close(self) -> None:
        for f in self.files.values():
            f.close()
        with self.store.open_output_stream(f"{self.root}/kinds") as f:
            f.write(json.dumps(self.kinds).encode())


def _read(root: str) -> dict[str, np.ndarray]:
    """The arrays, memory-mapped; a store without local paths gives its bytes."""
    store, path = _place(root)
    with store.open_input_file(f"{path}/kinds") as f:
        kinds = json.loads(f.read())
    out = {}
    for name, kind in kinds.items():
        at = f"{path}/{name}"
        if not store.get_file_info(at).size:
            out[name] = np.zeros(0, dtype=kind)
        elif store.type_name == "local":
            out[name] = np.asarray(np.memmap(at, dtype=kind, mode="r"))
        else:
            with store.open_input_file(at) as f:
                out[name] = np.frombuffer(f.read_buffer(), dtype=kind)
    return out


def build(root: str, items: Iterable[tuple[int | None, list[bytes]]], depth: int) -> None:
    """Writes the automaton of all windows of ``depth`` words of the items, and of whole shorter items."""
    number: dict[bytes, int] = {}
    seq, owner = array("q", [0]), array("q", [0])
    short: list[tuple[int, int]] = []  # (start, words) of the items of less than depth words
    owners: list[int | None] = [None]
    for item, words in items:
        if not words:
            continue
        if len(words) < depth:
            short.append((len(seq), len(words)))
        owners.append(item)
        seq.extend([number.setdefault(w, len(number) + 1) for w in words])
        owner.extend([len(owners) - 1] * len(words))
        seq.append(0)
        owner.append(0)
    out = _Writer(root)
    vocabulary = sorted((xxhash.xxh64_intdigest(w), w) for w in number)
    renumbered = np.zeros(len(number) + 1, dtype=np.uint32)
    for i, (_, w) in enumerate(vocabulary):
        renumbered[number[w]] = i + 1
    out.add("hash", np.array([h for h, _ in vocabulary], dtype=np.uint64))
    out.add("start", np.cumsum([0, *(len(w) for _, w in vocabulary)], dtype=np.uint64))
    out.add("letters", np.frombuffer(b"".join(w for _, w in vocabulary), dtype=np.uint8))
    del number, vocabulary
    words, owner = renumbered[np.asarray(seq, dtype=np.int64)], np.asarray(owner, dtype=np.int64)
    ids = np.array([0 if i is None else i for i in owners], dtype=np.int64)
    known = np.array([i is not None for i in owners])
    short_at, short_n = np.array([s[0] for s in short], dtype=np.int64), np.array([s[1] for s in short], dtype=np.int64)

    at = np.flatnonzero(words)  # where a state of the level begins
    state = words.copy()
    states = len(renumbered)  # the next new state
    ends = np.zeros(states, dtype=np.uint32)  # of the level before: the longest pattern ending there
    level_from = 0
    patterns = 1  # number 0: none
    out.add("length", np.zeros(1, dtype=np.uint8))
    out.add("next", np.zeros(1, dtype=np.uint32))
    owner_start = [np.zeros(2, dtype=np.uint64)]
    for k in range(1, depth + 1):
        if k == 1:
            n_new, first, fail, inverse = states, 0, np.zeros(states, dtype=np.uint32), state[at].astype(np.int64)
            below = np.zeros(states, dtype=np.uint32)
        else:
            at = at[words[at + k - 1] != 0]  # the run of item words goes on; every item ends in a zero
            keys = state[at].astype(np.uint64) << np.uint64(32) | words[at + k - 1]
            edges, inverse = np.unique(keys, return_inverse=True)
            n_new, first = len(edges), states
            if first + n_new >= 1 << 32:
                raise ValueError("an automaton numbers its states in 32 bits")
            fail = np.zeros(n_new, dtype=np.uint32)
            fail[inverse] = state[at + 1]
            fresh = np.zeros(len(state), dtype=np.uint32)
            fresh[at] = first + inverse
            state = fresh
            states += n_new
            below = ends[fail.astype(np.int64) - level_from]
            out.add("edges", edges)
        whole = at if k == depth else short_at[short_n == k]
        here = below.copy()
        if len(whole):
            local = state[whole].astype(np.int64) - first
            pairs = np.unique(local << 32 | owner[whole])
            terminal, begin = np.unique(pairs >> 32, return_index=True)
            holders = pairs & 0xFFFFFFFF
            here[terminal] = patterns + np.arange(len(terminal), dtype=np.uint32)
            out.add("length", np.full(len(terminal), k, dtype=np.uint8))
            out.add("next", below[terminal])
            named = known[holders]
            out.add("owner", ids[holders][named])
            counts = np.add.reduceat(named.astype(np.uint64), begin)
            owner_start.append(owner_start[-1][-1] + np.cumsum(counts, dtype=np.uint64))
            patterns += len(terminal)
        out.add("fail", fail)
        out.add("ends", here)
        ends, level_from = here, first
    out.add("edges", np.zeros(0, dtype=np.uint64))
    out.add("owner", np.zeros(0, dtype=np.int64))
    out.add("owner_start", np.concatenate(owner_start))
    out.add("depth", np.array([depth], dtype=np.int64))
    out.close()


class Automaton:
    """The mapped arrays of one build."""

    def __init__(self, root: str) -> None:
        a = _read(root)
        self.hash, self.start, self.letters = a["hash"], a["start"], a["letters"]
        self.edges, self.fail, self.ends = a["edges"], a["fail"], a["ends"]
        self.length, self.next, self.owner, self.owner_start = a["length"], a["next"], a["owner"], a["owner_start"]
        self.depth = int(a["depth"][0])
        self.words = len(self.hash)
        self.memo: dict[bytes, int] = {}

    def _learn(self, words: list[bytes]) -> None:
        """Puts the numbers of words into the memo; 0 is any word that no item has."""
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
        for w, h, at in zip(words, hashes, np.searchsorted(self.hash, hashes).tolist()):
            n = 0
            while at < self.words and self.hash[at] == h:
                if self.letters[int(self.start[at]) : int(self.start[at + 1])].tobytes() == w:
                    n = at + 1
                    break
                at += 1
            self.memo[w] = n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list(set(words).difference(self.memo))
        if new:
            self._learn(new)
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.int64, count=len(words))

    def occurrences(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of last words, patterns) of all occurrences in a run of word numbers, in parts."""
        if not self.words or not len(numbers):
            return
        lanes = -(-len(numbers) // LANE)
        padded = np.zeros(self.depth + lanes * LANE, dtype=np.int64)
        padded[self.depth : self.depth + len(numbers)] = numbers
        begin = np.arange(lanes) * LANE
        state = np.zeros(lanes, dtype=np.int64)
        for step in range(self.depth + LANE):
            state = self._stepped(state, padded[step : step + (lanes - 1) * LANE + 1 : LANE])
            if step < self.depth:
                continue
            pattern = self.ends[state]
            lane = np.flatnonzero(pattern)
            pattern = pattern[lane]
            while len(lane):
                yield begin[lane] + step - self.depth, pattern
                pattern = self.next[pattern]
                lane, pattern = lane[pattern != 0], pattern[pattern != 0]

    def _stepped(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each."""
        out = word.copy()  # a word alone is a state by its number; 0 is the root
        todo = np.flatnonzero((word != 0) & (state != 0))
        now, word = state[todo], word[todo]
        while len(todo) and len(self.edges):
            keys = now.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)
            at = np.searchsorted(self.edges, keys)
            hit = self.edges[np.minimum(at, len(self.edges) - 1)] == keys
            out[todo[hit]] = self.words + 1 + at[hit]
            now = self.fail[now].astype(np.int64)
            left = ~hit & (now != 0)
            todo, now, word = todo[left], now[left], word[left]
        return out

    def owners(self, patterns: np.ndarray) -> list[int]:
        """Sorted ids of the items with these patterns."""
        begin, end = self.owner_start[patterns].astype(np.int64), self.owner_start[patterns + 1].astype(np.int64)
        return np.unique(np.concatenate([self.owner[a:b] for a, b in zip(begin, end)])).tolist() if len(patterns) else []
