"""Sorted hash arrays in the shared folder: written by tasks, memory-mapped by tasks."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa

_K = np.uint64(0x9E3779B97F4A7C15)
#: Hashes in a range of the index, on average.
RANGE = 16
#: Rows of a table that its codes are taken from.
SAMPLE = 1 << 16
#: Files that a worker keeps mapped.
MAX_OPEN = 4096
#: Files of appended arrays that a worker keeps open.
MAX_FILES = 256


def mixed(x: np.ndarray) -> np.ndarray:
    """The numbers with their bits well spread (the finaliser constants of splitmix64); one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_on(keys: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The hashes of rows that are one word longer than those of the keys; 0 is the hash of the empty row."""
    with np.errstate(over="ignore"):
        return mixed(keys * _K + words)


def key_of(words: np.ndarray) -> np.ndarray:
    """One hash for each row of word hashes [n, k]."""
    out = np.zeros(len(words), dtype=np.uint64)
    for k in range(words.shape[1]):
        out = key_on(out, words[:, k])
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def groups_of(buckets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its rows, in order) of each bucket that occurs."""
    if not len(buckets):
        return
    small = buckets.astype(np.uint16) if int(buckets.max()) < 1 << 16 else buckets  # sorted by digits
    by = np.argsort(small, kind="stable")
    cuts = np.flatnonzero(np.diff(buckets[by])) + 1
    for part in np.split(by, cuts):
        yield int(buckets[part[0]]), part


def packed_columns(keys: Sequence[np.ndarray], counts: Sequence[np.ndarray]) -> bytes:
    """Columns of unsigned numbers as bytes: keys as differences where all keys before are equal, planes of bytes compressed."""
    n, new, columns = len(keys[0]), np.zeros(len(keys[0]), dtype=bool), []
    new[:1] = True
    for x in keys:
        d = x.astype(np.uint64)
        with np.errstate(over="ignore"):
            d[1:] -= np.where(new[1:], np.uint64(0), x[:-1])
        columns.append(d)
        new[1:] |= x[1:] != x[:-1]
    planes, masks = [], bytearray()
    for c in [*columns, *counts]:
        rows = np.ascontiguousarray(c.astype("<u8")).view(np.uint8).reshape(n, 8)
        used = [i for i in range(8) if rows[:, i].any()]
        masks.append(sum(1 << i for i in used))
        planes += [rows[:, i].tobytes() for i in used]
    raw = b"".join(planes)
    head = np.array([n, len(keys), len(counts), len(raw)], dtype="<u8").tobytes()
    return head + bytes(masks) + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpacked_columns(body: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n, n_keys, n_counts, size = np.frombuffer(body, dtype="<u8", count=4).astype(np.int64).tolist()
    masks = body[32 : 32 + n_keys + n_counts]
    raw = np.frombuffer(pa.decompress(body[32 + len(masks) :], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", dtype=np.uint8)
    at, columns = 0, []
    for mask in masks:
        rows = np.zeros((n, 8), dtype=np.uint8)
        for i in range(8):
            if mask >> i & 1:
                rows[:, i] = raw[at : at + n]
                at += n
        columns.append(rows.view("<u8")[:, 0])
    new, keys = np.zeros(n, dtype=bool), []
    new[:1] = True
    for d in columns[:n_keys]:
        with np.errstate(over="ignore"):
            total = np.cumsum(d, dtype=np.uint64)
            start = np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, dtype=np.int64)
            x = total - total[start] + d[start]
        keys.append(x)
        new = new.copy()
        new[1:] |= x[1:] != x[:-1]
    return keys, columns[n_keys:]


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def _least(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if x.size else 0
    return x.astype(f"<u{next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)}")


def _section(keys: np.ndarray | None, columns: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of one table: an index, 40 bits of each hash, and columns, mostly as one-byte codes of whole rows."""
    out, n = {}, len(columns)
    if keys is not None:
        by = np.argsort(keys, kind="stable")
        keys, columns = keys[by], columns[by]
        bits = max(0, (n // RANGE).bit_length())
        parts = keys >> np.uint64(64 - bits) if bits else np.zeros(n, dtype=np.uint64)
        rest = keys << np.uint64(bits)
        out["index"] = np.searchsorted(parts, np.arange((1 << bits) + 1, dtype=np.uint64)).astype("<u4" if n < 1 << 32 else "<u8")
        out["high"], out["low"] = (rest >> np.uint64(32)).astype("<u4"), (rest >> np.uint64(24) & np.uint64(255)).astype(np.uint8)
    # The rows that are common among the first get the codes 0 to 254.
    rows = key_of(columns)
    seen, first, often = np.unique(rows[:SAMPLE], return_index=True, return_counts=True)
    common = np.sort(np.argsort(-often, kind="stable")[:255])
    at = np.minimum(np.searchsorted(seen[common], rows), max(0, len(common) - 1))
    known = seen[common][at] == rows if n else np.zeros(0, dtype=bool)
    if n and known.mean() < 0.75:
        for i in range(columns.shape[1]):
            out[f"plain{i}"] = _least(columns[:, i])
        return out
    out["code"] = np.where(known, at, 255).astype(np.uint8)
    out["rows"] = columns[first[common]].astype("<u8")
    rare = np.flatnonzero(out["code"] == 255)
    out["rare"], out["rare_rows"] = rare.astype("<u4" if n < 1 << 32 else "<u8"), columns[rare].astype("<u8")
    return out


def write_bucket(uri: str, sections: Mapping[str, tuple[np.ndarray | None, np.ndarray]]) -> None:
    """Tables (hashes or None, columns [n, k]) as one file, renamed into place."""
    arrays = {f"{name}/{part}": a for name, (keys, columns) in sections.items() for part, a in _section(keys, columns).items()}
    head, bodies, at = {}, [], 0
    for name, a in arrays.items():
        body = a.tobytes()
        head[name] = (at, a.dtype.str, a.shape)
        bodies += [body, bytes(-len(body) % 8)]
        at += len(body) + -len(body) % 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    parts = [np.array([len(text)], dtype="<u8").tobytes(), text, *bodies]
    own = f"{uri}.{uuid.uuid4().hex}"
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(own), "wb") as f:
            f.writelines(parts)
        os.replace(_local(own), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path + own[len(uri) :]) as f:
        for p in parts:
            f.write(p)
    store.move(path + own[len(uri) :], path)


def _mapped(uri: str) -> np.ndarray | None:
    """The bytes of a file, memory-mapped; None if it is not there."""
    path, held = _local(uri), None
    if path is None:
        from pyarrow import fs

        store, there = fs.FileSystem.from_uri(uri)
        if store.get_file_info(there).type == fs.FileType.NotFound:
            return None
        held = tempfile.TemporaryFile()  # has no name, so nothing is left behind
        with store.open_input_stream(there) as f:
            while block := f.read(1 << 22):
                held.write(block)
        held.flush()
    elif not os.path.exists(path):
        return None
    return np.asarray(np.memmap(held if held is not None else path, dtype=np.uint8, mode="r"))


class Bucket:
    """One file's tables; a file or table that is not there is empty."""

    def __init__(self, uri: str) -> None:
        data = _mapped(uri)
        self.arrays: dict[str, np.ndarray] = {}
        if data is not None:
            size = int(data[:8].view("<u8")[0])
            for name, (at, kind, shape) in json.loads(data[8 : 8 + size].tobytes()).items():
                n = int(np.prod(shape)) * np.dtype(kind).itemsize
                self.arrays[name] = data[8 + size + at : 8 + size + at + n].view(kind).reshape(shape)

    def _take(self, name: str, at: np.ndarray) -> np.ndarray:
        """Columns [n, k] of rows."""
        if f"{name}/code" not in self.arrays:
            return np.stack([self.arrays[f"{name}/plain{i}"][at].astype(np.uint64) for i in range(sum(a.startswith(f"{name}/plain") for a in self.arrays))], axis=1)
        code, rows = self.arrays[f"{name}/code"][at], self.arrays[f"{name}/rows"]
        if not len(rows):
            return np.zeros((0, rows.shape[1]), dtype=np.uint64)
        out = rows[np.minimum(code, len(rows) - 1)]
        odd = np.flatnonzero(code == 255)
        if len(odd):
            out[odd] = self.arrays[f"{name}/rare_rows"][np.searchsorted(self.arrays[f"{name}/rare"], at[odd])]
        return out

    def column(self, name: str, at: np.ndarray) -> np.ndarray:
        """The first column of rows of a table without hashes."""
        return self._take(name, at)[:, 0]

    def find(self, name: str, keys: np.ndarray, out: np.ndarray, into: np.ndarray) -> None:
        """Puts the columns of the keys that are there into the rows ``into`` of ``out``; the others stay."""
        high = self.arrays.get(f"{name}/high")
        if high is None or not len(high) or not len(keys):
            return
        low, index = self.arrays[f"{name}/low"], self.arrays[f"{name}/index"]
        bits = (len(index) - 1).bit_length() - 1
        part = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
        rest = keys << np.uint64(bits)
        want, want_low = (rest >> np.uint64(32)).astype(np.uint32), (rest >> np.uint64(24) & np.uint64(255)).astype(np.uint8)
        begin, end = index[part].astype(np.int64), index[part + 1].astype(np.int64)
        stop = end
        for _ in range(int((end - begin).max()).bit_length()):  # the first place that is not below
            middle = (begin + end) >> 1
            below = (high[np.minimum(middle, len(high) - 1)] < want) & (begin < end)
            begin, end = np.where(below, middle + 1, begin), np.where(below, end, middle)
        todo = np.flatnonzero(begin < stop)
        while len(todo):
            at = begin[todo]
            same = high[at] == want[todo]
            hit = same & (low[at] == want_low[todo])
            found = todo[hit]
            if len(found):
                out[into[found]] = self._take(name, begin[found])
            todo = todo[same & ~hit]  # the next one may have the same high bits
            begin[todo] += 1
            todo = todo[begin[todo] < stop[todo]]


class Buckets:
    """The files under a folder; the least recently used are closed."""

    def __init__(self, root: str, buckets: int) -> None:
        self.root, self.buckets = root, buckets
        self._open: OrderedDict[int, Bucket] = OrderedDict()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": OrderedDict()}

    def uri(self, b: int) -> str:
        return f"{self.root}/{b:07d}"

    def open(self, b: int) -> Bucket:
        found = self._open.pop(b, None) or Bucket(self.uri(b))
        self._open[b] = found
        if len(self._open) > MAX_OPEN:
            self._open.popitem(last=False)
        return found


def write_array(uri: str, keys: np.ndarray, columns: np.ndarray) -> None:
    """Sorted keys and columns as one file, renamed into place."""
    wide = 4 if columns.size == 0 or int(columns.max()) < 1 << 32 else 8
    parts = [np.array([len(keys), columns.shape[1], wide], dtype="<u8").tobytes(), keys.astype("<u8").tobytes(), *(c.astype(f"<u{wide}").tobytes() for c in columns.T)]
    own = f"{uri}.{uuid.uuid4().hex}"
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(_local(own), "wb") as f:
            f.writelines(parts)
        os.replace(_local(own), path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path + own[len(uri) :]) as f:
        for p in parts:
            f.write(p)
    store.move(path + own[len(uri) :], path)


class Appended:
    """Arrays of 64-bit hashes, one after another in a file that one task writes."""

    def __init__(self, root: str) -> None:
        self.name, self._root, self._file, self._at = uuid.uuid4().hex, root, None, 0

    def add(self, array: np.ndarray) -> int:
        """The place of the array in the file."""
        if self._file is None:
            uri, path = f"{self._root}/{self.name}", _local(self._root)
            if path is not None:
                os.makedirs(path, exist_ok=True)
                self._file = open(_local(uri), "wb")
            else:
                from pyarrow import fs

                store, path = fs.FileSystem.from_uri(self._root)
                store.create_dir(path, recursive=True)
                self._file = store.open_output_stream(f"{path}/{self.name}")
        at = self._at
        self._file.write(array.astype("<u8").tobytes())
        self._at += 8 * len(array)
        return at

    def close(self) -> None:
        if self._file is not None:
            self._file.close()


class AppendedFiles:
    """Reads single arrays of such files; they are not mapped, so a task holds only what it has read."""

    def __init__(self, root: str) -> None:
        self.root, self._open = root, OrderedDict()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": OrderedDict()}

    def read(self, name: str, at: int, n: int) -> np.ndarray:
        found = self._open.pop(name, None)
        if found is None:
            path = _local(self.root)
            if path is not None:
                found = open(f"{path}/{name}", "rb", buffering=0)
            else:
                from pyarrow import fs

                store, path = fs.FileSystem.from_uri(self.root)
                found = store.open_input_file(f"{path}/{name}")
        self._open[name] = found
        if len(self._open) > MAX_FILES:
            self._open.popitem(last=False)[1].close()
        body = os.pread(found.fileno(), 8 * n, at) if _local(self.root) is not None else found.read_at(8 * n, at)
        if len(body) != 8 * n:
            raise OSError(f"{name} ends early")
        return np.frombuffer(body, dtype="<u8")


class HashArray:
    """One bucket's sorted hashes and counts, memory-mapped."""

    def __init__(self, uri: str) -> None:
        path, held = _local(uri), None
        if path is None:
            from pyarrow import fs

            store, there = fs.FileSystem.from_uri(uri)
            if store.get_file_info(there).type == fs.FileType.NotFound:
                path = ""
            else:
                held = tempfile.TemporaryFile()  # has no name, so nothing is left behind
                with store.open_input_stream(there) as f:
                    while block := f.read(1 << 22):
                        held.write(block)
                held.flush()
        if held is None and not os.path.exists(path):
            self.keys, self.columns = np.zeros(0, dtype=np.uint64), []
            return
        data = np.memmap(held if held is not None else path, dtype=np.uint8, mode="r")
        n, columns, wide = np.frombuffer(data[:24].tobytes(), dtype="<u8").astype(np.int64).tolist()
        self.keys = data[24 : 24 + 8 * n].view("<u8")
        at = 24 + 8 * n
        self.columns = [data[at + i * wide * n : at + (i + 1) * wide * n].view(f"<u{wide}") for i in range(columns)]

    def find(self, keys: np.ndarray, into: np.ndarray, there: np.ndarray | None = None) -> None:
        """Puts the columns of sorted keys into rows of ``into``, and 1 into ``there``; absent ones stay."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        for i, c in enumerate(self.columns):
            into[hit, i] = c[at[hit]]
        if there is not None:
            there[hit] = 1
