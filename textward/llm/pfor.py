"""Patched frame-of-reference blocks for token ids.

A file is: ``MAGIC``; blocks; the document table; the block index; the trailer.

- block of 128 ids (the last one of a file is filled up with its minimum): u32 minimum, u8 width, u8 number of
  exceptions, u16 number of ids; 128 packed values of ``width`` bits, little-endian; the exceptions' places (u8 each) and
  what of them is above ``width`` bits (u32 each).
- document table: i64 doc_id (``NO_ID`` for null) and u64 number of ids, for each document.
- block index: u64 offset of each block, and one for their end.
- trailer: u64 offset of the document table, u64 documents, u64 offset of the index, u64 blocks, u64 ids, ``MAGIC``.
"""

from __future__ import annotations

import numpy as np

MAGIC = b"TWPFOR1\n"
BLOCK = 128
#: This share of a block's values fits its width; the rest are exceptions.
PERCENTILE = 0.9
NO_ID = -(1 << 63)
TRAILER = 48


def bits(x: np.ndarray) -> np.ndarray:
    """Bit lengths of unsigned 32-bit values."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 128) values, each below 2**width, to (n, 4 * width) words."""
    rows = np.ascontiguousarray(values.T).astype(np.uint64)
    out = np.zeros((4 * width + 1, values.shape[0]), np.uint64)
    for j in range(BLOCK):
        k, s = divmod(j * width, 32)
        out[k] |= rows[j] << np.uint64(s)
        if s + width > 32:
            out[k + 1] |= rows[j] >> np.uint64(32 - s)
    return np.ascontiguousarray(out[: 4 * width].T & np.uint64(0xFFFFFFFF)).astype("<u4")


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of :func:`pack`."""
    cols = np.zeros((4 * width + 1, words.shape[0]), np.uint64)
    cols[: 4 * width] = words.T
    out, mask = np.zeros((BLOCK, words.shape[0]), np.uint64), np.uint64((1 << width) - 1)
    for j in range(BLOCK if width else 0):
        k, s = divmod(j * width, 32)
        out[j] = ((cols[k] >> np.uint64(s)) | (cols[k + 1] << np.uint64(32 - s))) & mask
    return out.T


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Blocks of the ids; the last may be short."""
    n = len(ids)
    rows = -(-n // BLOCK)
    full = np.zeros(rows * BLOCK, np.uint32)
    full[:n] = ids
    if n < len(full):
        full[n:] = ids[(rows - 1) * BLOCK :].min()
    full = full.reshape(rows, BLOCK)
    low = full.min(axis=1)
    d = full - low[:, None]
    at = min(BLOCK - 1, int(np.ceil(PERCENTILE * BLOCK)) - 1)
    width = bits(np.partition(d, at, axis=1)[:, at])
    high = d.astype(np.uint64) >> width[:, None].astype(np.uint64)
    r, c = np.nonzero(high)
    n_exc = np.bincount(r, minlength=rows)
    ends = np.cumsum(n_exc)
    over = high[r, c].astype("<u4")
    head = np.zeros(rows, np.dtype([("low", "<u4"), ("width", "u1"), ("exc", "u1"), ("n", "<u2")]))
    head["low"], head["width"], head["exc"], head["n"] = low, width, n_exc, BLOCK
    head["n"][-1] = n - (rows - 1) * BLOCK
    heads, places, overs = head.tobytes(), c.astype("u1").tobytes(), over.tobytes()
    out: list = [b""] * rows
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        body, size = pack(d[own].astype(np.uint64) & np.uint64((1 << int(w)) - 1), int(w)).tobytes(), 16 * int(w)
        for k, i in enumerate(own.tolist()):
            hi, lo = int(ends[i]), int(ends[i] - n_exc[i])
            out[i] = heads[8 * i : 8 * i + 8] + body[k * size : (k + 1) * size] + places[lo:hi] + overs[4 * lo : 4 * hi]
    return out


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in data."""
    raw = np.frombuffer(data, np.uint8)
    if not len(starts):
        return np.zeros(0, np.uint32)
    head = np.ascontiguousarray(raw[starts[:, None] + np.arange(8)])
    low, n = head[:, :4].copy().view("<u4")[:, 0], head[:, 6:8].copy().view("<u2")[:, 0]
    width, n_exc = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.uint64)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        words = np.ascontiguousarray(raw[starts[own][:, None] + 8 + np.arange(16 * int(w))]).view("<u4")
        out[own] = unpack(words, int(w))
    rows = np.repeat(np.arange(len(starts)), n_exc)
    if len(rows):
        k = np.arange(len(rows)) - np.repeat(np.cumsum(n_exc) - n_exc, n_exc)
        at = starts[rows] + 8 + 16 * width[rows]
        place = raw[at + k]
        over = np.ascontiguousarray(raw[(at + n_exc[rows] + 4 * k)[:, None] + np.arange(4)]).view("<u4")[:, 0]
        out[rows, place] |= over.astype(np.uint64) << width[rows].astype(np.uint64)
    out += low[:, None]
    ids = out.astype(np.uint32).reshape(-1)
    return ids[: (len(starts) - 1) * BLOCK + int(n[-1])] if (n[:-1] == BLOCK).all() else np.concatenate([ids[i * BLOCK : i * BLOCK + int(m)] for i, m in enumerate(n)])


class Writer:
    """Takes documents one after another; holds no more than ``hold`` ids."""

    def __init__(self, file, hold: int = 1 << 18):
        self.file, self.hold = file, hold
        self.at, self.waiting, self.n_waiting = len(MAGIC), [], 0
        self.offsets, self.docs, self.sizes, self.n = [], [], [], 0
        file.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(NO_ID if doc_id is None else doc_id)
        self.sizes.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= self.hold:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.waiting), "<u4")
        take = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in encode_blocks(ids[:take]) if take else []:
            self.offsets.append(self.at)
            self.file.write(block)
            self.at += len(block)
        self.n += take
        self.waiting, self.n_waiting = [ids[take:].tobytes()], len(ids) - take

    def close(self) -> None:
        self.flush(True)
        docs = np.array(self.docs, "<i8").tobytes() + np.array(self.sizes, "<u8").tobytes()
        index = np.array([*self.offsets, self.at], "<u8").tobytes()
        self.file.write(docs)
        self.file.write(index)
        self.file.write(np.array([self.at, len(self.docs), self.at + len(docs), len(self.offsets), self.n], "<u8").tobytes() + MAGIC)


class Reader:
    """``docs()`` gives (doc_id, start in the file, ids as bytes) in order; ``ids(lo, hi)`` reads only the blocks that hold them."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = file.read_at(TRAILER, size - TRAILER)
        if tail[40:] != MAGIC or file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError("not a token file")
        docs_at, n_docs, index_at, n_blocks, self.n = (int(x) for x in np.frombuffer(tail[:40], "<u8"))
        docs = file.read_at(16 * n_docs, docs_at)
        self.doc_ids, self.sizes = np.frombuffer(docs[: 8 * n_docs], "<i8"), np.frombuffer(docs[8 * n_docs :], "<u8").astype(np.int64)
        self.offsets = np.frombuffer(file.read_at(8 * (n_blocks + 1), index_at), "<u8").astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        if hi <= lo:
            return np.zeros(0, np.uint32)
        a, b = lo // BLOCK, -(-hi // BLOCK)
        data = self.file.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        return decode_blocks(data, self.offsets[a:b] - self.offsets[a])[lo - a * BLOCK : hi - a * BLOCK]

    def docs(self, span: int = 1 << 19):
        ends = np.cumsum(self.sizes)
        starts, k = ends - self.sizes, 0
        while k < len(ends):
            last = max(k + 1, int(np.searchsorted(ends, starts[k] + span, "right")))
            data, base = self.ids(int(starts[k]), int(ends[last - 1])).astype("<u4").tobytes(), int(starts[k])
            for i in range(k, last):
                doc = int(self.doc_ids[i])
                yield None if doc == NO_ID else doc, int(starts[i]), data[4 * (int(starts[i]) - base) : 4 * (int(ends[i]) - base)]
            k = last
