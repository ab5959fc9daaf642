"""Cost-balanced packing of token documents into sequences of a fixed length."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common
from .encode import encoded

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Estimated cost of a piece of n tokens: LINEAR * n + n * n, its attention being within the piece.
LINEAR = 4096.0


def cost(n):
    return LINEAR * n + n * n


def balance(lengths: list[int], bins: int, size: int) -> list[list[tuple[int, int, int]]]:
    """Pieces in descending order, each to the lowest-cost sequence that has room.

    A piece goes whole into the cheapest sequence it fits; if it fits none it is cut to the room of the cheapest one
    with any, and what is left is dealt with next. Returns for each sequence (piece, start in it, tokens). What doesn't
    fit ``bins * size`` at all comes as an extra, last list of leftovers.
    """
    room, price = np.full(bins, size, np.int64), np.zeros(bins)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(bins + 1)]
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at, left = 0, lengths[piece]
        while left:
            fits = np.where(room >= left, price, np.inf) if bins else np.array([np.inf])
            k = int(fits.argmin())
            if fits[k] == np.inf:
                fits = np.where(room > 0, price, np.inf) if bins else fits
                k = int(fits.argmin())
                if fits[k] == np.inf:
                    out[bins].append((piece, at, left))
                    break
            n = min(left, int(room[k]))
            out[k].append((piece, at, n))
            room[k] -= n
            price[k] += cost(n)
            at, left = at + n, left - n
    return out


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1, group: int = 512, kept: int = 1_200_000, chunk: int = 6 << 20) -> DataFrame:
    """Sequences of at most ``size`` tokens from all documents; one row for each piece, every id in exactly one.

    Null and empty texts are a document of ``end_id`` alone. A document is cut into full sequences and a rest; the rests
    are dealt out in groups of about ``group`` sequences by :func:`balance`. A group fills all its sequences; what is over
    is carried to the next one, so only the last sequence of a partition is short. Rows are packed where they lie: no
    shuffle, memory for one group. sequence_id is the partition's number times 2**40 plus a count. Equal doc_ids or rows
    are packed each on their own; an empty table gives no rows; other columns are ignored. ``kept`` bounds the words whose
    ids a worker remembers, ``chunk`` the bytes of text encoded at once: more cost memory, fewer cost time, the rows are
    the same.
    """
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        base, count = TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of rests
        n_held, rows = 0, []

        def row(doc_id, start, ids, total, seq, offset):
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, base + seq, offset))

        def settle(last: bool):
            """Packs what is held; all but the last time only into full sequences."""
            nonlocal held, n_held, count
            bins = -(-n_held // size) if last else n_held // size
            kept = []
            for k, own in enumerate(balance([len(h[2]) // 4 for h in held], bins, size)):
                offset = 0
                for piece, at, n in own:
                    doc_id, start, ids, total = held[piece]
                    part = ids[4 * at : 4 * (at + n)]
                    if k < bins:
                        row(doc_id, start + at, part, total, count + k, offset)
                        offset += n
                    else:
                        kept.append((doc_id, start + at, part, total))
            count += bins
            held, n_held = kept, sum(len(h[2]) // 4 for h in kept)

        for found in encoded(batches, vocabulary, kept, chunk):
            for doc_id, ids in zip(*found, strict=True):
                ids += end
                total = len(ids) // 4
                full = total // size
                for k in range(full):
                    row(doc_id, k * size, ids[4 * k * size : 4 * (k + 1) * size], total, count, 0)
                    count += 1
                if total > full * size:
                    held.append((doc_id, full * size, ids[4 * full * size :], total))
                    n_held += total - full * size
                if n_held >= group * size:
                    settle(False)
            if rows:
                yield out(rows)
                rows = []
        settle(True)
        if rows:
            yield out(rows)

    def out(rows):
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return common.columns(docs, doc_id="long", text="string").mapInArrow(run, PIECES)
