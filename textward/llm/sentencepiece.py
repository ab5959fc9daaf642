"""SentencePiece encoding and decoding: an automaton over the pieces drives one pass over each word.

The automaton (Aho-Corasick) gives, at each position, all pieces that end there by its output links. For a unigram model
each relaxes the best score of its end (Viterbi). A BPE model's segmentation isn't the best of additive scores: there
each takes part if it is compatible with the last piece before it, which leaves exactly one, that of the model's merges
(a sequence of pieces is what the merges give if each two neighbours are what the merges make of both together). Words
begin at the white space mark, which no piece holds further on, so equal words are encoded once.
"""

from __future__ import annotations

import heapq
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import common
from .encode import Store, by_text, parts, ragged

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: At a position that no piece reaches.
NONE = -2
#: What the score of an unknown character is below the least of the pieces.
PENALTY = 10.0
ROW = "doc_id long, n_pieces long, ids_crc32 long, text_crc32 long, round_trip boolean"


def fields(data: bytes):
    """(number, value) of a protocol buffer's message."""
    i = 0

    def varint():
        nonlocal i
        v = s = 0
        while True:
            x = data[i]
            i += 1
            v |= (x & 127) << s
            s += 7
            if x < 128:
                return v

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f", data[i : i + 4])[0] if kind == 5 else data[i : i + n]
            i += n


class Model:
    """A model file's pieces, and the automaton over them. ``kept`` bounds the words that are remembered."""

    def __init__(self, data: bytes, kept: int = 1_000_000):
        import ahocorasick

        self.pieces, self.scores, self.types = [], [], []
        self.kind, self.fallback, norm = UNIGRAM, False, {}
        for f, v in fields(data):
            if f == 1:
                d = dict(fields(v))
                self.pieces.append(d[1].decode())
                self.scores.append(d.get(2, 0.0))
                self.types.append(d.get(3, NORMAL))
            elif f == 2:
                d = dict(fields(v))
                self.kind, self.fallback = d.get(3, UNIGRAM), bool(d.get(35, 0))
            elif f == 3:
                norm = dict(fields(v))
        if norm.get(2):
            raise ValueError("models that normalize characters by a table are not supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        if USER in self.types:
            raise ValueError("models with user-defined pieces are not supported")
        self.dummy, self.squeeze, self.escape = (bool(norm.get(k, 1)) for k in (3, 4, 5))
        self.unk = self.types.index(UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == BYTE}
        self.id = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.plain_ids = None
        self.least = min((self.scores[i] for i in self.id.values()), default=0.0) - PENALTY
        self.words = all(SPACE not in p.lstrip(SPACE) for p in self.id)
        self.kept, self.store, self.pairs = kept, Store(kept), {}
        self.auto = ahocorasick.Automaton()
        for p, i in self.id.items():
            # a piece that its own merges don't make never comes out of them
            if self.kind == UNIGRAM or self.merged(p) == [i]:
                self.auto.add_word(p, (i, len(p)))
        if len(self.auto):
            self.auto.make_automaton()
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def merged(self, text: str) -> list[int]:
        """The model's merges on a short text: best score first, then leftmost. Characters without a piece are -1."""
        parts: list = list(text)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list = []

        def offer(a, b):
            if a >= 0 and b < len(parts) and (i := self.id.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.scores[i], a, b, parts[a] + parts[b]))

        for k in range(len(parts) - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, whole = heapq.heappop(heap)
            if parts[a] is None or parts[b] is None or after[a] != b or parts[a] + parts[b] != whole:
                continue
            parts[a], parts[b] = whole, None
            after[a] = after[b]
            if after[a] < len(parts):
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [self.id.get(p, -1) for p in parts if p is not None]

    def fits(self, a: int, b: int) -> bool:
        """Do the merges make these two of both together?"""
        key = a << 32 | b
        if key not in self.pairs:
            if len(self.pairs) > 2 * self.kept:
                self.pairs.clear()
            self.pairs[key] = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
        return self.pairs[key]

    def unknown(self, char: str) -> list[int]:
        raw = char.encode("utf-8", "replace")
        return [self.bytes[x] for x in raw] if self.fallback and all(x in self.bytes for x in raw) else [self.unk]

    def segment(self, word: str) -> list[int]:
        """One pass: at each position the pieces that end there, by the automaton's output links.

        Of a position two numbers are kept, its piece (-1: a character without one, NONE: no way here) and the piece's length;
        of a unigram model the score, too. So a word of any length takes some 16 bytes a character, and its ids.
        """
        n = len(word)
        piece, size = array("i", [NONE]) * (n + 1), array("i", [1]) * (n + 1)
        unigram = self.kind == UNIGRAM
        best = array("d", [float("-inf")]) * (n + 1 if unigram else 1)
        best[0] = 0.0
        events = iter(self.auto.iter(word)) if len(self.auto) else iter(())
        held = next(events, None)
        for at in range(1, n + 1):
            here = []
            while held is not None and held[0] + 1 == at:
                here.append(held[1])
                held = next(events, None)
            if unigram:
                for i, k in here:
                    if (s := best[at - k] + self.scores[i]) > best[at]:
                        best[at], piece[at], size[at] = s, i, k
                if not any(k == 1 for _, k in here) and (s := best[at - 1] + self.least) > best[at]:
                    best[at], piece[at], size[at] = s, -1, 1
            else:
                for i, k in here:
                    before = piece[at - k]
                    if at == k or before != NONE and (before < 0 or self.fits(before, i)):
                        piece[at], size[at] = i, k
                        break
                else:
                    # a character without a piece takes no part in merges; inside a word a prefix always has its pieces
                    if word[at - 1] not in self.id:
                        piece[at] = -1
        out, at = array("i"), n  # from the last to the first
        joined = unigram and not self.fallback  # runs of unknown characters are one
        while at:
            if piece[at] == NONE:
                return self.unlinked(word)
            for i in (piece[at],) if piece[at] >= 0 else reversed(self.unknown(word[at - 1])):
                if not (joined and i == self.unk and len(out) and out[-1] == self.unk):
                    out.append(i)
            at -= size[at]
        out.reverse()
        return out.tolist()

    def unlinked(self, word: str) -> list[int]:
        """The merges themselves, for the case that a prefix had no compatible piece."""
        out, text = [], word
        parts = re.split("|".join({re.escape(c) for c in text if c not in self.id}) or "(?!)", text)
        holes = [c for c in text if c not in self.id]
        for k, p in enumerate(parts):
            out += self.merged(p) if p else []
            out += self.unknown(holes[k]) if k < len(holes) else []
        return out

    def normalize(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if self.dummy and text:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    def encode(self, text: str) -> list[int]:
        text = self.normalize(text)
        words = self.cut(text) if self.words else [text] if text else []
        return [i for w in words for i in self.segment(w)]

    def several(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [self.segment(SPACE + w) for w in words]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def encode_many(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's number of ids; equal words are encoded once."""
        col = pc.fill_null(col, "")
        plain = self.words and self.dummy and self.escape and not self.squeeze
        # where spaces follow each other or stand at an end, or the mark is in the text, words aren't what is between spaces
        loose = pc.match_substring_regex(col, f"  |^ | $|{SPACE}|^$").to_numpy(zero_copy_only=False) if plain else np.ones(len(col), bool)
        sizes, starts = np.zeros(len(col), np.int64), np.zeros(len(col), np.int64)
        flat, own = [np.zeros(0, np.uint32)], np.flatnonzero(~loose)
        if len(own):
            offsets, values = parts(pc.split_pattern(col.take(pa.array(own)), " "))
            slots = self.store.slots(values.dictionary_encode(), self.several)
            n = self.store.sizes[slots]
            flat.append(ragged(self.store.flat, self.store.starts[slots], n))
            sizes[own] = np.diff(np.concatenate([[0], np.cumsum(n)])[offsets])
            starts[own] = np.cumsum(sizes[own]) - sizes[own]
        at = sum(map(len, flat))
        for k in np.flatnonzero(loose).tolist():
            ids = np.array(self.encode(col[k].as_py()), np.uint32)
            flat.append(ids)
            starts[k], sizes[k], at = at, len(ids), at + len(ids)
        return ragged(np.concatenate(flat), starts, sizes), sizes

    def decode(self, ids) -> str:
        """The text of ids. Bytes that aren't UTF-8 become replacement characters, unknown pieces the model's mark."""
        if self.plain_ids is None:
            self.of = {i: b for b, i in self.bytes.items()}
            self.plain_ids = [p if t == NORMAL else None for p, t in zip(self.pieces, self.types, strict=True)]
        words = [self.plain_ids[i] for i in ids]
        if None not in words:
            text = "".join(words).replace(SPACE, " ")
            return text[1:] if self.dummy and text.startswith(" ") else text
        out, raw, of = [], bytearray(), self.of
        for i in ids:
            if i in of:
                raw.append(of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            if self.types[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif self.types[i] != CONTROL:
                out.append(self.pieces[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(SPACE, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


def load(path: str) -> Model:
    """One for each worker, while it works with this model."""

    def make():
        with open(path, "rb") as f:
            return Model(f.read())

    return common.only(f"pieces {path}", make)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the piece ids of each whole text (null and empty: none); a row for each row, other columns ignored.

    A white space mark in the text itself is encoded like a space, as the library does. An empty table gives no rows.
    """

    def run(batches):
        for doc_ids, ids in by_text(batches, load(model).encode_many):
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return common.columns(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and the text of ``ids`` (null: null); a row for each row."""

    def run(batches):
        m = load(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else m.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return common.columns(rows, doc_id="long", ids="array<int>").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Encodes each whole text and decodes it again: doc_id, n_pieces, ids_crc32, text_crc32 (of the decoded text), round_trip.

    round_trip: is the decoded text the text? A white space mark comes back as a space.
    """

    def run(batches):
        m = load(model)
        for batch in batches:
            texts, at = batch.column(1), 0
            for doc_ids, found in by_text([batch], m.encode_many):
                rows = []
                for doc_id, ids, text in zip(doc_ids, found, texts.slice(at, len(doc_ids)).to_pylist(), strict=True):
                    back = m.decode(array("I", ids))
                    rows.append((doc_id, len(ids) // 4, zlib.crc32(ids), zlib.crc32(back.encode("utf-8", "replace")), back == (text or "")))
                at += len(doc_ids)
                kinds = [pa.int64()] * 4 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in ROW.split(", ")])

    return common.columns(docs, doc_id="long", text="string").mapInArrow(run, ROW)
