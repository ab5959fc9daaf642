"""Whole texts to token ids with the tokenizers library, quickly: equal words are encoded once.

A text is cut only where no token can span the cut and the tokenizer's rules look at neither side, so the ids are those
of the whole text. Which cuts are safe follows from the tokenizer's own pre-tokenizer; where none is known to be, the
text is encoded in one piece.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: Bytes of text that are cut and encoded at once.
CHUNK = 8 << 20
#: A text holding this has a space beside other white space or at an end; there a cut before a space isn't known to be safe.
LOOSE = r"[\s\x1c-\x1f\x{85}\p{Z}] | [\s\x1c-\x1f\x{85}\p{Z}]|^ | $"
#: Stands between pieces that are encoded together. Pieces that hold it are encoded alone.
BAR = "|"
#: ASCII characters that are neither letters, digits nor white space, at a piece's end.
TAIL = re.compile(r"[!-/:-@\[-`{-~]+\Z")


def cut_rule(spec: dict) -> str:
    """"word": white space is dropped and tokens never hold it. "space": a token may begin with one space, never hold one later. "": unknown."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or []):
        return ""
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not norm:
        return "space"
    kinds = [p.get("type") for p in pre.get("pretokenizers", [])]
    norms = {n.get("type") for n in (norm or {}).get("normalizers", [])}
    if kinds == ["Split", "ByteLevel"] and norms <= {"NFC", "Replace", "Lowercase"}:
        split, level = pre["pretokenizers"]
        pattern = split.get("pattern", {}).get("Regex", "")
        outside = all(n.get("pattern") == {"Regex": "\\s+"} and n.get("content") == " " for n in norm["normalizers"] if n["type"] == "Replace")
        # every alternative of the pattern is made of letters, digits or what is no white space, and nothing looks around
        if split.get("behavior") == "Removed" and split.get("invert") and outside and not level.get("use_regex") and not level.get("add_prefix_space") and "(?" not in pattern and "[^\\s\\p{L}\\p{N}]+" in pattern and " " not in pattern:
            return "word"
    return ""


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + sizes[i]] of all i, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


class Store:
    """The ids of pieces seen before: at most ``kept``, then all are forgotten."""

    def __init__(self, kept: int):
        self.kept = kept
        self.forget()

    def forget(self) -> None:
        self.slot: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def slots(self, coded: pa.DictionaryArray, make) -> np.ndarray:
        """The slot of each value; ``make`` gives ids and sizes of a list of new ones."""
        unique = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.slot) > self.kept:
            self.forget()
        n, got = len(self.sizes), list(map(self.slot.get, unique))
        gaps = [i for i, k in enumerate(got) if k is None]
        if gaps:
            new = [unique[i] for i in gaps]
            flat, sizes = make(new)
            for k, i in enumerate(gaps, n):
                got[i] = k
            self.slot.update(zip(new, range(n, n + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        return np.array(got, np.int64)[coded.indices.to_numpy()]


def parts(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0, and the values."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.values.slice(offsets[0], offsets[-1] - offsets[0])


class Encoder:
    """``encode(texts)``: the ids of all texts one after another, and each text's number of ids.

    Equal pieces are encoded once. ``kept`` bounds the pieces that a worker remembers; it forgets all when they are more.
    """

    def __init__(self, path: str, kept: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.rule = cut_rule(json.load(f))
        self.store = Store(kept)
        self.lead = " " if self.rule == "space" else ""
        bar = self.tokenizer.encode(self.lead + BAR, add_special_tokens=False).ids
        self.bar = bar[0] if len(bar) == 1 else None
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)
        # ids that begin with a space, or end a word: one for each piece of which that is known
        mark = (lambda t: t.startswith("Ġ")) if self.rule == "space" else (lambda t: t.endswith("</w>"))
        self.edge[[i for t, i in vocabulary.items() if mark(t)]] = True

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and sizes of pieces; with the rule "word" of letters and the punctuation after them by themselves, each encoded once."""
        if self.rule == "space":
            return self.joined(new)
        units: dict[str, int] = {}
        two = np.full((len(new), 2), -1, np.int64)
        for i, p in enumerate(new):
            # letters end where ASCII punctuation begins, and nothing composes across: no token spans that cut
            tail = "" if p.isalpha() else m[0] if (m := TAIL.search(p)) else ""
            word = p[: len(p) - len(tail)]
            if not word or not word.isalpha() or "İ" in word:
                two[i, 0] = units.setdefault(p, len(units))
                continue
            if not word.islower() and max(word) < "İ":  # there case is a matter of single characters
                word = word.lower()
            two[i, 0] = units.setdefault(word, len(units))
            if tail:
                two[i, 1] = units.setdefault(tail, len(units))
        store, names = self.store, list(units)
        slots = [store.slot.get(u, -1) for u in names]
        gaps = [u for u, k in zip(names, slots, strict=True) if k < 0]
        flat, own = self.joined(gaps)
        slots = np.array(slots, np.int64)
        there, fresh = np.flatnonzero(slots >= 0), np.flatnonzero(slots < 0)
        sizes, starts = np.zeros(len(names) + 1, np.int64), np.zeros(len(names) + 1, np.int64)  # the last is no unit
        sizes[fresh], sizes[there] = own, store.sizes[slots[there]]
        starts[fresh] = np.cumsum(own) - own
        starts[there] = len(flat) + np.cumsum(sizes[there]) - sizes[there]
        flat = np.concatenate([flat, ragged(store.flat, store.starts[slots[there]], sizes[there])])
        return ragged(flat, starts[two.ravel()], sizes[two.ravel()]), sizes[two].sum(axis=1)

    def joined(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces in few calls, parted again by the ids at their edges.

        With the rule "space" each piece's first id, and no other, begins with a space. With the rule "word" a piece of
        letters alone is one word, with one last id; other pieces are put between bars.
        """
        alone = [i for i, p in enumerate(new) if "<|" in p or not p or BAR in p and self.rule == "word"]
        rest = sorted(set(range(len(new))).difference(alone)) if alone else list(range(len(new)))
        flat, order, sizes = [], [], np.zeros(len(new), np.int64)
        if self.rule == "space":
            plain, barred = rest, []
        else:  # a dotted capital I becomes two characters
            plain = [i for i in rest if new[i].isalpha() and "İ" not in new[i]]
            barred = sorted(set(rest).difference(plain))
        for own, barring in ((plain, False), (barred, True)):
            for lo in range(0, len(own), 2000):
                part = [new[i] for i in own[lo : lo + 2000]]
                text = f" {BAR} ".join(part) + f" {BAR}" if barring else self.lead + " ".join(part)
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                if barring:
                    at = np.flatnonzero(ids == self.bar) if self.bar is not None else []
                    n, ids = np.diff(at, prepend=-1) - 1, ids[ids != self.bar] if self.bar is not None else ids
                else:
                    at = np.flatnonzero(self.edge[ids])
                    n = np.diff(at, append=len(ids)) if self.rule == "space" else np.diff(at, prepend=-1)
                if len(at) != len(part) or n.sum() != len(ids):  # not expected: then one by one
                    ids, n = self.plain([self.lead + p for p in part])
                flat.append(ids)
                sizes[own[lo : lo + len(part)]] = n
            order += own
        if alone:
            ids, n = self.plain([self.lead + new[i] if new[i] else "" for i in alone])
            flat.append(ids)
            sizes[alone] = n
            order += alone
        order = np.array(order, np.int64)
        n = sizes[order]
        starts = np.empty(len(new), np.int64)
        starts[order] = np.cumsum(n) - n
        return ragged(np.concatenate(flat) if flat else np.zeros(0, np.uint32), starts, sizes), sizes

    def cut(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of texts in which every cut is safe."""
        offsets, values = parts(pc.ascii_split_whitespace(col) if self.rule == "word" else pc.split_pattern(col, " "))
        slots = self.store.slots(values.dictionary_encode(), self.pieces)
        starts, sizes, flat = self.store.starts[slots], self.store.sizes[slots], self.store.flat
        if self.rule == "space":  # a text's first piece has no space before it
            first = offsets[:-1]
            heads, n = self.plain(values.take(pa.array(first)).to_pylist())
            flat = np.concatenate([flat, heads])
            starts[first], sizes[first] = len(self.store.flat) + np.cumsum(n) - n, n
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ragged(flat, starts, sizes), np.diff(ends[offsets])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        col = pc.fill_null(col, "")
        if not len(col):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.rule:
            return self.plain(col.to_pylist())
        if self.rule == "word":
            return self.cut(col)
        loose = pc.match_substring_regex(col, LOOSE).to_numpy(zero_copy_only=False)
        if not loose.any():
            return self.cut(col)
        which = [np.flatnonzero(~loose), np.flatnonzero(loose)]
        got = [self.cut(col.take(pa.array(which[0]))) if len(which[0]) else self.plain([]), self.plain(col.take(pa.array(which[1])).to_pylist())]
        sizes, starts = np.zeros(len(col), np.int64), np.zeros(len(col), np.int64)
        for own, n, base in ((which[0], got[0][1], 0), (which[1], got[1][1], len(got[0][0]))):
            sizes[own], starts[own] = n, base + np.cumsum(n) - n
        return ragged(np.concatenate([got[0][0], got[1][0]]), starts, sizes), sizes


def encoder(path: str, kept: int) -> Encoder:
    """One for each worker, while it encodes with this vocabulary."""
    return common.only(f"encoder {path} {kept}", lambda: Encoder(path, kept))


def encoded(batches, path: str, kept: int = 1_200_000, chunk: int = CHUNK):
    """(doc_id, ids) of Arrow batches of doc_id and text, as (list of doc_ids, list of byte strings) of about ``chunk`` bytes of text each."""
    yield from by_text(batches, encoder(path, kept).encode, chunk)
    common.tidy()


def by_text(batches, encode, chunk: int = CHUNK):
    """Rows of Arrow batches of doc_id and text with what ``encode`` makes of the texts, about ``chunk`` bytes at a time."""
    for batch in batches:
        text = batch.column(1).cast(pa.string())
        size = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + chunk, "right")))
            flat, n = encode(text.slice(lo, hi - lo))
            data, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(n)).tolist()
            yield batch.column(0).slice(lo, hi - lo).to_pylist(), [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            lo = hi
