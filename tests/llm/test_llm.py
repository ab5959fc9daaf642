import collections
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle import of_spark, of_sql
from textward.llm import ann, common, encode, htmltext, langid, linededup, neardup, packing, pfor, quality, queries, sentencepiece, tokenids, warc

public = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, page_id string, row_key string, band string"
ODD = [
    (1, "one two three four five six seven", "en", "a", 1, "x", "y", "z"), (2, "One two three four five six seven", "en", "b", 1, "x", "y", "z"), (3, None, None, None, None, None, None, None), (4, "", "en", "a", 0, "x", "y", "z"),
    (5, "  \n\t ", "en", "a", 0, "x", "y", "z"), (6, "word " * 30000, "en", "a", 0, "x", "y", "z"), (6, "word " * 30000, "en", "a", 0, "x", "y", "z"), (None, "no id here at all, at all", "de", None, 0, "x", "y", "z"), (7, "12 34 !!", "de", "c", 0, "x", "y", "z"),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf, name):
    assert of_spark(queries.queries()[name](spark, sf)) == of_sql(queries.oracle_sql()[name], sf)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_pfor_round_trip(ids):
    sink = pa.BufferOutputStream()
    w = pfor.Writer(sink, hold=200)
    w.add(1, np.array(ids, "<u4").tobytes())
    w.add(None, b"")
    w.add(2, np.array(ids[::-1], "<u4").tobytes())
    w.close()
    r = pfor.Reader(pa.BufferReader(sink.getvalue()))
    assert [(d, s, np.frombuffer(b, "<u4").tolist()) for d, s, b in r.docs()] == [(1, 0, ids), (None, len(ids), []), (2, len(ids), ids[::-1])]
    assert r.ids(1, len(ids)).tolist() == ids[1:]


WORDS = st.text(st.sampled_from("ab|É́İß,.'-9 \n\t\x1c\x85\xa0日<>|eo"), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=6))
def test_cut_texts_have_the_librarys_ids(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        e = _coder(name)
        flat, n = e.encode(pa.array([*texts, "<|endoftext|> x", None], pa.string()))
        want = [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in [*texts, "<|endoftext|> x", None]]
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from("aBéÉÀŠıİΣςσǅµªŉ\u0301\u0338<|>_'.,=s9ᄀ각日"), max_size=6), max_size=12), max_size=4))
def test_words_and_their_punctuation_have_the_librarys_ids(texts):
    e = _coder("word_bpe_49k.json")
    texts = [" ".join(t) for t in texts] + ["It's Σ, ΑΣ. a<|endoftext|>, İ, =\u0338 a\u0301, A|| don't's!"]
    flat, n = e.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_word_is_encoded_once_whatever_follows_it():
    e, told = encode.Encoder(public.path("word_bpe_49k.json")), []

    class Told:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **how):
            told.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **how)

    e.tokenizer = Told(e.tokenizer)
    texts = ["qwertz qwertz, qwertz; Qwertz QWERTZ!! éqa", "qwertz. Éqa, éqa... (qwertz"]
    got = [e.encode(pa.array([t]))[0].tolist() for t in texts]
    assert got == [e.tokenizer.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    said = " ".join(told).split()
    assert said.count("qwertz") == said.count("éqa") == 1 and not {"qwertz,", "Qwertz", "éqa,", "QWERTZ!!"} & set(said)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=30), max_size=12))
def test_forgetting_words_changes_no_ids(calls):
    store, ids = encode.Store(20), lambda w: [int(w)] * (int(w) % 4)

    def make(new):
        assert not set(new) & set(store.slot)
        return np.array([i for w in new for i in ids(w)], np.uint32), np.array([len(ids(w)) for w in new], np.int64)

    for call in calls:
        slots = store.slots(pa.array(list(map(str, call)), pa.string()).dictionary_encode(), make)
        assert [store.flat[store.starts[s] : store.starts[s] + store.sizes[s]].tolist() for s in slots] == [ids(w) for w in map(str, call)]
        assert list(store.slot.values()) == list(range(len(store.sizes))) and len(store.slot) <= 20 + 31


_kept = {}


def _coder(name):
    return _kept.setdefault(name, encode.Encoder(public.path(name))) if name in _kept else _kept.setdefault(name, encode.Encoder(public.path(name)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abthe ▁é日🎉\n1."), max_size=40), min_size=1, max_size=5))
def test_sentencepiece_is_the_librarys(texts):
    spm = pytest.importorskip("sentencepiece")
    data = open(public.path("piece_bpe_32k.model"), "rb").read()
    m = _kept.setdefault("m", None) or sentencepiece.Model(data)
    k = _kept.setdefault("k", None) or spm.SentencePieceProcessor(model_proto=data)
    _kept.update(m=m, k=k)
    flat, n = m.encode_many(pa.array(texts, pa.string()))
    got = [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    assert got == k.encode(texts) and [m.decode(g) for g in got] == k.decode(got)


def unigram(pieces):
    """A unigram model's bytes."""
    out = b""
    for p, s, t in pieces:
        body = b"\x0a" + bytes([len(p.encode())]) + p.encode() + b"\x15" + np.float32(s).tobytes() + b"\x18" + bytes([t])
        out += b"\x0a" + bytes([len(body)]) + body
    return out + b"\x12\x02\x18\x01" + b"\x1a\x02\x20\x00"


def test_unigram_viterbi_is_the_best_score():
    rng = np.random.default_rng(0)
    names = ["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "aa"]
    scores = {n: float(np.float32(-rng.random() * 5)) for n in names}
    m = sentencepiece.Model(unigram([("<unk>", 0, 2), *((n, scores[n], 1) for n in names)]))

    def best(t):
        if not t:
            return 0.0
        return max((scores[n] + best(t[len(n):]) for n in names if t.startswith(n)), default=-1e9)

    for t in ["abc", "aabca", "cab abc", "a b c"]:
        ids = m.encode(t)
        word = "▁" + t.replace(" ", "▁")
        assert "".join(m.pieces[i] for i in ids) == word
        assert sum(m.scores[i] for i in ids) == pytest.approx(sum(best(w) for w in m.cut(word)))


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_a_long_word_takes_little_memory(kind):
    import tracemalloc

    names = ["▁", "a", "b", "c", "ab", "bc", "abc"]
    m = sentencepiece.Model(unigram([("<unk>", 0, 2), *((n, -1.0, 1) for n in names)]) if kind == "unigram" else open(public.path("piece_bpe_32k.model"), "rb").read())
    word = "▁" + "abcX" * 100_000
    tracemalloc.start()
    flat = m.segment(word)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * len(word) and len(flat) > 100_000  # 10 MB of base64 within 500 MB


def test_sentencepiece_queries(spark, odd, empty):
    path = public.path("piece_bpe_32k.model")
    rows = sentencepiece.round_trip(odd, path).collect()
    assert len(rows) == len(ODD) and all(r.round_trip for r in rows) and sentencepiece.round_trip(empty, path).count() == 0
    back = sentencepiece.decode(sentencepiece.encode(odd, path), path).collect()
    assert sorted(r.text for r in back) == sorted(r[1] or "" for r in ODD)


def test_ids_of_the_documents_table(spark, sf):
    """The queries of op1 and op3 against the libraries, over the whole table."""
    spm = pytest.importorskip("sentencepiece")
    texts = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    k = spm.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.op1_sentencepiece(spark, sf).collect()}
    assert len(got) == len(texts)
    for doc_id, text in texts:
        ids = k.encode(text)
        r = got[doc_id]
        assert (r.n_pieces, r.ids_crc32, r.text_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(k.decode(ids).encode())), doc_id
    e, at, rows = _coder("word_bpe_49k.json"), 0, []
    for doc_id, text in texts:
        ids = np.array([*e.tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op3_token_files(spark, sf).collect()) == rows


def test_languages_against_plain_arithmetic(spark, sf):
    """Predictions and scores by the formulas, from the fitted weights and n-grams counted in plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(langid.split(docs))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    for r in docs.limit(60).collect():
        if not r.text or not any(map(str.isalpha, r.text)):
            assert got[r.doc_id] == ("und", 0.0)
            continue
        n = collections.Counter(int(g) for g in langid.grams(np.array([ord(c) for c in r.text.lower()])))
        x = {g: (1 + np.log(c)) * model.idf[g] for g, c in n.items()}
        norm = np.sqrt(sum(v * v for v in x.values()))
        z = sum(v / norm * model.w[g] for g, v in x.items()) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[r.doc_id][0] == model.classes[int(p.argmax())] and got[r.doc_id][1] == pytest.approx(float(p.max()))


def test_token_files(spark, odd, empty):
    path = public.path("word_bpe_49k.json")
    got = tokenids.read(tokenids.write(odd, common.new_dir(spark, "t"), path, parts=3)).collect()
    e = _coder("word_bpe_49k.json")
    want = []
    for doc_id, text, *_ in ODD:
        ids = np.array([*e.tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((doc_id, len(ids), zlib.crc32(ids.tobytes())))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == [None, 1, 2, 3, 4, 5, 6, 6, 7]
    assert tokenids.read(tokenids.write(empty, common.new_dir(spark, "t"), path)).count() == 0


def test_packing(spark, sf, odd, empty):
    path = public.path("byte_bpe_50k.json")
    e = _coder("byte_bpe_50k.json")
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), odd):
        texts = collections.defaultdict(list)
        for r in docs.select("doc_id", "text").collect():
            texts[r.doc_id].append([*e.tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
        rows = packing.pack(docs, path).collect()
        fill = collections.defaultdict(list)
        for r in rows:
            assert any(zlib.crc32(np.array(t[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for t in texts[r.doc_id] if len(t) == r.doc_tokens)
            fill[r.sequence_id].append((r.offset, r.length))
        for own in fill.values():
            at = 0
            for offset, n in sorted(own):
                assert offset == at and n > 0
                at += n
            assert at <= 2048
        total = sum(len(t) for own in texts.values() for t in own)
        assert sum(r.length for r in rows) == total and len(fill) * 2048 - total < 2048 * max(1, docs.rdd.getNumPartitions())
    assert packing.pack(empty, path).count() == 0


def test_balance_takes_the_cheapest():
    out = packing.balance([5, 5, 3, 2], 2, 8)
    assert sorted(n for own in out[:2] for _, _, n in own) == [2, 3, 5, 5] and not out[2]
    assert [sum(n for _, _, n in own) for own in packing.balance([9, 9, 9], 2, 10)] == [10, 10, 7]


def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark, sf, odd, empty):
    rng = np.random.default_rng(3)
    made, k = [], 10_000
    for length in (3, 6, 12, 40, 200):
        base = [f"w{x}" for x in rng.integers(0, 500, length)]
        for share in (0.0, 0.02, 0.05, 0.1, 0.2) * 3:
            made.append((k, " ".join(w if rng.random() > share else f"x{rng.integers(0, 10**6)}" for w in base)))
            k += 1
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(made, "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()}
    assert got == brute_near([tuple(r) for r in docs.collect()])
    rows = neardup.near_duplicates(odd).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in rows) == [(0, 3, 0, True), (1, 3, 1, True), (2, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (6, 1, 6, True), (7, 1, 7, True)]
    assert neardup.near_duplicates(empty).count() == 0
    assert sorted(r.doc_id or 0 for r in neardup.keep_one(odd).collect()) == [0, 1, 3, 4, 5, 6, 7]


def near_copies(n, length=200, changes=(4, 4, 4, 7)):
    """Copies of a text, most pairs of which are just below 75 %."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(length)]
    rows = []
    for k in range(n):
        own = list(base)
        for at in rng.choice(length, changes[k % len(changes)], replace=False):
            own[at] = f"x{rng.integers(0, 10**9)}"
        rows.append((k, " ".join(own)))
    return rows


def test_a_large_group_of_near_copies(spark, monkeypatch):
    rows, sent = near_copies(2000), []
    for name in ("block_links", "confirmed"):
        monkeypatch.setattr(neardup, name, lambda *a, f=getattr(neardup, name): (sent.append((d := f(*a)).count()), d)[1])
    got = {r.doc_id: r.component for r in neardup.linked(spark.createDataFrame(rows, "doc_id long, text string"), block=400_000).collect()}
    # brute force: shared shingles of all pairs by one product of the sets as rows of a matrix
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    often = collections.Counter(x for s in sets for x in s)
    at = {x: k for k, x in enumerate(x for x, n in often.items() if n > 1)}
    m = np.zeros((len(sets), len(at)), np.float32)
    for i, s in enumerate(sets):
        m[i, [at[x] for x in s if x in at]] = 1
    both, size = np.rint(m @ m.T).astype(int), np.array([len(s) for s in sets])
    near = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    below = ~near & (100 * both >= 65 * (size[:, None] + size[None, :] - both))
    assert below.mean() > 0.4
    want, seen = {}, np.zeros(len(sets), bool)
    for i in range(len(sets)):
        if not seen[i]:
            own = np.zeros(len(sets), bool)
            own[i], grown = True, 0
            while own.sum() != grown:
                grown = own.sum()
                own |= near[own].any(0)
            seen |= own
            want |= dict.fromkeys(np.flatnonzero(own).tolist(), i)
    assert got == want and len(set(want.values())) > 1
    assert sum(sent) <= neardup.BANDS * len(rows) < below.sum() // 10


def rows_in(spark, monkeypatch, docs, block):
    """Components, and the rows that go into each step on groups: blocks, and the shingles that are counted."""
    into = collections.Counter()
    links, each = neardup.block_links, neardup.hashes
    with monkeypatch.context() as m:
        m.setattr(neardup, "block_links", lambda rows, unit: (into.update({f"blocks {unit}": rows.count()}), links(rows, unit))[1])
        m.setattr(neardup, "hashes", lambda rows: (into.update(hashes=each(rows).count()), each(rows))[1])
        got = {r.doc_id: r.component for r in neardup.linked(docs, block=block).collect()}
    return got, into


def test_what_goes_into_blocks_grows_with_a_group(spark, monkeypatch):
    frame = lambda n: spark.createDataFrame(near_copies(n, 120, (6, 6, 7, 7)), "doc_id long, text string")
    one, into = rows_in(spark, monkeypatch, frame(700), 64 << 10)
    four, more = rows_in(spark, monkeypatch, frame(2800), 64 << 10)
    assert len(set(one.values())) > 600 and into["hashes"] > 0  # the group stays apart, in several blocks
    assert more["hashes"] <= 5 * into["hashes"] and more["blocks 175"] + more["blocks 350"] <= 5 * (into["blocks 175"] + into["blocks 350"]), (into, more)


@pytest.mark.parametrize("block", [4000, 20_000])
def test_lists_of_rare_shingles_lose_no_link(spark, monkeypatch, block):
    # few edits, made again and again: shingles are shared by many, and lists are parted by the next ones
    rng = np.random.default_rng(9)
    base, rows = [f"w{k}" for k in range(60)], []
    for k in range(240):
        own = list(base)
        for at in rng.choice(60, int(rng.integers(1, 5)), replace=False):
            own[at] = f"x{at}-{rng.integers(0, 2)}"
        rows.append((k, " ".join(own)))
    got, into = rows_in(spark, monkeypatch, spark.createDataFrame(rows, "doc_id long, text string"), block)
    assert got == {i: c for i, (_, c) in brute_near(rows).items()} and into["blocks 350"] > 0


def test_near_duplicates_in_small_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(i + 50_000, t) for i, t in near_copies(60, 60, (1, 2, 3))], "doc_id long, text string"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, block=3000).collect()}
    assert got == brute_near([tuple(r) for r in docs.collect()])


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(7, a), (5, a), (5, b), (5, b), (8, b), (None, b), (None, c), (9, ""), (9, None), (9, c), (3, ""), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, `a.b` int, uid int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == sorted([(7, 16, 5, False), (5, 16, 5, True), (5, 16, 5, True), (5, 16, 5, True), (8, 16, 5, False), (0, 16, 0, True), (0, 16, 0, True), (9, 0, 9, True), (9, 0, 9, True), (9, 16, 9, True), (3, 0, 3, True), (0, 0, 0, True), (0, 0, 0, True)])
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    # each text stays once, with the least doc_id; rows without a word stay
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(5, a), (5, b), (9, ""), (9, ""), (9, c), (3, ""), (0, ""), (0, "")])


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95)]
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 90: 90, 95: 90, 100: 90}


def test_quality(spark, odd, empty):
    labels = spark.createDataFrame([(i, q, 0) for i in range(3000) for q in [int(i % 10 != 0)]], "doc_id long, quality int, toxic int")
    text = "clean words that are all different from the others here " + " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(i, text.replace(" ", " # ") if i % 10 == 0 else text, "en", "s") for i in range(3000)], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    assert all(got[i] == (i % 10 != 0) for i in range(3000)) and quality.keep(docs, labels).count() == 2700
    rows = quality.judge(odd, labels).collect()
    assert len(rows) == len(ODD) and not any(r.kept for r in rows)
    assert quality.judge(empty, labels).count() == 0
    none = quality.judge(docs, labels.filter("false")).collect()
    assert all(r.kept for r in none if not r.base_failed)


def test_binomial_tail(spark):
    from math import comb

    for k, n, p in ((0, 10, 0.1), (3, 40, 0.05), (9, 300, 0.02)):
        want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert spark.range(1).select(quality.tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0] == pytest.approx(want)


def test_line_dedup(spark, odd, empty):
    rows = [(i, f"own line {i}\nshared by all sites\n\nonly in {i % 3}", f"s{i % 12}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in linededup.remove(docs).collect()}
    assert got[0] == rows[0][1] and all(got[i] == f"own line {i}\n\nonly in {i % 3}" for i in range(1, 60))
    assert linededup.remove(odd).count() == len(ODD) and linededup.remove(empty).count() == 0
    assert linededup.remove(odd).columns[:8] == odd.columns


PAGES = "page_id long, url string, html string, text string"


def test_lines_are_left_out_by_their_hashes(spark):
    rng = np.random.default_rng(2)
    pool = ["a", "b b", "", " ", "é", "日", "a ", "x" * 50]
    rows = [([str(x) for x in rng.choice(pool, rng.integers(1, 12))], sorted({str(x) for x in rng.choice(pool, rng.integers(1, 5))})) for _ in range(300)]
    df = spark.createDataFrame(rows, "lines array<string>, gone array<string>")
    got = df.select(linededup.without(F.col("lines"), F.transform("gone", lambda x: F.xxhash64(x)))).collect()
    assert [r[0] for r in got] == [[x for x in lines if x not in gone or not x.strip()] for lines, gone in rows]


def test_long_texts_of_boilerplate_take_seconds(spark):
    import time

    lines, mine = [f"line {k} of the boilerplate" for k in range(40_000)], lambda i: [f"own {i} {k}" for k in range(40_000)]
    rows = [(i, f"s{i}", "\n".join(lines + mine(i))) for i in range(12)]
    began = time.time()
    got = linededup.remove(spark.createDataFrame(rows, "doc_id long, source string, text string"), 10).collect()
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in got} == {i: (80_000, 40_000 if i else 0) for i in range(12)}
    assert all(r.text == ("\n".join(mine(r.doc_id)) if r.doc_id else rows[0][2]) for r in got) and time.time() - began < 300


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x", ""), (2, "http://b/\r\nX: y", "<p>x", ""), (3, None, None, ""), (4, "", "", ""), (5, "http://c", "é" * 50000, ""), (None, "u", "<p>x", ""), (6, "d", "only", ""), (6, "d", "only", "")]
    pages = spark.createDataFrame(rows, PAGES)
    index = warc.write(pages, f"file://{tmp_path}/w", per_file=200)
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read(index).collect()), key=repr)
    assert got == [(0, 4, "revisit", 2), (1, 4, "revisit", 2), (2, 4, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 100000, "response", None), (6, 4, "response", None), (6, 4, "response", None)]
    some = warc.read(index.filter("page_id in (2, 5)"), payload=True).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in some} == {2: "<p>x", 5: "é" * 50000}
    assert warc.read(warc.write(spark.createDataFrame([], PAGES), f"file://{tmp_path}/e")).count() == 0


def test_many_equal_payloads_are_dealt_out(spark, tmp_path):
    rows = [(i, f"u{i}", f"<p>{i % 7 if i % 3 else 0}", "") for i in range(200)]
    pages = spark.createDataFrame(rows, PAGES)
    a, b = (sorted(map(tuple, warc.read(warc.write(pages, f"file://{tmp_path}/{k}", **x)).collect())) for k, x in (("a", {}), ("b", {"winners": 0, "dealt": 10})))
    assert a == b and len(a) == 200 and sum(r[4] == "response" for r in a) == 7


def test_ranges_are_joined():
    assert [(o, n, len(m)) for o, n, m in warc.ranges([(0, 10), (12, 10), (5000, 5)], gap=100, span=1000)] == [(0, 22, 2), (5000, 5, 1)]


def test_neighbours(spark, sf):
    rows = queries.op7_hilbert_neighbours(spark, sf).collect()
    data = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    hits = 0
    for q in {r.query_id for r in rows}:
        want = sorted((float(np.sqrt(((data[v] - data[q]) ** 2).sum())), v) for v in data if v != q)[:10]
        own = sorted((r["rank"], r.vec_id, r.score) for r in rows if r.query_id == q)
        hits += len({v for _, v in want} & {v for _, v, _ in own})
        assert [x[0] for x in own] == list(range(1, 11)) and [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
    assert hits >= 0.9 * len(rows)


def test_neighbours_of_odd_vectors(spark):
    kind = "vec_id long, embedding array<float>, label int"
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 1), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 1), (6, [0.0, 1.0], 1), (None, [1.0, 1.0], 1), (7, [1.0], 1), (100, [1.0, 0.0], 1)]
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in ann.search(spark.createDataFrame(rows, kind)).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 100, 0.0), (0, 3, 6, 1.414214), (100, 1, 0, 0.0), (100, 2, 1, 0.0), (100, 3, 6, 1.414214)]
    assert ann.search(spark.createDataFrame([], kind)).count() == 0


def brute_neighbours(rows, every, k=10):
    out = []
    for q, x in rows:
        if q % every == 0:
            d = [(float(np.sqrt(((np.array(v) - np.array(x)) ** 2).sum())), i) for i, v in rows if i != q and len(v) == len(x)]
            out += [(q, r, i) for r, (_, i) in enumerate(sorted(d)[:k], 1)]
    return sorted(out)


def test_windows_over_many_partitions(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    run = lambda **x: sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(vectors, every=20, wider=(1,), target=0.0, **x).collect())
    rows = [(r.vec_id, list(map(float, r.embedding))) for r in vectors.collect()]
    want = brute_neighbours(rows, 20)
    narrow = run(half=6, part=400)
    # the boundaries of partitions change nothing
    assert narrow == run(half=6, part=10**6)
    # windows of 13 of 500 rows aren't all rows, and wider ones find more
    hits = [len(set((q, i) for q, _, i in got) & set((q, i) for q, _, i in want)) / len(want) for got in (run(half=6, curves=4), narrow, run(half=25))]
    assert hits[0] < 0.6 < hits[1] < hits[2] and hits[2] >= 0.95


def test_work_for_a_query_is_the_same_in_larger_tables(spark, monkeypatch):
    rng = np.random.default_rng(2)
    seen = []
    for n in (1000, 4000):
        # clusters, so that neighbours are near
        v = rng.normal(size=(n // 20, 8)).repeat(20, 0) + 0.05 * rng.normal(size=(n, 8))
        rows = [(i, v[i].tolist()) for i in range(n)]
        got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, half=20, curves=8, part=2000, wider=(1,), target=0.0)
        got = sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect())
        want = brute_neighbours(rows, 50)
        seen.append(len(set((q, i) for q, _, i in got) & set((q, i) for q, _, i in want)) / len(want))
    assert min(seen) >= 0.9  # 8 windows of 41 rows, whatever the table's size


def found_of(got, want):
    return len({(r.query_id, r.vec_id) for r in got} & {(q, i) for q, _, i in want}) / len(want)


def unstructured(n, dim=24, seed=11):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return v, [(i, (x / np.linalg.norm(x)).tolist()) for i, x in enumerate(v)]


def test_registered_windows_find_neighbours_of_unstructured_vectors(spark):
    v, rows = unstructured(20_000)
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = []
    for q in range(0, 20_000, 100):
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        want += [(q, 0, int(i)) for i in np.argsort(d)[:10]]
    assert found_of(got, want) >= 0.9


def test_every_query_has_its_nearest_whatever_the_others_find(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(6000, 24))
    # near copies, whose codes are equal: too few to count in a recall of all queries
    dense = rng.choice(6000, 360, replace=False)
    v[dense] = v[dense[0]] + 1e-4 * rng.normal(size=(360, 24))
    got = ann.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>"), every=20).collect()
    want = []
    for q in range(0, 6000, 20):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want += [(q, r, int(i)) for r, i in enumerate(np.lexsort((np.arange(6000), d))[:10], 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_ties_go_to_the_smaller_id(spark, shift):
    rows = [(i, [shift + float(x) for x in np.random.default_rng(i).integers(0, 3, 7)]) for i in range(1500)][::-1]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), every=50).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == brute_neighbours(rows, 50)


@pytest.mark.parametrize(("wider", "target"), [((1, 4, 16), 0.9), ((1,), 0.97)])
def test_windows_widen_until_recall_holds(spark, wider, target):
    _, rows = unstructured(1500, 16)
    want = brute_neighbours(rows, 20)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    narrow = ann.search(frame, every=20, half=5, curves=8, wider=(1,), target=0.0).collect()
    got = ann.search(frame, every=20, half=5, curves=8, wider=wider, target=target).collect()
    assert found_of(narrow, want) < 0.7 and found_of(got, want) >= target - 0.03
    if wider == (1,):  # no window will do: all rows, exactly
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in got) == want


def test_vectors_of_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(ann, "LENGTHS", 2)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=2 + i % 9 if i % 3 else 4).tolist()) for i in range(400)] + [(500, [1e-170, 1e-170]), (600, [2e-170, 0.0]), (501, [-1e200, 1e200])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10).collect()
    usual = [r for r in rows if r[0] < 500]
    assert found_of([r for r in got if r.query_id < 500], [x for x in brute_neighbours(usual, 10)]) >= 0.9
    assert [r.vec_id for r in got if r.query_id == 500 and r["rank"] == 1] == [600]


def test_neighbours_far_from_the_origin(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (1e6 + 1e-3 * rng.normal(size=6)).tolist()) for i in range(300)]
    rows += [(1000 + i, rng.normal(size=3).tolist()) for i in range(50)] + [(2000, [1e200, 0.0, 1.0, 2.0]), (2001, [1.0, 0.0, 1.0, 2.0]), (2002, [-1e200, 0.0, 1.0, 2.0]), (2003, [1e-200, 0.0, 1.0, 2.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got if r.query_id != 2000) == [x for x in brute_neighbours(rows, 20) if x[0] != 2000]
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 2000] == [(2001, 1e200), (2003, 1e200), (2002, 2e200)]


def test_neighbours_of_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [5.0, 5.0]), (2, [1.0, 0.5])] + [(k, [9.0, 9.0]) for k in range(100, 140)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect())
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.5), (0, 3, 100, pytest.approx(145**0.5)), (100, 1, 101, 0.0), (100, 2, 102, 0.0), (100, 3, 103, 0.0)]


def test_hilbert_neighbours_touch():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    key = ann.hilbert(grid, 4)
    assert sorted(key.tolist()) == list(range(256))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_languages(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    rows = langid.identify(odd).collect()
    assert len(rows) == len(ODD) and {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 7)} == {"und"} and langid.identify(empty).count() == 0
    assert langid.keep(odd).columns == odd.columns


def test_the_most_frequent_languages_are_learned(spark, sf, monkeypatch):
    monkeypatch.setattr(langid, "LANGS", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    often = [r.lang for r in langid.learnable(langid.split(docs)).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect()]
    assert langid.train(langid.split(docs)).classes == sorted(often)


def test_files_go_by_bytes(spark, sf, monkeypatch, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert tokenids.files_for(docs) is None and tokenids.files_for(spark.createDataFrame([(1, "x")], "doc_id long, text string")) is None
    want = sorted(map(tuple, tokenids.read(tokenids.write(docs, f"file://{tmp_path}/a", public.path("word_bpe_49k.json"))).collect()))
    monkeypatch.setattr(tokenids, "FILE", 20_000)
    manifest = tokenids.write(docs, f"file://{tmp_path}/b", public.path("word_bpe_49k.json"))
    assert manifest.count() > 4 and sorted(map(tuple, tokenids.read(manifest).collect())) == want


def test_html():
    page = '<html><head><title>T</title></head><body><nav><a>menu</a></nav><header>top</header><div class="cookie-notice">ok?</div><article><header><h1>Head &amp; more</h1></header><p>one\n two<br>three<p>four <b>bold</b> x<script>var a="<p>";</script> y<div class="ad">buy</div><ul><li>a<li>b</ul><section id="comments"><p>nice</section><form>f</form></article><aside>side</aside><footer>f</footer>'
    assert htmltext.main_text(page) == "Head & more\none two three\nfour bold x y\na\nb"
    assert htmltext.main_text(None) == "" and htmltext.main_text("") == "" and htmltext.main_text("plain <b>text") == "plain text"
    assert htmltext.main_text("<article><p>cut <a href='x") == "cut <a href='x" or htmltext.main_text("<article><p>cut <a href='x").startswith("cut")


def test_wrappers(spark):
    body = '<html><body><div class="x"><p>Read this site every day</p><p>{0} own words of page {0}</p></div><div class="y"><p>All rights</p></div></body></html>'
    pages = [body.format(i) for i in range(8)]
    w = htmltext.induce(pages)
    assert {t for _, t in w["template"]} == {"Read this site every day", "All rights"}
    assert htmltext.main_text(pages[3], w) == "3 own words of page 3"
    df = spark.createDataFrame([(i, f"http://h/{i}", p, "") for i, p in enumerate(pages)] + [(9, None, None, ""), (10, "http://h/9", "", "")], PAGES)
    got = {r.page_id: (r.text, r.n_chars) for r in htmltext.extract(df).collect()}
    assert got[5] == ("5 own words of page 5", 21) and got[9] == ("", 0) and got[10] == ("", 0)
    assert htmltext.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_every_slot_is_content():
    nested = '<div class="content"><h1>Title {0}</h1><div class="body"><p>{0} one</p><p>{0} two</p></div></div>'
    split = '<div class="s1"><p>{0} first half</p></div><p>Always here</p><div class="s2"><p>{0} second half of it</p></div>'
    for body, want in ((nested, "Title 3\n3 one\n3 two"), (split, "3 first half\n3 second half of it")):
        pages = [body.format(i) for i in range(8)]
        assert htmltext.main_text(pages[3], htmltext.induce(pages)) == want


def test_text_outside_articles_stays():
    page = "<main><article><p>card</p></article></main><div><p>The text itself {0}</p><p>and more</p></div><p>Read on</p><nav>menu</nav>"
    assert htmltext.main_text(page.format(3)) == "card\nThe text itself 3\nand more\nRead on"
    fixed = {"template": [["/p", "Read on"]], "slots": []}
    assert htmltext.main_text(page.format(3), fixed) == "card\nThe text itself 3\nand more"


def test_wrappers_see_all_pages(spark):
    own = "page {0} tells of things that no other page of this site tells of, number {0}"
    one = '<div class="one"><p>Read us daily</p><p>' + own + "</p></div>"
    two = '<section class="two"><p>Second layout</p><p>' + own + "</p></section>"
    rows = [(i, f"http://big/{i}", (one if i % 2 else two).format(i), "") for i in range(60)]
    rows += [(100 + i, f"http://small/{i}", one.format(100 + i), "") for i in range(3)]
    # the same article on two pages of a host, one sentence changed, is no template
    rows += [(200 + i, f"http://copy/{i}", "<div><p>A long paragraph that both of the copies have, word for word</p><p>" + str(i) + "</p></div>", "") for i in range(2)]
    # one page varies the boilerplate
    rows += [(300 + i, f"http://vary/{i}", one.format(300 + i).replace("daily", "weekly" if i == 4 else "daily"), "") for i in range(20)]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == len(rows)
    for i in [*range(60), 100, 101, 102, *(300 + i for i in range(20) if i != 4)]:
        assert got[i] == own.format(i), i
    assert got[304] == "Read us weekly\n" + own.format(304)
    assert got[201] == "A long paragraph that both of the copies have, word for word\n1"


def test_one_rule_at_every_number_of_pages(spark):
    own = "page {0} of {1} tells of things that no other page of this site tells of"
    sizes = (2, 3, 4, 5, 6, 7, 8, 12, 20, 120)
    rows, want = [], {}
    for n in sizes:
        for i in range(n):
            said = own.format(i, n)
            # one page varies the boilerplate: it is on SHARE of the pages from 4 on
            varied = "Read us weekly" if i == 1 else "Read us daily"
            # the same words on every page, but nowhere in the same place of the list
            items = [f"item {k} of {i} and {n}" for k in range(n)]
            items.insert(i, "Berlin")
            for kind, body, text in (
                ("vary", f"<p>{varied}</p><p>{said}</p>", said if n >= 4 and i != 1 else f"{varied}\n{said}"),
                ("list", "<ul>" + "".join(f"<li>{t}</li>" for t in items) + f"</ul><p>{said}</p>", "\n".join([*items, said])),
                ("tell", f"<h2>Every reader of ours is told so</h2><p>{said}</p>", said),
            ):
                want[len(rows)] = kind, n, i, text
                rows.append((len(rows), f"http://{kind}{n}/{i}", f"<div>{body}</div>", ""))
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert {k: (*want[k][:3], got[k]) for k in want} == want


def test_rows_of_neighbours_lose_no_pair(spark, monkeypatch):
    """Two pages that are neighbours across the end of a row; and the rule for pages at hand is the same."""
    page = "<div><h2>Every reader of ours is told so</h2><p>page {0} of {1} tells of things that no other page of this site tells of</p></div>"
    monkeypatch.setattr(htmltext, "ROW", 1)
    pages = spark.createDataFrame([(100 * n + i, f"http://h{n}/{i}", page.format(i, n), "") for n in (2, 3, 7) for i in range(n)], PAGES)
    assert all(r.text.startswith("page ") for r in htmltext.extract(pages).collect())
    for n in (2, 3, 7):
        assert len(htmltext.learn([page.format(i, n) for i in range(n)])) == 1
    assert htmltext.learn(["<p>A long paragraph of two copies, word for word</p><p>0</p>", "<p>A long paragraph of two copies, word for word</p><p>1</p>"]) == []


def test_wrappers_grow_with_their_layouts_alone(spark):
    def made(layouts):
        page = lambda k, i: f'<div class="l{k}"><p>Layout {k} says hello to its readers</p><h2 class="x{k}">Always the same</h2><p class="own">page {k} {i} tells what no other tells</p></div>'
        return spark.createDataFrame([(k * 8 + i, f"http://host/{k}/{i}", page(k, i), "") for k in range(layouts) for i in range(8)], PAGES)

    sizes = {}
    for layouts in (20, 80):
        rows = common.columns(made(layouts), page_id="long", url="string", html="string").withColumn("host", htmltext.host_of(F.col("url"))).withColumn("h", F.xxhash64("html"))
        sizes[layouts] = htmltext.wrappers(rows, htmltext.parsed(rows)).agg(F.count("*"), F.sum(F.size("fixed")), F.max(F.size("fixed"))).first()
        got = htmltext.extract(made(layouts)).collect()
        assert all(re.fullmatch(r"page \d+ \d+ tells what no other tells", r.text) for r in got) and len(got) == 8 * layouts
    assert tuple(sizes[20]) == (20, 40, 2) and tuple(sizes[80]) == (80, 160, 2)


@pytest.mark.parametrize("inner", ['<section class="social-impact"><p>{}</p></section>', '<section id="respond-to-crisis"><p>{}</p></section>', '<p class="related">{}</p>', '<figure class="widget"><p>{}</p></figure>'])
def test_names_of_what_an_article_is_about_stay(inner):
    page = "<article><h1>Title</h1><p>" + "An article has text. " * 20 + "</p>" + inner.format("This belongs to it.") + "</article>"
    assert htmltext.main_text(page).endswith("This belongs to it.")


def test_names_alone_take_no_article():
    m = htmltext.main_text
    assert m('<div class="widget-container"><article><p>The story goes on and on</p></article></div>') == "The story goes on and on"
    assert m('<article class="related-work"><h1>Hi</h1><p>long text is here</p></article>') == "Hi\nlong text is here"
    assert m('<nav>x</nav><div class="social-science"><p>text text</p></div>') == "text text"
    assert m("<article><h2>Teaser</h2></article><div><p>long story</p></div>") == "Teaser\nlong story"
    # what is named so beside an article goes, however long
    assert m('<div class="post"><p>story of length</p></div><div class="related"><p>another story, much longer than this one is</p></div>') == "story of length"
    assert m('<article><p>short</p><div class="ad"><p>' + "buy " * 50 + "</p></div></article>") == "short"


@pytest.mark.parametrize("name", ['class="commentlist"', 'class="user-comments-area"', 'id="comments"', 'class="x comment-list y"'])
def test_reader_comments_go(name):
    said = "".join(f'<li><article class="comment-body"><p>nice one {k}</p></article></li>' for k in range(40))
    assert htmltext.main_text(f"<article><p>story</p></article><ol {name}>{said}</ol>") == "story"
    assert htmltext.main_text(f'<div class="post has-comments"><h1>Head</h1><p>story</p><ol {name}>{said}</ol></div>') == "Head\nstory"


def test_comments_by_their_title():
    assert htmltext.main_text("<article><p>story</p></article><section><h3>3 Comments</h3><p>nice, is it not</p></section>") == "story"


def test_deep_long_and_odd_pages():
    deep = ["<div>" * 50_000 + f"<p>own {i}</p>same" for i in range(3)]
    assert htmltext.main_text(deep[1]) == "own 1\nsame" and len(htmltext.learn(deep)) == 1
    wide = ["<ul>" + "".join(f"<li>item {i} {k}</li>" for k in range(20_000 + 100 * i)) + "<li>same</ul>" for i in range(3)]
    assert htmltext.main_text(wide[2]).count("\n") == 20_200 and len(htmltext.learn(wide)) == 1
    for page in ("<a " * 100_000, "<p '>" * 50_000 + "x", "</b></p>" * 50_000, "<p><b>" * 50_000, "<div class=ad>" * 50_000 + "x", "<!-- " * 50_000, "<script>" * 50_000):
        htmltext.main_text(page)
    assert htmltext.main_text("a<!-- > b") == "a" and htmltext.main_text("a < b") == "a < b" and htmltext.main_text("<p>x<!-- > --> y") == "x y"


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_alignment_is_the_best(data):
    names = st.sampled_from(["p", "div", "li", "span"])
    grow = lambda kids: st.tuples(names, st.lists(kids, max_size=4))
    kind = st.recursive(st.tuples(names, st.sampled_from("ab")), grow, max_leaves=12)

    def html(t):
        return f"<{t[0]}x>{t[1] if isinstance(t[1], str) else ''.join(map(html, t[1]))}</{t[0]}x>"

    known, weight, trees = {}, {}, []
    for _ in range(2):
        page = "".join(html(t) for t in data.draw(st.lists(kind, max_size=4)))
        # inline names end no block: each is made one by a <br> of its own
        found = htmltext.parse(page.replace("x>", "x><hr>"))
        trees.append(htmltext.tree(found))
        htmltext.number(trees[-1], known)

    def best(a, b, bonus):
        if a.name != b.name:
            return 0.0
        n, m = len(a.kids), len(b.kids)
        t = [[0.0] * (m + 1) for _ in range(n + 1)]
        for i in range(n):
            for j in range(m):
                w = best(a.kids[i], b.kids[j], 0.0)
                w += bonus if w and a.kids[i].whole == b.kids[j].whole else 0.0
                t[i + 1][j + 1] = max(t[i][j + 1], t[i + 1][j], t[i][j] + w)
        return 1 + t[n][m]

    a, b = trees
    htmltext.shape_weights({a.shape}, {b.shape}, known, weight)
    assert weight[a.shape, b.shape] == best(a, b, 0.0)
    htmltext.shape_weights({k.shape for k in a.kids}, {k.shape for k in b.kids}, known, weight)
    row = htmltext.rows_of(a.kids, b.kids, weight)
    pairs = htmltext.align(row, *([k.whole for k in t.kids] for t in trees), tuple([k.shape for k in t.kids] for t in trees))
    assert 1 + sum(row(i, j, j + 1)[0] for i, j in pairs) == best(a, b, htmltext.EQUAL)
    assert all(x < y for x, y in zip(pairs, pairs[1:])) and len({j for _, j in pairs}) == len(pairs)


def test_short_ways_of_matching_change_no_pair(spark, sf, monkeypatch):
    """Alignments that names force, and matches within some elements alone, against matches of everything."""
    pages = [r.html.replace("<article>", "<article><p>Read us daily</p>") for r in spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").limit(30).collect()]
    short = htmltext.by_names
    n = 0
    for one, two in zip(pages, pages[1:]):
        known, trees = {}, [htmltext.tree(htmltext.parse(p)) for p in (one, two)]
        for t in trees:
            htmltext.number(t, known)
        monkeypatch.setattr(htmltext, "by_names", lambda a, b: None)
        full = [(id(x), id(y)) for x, y in htmltext.match(*trees, known, {})]
        monkeypatch.setattr(htmltext, "by_names", short)
        assert sorted((id(x), id(y)) for x, y in htmltext.match(*trees, known, {})) == sorted(full)
        leaf, todo = [], [trees[0]]
        while todo:
            e = todo.pop()
            todo += e.kids
            leaf += [e] if e.text is not None else []
        for some in (leaf[:1], leaf[-1:], leaf[len(leaf) // 2 :][:1]):
            within = {id(trees[0]), *(id(e) for e in some)}
            for e in some:
                while e.up is not None:
                    e = e.up
                    within.add(id(e))
            got = {(id(x), id(y)) for x, y in htmltext.match(*trees, known, {}, within)}
            assert got == {p for p in full if p[0] in {id(e) for e in some}}
            n += len(got)
    assert n > 30


def test_text_of_all_pages(spark, sf):
    """Against the article's markup, cut by hand: the test pages have all their text in one article."""
    got = {r.page_id: r.text for r in queries.op2_html_text(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(rows) > 0
    import html

    for r in rows:
        body = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        body = re.sub(r"<(script|style|aside|form|nav|section)\b.*?</\1>|<!--.*?-->|<div class=\"?(ad|comments?)\b.*?</div>", "", body, flags=re.DOTALL)
        parts = re.split(r"</?(?:p|h\d|ul|li|ol|div|blockquote|table|tr|td|header)\b[^>]*>", re.sub(r"<br>", " ", body))
        want = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts]
        assert got[r.page_id] == "\n".join(x for x in want if x), r.page_id


def test_many_wrappers_are_joined_by_a_shuffle(spark):
    own = "page {0} tells of things that no other page of this site tells of, number {0}"
    rows = [(i, f"http://h{i % 3 if i % 2 else 0}/{i}", f"<div><p>Read us daily, dear reader {i % 3 if i % 2 else 0}</p><p>{own.format(i)}</p></div>", "") for i in range(90)] + [(1000 + i, None, f"<p>{i}</p>", "") for i in range(20)]
    pages = spark.createDataFrame(rows, PAGES)
    want = sorted((r.page_id, r.text) for r in htmltext.extract(pages).collect())
    assert sorted((r.page_id, r.text) for r in htmltext.extract(pages, broadcast=0, split=7).collect()) == want
    assert want[5] == (5, own.format(5))


STRANGE = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, row_key string, _id long, _out string, _kept int, hit int, own int, out int, mine int, rest int, uid int, number int, dropped long, n_lines string, n_removed string, key int, `c``d` int"


def strange(spark, rows):
    n = len(STRANGE.split(", ")) - 5
    kinds = [c.split()[-1] for c in STRANGE.split(", ")[5:]]
    return spark.createDataFrame([(*r[:4], len(r[1] or ""), *(f"s{k}" if kinds[k] == "string" else 100 * i + k for k in range(n))) for i, r in enumerate(rows)], STRANGE)


@pytest.mark.parametrize("name", ["quality rules", "language ID", "line dedup", "MinHash near-dedup"])
def test_stages_keep_all_columns(spark, sf, name):
    pipeline = pytest.importorskip("corpus_pipeline")
    stage = dict(pipeline.STAGES)[name]
    said = "these are plain words of a text that has enough of them to pass every base rule there is number {0} one more {0}"
    rows = [(i, said.format(i) + f"\nshared line of all sites\nown {i}", "en", f"s{i % 12}") for i in range(24)]
    rows += [(5, said.format(5), "en", "x"), (5, rows[5][1], "en", "x"), (None, "shared line of all sites\n" + said.format(77), "en", None), (None, said.format(78), "en", None), (40, None, None, None), (None, None, None, None), (41, "", "en", "a"), (42, "12 34", "de", "b"), (42, "12 34", "de", "b")]
    docs = strange(spark, rows)
    got = stage(spark, docs, sf)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    # each row's other columns came with it
    by = {r["_id"]: r for r in docs.collect()}
    kept = got.collect()
    assert 0 < len(kept) <= len(rows) and all(tuple(r)[5:] == tuple(by[r["_id"]])[5:] and r.doc_id == by[r["_id"]].doc_id for r in kept)
    texts = [(r.doc_id, r.text) for r in kept]
    if name == "quality rules":
        assert sorted(map(repr, texts)) == sorted(repr(r[:2]) for r in rows if r[1] and len(r[1].split()) >= 20)
    if name == "line dedup":
        assert (None, said.format(77)) in texts and (0, rows[0][1]) in texts and (1, said.format(1) + "\nown 1") in texts and (40, None) in texts
        assert len(texts) == len(rows)
    if name == "MinHash near-dedup":
        assert texts.count((5, rows[5][1])) == 1 and (None, None) in texts and texts.count((42, "12 34")) == 1
    assert stage(spark, docs.limit(0), sf).count() == 0


def in_duckdb(sql, docs, sf):
    c = duckdb.connect()
    c.register("documents", docs.toArrow())
    c.execute(f"create view labels as select * from '{sf}/labels.parquet'")
    return c.execute(sql)


def test_pipeline(spark, sf):
    """Each stage against a brute-force version of what it must do to all its predecessor kept."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = common.materialize(stage(spark, before, sf), "stage")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        texts, had = ({r.doc_id: r.text for r in d.collect()} for d in (docs, before))
        assert len(texts) == docs.count() > 0
        if name == "quality rules":
            want = {r[0]: had[r[0]] for r in in_duckdb(f"select doc_id from ({quality.oracle()}) where kept", before, sf).fetchall()}
        elif name == "language ID":
            want = {r.doc_id: had[r.doc_id] for r in langid.identify(before).filter("lang_pred != 'und' and score >= 0.35").collect()}
        elif name == "line dedup":
            rows = in_duckdb(linededup.oracle(), before, sf).fetchall()
            want = {i: t for i, _, gone, t in rows if not gone or re.search(r"[^\x20\x09-\x0D]", t)}
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        else:
            want = {i: had[i] for i, (_, c) in brute_near(list(had.items())).items() if i == c}
        assert texts == want, name
    e, fill = _coder("byte_bpe_50k.json"), collections.defaultdict(list)
    ids = {i: np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    parts = collections.defaultdict(list)
    for r in pipeline.STAGES[-1][1](spark, docs, sf).collect():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        fill[r.sequence_id].append((r.offset, r.length))
        parts[r.doc_id].append((r.start, r.length))
    assert all(sum(n for _, n in own) <= 2048 for own in fill.values()) and set(parts) == set(ids)
    for i, own in parts.items():
        assert [a for a, _ in sorted(own)] == [0, *np.cumsum([n for _, n in sorted(own)])[:-1].tolist()] and sum(n for _, n in own) == len(ids[i])
