"""Language model, language identification, pieces, wavelet shards: exact or brute-force checks."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskloom.llm import chain, crf, hmm, pieces, queries, wavelet
from riskloom.llm.common import crc_of_id
from riskloom.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a b\tC", "en", "s", 5), (1, "a b\tC", "en", "s", 5), (2, None, None, None, None), (3, "", "en", None, 0), (4, "12 | 34", "de", "s", 7), (5, "word " * 30_000, "fr", "s", 150_000), (None, "é ß ç", "fr", "t", 5)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit(1)).withColumn("ids", F.lit("x")).withColumn("kept", F.lit(2))


def tokens(text):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())] + [b"\n"]


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    start, move, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.random((5, 3))
    lengths = np.array([4, 1, 6])
    symbols = rng.integers(0, 5, 11)
    got = chain.log_likelihood(chain.Layout(lengths), symbols, start, move, emit)
    at = 0
    for n, g in zip(lengths, got, strict=True):
        a = start * emit[symbols[at]]
        for s in symbols[at + 1 : at + n]:
            a = (a @ move) * emit[s]
        assert math.isclose(math.log10(a.sum()), g, rel_tol=1e-12)
        at += n


def test_posteriors_by_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    start, move, e = rng.random(2), rng.random((2, 2)), rng.random((4, 2))
    gamma, moves = chain.posteriors(chain.Layout(np.array([4])), e, start, move)
    want, want_moves, z = np.zeros((4, 2)), np.zeros((2, 2)), 0
    for path in product(range(2), repeat=4):
        p = start[path[0]] * e[0, path[0]]
        for t in range(1, 4):
            p *= move[path[t - 1], path[t]] * e[t, path[t]]
        z += p
        for t in range(4):
            want[t, path[t]] += p
        for t in range(3):
            want_moves[path[t], path[t + 1]] += p
    assert np.allclose(gamma, want / z) and np.allclose(moves, want_moves / z)


def test_hmm_base_score_and_gain(spark, sf_dir):
    docs = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    c = Counter(t for d, x in docs.items() if not held[d] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    rows = queries.QUERIES["op1_hmm_score"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        t = tokens(docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[x] > 0 for x in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_hmm_probabilities_sum_to_one(spark):
    """Over all known words and each class's unseen slot, the one-token probabilities add up to 1."""
    settings = hmm.Settings(own_words=2, looked_up=3, classes=4, rounds=1, init_texts=5)
    docs = spark.createDataFrame([(i, "a a b c d e") for i in range(4)], "doc_id long, text string")
    counts = hmm.word_counts(docs.select("text"), settings)
    v = hmm.vocabulary(counts, settings)
    per_class = {}
    for r in counts.collect():
        if r.word not in list(v.index)[: v.own]:
            per_class.setdefault(r["class"], []).append(r.c)
    for k, cs in per_class.items():
        assert (sum(x + 1 for x in cs) + 1) / (v.class_tokens[k] + v.class_words[k] + 1) == 1


def test_hmm_edge_rows(spark, odd):
    rows = hmm.score(odd, held_out=crc_of_id("doc_id") % 7 == 2).collect()
    assert len(rows) == len(ODD) and all(r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
    assert hmm.score(odd.limit(0)).count() == 0
    assert {r.score for r in hmm.score(odd, held_out=F.lit(True)).collect()} == {0.0}


def test_hmm_states_differ_with_copies(spark):
    """A large group of copies leaves no two states alike, and the start reads every text."""
    rows = [("the same old text again",)] * 1_600 + [(f"alpha beta {i % 7} gamma {i % 5}",) for i in range(200)]
    words = sorted({w.encode() for (t,) in rows for w in t.split()} | {hmm.END})
    at = {w: i for i, w in enumerate(words)}
    symbols = [(np.array([at[w.encode()] for w in t.split()] + [at[hmm.END]], np.uint16).tobytes(),) for (t,) in rows]
    encoded = spark.createDataFrame([(False, bytearray(x)) for (x,) in symbols], "held_out boolean, symbols binary")
    shared = np.full(len(words), 1 / len(words))
    model = hmm.baum_welch(encoded, shared, hmm.Settings(states=4, init_rounds=2, rounds=1))
    gaps = [np.abs(model.emit[:, a] - model.emit[:, b]).max() for a in range(4) for b in range(a)]
    assert min(gaps) > 1e-3
    total = np.zeros((len(words) + 5, 4))
    flat = [np.frombuffer(x, np.uint16).astype(np.int64) for (x,) in symbols]
    hmm.started(np.concatenate(flat), np.array([len(x) for x in flat]), total)
    assert total[: len(words)].sum() == sum(map(len, flat))


def test_hmm_score_equals_a_recursion_over_words(spark, sf_dir, monkeypatch):
    """Own words, looked-up class words, joined rare words and unseen ones, from the trained arrays alone."""
    made = {}

    def seen(name):
        f = getattr(hmm, name)
        monkeypatch.setattr(hmm, name, lambda *a: made.setdefault(name, f(*a)))

    seen("vocabulary")
    seen("baum_welch")
    settings = hmm.Settings(states=3, own_words=40, looked_up=150, classes=16, rounds=1, init_rounds=2)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id").limit(150)
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    got = {r.doc_id: r.score for r in hmm.score(docs, held_out=crc_of_id("doc_id") % 7 == 2, settings=settings).collect()}
    v, model = made["vocabulary"], made["baum_welch"]
    own = list(v.index)[: v.own]
    words_of = {d: hmm.words(x) + [hmm.END] for d, x in texts.items()}
    c = Counter(w for d, ws in words_of.items() if not held[d] for w in ws)
    of_class = [[n for w, n in c.items() if w not in own and hmm.word_class(w, 16) == k] for k in range(16)]
    assert any(0 < c[w] and w not in v.index for ws in words_of.values() for w in ws)  # some are joined
    for d, ws in words_of.items():
        state, log = model.start, 0.0
        for w in ws:
            k = hmm.word_class(w, 16)
            share = 1.0 if w in own else (c[w] + 1) / (sum(of_class[k]) + len(of_class[k]) + 1)
            p = state * model.emit[own.index(w) if w in own else len(own) + k] * share
            log += math.log10(p.sum())
            state = p / p.sum() @ model.move
        assert math.isclose(got[d], log, rel_tol=1e-9)


def test_hmm_refuses_symbols_that_dont_fit(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="symbols"):
        hmm.score(docs, settings=hmm.Settings(own_words=65_000, classes=1_000))


def test_hmm_pair_counts_equal_enumeration(monkeypatch):
    r = np.random.default_rng(3)
    s, k = 6, 3
    model = hmm.Model(r.dirichlet(np.ones(k)), r.dirichlet(np.ones(k), k), r.dirichlet(np.ones(s), k).T)
    occupied = r.dirichlet(np.ones(k))
    texts = [r.integers(0, s, n) for n in (1, 2, 5, 9, 9, 30)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.astype(np.uint16).tobytes() for t in texts])], ["symbols"])
    (out,) = hmm._pairs(s, 1000)([batch])
    assert sum(out.column(1).to_pylist()) == sum(map(len, texts))
    want = np.zeros((s + k + 1, k))
    for t in texts:
        p = model.start * model.emit[t[0]] / (model.start @ model.emit[t[0]])
        want[s + k] += p
        want[t[0]] += p
        for a, b in zip(t[:-1], t[1:], strict=True):
            p = occupied[:, None] * model.move * np.outer(model.emit[a], model.emit[b])
            p /= p.sum()
            want[s : s + k] += p
            want[a] += p.sum(axis=1)
            want[b] += p.sum(axis=0)
    monkeypatch.setattr(hmm, "PAIRS", 7)
    got = np.zeros_like(want)
    hmm.expected_pair_counts(model, occupied, out.column(0).to_numpy(), out.column(1).to_numpy(), got)
    assert np.allclose(got, want, atol=1e-5)


def test_language_held_out_accuracy(spark, sf_dir):
    got = queries.QUERIES["op2_crf_language"](spark, sf_dir)
    both = got.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred != 'und'")
    right, n = both.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert right >= 0.95 * n


def test_language_edge_rows(spark, odd):
    model = crf.fit_on(odd, "text", "lang")
    got = {r.doc_id: (r.lang_pred, r.score) for r in crf.predict(odd, model).collect()}
    assert got[2] == got[3] == got[4] == ("und", 0.0) and got[5][0] == "fr"
    assert crf.predict(odd.limit(0), model).count() == 0
    none = crf.fit_on(odd.withColumn("lang", F.lit(None).cast("string")), "text", "lang")
    assert {r.lang_pred for r in crf.predict(odd, none).collect()} == {"und"}


def test_language_fit_with_copies(spark):
    """Copies count once: a label of few texts in many rows is fitted on all of them."""
    few = spark.range(60_000).selectExpr("concat('wort nummer ', id % 50) AS text", "'de' AS lang")
    many = spark.range(2_000).selectExpr("concat('word number ', id) AS text", "'en' AS lang")
    seen = {}
    settings = crf.Settings(fit_texts=40, epochs=1)
    fit, crf.fit = crf.fit, lambda rows, settings: seen.update(rows=rows)
    try:
        crf.fit_on(few.union(many), "text", "lang", settings)
    finally:
        crf.fit = fit
    assert Counter(lang for _, lang in seen["rows"]) == {"de": 40, "en": 40}


def test_code_switched_words():
    de = ["der und die ist nicht auf haus " * 3] * 4
    fr = ["les une est pas dans maison elle " * 3] * 4
    m = crf.fit([(t, "de") for t in de] + [(t, "fr") for t in fr], crf.Settings(buckets=1 << 12))
    mixed = crf.tokens("der haus ist nicht les maison une elle")
    seen, at, n = crf._index([mixed])
    layout = chain.Layout(n)
    gamma, _ = chain.posteriors(layout, crf._exp(crf.word_scores(m, seen))[at[layout.order]], np.exp(m.start), np.exp(m.move))
    assert gamma.argmax(axis=1).tolist() == [0] * 4 + [1] * 4
    texts = [(crf.tokens(t), np.full(len(crf.tokens(t)), y)) for y, group in enumerate((de, fr)) for t in group]
    made = crf.switched(texts, crf.Settings(switch=1))
    assert made and all(len(w) == len(y) and {0, 1} == set(y.tolist()) for w, y in made)
    assert all((x in crf.tokens(fr[0])) == bool(g) for w, y in made for x, g in zip(w, y.tolist(), strict=True))


def test_words_of_switched_texts(spark, sf_dir):
    """Word by word on texts of two languages in turn, made of documents that took no part in the fit."""
    rows = [(r.text, r.lang) for r in table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL").orderBy("doc_id").collect()]
    m = crf.fit(sorted(rows[::2]), crf.Settings())
    texts = [(crf.tokens(t), np.full(len(crf.tokens(t)), m.labels.index(y))) for t, y in rows[1::2] if len(crf.tokens(t)) > 60]
    right = n = 0
    for words, gold in crf.switched(texts, crf.Settings(switch=1)):
        seen, at, lengths = crf._index([words])
        layout = chain.Layout(lengths)
        gamma, _ = chain.posteriors(layout, crf._exp(crf.word_scores(m, seen))[at[layout.order]], np.exp(m.start), np.exp(m.move))
        right += (gamma.argmax(axis=1) == gold).sum()
        n += len(gold)
    assert n > 1_000 and right >= 0.97 * n


def test_pieces_equal_the_library(spark, sf_dir, odd):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    e = pieces.Encoder(pieces.Table.load(path))
    r = random.Random(3)
    made = ["".join(r.choice("ab ein\n\t🙂é中▁\x00<>/s|  ") for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for x in made:
        ids = sp.encode(x, add_eos=True)
        assert e.encode(x)[0] == ids and pieces.decode(e.t, ids) == sp.decode(ids)
    texts = {x.doc_id: x.text for x in table(spark, sf_dir, "documents").collect()}
    for row in queries.QUERIES["op3_piece_roundtrip"](spark, sf_dir).collect():
        ids = sp.encode(texts[row.doc_id], add_eos=True)
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert row.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    back = pieces.decoded(pieces.encode(odd, path), path).select("doc_id", "text").collect()
    assert sorted((x.text or "") for x in back) == sorted((x[1] or "") for x in ODD)


def test_wavelet_matrix_queries():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 513, 3000):
        ids = rng.integers(0, 300, n).astype(np.uint16)
        m, extra = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 9).to_bytes(b"more"))
        assert extra == b"more" and (m.all() == ids).all()
        for i in range(0, n, 101):
            v = int(ids[i])
            where = np.flatnonzero(ids == v)
            assert m.access(i) == v and m.rank(v, i) == int((ids[:i] == v).sum()) and m.select(v, 0) == where[0] and m.select(v, len(where)) == -1


def test_wavelet_shards_equal_the_library(spark, sf_dir, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    start = 0
    got = {r.doc_id: r for r in queries.QUERIES["op8_wavelet_shards"](spark, sf_dir).collect()}
    for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        g = got[r.doc_id]
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) and g.n_ends == ids.count(0)
        start += len(ids)
    e = wavelet.UnitEncoder(path)
    r = random.Random(4)
    made = ["".join(r.choice([" ", "  ", "\n", "a", "'s", "1", ".", "é", "\xa0", "　", "\x1c", "<|endoftext|>", "the"]) for _ in range(r.randint(0, 12))) for _ in range(2000)]
    made += [None, "", "x" * 50_000 + " y"]
    e.slice_bytes = 500  # several slices
    for x, ids in zip(made, [x for ids, n in e.encoded(made) for x in np.split(ids, np.cumsum(n)[:-1])], strict=True):
        assert ids.tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 0]
    shards = wavelet.write_shards(odd, path, shard_tokens=100)
    assert sorted((r.doc_id or 0) for r in wavelet.read_documents(shards).collect()) == [0, 1, 1, 2, 3, 4, 5] and shards.count() > 1
    assert wavelet.occurrences(shards, 0).agg(F.sum("n")).first()[0] == 7
    many = table(spark, sf_dir, "documents").select((F.col("doc_id") - 50).alias("doc_id"), "text")
    shards = wavelet.write_shards(many, path, shard_tokens=3_000, ranges=5)
    assert shards.select("bucket").distinct().count() > 1
    assert {(x.doc_id + 50, x.start, x.ids_crc32) for x in wavelet.read_documents(shards).collect()} == {(x.doc_id, x.start, x.ids_crc32) for x in got.values()}
    assert wavelet.read_documents(wavelet.write_shards(odd.limit(0), path)).count() == 0


def test_ids_of_a_slice_are_laid_end_to_end_without_an_index_for_each():
    e = wavelet.UnitEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["zqxjkv" * 6 + " " + "the zqxjkvzqxjkvzqxjkv, " * 20_000 + str(i) for i in range(4)]
    e._slice(texts)  # units are known from now on
    tracemalloc.start()
    try:
        ids, sizes = e._slice(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [ids[b - n : b].tolist() for n, b in zip(sizes, np.cumsum(sizes), strict=True)] == [[*e.t.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert peak < 16 * len(ids)  # two 64-bit places for each id
