"""Repeats, fingerprints, near duplicates, neighbours, archive records, packing, and the pipeline."""

import base64
import gzip
import hashlib
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import common, forest, iblt, near, packing, queries, simhash, suffix, warc
from riskloom.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)


def uncovered(texts, size):
    c = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if c[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        out.append((len(t), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), bytes(x for x, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 500])
def test_repeats_by_brute_force(spark, limit):
    r = random.Random(limit)
    base = "".join(r.choice("abcdé ") for _ in range(600))
    texts = [None, "", "x" * 1000, base, base, base[100:400] + "tail", "head" + base[50:300], "ab" * 300]
    texts += ["".join(base[r.randrange(500) :][: r.randint(30, 200)] for _ in range(4)) for _ in range(12)]
    docs = frame(spark, list(enumerate(texts))).withColumn("kept", F.lit(1)).withColumn("runs", F.lit("own")).withColumn("thash", F.lit(5))
    assert suffix.remove_repeats(docs, size=64, limit=limit).where("runs = 'own' AND thash = 5").count() == len(texts)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in suffix.remove_repeats(docs, size=64, limit=limit).collect()}
    want = uncovered([(t or "").encode() for t in texts], 64)
    assert got == dict(enumerate(want))
    lost = frame(spark, [(None, base), (None, base[:200] + "other"), (3, "clean")])
    assert sorted((x.doc_id or 0, x.n_removed > 0) for x in suffix.remove_repeats(lost, size=64, limit=limit).collect()) == [(0, True), (0, True), (3, False)]


def test_repeats_query_and_empty(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    want = uncovered([d.text.encode() for d in docs], 400)
    got = {r.doc_id: r for r in queries.QUERIES["op4_suffix_dedup"](spark, sf_dir).collect()}
    for d, (n, gone, runs, kept) in zip(docs, want, strict=True):
        g = got[d.doc_id]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == (n, gone, runs, hashlib.sha256(kept).hexdigest())
        assert g.n_passage_bytes >= g.n_removed
    assert suffix.remove_repeats(frame(spark, [(1, "a")]).limit(0), passage=51).count() == 0


def test_rows_with_one_id_and_text(spark):
    """Each row's runs once, however many rows say the same."""
    r = random.Random(6)
    text = "".join(r.choice("abcdefgh ") for _ in range(5_000))
    for ids in ([None] * 60, [4] * 60):
        rows = frame(spark, [(i, text) for i in ids])
        named = rows.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), F.xxhash64("text").alias("thash"), "text")
        (found,) = suffix.repeated(named, [(400, suffix.BYTES)])[0].collect()
        assert len(found.runs) < 60 and sum(b - a for a, b in found.runs) == 5_000 - 399
        assert {(x.n_removed, x.n_spans) for x in suffix.remove_repeats(rows).collect()} == {(5_000, 1)}


def without_passages(texts, words=51, size=400):
    places = [[(m.start(), m.end()) for m in re.finditer(rb"[^\t-\r ]+", t)] for t in texts]
    said = Counter(tuple(t.split()[i : i + words]) for t in texts for i in range(len(t.split()) - words + 1))
    held = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t, at in zip(texts, places, strict=True):
        gone = set()
        for i in range(len(at) - words + 1):
            if said[tuple(t.split()[i : i + words])] > 1:
                gone.update(range(at[i][0], at[i + words - 1][1]))
        for i in range(len(t) - size + 1):
            if held[t[i : i + size]] > 1:
                gone.update(range(i, i + size))
        out.append(bytes(x for i, x in enumerate(t) if i not in gone))
    return out


@pytest.mark.parametrize("limit", [1 << 20, 500])
def test_repeats_stage_by_words(spark, limit):
    """51 short words go, 50 stay, other spacing is no other passage, and 400 bytes of few words still go."""
    r = random.Random(4)

    def said(n):
        return [r.choice("aeiou") + r.choice("xyz") + str(r.randrange(900)) for _ in range(n)]

    p, q, long = said(51), said(50), "z".join(said(120))
    texts = [" ".join(said(20) + x + said(30)) for x in (p, p, q, q, [long], [long])]
    texts += ["  ".join(said(9) + p + said(5)), " ".join(p), " ".join(said(200)), None, ""]
    docs = frame(spark, list(enumerate(texts)))
    want = [x.decode() for x in without_passages([(t or "").encode() for t in texts])]
    got = suffix.remove_repeats(docs, limit=limit, as_text=True, passage=corpus_pipeline.PASSAGE)
    told = {x.doc_id: x for x in suffix.remove_repeats(docs, limit=limit, passage=corpus_pipeline.PASSAGE).collect()}
    for i, (t, w) in enumerate(zip(texts, want, strict=True)):
        assert told[i].n_passage_bytes == len((t or "").encode()) - len(w) and told[i].n_removed == uncovered([(x or "").encode() for x in texts], 400)[i][1]
    assert {x.doc_id: x.kept for x in got.collect()} == dict(enumerate(want))
    assert want[7] == "" and " ".join(q) in want[2] and long not in want[4]
    if limit > 500:
        assert {x.doc_id: x.text for x in corpus_pipeline.repeats(spark, docs, "").collect()} == dict(enumerate(want))


def test_batches_of_texts_are_bounded(spark, tmp_path, monkeypatch):
    """Texts of 14 MB in one partition: what reads them never holds a batch of them all."""

    def watched(name, make):
        def made(*settings):
            run = make(*settings)

            def seen(batches):
                for b in batches:
                    with (tmp_path / name).open("a") as said:
                        said.write(f"{b.nbytes}\n")
                    yield b

            return lambda batches: run(seen(batches))

        return made

    for name in ("_spans", "_keep"):
        monkeypatch.setattr(suffix, name, watched(name, getattr(suffix, name)))
    words = F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: F.hex(F.xxhash64("id", i)))
    docs = spark.range(0, 1_600, 1, 1).select(F.col("id").alias("doc_id"), F.concat_ws(" ", words).alias("text"))
    assert suffix.remove_repeats(docs).agg(F.sum("n_removed")).first()[0] == 0
    for name in ("_spans", "_keep"):
        sizes = [int(x) for x in (tmp_path / name).read_text().split()]
        assert sum(sizes) > 12_000_000 and max(sizes) < 1.1 * common.BATCH_BYTES, name


def test_merged_transforms():
    r = random.Random(7)
    for _ in range(60):
        base = bytes(r.choice(b"ab") for _ in range(200))
        members = [b"".join(base[r.randrange(150) :][: r.randint(20, 90)] for _ in range(5)) + b"z" * 70 for _ in range(r.randint(1, 6))]
        c = Counter(m[i : i + 64] for m in members for i in range(len(m) - 63))
        for m, flags in zip(members, suffix.repeated_windows(members, 64, dealt=[r.randrange(3) for _ in members]), strict=True):
            assert flags.tolist() == [c[m[i : i + 64]] > 1 for i in range(len(m) - 63)]
        (twice, *_) = suffix.repeated_windows(members, 64, times=[2] + [1] * (len(members) - 1))
        assert twice.all()
        words = [np.array([x % 3 for x in m], "<u8").tobytes() for m in members]
        c = Counter(w[i : i + 8 * 9] for w in words for i in range(0, len(w) - 71, 8))
        for w, flags in zip(words, suffix.repeated_windows(words, 9, suffix.WORDS, dealt=[r.randrange(3) for _ in members]), strict=True):
            assert flags.tolist() == [c[w[i : i + 72]] > 1 for i in range(0, len(w) - 71, 8)]
    wide = suffix._order(np.array([70_000, 3, 1 << 20, 70_000, 65_536, 3], np.int32))
    assert wide.tolist() == [1, 5, 4, 0, 3, 2]


def paragraphs(text):
    return {p.strip(" ") for p in (text or "").split("\n")} - {""}


def parsed(fingerprint):
    """Blocks of {cell: (count, digests, checks)} from a fingerprint alone."""
    size, blocks, cells = fingerprint.split(":")
    size, blocks = int(size), int(blocks)
    assert len(cells) == 36 * size * blocks
    each = [cells[i : i + 36] for i in range(0, len(cells), 36)]
    each = [(int(c[:4], 16), int(c[4:20], 16), int(c[20:], 16)) for c in each]
    return size, [each[i : i + size] for i in range(0, len(each), size)]


def peel(size, cells):
    cells, found = list(cells), set()
    while True:
        pure = [(c, k) for c, k, h in cells if abs(c) == 1 and h == check(k)]
        if not pure:
            return found if all(x == (0, 0, 0) for x in cells) else None
        c, k = pure[0]
        found.add(k)
        for j in range(3):
            signed = hash_of(k, size * 10 + j)
            at = signed % (size // 3) + size // 3 * j
            n, x, h = cells[at]
            cells[at] = (n - c, x ^ k, h ^ check(k))


def hash_of(k, seed):
    """Spark's xxhash64 of a long and an int, signed."""
    h = xxhash.xxh64_intdigest(k.to_bytes(8, "little"), 42)
    h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def check(k):
    return hash_of(k, 1_000_003) & (1 << 64) - 1


def like_from(a, b):
    """Likeness from two fingerprints and nothing else."""
    (sa, xs), (sb, ys) = parsed(a), parsed(b)
    if (sa, len(xs)) == (sb, len(ys)):
        left = [peel(sa, [(p[0] - q[0], p[1] ^ q[1], p[2] ^ q[2]) for p, q in zip(x, y, strict=True)]) for x, y in zip(xs, ys, strict=True)]
        if None not in left:
            n, d = (sum(c for x in s for c, *_ in x) // 3 for s in (xs, ys)), sum(map(len, left))
            total = sum(n)
            return (total - d) / (total + d) if total else 1.0
    one, other = (set().union(*(peel(s, x) for x in blocks)) for s, blocks in ((sa, xs), (sb, ys)))
    return len(one & other) / len(one | other) if one | other else 1.0


def test_fingerprints(spark, sf_dir):
    docs = sorted(((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()), reverse=True)
    got = {r.doc_id: r for r in queries.QUERIES["op5_iblt_fingerprint"](spark, sf_dir).collect()}
    by_text = {}
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for (i, t), (j, u) in zip(docs, [*docs[1:], docs[0]], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        g = got[i]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert g.near_edited == pytest.approx(like(paragraphs(t), paragraphs(edited))) and g.near_next == pytest.approx(like(paragraphs(t), paragraphs(u)))
        assert g.near_edited == pytest.approx(like_from(g.fingerprint, g.edited_fingerprint)) and g.near_next == pytest.approx(like_from(g.fingerprint, got[j].fingerprint))
        for text, f in ((t, g.fingerprint), (edited, g.edited_fingerprint)):
            assert by_text.setdefault(text, f) == f


def test_fingerprint_edge_rows(spark):
    lines = "\n".join(f"line {i}" for i in range(3_000))
    rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (3, "two"), (7, "line\n" * 5), (9, "w" * 50_000), (11, lines), (12, lines + "\nmore")]
    got = iblt.edited_likeness(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r.near_next <= 1 for r in got)
    assert {r.doc_id: r.near_next for r in got}[12] == pytest.approx(3_000 / 3_001)
    lone = iblt.edited_likeness(frame(spark, [(1, "abc")])).first()
    assert lone.near_next == 1.0 and lone.edited_text == "aba"
    assert iblt.edited_likeness(frame(spark, rows).limit(0)).count() == 0


def test_peeling_recovers_or_fails(spark):
    d = spark.range(1).select(F.array(*[F.lit(i * 7919) for i in range(12)]).cast("array<long>").alias("a"), F.array(*[F.lit(i * 7919) for i in range(3, 14)]).cast("array<long>").alias("b"))
    both = d.select(iblt.sketched(F.col("a")).alias("a"), iblt.sketched(F.col("b")).alias("b"))
    found = both.select(iblt.difference(F.col("a"), F.col("b")).alias("d")).first().d
    assert sorted(found) == sorted(i * 7919 for i in (0, 1, 2, 12, 13))
    three, none = F.lit(3), F.array().cast("array<long>")
    small = d.select(iblt.peeled(iblt.subtracted(iblt.sketch(F.col("a"), three), iblt.sketch(none, three)), three).alias("d")).first().d
    assert small is None
    again = d.select(iblt.block_difference(F.col("a"), none, F.lit(0)).alias("d")).first().d  # 12 digests don't come out of 12 cells
    assert sorted(again) == [i * 7919 for i in range(12)]


def test_range_buckets(spark):
    from riskloom.llm.common import range_bucket

    bounds = [float(x) for x in range(-20, 300, 7)]
    rows = spark.range(-50, 400).union(spark.sql("SELECT CAST(NULL AS LONG)")).select("id", range_bucket("id", bounds).alias("b")).collect()
    assert all(r.b == (0 if r.id is None else sum(b <= r.id for b in bounds)) for r in rows)


def brute_components(prints):
    nodes = sorted(set(prints.values()))
    parent = list(range(len(nodes)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for j in range(i):
            if (a ^ nodes[j]).bit_count() <= 4:
                parent[top(i)] = top(j)
    at = {n: top(i) for i, n in enumerate(nodes)}
    least = {}
    for d, f in prints.items():
        least[at[f]] = min(least.get(at[f], d), d)
    return {d: least[at[f]] for d, f in prints.items()}


def slow_print(text):
    w = [x.lower() for x in (text or "").encode().split()]
    if not w:
        return 0
    h = [xxhash.xxh64(b" ".join(w[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_components_by_brute_force(spark, sf_dir):
    prints = {r.doc_id: slow_print(r.text) for r in table(spark, sf_dir, "documents").collect()}
    want = brute_components(prints)
    got = queries.QUERIES["op6_simhash_components"](spark, sf_dir).collect()
    assert {(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got} == {(d, prints[d], want[d]) for d in prints}


def test_dense_links(spark):
    r = random.Random(1)
    values = {r.getrandbits(64) for _ in range(200)}
    seed = r.getrandbits(64)
    for _ in range(400):
        seed ^= 1 << r.randrange(64) | 1 << r.randrange(64)
        values.add(seed)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes, shard=16)).collect()}
    want = brute_components({v: v & (1 << 64) - 1 for v in signed})
    groups = Counter(want.values())
    assert {v: roots.get(v, v) for v in signed} == want and max(groups.values()) > 300


def test_bk_tree():
    r = random.Random(3)
    seeds = [r.getrandbits(64) for _ in range(5)]
    values = [s ^ sum(1 << r.randrange(64) for _ in range(r.randint(0, 9))) & (1 << 64) - 1 for s in seeds for _ in range(60)]
    v = np.array(values, np.uint64)
    tree = simhash.BKTree(v[:200])
    for at, below in enumerate(tree.children):
        assert all(int(v[at] ^ v[c]).bit_count() == k for k, c in below.items())
    got = {(n, int(q)) for n, who in tree.hits(v[100:], 4) for q in who}
    assert got == {(i, j) for i in range(200) for j in range(200) if int(v[i] ^ v[100 + j]).bit_count() <= 4}


def test_simhash_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, "ONE"), (6, "w " * 30_000)]
    got = {(r.doc_id, r.component_id) for r in simhash.clusters(frame(spark, rows).withColumn("fp", F.lit(1))).collect()}
    assert {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)} <= got
    assert simhash.clusters(frame(spark, rows).limit(0)).count() == 0
    lost = [(None, "a b c d e f g"), (None, "a b c d e f g"), (7, "a b c d e f g"), (None, "alone it stands here now")]
    assert Counter(r.component_id for r in simhash.clusters(frame(spark, lost)).collect()) == {7: 3, None: 1}
    assert sorted(r.doc_id for r in simhash.representatives(frame(spark, rows)).collect()) == [1, 4, 6]


@pytest.mark.parametrize("keep", [simhash.representatives, near.representatives])
def test_representatives_of_rows_without_or_with_shared_ids(spark, keep):
    rows = [(None, "a lone text that nothing else is like at all"), (None, "twice here"), (None, "twice here"), (9, "with and without an id"), (None, "with and without an id")]
    rows += [(5, "first text under five"), (5, "second wholly other text below five"), (3, "first text under five"), (3, "a third one"), (4, "second wholly other text below five")]
    got = Counter((r.doc_id, r.text) for r in keep(frame(spark, rows)).collect())
    want = [rows[0], rows[1], rows[3], rows[7], rows[8], rows[9]]
    assert got == Counter(want)


def shingle_sets(rows, n=5):
    out = {}
    for d, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        out[d] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    return out


def kept_by_jaccard(sets):
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {top(d) for d in sets}


def test_near_duplicate_stage_by_brute_jaccard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = kept_by_jaccard(shingle_sets([(r.doc_id, r.text) for r in docs.collect()]))
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()} == want
    r = random.Random(8)
    names = [f"w{i}" for i in range(3_000)]
    common = [r.choice(names) for _ in range(40)]
    rows = [(0, None), (1, " "), (2, "one two"), (3, "ONE two"), (4, "one two three")]
    for _ in range(12):
        base = [r.choice(names) for _ in range(r.randint(20, 200))] + common
        for _ in range(12):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(names)
            rows.append((len(rows), " ".join(w)))
    want = kept_by_jaccard(shingle_sets(rows))
    assert {x.doc_id for x in corpus_pipeline.near_duplicates(spark, frame(spark, rows), sf_dir).collect()} == want
    assert corpus_pipeline.near_duplicates(spark, frame(spark, rows).limit(0), sf_dir).count() == 0


def most_joined(spark, run):
    """The largest number of rows that a join made in the queries of `run`."""
    store = spark._jsparkSession.sharedState().statusStore()
    each = lambda seq: (seq.apply(i) for i in range(seq.size()))
    before = {e.executionId() for e in each(store.executionsList())}
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    made = [0]
    for i in (e.executionId() for e in each(store.executionsList()) if e.executionId() not in before):
        values = store.executionMetrics(i)
        for node in each(store.planGraph(i).allNodes()):
            found = [m for m in each(node.metrics()) if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId())]
            made += [int(values.get(m.accumulatorId()).get().replace(",", "")) for m in found]
    return max(made)


def test_near_copies_that_are_hardly_alike_are_not_all_paired(spark):
    """Copies of one text that lack some of its words: one component, and others that are almost alike to many of its members."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(400):
        gone = set(r.sample(range(150), r.choice([0, 1, 2, 3, 3, 4, 5, 6, 7, 8])))
        rows.append((i, " ".join(w for j, w in enumerate(base) if j not in gone)))
    kept = []
    made = most_joined(spark, lambda: kept.extend(x.doc_id for x in near.representatives(frame(spark, rows)).collect()))
    want = kept_by_jaccard(shingle_sets(rows))
    assert set(kept) == want and 20 < len(want) < 300
    assert made <= 40 * len(rows)  # as many as the prefix shingles of all texts, about


def test_parity_signatures_never_drop_an_alike_pair():
    r = np.random.default_rng(3)
    for size in (1, 9, 150, 900, 3_000):
        a = r.integers(0, 1 << 63, size, dtype=np.uint64)
        for lost in (0, 1, size // 9, size // 2):
            b = np.concatenate([a[lost:], r.integers(0, 1 << 63, lost, dtype=np.uint64)])
            differ = int(np.bitwise_count((near.parities(a) ^ near.parities(b)).view(np.uint64)).sum())
            assert differ <= 2 * lost and (size > 1_000 or lost < 9 or differ > lost / 2)


def recall_of(found, ids, v, every=20, k=20):
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in np.flatnonzero(ids % every == 0):
        s = v @ v[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:k]
        mine = got[ids[q]]
        assert sorted(mine) == list(range(1, k + 1)) and all(abs(v[ids == i][0] @ v[q] - x) < 1e-9 for i, x in mine.values())
        hits += len({ids[i] for i in order} & {i for i, _ in mine.values()})
    return hits / (k * len(got))


def test_neighbours_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    assert recall_of(queries.QUERIES["op7_forest_nearest"](spark, sf_dir), ids, v) >= 0.9


def test_neighbours_over_shards_and_blocks(spark):
    """Several shards and blocks, a few thousand rows: recall stays, and fewer than half of the rows are scored."""
    sf = "/root/testdata/sf0.1"
    t = table(spark, sf, "embeddings")
    rows = t.collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    assert recall_of(forest.nearest(t, t.where("vec_id % 20 = 0"), 20, shard=64, block=30), ids, v) >= 0.9
    assert recall_of(forest.nearest(t, t.where("vec_id % 20 = 0"), 20, shard=700), ids, v) >= 0.9
    for n in (64, 700, 2_000):
        found = forest.Forest(v[:n]).candidates(v[::20], 160 * n // 2_000)
        assert np.mean([len(f) for f in found]) < 0.45 * n


@pytest.mark.parametrize("kind", ["offset", "positive", "clusters", "lengths", "wide"])
def test_neighbours_of_other_vectors(spark, kind):
    """Vectors far from uniform: about a far mean, of one sign, in clusters, of very different lengths, of many dimensions."""
    rng = np.random.default_rng(5)
    v = rng.standard_normal((1_600, 200 if kind == "wide" else 48))
    v = {"offset": v + 5, "positive": abs(v), "clusters": v[rng.integers(0, 20, len(v))] + 0.2 * v, "lengths": v * np.exp(v[:, :1]), "wide": v}[kind]
    t = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(3).persist()
    assert recall_of(forest.nearest(t, t.where("vec_id % 20 = 0"), 20, shard=300), np.arange(len(v)), v) >= 0.9


def test_neighbour_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 1.0, 1.0]), (20, [0.0, 3.0]), (None, [9.0, 9.0])]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in forest.nearest(t, t.where("vec_id % 20 = 0"), 2).collect()}
    assert got == {(0, 1): (1, 2.0), (0, 2): (2, 2.0), (20, 1): (0, 0.0), (20, 2): (1, 0.0)}
    assert forest.nearest(t.limit(0), t.limit(0), 2).count() == 0


class Reader(HTMLParser):
    """Text and links by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.hidden, self.text, self.links, self.title, self.lang, self.in_title = 0, [], [], None, None, False

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "noscript", "template", "head"):
            self.hidden += 1
        if tag in warc.BLOCKS:
            self.text.append("\n")
        if tag == "a" and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"].strip())
        if tag == "html":
            self.lang = dict(attrs).get("lang")
        if tag == "title":
            self.in_title, self.title = True, ""

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript", "template", "head"):
            self.hidden -= 1
        if tag in warc.BLOCKS:
            self.text.append("\n")
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if not self.hidden:
            self.text.append(data)


def test_warc_query_by_another_parser(spark, sf_dir):
    """Every record of the query's table, by the standard library's HTML parser and its hashes."""
    pages = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    made = warc.build(table(spark, sf_dir, "pages")).collect()
    got = {(r.page_id, r.record_type): r for r in queries.QUERIES["op9_warc_derivatives"](spark, sf_dir).collect()}
    assert len(made) == 2 * len(pages) == len(got)
    for r in made:
        p = pages[r.page_id]
        html = p.html or ""
        reader = Reader()
        reader.feed(html)
        reader.close()
        ((headers, block),) = warc.parse(bytes(r.record))
        source = "sha1:" + base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert headers["WARC-Source-Payload-Digest"] == source == r.source_digest and headers.get("WARC-Target-URI") == p.url
        assert headers["WARC-Refers-To"] == r.refers_to == got[r.page_id, "metadata"].refers_to == got[r.page_id, "conversion"].refers_to
        assert headers["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
        assert got[r.page_id, r.record_type].record_sha256 == hashlib.sha256(bytes(r.record)).hexdigest()
        if r.record_type == "conversion":
            assert headers["WARC-Concurrent-To"] == got[r.page_id, "metadata"].record_id
            lines = [" ".join(x.split()) for x in "".join(reader.text).split("\n")]
            assert block.decode().split() == " ".join(lines).split() and [" ".join(x.split()) for x in block.decode().split("\n")] == [x for x in lines if x]
        else:
            want = [f"title: {' '.join(reader.title.split())}"] if reader.title is not None else []
            want += [f"language: {reader.lang.lower()}"] if reader.lang else []
            assert block.decode().split("\r\n")[:-1] == want + [f"outlink: {' '.join(x.split())} L a/@href" for x in reader.links]


def test_warc_files(spark, tmp_path):
    """Files that others wrote: plain or in gzip members, with records of other types; source headers stay."""
    one = warc.response(7, "http://a/é", "<p>One\r\n\r\ntwo</p>", "2020-02-03T04:05:06Z")
    info = warc.serialise([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:x>")], b"software: x")
    (tmp_path / "part-1.warc").write_bytes(info + one)
    (tmp_path / "part-2.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(warc.response(None, None, None)))
    found = warc.read(spark, str(tmp_path))
    assert found.count() == 4
    rows = warc.derive(found).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in rows) == [(0, "conversion"), (0, "metadata"), (7, "conversion"), (7, "metadata")]
    for r in rows:
        ((h, block),) = warc.parse(bytes(r.record))
        if r.page_id == 7:
            ((source, _),) = warc.parse(one)
            assert (h["WARC-Date"], h["WARC-Refers-To-Date"], h["WARC-Target-URI"], h["WARC-Refers-To"]) == ("2020-02-03T04:05:06Z",) * 2 + ("http://a/é", source["WARC-Record-ID"])
            assert r.record_type == "metadata" or block == b"One\ntwo"
        else:
            assert r.target_uri is None and block == b""


def test_warc_text_and_edge_rows(spark):
    page = "<html lang=EN><head><title>T &amp; U</title></head><body><!-- no --><script>var a='<p>';</script><p>One&nbsp;two<br>three <b>four</b></p><a href='/x'>x</a></body>"
    assert warc.plain_text(page) == "One two\nthree four\nx"
    assert warc.metadata_fields(page) == "title: T & U\r\nlanguage: en\r\noutlink: /x L a/@href\r\n"
    assert warc.plain_text("a < b <c>d</c> <e") == "a < b d <e" and warc.plain_text("x<script>y") == "x" and warc.plain_text("&#" + "9" * 5_000 + ";") == "\ufffd"
    rows = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>a</p>"), (None, "u", "<p>a</p>"), (2, "u", "<script>" * 3)], "page_id long, url string, html string").withColumn("record", F.lit(1))
    assert warc.build(rows).count() == 10 and warc.build(rows.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<title>", "<p ", "<a", "<", "<a href=\"", "<!--", "<script>", "</script ", "&amp", "<a b='", "<b\n", "<html lang ", "=", "x=", "x ="])
def test_long_broken_pages_take_time_in_proportion(piece):
    def took(n):
        began = time.process_time()
        warc.derived(piece * n)
        warc.derived(piece * n + ">")
        return time.process_time() - began

    took(1_000)
    assert took(80_000) < 60 * max(took(4_000), 0.01)


def test_long_attribute_runs():
    began = time.time()
    for run in ("x" * 100_000, "x " * 50_000, "x= " * 30_000, "x='" * 30_001, "=" * 100_000):
        warc.derived(f"<a {run}>link</a><a href=end>")
        assert warc.attribute(f" {run} ", "href") is None
    assert warc.attribute(" a=1 Href = 'x y' href=z", "href") == "x y" and warc.attribute('a="b"href="c"', "href") == "c"
    assert time.time() - began < 5


def test_archives_of_other_writers(spark, tmp_path):
    """Any file name, folders, gzip by record, header names in any case, no blank, folded lines, foreign ids."""
    def record(page, name, own=""):
        http = f"HTTP/1.1 200 OK\r\n{own}\r\n".encode() + page
        return f"WARC/1.0\r\nwarc-type:response\r\nWARC-RECORD-ID: <{name}>\r\nWarc-Target-Uri:http://a/\r\n b\r\ncontent-length:{len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"

    (tmp_path / "deep").mkdir()
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "CC-MAIN-0001.warc").write_bytes(info + record(b"<p>one</p>", "r1", "X-Page-Id: abc\r\n"))
    (tmp_path / "deep" / "two.warc.gz").write_bytes(gzip.compress(record(b"<p>two</p>", "r2", "x-page-id:7\r\n")) + gzip.compress(record(b"three", "r3")))
    (tmp_path / "part-0001").write_bytes(record(b"", "r4", "X-Page-Id: " + "9" * 40 + "\r\n"))
    (tmp_path / "_SUCCESS").write_bytes(b"")
    assert warc.read(spark, str(tmp_path)).count() == 5
    got = {(r.refers_to, r.record_type): r for r in warc.derive(warc.read(spark, str(tmp_path))).collect()}
    assert len(got) == 8 and {k[0] for k in got} == {"<r1>", "<r2>", "<r3>", "<r4>"}
    assert {k[0]: r.page_id for k, r in got.items()} == {"<r1>": None, "<r2>": 7, "<r3>": None, "<r4>": None}
    assert got["<r2>", "conversion"].record.endswith(b"two\r\n\r\n") and got["<r1>", "conversion"].target_uri == "http://a/ b"
    for broken in (b"hello", b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc"):
        with pytest.raises(ValueError):
            list(warc.parse(broken))


def test_best_fit_rules(spark, sf_dir):
    r = random.Random(2)
    items = [(i, r.randint(0, 300), r.choice(["a", "a", "b", "c", None]), r.choice([None, *range(40)])) for i in range(300)]
    made = packing.best_fit(items, 100)
    info = {i: x for i, *x in items}
    bins = {}
    for doc, piece, n, b, place, start in made:
        bins.setdefault(b, []).append((place, start, n, doc, piece))
    assert Counter(m[0] for m in made) == Counter({i: max(1, -(-n // 100)) for i, n, *_ in items})
    for own in bins.values():
        own.sort()
        assert [p for p, *_ in own] == list(range(len(own))) and sum(n for _, _, n, *_ in own) <= 100
        docs = [d for *_, d, _ in own]
        for k in (1, 2):
            known = [info[d][k] for d in docs if info[d][k] is not None]
            assert len(known) == len(set(known))
    # tightest compatible bin, by brute force over all bins
    state, parts = {}, sorted([(n % 100, i, n // 100, s, c) for i, n, s, c in items if n % 100 or not n], key=lambda p: (-p[0], p[1], p[2]))
    for doc, piece, n, b, place, start in made:
        if n == 100 and piece < info[doc][0] // 100:
            state[b] = [0, {info[doc][1]}, {info[doc][2]}]
    where = {(m[0], m[1]): m[3] for m in made}
    for n, doc, piece, s, c in parts:
        fits = [(room, b) for b, (room, ss, cs) in state.items() if room >= n and room > 0 and (s is None or s not in ss) and (c is None or c not in cs)]
        b = where[doc, piece]
        assert b == min(fits)[1] if fits else b not in state
        old = state.setdefault(b, [100, set(), set()])
        old[0] -= n
        old[1].add(s)
        old[2].add(c)
    got = queries.QUERIES["op10_bestfit_packing"](spark, sf_dir)
    sizes = packing.sizes(table(spark, sf_dir, "documents"))
    assert got.agg(F.sum("n_tokens")).first()[0] == sizes.agg(F.sum("n_tokens")).first()[0]
    empty = spark.createDataFrame([], "doc_id long, n_tokens long, source string, cluster long")
    odd = spark.createDataFrame([(None, None, None, None), (1, 0, None, 5), (1, 0, None, 5), (2, 10**6, "s", 5)], empty.schema)
    assert packing.pack(empty).count() == 0 and packing.pack(odd).select("doc_id").distinct().count() == 3
    lost = spark.createDataFrame([(None, 5, "s", i) for i in range(90)] + [(-1, 5, "s", 91)], empty.schema)
    got = packing.pack(lost, shard=10)
    assert got.where("doc_id IS NULL").count() == 90 and got.where("doc_id = -1").count() == 1 and got.select((F.col("bin") / (1 << 32)).cast("long")).distinct().count() > 1


def test_packing_query_rules(spark, sf_dir):
    """The query's bins, by the documents themselves: whole texts, room, no source or text twice, order within a bin."""
    docs = {r.doc_id: ([x.lower() for x in r.text.encode().split()], r.source) for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.QUERIES["op10_bestfit_packing"](spark, sf_dir).collect()
    sizes, bins = Counter(), {}
    for x in rows:
        sizes[x.doc_id] += x.n_tokens
        bins.setdefault(x.bin, []).append(x)
    assert {d: sizes[d] for d in docs} == {d: len(w) for d, (w, _) in docs.items()}
    for own in bins.values():
        own.sort(key=lambda x: x.place)
        assert [x.start for x in own] == [sum(y.n_tokens for y in own[:i]) for i in range(len(own))] and sum(x.n_tokens for x in own) <= 2_048
        assert len({docs[x.doc_id][1] for x in own}) == len(own) == len({tuple(docs[x.doc_id][0]) for x in own})
    # one shard at this size: no bin takes what a fuller compatible one had room for
    at = {(x.doc_id, x.piece): x for x in rows}
    state = {}
    for x in sorted(rows, key=lambda x: (-x.n_tokens, x.doc_id, x.piece)):
        if x.n_tokens == 2_048:
            state[x.bin] = [0, set(), set()]
            continue
        words, source = docs[x.doc_id]
        fits = [(room, b) for b, (room, s, c) in state.items() if room >= x.n_tokens and source not in s and tuple(words) not in c]
        assert (x.bin == min(fits)[1]) if fits else x.bin not in state
        own = state.setdefault(x.bin, [2_048, set(), set()])
        own[0] -= x.n_tokens
        own[1].add(source)
        own[2].add(tuple(words))
    assert len(at) == len(rows)


def test_pipeline_by_brute_force(spark, sf_dir):
    """Every stage on its own input: language by label, one document a component, repeats, no token lost."""
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "repeats", "pack"]
    one = corpus_pipeline.language(spark, docs, sf_dir)
    assert one.columns == docs.columns and one.count() >= 0.97 * docs.count()
    two = corpus_pipeline.near_duplicates(spark, one, sf_dir).cache()
    assert {r.doc_id for r in two.collect()} == kept_by_jaccard(shingle_sets([(r.doc_id, r.text) for r in one.collect()]))
    three = {r.doc_id: r.text for r in corpus_pipeline.repeats(spark, two, sf_dir).collect()}
    rows = two.collect()
    want = without_passages([r.text.encode() for r in rows])
    assert three == {r.doc_id: w.decode("utf-8", "ignore") for r, w in zip(rows, want, strict=True)}
    packed = corpus_pipeline.run(spark, sf_dir)
    total = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert total == {d: len(t.encode().split()) for d, t in three.items()}


def test_pipeline_keeps_own_columns_and_rows_without_an_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.when(F.col("doc_id") % 10 != 3, F.col("doc_id")))
    own = {c: F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for c in ("score", "lang_pred", "kept", "n_removed", "n_bytes", "th", "row", "d", "runs", "key")}
    docs = docs.withColumns(own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = out.collect()
        assert all(r[c] == c + ("-" if r.doc_id is None else str(r.doc_id)) for r in rows for c in own)
        assert sum(r.doc_id is None for r in rows) > 5, name
    assert corpus_pipeline.pack(spark, docs, sf_dir).where("doc_id IS NULL").count() >= 20


def test_nothing_dead_stays_on_disk(spark):
    """What only a step of the search reads goes with the step, and a stored table's shuffle files go with its write."""
    folder = Path(common.shared_folder(spark).removeprefix("file://"))
    texts = [" ".join(f"w{i % 7}-{j}" for j in range(40)) + f" end{i % 3}" for i in range(42)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    held = set(folder.iterdir())
    named, edges = near.links(docs.select(near.text_hash("text").alias("th"), "text"))
    assert {p.name.split("-", 2)[1] for p in set(folder.iterdir()) - held if p.name.startswith("near-")} == {"links", "nodes"}
    assert named.count() == 42 and edges.count() > 0
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    spark._jvm.System.gc()
    time.sleep(1)
    before = files()
    kept = common.stored(docs.groupBy("text").agg(F.count("*").alias("n")), "counts")
    for _ in range(20):
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and kept.count() == 21 and spark.conf.get(common._CLEANUP, None) is None
