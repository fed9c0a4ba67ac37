"""Importance resampling, collocations and license scans against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import collocations, licenses, queries, resample
from riskloom.session import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "a b\tC", "en", "s", 5), (1, "a b\tC", "en", "s", 5), (2, None, None, None, None), (3, "", "en", None, 0), (4, "12 | 34", "de", "s", 7), (5, "word " * 60_000, "fr", "s", 300_000), (None, "é ß ç", "fr", "t", 5), (6, "MIT License. mit-license", "en", "s", 9)]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).withColumn("score", F.lit(1)).withColumn("words", F.lit("x")).withColumn("rank", F.lit(2)).withColumn("key", F.lit("k"))


def words(text):
    return re.findall(WORD, (text or "").translate(LOW))


def brute_resample(docs, target, most=1, buckets=10_000, percent=10, least=20, seed=2024):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, most + 1) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text))
    for text in target:
        t.update(features(text))
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        f = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least))
    drawn = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = drawn[: len(drawn) * percent // 100]
    return Counter((*r[:4], drawn.index(r) + 1 if r in drawn else None) for r in rows)


def same(got, want):
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("name", ["op11_importance_resample", "op12_phrase_collocations"])
def test_queries_match_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    r = con.execute(queries.ORACLE_SQL[name])
    assert Counter(map(tuple, df.select([d[0] for d in r.description]).collect())) == Counter(r.fetchall())


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_by_brute_force(spark, sf_dir, most):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    rows, texts = [(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()]
    same(resample.resample(docs, target, most=most).collect(), brute_resample(rows, texts, most))


def test_resampling_edge_rows(spark, odd):
    """Nulls, copies, a long text in pieces, clashing columns, empty tables, everything drawn."""
    rows = [(r[0], r[1]) for r in ODD]
    target = spark.createDataFrame([("word a",), (None,)], "text string")
    got = resample.resample(odd, target, percent=100, least_words=1).collect()
    want = brute_resample(rows, ["word a", None], percent=100, least=1)
    assert Counter(tuple(r)[:4] for r in got) == Counter(k[:4] for k in want.elements())
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 7)) and [r.rank for r in sorted(got, key=lambda r: -r.score) if r.n_features] == sorted(r.rank for r in got if r.rank)
    none = odd.where("false")
    assert resample.resample(none, target).collect() == []
    assert all(r.weight <= 0 or r.n_features for r in resample.resample(odd, target.where("false")).collect())


def test_pieces_of_a_text(monkeypatch):
    """Windows over the ends of pieces are those of the whole text."""
    monkeypatch.setattr(resample, "PIECE", 7)
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice("abÉ.9 ") for _ in range(rng.randrange(80)))
        n, got = resample.Bucketer(3, 1000)(text)
        w = words(text)
        want = [zlib.crc32(" ".join(w[i : i + k]).encode()) % 1000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]
        assert n == len(w) and Counter(got) == Counter(want)
        assert Counter(resample.Bucketer(1, 1000)(text)[1]) == Counter(zlib.crc32(x.encode()) % 1000 for x in w)


def brute_collocations(rows, least, most=5, percent=100, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, most + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cands.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cands.items()):
                continue
            cuts = [(1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, _, left, right = min(cuts)
            found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return Counter(out)


ROWS = [("the cat sat. the cat sat, the\tcat  ran", "en"), ("The Cat Sat\x0bthe cat", "en"), ("a a a a a a a", None), ("a a a", "und"), ("x\x01 y x\x01 y x y x", "en"), (None, "en"), ("", "de"), ("ä ö ä ö Ä ö", "t\tx%09"), ("the cat sat", "en")]


@pytest.mark.parametrize("least,most,percent,top", [(2, 5, 100, 2000), (2, 3, 60, 3), (1, 4, 100, 2000)])
def test_collocations_by_brute_force(spark, monkeypatch, least, most, percent, top):
    monkeypatch.setattr(collocations, "IN_RANGE", 4)  # many ranges
    docs = spark.createDataFrame(ROWS, "text string, lang string").withColumn("words", F.lit("w")).withColumn("key", F.lit(1)).repartition(3)
    same(collocations.collocations(docs, least=least, most=most, percent=percent, top=top).collect(), brute_collocations(ROWS, least, most, percent, top))


def test_collocations_of_tables(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    monkeypatch.setattr(collocations, "IN_RANGE", 300)
    rows = [(r.text, r.lang) for r in docs.collect()]
    same(collocations.collocations(docs, least=20).collect(), brute_collocations(rows, 20))
    assert collocations.collocations(docs.where("false")).collect() == []


def test_bit_map_errors_cost_nothing(spark, monkeypatch):
    """A full bit map cuts no suffix; the counts are the same."""
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    docs = spark.createDataFrame(ROWS, "text string, lang string")
    same(collocations.collocations(docs, least=2).collect(), brute_collocations(ROWS, 2))


def test_quicksort_counts():
    rng = np.random.default_rng(4)
    rows = np.zeros((400, 6), np.int32)
    for r in rows:
        n = rng.integers(3, 7)
        r[:n] = rng.integers(1, 4, n)
    weight = rng.integers(1, 5, 400)
    got = {tuple(rows[i, : d + 1]): n for i, d, n in collocations.quicksort(rows, weight, 30)}
    want = Counter()
    for r, w in zip(rows, weight, strict=True):
        for d in range(2, 6):
            if r[d]:
                want[tuple(r[: d + 1])] += int(w)
    assert got == {k: n for k, n in want.items() if n >= 30}
    keys = pa.array(["en\ta\tb\t", "en\ta\t"])
    codes, names = collocations.matrix(keys, 5)
    assert codes[1, 2] == 0 and codes[0, 1] == codes[1, 1] and names[int(codes[0, 2]) - 1].as_py() == "b"


def brute_scan(text, k=3, drift=3, least=0.6):
    w = words(text)
    places = [(i, label) for i in range(len(w)) for p, label in licenses.BASE.items() if w[i : i + len(p.split())] == p.split()]
    spans = []
    for label, notices in licenses.NOTICES.items():
        for notice in notices:
            t = words(notice)
            runs = defaultdict(list)
            for j in range(len(t) - k + 1):
                runs[tuple(t[j : j + k])].append(j)
            lines = defaultdict(list)
            for i in range(len(w) - k + 1):
                for j in runs.get(tuple(w[i : i + k]), ()):
                    lines[i - j].append((i, j))
            groups, before = [], None
            for d in sorted(lines):
                if before is None or d - before > drift:
                    groups.append([])
                groups[-1] += lines[d]
                before = d
            for g in groups:
                lo, hi = min(i for i, _ in g), max(i for i, _ in g)
                score = round(len({j for _, j in g}) / max(len(t) - k + 1, hi - lo + 1), 6)
                if score >= least:
                    spans.append((lo, hi + k - 1, label, score))
    at, base = [i for i, _ in places], {x for _, x in places}
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[2] for s in spans})), max([s[3] for s in spans] + [0.5 if at else 0.0]), sorted(spans)


def check_scan(docs):
    rows = docs.select("doc_id", "text").collect()
    got = licenses.scan(docs).collect()
    assert got and Counter(repr((r[0], *r[1:8], [tuple(s) for s in r.spans])) for r in got) == Counter(repr((i, *brute_scan(t))) for i, t in rows)
    return got


def test_license_scan_by_brute_force(spark, sf_dir):
    check_scan(table(spark, sf_dir, "documents"))


def test_license_notices(spark, odd):
    """Whole, changed and repeated notices; base phrases at the ends; long texts, nulls, copies."""
    notices = [t for ts in licenses.NOTICES.values() for t in ts]
    rng = random.Random(5)
    rows = [(100 + i, f"intro words {t} and more") for i, t in enumerate(notices)]
    for i, t in enumerate(notices):
        w = t.split()
        for _ in range(max(1, len(w) // 15)):
            w.insert(rng.randrange(len(w)), "extra") if rng.random() < 0.5 else w.pop(rng.randrange(len(w)))
        rows.append((200 + i, " ".join(w)))
    rows += [(300, "x " * 50_000 + notices[0] + " y" * 50_000 + " " + notices[0]), (301, "GNU General Public License"), (302, "cc by cc cc-by CC\nBY"), (303, "licensed under " * 200), (304, "mit İ license mit\x00license K")]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("spans", F.lit(1)).withColumn("hash", F.lit(2))
    got = {r.doc_id: r for r in check_scan(docs)}
    for i, (label, _) in enumerate((label, t) for label, ts in licenses.NOTICES.items() for t in ts):
        assert label in got[100 + i].labels.split(",")
    assert got[302].n_base == 3 and got[303].labels == "" and len(got[300].spans) >= 2
    assert licenses.scan(docs.where("false")).collect() == []
