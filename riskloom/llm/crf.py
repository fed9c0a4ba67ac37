"""Linear-chain conditional random field for the language of every word.

A word's features are its affixes, its character n-grams (both hashed into one weight table) and
its entry in a lexicon of the commonest labelled words; learned transitions tie neighbours, and
forward-backward gives each word's language probabilities, so code-switched texts are labelled
word by word. A text's language is the one with the largest mean probability over its words that
have a letter; the score is that mean.

The classifier is fitted on a bounded sample of labelled rows (`fit_texts` for each language, in
hash order, whole texts), and on code-switched texts made of runs of two of those in turn, so that
changes of language are seen and learned; prediction covers every row and every word.

Defined results: null text or no letter: `und`, score 0. No labelled row: `und`, score 0.
One label: that label. Repeated rows are predicted one by one. Null labels never train.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import chain
from riskloom.llm.common import mapped

UNDEFINED = "und"


@dataclass
class Settings:
    fit_texts: int = 300  # labelled rows for each language
    buckets: int = 1 << 18
    lexicon: int = 20_000
    switch: int = 4  # one code-switched text is made for so many labelled ones
    epochs: int = 6
    batch_tokens: int = 20_000
    rate: float = 0.2
    chunk_tokens: int = 500_000


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    lexicon: dict[str, int]
    lexicon_weights: np.ndarray  # words x labels; the last row, of words outside, is 0
    start: np.ndarray  # logs
    move: np.ndarray


def features(distinct: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words, end to end, and where each word's begin.

    Of the bytes ^word$: all 2-, 3- and 4-grams, and affixes (the grams at either end, marked).
    """
    joined = "".join(f"^{w}$" for w in distinct).encode("utf-8", "surrogatepass")
    b = np.frombuffer(joined, np.uint8).astype(np.uint64)
    sizes = np.array([len(w.encode("utf-8", "surrogatepass")) + 2 for w in distinct], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(distinct)), sizes)
    ahead = np.repeat(begin[1:], sizes) - np.arange(len(b))  # bytes left in the word
    behind = np.arange(len(b)) - np.repeat(begin[:-1], sizes)
    owners, hashes = [], []
    h = b.copy()
    for n in range(2, 5):
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + b[n - 1 :] if len(h) > 1 else h[:0]
        full = np.flatnonzero(ahead[: len(h)] >= n)
        g = h[full] ^ np.uint64(n << 56)
        g = g ^ (g >> np.uint64(29))
        owners.append(word[full])
        hashes.append(g * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40))
        edge = full[(behind[full] == 0) | (ahead[full] == n)]
        owners.append(word[edge])
        e = h[edge] + np.where(behind[edge] == 0, np.uint64(77), np.uint64(1077))
        hashes.append((e ^ (e >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40))
    owner, hashed = np.concatenate(owners), np.concatenate(hashes)
    by = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[by], np.arange(len(distinct) + 1))
    return (hashed[by] % np.uint64(buckets)).astype(np.int64), starts


def word_scores(model: Model, distinct: list[str]) -> np.ndarray:
    """Summed weights of each word's features: words x labels, some thousand words at a time."""
    out = np.empty((len(distinct), len(model.labels)))
    get, outside = model.lexicon.get, len(model.lexicon)
    for at in range(0, len(distinct), 10_000):
        part = distinct[at : at + 10_000]
        ids, starts = features(part, len(model.weights))
        sums = np.add.reduceat(model.weights[ids], starts[:-1], axis=0)  # every word has a feature: "^" and the next byte
        out[at : at + len(part)] = sums + model.lexicon_weights[[get(w, outside) for w in part]]
    return out


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def _index(texts: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the words of all texts as indexes of those, lengths."""
    seen: dict[str, int] = {}
    at = [seen.setdefault(w, len(seen)) for t in texts for w in t]
    return list(seen), np.array(at, np.int64), np.array([len(t) for t in texts], np.int64)


def _exp(scores: np.ndarray) -> np.ndarray:
    return np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores


def fit(rows: list[tuple[str, str]], settings: Settings) -> Model:
    """Adaptive gradient ascent on the conditional likelihood of whole labelled texts."""
    labels = sorted({lang for _, lang in rows})
    at_label = {x: i for i, x in enumerate(labels)}
    texts = [(tokens(t), at_label[lang]) for t, lang in rows]
    texts = [(w, np.full(len(w), y)) for w, y in texts if w]
    texts += switched(texts, settings)
    k = len(labels)
    counts: dict[str, int] = {}
    for w, _ in texts:  # switched texts count as well
        for x in set(w):
            counts[x] = counts.get(x, 0) + 1
    listed = sorted(counts, key=lambda x: (-counts[x], x))[: settings.lexicon]
    model = Model(labels, np.zeros((settings.buckets, k)), {w: i for i, w in enumerate(listed)}, np.zeros((len(listed) + 1, k)), np.zeros(k), np.zeros((k, k)))
    sums = [np.full(x.shape, 1e-6) for x in (model.weights, model.lexicon_weights, model.start, model.move)]
    order = np.random.default_rng(7)
    for _ in range(settings.epochs):
        batch, size = [], 0
        for i in [*order.permutation(len(texts)), -1]:
            if i >= 0:
                batch.append(texts[i])
                size += len(texts[i][0])
            if batch and (i < 0 or size >= settings.batch_tokens):
                _step(model, batch, sums, settings.rate)
                batch, size = [], 0
    return model


def switched(texts: list, settings: Settings) -> list:
    """Texts of runs of 3 to 40 words from two texts of different labels in turn, one for every `switch` texts."""
    rng = np.random.default_rng(23)
    out = []
    for i in rng.permutation(len(texts))[: len(texts) // settings.switch].tolist():
        j = int(rng.integers(len(texts)))
        (a, y), (b, z) = texts[i], texts[j]
        if y[0] == z[0]:
            continue
        words, gold, at = [], [], [0, 0]
        for turn in range(12):
            own, label = ((a, y), (b, z))[turn % 2]
            run = own[at[turn % 2] : at[turn % 2] + int(rng.integers(3, 41))]
            at[turn % 2] += len(run)
            words += run
            gold.append(label[: len(run)])
        out.append((words, np.concatenate(gold)))
    return out


def _step(model: Model, batch: list, sums: list[np.ndarray], rate: float) -> None:
    distinct, at, lengths = _index([w for w, _ in batch])
    k = len(model.labels)
    scores = word_scores(model, distinct)
    layout = chain.Layout(lengths)
    seen = at[layout.order]
    named = np.concatenate([y for _, y in batch])
    gold = named[layout.order]
    gamma, moves = chain.posteriors(layout, _exp(scores)[seen], np.exp(model.start), np.exp(model.move))
    wrong = np.eye(k)[gold] - gamma
    n = len(seen)
    by_word = np.stack([np.bincount(seen, weights=wrong[:, j], minlength=len(distinct)) for j in range(k)], axis=1)
    ids, starts = features(distinct, len(model.weights))
    spread = np.repeat(by_word, np.diff(starts), axis=0)
    touched, back = np.unique(ids, return_inverse=True)
    g_weights = np.stack([np.bincount(back, weights=spread[:, j], minlength=len(touched)) for j in range(k)], axis=1)
    outside = len(model.lexicon)
    entry = np.array([model.lexicon.get(w, outside) for w in distinct])
    inside = entry < outside
    first = layout.active[0]
    g_start = wrong[:first].sum(axis=0)
    inner = np.ones(len(named) - 1, bool)
    inner[np.cumsum(lengths)[:-1] - 1] = False  # not from one text to the next
    g_move = np.bincount(named[:-1][inner] * k + named[1:][inner], minlength=k * k).reshape(k, k).astype(float) - moves
    for x, s, rows, g in (
        (model.weights, sums[0], touched, g_weights / n), (model.lexicon_weights, sums[1], entry[inside], by_word[inside] / n),
        (model.start, sums[2], slice(None), g_start / n), (model.move, sums[3], slice(None), g_move / n),
    ):
        s[rows] += g * g
        x[rows] += rate * g / np.sqrt(s[rows])


def _predict(shared, limit: int, keep_text: bool):
    def work(held: list):
        model: Model = shared.value
        k = len(model.labels)
        texts = [tokens(t) for *_, t in held]
        distinct, at, lengths = _index(texts)
        lettered = np.array([any(c.isalpha() for c in w) for w in distinct], bool)
        full = np.flatnonzero(lengths > 0)
        sums, n = np.zeros((len(held), k)), np.zeros(len(held))
        if len(full):
            layout = chain.Layout(lengths[full])
            seen = at[layout.order]
            gamma, _ = chain.posteriors(layout, _exp(word_scores(model, distinct)).astype(np.float32)[seen], np.exp(model.start).astype(np.float32), np.exp(model.move).astype(np.float32))
            owner = np.repeat(full, lengths[full])[layout.order]
            use = lettered[seen]
            n = np.bincount(owner[use], minlength=len(held))
            sums = np.stack([np.bincount(owner[use], weights=gamma[use, j], minlength=len(held)) for j in range(k)], axis=1)
        mean = sums / np.maximum(n, 1)[:, None]
        best = mean.argmax(axis=1)
        lang = [model.labels[b] if m else UNDEFINED for b, m in zip(best, n, strict=True)]
        score = np.where(n > 0, np.clip(mean[np.arange(len(held)), best], 0, 1), 0.0)
        return lang, score

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            held, size, lang, scores = [], 0, [], []
            for i in range(batch.num_rows):
                t = texts[i].as_py()
                held.append((t,))
                size += len(t or "") // 6
                if size >= limit or i + 1 == batch.num_rows:
                    got = work(held)
                    lang += got[0]
                    scores.append(got[1])
                    held, size = [], 0
            kept = batch.num_columns - (not keep_text)
            rest = [batch.column(i) for i in range(kept)]
            names = batch.schema.names[:kept]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], [*names, "lang_pred", "score"])

    return run


def fit_on(docs: DataFrame, text: str, lang: str, settings: Settings | None = None) -> Model:
    """Fits on at most `fit_texts` distinct texts of each label, the first in the order of a hash."""
    settings = settings or Settings()
    by = F.xxhash64(text)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"), by.alias("h"))
    # a hash threshold first, from counts, so that no label's rows are ever sorted as a whole
    # counts of distinct texts, as copies share a hash and are dropped: about 4 * fit_texts texts of a label pass, all of them if it has no more
    texts = labelled.groupBy("l", "h").agg(F.lit(1).alias("one")).groupBy("l").agg(F.count("*").alias("n"))
    share = {r.l: min(1.0, 4.0 * settings.fit_texts / r.n) for r in texts.collect()}
    if not share:
        return fit([], settings)
    below = F.lit(False)
    for name, s in share.items():
        below = below | ((F.col("l") == F.lit(name)) & (F.abs(F.col("h") % 1_000_003) < F.lit(int(s * 1_000_003) + 1)))
    first = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))
    rows = labelled.where(below).dropDuplicates(["l", "h"]).withColumn("i", first).where(F.col("i") <= settings.fit_texts).select("t", "l").collect()
    return fit(sorted((r.t, r.l) for r in rows), settings)


def predict(docs: DataFrame, model: Model, text: str = "text", settings: Settings | None = None, keep_text: bool = False) -> DataFrame:
    """All columns of `docs`, the text only if asked for, then lang_pred and score."""
    settings = settings or Settings()
    keep = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    if not model.labels:
        return docs.select(*keep, *([text] if keep_text else []), F.lit(UNDEFINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = docs.select(*keep, text)
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    schema = StructType([*(f for f in rows.schema if keep_text or f.name in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return mapped(rows, _predict(docs.sparkSession.sparkContext.broadcast(model), settings.chunk_tokens, keep_text), schema)
