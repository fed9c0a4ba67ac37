"""Hidden Markov language model.

Tokens are words plus one end token for each text. The model's alphabet is bounded: the commonest
training words are symbols of their own, every other word belongs to one of a fixed number of
suffix classes. A class word's probability given its class is (c + 1) / (C + V + 1) over the
class's training tokens C and distinct words V, one of the slots standing for all unseen words,
so every word has a probability and they sum to one. That factor doesn't depend on the state:
a text's exact log likelihood is the scaled forward recursion over its symbols plus a plain sum
over its class words, and the unbounded vocabulary is only ever joined, never broadcast.

Baum-Welch: each partition adds up expected emissions, moves and starts over its whole texts;
Spark sums them by symbol; the next model goes out as a broadcast of (symbols x states) numbers.
The start is a pass of the same kind, with one state for each text. The rounds that part the states
(`init_rounds`) work on the counts of neighbouring symbols: all training texts are read once for
them, then a round costs what there are distinct pairs, which the alphabet bounds however long the
texts are. Baum-Welch over the whole texts follows (`rounds`), so every count covers all training texts.

Nulls count as empty texts (one end token). Repeated rows are scored and counted one by one.
A text of any length is one chain, never cut; its symbols are held by one task. Words with equal
counts are own words or class words together; only the named columns are read.
An empty training set gives every text score and base score 0.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm import chain
from riskloom.llm.common import discard, stored, words

END = b"\n"  # no word holds white space
PAIRS = 1 << 16  # pairs that are worked out together


@dataclass
class Settings:
    states: int = 8
    own_words: int = 16_384  # words with an emission of their own, at most
    looked_up: int = 262_144  # words whose counts are broadcast, at most; the rest is joined
    classes: int = 2_048
    rounds: int = 3  # Baum-Welch rounds over all training texts
    init_texts: int = 1_500  # without effect, for callers that still set it: the start reads all training texts
    init_rounds: int = 12  # rounds before those, which part the states, over the pair counts of all training texts
    smoothing: float = 200.0  # tokens of the shared distribution mixed into each state
    chunk_tokens: int = 1_500_000  # tokens of whole texts that are stepped together


@dataclass
class Vocabulary:
    """Bounded part of the training counts."""

    index: dict[bytes, int]
    counts: np.ndarray  # of the looked-up words
    symbol: np.ndarray  # their symbols
    own: int
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int  # N
    distinct: int  # V


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states
    history: list[float] = field(default_factory=list)


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-3:]) % classes


def _count(classes: int, flush: int = 300_000):
    def run(batches):
        seen: Counter = Counter()

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array([word_class(w, classes) for w in keys], pa.int32()), pa.array(list(seen.values()), pa.int64())],
                ["word", "class", "c"],
            )

        for batch in batches:
            for text in batch.column(0):
                seen.update(words(text.as_py()))
                seen[END] += 1
                if len(seen) > flush:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return run


def word_counts(texts: DataFrame, settings: Settings) -> DataFrame:
    """word, class, c over all rows of the one-column frame `texts`."""
    parts = texts.mapInArrow(_count(settings.classes), "word binary, class int, c long")
    return parts.groupBy("word", "class").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame, settings: Settings) -> Vocabulary:
    """Thresholds on the count bound what is collected; no sort of the vocabulary is needed."""
    levels = sorted(((r.c, r.n) for r in counts.groupBy("c").agg(F.count("*").alias("n")).collect()), reverse=True)
    own_from = all_from = (levels[0][0] + 1) if levels else 1
    running = 0
    for c, n in levels:
        running += n
        if running <= settings.own_words:
            own_from = c
        if running <= settings.looked_up:
            all_from = c
    top = counts.where(F.col("c") >= all_from).select("word", "class", "c").toArrow()
    top = top.take(pa.compute.sort_indices(top, [("c", "descending"), ("word", "ascending")]))
    c = top.column("c").to_numpy().astype(np.int64)
    own = int((c >= own_from).sum())
    symbol = np.where(np.arange(len(c)) < own, np.arange(len(c)), own + top.column("class").to_numpy())
    class_tokens, class_words = np.zeros(settings.classes, np.int64), np.zeros(settings.classes, np.int64)
    for r in counts.where(F.col("c") < own_from).groupBy("class").agg(F.sum("c").alias("t"), F.count("*").alias("n")).collect():
        class_tokens[r["class"]], class_words[r["class"]] = r.t, r.n
    return Vocabulary(
        {w: i for i, w in enumerate(top.column("word").to_pylist())},
        c, symbol.astype(np.int64), own, class_tokens, class_words,
        sum(c * n for c, n in levels), sum(n for _, n in levels),
    )


ENCODED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, class_log double, symbols binary, rare array<binary>"


def _encode(shared, classes: int):
    def run(batches):
        v: Vocabulary = shared.value
        get = v.index.get
        log_c = np.log10(v.counts + 1.0)
        log_class = np.log10(v.class_tokens + v.class_words + 1.0)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(3):
                w = words(text.as_py())
                w.append(END)
                at = np.fromiter(map(get, w, repeat(-1)), np.int64, len(w))
                rare = np.flatnonzero(at < 0)
                known = at[at >= 0]
                symbols = np.empty(len(w), np.int64)
                symbols[at >= 0] = v.symbol[known]
                rare_words = [w[i] for i in rare.tolist()]
                symbols[rare] = [v.own + word_class(x, classes) for x in rare_words]
                in_class = symbols >= v.own
                shares = log_c[known]
                row = (len(w), len(known), shares.sum(), shares[known >= v.own].sum() - log_class[symbols[in_class] - v.own].sum(), symbols.astype(np.uint16).tobytes(), rare_words)
                for x, values in zip(row, out, strict=True):
                    values.append(x)
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            arrays = [pa.array(x, k) for x, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *arrays], [f.split()[0] for f in ENCODED.split(", ")])

    return run


def _chunks(batches, at: int, limit: int):
    """(batch pieces, symbols, lengths) of about `limit` tokens of whole texts."""
    rows, held, size = [], [], 0
    for batch in batches:
        values = batch.column(at)
        for i, x in enumerate(values):
            s = np.frombuffer(x.as_py(), np.uint16)
            held.append(s)
            rows.append((batch, i))
            size += len(s)
            if size >= limit:
                yield rows, np.concatenate(held).astype(np.int64), np.array([len(s) for s in held])
                rows, held, size = [], [], 0
    if rows:
        yield rows, np.concatenate(held).astype(np.int64), np.array([len(s) for s in held])


def expected_counts(model: Model, symbols: np.ndarray, lengths: np.ndarray, into: np.ndarray) -> None:
    """Adds expected emissions, then moves, then starts of whole chains to `into` ((S + K + 1) x K)."""
    k = len(model.start)
    s = len(into) - k - 1
    layout = chain.Layout(lengths)
    seen = symbols[layout.order]
    gamma, moves = chain.posteriors(layout, model.emit.astype(np.float32)[seen], model.start.astype(np.float32), model.move.astype(np.float32))
    for j in range(k):
        into[:s, j] += np.bincount(seen, weights=gamma[:, j], minlength=s)
    into[s : s + k] += moves
    into[s + k] += gamma[: layout.active[0]].sum(axis=0)


def maximise(counts: np.ndarray, shared: np.ndarray, settings: Settings) -> Model:
    k = settings.states
    s = len(shared)
    emit = counts[:s] + settings.smoothing * shared[:, None]
    move, start = counts[s : s + k] + 0.1, counts[s + k] + 0.1
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def started(symbols: np.ndarray, lengths: np.ndarray, into: np.ndarray) -> None:
    """Adds the counts of whole texts to `into`, each in the one state that its hash names."""
    k = into.shape[1]
    s = len(into) - k - 1
    ends = np.cumsum(lengths)
    state = [zlib.crc32(symbols[e - n : e].tobytes()) % k for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
    into[:s] += np.bincount(symbols * k + np.repeat(state, lengths), minlength=s * k).reshape(s, k)


def initial(counts: np.ndarray, shared: np.ndarray, settings: Settings) -> Model:
    """The first model, from `started` counts of all texts.

    Every (symbol, state) is perturbed by a fixed share, so that no two states are equal even if
    copies put all texts into one of them; equal states would never part.
    """
    k, s = settings.states, len(shared)
    counts = counts.copy()
    spread = np.random.default_rng(13).uniform(0.8, 1.25, (s, k))
    counts[:s] = (counts[:s] + settings.smoothing * shared[:, None]) * spread
    counts[s : s + k] = (0.02 + 0.9 * np.eye(k)) * 1e4
    return maximise(counts, shared, settings)


def _pairs(size: int, limit: int):
    """pair, c: neighbouring symbols as left * size + right; `size` stands left of a text's first symbol."""

    def run(batches):
        for _, symbols, lengths in _chunks(batches, 0, limit):
            left = np.concatenate([[size], symbols[:-1]])
            left[np.cumsum(lengths)[:-1]] = size
            pair, c = np.unique(left * size + symbols, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair, pa.int64()), pa.array(c, pa.int64())], ["pair", "c"])

    return run


def expected_pair_counts(model: Model, occupied: np.ndarray, pair: np.ndarray, c: np.ndarray, into: np.ndarray) -> None:
    """Adds expected emissions, moves and starts of pairs that occur `c` times to `into`.

    A pair is a chain of two symbols whose first state has the shares `occupied`; a text's first symbol is one alone.
    """
    k = len(model.start)
    s = len(into) - k - 1
    emit = np.ascontiguousarray(model.emit.T, np.float32)  # state by state, so that each row is contiguous
    joint = (occupied[:, None] * model.move).astype(np.float32)
    for i in range(0, len(pair), PAIRS):
        left, right = pair[i : i + PAIRS] // s, pair[i : i + PAIRS] % s
        times = c[i : i + PAIRS].astype(np.float32)
        first = left == s
        if first.any():
            at = right[first]
            alone = emit[:, at] * model.start[:, None]
            alone *= times[first] / alone.sum(axis=0)
            into[s + k] += alone.sum(axis=1)
            for j in range(k):
                into[:s, j] += np.bincount(at, weights=alone[j], minlength=s)
            left, right, times = left[~first], right[~first], times[~first]
        x, y = emit[:, left], emit[:, right]
        ahead = joint.T @ x
        y *= times / np.einsum("ji,ji->i", ahead, y)
        into[s : s + k] += joint * (x @ y.T)
        ahead *= y
        x *= joint @ y
        for j in range(k):
            into[:s, j] += np.bincount(right, weights=ahead[j], minlength=s) + np.bincount(left, weights=x[j], minlength=s)


def _expect_pairs(shared, size: int, k: int):
    def run(batches):
        model, occupied = shared.value
        total = np.zeros((size + k + 1, k))

        def add(held):
            t = pa.Table.from_batches(held)
            expected_pair_counts(model, occupied, t.column(0).to_numpy(), t.column(1).to_numpy(), total)

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= PAIRS:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        yield from _summed(total)

    return run


def _summed(total: np.ndarray):
    some = np.flatnonzero(total.any(axis=1))
    columns = {"symbol": pa.array(some, pa.int64())} | {f"g{j}": pa.array(total[some, j]) for j in range(total.shape[1])}
    yield pa.RecordBatch.from_pydict(columns)


def _expect(shared, size: int, k: int, limit: int):
    def run(batches):
        model: Model | None = shared.value
        total = np.zeros((size + k + 1, k))
        for _, symbols, lengths in _chunks(batches, 0, limit):
            if model is None:
                started(symbols, lengths, total)
            else:
                expected_counts(model, symbols, lengths, total)
        yield from _summed(total)

    return run


def baum_welch(encoded: DataFrame, shared: np.ndarray, settings: Settings) -> Model:
    """The start and all rounds over all training rows of `encoded` (a stored table)."""
    spark, k, size = encoded.sparkSession, settings.states, len(shared)
    train = encoded.where(~F.col("held_out")).select("symbols")

    def added(rows: DataFrame, task, value) -> np.ndarray:
        """Counts of one round: a task's sums, added up by symbol ((S + K + 1) x K numbers on the driver)."""
        sent = spark.sparkContext.broadcast(value)
        parts = rows.mapInArrow(task(sent), "symbol long, " + ", ".join(f"g{j} double" for j in range(k)))
        sums = parts.groupBy("symbol").agg(*[F.sum(f"g{j}").alias(f"g{j}") for j in range(k)]).toArrow()
        counts = np.zeros((size + k + 1, k))
        for j in range(k):
            counts[sums.column("symbol").to_numpy(), j] = sums.column(f"g{j}").to_numpy()
        sent.unpersist()
        return counts

    def whole(sent):
        return _expect(sent, size, k, settings.chunk_tokens)

    model = initial(added(train, whole, None), shared, settings)
    if settings.init_rounds:
        counted = train.mapInArrow(_pairs(size, settings.chunk_tokens), "pair long, c long")
        pairs = stored(counted.groupBy("pair").agg(F.sum("c").alias("c")), "hmm-pairs")
        occupied = np.full(k, 1 / k)
        for _ in range(settings.init_rounds):
            counts = added(pairs, lambda sent: _expect_pairs(sent, size, k), (model, occupied))
            model = maximise(counts, shared, settings)
            left = counts[size : size + k].sum(axis=1) + 0.1
            occupied = left / left.sum()
        discard(pairs)
    for _ in range(settings.rounds):
        model = maximise(added(train, whole, model), shared, settings)
    return model


def _score(shared, limit: int):
    def run(batches):
        model: Model = shared.value
        names = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "known_log", "class_log"]
        for rows, symbols, lengths in _chunks(batches, 7, limit):
            logs = chain.log_likelihood(chain.Layout(lengths), symbols, model.start, model.move, model.emit)
            kept = {id(b): b for b, _ in rows}
            tables = []
            for key, b in kept.items():
                at = [i for c, i in rows if id(c) == key]
                tables.append(b.select(names).slice(at[0], len(at)))
            done = pa.Table.from_batches(tables).combine_chunks()
            yield from done.append_column("chain_log", pa.array(logs)).to_batches()

    return run


def score(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", held_out=None, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    `held_out` is a boolean column expression; rows where it is true don't train the model.
    """
    settings = settings or Settings()
    if settings.own_words + settings.classes > 1 << 16:
        raise ValueError("own_words + classes: symbols are kept in 16 bits")
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False)).alias("held_out"), F.col(text).alias("text"),
    )
    counts = stored(word_counts(rows.where(~F.col("held_out")).select("text"), settings), "hmm-counts")
    v = vocabulary(counts, settings)
    shared_v = spark.sparkContext.broadcast(v)
    encoded = stored(rows.mapInArrow(_encode(shared_v, settings.classes), ENCODED), "hmm-encoded")

    shared = np.concatenate([v.counts[: v.own], v.class_tokens]) + 1.0
    model = baum_welch(encoded, shared / shared.sum(), settings) if v.tokens else None

    # counts that were looked up are in the sums already; what is left is joined word by word
    left = F.col("c") < F.lit(int(v.counts.min())) if len(v.counts) else F.lit(True)
    rare = encoded.select("rid", F.explode("rare").alias("word"))
    rare_sums = (
        rare.join(counts.where(left).select("word", "c"), "word")
        .groupBy("rid")
        .agg(F.sum(F.log10(F.col("c") + F.lit(1.0))).alias("rare_log"), F.count("*").alias("rare_known"))
    )
    if model is None:
        chained = encoded.select("rid", "doc_id", "held_out", "n_tokens", "n_known", F.lit(0.0).alias("known_log"), F.lit(0.0).alias("class_log"), F.lit(0.0).alias("chain_log"))
    else:
        kinds = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, class_log double, chain_log double"
        chained = encoded.drop("rare").mapInArrow(_score(spark.sparkContext.broadcast(model), settings.chunk_tokens), kinds)
    extra = F.coalesce("rare_log", F.lit(0.0))
    per_token = float(np.log10(v.tokens + v.distinct + 1.0))
    return chained.join(rare_sums, "rid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("known_log") + extra - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("chain_log") + F.col("class_log") + extra).alias("score"),
    )
