r"""Importance resampling towards a target distribution, by hashed word features.

An untrained Regex Split of the tokenizers library takes the words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`
of a text whose A-Z are lower-cased, each with its pair of offsets. Every window of 1 to `most`
consecutive pairs is a feature, its words joined by one space; the feature's bucket is the CRC-32
of its UTF-8 bytes modulo the number of buckets. Buckets are counted over all documents (s, S in
all) and over all target texts (t, T in all), and a bucket's gain is
floor(1000 * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))). A document's weight is the
sum of its features' gains; with Gumbel noise from a hash of its id it is the score by which
`percent` of the documents with at least `least_words` words are drawn without replacement.

Documents are read once: their buckets are stored, 2 bytes or so a word. A histogram has as many
rows as there are buckets, a parameter, so it may go to the driver and the gains be broadcast. Rows
are ranked by ranges of the score and the id, each range numbered in its own task, so no task holds
all rows.

Null and empty texts have no feature: weight 0, never drawn unless `least_words` is 0. A long text
is split a piece at a time. A null id has the noise of an empty one and stands behind equal scores;
rows with the same id and score get neighbouring ranks. Empty tables: without documents no row,
without target texts T is 0. Other columns of the tables are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import partitions_for, stored

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
APART = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
PIECE = 1 << 18  # characters that are split at once
REMEMBERED = 1 << 18  # buckets of words that a task keeps


def pieces_of(text: str) -> Iterator[str]:
    """`text` in pieces that end between words."""
    at = 0
    while at < len(text):
        cut = APART.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class Bucketer:
    """Buckets of the features of a text, in the order of the windows' first words."""

    def __init__(self, most: int, buckets: int):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        self.split = Split(Regex(WORD), behavior="removed", invert=True)
        self.most, self.buckets, self.known = most, buckets, {}

    def words(self, text: str) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """Each piece, lower-cased, with its words' offset pairs."""
        for piece in pieces_of(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")):
            yield piece, [pair for _, pair in self.split.pre_tokenize_str(piece)]

    def singles(self, text: str) -> list[int]:
        out, known = [], self.known
        for piece, pairs in self.words(text):
            for a, b in pairs:
                word = piece[a:b]
                bucket = known.get(word)
                if bucket is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    bucket = known[word] = zlib.crc32(word.encode()) % self.buckets
                out.append(bucket)
        return out

    def __call__(self, text: str | None) -> tuple[int, list[int]]:
        """Number of words, and the buckets of all features."""
        if not text:
            return 0, []
        if self.most == 1:
            out = self.singles(text)
            return len(out), out
        n, out, before = 0, [], []  # before: the last words of the piece before this one
        for piece, pairs in self.words(text):
            own = [piece[a:b].encode() for a, b in pairs]
            words = before + own
            for i in range(len(words)):
                crc = 0
                for k in range(min(self.most, len(words) - i)):
                    crc = zlib.crc32(words[i + k] if k == 0 else b" " + words[i + k], crc)
                    if i + k >= len(before):  # else the piece before has it
                        out.append(crc % self.buckets)
            n += len(own)
            before = words[-(self.most - 1) :]
        return n, out


def features(rows: DataFrame, text: str = "text", keys: tuple[str, ...] = (), most: int = 1, buckets: int = 10_000) -> DataFrame:
    """The `keys`, n_words, and the buckets of all features of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Bucketer(most, buckets)
        for batch in batches:
            texts = batch.column(len(keys))
            made, n, held, at = [], [], 0, 0
            for i, one in enumerate(texts):
                words, own = of(one.as_py())
                n.append(words)
                made.append(np.array(own, np.int32))
                held += len(own)
                if held > 1 << 21 or i + 1 == len(texts):
                    ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(at, len(made)) for j in range(len(keys))), pa.array(n, pa.int64()), lists], names=[*keys, "n_words", "buckets"])
                    made, n, held, at = [], [], 0, i + 1

    kinds = dict(rows.dtypes)
    return rows.select(*keys, F.col(text).alias("_text")).mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "n_words long", "buckets array<int>"]))


def histogram(featured: DataFrame, buckets: int) -> list[int]:
    """How many features fall into each bucket: as many rows as there are buckets come to the driver."""
    out = [0] * buckets
    for bucket, n in featured.select(F.explode("buckets").alias("bucket")).groupBy("bucket").count().toLocalIterator():
        out[bucket] = n
    return out


def gains(target: list[int], source: list[int]) -> list[int]:
    many, t_all, s_all = len(source), sum(target), sum(source)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + many) / ((s + 1.0) * (t_all + many)))) for t, s in zip(target, source, strict=True)]


def weighted(featured: DataFrame, gain: list[int], key: str) -> DataFrame:
    """key, n_words, n_features, weight."""
    sent = featured.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            total = np.concatenate([[0], np.cumsum(sent.value[lists.values.to_numpy()[ends[0] : ends[-1]]])])
            at = ends - ends[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(total[at[1:]] - total[at[:-1]])], names=[key, "n_words", "n_features", "weight"])

    kind = dict(featured.dtypes)[key]
    return featured.select(key, "n_words", "buckets").mapInArrow(run, f"`{key}` {kind}, n_words long, n_features long, weight long")


def noise(key: str, seed: int):
    """floor(-1000 * ln(-ln(u))), u from the first 32 bits of a hash of the seed and the id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """`rows` stored with part and place: ranges of the order, and a row's place in its range from 1."""
    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            place = pa.array(np.arange(seen + 1, seen + n + 1, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), place], names=[*batch.schema.names, "_part", "_place"])
            seen += n

    ordered = rows.repartitionByRange(partitions_for(rows), *order).sortWithinPartitions(*order)
    return stored(ordered.mapInArrow(run, f"{kinds}, _part int, _place long"), name)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", most: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every document's key, n_features, weight, score, and its rank if it is drawn."""
    own = stored(features(docs, text, (key,), most, buckets), "features")
    gain = gains(histogram(features(target, text, (), most, buckets), buckets), histogram(own, buckets))
    scored = weighted(own, gain, key).select(key, "n_features", "weight", (F.col("weight") + noise(key, seed)).alias("score"), (F.col("n_words") < least_words).alias("_short"))
    placed = numbered(scored, [F.col("_short"), F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features"), F.col("weight")], "scored")
    parts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.count_if(~F.col("_short")).alias("_long"))
    every = Window.partitionBy(F.lit(0))  # a row for each range, whose number is bounded
    before = F.coalesce(F.sum("_n").over(every.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    drawn = F.floor(F.sum("_long").over(every) * percent / 100)
    parts = parts.select("_part", before.alias("_before"), drawn.alias("_drawn"))
    rank = F.col("_before") + F.col("_place")
    return placed.join(F.broadcast(parts), "_part").select(key, "n_features", "weight", "score", F.when(~F.col("_short") & (rank <= F.col("_drawn")), rank).alias("rank"))
