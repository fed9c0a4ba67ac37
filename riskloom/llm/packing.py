"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Documents are dealt by hash of their id, those without one by their place in the table, into shards
of about `shard` documents, each packed in a task of its own, so a source that holds a third of all
rows is spread like any other; shards share no bins, so bins change with the number of rows. In a shard,
documents go in descending size. Bins are kept in order of what is left in them and carry two
bitmaps: the sources and the duplicate clusters they hold. A document looks up the first bin that
has room (its successor in that order) and goes on to the next until a bin shares neither bit: the
tightest compatible bin. If there is none, it opens a bin.

A document above the capacity fills bins of its own; what is over is packed like any other and may
not meet its own cluster either. Null source or cluster: no conflict. Empty documents take no room,
but keep to the same rules. A null id stays null, a null size is 0. Repeated rows are of one cluster, so
they never share a bin. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import mapped, words

PACKED = "doc_id long, piece int, n_tokens long, bin long, place int, start long"


def best_fit(items: list[tuple[int | None, int, object, object]], capacity: int) -> list[tuple[int | None, int, int, int, int, int]]:
    """(doc_id, piece, tokens, bin, place, start) of (doc_id, tokens, source, cluster) items.

    `place` counts the documents of a bin, `start` its tokens before this one.
    """
    sources: dict = {}
    clusters: dict = {}
    bit = lambda seen, x: 0 if x is None else 1 << seen.setdefault(x, len(seen))
    out, parts = [], []
    bins: list[list] = []  # sources, clusters, documents, tokens
    order: list[tuple[int, int]] = []  # (room left, bin)

    def put(doc, piece, n, s, c, b):
        if b is None:
            b = len(bins)
            bins.append([0, 0, 0, 0])
        own = bins[b]
        out.append((doc, piece, n, b, own[2], own[3]))
        own[0] |= s
        own[1] |= c
        own[2] += 1
        own[3] += n
        if own[3] < capacity:
            insort(order, (capacity - own[3], b))

    for doc, n, source, cluster in items:
        s, c = bit(sources, source), bit(clusters, cluster)
        whole, rest = divmod(n, capacity)
        for piece in range(whole):
            put(doc, piece, capacity, s, c, None)
        if rest or not whole:
            parts.append((rest, doc, whole, s, c))
    for n, doc, piece, s, c in sorted(parts, key=lambda p: (-p[0], p[1] is None, p[1] or 0, p[2])):
        at = bisect_left(order, (n, -1))
        while at < len(order) and (bins[order[at][1]][0] & s or bins[order[at][1]][1] & c):
            at += 1
        put(doc, piece, n, s, c, order.pop(at)[1] if at < len(order) else None)
    return out


def sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, n_tokens (words), source, cluster (digest of the lower-cased words) of every row."""

    def run(batches):
        for b in batches:
            split = [words(x.as_py()) for x in b.column(2)]
            digests = [xxhash.xxh3_64_intdigest(b" ".join(w)) for w in split]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(w) for w in split], pa.int64()), b.column(1), pa.array(np.array(digests, np.uint64).view(np.int64))],
                ["doc_id", "n_tokens", "source", "cluster"],
            )

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return mapped(rows, run, "doc_id long, n_tokens long, source string, cluster long")


def pack(sized: DataFrame, capacity: int = 2_048, shard: int = 8_192) -> DataFrame:
    """doc_id, piece, n_tokens, bin, place, start for every piece of (doc_id, n_tokens, source, cluster) rows."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    shards = max(1, -(-sized.count() // shard))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in PACKED.split(", ")]

    def run(batches):
        held: list = []
        now = None

        def done():
            made = [(d, p, n, now << 32 | b, at, start) for d, p, n, b, at, start in best_fit(held, capacity)]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names)

        for b in batches:
            for own, *item in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != now and held:
                    yield done()
                    held = []
                now = own
                held.append(item)
        if held:
            yield done()

    place = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # no one key for all rows without an id
    dealt = sized.select(F.pmod(F.xxhash64("doc_id", place), F.lit(shards)).cast("int").alias("shard"), "doc_id", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), "source", "cluster")
    return dealt.repartition("shard").sortWithinPartitions("shard", "doc_id", "cluster", "n_tokens").mapInArrow(run, PACKED)
