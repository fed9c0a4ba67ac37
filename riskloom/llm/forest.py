"""Nearest neighbours by a hash-prefix forest.

Rows are dealt by hash of their id into shards of about `shard` rows; a shard's forest holds, for
each tree, the rows' hash strings in sorted order. A string has eight digits of eight bits: under
the tree's random rotation, the axes that the row is nearest to, nearest first. A query descends
every tree to its longest prefix match by binary search and ascends all trees together, a digit at a
time, until the rows below the prefixes are enough: `spare` times k over all shards. Those are
scored exactly, which is about two fifths of a shard of nearly uniform vectors, whatever its size.
How many rows are enough depends on how the vectors lie, so each shard measures it: a sample of the block's queries is
held against all of the shard's rows, and the number is doubled until they find `SHARE` of their nearest, at last by all rows.
Rows with one hash string always come together, so ties among copies are whole. Queries that end up
with fewer than k rows ask all rows.

Largest inner product is turned into smallest angle first: a vector gets one more component that
makes all of a shard's vectors equally long, about their mean: an inner product with the mean is the same for all rows, so it can't order them. Scores are inner products of the original vectors in
double precision. Every row is indexed; queries meet shards in blocks of bounded size.

Vectors that are null, zero, or hold a null or non-finite component, and rows without an id, take no part. Vectors of
different lengths never meet. Rows with the query's own id are not its neighbours. Fewer than k
candidates: all of them. Repeated ids keep one row each among a query's results. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored

TREES = 88
DIGITS = 8
AXES = 127  # of a rotation, at most: each has two ends, and a digit holds which
SHARE, TRIED = 0.95, 128  # of the nearest rows of a shard, as found by so many of a block's queries


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, seed: int = 11):
        self.n, dims = vectors.shape
        vectors = vectors - vectors.mean(axis=0) if self.n else vectors
        norms = np.linalg.norm(vectors, axis=1)
        self.scale = norms.max(initial=0.0) or 1.0
        rest = np.sqrt(np.maximum(0.0, 1.0 - (norms / self.scale) ** 2))
        rng = np.random.default_rng(seed)
        lifted = np.concatenate([vectors / self.scale, rest[:, None]], axis=1)
        self.turns, self.strings, self.order = [], [], []
        for _ in range(trees):
            turn = rng.standard_normal((dims + 1, min(dims + 1, AXES)))
            self.turns.append(np.linalg.qr(turn)[0])
            s = _strings(lifted @ self.turns[-1])
            by = np.argsort(s, kind="stable")
            self.strings.append(s[by])
            self.order.append(by)

    def candidates(self, queries: np.ndarray, least: int) -> list[np.ndarray]:
        """Rows below the longest common prefix length at which all trees together hold `least` different rows."""
        unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        lifted = np.concatenate([unit, np.zeros((len(queries), 1))], axis=1)
        asked = [_strings(lifted @ turn) for turn in self.turns]
        depth, open_ones, out = np.full(len(queries), DIGITS), np.arange(len(queries)), [np.zeros(0, np.int64)] * len(queries)
        while len(open_ones):
            mask = np.array([(1 << 8 * (DIGITS - d)) - 1 for d in depth[open_ones].tolist()], np.uint64)
            found = [(np.searchsorted(s, q[open_ones] & ~mask, "left"), np.searchsorted(s, q[open_ones] | mask, "right")) for s, q in zip(self.strings, asked, strict=True)]
            places = np.stack([np.stack(r) for r in found])  # trees x 2 x queries
            again = []
            for i, total in enumerate((places[:, 1] - places[:, 0]).sum(axis=0).tolist()):
                which = open_ones[i]
                if total >= least or not depth[which]:
                    seen = np.zeros(self.n, bool)
                    for o, (a, b) in zip(self.order, places[:, :, i].tolist(), strict=True):
                        seen[o[a:b]] = True
                    out[which] = np.flatnonzero(seen)
                if len(out[which]) < least and depth[which]:
                    again.append(which)  # ascend in all trees
            open_ones = np.array(again, np.int64)
            depth[open_ones] -= 1
        return out


def _strings(turned: np.ndarray) -> np.ndarray:
    """The nearest axes of each row, nearest first, as one number."""
    ends = np.concatenate([turned, -turned], axis=1)
    k = min(DIGITS, ends.shape[1])
    near = np.argpartition(-ends, k - 1, axis=1)[:, :k]
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(ends, near, 1), axis=1, kind="stable"), 1)
    digits = np.zeros((len(turned), DIGITS), np.uint8)
    digits[:, :k] = near
    return np.ascontiguousarray(digits).view(">u8").ravel().astype(np.uint64)


def _best(ids: np.ndarray, vectors: np.ndarray, found: np.ndarray, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best of the found rows, ties to the smaller id, one row for each id."""
    scores = vectors @ query if len(found) == len(ids) else vectors[found] @ query
    other = ids[found] != own
    found, scores = found[other], scores[other]
    order = np.lexsort((ids[found], -scores))
    _, first = np.unique(ids[found][order], return_index=True)
    order = order[np.sort(first)[:k]]
    return ids[found][order], scores[order]


def _enough(forest: Forest, ids: np.ndarray, vectors: np.ndarray, q_ids: np.ndarray, q: np.ndarray, near: int, least: int) -> int:
    """`least`, doubled until a sample of the queries finds SHARE of its `near` nearest rows; equal scores stand for each other."""
    at = np.unique(np.linspace(0, len(q) - 1, min(TRIED, len(q))).astype(np.int64))
    scores = np.where(ids == q_ids[at, None], -np.inf, q[at] @ vectors.T)
    near = min(near, len(ids))
    last = np.partition(scores, len(ids) - near, axis=1)[:, len(ids) - near]
    while least < len(ids):
        found = forest.candidates(q[at], least)
        hits = [min(near, np.count_nonzero(s[f] >= x)) for s, f, x in zip(scores, found, last, strict=True)]
        if np.mean(hits) >= SHARE * near:
            return least
        least *= 2
    return len(ids)


def _usable(c: str):
    v = F.col(c)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def nearest(
    table: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding",
    shard: int = 4_096, block: int = 4_096, spare: int = 8,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `table` nearest to each row of `queries`."""
    pick = [F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")]
    usable = _usable(embedding) & F.col(vec_id).isNotNull()
    rows, asked = table.where(usable).select(*pick), queries.where(usable).select(*pick)
    n, m = rows.count(), asked.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-m // block))
    all_of = lambda count, name: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)
    dealt = rows.select("id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), all_of(blocks, "block"))

    def search(needed: int | None):
        """Rows of a shard for a block of queries: those below prefixes that hold `needed` rows, or all."""

        def run(own: pd.DataFrame, them: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(own) and len(them):
                ids, vectors = own["id"].to_numpy(), np.stack(own["v"].to_numpy())
                forest, least = None if needed is None else Forest(vectors), len(ids)
                if forest is not None:
                    least = _enough(forest, ids, vectors, them["id"].to_numpy(), np.stack(them["v"].to_numpy()), min(k, 2 * -(-k // shards)), needed)
                for at in range(0, len(them), 512):
                    part = them.iloc[at : at + 512]
                    q_ids, q = part["id"].to_numpy(), np.stack(part["v"].to_numpy())
                    every = [np.arange(len(ids))] * len(q) if least >= len(ids) else forest.candidates(q, least)
                    for i, found in enumerate(every):
                        best, scores = _best(ids, vectors, found, q_ids[i], q[i], k)
                        out.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": best, "score": scores}))
            return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

        return run

    def met(those: DataFrame, needed: int | None) -> DataFrame:
        keys = ["dims", "shard", "block"]
        meet = those.select("id", "v", F.size("v").alias("dims"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), all_of(shards, "shard"))
        near = dealt.groupBy(*keys).cogroup(meet.groupBy(*keys)).applyInPandas(search(needed), "query_id long, vec_id long, score double")
        near = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    first = stored(met(asked, 1 + -(-spare * k // shards)), "nearest")  # one more, as the query's own row may be there
    whole = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = stored(asked.join(whole, "id", "left_anti"), "nearest-short")
    return first.join(whole, F.col("query_id") == F.col("id"), "left_semi").unionByName(met(short, None))
