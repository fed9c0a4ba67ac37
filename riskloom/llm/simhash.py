"""SimHash near-duplicates by BK-trees.

Fingerprints: 64 bits over the XXH64 hashes of word shingles, repeats included. Equal fingerprints
are one node. Candidates: the bits are cut into blocks; two fingerprints within the radius agree
on at least (blocks - radius) of them, so every combination of that many blocks is a key, and
only fingerprints that share a key are compared. A key's fingerprints go into BK-tree shards of
bounded size, children keyed by their integer Hamming distance to the parent; the asked go down all
at once and follow only edges within the radius. A larger key is dealt into pieces, and each pair
of pieces is a task of its own: one piece's tree is sent to it, the other piece asks. No tree goes to
all tasks, as trees of all fingerprints have no size bound. Only edges of a spanning forest leave a
task, so groups of thousands of near copies stay linear in what is written and joined.

Components: alternating large-star and small-star rounds over the edges, stored in the shared
folder, until nothing changes. Nothing of corpus size reaches the driver.

Null or blank texts have fingerprint zero and link like any other. Repeated rows with one doc_id
are each returned, with one component. Rows without an id belong to a component but never name it.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import discard, mapped, stored, words


def fingerprint(text: str | None, n: int = 4) -> int:
    w = words(text)
    if not w:
        return 0
    joined = b" ".join(w)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    digest = xxhash.xxh64_intdigest
    m = max(1, len(w) - n + 1)
    reach = min(n, len(w)) - 1
    return majority(np.array([digest(joined[starts[i] : ends[i + reach]], 42) for i in range(m)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes; 0 for none."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""

    def run(batches):
        for b in batches:
            f = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return mapped(rows, run, "doc_id long, fp long")


class BKTree:
    """Children keyed by their integer Hamming distance to the parent; the first value is the root."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        plain = values.tolist()
        for i in range(1, len(plain)):
            at, v = 0, plain[i]
            while True:
                below = self.children[at].setdefault((plain[at] ^ v).bit_count(), i)
                if below == i:
                    break
                at = below

    def hits(self, asked: np.ndarray, radius: int):
        """(node, which of the asked lie within the radius of it), along edges within the radius only."""
        todo = [(0, np.arange(len(asked)))] if len(self.values) else []
        while todo:
            at, who = todo.pop()
            d = np.bitwise_count(asked[who] ^ self.values[at]).astype(np.int64)
            if (near := who[d <= radius]).size:
                yield at, near
            for k, child in self.children[at].items():
                if (follow := who[np.abs(d - k) <= radius]).size:
                    todo.append((child, follow))


def _forest(tree_values: np.ndarray, asked: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges that connect all that lies within the radius between both sides, none in a ring."""
    values = np.concatenate([tree_values, asked])
    part = np.arange(len(values))
    edges = []
    for node, near in BKTree(tree_values).hits(asked, radius):
        others = near + len(tree_values)
        parts, first = np.unique(part[others], return_index=True)
        for other, i in zip(parts.tolist(), others[first].tolist(), strict=True):
            if other != part[node]:
                part[part == other] = part[node]
                if values[node] != values[i]:
                    edges.append((int(values[node].view(np.int64)), int(values[i].view(np.int64))))
    return edges


def links(nodes: DataFrame, radius: int = 4, blocks: int = 6, shard: int = 2_048, fp: str = "fp") -> DataFrame:
    """a, b: a spanning set of the links among the distinct fingerprints of `nodes`."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        m = 0
        for c in chosen:
            m |= ((1 << cuts[c + 1]) - 1) ^ ((1 << cuts[c]) - 1)
        masks.append(m - (1 << 64) if m >> 63 else m)
    keyed = nodes.select(
        F.col(fp).alias("fp"),
        F.posexplode(F.array(*[F.col(fp).bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "bits"),
    )
    # how many share a key tells which keys are alone (no pair), small (one task) or large (dealt into pieces)
    sizes = keyed.groupBy("mask", "bits").agg(F.count("*").alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / F.lit(shard)).cast("int")
    piece = F.pmod(F.xxhash64("fp"), F.col("pieces")).cast("int")
    shared = keyed.join(sizes.withColumn("pieces", pieces), ["mask", "bits"]).withColumn("piece", piece)
    # the pair (i, j), i <= j, of pieces: piece p stands in (0..p, p) and (p, p..)
    pairs = F.array_distinct(
        F.concat(
            F.transform(F.sequence(F.lit(0), F.col("piece")), lambda i: F.struct(i.alias("i"), F.col("piece").alias("j"))),
            F.transform(F.sequence(F.col("piece"), F.col("pieces") - 1), lambda j: F.struct(F.col("piece").alias("i"), j.alias("j"))),
        )
    )
    dealt = shared.select("mask", "bits", "fp", "piece", F.explode(pairs).alias("pair")).select("mask", "bits", "fp", "piece", "pair.i", "pair.j")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, _, i, j), g in pdf.groupby(["mask", "bits", "i", "j"], sort=False):
            values = g["fp"].to_numpy(np.int64).view(np.uint64)
            if len(values) == 2:
                if int(values[0] ^ values[1]).bit_count() <= radius:
                    out.append(tuple(values.view(np.int64).tolist()))
            elif i == j:
                out += _forest(values, values, radius)
            else:
                first = g["piece"].to_numpy() == i
                out += _forest(values[first], values[~first], radius)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    edges = _grouped(dealt, compare)
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _grouped(dealt: DataFrame, compare) -> DataFrame:
    """`compare` over whole (mask, bits, i, j) groups, many small ones to a call."""
    keys = ["mask", "bits", "i", "j"]

    def run(batches):
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            last = pdf.iloc[-1] if len(pdf) else None
            if last is None:
                continue
            open_group = np.logical_and.reduce([pdf[k].to_numpy() == last[k] for k in keys])
            held = pdf[open_group]
            if not open_group.all():
                yield compare(pdf[~open_group])
        if held is not None and len(held):
            yield compare(held)

    together = dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "fp", "piece")
    return together.mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of an edge. By alternating stars.

    Nodes are of any type with an order. Rounds go on until nothing changes, a few for each doubling
    of the longest path.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    now = stored(both.where("u != v").distinct(), "edges")
    while True:
        # large star: each larger neighbour of u points to the smallest of u and its neighbours
        around = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours point to the smallest of them
        down = large.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = stored(small.where("u != v").distinct(), "edges")
        marks = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("v", "u"))]
        same = after.agg(*marks).first() == now.agg(*marks).first()
        discard(now)
        now = after
        if same:
            break
    return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")


def clusters(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable, itself included) of every row."""
    prints = stored(fingerprints(docs, text, doc_id, shingle), "simhash")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"))
    # nodes are in the order of their smallest id, so a component's root names it and no join by root is needed
    label = F.struct(F.coalesce("first_doc", F.lit((1 << 63) - 1)).alias("d"), F.col("fp"))
    named = stored(nodes.select("fp", "first_doc", label.alias("label")), "simhash-nodes")
    ends = [named.select(F.col("fp").alias(x), F.col("label").alias(f"{x}_label")) for x in "ab"]
    edges = links(named, radius).join(ends[0], "a").join(ends[1], "b").select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b"))
    roots = components(edges).select(F.col("node.fp").alias("fp"), F.nullif(F.col("root.d"), F.lit((1 << 63) - 1)).alias("root_doc"), F.lit(True).alias("linked"))
    classes = named.join(roots, "fp", "left").select("fp", F.when(F.col("linked"), F.col("root_doc")).otherwise(F.col("first_doc")).alias("component_id"))
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id")


def hexed(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def text_hash(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def one_of_each(docs: DataFrame, classes: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of `docs` for each root of `classes` (th, the hash of a text, and root).

    The row with the smallest doc_id stays, ties by the text's hash; rows without an id come last.
    """
    marked = docs.select(F.struct(*docs.columns).alias("row"), text_hash(text).alias("th"), F.col(doc_id).cast("long").alias("d"))
    rank = F.struct(F.col("d").isNull().alias("no_id"), F.col("d").alias("d"))
    least = marked.groupBy("th").agg(F.min(rank).alias("least"))
    chosen = least.join(classes, "th").groupBy("root").agg(F.min(F.struct("least", "th")).alias("m"))
    chosen = chosen.select(F.col("m.least.d").alias("cd"), F.col("m.th").alias("ct"))
    rows = marked.join(chosen, (F.col("th") == F.col("ct")) & F.col("d").eqNullSafe(F.col("cd")))
    return rows.dropDuplicates(["ct"]).select("row.*")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row of every component: the one with the smallest id, rows without an id last."""
    texts = docs.select(text_hash(text).alias("doc_id"), F.col(text).alias("text")).dropDuplicates(["doc_id"])
    prints = stored(fingerprints(texts, "text", "doc_id", shingle).withColumnRenamed("doc_id", "th"), "simhash")
    roots = components(links(prints.select("fp").distinct(), radius))
    classes = prints.join(roots, F.col("fp") == F.col("node"), "left").select("th", F.coalesce("root", "fp").alias("root"))
    return one_of_each(docs, classes, text, doc_id)
