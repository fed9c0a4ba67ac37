"""SimHash near-dedup with an exact check: texts alike by the Jaccard likeness of word shingles.

Two texts are linked if the sets of their `n`-word shingles have a Jaccard likeness of at least
`least` (a fraction). Texts with equal sets are one node.

1. SimHash: fingerprints over the shingle sets, linked by the BK-trees of `simhash`. Together with
   the nodes that share much of their prefix (below) with a key's smallest node, these are first
   candidates; whole sets decide. That joins large groups of near copies in linear time.
2. Fingerprints can't see every pair at the least likeness, so what is still apart is completed by
   an exact prefix filter. Shingles have one order for all texts: rare ones first, by hash, those
   common in a sample of texts last (the sample decides how fast it is, not what is found). Sets
   that are alike enough share one of the first |s| - ceil(least |s|) + 1 shingles of that order, so
   every pair that is linked meets at such a key. Nodes that share too few of their prefix shingles
   with any other for their size meet none. Two sizes say how many shingles the pair must have in
   common, and so how early in both orders a key must stand; the bits in which two parity
   signatures differ are at most as many as the shingles that only one set holds. Pairs of a key in
   different components that pass both are held against each other by prefixes: how many shingles
   they share there, and where, bounds what the sets can share in all. Only pairs that may still be
   alike enough are held against each other whole.

Null or blank texts have the empty set and are one node. An empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm import simhash
from riskloom.llm.common import discard, mapped, stored, words
from riskloom.llm.simhash import components, one_of_each, text_hash

LEAST = Fraction(4, 5)
COMMON = 262_144  # shingles that are put last, at most
SAMPLE = 16_384  # texts, about, that tell which are common
ROUNDS = 4  # of new centres, at most, which decide how fast it is, not what is found
MUCH = 0.1  # of the links so far; a round that finds less is the last
BITS = 512  # of a parity signature; those of sets of over 1,100 shingles tell little
_FACTORS = np.random.default_rng(31).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles, ascending; all words are the one shingle of a shorter text."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(x) for x in w], np.uint64)
    k = min(n, len(w))
    m = len(w) - k + 1
    total = np.full(m, k, np.uint64)
    for i in range(k):
        total += h[i : i + m] * _FACTORS[i]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.unique(total ^ (total >> np.uint64(29)))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def parities(s: np.ndarray) -> np.ndarray:
    """Bit b: whether the shingles with b as the lowest bits of their hash are odd in number."""
    odd = np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(n: int, common=None, least: Fraction = LEAST):
    """node, fingerprint, parity signature, size and shingles of each text: all of them, or the prefix in the common order."""

    def run(batches):
        late, rank = common.value if common is not None else (None, None)
        for b in batches:
            nodes, prints, odd, sizes, kept = [], [], [], [], []
            for text in b.column(1):
                s = shingles(text.as_py(), n)
                nodes.append(xxhash.xxh64_intdigest(s.tobytes()))
                sizes.append(len(s))
                if late is not None:
                    prints.append(simhash.majority(s))
                    odd.append(parities(s))
                    if len(s):
                        at = np.minimum(np.searchsorted(late, s), max(len(late) - 1, 0))
                        ranks = np.where(late[at] == s, rank[at], 0) if len(late) else np.zeros(len(s), np.int64)
                        needed = -(-len(s) * least.numerator // least.denominator)
                        s = s[np.argsort(ranks, kind="stable")[: len(s) - needed + 1]]
                else:
                    prints.append(0)
                    odd.append(None)
                kept.append(_signed(s))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(_signed(np.array(x, np.uint64))) for x in (nodes, prints)), pa.array(odd, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(kept, pa.list_(pa.int64()))],
                ["th", "node", "fp", "odd", "size", "keys"],
            )

    return run


ROWS = "th long, node long, fp long, odd array<long>, size int, keys array<long>"


def _common(texts: DataFrame, n: int):
    """Sorted hashes of the commonest shingles in a sample of texts, and their ranks, 1 for the rarest."""
    every = max(1, texts.count() // SAMPLE)
    seen = mapped(texts.where(F.pmod(F.col("th"), F.lit(every)) == 0), _sets(n), ROWS).select("node", "keys").dropDuplicates(["node"])
    counts = seen.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    top = counts.orderBy(F.desc("c"), "key").limit(COMMON).toArrow().column("key").to_numpy().view(np.uint64)
    order = np.argsort(top)
    return top[order], (len(top) - np.arange(len(top)))[order]


def links(texts: DataFrame, n: int = 5, least: Fraction = LEAST) -> tuple[DataFrame, DataFrame]:
    """(th, node) of every text of the frame (th, text), and the links a, b that join the components."""
    p, q = least.numerator, least.denominator
    common = texts.sparkSession.sparkContext.broadcast(_common(texts, n))
    rows = stored(mapped(texts, _sets(n, common, least), ROWS), "near-prefixes")
    nodes = rows.groupBy("node").agg(F.min("th").alias("th"))
    odd = F.struct(*(F.col("odd")[i].alias(f"w{i}") for i in range(BITS // 64))).alias("odd")
    heads = stored(rows.dropDuplicates(["node"]).select("node", "size", "keys", odd), "near-heads")
    marks = heads.select("node", "size", "odd")
    placed = heads.select("node", "size", F.posexplode("keys").alias("pos", "key"))

    def centred(places: DataFrame, order: Column, root: str) -> DataFrame:
        """Each place with c, the first place of its key in an order, and the node that follows."""
        by_key = Window.partitionBy("key").orderBy(order, "node")
        return places.withColumns({"c": F.first(F.struct("node", "size", "pos", F.col(root).alias("root"))).over(by_key), "more": F.lead("node").over(by_key)})

    # a text that has the key early has few rare shingles before it: it is the least edited one
    shared = centred(placed, F.col("pos"), "node").where("c.node != node OR more IS NOT NULL")
    shared = stored(shared.select("key", "node", "size", "pos", F.col("node").alias("root"), "c"), "near-shared")

    def prefix(size: str) -> Column:
        return F.col(size) - F.ceil(F.col(size) * p / q) + 1

    def close(one: str, other: str) -> Column:
        return (F.col(one) * q >= F.col(other) * p) & (F.col(other) * q >= F.col(one) * p)

    def least_both(one: str, other: str) -> Column:
        """So much the sets of an alike pair have in common."""
        return F.ceil((F.col(one) + F.col(other)) * p / (p + q))

    def early(one: str, other: str) -> Column:
        """The first shingle that an alike pair shares stands no later than that in either set."""
        least = least_both(f"{one}.size", f"{other}.size")
        return (F.col(f"{one}.pos") <= F.col(f"{one}.size") - least) & (F.col(f"{other}.pos") <= F.col(f"{other}.size") - least)

    def even(one: str, other: str) -> Column:
        """Signatures differ in no more bits than an alike pair has shingles that only one of its sets holds."""
        differ = sum((F.bit_count(F.col(f"{one}.odd.w{i}").bitwiseXOR(F.col(f"{other}.odd.w{i}"))) for i in range(BITS // 64)), F.lit(0))
        return differ <= F.col(f"{one}.size") + F.col(f"{other}.size") - 2 * least_both(f"{one}.size", f"{other}.size")

    def both_of(pairs: DataFrame, table: DataFrame) -> DataFrame:
        return pairs.join(table.alias("x"), F.col("a") == F.col("x.node")).join(table.alias("y"), F.col("b") == F.col("y.node"))

    def alike(pairs: DataFrame) -> DataFrame:
        """Those pairs whose whole sets are alike."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        signed = stored(both_of(pairs, marks).where(close("x.size", "y.size") & even("x", "y")).select("a", "b"), "near-signed")
        # how much their prefixes share, and where, in the order that both have
        held = both_of(signed, heads.select("node", "size", "keys")).select("a", "b", F.col("x.size").alias("m"), F.col("y.size").alias("n"), F.col("x.keys").alias("xk"), F.col("y.keys").alias("yk"), F.array_intersect("x.keys", "y.keys").alias("both"))
        place = lambda keys, at: F.array_position(keys, F.element_at("both", at)) - 1
        held = held.where(F.size("both") > 0).select("a", "b", "m", "n", F.size("both").alias("o"), place("xk", -1).alias("i"), place("yk", -1).alias("j"), place("xk", 1).alias("i0"), place("yk", 1).alias("j0"))
        # after the last shared place, one of the two prefixes ends first; what it still holds is in no place of the other
        rest = F.greatest(F.least(F.col("m") - prefix("m"), F.col("n") - F.col("j") - 1), F.least(F.col("m") - F.col("i") - 1, F.col("n") - prefix("n")))
        most = F.least(F.col("o") + rest, F.col("m") - F.col("i0"), F.col("n") - F.col("j0"))
        pairs = stored(held.where(most * (p + q) >= (F.col("m") + F.col("n")) * p).select("a", "b"), "near-pairs")
        discard(signed)
        met = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("th")
        sets = stored(mapped(texts.join(met, "th", "left_semi").dropDuplicates(["th"]), _sets(n), ROWS).select("node", "keys"), "near-sets")
        both = F.size(F.array_intersect("x.keys", "y.keys"))
        linked = stored(both_of(pairs, sets).where(both * q >= (F.size("x.keys") + F.size("y.keys") - both) * p).select("a", "b"), "near-links")
        discard(pairs)
        discard(sets)
        return linked

    def star(places: DataFrame) -> DataFrame:
        """Pairs of a key's centre and the others."""
        pairs = places.where("root != c.root").select(F.struct("node", "size", "pos").alias("x"), F.col("c").alias("y")).where(close("x.size", "y.size") & early("x", "y"))
        return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    # 1. fingerprints within the BK-trees' radius, and each key's nodes with its centre
    firsts = rows.groupBy("fp").agg(F.min("node").alias("first"))
    same = rows.select("fp", "node").distinct().join(firsts, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    seen = simhash.links(firsts.select("fp"))
    near = seen.join(firsts.select(F.col("fp").alias("a"), F.col("first").alias("fa")), "a").join(firsts.select(F.col("fp").alias("b"), F.col("first").alias("fb")), "b")
    edges = alike(same.union(near.select(F.col("fa").alias("a"), F.col("fb").alias("b"))).union(star(shared)))

    def still_open(places: DataFrame) -> DataFrame:
        """Places, with their roots, of keys that hold several components; lo: the smallest root of the key."""
        part = places.select("key", "node", "size", "pos").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
        open_keys = part.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "lo")
        found = stored(part.join(open_keys, "key"), "near-open")
        discard(places)
        return found

    # 2. what a key still holds apart is held against another centre, again if that finds much
    still = still_open(shared)
    for turn in range(ROUNDS):
        more = alike(star(centred(still, F.xxhash64("key", "node", F.lit(turn)), "root")))
        gained, had = more.count(), edges.count()
        edges = edges.union(more)
        if gained < had * MUCH:
            break
        still = still_open(still)

    # 3. whatever pairs of a key are still apart
    part = still.join(still.groupBy("node").agg(F.count("*").alias("s")).join(marks.select("node", "odd"), "node"), "node")  # s: places that it shares with any other
    # the key's smallest component, mostly a large one, is only met by the others and doesn't meet itself
    x, y = part.where("root != lo").alias("x"), part.alias("y")
    once = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.lo")) | (F.col("x.node") < F.col("y.node")))
    # the prefix that ends first must hold what the rest can't
    needed = F.least(prefix("x.size") - F.col("x.size"), prefix("y.size") - F.col("y.size")) + least_both("x.size", "y.size")
    apart = x.join(y, (F.col("x.key") == F.col("y.key")) & once & close("x.size", "y.size") & early("x", "y") & (F.least("x.s", "y.s") >= needed) & even("x", "y"))
    edges = edges.union(alike(apart.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))))
    discard(still)
    discard(heads)
    named = stored(rows.select("th", "node"), "near-nodes")
    discard(rows)
    return named, edges


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = 5, least: Fraction = LEAST) -> DataFrame:
    """One row of every component: the one with the smallest id, rows without an id last."""
    named, edges = links(docs.select(text_hash(text).alias("th"), F.col(text).alias("text")), n, least)
    roots = components(edges)
    classes = named.distinct().join(roots, "node", "left").select("th", F.coalesce("root", "node").alias("root"))
    return one_of_each(docs, classes, text, doc_id)
