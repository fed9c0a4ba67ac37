"""Paragraph fingerprints: invertible Bloom lookup sketches, in DataFrame expressions only.

A text's paragraphs (its lines that aren't blank, without the white space around them) are hashed;
the distinct digests are dealt by hash into blocks of a few digests, a power of two in number. A
block's sketch has three sub-tables; a digest goes into one cell of each, which holds a count, the
exclusive-or of its digests and that of their check hashes. The fingerprint is the sketch itself,
written out: cells a block, blocks, then the cells. Its size is the smallest at which every block
alone can be peeled, so a fingerprint gives back all its digests.

Likeness needs the two fingerprints only: cells of equally dealt sketches subtract, so what both
have cancels; peeling takes out cells with a single digest left, again and again, until nothing is
left. A block that can't be peeled, and all blocks of sketches that are dealt differently, are
sketched again from the digests that the fingerprints give back, with twice the cells and other
hashes, until they can. Likeness: shared over distinct digests; two texts without any are alike
(1). Equal texts have equal sketches. Null text counts as empty. Rows with the same doc_id are rows
of their own, in the order of their texts; a table of one row is its own neighbour; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import partitions_for, range_bounds, range_bucket

PER_BLOCK = 4
SIZES = [12 << i for i in range(12)]  # cells of a block, by attempt; each has hashes of its own
ROUNDS = 12


def let(value: Column, body) -> Column:
    """`body` of the value, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the paragraphs."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def check_hash(x: Column) -> Column:
    return F.xxhash64(x, F.lit(1_000_003))


def blocks_for(n: Column) -> Column:
    """A power of two, about n / PER_BLOCK."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(n / F.lit(PER_BLOCK), F.lit(1.0))))).cast("int")


def dealt(values: Column, blocks: Column) -> Column:
    """`values` by block, in two steps, so that n values of b blocks cost n * sqrt(b)."""
    coarse = F.pow(F.lit(2.0), F.floor(F.log2(blocks) / 2)).cast("int")
    fine = (blocks / coarse).cast("int")

    def deal(c):
        def part(i):
            own = F.filter(values, lambda x: F.pmod(x, c.coarse) == i)
            return let(own, lambda o: F.transform(F.sequence(F.lit(0), c.fine - 1), lambda j: F.filter(o, lambda x: F.pmod(F.shiftrightunsigned(x, 20), c.fine) == j)))

        return F.flatten(F.transform(F.sequence(F.lit(0), c.coarse - 1), part))

    return F.when(blocks == 1, F.array(values)).otherwise(let(F.struct(coarse.alias("coarse"), fine.alias("fine")), deal))


def _item(x: Column, size: Column, *more: Column) -> Column:
    third = (size / 3).cast("int")
    places = [(F.pmod(F.xxhash64(x, size * 10 + j), third) + third * j).cast("int") for j in range(3)]
    return F.struct(x.alias("k"), check_hash(x).alias("h"), F.array(*places).alias("p"), *more)


def sketch(block: Column, size: Column) -> Column:
    """array<struct<c: long, k: long, h: long>> of `size` cells."""
    zero = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("h"))

    def cell(items):
        def one(i):
            mine = F.filter(items, lambda t: F.array_contains(t.p, i))
            return F.aggregate(mine, zero, lambda a, t: F.struct((a.c + 1).alias("c"), a.k.bitwiseXOR(t.k).alias("k"), a.h.bitwiseXOR(t.h).alias("h")))

        return F.transform(F.sequence(F.lit(0), size - 1), one)

    return let(F.transform(block, lambda x: _item(x, size)), cell)


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x.c - y.c).alias("c"), x.k.bitwiseXOR(y.k).alias("k"), x.h.bitwiseXOR(y.h).alias("h")))


def peeled(cells: Column, size: Column) -> Column:
    """The digests that only one side has; null if some can't be recovered."""

    def step(state, _):
        pure = F.filter(state.cells, lambda c: (F.abs(c.c) == 1) & (c.h == check_hash(c.k)))
        distinct = F.array_distinct(F.transform(pure, lambda c: F.struct(c.k.alias("k"), c.c.alias("c"))))

        def take(found):
            def less(items):
                def one(c, i):
                    mine = F.filter(items, lambda t: F.array_contains(t.p, i))
                    return F.aggregate(mine, c, lambda a, t: F.struct((a.c - t.s).alias("c"), a.k.bitwiseXOR(t.k).alias("k"), a.h.bitwiseXOR(t.h).alias("h")))

                return F.transform(state.cells, one)

            items = F.transform(found, lambda f: _item(f.k, size, f.c.alias("s")))
            return F.when(F.size(found) == 0, state).otherwise(
                F.struct(let(items, less).alias("cells"), F.concat(state.found, F.transform(found, lambda f: f.k)).alias("found"))
            )

        return let(distinct, take)

    begin = F.struct(cells.alias("cells"), F.array().cast("array<long>").alias("found"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, step)
    return let(done, lambda s: F.when(~F.exists(s.cells, lambda c: (c.c != 0) | (c.k != 0) | (c.h != 0)), s.found))


def _first(attempt, kind: str, above: Column | None = None) -> Column:
    """What the first of the ascending sizes gives that doesn't give null."""
    sizes = F.array(*[F.lit(s) for s in SIZES])
    sizes = sizes if above is None else F.filter(sizes, lambda s: s > above)
    return F.aggregate(sizes, F.lit(None).cast(kind), lambda found, size: F.coalesce(found, attempt(size)))


def block_difference(a: Column, b: Column, above: Column) -> Column:
    """Digests in one of two blocks only: sketch, subtract, peel; more cells on failure."""
    return _first(lambda s: peeled(subtracted(sketch(a, s), sketch(b, s)), s), "array<long>", above)


CELLS = "array<array<struct<c: long, k: long, h: long>>>"
SKETCH = f"struct<n: int, size: int, parts: array<array<long>>, cells: {CELLS}>"


def sketched(values: Column) -> Column:
    """n, size, parts and cells of the smallest sketch of which every block can be peeled alone."""

    def attempt(parts, size):
        cells = F.transform(parts, lambda b: sketch(b, size))
        n = F.aggregate(parts, F.lit(0), lambda a, b: a + F.size(b))
        whole = lambda c: F.when(F.forall(c, lambda b: peeled(b, size).isNotNull()), F.struct(n.alias("n"), size.alias("size"), parts.alias("parts"), c.alias("cells")))
        return let(cells, whole)

    return let(dealt(values, blocks_for(F.size(values))), lambda parts: _first(lambda s: attempt(parts, s), SKETCH))


def difference(a: Column, b: Column) -> Column:
    """Digests of one sketch only; `parts` stand for what peeling a sketch alone gives back."""

    def block(z):
        return F.coalesce(peeled(subtracted(z.ca, z.cb), a.size), block_difference(z.pa, z.pb, a.size))

    zipped = F.arrays_zip(a.cells.alias("ca"), b.cells.alias("cb"), a.parts.alias("pa"), b.parts.alias("pb"))
    direct = F.flatten(F.transform(zipped, block))
    blocks = F.greatest(F.size(a.parts), F.size(b.parts))
    again = let(blocks, lambda n: F.flatten(F.zip_with(dealt(F.flatten(a.parts), n), dealt(F.flatten(b.parts), n), lambda x, y: block_difference(x, y, F.lit(0)))))
    return F.when((a.size == b.size) & (F.size(a.parts) == F.size(b.parts)), direct).otherwise(again)


def likeness(a: Column, b: Column) -> Column:
    """Of two sketches, from 0 to 1."""
    total = a.n + b.n
    return F.when(total == 0, F.lit(1.0)).otherwise(let(F.size(difference(a, b)), lambda d: (total - d) / (total + d)))


def fingerprint(s: Column) -> Column:
    """The sketch as a string: cells a block, blocks, then each cell's count, digests and checks in hex."""
    word = lambda x, n: F.lpad(F.hex(x), n, "0")
    cells = F.transform(F.flatten(s.cells), lambda c: F.concat(word(c.c, 4), word(c.k, 16), word(c.h, 16)))
    return F.lower(F.concat_ws(":", s.size.cast("string"), F.size(s.parts).cast("string"), F.array_join(cells, "")))


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mb: int = 8) -> DataFrame:
    """doc_id, text, sketch, and the text and sketch of the next row in descending doc_id as next.

    Rows are dealt out by ranges of doc_id; a range's topmost rows go to the range above as well, to
    end it (those of the top range end the lowest), so no window spans the whole table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = partitions_for(docs, mb)
    bounds = range_bounds(rows.select("doc_id"), "doc_id", 4 * n)
    bucketed = rows.withColumn("bucket", range_bucket("doc_id", bounds))
    tops = sorted((r.bucket, r.top) for r in bucketed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect())
    above = [tops[(i + 1) % len(tops)][0] for i in range(len(tops))]
    ends = spark.createDataFrame([(b, top, up) for (b, top), up in zip(tops, above, strict=True)], "bucket int, top long, above int")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra"))
    more = F.struct(F.col("above").alias("bucket"), F.lit(1).alias("extra"))
    copied = bucketed.join(F.broadcast(ends), "bucket").select(  # one row for each range of ids
        "doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("top")), F.array(own, more)).otherwise(F.array(own))).alias("to")
    )
    order = Window.partitionBy("bucket").orderBy("extra", F.col("doc_id").desc(), "text")
    placed = copied.select("to.bucket", "to.extra", "doc_id", "text").repartition("bucket")
    placed = placed.withColumn("sketch", sketched(digests(F.col("text"))))
    return placed.withColumn("next", F.lead(F.struct("text", "sketch")).over(order)).where("extra = 0").select("doc_id", "text", "sketch", "next")


def edited_likeness(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Edited: the last half of the code points gives way to as many of the next text's first.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    paired = with_next(docs, text, doc_id).select(
        "doc_id", n.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"),
        F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next.text").substr(F.lit(1), half)).alias("edited_text"),
    )
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return paired.withColumn("edited_sketch", sketched(digests(F.col("edited_text")))).select(
        "doc_id", "n_chars", "edited_text",
        fingerprint(own).alias("fingerprint"), fingerprint(edited).alias("edited_fingerprint"),
        likeness(own, edited).alias("near_edited"), likeness(own, after).alias("near_next"),
    )
