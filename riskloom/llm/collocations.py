r"""Phrase collocations by language, from sorted suffixes.

Texts (A-Z lower-cased) are split at `[.,;:!?\x0A-\x0D]` into pieces and those into words
`[^\x20\x09]+`. A suffix starts at every word and ends after `most` words or with its piece. Suffixes
with a word, or a pair of words next to each other, that occurs less than `least` times in its
language are cut before it, as no frequent phrase has it: words are counted first, then pairs of
frequent words, each count by a shuffle of what tasks have added up. Both sets go out as bit maps of
a bounded size; a wrong hit there costs a longer suffix and no more.

What is left, equal suffixes of a task added up, is routed globally by its leading words: into ranges
of its words, so a common leading word or pair is spread over as many tasks as it needs. Each range
sorts its suffix pointers by a multikey three-way quicksort: the sum of an equal partition is its
prefix's count, the partition goes on with the next word, and partitions below `least` are abandoned.
Prefixes of a range's first and last suffix may go on in the next range and are added up last.

A candidate is a phrase of 2 to `most` words with a = f(phrase) >= least. Cut after its first k words
into parts with counts l and r it scores floor(1000 * a * n / (l * r)), n being the language's words,
in whole numbers of up to 38 digits; the lowest cut counts, the smallest k if equal. Candidates whose words stand in
a longer candidate that occurs (within `percent`) as often are dropped; each language's first `top`
remain, by score, a and phrase.

Null texts count as empty, a null language as `und`. Rows count one by one, repeated ones as well. No
row gives no phrase. A long text is worked on as a whole in one task. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import stored

MARK = b"."  # stands for all that separates pieces, so it is in no word
SIGNS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + MARK * 10 + b" ")
AT_ONCE = 1 << 24  # bytes of text whose suffixes are added up together
MOST_BITS = 1 << 26  # of a bit map
IN_RANGE = 400_000  # suffixes that a task sorts, about
END = "\t"  # behind the language and each word of a key; no word has it


def named(lang: str | None) -> str:
    """A language as part of a key."""
    return "und" if lang is None else lang.replace("%", "%25").replace(END, "%09")


def original(c):
    return F.replace(F.replace(c, F.lit("%09"), F.lit(END)), F.lit("%25"), F.lit("%"))


def split(texts: list[bytes]) -> list[bytes]:
    """Words and marks of several texts, a mark between any two texts."""
    return MARK.join([*texts, b""]).translate(SIGNS).replace(MARK, b" . ").split()


class Bits:
    """A set of hashes as a bit map whose size is a power of two."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.mask = bits, np.uint64(len(bits) * 64 - 1)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bits_of(keys: DataFrame, key: str) -> Bits:
    """The bit map of a column; at most 2^20 words of 64 bits come to the driver."""
    size = 64
    while size < min(MOST_BITS, 16 * keys.count()):
        size *= 2
    at = F.crc32(F.col(key).cast("binary")).bitwiseAND(F.lit(size - 1))
    made = keys.select(at.alias("_at")).select(F.shiftright("_at", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(_at & 63 AS int))").alias("bit"))
    found = made.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return Bits(out.view(np.uint64))


def crcs(keys: pa.Array) -> np.ndarray:
    return np.fromiter((crc32(k) for k in keys.to_pylist()), np.uint64, len(keys))


def together(lang: bytes, columns: list[pa.Array]) -> pa.Array:
    """Keys: the language and the words of a row, each with an end behind it."""
    first = pa.scalar(lang, pa.binary())
    return pc.binary_join_element_wise(first, *columns, pa.scalar(b"", pa.binary()), pa.scalar(END.encode(), pa.binary()), null_handling="skip")


def suffixes(lang: str, texts: list[bytes], depth: int, least_depth: int, words: Bits | None, pairs: Bits | None) -> tuple[pa.Array, np.ndarray, int]:
    """Keys of the distinct suffixes of `least_depth` to `depth` words, how often each occurs, and the number of all words."""
    name = lang.encode()
    coded = pa.array(split(texts), pa.binary()).dictionary_encode()
    ids, names = coded.indices.to_numpy(), coded.dictionary
    plain = pc.not_equal(names, pa.scalar(MARK, pa.binary())).to_numpy(zero_copy_only=False)
    n = int(plain[ids].sum())
    good = plain.copy()
    if words is not None:
        where = np.flatnonzero(plain)
        good[where] = words.has(crcs(together(name, [names.take(pa.array(where))])))
    ok = good[ids]
    size = len(ids)
    length = ok.astype(np.int8)  # of the suffix from here
    joined = np.zeros(size, bool)  # may the next word follow?
    joined[:-1] = ok[:-1] & ok[1:]
    many = np.int64(len(names))
    if pairs is not None and joined.any():
        at = np.flatnonzero(joined)
        two, back = np.unique(ids[at] * many + ids[at + 1], return_inverse=True)
        known = pairs.has(crcs(together(name, [names.take(pa.array(two // many)), names.take(pa.array(two % many))])))
        joined[at] = known[back]
    run = joined.copy()
    for k in range(1, depth):
        length += run
        further = np.zeros(size, bool)
        further[: max(size - k, 0)] = joined[k:]
        run &= further
    starts = np.flatnonzero(length >= least_depth)
    code, length = ids[starts].astype(np.int64) + 1, length[starts]
    for k in range(1, depth):  # ranks of the prefixes, a word more each time
        word = np.where(length > k, ids[np.minimum(starts + k, size - 1)].astype(np.int64) + 1, 0)
        _, code = np.unique(code * (many + 1) + word, return_inverse=True)
    _, first, count = np.unique(code, return_index=True, return_counts=True)
    columns = [names.take(pa.array(np.where(length[first] > k, ids[np.minimum(starts[first] + k, max(size - 1, 0))], 0), mask=length[first] <= k)) for k in range(depth)]
    return together(name, columns), count, n


def counted(docs: DataFrame, text: str, lang: str, depth: int, least_depth: int, words: Bits | None = None, pairs: Bits | None = None) -> DataFrame:
    """key, n: suffixes of `least_depth` to `depth` words, equal ones added up by task; with a depth of 1 also each language's words by its key alone."""
    context = docs.sparkSession.sparkContext
    sent = [context.broadcast(b) if b is not None else None for b in (words, pairs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        room = 0

        def flush():
            for name, texts in held.items():
                keys, count, n = suffixes(name, texts, depth, least_depth, *[b.value if b else None for b in sent])
                if depth == 1 and n:
                    keys, count = pa.concat_arrays([keys, pa.array([(name + END).encode()], pa.binary())]), np.append(count, n)
                for at in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([keys[at : at + (1 << 16)].cast(pa.string()), pa.array(count[at : at + (1 << 16)], pa.int64())], names=["key", "n"])
            held.clear()

        for batch in batches:
            for name, one in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                if one.is_valid:
                    held.setdefault(named(name), []).append(own := one.as_py())
                    room += len(own)
                    if room >= AT_ONCE:
                        yield from flush()
                        room = 0
        yield from flush()

    return docs.select(F.col(lang).alias("_lang"), F.col(text).alias("_text")).mapInArrow(run, "key string, n long")


def quicksort(words: np.ndarray, weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, depth, count): each prefix of at least two words of `words` (a row of codes, 0 behind its last) whose rows weigh `least` or more, one of them, and their weight.

    Column 0 is the language. A multikey three-way quicksort of row pointers: the equal partition's weight is its prefix's count, and what weighs less than `least` is left alone.
    """
    at = np.arange(len(words))
    todo = [(0, len(words), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        own = at[lo:hi]
        codes = words[own, depth]
        pivot = np.sort(codes[[0, (hi - lo) // 2, hi - lo - 1]])[1]
        less, equal = codes < pivot, codes == pivot
        a, b = lo + int(less.sum()), lo + int(less.sum()) + int(equal.sum())
        at[lo:hi] = np.concatenate([own[less], own[equal], own[codes > pivot]])
        for x, y in ((lo, a), (b, hi)):
            if x < y and weight[at[x:y]].sum() >= least:
                todo.append((x, y, depth))
        if pivot and (count := int(weight[at[a:b]].sum())) >= least:
            if depth >= 2:
                yield int(at[a]), depth, count
            if depth + 1 < words.shape[1]:
                todo.append((a, b, depth + 1))


def matrix(keys: pa.Array, most: int) -> tuple[np.ndarray, pa.Array]:
    """Codes (0: no word) of each key's language and words, and what code i + 1 stands for."""
    parts = pc.split_pattern(keys, END)
    sizes = pc.list_value_length(parts).to_numpy() - 1  # the last part is empty
    coded = pc.list_flatten(parts).dictionary_encode()
    ids, ends = coded.indices.to_numpy(), parts.offsets.to_numpy()
    ends = ends - ends[0]
    out = np.zeros((len(keys), most + 1), np.int32)
    for k in range(most + 1):
        has = sizes > k
        out[has, k] = ids[ends[:-1][has] + k] + 1
    return out, coded.dictionary


def frequent_prefixes(ranges: DataFrame, least: int, most: int) -> DataFrame:
    """key, n: the prefixes of each range with `least` or more; those of its first and last key whatever their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        keys, weight = table.column(0).chunk(0), table.column(1).to_numpy()
        raw = keys.cast(pa.binary())
        words, names = matrix(keys, most)
        edge = pc.min_max(raw)
        found: dict[tuple, int] = {}
        for end in ("min", "max"):
            row = words[pc.index(raw, edge[end]).as_py()]
            same = words[:, 0] == row[0]
            for depth in range(1, most + 1):
                same &= words[:, depth] == row[depth]
                if depth >= 2 and row[depth]:
                    found[tuple(row[: depth + 1])] = int(weight[same].sum())
        for row, depth, count in quicksort(words, weight, least):
            found[tuple(words[row, : depth + 1])] = count
        texts = ["".join(names[int(i) - 1].as_py() + END for i in key) for key in found]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(list(found.values()), pa.int64())], names=["key", "n"])

    return ranges.mapInArrow(run, "key string, n long")


def frequent_phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, most: int = 5) -> DataFrame:
    """lang, words (array), n of all phrases of 0 to `most` words with n >= least; of no words: the language's words, whatever their number."""
    is_lang = F.size(F.split("key", END)) == 2
    add = lambda df: df.groupBy("key").agg(F.sum("n").alias("n"))
    ones = stored(add(counted(docs, text, lang, 1, 1)).where((F.col("n") >= least) | is_lang), "words")
    words = bits_of(ones.where(~is_lang), "key")
    twos = stored(add(counted(docs, text, lang, 2, 2, words)).where(F.col("n") >= least), "pairs")
    total = twos.agg(F.sum("n")).first()[0] or 0
    longer = counted(docs, text, lang, most, 2, words, bits_of(twos, "key"))
    ranges = longer.repartitionByRange(max(1, total // IN_RANGE + 1), "key")
    found = add(frequent_prefixes(ranges, least, most)).where(F.col("n") >= least)
    parts = F.split("key", END)
    both = ones.unionByName(found).select(original(parts[0]).alias("lang"), F.slice(parts, 2, F.size(parts) - 2).alias("words"), "n")
    return stored(both, "phrases")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, most: int = 5, percent: int = 100, top: int = 2_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    phrases = frequent_phrases(docs, text, lang, least, most)
    size = F.size("words")
    totals = phrases.where(size == 0).select("lang", F.col("n"))
    if totals.count() <= 100_000:
        totals = F.broadcast(totals)
    counts = phrases.where(size > 0).select("lang", F.concat_ws(" ", "words").alias("phrase"), F.col("n").alias("f"))
    candidates = phrases.where(size > 1).select("lang", F.concat_ws(" ", "words").alias("phrase"), "words", F.col("n").alias("a"))
    # what stands in a longer candidate that is as frequent
    inner = F.expr("flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    within = candidates.where("size(words) > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = candidates.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(percent) * F.col("a")))
    cut = kept.select("lang", "phrase", "a", F.posexplode(F.expr("transform(sequence(1, size(words) - 1), k -> struct(array_join(slice(words, 1, k), ' ') AS left, array_join(slice(words, k + 1, size(words) - k), ' ') AS right))")).alias("k", "parts"))
    side = lambda name: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(name[0]))
    cut = cut.select("lang", "phrase", "a", "k", "parts.left", "parts.right").join(side("left"), ["lang", "left"]).join(side("right"), ["lang", "right"]).join(totals, "lang")
    whole = lambda x: f"cast({x} AS decimal(19, 0))"
    scored = cut.withColumn("score", F.expr(f"cast(cast(1000 AS decimal(4, 0)) * cast({whole('a')} * {whole('n')} AS decimal(34, 0)) AS decimal(38, 0)) div cast({whole('l')} * {whole('r')} AS decimal(38, 0))"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("b")).select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
