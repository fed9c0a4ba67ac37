"""Exact removal of long repeated strings by merging shard Burrows-Wheeler transforms.

A byte goes if a string of `size` bytes (a window) that covers it also starts anywhere else. The
same search runs over words (`WORDS`): then windows are strings of so many words.

1. Spans. A window's key is the smallest hash among its short grams, which depends on its content
   alone, so equal windows have equal keys. Neighbouring windows with one key make a span (about
   one for every 200 bytes). Only spans whose key occurs twice can hold repeats. Spans that are
   equal as a whole travel as one, with the number of times they occur.
2. Shards. Documents are dealt by hash into `SHARDS` shards. Spans of one key meet in a task, which
   sorts one transform for each shard: symbols are hashes of blocks (a quarter of a window of
   bytes, a third of one of words), each phase of a span being one sequence.
3. Merge. The shards' transforms are merged by refining an interleave: one round orders the merged
   suffixes by one more symbol, reading every shard's transform in its own order, and notes where
   neighbours first differ, which is the common prefix in symbols. After as many rounds as a window
   has blocks, what lies between two borders is an interval of equal windows; it is a repeat if its
   spans occur more than once in all. Suffixes are never compared or sorted again across shards.
   A key with one distinct span, whose gram occurs there once, has nothing to merge: its windows
   differ, and each occurs as often as the span.
4. A key whose distinct spans hold more than `limit` symbols (what a task can sort in some 400 MB) is settled by counting window digests
   instead, which spreads over the cluster whatever the key, so no task holds a key of unbounded
   size; its windows are found exactly as well.

Null counts as empty. Texts are UTF-8 bytes; matches never cross rows. Repeated rows repeat each
other. Rows are known by id and a hash of their text; a null id is an id like others. Equality of
blocks and spans is that of 64- and 128-bit hashes. An empty table gives no rows. Input columns
with the name of a result column are replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from riskloom.llm.common import discard, mapped, stored

SHARDS = 8
PIECE = 2_048  # windows of a span row at most
_TABLE = np.random.default_rng(20_231).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_IN_WORD = np.array([b not in b"\t\n\v\f\r " for b in range(256)], np.int8)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def raw_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_bytes(text: str | None) -> bytes:
    """The text's words, 8 bytes of hash each, whatever space is between them.

    A word's hash is a difference of two running sums over the text, moved to where sums begin.
    """
    raw = np.frombuffer(raw_bytes(text), np.uint8)
    if not len(raw):
        return b""
    edge = np.flatnonzero(np.diff(_IN_WORD[raw], prepend=np.int8(0), append=np.int8(0)))
    begin, end = edge[::2], edge[1::2]
    power, back = _powers(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[raw] * power[: len(raw)], dtype=np.uint64)])
    return _mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64)).astype("<u8").tobytes()


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, base, np.uint64)]), dtype=np.uint64)
    return _POWERS


def word_places(raw: bytes) -> list[tuple[int, int]]:
    """Begin and end of each word in the bytes."""
    return [m.span() for m in re.finditer(rb"[^\t-\r ]+", raw)]


@dataclass(frozen=True)
class Alphabet:
    """What a text is a sequence of."""

    data: Callable[[str | None], bytes]
    width: int  # bytes of data for a symbol
    gram: int  # symbols whose hash may be a key
    blocks: int  # symbols of a transform in a window

    def values(self, data: bytes) -> np.ndarray:
        return _TABLE[np.frombuffer(data, np.uint8)] if self.width == 1 else np.frombuffer(data, "<u8").astype(np.uint64)


BYTES = Alphabet(raw_bytes, 1, 32, 4)
WORDS = Alphabet(word_bytes, 8, 4, 3)


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """64-bit polynomial hashes of all strings of k values."""
    if len(values) < k:
        return np.zeros(0, np.uint64)
    power, power_n, out, out_n = values, 1, None, 0
    while True:
        if k & power_n:
            if out is None:
                out, out_n = power, power_n
            else:  # what is there, then this power's string
                n = len(values) - out_n - power_n + 1
                out = out[:n] * np.uint64(pow(_BASE, power_n, 1 << 64)) + power[out_n : out_n + n]
                out_n += power_n
        if power_n * 2 > k:
            return out[: len(values) - k + 1]
        power = power[:-power_n] * np.uint64(pow(_BASE, power_n, 1 << 64)) + power[power_n:]
        power_n *= 2


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _smallest(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours."""
    n = 1
    while n * 2 <= w:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    rest = w - n
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def spans(data: bytes, size: int, of: Alphabet = BYTES) -> list[tuple[int, bytes, int, int, bool]]:
    """(key, digest of the content, first window, windows, key's gram occurs twice) of every span."""
    if len(data) < size * of.width:
        return []
    grams = _mixed(rolling(of.values(data), of.gram))
    w = size - of.gram + 1
    keys = _smallest(grams, w)
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    begin, end = [0, *cut.tolist()], [*cut.tolist(), len(keys)]
    signed = keys.view(np.int64)
    out = []
    for s, e in zip(begin, end, strict=True):
        key = keys[s]
        twice = np.count_nonzero(grams[s : e + w - 1] == key) > 1
        for p in range(s, e, PIECE):
            q = min(e, p + PIECE)
            out.append((int(signed[s]), xxhash.xxh3_128_digest(data[p * of.width : (q + size - 1) * of.width]), p, q - p, bool(twice)))
    return out


def _batch(rows: list, kinds: list, names: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


SPANS = "doc_id long, thash long, key long, digest binary, start int, windows int, twice boolean"


def _spans(size: int, of: Alphabet):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.bool_()]
    names = [c.split()[0] for c in SPANS.split(", ")]

    def run(batches):
        for b in batches:
            rows = []
            for doc, th, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows += [(doc, th, *s) for s in spans(of.data(text.as_py()), size, of)]
                if len(rows) > 100_000:
                    yield _batch(rows, kinds, names)
                    rows = []
            yield _batch(rows, kinds, names)

    return run


MEMBERS = "search int, key long, hot boolean, n long, digest binary, shard int, data binary"


def _cut(searches: list[tuple[int, Alphabet]]):
    """The distinct spans that each document lends its content to."""
    names = [c.split()[0] for c in MEMBERS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary()]

    def run(batches):
        for b in batches:
            rows = []
            for doc, th, text, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                shard = xxhash.xxh32_intdigest(b"%d %d" % (doc, th)) % SHARDS
                members, text = members.as_py(), text.as_py()
                for i, (size, of) in enumerate(searches):
                    own = [m for m in members if m["search"] == i]
                    data = of.data(text) if own else b""
                    rows += [(i, m["key"], m["hot"], m["n"], m["digest"], shard, data[m["start"] * of.width : (m["start"] + m["windows"] + size - 1) * of.width]) for m in own]
                if len(rows) > 20_000:
                    yield _batch(rows, kinds, names)
                    rows = []
            yield _batch(rows, kinds, names)

    return run


def _order(values: np.ndarray) -> np.ndarray:
    """Stable order of small integers, by counting 16 bits at a time."""
    if not len(values) or values.max() < 1 << 16:
        return np.argsort(values.astype(np.uint16), kind="stable")
    low = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((values >> 16).astype(np.uint16)[low], kind="stable")]


class Shard:
    """Block-symbol sequences of some spans: suffixes sorted to `blocks` symbols, and their transform.

    Suffix p of a span continues at p + step; `before` is the symbol at p - step, -1 if the suffix
    begins its sequence. The empty suffixes that end the sequences sort first.
    """

    def __init__(self, symbols: np.ndarray, previous: np.ndarray, ends: np.ndarray, blocks: int):
        """`symbols` by position; `previous`: the position a step before, -1: none; `ends`: for each
        sequence the position of its last symbol."""
        n = len(symbols)
        empty = np.arange(n, n + len(ends), dtype=np.int32)
        order = np.concatenate([empty, np.arange(n, dtype=np.int32)])  # empties, then the rest in any order
        before_of = np.concatenate([previous, ends]).astype(np.int32)
        for _ in range(blocks):
            came = before_of[order]
            came = came[came >= 0]
            order = np.concatenate([empty, came[_order(symbols[came])]])
        self.order = order
        came = before_of[order]
        self.before = np.where(came >= 0, symbols[came], np.int32(-1))
        self.empties = len(ends)


def merged_borders(shards: list[Shard], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The final interleave (shard of each suffix) and common prefix with the suffix before, in symbols.

    The prefix is capped at `blocks`. Round h derives the interleave by h symbols from that by h - 1.
    """
    z = np.concatenate([np.full(len(s.order), j, np.uint16) for j, s in enumerate(shards)])
    head = np.concatenate([np.full(s.empties, j, np.uint16) for j, s in enumerate(shards)])
    transforms = np.concatenate([s.before for s in shards])
    block = np.zeros(len(z), np.int32)  # interval of each suffix by the symbols so far
    prefix = np.full(len(z), blocks, np.int8)
    prefix[0] = 0
    for h in range(1, blocks + 1):
        read = np.empty(len(z), transforms.dtype)
        read[np.argsort(z, kind="stable")] = transforms  # every shard's transform, in its own order
        has = np.flatnonzero(read >= 0)
        by = has[_order(read[has])]
        symbol = np.concatenate([np.full(len(head), -1, np.int32), read[by]])
        inner = np.concatenate([np.zeros(len(head), np.int32), block[by]])
        z = np.concatenate([head, z[by]])
        border = (symbol[1:] != symbol[:-1]) | (inner[1:] != inner[:-1])
        new = np.flatnonzero(border & (prefix[1:] == blocks)) + 1
        prefix[new] = h - 1
        block = np.concatenate([[0], np.cumsum(border)]).astype(np.int32)
    return z, prefix


def repeated_windows(members: list[bytes], size: int, of: Alphabet = BYTES, times: list[int] | None = None, dealt: list[int] | None = None) -> list[np.ndarray]:
    """For each member, which of its windows occurs again.

    `times`: how often each member stands in the corpus; `dealt`: its shard.
    """
    step = size // of.blocks
    times, dealt = np.array(times or [1] * len(members)), dealt or [0] * len(members)
    parts, hashes = [], []
    for shard in sorted(set(dealt)):
        own = [i for i, s in enumerate(dealt) if s == shard]
        lengths = np.array([len(members[i]) // of.width for i in own])
        h = rolling(of.values(b"".join([members[i] for i in own])), step)
        ends = np.cumsum(lengths)
        at = np.arange(int(ends[-1]))
        left = np.repeat(ends, lengths) - at
        offset = at - np.repeat(ends - lengths, lengths)
        inside = np.flatnonzero(left >= step)  # blocks that end in their member
        parts.append((own, lengths, left, offset, inside))
        hashes.append(h[inside])
    every = np.concatenate(hashes)  # one alphabet for all shards
    by = np.argsort(every)
    ranks = np.empty(len(by), np.int32)
    ranks[by] = np.cumsum(np.diff(every[by], prepend=every[by[:1]]) != 0)
    shards, at = [], 0
    for own, lengths, left, offset, inside in parts:
        symbols = ranks[at : at + len(inside)]
        at += len(inside)
        place = np.full(len(left), -1, np.int32)
        place[inside] = np.arange(len(inside), dtype=np.int32)
        previous = np.where(offset[inside] >= step, place[np.maximum(inside - step, 0)], -1)
        shards.append(Shard(symbols, previous, np.flatnonzero(left[inside] < 2 * step), of.blocks))
    z, prefix = merged_borders(shards, of.blocks)
    # intervals of equal windows, and how often each occurs in all
    weight = np.empty(len(z), np.int64)
    for j, (shard, (own, lengths, _, _, inside)) in enumerate(zip(shards, parts, strict=True)):
        of_place = np.concatenate([np.repeat(times[own], lengths)[inside], np.zeros(shard.empties, np.int64)])
        weight[z == j] = of_place[shard.order]
    begin = np.flatnonzero(prefix < of.blocks)
    repeated = np.repeat(np.add.reduceat(weight, begin) > 1, np.diff(np.append(begin, len(z))))
    out: list = [None] * len(members)
    for j, (shard, (own, lengths, left, _, inside)) in enumerate(zip(shards, parts, strict=True)):
        flags = repeated[z == j]  # in the shard's own order
        real = shard.order < len(inside)
        by_place = np.zeros(len(left), bool)
        by_place[inside[shard.order[real]]] = flags[real]
        ends = np.cumsum(lengths)
        for i, n, e in zip(own, lengths.tolist(), ends.tolist(), strict=True):
            out[i] = by_place[e - n : e - size + 1]
    return out


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": a, "stop": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


RUNS = "array<struct<start: int, stop: int>>"
FOUND = f"key long, digest binary, runs {RUNS}"


def _resolve(size: int, of: Alphabet, batch: int):
    """Distinct spans sorted by key to the runs of their repeated windows."""
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))]

    def done(rows):
        flags = repeated_windows([r[4] for r in rows], size, of, [r[1] for r in rows], [r[3] for r in rows])
        found = [(r[0], r[2], runs) for r, f in zip(rows, flags, strict=True) if (runs := _runs(f))]
        return _batch(found, kinds, ["key", "digest", "runs"])

    def run(batches):
        rows, total = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if total >= batch and r[0] != rows[-1][0]:
                    yield done(rows)
                    rows, total = [], 0
                rows.append(r)
                total += len(r[4]) // of.width
        if rows:
            yield done(rows)

    return run


def _window_digests(size: int, of: Alphabet, rows: int = 50_000):
    """Every window of the distinct spans, by digest."""
    names = ["window", "n", "key", "digest", "start"]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]

    def run(batches):
        held: list = []
        for b in batches:
            for key, n, digest, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                count = len(data) // of.width - size + 1
                for i in range(count):
                    held.append((xxhash.xxh3_128_digest(data[i * of.width : (i + size) * of.width]), n, key, digest, i))
                if len(held) >= rows:
                    yield _batch(held, kinds, names)
                    held = []
        yield _batch(held, kinds, names)

    return run


def repeated(docs: DataFrame, searches: list[tuple[int, Alphabet]], limit: int = 1 << 22, batch: int = 60_000) -> list[DataFrame]:
    """For each (size, alphabet): doc_id, thash, runs (start, stop) of the repeated windows of the rows (doc_id, thash, text)."""
    found, members, singles = [], [], []
    for i, (size, of) in enumerate(searches):
        if size % of.blocks or size < 2 * of.gram:
            raise ValueError(f"the length must be a multiple of {of.blocks}, and at least {2 * of.gram}")
        all_spans = stored(mapped(docs, _spans(size, of), SPANS), "spans")
        keys = all_spans.groupBy("key").agg(F.count("*").alias("total"), F.max("twice").alias("any_twice")).where("total > 1 OR any_twice")
        shared = stored(all_spans.join(keys.select("key"), "key"), "shared-spans")
        discard(all_spans)
        distinct = shared.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "thash", "start", "windows", "twice")).alias("m"))
        distinct = stored(distinct.select("key", "digest", "n", "m.*"), "distinct-spans")
        sizes = distinct.groupBy("key").agg(F.sum((F.col("windows") + F.lit(size - 1)).cast("long")).alias("symbols"), (F.max("twice") | (F.count("*") > 1)).alias("several"))
        members.append(distinct.join(sizes.where("several").select("key", (F.col("symbols") > limit).alias("hot")), "key").withColumn("search", F.lit(i)))
        alone = distinct.join(sizes.where("NOT several").select("key"), "key").where("n > 1")
        singles.append(stored(alone.select("key", "digest", F.array(F.struct(F.lit(0).alias("start"), F.col("windows").alias("stop"))).alias("runs")), "single-spans"))
        found.append((shared, distinct))
    # a text moves once for all searches; what it lends is bounded by it
    by_doc = reduce(DataFrame.unionByName, members).groupBy("doc_id", "thash").agg(F.collect_list(F.struct("search", "key", "hot", "n", "digest", "start", "windows")).alias("members"))
    lent = docs.join(by_doc, ["doc_id", "thash"]).dropDuplicates(["doc_id", "thash"]).select("doc_id", "thash", "text", "members")
    data = stored(mapped(lent, _cut(searches), MEMBERS), "members")
    out = []
    for i, ((size, of), (shared, distinct)) in enumerate(zip(searches, found, strict=True)):
        discard(distinct)
        own = data.where(F.col("search") == i)
        cold = own.where("NOT hot").select("key", "n", "digest", "shard", "data").repartition("key").sortWithinPartitions("key", "shard")
        met = mapped(cold, _resolve(size, of, batch), FOUND)
        windows = mapped(own.where("hot").select("key", "n", "digest", "data"), _window_digests(size, of), "window binary, n long, key long, digest binary, start int")
        again = windows.groupBy("window").agg(F.sum("n").alias("total")).where("total > 1").select("window")
        counted = windows.join(again, "window").groupBy("key", "digest").agg(F.collect_list(F.struct("start", (F.col("start") + 1).alias("stop"))).alias("runs"))
        runs = met.unionByName(counted.select("key", "digest", F.col("runs").cast(RUNS))).unionByName(singles[i].select("key", "digest", F.col("runs").cast(RUNS)))
        placed = shared.join(runs, ["key", "digest"]).select("doc_id", "thash", F.transform("runs", lambda r: F.struct((r.start + F.col("start")).alias("start"), (r.stop + F.col("start")).alias("stop"))).alias("runs"))
        out.append(placed.groupBy("doc_id", "thash").agg(F.flatten(F.collect_set("runs")).alias("runs")))  # a set: rows with one id and text say the same
    return out


def _united(gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the intervals cover."""
    out: list[list[int]] = []
    for start, stop in sorted(gone):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _without(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for g in gone for x in g], len(raw)]
    return b"".join([raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)])


def _keep(size: int, as_text: bool, passage: int):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()]

    def run(batches):
        for b in batches:
            rows = []
            at = b.num_columns - 3
            for text, runs, said in zip(b.column(at), b.column(at + 1), b.column(at + 2), strict=True):
                raw = raw_bytes(text.as_py())
                gone = _united([(r["start"], r["stop"] + size - 1) for r in runs.as_py() or []])
                passages = said.as_py() or []
                places = word_places(raw) if passages else []
                both = _united(gone + [(places[r["start"]][0], places[r["stop"] + passage - 2][1]) for r in passages])
                left = _without(raw, both if as_text else gone)
                rows.append((len(raw), sum(y - x for x, y in gone), len(gone), sum(y - x for x, y in both), left.decode("utf-8", "ignore") if as_text else left))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], *_batch(rows, kinds, RESULT).columns], [*b.schema.names[:at], *RESULT])

    return run


RESULT = ["n_bytes", "n_removed", "n_spans", "n_passage_bytes", "kept"]


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = 400, limit: int = 1 << 22, as_text: bool = False, passage: int = 0) -> DataFrame:
    """All columns of `docs` but the text, then n_bytes, n_removed, n_spans, n_passage_bytes and kept.

    n_removed and n_spans tell of the strings of `size` bytes, which are cut out of `kept` (binary).
    With `passage`, strings of that many words that occur again are looked for as well, whatever
    their bytes; n_passage_bytes counts the bytes that either covers. With `as_text`, `kept` is a
    string without either, and without the characters that an edge cuts in half.
    """
    keep = [c for c in docs.columns if c not in (text, *RESULT)]
    ids, thash = F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(ids.alias("doc_id"), thash.alias("thash"), F.col(text).alias("text"))
    runs, *said = repeated(rows, [(size, BYTES), *([(passage, WORDS)] if passage else [])], limit)
    if said:
        runs = runs.join(said[0].withColumnRenamed("runs", "said"), ["doc_id", "thash"], "full")
    else:
        runs = runs.withColumn("said", F.lit(None).cast(RUNS))
    whole = docs.select(F.struct(*keep).alias("row"), ids.alias("doc_id"), thash.alias("thash"), F.col(text).alias("text"))
    inner = max([*keep, ""], key=len)  # a name that no column has, with the suffixes below
    last = [F.col(c).alias(f"{inner}_{c}") for c in ("text", "runs", "said")]
    joined = whole.join(runs, ["doc_id", "thash"], "left").select(*[F.col("row").getField(c).alias(c) for c in keep], *last)
    made = [*(StructField(n, LongType()) for n in RESULT[:-1]), StructField("kept", StringType() if as_text else BinaryType())]
    return mapped(joined, _keep(size, as_text, passage), StructType([*(docs.schema[c] for c in keep), *made]))
