"""Token ids in wavelet-matrix shard files.

A shard holds the ids of whole documents in ascending document order as one bit plane for each
bit of an id, most significant first; below each plane the zeros come before the ones, stably.
The file keeps each plane's number of zeros and its running counts every 512 bits (the rank
directory), so that access(i), rank(id, i) (counting) and select(id, j) (occurrence lookup) read
only a few words of each plane. A shard is one compressed blob in one file, written by Spark's
committer into the shared folder, so a lost executor's task is simply run again.

Texts are dealt out by ranges of doc_id and sorted within; one task encodes a range and cuts it
into shards of about `shard_tokens` ids at document borders; a longer document is a shard of its
own. Null text counts as empty: only the end id. Rows with one id keep an order of their own (by
text); a null id stands as the smallest number in the files and comes back as null. An empty table
gives no shards and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import partitions_for, stored

MAGIC = b"WMS2"
HEAD = "<4sQIIII"
BLOCK = 512  # bits between running counts
NO_ID = -(1 << 63)


class WaveletMatrix:
    """Succinct sequence of unsigned ids: bit planes and their rank directory."""

    def __init__(self, n: int, planes: np.ndarray, zeros: np.ndarray, counts: np.ndarray | None = None):
        self.n, self.planes, self.zeros = n, planes, zeros  # planes: bits x ceil(n / 8) bytes
        if counts is None:
            per = BLOCK // 8
            ones = np.bitwise_count(np.pad(planes, ((0, 0), (0, -planes.shape[1] % per)))).reshape(len(planes), -1, per).sum(axis=2, dtype=np.uint32)
            counts = np.concatenate([np.zeros((len(planes), 1), np.uint32), np.cumsum(ones, axis=1, dtype=np.uint32)], axis=1)
        self.counts = counts

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros = [], []
        for b in range(bits - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << b)).astype(bool)
            low, high = np.flatnonzero(~one), np.flatnonzero(one)  # places: numpy finds them without a branch, unlike masked items
            planes.append(np.packbits(one))
            zeros.append(len(low))
            ids = np.concatenate([ids.take(low), ids.take(high)])
        return cls(len(ids), np.stack(planes) if planes else np.zeros((0, 0), np.uint8), np.array(zeros, np.int64))

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first at[j] bits of a plane, for all j."""
        block = at // BLOCK
        plane = self.planes[level]
        span = block[:, None] * (BLOCK // 8) + np.arange(BLOCK // 8)
        inside = np.bitwise_count(plane[np.minimum(span, max(len(plane) - 1, 0))]) * (span < (at // 8)[:, None]) if len(plane) else np.zeros(span.shape, np.int64)
        last = plane[np.minimum(at // 8, len(plane) - 1)] >> (8 - at % 8).astype(np.uint8) if len(plane) else np.zeros(len(at), np.uint8)
        return self.counts[level, block].astype(np.int64) + inside.sum(axis=1, dtype=np.int64) + np.where(at % 8 > 0, np.bitwise_count(last), 0)

    def access(self, i: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            one = self.planes[level, i // 8] >> (7 - i % 8) & 1
            ones = int(self._ones(level, np.array([i]))[0])
            value = value << 1 | int(one)
            i = int(self.zeros[level]) + ones if one else i - ones
        return value

    def ranks(self, value: int, at: np.ndarray) -> np.ndarray:
        """How often `value` occurs among the first at[j] ids, for all j."""
        bits = len(self.planes)
        both = np.concatenate([np.zeros(1, np.int64), at])
        for level in range(bits):
            ones = self._ones(level, both)
            both = int(self.zeros[level]) + ones if value >> (bits - 1 - level) & 1 else both - ones
        return both[1:] - both[0]

    def rank(self, value: int, i: int) -> int:
        return int(self.ranks(value, np.array([i]))[0])

    def select(self, value: int, j: int) -> int:
        """Position of occurrence j (from 0), or -1."""
        if j < 0 or j >= self.rank(value, self.n):
            return -1
        low, high = 0, self.n  # the smallest prefix with j + 1 occurrences
        while low < high:
            mid = (low + high) // 2
            if self.rank(value, mid) <= j:
                low = mid + 1
            else:
                high = mid
        return low - 1

    def all(self) -> np.ndarray:
        """Every id, plane by plane from the lowest up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for level in range(bits - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(bool)
            zeros = int(self.zeros[level])
            above = np.empty(self.n, kind)
            above[np.flatnonzero(~one)] = value[:zeros]
            above[np.flatnonzero(one)] = value[zeros:] | kind(1 << (bits - 1 - level))
            value = above
        return value

    def to_bytes(self, extra: bytes = b"") -> bytes:
        body = zstandard.ZstdCompressor(level=1).compress(self.planes.tobytes())
        directory = self.counts.astype("<u4").tobytes()
        head = struct.pack(HEAD, MAGIC, self.n, len(self.planes), len(extra), len(body), self.counts.shape[1])
        return head + self.zeros.astype("<i8").tobytes() + directory + extra + body

    @classmethod
    def from_bytes(cls, blob: bytes) -> tuple[WaveletMatrix, bytes]:
        magic, n, bits, n_extra, n_body, blocks = struct.unpack_from(HEAD, blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at = struct.calcsize(HEAD)
        zeros = np.frombuffer(blob, "<i8", bits, at).astype(np.int64)
        at += 8 * bits
        counts = np.frombuffer(blob, "<u4", bits * blocks, at).reshape(bits, blocks)
        at += 4 * bits * blocks
        extra = blob[at : at + n_extra]
        body = zstandard.ZstdDecompressor().decompress(blob[at + n_extra : at + n_extra + n_body], max_output_size=max(1, bits * -(-n // 8)))
        return cls(n, np.frombuffer(body, np.uint8).reshape(bits, -(-n // 8)), zeros, counts), extra


BLANK_RUN = re.compile(r" \s")
START = re.compile(r" (?=\S)")
# Fixed value: the pre-token pattern of byte-level BPE vocabularies, as their files name it by "use_regex".
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CLOSING = frozenset(".,;:!?)")


class Recent:
    """A bounded memory of two generations: when the newer is full it becomes the older.

    What is asked for again moves to the newer one, so common keys stay and rare ones go.
    """

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def put(self, key: str, value: bytes) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def get(self, key: str) -> bytes | None:
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value


class UnitEncoder:
    """The tokenizers library's ids of whole texts, its model asked once for each recent pre-token.

    A blank before a character that isn't white space always begins a new pre-token, so texts are
    cut there first; Arrow finds the distinct units of some texts, and only those not seen lately
    are cut by the library's pattern. Texts with an added token of the vocabulary go to the library
    whole.
    """

    def __init__(self, path: str, units: int = 400_000, slice_bytes: int = 12 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.added = [x["content"] for x in json.load(f)["added_tokens"]]
        self.bits = max(1, (max(self.t.get_vocab_size(with_added_tokens=True), 2) - 1).bit_length())
        self.kind = np.uint16 if self.bits <= 16 else np.uint32
        self.code = "H" if self.bits <= 16 else "I"
        self.tokenize = self.t.model.tokenize
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        others = iter(range(256, 512))  # byte-level models see a byte as a character, the others moved up in order
        self.shown = {b: b if b in plain else next(others) for b in range(256)}
        self.blank = chr(self.shown[32])
        self.units, self.parts, self.slice_bytes = Recent(units), Recent(units // 5), slice_bytes  # units by what follows their blank

    def _part(self, part: str) -> bytes:
        """Ids of one pre-token."""
        if part[0] == " " and part[1:].isalpha():
            return self._unit(part[1:])
        found = self.parts.get(part)
        if found is None:
            found = array(self.code, [x.id for x in self.tokenize(part.encode("utf-8").decode("latin-1").translate(self.shown))]).tobytes()
            if len(part) <= 40:
                self.parts.put(part, found)
        return found

    def _cut(self, text: str) -> bytes:
        if text.isprintable() or text.replace("\n", "").isprintable():  # as to white space, the pattern and the library may differ in control characters only
            return b"".join([self._part(x) for x in PATTERN.findall(text)])
        return b"".join([self._part(text[a:b]) for _, (a, b) in self.t.pre_tokenizer.pre_tokenize_str(text)])

    def _unit(self, unit: str) -> bytes:
        """Ids of a blank and this unit."""
        return self.units.new.get(unit) or self._older(unit)

    def _older(self, unit: str) -> bytes:
        """The same of a unit that isn't in the newer generation."""
        found = self.units.old.get(unit)
        if found is None:
            if unit.isalpha():  # one pre-token
                shown = self.blank + unit if unit.isascii() else (" " + unit).encode("utf-8").decode("latin-1").translate(self.shown)
                found = array(self.code, [x.id for x in self.tokenize(shown)]).tobytes()
            elif unit[-1:] in CLOSING and unit[:-1].isalpha():
                found = self._unit(unit[:-1]) + self._part(unit[-1])
            else:
                found = self._cut(" " + unit)
        if len(unit) <= 40:
            if len(self.units.new) < self.units.size:
                self.units.new[unit] = found
            else:
                self.units.put(unit, found)
        return found

    def _slice(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without added tokens, each with its end id, and how many each has."""
        odd = {i: START.split(t) for i, t in enumerate(texts) if t[-1:] == " " or BLANK_RUN.search(t)}
        lists = pc.split_pattern(pa.array([None if i in odd else t for i, t in enumerate(texts)], pa.large_string()), " ")
        if odd:
            lists = pa.array([odd.get(i, x) for i, x in enumerate(lists.to_pylist())], pa.large_list(pa.large_string()))
        offsets = lists.offsets.to_numpy()
        named = lists.flatten().dictionary_encode()
        units = named.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist makes a scalar of each
        first = [self._cut(u) if u else b"" for u in (t[: len(odd[i][0])] if i in odd else t.partition(" ")[0] for i, t in enumerate(texts))]  # follows no blank
        known = [x or self._older(u) for x, u in zip(list(map(self.units.new.get, units)), units, strict=True)]
        known += [*first, self.kind(0).tobytes()]
        codes = named.indices.to_numpy().copy()  # int32: Arrow's dictionaries have no more
        codes[offsets[:-1] - offsets[0]] = len(units) + np.arange(len(texts))
        codes = np.insert(codes, offsets[1:] - offsets[0], len(known) - 1)
        # Arrow lays the ids of all codes end to end, and its offsets say where each ends
        laid = pa.array(known, pa.large_binary()).take(pa.array(codes))
        ends = np.frombuffer(laid.buffers()[1], np.int64, len(codes) + 1)[1:] // self.kind(0).nbytes
        ids = np.frombuffer(laid.buffers()[2], self.kind, int(ends[-1]))
        return ids, np.diff(ends[offsets[1:] - offsets[0] + np.arange(len(texts))], prepend=0)

    def encoded(self, texts: list[str | None]):
        """(ids of whole texts, each with its end id, and their sizes), slice by slice."""
        held: list[str] = []
        total = 0
        for t in texts:
            t = t or ""
            if any(a in t for a in self.added):
                if held:
                    yield self._slice(held)
                    held, total = [], 0
                ids = np.array([*self.t.encode(t, add_special_tokens=False).ids, 0], self.kind)
                yield ids, np.array([len(ids)])
                continue
            held.append(t)
            total += len(t)
            if total >= self.slice_bytes:
                yield self._slice(held)
                held, total = [], 0
        if held:
            yield self._slice(held)


_ENCODERS: dict[str, UnitEncoder] = {}


def _encoder(path: str) -> UnitEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


SHARD = "bucket int, shard int, first_doc long, n_docs long, n_tokens long, data binary"


def _write(path: str, shard_tokens: int):
    """Sorted rows of (doc_id, text), a range of ids, to shards of whole documents."""

    def run(batches):
        e = _encoder(path)
        bucket = TaskContext.get().partitionId()
        shard, docs, sizes, ids, total = 0, [], [], [], 0

        def out():
            values = np.concatenate(ids)
            extra = np.array(docs, "<i8").tobytes() + np.array(sizes, "<i8").tobytes()
            blob = WaveletMatrix.build(values, e.bits).to_bytes(extra)
            columns = zip(SHARD.split(", "), (bucket, shard, docs[0], len(docs), len(values), blob), strict=True)
            kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[c.split()[1]]) for c, v in columns], [c.split()[0] for c in SHARD.split(", ")])

        for b in batches:
            names = iter(b.column(0).to_pylist())
            for coded, counted in e.encoded(b.column(1).to_pylist()):
                at = 0
                for n in counted.tolist():
                    if docs and total + n > shard_tokens:
                        yield out()
                        shard, docs, sizes, ids, total = shard + 1, [], [], [], 0
                    docs.append(next(names))
                    sizes.append(n)
                    ids.append(coded[at : at + n])
                    total += n
                    at += n
        if docs:
            yield out()

    return run


def write_shards(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", shard_tokens: int = 1 << 16, ranges: int | None = None) -> DataFrame:
    """Encodes every text and writes the shard files; returns the table of shards that they hold.

    A task has one range of ids, so `bucket`, its number, ascends with the ids. `ranges`: how many,
    by default one for every 16 MB of the table.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(ranges or partitions_for(docs, 16), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(dealt.mapInArrow(_write(path, shard_tokens), SHARD), "wavelet-shards")


def _read(batches):
    names = ["bucket", "shard", "pos", "doc_id", "n_tokens", "ids_crc32", "n_ends"]
    for b in batches:
        for bucket, shard, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            matrix, extra = WaveletMatrix.from_bytes(blob)
            n = len(extra) // 16
            docs, sizes = np.frombuffer(extra, "<i8", n), np.frombuffer(extra, "<i8", n, 8 * n)
            ids = matrix.all().astype("<u4")
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(ids[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            marks = np.diff(matrix.ranks(0, ends), prepend=0)
            yield pa.RecordBatch.from_arrays([pa.array([bucket] * n, pa.int32()), pa.array([shard] * n, pa.int32()), pa.array(ends - sizes), pa.array(docs), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(marks)], names)


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_ends of every document, from the shard files alone.

    Starts: a running sum over shards within each bucket, and over the buckets' totals. n_ends: how
    often the end id occurs in the document, by rank.
    """
    within = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shard_start = shards.select("bucket", "shard", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("before"))
    totals = sorted((r.bucket, r.n) for r in shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n")).collect())
    spark, base, rows = shards.sparkSession, 0, []
    for bucket, n in totals:  # one row for each range of ids
        rows.append((bucket, base))
        base += n
    bases = spark.createDataFrame(rows, "bucket int, base long")
    docs = shards.select("bucket", "shard", "data").mapInArrow(_read, "bucket int, shard int, pos long, doc_id long, n_tokens long, ids_crc32 long, n_ends long")
    return (
        docs.join(shard_start, ["bucket", "shard"])
        .join(bases, "bucket")
        .select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("base") + F.col("before") + F.col("pos")).alias("start"), "n_tokens", "ids_crc32", "n_ends")
    )


def _look(value: int):
    def run(batches):
        for b in batches:
            for bucket, shard, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                matrix, _ = WaveletMatrix.from_bytes(blob)
                n = matrix.rank(value, matrix.n)
                first = matrix.select(value, 0)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([first], pa.int64())], ["bucket", "shard", "n", "first"])

    return run


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """bucket, shard, n, first: how often each shard holds a token, and where first (-1: nowhere)."""
    return shards.select("bucket", "shard", "data").mapInArrow(_look(token), "bucket int, shard int, n long, first long")
