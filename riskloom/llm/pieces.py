"""SentencePiece-style encoding and decoding by a merge-type prefix table.

For every prefix of a unit (blanks and the word after them, which no piece reaches across) the
table holds the one token that ends the prefix's encoding: of the pieces that an automaton finds
ending there, the one that is compatible with the last token of the prefix before it. Two tokens
are compatible if undoing their merges from the latest back never shows a pair that would have
merged across them first. The ids are then read off backwards.

Null text counts as empty: only the end id. Characters outside the vocabulary become byte pieces.
Repeated rows are encoded one by one; texts of any length are encoded whole.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
UNIT = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


@dataclass
class Table:
    """The vocabulary: pieces by id, ranks, the two halves of each piece's last merge, the automaton."""

    ids: dict[str, int]
    rank: list[float]
    text: list[str]
    halves: list[tuple[int, int] | None]
    byte_ids: list[int]
    raw: list[bytes]  # what each id decodes to
    is_byte: list[bool]
    end_id: int
    inner: set[str]  # neighbouring characters of some piece: no merge joins any others
    automaton: ahocorasick.Automaton

    @classmethod
    def load(cls, path: str) -> Table:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        plain = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)]
        ids = {t: i for i, t in enumerate(text) if plain[i]}
        rank = [-1.0 if len(t) == 1 else -sp.get_score(i) for i, t in enumerate(text)]
        byte_ids = [0] * 256
        raw = []
        for i, t in enumerate(text):
            if sp.is_byte(i):
                byte_ids[int(t[3:5], 16)] = i
                raw.append(bytes([int(t[3:5], 16)]))
            else:
                raw.append(t.replace(BLANK, " ").encode() if plain[i] else " ⁇ ".encode() if sp.is_unknown(i) else b"")
        halves: list[tuple[int, int] | None] = [None] * n
        automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            if len(t) > 1:
                last = _last_merge(t, ids, rank)
                if last is None:
                    continue  # merging never makes it
                halves[i] = last
            automaton.add_word(t, (len(t), i))
        automaton.make_automaton()
        return cls(ids, rank, text, halves, byte_ids, raw, [sp.is_byte(i) for i in range(n)], sp.eos_id(), {t[i : i + 2] for t in ids for i in range(len(t) - 1)}, automaton)


def _last_merge(piece: str, ids: dict[str, int], rank: list[float]) -> tuple[int, int] | None:
    """The two tokens that the piece's own encoding joins last; None if its encoding is something else."""
    parts = list(piece)
    while len(parts) > 1:
        made = [(rank[ids[a + b]], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ids]
        if not made:
            return None
        _, i = min(made)
        if len(parts) == 2:
            a, b = parts
            return (ids[a], ids[b]) if a in ids and b in ids else None
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return None


class Encoder:
    """Encodes units by the prefix table; keeps what it found for short ones, up to a bound."""

    def __init__(self, table: Table, remember: int = 500_000, pairs: int = 1_000_000):
        self.t, self.remember, self.pair_limit = table, remember, pairs
        self.units: dict[str, tuple[tuple[int, ...], bytes]] = {}
        self.parts: dict[str, tuple[tuple[int, ...], bytes]] = {}
        self.pairs: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= self.pair_limit:
                self.pairs.clear()
            found = self.pairs[key] = self._compatible(a, b)
        return found

    def _compatible(self, a: int, b: int) -> bool:
        t, limit = self.t, float("inf")
        while True:
            joined = t.ids.get(t.text[a] + t.text[b])
            if joined is not None and t.rank[joined] < limit:
                return False
            ra, rb = t.rank[a], t.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, t.halves[a][1]
            else:  # of equal merges the left one comes first, so one across comes before b's own
                limit, b = rb + 0.5, t.halves[b][0]

    def known(self, unit: str) -> list[int]:
        """Ids of a string of known characters."""
        n = len(unit)
        last = [-1] * (n + 1)
        compatible = self.compatible
        for end, (size, token) in self.t.automaton.iter(unit):
            at = end + 1 - size
            if last[end + 1] < 0 and (at == 0 or (last[at] >= 0 and compatible(last[at], token))):
                last[end + 1] = token
        out = []
        while n:
            token = last[n]
            out.append(token)
            n -= len(self.t.text[token])
        return out[::-1]

    def part(self, part: str) -> tuple[tuple[int, ...], bytes]:
        """Ids and decimals of characters that follow each other in some piece, pair by pair."""
        found = self.parts.get(part)
        if found is None:
            if part in self.t.ids or len(part) > 1:
                ids = self.known(part)
            else:
                ids = [self.t.byte_ids[b] for b in part.encode("utf-8", "surrogatepass")]
            found = tuple(ids), b" ".join([b"%d" % x for x in ids])
            if len(part) <= 48:
                if len(self.parts) >= self.remember:
                    self.parts.clear()
                self.parts[part] = found
        return found

    def unit(self, unit: str) -> tuple[tuple[int, ...], bytes]:
        inner, begin, parts = self.t.inner, 0, []
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in inner:
                parts.append(self.part(unit[begin:i]))
                begin = i
        if not parts:
            return self.part(unit)
        parts.append(self.part(unit[begin:]))
        return tuple([x for p in parts for x in p[0]]), b" ".join([p[1] for p in parts])

    def encode(self, text: str | None) -> tuple[list[int], bytes]:
        """All ids with the end id, and their decimals joined by a blank."""
        if not text:
            return [self.t.end_id], b"%d" % self.t.end_id
        whole = (BLANK + text).replace(" ", BLANK)
        if BLANK + BLANK in whole:
            units = UNIT.findall(whole)
        else:  # each blank begins a unit
            units = [BLANK + x for x in whole[1:].split(BLANK)]
        get = self.units.get
        found = [get(u) for u in units]
        if None in found:
            for i, f in enumerate(found):
                if f is None:
                    u = units[i]
                    if (f := get(u)) is None:
                        f = self.unit(u)
                        if len(u) <= 48:
                            if len(self.units) >= self.remember:
                                self.units.clear()
                            self.units[u] = f
                    found[i] = f
        ids = [x for f in found for x in f[0]]
        ids.append(self.t.end_id)
        return ids, b" ".join([*(f[1] for f in found), b"%d" % self.t.end_id])


def decode(table: Table, ids: list[int]) -> str:
    """The text of ids: one leading blank goes, bytes that aren't UTF-8 become U+FFFD each."""
    raw = table.raw
    joined = b"".join([raw[i] for i in ids])
    lead = next((i for i in ids if raw[i] or table.is_byte[i]), None)
    if lead is not None and table.text[lead].startswith(BLANK):
        joined = joined[1:]
    try:
        return joined.decode("utf-8")
    except UnicodeDecodeError:
        return joined.decode("utf-8", "fffd_each")


codecs.register_error("fffd_each", lambda error: ("\ufffd", error.start + 1))

_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(Table.load(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All columns but the text, then ids array<int> with the end id. `path`: the model file, on every executor."""

    def run(batches):
        e = _encoder(path)
        for b in batches:
            ids = [e.encode(x.as_py())[0] for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.list_(pa.int32()))], [*b.schema.names[:-1], "ids"])

    keep = [c for c in docs.columns if c not in (text, "ids")]
    schema = docs.select(*keep, F.lit(None).cast("array<int>").alias("ids")).schema
    return docs.select(*keep, text).mapInArrow(run, schema)


def decoded(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """All columns but the ids, then text; null ids give null."""

    def run(batches):
        t = _encoder(path).t
        for b in batches:
            texts = [None if (v := x.as_py()) is None else decode(t, v) for x in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string())], [*b.schema.names[:-1], "text"])

    keep = [c for c in encoded.columns if c not in (ids, "text")]
    schema = encoded.select(*keep, F.lit(None).cast("string").alias("text")).schema
    return encoded.select(*keep, ids).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a round trip of each text, ids never leave the task."""

    def run(batches):
        e = _encoder(path)
        for b in batches:
            n, coded, back = [], [], []
            for x in b.column(1):
                ids, decimals = e.encode(x.as_py())
                n.append(len(ids))
                coded.append(hashlib.sha256(decimals).hexdigest())
                back.append(hashlib.sha256(decode(e.t, ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
