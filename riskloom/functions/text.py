"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lines_of_code(text: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")).cast("long")


def comment_lines(text: Column) -> Column:
    """Lines of `//` comments and of `/* */` blocks, by a fold over the lines with the block state.

    A block that closes on its own line leaves the state closed; what follows a close is comment.
    """
    state = F.struct(F.lit(0).cast("long").alias("n"), F.lit(False).alias("inside"))

    def step(s, line):
        t = F.trim(line)
        opens = t.startswith("/*") & ~s.inside
        closes = F.contains(t, F.lit("*/"))
        counted = s.inside | opens | t.startswith("//")
        inside = F.when(s.inside | opens, ~closes).otherwise(F.lit(False))
        return F.struct((s.n + counted.cast("long")).alias("n"), inside.alias("inside"))

    return F.aggregate(F.split(text, "\n"), state, step, lambda s: s.n)


def version_range(text: Column) -> dict[str, Column]:
    """Operator and numbers of a pragma: op is '^', '>=', 'exact' or null; a missing patch is 0."""
    p = r"pragma\s+solidity\s+(\^|>=)?\s*(\d+)\.(\d+)(?:\.(\d+))?(?:\s*<\s*(\d+)\.(\d+)\.(\d+))?"
    got = lambda i: F.nullif(F.regexp_extract(text, p, i), F.lit(""))
    return {
        "op": F.when(got(2).isNotNull(), F.coalesce(got(1), F.lit("exact"))),
        "major": got(2).cast("int"), "minor": got(3).cast("int"), "patch": F.when(got(2).isNotNull(), F.coalesce(got(4).cast("int"), F.lit(0))),
        "below": F.when(got(5).isNotNull(), F.concat_ws(".", got(5), got(6), got(7))),
    }


# Error codes and the words that name them, the first match counts.
ERROR_WORDS = [
    ("FILE_NOT_FOUND", ['" is not found', "source file not found", "no such file", "cannot open"]),
    ("IMPORT_ERROR", ["@openzeppelin", "@chainlink", "node_modules", "hardhat/console", "file import callback not supported", "import"]),
    ("VERSION_MISMATCH", [
        "requires different compiler", "source file requires different", "version mismatch", "does not satisfy the version pragma", "solidityversion",
        "solc-select", "error: no matching version", "incompatible solc version", "requires solc version",
    ]),
    ("SLITHER_INCOMPATIBLE", ["invalid option to --combined-json", "unrecognised option", "unknown option", "unsupported solc", "slither error"]),
    ("ANALYSIS_ERROR", []),
    ("COMPILATION_ERROR", ["compilation", "syntax error", "parsererror", "declarationerror", "typeerror", "undeclaredidentifier"]),
]
ANALYSIS_KINDS = ["AttributeError", "KeyError", "IndexError", "NoneType"]  # Fixed values: kinds of error that analysis raises


def error_category(message: Column, kind: Column | None = None) -> Column:
    """Ordered keyword lists, and the error's kind in its place among them; UNKNOWN_ERROR if none fits or the message is null."""
    low, kind = F.lower(message), F.lit(None).cast("string") if kind is None else kind
    out = F.when(F.lit(False), "")
    for code, keys in ERROR_WORDS:
        hit = kind.isin(ANALYSIS_KINDS) if code == "ANALYSIS_ERROR" else F.lit(False)
        for k in keys:
            hit = hit | F.contains(low, F.lit(k))
        out = out.when(hit, code)
    return out.otherwise("UNKNOWN_ERROR")


def bands(x: Column, cuts: list[tuple[float, str]], below: str) -> Column:
    """The name of the first cut at or below x, cuts descending."""
    out = F.when(F.lit(False), "")
    for least, name in cuts:
        out = out.when(x >= least, name)
    return out.otherwise(below)


def canonical_digest(names: list[str]) -> Column:
    """sha256 of the named columns as a JSON object in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)


def address_from_path(path: Column) -> Column:
    """`_0x` and hex digits of a path, padded with zeros to 42 characters."""
    hit = F.regexp_extract(path, r"_(0x[0-9a-fA-F]+)", 1)
    return F.when(hit != "", F.rpad(F.left(hit, F.lit(42)), 42, "0"))


def valid_address(a: Column) -> Column:
    return F.coalesce(a.rlike("^0x[0-9a-fA-F]{40}$"), F.lit(False))
