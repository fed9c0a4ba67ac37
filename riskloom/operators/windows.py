"""Windows anchored at events: folds over each key's ordered times.

A window opens at the first event that no open window covers, so each start depends on the one
before; no fixed window expresses that. Times are sorted by ranges of key and time, so a key may lie in
any number of tasks. A task folds each key's run of times, a step for each window. Keys with one run are
done with that. For the others, a run becomes a function of the window that is open when it begins: which
event opens the next one, how many windows follow and what is open at the end. Only events up to a span
from the run's first can be such an opening event, so the function is a table of those. Functions of
neighbouring runs are composed pairwise, in as many rounds as the logarithm of the number of runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from riskloom.operators.rounds import kept

LISTS = ["at", "before", "windows", "over", "open", "used"]  # of a run's table: opening event, events before it, and what follows from it


class Anchor:
    """The open window of one key, fed with ascending times: it looks for each window's end, not at each event."""

    def __init__(self, span: int, most: int):
        self.span, self.most = span, most
        self.open, self.used, self.n, self.over, self.windows = None, 0, 0, 0, 0

    def add(self, times: np.ndarray) -> None:
        at, n = 0, len(times)
        self.n += n
        while at < n:
            if self.open is None or times[at] >= self.open + self.span:
                self.open, self.used, self.windows = int(times[at]), 0, self.windows + 1
            end = at + int(np.searchsorted(times[at:], self.open + self.span))
            self.over += max(0, self.used + end - at - max(self.most, self.used))
            self.used, at = self.used + end - at, end


def run_table(times: np.ndarray, span: int, most: int, begins: bool) -> dict[str, np.ndarray]:
    """LISTS of a run: for each event that may open its first window, the windows, the events over the limit in those that end in the run, and
    the last one's start and events. `begins`: the key's first run, which its first event opens."""
    m = len(times)
    follows = np.searchsorted(times, times + span).tolist()
    windows, over, last = [1] * m, [0] * m, list(range(m))
    for i in range(m - 1, -1, -1):
        if (j := follows[i]) < m:
            windows[i], over[i], last[i] = windows[j] + 1, over[j] + max(0, j - i - most), last[j]
    n = 1 if begins else min(m, int(np.searchsorted(times, times[0] + span)) + 1)
    ends = np.array(last[:n])
    return {"at": times[:n], "before": np.arange(n), "windows": np.array(windows[:n]), "over": np.array(over[:n]), "open": times[ends], "used": m - ends}


def composed(a: dict, b: dict, span: int, most: int) -> dict:
    """The table of two neighbouring runs as one, from theirs (LISTS, n, first, last)."""
    ask = a["open"] + span
    through = ask > b["last"]  # the open window covers all of b
    i = np.minimum(np.searchsorted(b["at"], ask), len(b["at"]) - 1)
    pick = lambda x: b[x][i]
    closed = np.maximum(0, a["used"] + pick("before") - most)
    out = {
        "at": a["at"], "before": a["before"], "windows": a["windows"] + np.where(through, 0, pick("windows")), "over": a["over"] + np.where(through, 0, closed + pick("over")),
        "open": np.where(through, a["open"], pick("open")), "used": np.where(through, a["used"] + b["n"], pick("used")),
    }
    if not a["begins"] and a["last"] < a["first"] + span:  # events of b may open the first window, too
        more = min(len(b["at"]), int(np.searchsorted(b["at"], a["first"] + span)) + 1)
        out = {k: np.concatenate([v, b[k][:more] + (a["n"] if k == "before" else 0)]) for k, v in out.items()}
    return out | {"n": a["n"] + b["n"], "first": a["first"], "last": b["last"], "begins": a["begins"]}


def anchored(events: DataFrame, key: list[str], ts: Column, seconds: int, most: int, free: Column | None = None) -> DataFrame:
    """key, n, over_limit, windows of events by key: `over_limit` events came after the window's first `most`.

    Events for which `free` holds (private addresses, paths that aren't limited) take no part. Events
    without a time don't either. Null keys are keys.
    """
    counted = events if free is None else events.where(~F.coalesce(free, F.lit(False)))
    rows = counted.select(*key, F.unix_micros(ts.cast("timestamp")).alias("_t")).where("_t IS NOT NULL")
    span, plain = seconds * 1_000_000, [events.schema[k] for k in key]
    long = lambda *names: [StructField(n, LongType()) for n in names]
    lists = lambda *names: [StructField(n, ArrayType(LongType())) for n in names]

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, now, state, held = TaskContext.get().partitionId(), True, None, None, []

        def done(edge: bool) -> tuple:
            times = np.concatenate(held)
            return (*now, part, state.n, int(times[0]), int(times[-1]), state.over, state.windows, times if edge else None)

        names = [*key, "part", "n", "first", "last", "over", "windows", "times"]
        for pdf in batches:
            out, times, own = [], pdf["_t"].to_numpy(), pdf[key]
            begins = np.flatnonzero((own != own.shift()).any(axis=1).to_numpy())
            for a, b in zip(begins, [*begins[1:], len(pdf)], strict=True):
                k = [None if x != x else x for x in own.iloc[a].tolist()]
                if k != now:
                    if now is not None:
                        out.append(done(first))
                        first = False
                    now, state, held = k, Anchor(span, most), []
                state.add(times[a:b])
                held.append(times[a:b])
            yield pd.DataFrame(out, columns=names)
        if now is not None:
            yield pd.DataFrame([done(True)], columns=names)  # only a task's first and last key may have runs elsewhere

    ordered = rows.repartitionByRange(*key, "_t").sortWithinPartitions(*key, "_t")
    every = kept(ordered.mapInPandas(runs, StructType([*plain, *long("part", "n", "first", "last", "over", "windows"), *lists("times")])), "runs")
    of = Window.partitionBy(*key)
    placed = every.withColumns({"runs": F.count("*").over(of), "place": F.row_number().over(of.orderBy("part")) - 1})
    single = placed.where("runs = 1").select(*key, "n", F.col("over").alias("over_limit"), "windows")

    table = StructType([*plain, *long("place", "n", "first", "last", "begins"), *lists(*LISTS)])
    names = [f.name for f in table]

    def as_table(k: tuple, place: int, t: dict) -> pd.DataFrame:
        return pd.DataFrame([(*k, place, t["n"], t["first"], t["last"], int(t["begins"]), *[t[x] for x in LISTS])], columns=names)

    def begin(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        times = np.array(r["times"], np.int64)
        return as_table(k[:-1], int(r["place"]), run_table(times, span, most, r["place"] == 0) | {"n": len(times), "first": times[0], "last": times[-1], "begins": r["place"] == 0})

    def join(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        two = [{**{x: np.array(r[x], np.int64) for x in LISTS}, **{x: int(r[x]) for x in ("n", "first", "last", "begins")}} for _, r in pdf.sort_values("place").iterrows()]
        return as_table(k[:-1], int(k[-1]), composed(*two, span, most) if len(two) == 2 else two[0])

    tables = kept(placed.where("runs > 1").groupBy(*key, "place").applyInPandas(begin, table), "run-tables")
    left = tables.agg(F.max("place")).first()[0]
    while left:
        tables = kept(tables.groupBy(*key, F.floor(F.col("place") / 2).alias("_pair")).applyInPandas(join, table), "run-tables")
        left //= 2
    whole = tables.select(*key, "n", (F.get("over", F.lit(0)) + F.greatest(F.lit(0), F.get("used", F.lit(0)) - most)).alias("over_limit"), F.get("windows", F.lit(0)).alias("windows"))
    return single.unionByName(whole)


def cache_hits(events: DataFrame, key: list[str], ts: Column, ttl: int) -> DataFrame:
    """hits and misses of a cache whose entry lasts `ttl` seconds from the miss that made it."""
    w = anchored(events, key, ts, ttl, 1)
    return w.select(*key, F.col("n").alias("requests"), F.col("windows").alias("misses"), (F.col("n") - F.col("windows")).alias("hits"), F.round((F.col("n") - F.col("windows")) / F.col("n"), 6).alias("hit_rate"))


def cumulative_histogram(df: DataFrame, by: list[str], value: str, edges: list[float]) -> DataFrame:
    """by, le, n: counts at or below each edge and +Inf, in one aggregate."""
    names = [*map(str, edges), "+Inf"]
    counts = [F.count_if(F.col(value) <= e).alias(f"b{i}") for i, e in enumerate(edges)] + [F.count(value).alias(f"b{len(edges)}")]
    rows = F.array(*[F.struct(F.lit(n).alias("le"), F.col(f"b{i}").alias("n")) for i, n in enumerate(names)])
    return df.groupBy(*by).agg(*counts).select(*by, F.explode(rows).alias("r")).select(*by, "r.le", "r.n")
