"""Detection over sampled series: runs, islands, hysteresis, cooldown, phases, change points.

Windows over (keys, order) express everything that looks at neighbours. What depends on earlier
decisions (cooldown, skipping ahead, acceptance) is a stream of a media's rows in order with a state of one or two
numbers; phases are a fold over a slide's samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.groups import decided


def _w(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def run_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """_run: a number that grows where value differs from the row before (nulls are equal)."""
    w = _w(keys, order)
    rows = df.withColumn("_value", value)
    changed = (~F.col("_value").eqNullSafe(F.lag("_value").over(w))) | (F.row_number().over(w) == 1)
    return rows.withColumn("_changed", changed.cast("long")).withColumn("_run", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_changed")


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, min_len: int = 1, t: str = "t_us", emit_open_run: bool = True, max_us: int | None = None) -> DataFrame:
    """Runs of rows where flag holds: keys, start (first t), last (last t), closed_at (t of the row
    that ends the run, null if it is open), n. Open runs are left out unless asked for."""
    w = _w(keys, order)
    on = F.coalesce(flag, F.lit(False))
    found = run_ids(df.withColumn("_next", F.lead(t).over(w)), keys, order, on).where("_value")
    out = found.groupBy(*keys, "_run").agg(F.min(t).alias("start"), F.max(t).alias("last"), F.max_by("_next", F.struct(*order)).alias("closed_at"), F.count("*").alias("n")).drop("_run").where(F.col("n") >= min_len)
    if not emit_open_run:
        out = out.where("closed_at IS NOT NULL")
    return out if max_us is None else out.where(F.col("last") - F.col("start") <= max_us)


def hit_islands(df: DataFrame, keys: Sequence[str], t: str, gap: int, strict: bool = False) -> DataFrame:
    """Islands of hit times whose gaps are at most gap (less than it, if strict): start, last, n."""
    w = _w(keys, [t])
    d = F.col(t) - F.lag(t).over(w)
    new = d.isNull() | (d >= gap if strict else d > gap)
    rows = df.select(*keys, t, new.cast("long").alias("_new"))
    rows = rows.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min(t).alias("start"), F.max(t).alias("last"), F.count("*").alias("n")).drop("_island")


def widening_islands(df: DataFrame, keys: Sequence[str], t: str, gap: int, step: int, first_extra: int, before: int, max_len: int, after: int = 0) -> DataFrame:
    """Islands of hits where each hit reaches to t + step (the first to t + step + first_extra) and a hit
    joins if it is at most gap beyond that reach; then starts move back by before (not below 0),
    islands longer than max_len go, and ends move on by after.

    The reach of an island's first hit is longer, so whether a hit is the first decides on the next: a
    hit joins if it is within gap + step of the one before, or within gap + step + first_extra of an
    island's first. The second case matters only between the first and second hit, where both hold."""
    w = _w(keys, [t])
    d = F.col(t) - F.lag(t).over(w)
    # surely new, surely joined, or joined only right after an island's first hit
    kind = F.when(d.isNull() | (d > gap + step + first_extra), "new").when(d <= gap + step, "in").otherwise("maybe")
    rows = df.select(*keys, t, kind.alias("_k"))
    # a stretch of maybes alternates from the hit before it: after a first hit joined, new, joined ...
    back = F.row_number().over(w) - F.max(F.when(F.col("_k") != "maybe", F.row_number().over(w))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_back", back)
    base = F.last(F.when(F.col("_k") != "maybe", F.col("_k")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_base", base)
    new = F.when(F.col("_k") == "new", True).when(F.col("_k") == "in", False).otherwise(F.when(F.col("_base") == "new", F.col("_back") % 2 == 0).otherwise(F.col("_back") % 2 == 1))
    rows = rows.withColumn("_island", F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = rows.groupBy(*keys, "_island").agg(F.min(t).alias("start"), F.greatest(F.max(t) + step, F.min(t) + step + first_extra).alias("end")).drop("_island")
    got = got.withColumn("start", F.greatest(F.lit(0).cast("long"), F.col("start") - before)).where(F.col("end") - F.col("start") <= max_len)
    return got.withColumn("end", F.col("end") + after)


def hysteresis(df: DataFrame, keys: Sequence[str], order: Sequence[str], enter: Column, stay: Column, t: str = "t_us", min_n: int = 1) -> DataFrame:
    """Runs that begin at a row where enter holds and last while stay holds: start, last, n."""
    held = run_ids(df.withColumn("_enter", F.coalesce(enter, F.lit(False)) & F.coalesce(stay, F.lit(False))), keys, order, F.coalesce(stay, F.lit(False))).where("_value")
    w = _w([*keys, "_run"], order).rowsBetween(Window.unboundedPreceding, 0)
    begun = held.withColumn("_on", F.max("_enter").over(w)).where("_on")
    return begun.groupBy(*keys, "_run").agg(F.min(t).alias("start"), F.max(t).alias("last"), F.count("*").alias("n")).drop("_run").where(F.col("n") >= min_n)


def persistent(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, least: int) -> DataFrame:
    """Rows at which flag has held for at least `least` samples in a row, with the count _n."""
    held = run_ids(df, keys, order, F.coalesce(flag, F.lit(False))).where("_value")
    return held.withColumn("_n", F.row_number().over(_w([*keys, "_run"], order))).where(F.col("_n") >= least).drop("_value", "_run")


def fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """step over the rows of each key in order. For keys whose rows fit a task: a slide's samples, a media's candidates."""
    order = list(order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return step(pdf.sort_values(order, kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema)


def cooldown(df: DataFrame, keys: Sequence[str], t: str, wait: int) -> DataFrame:
    """Of fired rows those that stand: after one, rows up to t + wait are silent. Counters that made
    them fire are not reset."""

    def start():
        until = None

        def fires(x) -> bool:
            nonlocal until
            ok = until is None or x > until
            until = x + wait if ok else until
            return ok

        return fires

    return decided(df, keys, [t], [t], start)


def skip_ahead(df: DataFrame, keys: Sequence[str], at: str, resume: str) -> DataFrame:
    """Of candidates in order of `at` those that a scan takes: each one resumes at `resume`, and
    candidates before that are passed over."""

    def start():
        now = None

        def taken(a, b) -> bool:
            nonlocal now
            ok = now is None or a >= now
            now = b if ok else now
            return ok

        return taken

    return decided(df, keys, [at], [at, resume], start)


def segment_on_change(df: DataFrame, keys: Sequence[str], order: Sequence[str], changed: Column, name: str = "slide") -> DataFrame:
    """A number from 0 that grows at each row where changed holds."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.coalesce(changed, F.lit(False)).cast("long")).over(w))


def trimmed_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], head: int = 1, tail: int = 3) -> DataFrame:
    """Rows of each segment without its first `head`, and of the rest without its last `tail`."""
    w = Window.partitionBy(*keys)
    n = df.withColumns({"_i": F.row_number().over(w.orderBy(*order)), "_m": F.count("*").over(w)})
    return n.where((F.col("_i") > head) & (F.col("_i") <= F.col("_m") - tail)).drop("_i", "_m")


def rle_locf(df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], t: str = "t_us", grid: int = 2) -> DataFrame:
    """Values rounded half-even to a grid, gaps filled with the last known value, equal runs merged."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    snapped = df.withColumns({c: F.last((F.bround(F.col(c) / grid) * grid).cast("long"), True).over(w) for c in cols})
    found = run_ids(snapped, keys, order, F.struct(*cols)).groupBy(*keys, "_run")
    return found.agg(*[F.first(c).alias(c) for c in cols], F.min(t).alias("start"), F.max(t).alias("last"), F.count("*").alias("n")).drop("_run")


def phases(df: DataFrame, keys: Sequence[str], t: str, value: str, jump: float = 70, min_len: int = 2_500_000) -> DataFrame:
    """Phases within a slide: a new one where value is more than jump from the phase's first value.
    A phase shorter than min_len extends the one before; ends are stretched to the next start, the
    first begins at slide_start and the last ends at slide_end (columns of df)."""
    out = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", start long, end long, first double, low double, n long"

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[dict] = []
        for x, v in zip(pdf[t].tolist(), pdf[value].tolist()):
            if not found or abs(v - found[-1]["first"]) > jump:
                found.append({"start": x, "last": x, "first": v, "low": v, "n": 0})
            found[-1] |= {"last": x, "low": max(found[-1]["low"], v), "n": found[-1]["n"] + 1}
        lo, hi = int(pdf["slide_start"].iloc[0]), int(pdf["slide_end"].iloc[0])
        merged: list[dict] = []
        for p in found:
            if merged and p["last"] - p["start"] < min_len:
                merged[-1] |= {"last": p["last"], "low": max(merged[-1]["low"], p["low"]), "n": merged[-1]["n"] + p["n"]}
            else:
                merged.append(p)
        starts = [lo, *(p["start"] for p in merged[1:])]
        rows = [{"start": a, "end": b, "first": p["first"], "low": p["low"], "n": p["n"]} for p, a, b in zip(merged, starts, [*starts[1:], hi])]
        return pd.DataFrame(rows).assign(**{k: pdf[k].iloc[0] for k in keys})[[*keys, "start", "end", "first", "low", "n"]]

    return fold(df, keys, [t], step, out)


def longest_run(df: DataFrame, keys: Sequence[str], order: str, flag: Column) -> DataFrame:
    """The most rows in a row, by consecutive values of order, where flag holds."""
    on = df.where(flag).select(*keys, order).distinct()
    w = _w(keys, [order])
    rows = on.withColumn("_g", F.col(order) - F.row_number().over(w))
    return rows.groupBy(*keys, "_g").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("longest"))


def onset_settle(diffs: DataFrame, keys: Sequence[str], t: str = "t", value: str = "diff", floor: float = 4.0, share: float = 0.35, fps: float = 30.0) -> DataFrame:
    """Within each key: the first and last time at which value reaches the threshold
    greatest(floor, share * max); keys whose largest value is below floor are left out. Rows carry
    t as the time of the later of two frames; onset lies half a frame before it."""
    top = F.max(value).over(Window.partitionBy(*keys))
    hot = diffs.withColumn("_top", top).where((F.col("_top") >= floor) & (F.col(value) >= F.greatest(F.lit(floor), F.col("_top") * share)))
    return hot.groupBy(*keys).agg((F.min(t) - 0.5 / fps).alias("onset"), (F.max(t) + 1.0 / fps).alias("settle"))


def accepted_apart(df: DataFrame, keys: Sequence[str], start: str = "start_us", end: str = "end_us", slack: int = 400_000, most: int | None = None) -> DataFrame:
    """In order of start, rows that no row accepted before holds within slack at both ends; at most `most` for each key.
    Those before start no later, so the latest of their ends decides."""

    def fresh():
        last, n = None, 0

        def accepted(s, e) -> bool:
            nonlocal last, n
            if (most is not None and n >= most) or (last is not None and e <= last + slack):
                return False
            last, n = e if last is None else max(last, e), n + 1
            return True

        return accepted

    return decided(df, keys, [start, end], [start, end], fresh)


def pinned_edges(spans: DataFrame, matches: DataFrame, keys: Sequence[str], reach: int = 1_000_000) -> DataFrame:
    """spans: keys, span, a, b, lo, hi (bounds set by neighbours). matches: keys, t where the pattern fits. The
    first match from a - reach on and the last one up to b + reach, within the bounds; spans without
    a match on either side are left out. A match counts for few spans, so it is a bucketed join."""
    width = 10 * reach
    b = lambda c: F.floor(c / F.lit(width)).cast("long")
    s = spans.withColumns({"_from": F.greatest(F.col("a") - reach, F.col("lo")), "_to": F.least(F.col("b") + reach, F.col("hi"))}).where("_to >= _from")
    s = s.withColumn("_bucket", F.explode(F.sequence(b(F.col("_from")), b(F.col("_to")))))
    m = matches.select(*keys, "t", b(F.col("t")).alias("_bucket"))
    near = s.join(m, [*keys, "_bucket"]).where(F.col("t").between(F.col("_from"), F.col("_to")))
    return near.groupBy(*keys, "span").agg(F.min("t").alias("start"), F.max("t").alias("end"))
