"""Sequence algebra over ordered samples: builders of column expressions, shared by batch operators.

A missing sample is NULL, never NaN. Frames count rows, centred as rows i - w // 2 to i + (w - 1) // 2. Long series are dealt
out by halo(): windows then run over buckets of rows instead of whole series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(*keys: str, by: str = "seq", then: str | None = None) -> WindowSpec:
    """Rows of the keys in order. back is the same in reverse: what lies ahead is there a running frame, which costs each row once, where
    a frame up to the last row would be gone through anew for each."""
    names = [by] if then is None else [by, then]
    win = Window.partitionBy(*keys).orderBy(*names)
    win.back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in names])
    return win


def centred(win: WindowSpec, w: int) -> WindowSpec:
    return win.rowsBetween(-(w // 2), (w - 1) // 2)


def roll_mean(v: str, win: WindowSpec, w: int, least: int = 1) -> Column:
    frame = centred(win, w)
    return F.when(F.count(v).over(frame) >= least, F.avg(v).over(frame))


def wide_mean(df: DataFrame, v: str, name: str, keys: list[str], w: int, least: int = 1) -> DataFrame:
    """df with name, as roll_mean(): from running sums, which cost each row once however wide the frame is."""
    win, whole = ordered(*keys), Window.partitionBy(*keys)
    upto = win.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"__s": F.coalesce(F.sum(v).over(upto), F.lit(0.0)), "__n": F.count(v).over(upto)})
    edges = [(F.coalesce(F.lead(c, (w - 1) // 2).over(win), F.max_by(c, "seq").over(whole)), F.coalesce(F.lag(c, w // 2 + 1).over(win), F.lit(0))) for c in ("__s", "__n")]
    (s1, s0), (n1, n0) = edges
    return df.withColumns({"__d": s1 - s0, "__m": n1 - n0}).withColumn(name, F.when(F.col("__m") >= max(least, 1), F.col("__d") / F.col("__m"))).drop("__s", "__n", "__d", "__m")


def roll_median(v: str, win: WindowSpec, w: int) -> Column:
    return F.percentile(v, F.lit(0.5)).over(centred(win, w))


def trailing_range(v: str, win: WindowSpec, n: int) -> Column:
    """Maximum less minimum of the last n rows; NULL where there are fewer values."""
    frame = win.rowsBetween(-(n - 1), 0)
    return F.when(F.count(v).over(frame) == n, F.max(v).over(frame) - F.min(v).over(frame))


def median_filter(v: str, win: WindowSpec, k: int = 11) -> Column:
    """Median of k rows, with zeros beyond the ends; v has no NULLs."""
    near = F.collect_list(v).over(centred(win, k))
    return F.element_at(F.array_sort(F.concat(near, F.array_repeat(F.lit(0.0), F.lit(k) - F.size(near)))), k // 2 + 1)


def known(v: str, win: WindowSpec, at: str = "seq") -> tuple[Column, Column]:
    """Structs (at, v) of the last known sample up to here and of the first from here on; win is ordered()."""
    one = F.last(F.when(F.col(v).isNotNull(), F.struct(F.col(at).alias("at"), F.col(v).alias("v"))), True)
    return tuple(one.over(w.rowsBetween(Window.unboundedPreceding, 0)) for w in (win, win.back))


def between(before: Column, after: Column, at: Column) -> Column:
    """The straight line through both, held level beyond the ends."""
    line = before["v"] + (after["v"] - before["v"]) * (at - before["at"]) / F.nullif(after["at"] - before["at"], F.lit(0))
    return F.when(before.isNull(), after["v"]).when(after.isNull() | (after["at"] == before["at"]), before["v"]).otherwise(line)


def fill_linear(v: str, win: WindowSpec) -> Column:
    before, after = known(v, win)
    return F.coalesce(F.col(v), between(before, after, F.col("seq")))


def bridge(v: str, win: WindowSpec, limit: int) -> Column:
    """Fills the first `limit` rows of gaps that have samples on both sides."""
    before, after = known(v, win)
    inner = before.isNotNull() & after.isNotNull() & (F.col("seq") - before["at"] <= limit)
    return F.coalesce(F.col(v), F.when(inner, between(before, after, F.col("seq"))))


def dilated(flag: Column, win: WindowSpec, m: int) -> Column:
    return F.max(flag.cast("int")).over(win.rowsBetween(-m, m)) == 1


def numbered_runs(df: DataFrame, breaks: Column, win: WindowSpec, name: str = "run") -> DataFrame:
    """Numbers rows by how many breaks there have been; breaks may look back with lag()."""
    return df.withColumn("__b", F.coalesce(breaks, F.lit(True)).cast("int")).withColumn(name, F.sum("__b").over(win)).drop("__b")


def islands(df: DataFrame, flag: Column, keys: list[str], *aggregates: Column) -> DataFrame:
    """A row for each run of rows with flag: start and stop (seq, stop exclusive), t_start, t_end, n, and the aggregates. NULL counts as false."""
    win = ordered(*keys)
    marked = df.withColumn("__f", F.coalesce(flag, F.lit(False)))
    marked = numbered_runs(marked, F.col("__f") != F.lag("__f").over(win), win)
    return marked.where("__f").groupBy(*keys, "run").agg(
        F.min("seq").alias("start"), (F.max("seq") + 1).alias("stop"), F.min("t").alias("t_start"), F.max("t").alias("t_end"), F.count("*").alias("n"), *aggregates
    ).drop("run")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """left (keys, t, ...) with before and after: structs (at, v) of right's rows around t, by one sorted union rather than a range join."""
    names = [c for c in left.columns if c not in (*keys, "t")]
    side = lambda df, own: df.select(*keys, F.col("t").cast("double").alias("t"), *[(F.col(c) if own else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in names], (F.lit(None).cast("double") if own else F.col(value).cast("double")).alias("__v"), F.lit(int(own)).alias("__own"))
    win = ordered(*keys, by="t", then="__own")
    before, after = known("__v", win, "t")
    both = side(left, True).unionByName(side(right.where(F.col(value).isNotNull()), False))
    return both.withColumn("before", before).withColumn("after", after).where("__own = 1").drop("__v", "__own")


def interpolated(left: DataFrame, right: DataFrame, keys: list[str], value: str = "v", name: str = "r") -> DataFrame:
    """left with right's series interpolated at its times, held level beyond the ends."""
    found = as_of(left, right, keys, value)
    exact = F.when(F.col("before.at") == F.col("t"), F.col("before.v"))
    return found.withColumn(name, F.coalesce(exact, between(F.col("before"), F.col("after"), F.col("t")))).drop("before", "after")


def halo(df: DataFrame, keys: list[str], radius: int, size: int) -> DataFrame:
    """Rows dealt into buckets of size rows by seq, with radius rows more on both sides: columns bucket, and own (false for those).

    A frame of radius rows or fewer then needs one bucket, and one long series becomes many tasks.
    """
    b = F.floor(F.col("seq") / size)
    near = F.array_distinct(F.array(F.floor((F.col("seq") - radius) / size), b, F.floor((F.col("seq") + radius) / size)))
    return df.withColumn("__own", b).withColumn("bucket", F.explode(near)).withColumn("own", F.col("bucket") == F.col("__own")).drop("__own")


def significant(x: Column, digits: int = 6) -> Column:
    """Rounded to so many significant digits; 0 and NULL stay."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(F.nullif(x, F.lit(0.0))))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * power) / power)
