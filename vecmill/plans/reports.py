"""Reports over result tables: traces, envelopes, selections under a budget, summaries.

A method may hold most rows: its percentiles and places come from slices (``functions.ranks``), not from one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..functions.ranks import numbered, part_of, percentiles
from ..operators.quality import LATENCIES


def latency_summary(results: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """n, mean, std (population) and exact percentiles of each group; values that aren't finite are left out."""
    finite = results.where(V.is_finite(F.col(value)))
    sums = finite.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return _beside(sums, percentiles(finite, by, value, LATENCIES, results.count()), by)


def _beside(groups: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """Columns of ``more`` beside those of ``groups``; by may be null, a group that more hasn't has nulls."""
    theirs = more.select(*(F.col(c).alias(f"_{c}") for c in by), *(c for c in more.columns if c not in by))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return groups.join(theirs, same, "left").drop(*(f"_{c}" for c in by))


def stream_summary(batches: DataFrame, by: list[str], warmup: int) -> DataFrame:
    """Of a run's batches (batch, recall, qps, latency): mean recall and qps over batches with qps above 0, warm-up included; exact percentiles of latency after it."""
    timed = F.when(F.col("batch") >= warmup, F.col("latency"))
    busy = lambda c: F.avg(F.when(F.col("qps") > 0, F.col(c)))
    marked = batches.withColumn("timed", timed)
    sums = marked.groupBy(*by).agg(F.count("timed").alias("timed"), busy("recall").alias("recall"), busy("qps").alias("qps"))
    return _beside(sums, percentiles(marked, by, "timed", LATENCIES), by)


def windows(results: DataFrame, by: list[str], order: str, value: str = "value", n: int = 12) -> DataFrame:
    """part (1 to n), mean and p99 of near-equal consecutive parts of each group's trace."""
    most = results.count()
    parts = numbered(results.select(*by, order, value), by, [order], most=most).withColumn("part", part_of(F.col("place"), F.col("total"), n))
    means = parts.groupBy(*by, "part").agg(F.avg(value).alias("mean"))
    return _beside(means, percentiles(parts, [*by, "part"], value, {"p99": 0.99}, most), [*by, "part"])


def trace_envelope(traces: DataFrame, key: str = "method", over: str = "dataset", value: str = "mean") -> DataFrame:
    """key, part, mean, low, high over datasets, up to the shortest dataset's last part."""
    ends = traces.groupBy(key, over).agg(F.max("part").alias("end")).groupBy(key).agg(F.min("end").alias("end"))
    out = traces.join(ends, key).where("part <= end").groupBy(key, "part")
    return out.agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def distribution(results: DataFrame, by: list[str], value: str, tie: str) -> DataFrame:
    """The empirical distribution: each value with rank/n inside its group; equal values have ranks in order of ``tie``."""
    return numbered(results, by, [value, tie]).withColumn("share", (F.col("place") + 1) / F.col("total")).drop("place", "total")


def envelope(results: DataFrame, by: list[str], value: str) -> DataFrame:
    return results.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))


def over_seeds(results: DataFrame, metrics: list[str], key: str = "method") -> DataFrame:
    """mean and population std of each metric over seeds."""
    return results.groupBy(key).agg(F.count(F.lit(1)).alias("seeds"), *(f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def best_within(candidates: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget, method, recall, qps: the candidate (method, cost, recall, qps) of highest recall, then qps, then first name, whose cost fits; null where none does."""
    fits = budgets.join(F.broadcast(candidates), F.col("cost") <= F.col("budget"))  # a row for each method
    rank = F.row_number().over(Window.partitionBy("budget").orderBy(F.desc("recall"), F.desc("qps"), "method"))
    best = fits.withColumn("r", rank).where("r = 1").select("budget", "method", "recall", "qps")
    return budgets.select("budget").distinct().join(best, "budget", "left")


def relative(curves: DataFrame, keys: list[str], t: str = "t", value: str = "sse") -> DataFrame:
    """``value`` over its first value of each curve; 1 where the first isn't positive."""
    first = F.first_value(value).over(Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    return curves.withColumn("relative", F.when(first > 0, F.col(value) / first).otherwise(1.0))


def paired(curves: DataFrame, key: str, t: str, a: str = "cdkm", b: str = "lloyd", value: str = "relative") -> DataFrame:
    """t, mean of both methods, share of pairs in which a is lower, and the gap of the means."""
    wide = curves.groupBy(key, t).pivot("method", [a, b]).agg(F.first(value))
    return wide.groupBy(t).agg(F.avg(a).alias(f"{a}_mean"), F.avg(b).alias(f"{b}_mean"), F.avg(F.when(F.col(a) < F.col(b), 1.0).otherwise(0.0)).alias("better"), (F.avg(b) - F.avg(a)).alias("gap"))


def speedups(results: DataFrame, ours: str, theirs: str, value: str) -> DataFrame:
    """mean, low, high over datasets of theirs/ours; datasets that lack either, or where ours is 0, don't count."""
    side = lambda m, n: results.where(F.col("method") == m).select("dataset", F.col(value).alias(n))
    x = side(ours, "x").join(side(theirs, "y"), "dataset").withColumn("speedup", V.ratio(F.col("y"), F.col("x"))).where("speedup is not null")
    return x.agg(F.count(F.lit(1)).alias("datasets"), F.avg("speedup").alias("mean"), F.min("speedup").alias("low"), F.max("speedup").alias("high"))


def section(results: DataFrame, columns: dict[str, tuple[str, str]], ratios: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """dataset and a column for each (method, metric) of results (dataset, method, metric, value), and ratios of columns.

    What a dataset lacks is null, as is a ratio over 0.
    """
    pick = lambda m, k: F.max(F.when((F.col("method") == m) & (F.col("metric") == k), F.col("value")))
    rows = results.groupBy("dataset").agg(*(pick(m, k).alias(c) for c, (m, k) in columns.items()))
    return rows.withColumns({c: V.ratio(F.col(a), F.col(b)) for c, (a, b) in (ratios or {}).items()})


def section_summary(rows: DataFrame, measures: list[tuple[str, str]]) -> DataFrame:
    """name and value of statistics (mean, min, max, sum) of columns over datasets, as (statistic, column); nulls don't count."""
    how = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}
    one = rows.agg(*(how[s](c).cast("double").alias(f"{s}_{c}") for s, c in measures))
    return one.select(F.explode(F.array(*(F.struct(F.lit(f"{s}_{c}").alias("name"), F.col(f"{s}_{c}").alias("value")) for s, c in measures))).alias("r")).select("r.*")


#: Sections of the claim summary: columns by (method, metric), ratios, and statistics over datasets.
CLAIMS = {
    "maintenance": ({"theirs": ("lire", "maintenance"), "ours": ("scdkm", "maintenance"), "their_moves": ("lire", "reassigned"), "our_moves": ("scdkm", "reassigned"), "their_recall": ("lire", "recall"), "our_recall": ("scdkm", "recall")}, {"speedup": ("theirs", "ours")}, [("mean", "speedup"), ("min", "speedup"), ("max", "speedup"), ("sum", "their_moves"), ("sum", "our_moves")]),
    "drift": ({"frozen_recall": ("frozen", "recall"), "rebuild_recall": ("rebuild", "recall"), "our_recall": ("scdkm", "recall"), "frozen_qps": ("frozen", "qps"), "our_qps": ("scdkm", "qps"), "frozen_p99": ("frozen", "p99"), "our_p99": ("scdkm", "p99")}, {}, [("mean", c) for c in ("frozen_recall", "rebuild_recall", "our_recall", "frozen_p99", "our_p99")]),
    "splits": ({"l0_violations": ("lire_l0", "violations"), "l5_violations": ("lire_l5", "violations"), "our_violations": ("scdkm", "violations"), "l0_recall": ("lire_l0", "recall"), "l5_recall": ("lire_l5", "recall"), "our_recall": ("scdkm", "recall"), "l5_moves": ("lire_l5", "reassigned")}, {}, [("mean", c) for c in ("l0_violations", "l5_violations", "our_violations", "l5_moves")]),
    "updates": ({"their_delete_p99": ("lire", "delete_p99"), "our_delete_p99": ("scdkm", "delete_p99"), "their_query_p99": ("lire", "query_p99"), "our_query_p99": ("scdkm", "query_p99"), "their_recall": ("lire", "recall"), "our_recall": ("scdkm", "recall")}, {"speedup": ("their_delete_p99", "our_delete_p99")}, [("mean", "speedup"), ("min", "speedup"), ("max", "speedup")]),
}


def claim_summary(results: DataFrame, datasets: dict[str, Column] | None = None) -> DataFrame:
    """section, name, value of CLAIMS; ``datasets``: a condition on the datasets of a section, where not all count."""
    out = None
    for name, (columns, ratios, measures) in CLAIMS.items():
        own = results.where(datasets[name]) if datasets and name in datasets else results
        one = section_summary(section(own, columns, ratios), measures).select(F.lit(name).alias("section"), "name", "value")
        out = one if out is None else out.union(one)
    return out


def baselines(results: DataFrame, names: dict[str, str], metrics: list[str]) -> DataFrame:
    """dataset, method (the name it is shown by) and metrics of the methods that stand for baselines; those that a dataset lacks have no row."""
    shown = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    pick = lambda k: F.max(F.when(F.col("metric") == k, F.col("value"))).alias(k)
    mine = results.where(F.col("method").isin(list(names)))
    return mine.groupBy("dataset", shown[F.col("method")].alias("method")).agg(*map(pick, metrics))


def flattened(results: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """Parallel arrays as rows, with their place."""
    z = results.select(*keys, F.posexplode(F.arrays_zip(*arrays)).alias("place", "z"))
    return z.select(*keys, F.col("place").cast("long").alias("place"), *(F.col("z")[a].alias(a) for a in arrays))


def last_wins(tables: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of result tables; of rows with one key, that of the last table."""
    every = None
    for i, t in enumerate(tables):
        t = t.withColumn("_from", F.lit(i))
        every = t if every is None else every.unionByName(t, allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_from")))
    return every.withColumn("_r", rank).where("_r = 1").drop("_r", "_from")


def appended(results: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """``more``'s rows added where their key isn't there yet."""
    return results.unionByName(more.join(results.select(*key), key, "left_anti"), allowMissingColumns=True)
