"""Robust statistics and small models: outliers by median deviation, drift, slopes, forecasts, precursors, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.calendar import day_of

Z, CUT, SAMPLES = 0.6745, 3.5, 5


def scales(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n, med, scale: the median deviation from the median, or the mean one where that is 0."""
    med = rows.groupBy(*keys).agg(F.median(value).alias("med"), F.count("*").alias("n"))
    off = F.abs(F.col(value) - F.col("med"))
    return rows.join(med, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("med").alias("med"), F.median(off).alias("mad"), F.avg(off).alias("mean")).select(*keys, "n", "med", F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("mean")).alias("scale"))


def robust_z(value: str) -> Column:
    return F.lit(Z) * (F.col(value) - F.col("med")) / F.col("scale")


def outliers(rows: DataFrame, keys: list[str], value: str, samples: int = SAMPLES) -> DataFrame:
    """trace_id, step_index, tool, value, median, robust_z of values beyond the cut within their group; groups of under
    `samples` values are left alone."""
    s = scales(rows, keys, value).where((F.col("n") >= samples) & (F.col("scale") > 0))
    found = rows.join(s, keys).withColumn("z", robust_z(value)).where(F.abs("z") > CUT)
    return found.select("trace_id", "step_index", "tool", F.col(value).alias("value"), F.col("med").cast("double").alias("median"), F.col("z").alias("robust_z"))


def family_outliers(rows: DataFrame, value: str) -> DataFrame:
    """Within each trace: a tool with enough calls by its own scale, the others by the trace's."""
    own = scales(rows, ["trace_id", "tool"], value).where(F.col("n") >= SAMPLES).select("trace_id", "tool", F.col("med").alias("m1"), F.col("scale").alias("s1"))
    all_ = scales(rows, ["trace_id"], value).where(F.col("n") >= SAMPLES).select("trace_id", F.col("med").alias("m0"), F.col("scale").alias("s0"))
    both = rows.join(all_, "trace_id").join(own, ["trace_id", "tool"], "left").withColumns({"med": F.coalesce("m1", "m0"), "scale": F.coalesce("s1", "s0")}).where("scale > 0")
    found = both.withColumn("z", robust_z(value)).where(F.abs("z") > CUT)
    return found.select("trace_id", "step_index", "tool", F.col(value).alias("value"), F.col("med").cast("double").alias("median"), F.col("z").alias("robust_z"))


def shape() -> Column:
    """A call's structure: its tool and the names of its arguments."""
    return F.concat(F.coalesce("tool", F.lit("-")), F.lit(" {"), F.coalesce(F.array_join(F.array_sort(F.json_object_keys("args_canon")), ","), F.lit("")), F.lit("}"))


def psi(steps: DataFrame, baseline: Column) -> DataFrame:
    """action, baseline and current share, term: the parts of the population stability index."""
    counts = steps.where("kind = 'tool_call' and error is null").groupBy(shape().alias("action")).agg(F.count_if(baseline).alias("a"), F.count_if(~baseline).alias("b"))
    na, nb = counts.agg(F.sum("a"), F.sum("b")).first()
    share = lambda c, n: (F.col(c) + 1e-6) / (max(n or 0, 1) + 1e-6)
    rows = counts.select("action", share("a", na).alias("baseline_share"), share("b", nb).alias("current_share"))
    return rows.withColumn("term", (F.col("baseline_share") - F.col("current_share")) * F.log(F.col("baseline_share") / F.col("current_share")))


def psi_verdict(total: Column) -> Column:
    return F.when(total > 0.25, "significant shift").when(total > 0.1, "moderate shift").otherwise("stable")


def theil_sen(series: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """key, slope: the median of the slopes between all pairs of a series. A series is a row for each day: bounded by time."""
    rows = series.select(key, F.col(value).alias("v"), F.row_number().over(W.partitionBy(key).orderBy(order)).alias("i"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.i") < F.col("b.i")))
    return pairs.groupBy(F.col(f"a.{key}").alias(key)).agg(F.median((F.col("b.v") - F.col("a.v")) / (F.col("b.i") - F.col("a.i"))).alias("slope"))


def daily(traces: DataFrame, rate: Column) -> DataFrame:
    day = day_of(F.col("created_us"))
    return traces.groupBy("store", day.alias("day")).agg(F.count("*").alias("traces"), F.count_if(F.col("success") == False).alias("failures"), F.sum(F.col("tokens") / 1000 * F.coalesce(rate, F.lit(0.0))).alias("est_spend"))  # noqa: E712


def forecast(days: DataFrame, ceiling: float, horizon: int = 14) -> DataFrame:
    """store, offset, est_spend, days_to_ceiling: the last day's spend carried on by its slope, never below 0."""
    slope = theil_sen(days, "store", "day", "est_spend")
    last = days.groupBy("store").agg(F.max_by("est_spend", "day").alias("latest"), F.max("day").alias("last_day"))
    rows = last.join(slope, "store")
    reach = F.when(F.col("latest") > ceiling, 0).when(F.col("slope") > 0, F.ceil((ceiling - F.col("latest")) / F.col("slope"))).cast("long")
    return rows.select("store", "latest", "slope", "last_day", reach.alias("days_to_ceiling"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("offset")).select("store", F.col("offset").cast("long").alias("offset"), F.date_add(F.col("last_day").cast("date"), F.col("offset")).cast("string").alias("day"), F.greatest(F.lit(0.0), F.col("latest") + F.col("slope") * F.col("offset")).alias("est_spend"), "days_to_ceiling")


def budget_projection(days: DataFrame, allowance: int, horizon: int = 60) -> DataFrame:
    """store, burned, slope, days_to_exhaustion: the days until failures, carried on by their slope (none below 0, each day
    rounded half to even), are over the allowance; 0 where they are already, null beyond the horizon."""
    rows = days.select("store", "day", F.greatest("failures", F.lit(0)).alias("failures"))
    last = rows.groupBy("store").agg(F.sum("failures").alias("burned"), F.max_by("failures", "day").alias("latest"))
    rows = last.join(theil_sen(rows, "store", "day", "failures"), "store").withColumn("offset", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    step = F.bround(F.greatest(F.lit(0.0), F.col("latest") + F.col("slope") * F.col("offset")), 0)
    w = W.partitionBy("store").orderBy("offset")
    over = F.when(F.col("burned") + F.sum(step).over(w) > allowance, F.col("offset"))
    out = rows.withColumn("over", over).groupBy("store", "burned", "slope").agg(F.min("over").alias("first"))
    return out.select("store", "burned", "slope", F.when(F.col("burned") > allowance, 0).otherwise(F.col("first")).cast("long").alias("days_to_exhaustion"))


def failure_budget(days: DataFrame, allowance: int) -> DataFrame:
    """store, burned, allowance, exhausted: failures so far against what is allowed, and the first day on which they are over."""
    w = W.partitionBy("store").orderBy("day")
    rows = days.withColumn("burned", F.sum(F.greatest("failures", F.lit(0))).over(w))
    return rows.groupBy("store").agg(F.max("burned").alias("burned"), F.min(F.when(F.col("burned") > allowance, F.col("day"))).alias("exhausted")).withColumn("allowance", F.lit(allowance).cast("long"))


def ngrams(steps: DataFrame) -> DataFrame:
    """trace_id, n, gram, pos: runs of one to three calls (tool and argument names)."""
    calls = steps.where("kind = 'tool_call'")
    w = W.partitionBy("trace_id").orderBy("step_index")
    one = F.concat(F.lit("tool_call:"), shape())
    rows = calls.select("trace_id", "step_index", one.alias("g1"), F.row_number().over(w).alias("pos"), F.lead(one, 1).over(w).alias("g2"), F.lead(one, 2).over(w).alias("g3"))
    grams = F.array(F.struct(F.lit(1).alias("n"), F.col("g1").alias("gram")), F.struct(F.lit(2).alias("n"), F.when(F.col("g2").isNotNull(), F.concat_ws("|", "g1", "g2")).alias("gram")), F.struct(F.lit(3).alias("n"), F.when(F.col("g3").isNotNull(), F.concat_ws("|", "g1", "g2", "g3")).alias("gram")))
    return rows.select("trace_id", "pos", F.explode(grams).alias("x")).select("trace_id", "pos", F.col("x.n").cast("long").alias("n"), F.col("x.gram").alias("gram")).where("gram is not null")


def precursors(steps: DataFrame, traces: DataFrame) -> DataFrame:
    """n, gram, occurrences, failures, p_fail: how often traces with a run of calls fail."""
    rows = ngrams(steps).join(traces.select("trace_id", "success"), "trace_id")
    return rows.groupBy("n", "gram").agg(F.count("*").alias("occurrences"), F.count_if(F.col("success") == False).alias("failures")).withColumn("p_fail", (F.col("failures") + 1.0) / (F.col("occurrences") + 2.0))  # noqa: E712


def precursor_score(steps: DataFrame, model: DataFrame) -> DataFrame:
    """trace_id, probability: of each length the run that was observed most (the first of such) votes, weighted by how often
    (at most 20) and by its length. The model grows with the kinds of runs only."""
    rows = ngrams(steps).join(model.select("n", "gram", "occurrences", "p_fail"), ["n", "gram"])
    best = rows.groupBy("trace_id", "n").agg(F.min_by(F.struct("occurrences", "p_fail"), F.struct(-F.col("occurrences"), "pos")).alias("x"))
    weight = F.least("x.occurrences", F.lit(20)) * F.col("n")
    out = best.groupBy("trace_id").agg((F.sum(weight * F.log(F.col("x.p_fail") / (1 - F.col("x.p_fail")))) / F.sum(weight)).alias("z"))
    return out.select("trace_id", (1 / (1 + F.exp(-F.col("z")))).alias("probability"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = successes / n
    middle, wide = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    empty = n == 0
    return F.when(empty, 0.0).otherwise(F.greatest(F.lit(0.0), middle - wide)), F.when(empty, 0.0).otherwise(F.least(F.lit(1.0), middle + wide))


def prf(pairs: DataFrame) -> DataFrame:
    """mode, tp, fp, fn, precision, recall, f1, low, high (Wilson bounds of precision). pairs: mode, predicted, gold."""
    rows = pairs.groupBy("mode").agg(F.count_if(F.expr("predicted and gold")).alias("tp"), F.count_if(F.expr("predicted and not gold")).alias("fp"), F.count_if(F.expr("not predicted and gold")).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    low, high = wilson(tp, tp + fp)
    return rows.select("mode", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), low.alias("low"), high.alias("high"))


def ece(pairs: DataFrame) -> DataFrame:
    """bin, n, gap: ten bins of confidence with the distance of its mean from the accuracy, weighted by their rows.
    pairs: confidence, correct."""
    total = pairs.count()
    rows = pairs.groupBy(F.least(F.lit(9), F.floor(F.col("confidence") * 10)).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.avg(F.col("correct").cast("double")).alias("a"))
    return rows.select("bin", "n", (F.col("n") / total * F.abs(F.col("c") - F.col("a"))).alias("gap"))
