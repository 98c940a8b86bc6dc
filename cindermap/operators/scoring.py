"""Scores of answers and of trajectories, and their averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.functions.scalar import EARTH_M, canonical


def close(gold: Column, pred: Column, absolute: float = 1.0, relative: float = 0.2) -> Column:
    """1 if equal or within absolute + relative * |gold|; NaN is close to NaN alone; a missing prediction scores 0."""
    g, p = gold.cast("double"), pred.cast("double")
    near = (p == g) | (F.abs(p - g) <= absolute + relative * F.abs(g))
    return F.when(F.isnan(g) | F.isnan(p), (F.isnan(g) & F.isnan(p)).cast("double")).otherwise(F.coalesce(near.cast("double"), F.lit(0.0)))


def ratio_close(gold: Column, pred: Column, absolute: float = 0.0) -> Column:
    """Fractions and percentages are one: if exactly one side is at most 1.5, the prediction is also tried in the gold's form, with the same tolerance."""
    plain = close(gold, pred, absolute)
    small_gold, small_pred = F.abs(gold) <= 1.5, F.abs(pred) <= 1.5
    scaled = F.when(small_gold & ~small_pred, close(gold, pred / 100, absolute)).when(small_pred & ~small_gold, close(gold, pred * 100, absolute)).otherwise(0.0)
    return F.greatest(plain, scaled)


def exact(gold: Column, pred: Column) -> Column:
    return F.coalesce((canonical(gold) == canonical(pred)).cast("double"), F.lit(0.0))


def set_f1(gold: Column, pred: Column) -> Column:
    """F1 of two arrays as sets; 1 if both are empty, 0 if one is."""
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    both = F.size(F.array_intersect(g, p))
    return F.when((F.size(g) == 0) & (F.size(p) == 0), 1.0).when((F.size(g) == 0) | (F.size(p) == 0), 0.0).otherwise(2.0 * both / (F.size(g) + F.size(p)))


def dict_score(gold: DataFrame, pred: DataFrame, by: list[str], key: str, value: str) -> DataFrame:
    """Mean closeness over the gold keys; keys that only the prediction has are free."""
    own = gold.select(*by, key, F.col(value).alias("g")).join(pred.select(*by, key, F.col(value).alias("p")), [*by, key], "left")
    return own.groupBy(*by).agg(F.avg(close(F.col("g"), F.col("p"))).alias("score"))


def ranking_score(gold: DataFrame, pred: DataFrame, by: str, item: str, rank: str) -> DataFrame:
    """(tau + 1) / 2 over the items both rankings have: the share of pairs in one order; ranks are distinct.

    With fewer than two common items: 1 if both rank the same items, else 0. One row for each gold ranking.
    """
    g = gold.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(item).alias("x")))).alias("g"))
    p = pred.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(item, rank))).alias("p"))
    ranks = F.filter(F.transform("g", lambda e: F.try_element_at("p", e["x"])), lambda r: r.isNotNull())
    rows = g.join(p, by, "left").withColumn("s", F.coalesce(ranks, F.array().cast(f"array<{pred.schema[rank].dataType.simpleString()}>")))
    n = F.size("s")
    later = F.transform("s", lambda v, i: F.size(F.filter(F.slice("s", i + 2, F.greatest(F.lit(0), n - i - 1)), lambda w: w > v)))
    same = (n == F.size("g")) & (n == F.coalesce(F.size("p"), F.lit(0)))
    share = F.aggregate(later, F.lit(0), lambda a, x: a + x) / (n * (n - 1) / 2)
    return rows.select(by, F.when(n < 2, same.cast("double")).otherwise(share).alias("score"))


def point_score(row: Column, col: Column, gold_row: Column, gold_col: Column, most: float = 20.0) -> Column:
    """1 within ``most`` pixels; missing coordinates count as 0."""
    z = [F.coalesce(x.cast("double"), F.lit(0.0)) for x in (row, col, gold_row, gold_col)]
    return (F.sqrt((z[0] - z[2]) * (z[0] - z[2]) + (z[1] - z[3]) * (z[1] - z[3])) <= most).cast("double")


def haversine_score_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def rect_iou(a: str, b: str) -> Column:
    """Intersection over union of two rectangles given as columns a_x0..., b_x0...."""
    c = lambda p, n: F.col(f"{p}{n}")
    w = F.greatest(F.lit(0), F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0")))
    h = F.greatest(F.lit(0), F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0")))
    area = lambda p: (c(p, "x1") - c(p, "x0")) * (c(p, "y1") - c(p, "y0"))
    return w * h / (area(a) + area(b) - w * h)


def sequences(steps: DataFrame, by: str) -> DataFrame:
    """Calls of each trajectory in order, as an array; wrapper steps are left out."""
    kept = steps.where(~F.col("call").isin("tool.loop", "tool.reduce"))
    return kept.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "call"))), lambda s: s["call"]).alias("calls"))


def of_nothing(pred: Column) -> Column:
    """The score where gold has no steps: 1 if the prediction has none either, else 0."""
    return (F.size(pred) == 0).cast("double")


def recall(gold: Column, pred: Column) -> Column:
    g = F.array_distinct(gold)
    return F.when(F.size(g) == 0, of_nothing(pred)).otherwise(F.size(F.array_intersect(g, pred)) / F.size(g))


def prefix(gold: Column, pred: Column) -> Column:
    """Length of the common prefix over the gold length."""
    same = F.zip_with(gold, pred, lambda g, p: F.coalesce(g == p, F.lit(False)))
    first = F.array_position(same, False)
    n = F.when(first == 0, F.size(same)).otherwise(first - 1)
    return F.when(F.size(gold) == 0, of_nothing(pred)).otherwise(F.least(n, F.size(gold)) / F.size(gold))


def efficiency(gold: Column, pred: Column) -> Column:
    longest = F.greatest(F.size(gold), F.size(pred))
    return F.when(longest == 0, 1.0).otherwise(F.size(gold) / longest)


def lcs(gold: Column, pred: Column) -> Column:
    """Longest common subsequence over the gold length: one row of the table is the state of a fold over gold."""
    start = F.transform(F.sequence(F.lit(0), F.size(pred)), lambda _: F.lit(0))

    def row(before: Column, g: Column) -> Column:
        steps = F.zip_with(pred, F.sequence(F.lit(1), F.size(pred)), lambda p, j: F.struct(p.alias("p"), j.alias("j")))
        return F.aggregate(steps, F.array(F.lit(0)), lambda out, s: F.concat(out, F.array(F.when(s["p"] == g, F.get(before, s["j"] - 1) + 1).otherwise(F.greatest(F.get(before, s["j"]), F.element_at(out, -1))))))

    both = F.aggregate(gold, start, row)
    return F.when(F.size(gold) == 0, of_nothing(pred)).when(F.size(pred) == 0, 0.0).otherwise(F.element_at(both, -1) / F.size(gold))


def parameter_accuracy(gold: DataFrame, pred: DataFrame, by: str) -> DataFrame:
    """Steps are compared place by place; a step with another call scores 0, else the share of its gold arguments (a map of numbers) that are close."""
    both = gold.select(by, "step", F.col("call").alias("g"), F.col("args").alias("ga")).join(pred.select(by, "step", F.col("call").alias("p"), F.col("args").alias("pa")), [by, "step"], "left")
    near = F.aggregate(F.map_entries("ga"), F.lit(0.0), lambda n, e: n + close(e["value"], F.try_element_at(F.col("pa"), e["key"])))
    share = F.when(F.col("g") == F.col("p"), F.when(F.size("ga") > 0, near / F.size("ga")).otherwise(1.0)).otherwise(0.0)
    there = pred.select(by).distinct()
    return both.groupBy(by).agg(F.avg(F.coalesce(share, F.lit(0.0))).alias("score")).join(there, by, "left_semi")


def averages(scores: DataFrame, dimension: str, task: str, score: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Task means, dimension means of tasks, and the plain mean of dimensions."""
    tasks = scores.groupBy(dimension, task).agg(F.avg(score).alias("score"))
    dims = tasks.groupBy(dimension).agg(F.avg("score").alias("score"), F.count("score").alias("tasks"))
    return tasks, dims, dims.agg(F.avg("score").alias("score"))


def merged_predictions(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last of repeated predictions."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
