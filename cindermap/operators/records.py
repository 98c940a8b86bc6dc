"""Points of interest and loop records: grouping, ranking, charts, allocation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.sources.shared import staged, tasks


def search_by_name(pois: DataFrame, name: str, exact: bool = False) -> DataFrame:
    own = F.lower(F.coalesce("name", F.lit("")))
    return pois.where(own == name.lower() if exact else own.contains(name.lower()))


def matching(pois: DataFrame, pattern: str) -> DataFrame:
    """Names that match a regular expression, case-insensitively."""
    return pois.where(F.coalesce("name", F.lit("")).rlike(f"(?i){pattern}"))


def attribute_in(rows: DataFrame, name: str, allowed: list[str]) -> DataFrame:
    """Any trimmed comma token is allowed; case matters."""
    return rows.where(F.arrays_overlap(F.transform(F.split(F.col(name), ","), lambda t: F.trim(t)), F.array(*[F.lit(a) for a in allowed])))


def only_named(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``name`` is one of ``wanted``'s; all rows if none is. Repeated and null names in ``wanted`` change nothing."""
    named = wanted.select(name).distinct().withColumn("_hit", F.lit(True))
    names = staged(rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n")).join(named, name, "left"), "names")
    total, some = names.agg(F.sum("_n"), F.bool_or("_hit")).first()
    if not some:
        return rows
    # Names that would fill a task by themselves are no more than there are tasks; the rest are dealt out by name.
    often = F.col("_n") >= total / tasks(rows)
    common, rare = names.where(often), names.where(~often & F.col("_hit"))
    out = rows.join(F.broadcast(common.where("_hit").select(name)), name, "left_semi").select(*rows.columns)
    if rare.isEmpty():
        return out
    rest = rows.join(F.broadcast(common.select(name)), name, "left_anti")
    return out.unionByName(rest.join(rare.select(name).hint("merge"), name, "left_semi"))


def group_by(rows: DataFrame, key: Column, amount: Column | None = None) -> DataFrame:
    """Count (and sum, rounded half to even, null where 0) by the first token of a comma list; null keys are left out."""
    first = F.trim(F.get(F.split(key.cast("string"), ","), F.lit(0)))
    agg = [F.count(F.lit(1)).alias("count")]
    if amount is not None:
        agg.append(F.bround(F.sum(amount), 2).alias("sum"))
    out = rows.where(key.isNotNull()).groupBy(first.alias("group")).agg(*agg)
    return out if amount is None else out.withColumn("sum", F.when(F.col("sum") != 0, F.col("sum")))


def dominant_class(counts: DataFrame, by: str) -> DataFrame:
    """For each item, the class with most pixels (the smaller on ties) of rows (by, class, n)."""
    return counts.groupBy(by).agg(F.max_by("class", F.struct("n", -F.col("class"))).alias("damage_class"))


def exposure(damage: DataFrame, population: DataFrame, least: float) -> DataFrame:
    """Join by name (the last row of a repeated name counts), damage at least ``least``; most people first."""
    last = population.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("pos")))).where("_n = 1").select("name", "population")
    return damage.join(last, "name").where(F.col("damage").isNotNull() & F.col("population").isNotNull() & (F.col("damage") >= least)).orderBy(F.desc("population"), F.desc("damage"), "name")


def reduce_by(rows: DataFrame, by: str, value: str, index: str, mode: str) -> DataFrame:
    """Best value and its index of each loop (first on ties); or the mean. Nulls are skipped."""
    if mode == "mean":
        return rows.groupBy(by).agg(F.avg(value).alias("best_value"))
    kept = rows.where(F.col(value).isNotNull())
    key = F.struct(F.col(value), -F.col(index)) if mode == "max" else F.struct(-F.col(value), -F.col(index))
    return kept.groupBy(by).agg((F.max if mode == "max" else F.min)(value).alias("best_value"), F.max_by(index, key).alias("best_index"))


def chart_data(rows: DataFrame, label: Column, fallback: Column, value: Column, top_k: int, digits: int, by: Column | None = None) -> DataFrame:
    """Labelled values of the rows largest by ``by`` (the value itself, if not given), not rounded yet; repeated labels get a number, the largest rounded value first; rounded half to even."""
    named = rows.select("id", F.coalesce(F.when(F.trim(label) != "", label), fallback).alias("label"), value.cast("double").alias("value"), (value if by is None else by).alias("by")).where("value IS NOT NULL")
    top = named.orderBy(F.desc("by"), "id").limit(top_k).withColumn("value", F.bround("value", digits))
    again = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("value"), "id"))
    return top.withColumn("n", again).select("id", F.when(F.col("n") > 1, F.concat("label", F.lit(" ("), F.col("n"), F.lit(")"))).otherwise(F.col("label")).alias("label"), "value")


def priority_score(rows: DataFrame, criteria: dict[str, float], top_k: int) -> DataFrame:
    score = sum((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w for f, w in criteria.items()), F.lit(0.0))
    return rows.withColumn("score", score).orderBy(F.desc("score"), "id").limit(top_k)


def allocate(demands: DataFrame, by: str, supply: float, least: float) -> DataFrame:
    """First ``least`` to each site in order while supply lasts; the rest is shared out by how far needs exceed ``least``.

    ``demands``: by, id, need, and optionally cap, which a site's allocation does not pass. Shares do not stop at the need, and
    nothing that a cap leaves over is given again.
    """
    order = Window.partitionBy(by).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    # Each site asks for the same, so what went before it is a count.
    before = F.count(F.lit(1)).over(order) * least
    base = F.greatest(F.lit(0.0), F.least(F.lit(float(least)), supply - before))
    above = F.greatest(F.lit(0.0), F.coalesce(F.col("need"), F.lit(0)) - least)
    rows = demands.withColumn("base", base).withColumn("above", above)
    totals = rows.groupBy(by).agg((supply - F.sum("base")).alias("left"), F.sum("above").alias("total"))
    extra = F.col("above") / F.col("total") * F.col("left")
    if "cap" in demands.columns:
        extra = F.least(extra, F.coalesce(F.col("cap"), F.lit(float("inf"))) - F.col("base"))
    extra = F.when((F.col("total") > 0) & (F.col("left") > 0), F.greatest(F.lit(0.0), extra)).otherwise(0.0)
    return rows.join(totals, by).select(by, "id", "need", (F.col("base") + extra).alias("allocated"))


def loop_windows(cells: DataFrame, height: int, width: int, n: int, value: Column) -> DataFrame:
    """A statistic for each of n x n windows of each raster, the loop as one grouped plan."""
    i = F.least(F.lit(n - 1), F.floor(F.col("r") / (height // n))).cast("int")
    j = F.least(F.lit(n - 1), F.floor(F.col("c") / (width // n))).cast("int")
    return cells.groupBy("raster_id", i.alias("row_idx"), j.alias("col_idx")).agg(value.alias("value"))
