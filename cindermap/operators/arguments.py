"""Arguments of tool calls as nested JSON: walked to their leaves in Spark, coerced, and compared by type.

A walk takes one round a level of nesting; every round is written to the shared folder. A node's path joins keys and places by /,
with / and ~ in keys written as ~1 and ~0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindermap.functions.answers import looks_like_path
from cindermap.functions.scalar import normalize_text, normalize_tool
from cindermap.operators.scoring import close
from cindermap.sources.shared import spread, staged

#: Steps that are no calls of their own, and a gold value that a run fills in.
WRAPPERS = ("tool.loop", "tool.reduce")
REFERENCE = r"^<\w+>\s+from\s+trajectory\[\d+\]\.obs$"


def _kind(value: Column) -> Column:
    """object, array, string, boolean, number or null of a variant."""
    t = F.schema_of_variant(value)
    return F.when(value.isNull() | F.is_variant_null(value), "null").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").otherwise("number")


def walked(rows: DataFrame, keys: list[str], text: str, coerce: bool = False) -> DataFrame:
    """Every node of the JSON texts of column ``text``: ``keys``, path, kind, size (of lists and objects) and leaf (a scalar's text).

    With ``coerce``, strings that hold a JSON list or object are that, at any depth. Texts that are not JSON have one node of kind null.
    """
    level, nodes = spread(rows.select(*keys, text), *keys).select(*keys, F.lit("").alias("path"), F.try_parse_json(text).alias("value")), None
    while True:
        if coerce:
            inner = F.trim(F.try_variant_get("value", "$", "string"))
            boxed = (inner.startswith("[") & inner.endswith("]")) | (inner.startswith("{") & inner.endswith("}"))
            parsed = F.when((_kind(F.col("value")) == "string") & boxed, F.try_parse_json(inner))
            level = level.withColumn("value", F.coalesce(parsed, "value"))
            # What came out of a string may be a string of that kind again only within; it is walked like any other.
        told = level.select(*keys, "path", _kind(F.col("value")).alias("kind"), "value")
        held = F.col("kind").isin("array", "object")
        told = told.select(*keys, "path", "kind", F.when(held, F.to_json("value")).alias("json"), F.when(~held & (F.col("kind") != "null"), F.try_variant_get("value", "$", "string")).alias("leaf"))
        size = F.when(F.col("kind") == "array", F.json_array_length("json")).when(F.col("kind") == "object", F.size(F.json_object_keys("json")))
        told = staged(told.select(*keys, "path", "kind", size.alias("size"), "leaf", "json"), "nodes")
        nodes = told.drop("json") if nodes is None else nodes.unionByName(told.drop("json"))
        inside = told.where("size > 0")
        if inside.isEmpty():
            return nodes
        step = F.coalesce(F.replace(F.replace("key", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.col("pos").cast("string"))
        each = inside.withColumn("v", F.parse_json("json")).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()))
        level = each.select(*keys, F.concat("path", F.lit("/"), step).alias("path"), "value")


def flat_steps(steps: DataFrame, by: str) -> DataFrame:
    """``by``, i (from 0), call (in one spelling), args, obs of the steps (``by``, step, call, args, obs) that are no wrappers."""
    place = F.row_number().over(Window.partitionBy(by).orderBy("step")) - 1
    return steps.where(~F.coalesce("call", F.lit("")).isin(*WRAPPERS)).select(by, place.alias("i"), normalize_tool(F.col("call")).alias("call"), "args", "obs")


def outputs(flat: DataFrame, by: str) -> DataFrame:
    """Paths that steps put out: ``by``, file, i (the last step that did). Looked for in the top level of observations (objects, JSON texts or
    ``{"text": JSON}``, one or a list of them) and in arguments whose names start with ``output``."""
    tvf = flat.sparkSession.tvf
    obs = flat.select(by, "i", F.try_parse_json("obs").alias("o")).where("o IS NOT NULL")
    listed = obs.withColumn("items", F.when(_kind(F.col("o")) == "array", F.col("o")).otherwise(F.parse_json(F.concat(F.lit("["), F.to_json("o"), F.lit("]")))))
    items = listed.select(by, "i", "items").lateralJoin(tvf.variant_explode(F.col("items").outer())).select(by, "i", F.col("value").alias("item"))
    text = F.when(_kind(F.col("item")) == "string", F.try_variant_get("item", "$", "string")).otherwise(F.try_variant_get("item", "$.text", "string"))
    found = items.select(by, "i", F.when(F.coalesce(text, F.lit("")) != "", F.try_parse_json(text)).when(_kind(F.col("item")) == "object", F.col("item")).alias("d"))
    args = flat.select(by, "i", F.try_parse_json("args").alias("d"))
    told = lambda rows: rows.where(_kind(F.col("d")) == "object").lateralJoin(tvf.variant_explode(F.col("d").outer())).select(by, "i", "key", F.try_variant_get("value", "$", "string").alias("file"))
    both = told(found).unionByName(told(args).where(F.col("key").startswith("output")))
    return both.where(looks_like_path(F.col("file"))).groupBy(by, "file").agg(F.max("i").alias("i"))


def _base(file: Column) -> Column:
    return F.regexp_extract(F.replace(file, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def _without_hashes(base: Column) -> Column:
    """A file's name without ``_<6 to 10 hexadecimal digits>`` before its ending."""
    ending = F.regexp_extract(base, r"[^.](\.[^.]*)$", 1)
    name = F.substring(base, F.lit(1), F.length(base) - F.length(ending))
    return F.concat(F.regexp_replace(name, r"_[0-9a-f]{6,10}(?=_|$)", ""), ending)


def parameter_accuracy(gold: DataFrame, pred: DataFrame, by: str) -> DataFrame:
    """``by``, score: over the gold steps, the mean share of arguments that the prediction's step at the same place shares, if it calls the same tool.

    Steps have ``by``, step, call, args and obs (JSON texts). Numbers are equal within 1 + 20 %; texts by spelling; booleans, lists and objects by
    value, item by item; a reference to an observation by any value. Files are equal by role: both inputs, or put out by the same step (or, if
    only one side's output is known, by the same tool at that place), or named alike up to hashes. A step without arguments scores 1. Without
    gold steps: 1 if the prediction has none.
    """
    sides = {s: staged(flat_steps(x, by), "steps") for s, x in (("g", gold), ("p", pred))}
    # The tables below are written compactly and all grow with the tasks: no join sends one to every task, whatever its files' size promises.
    tasks = gold.select(by).union(pred.select(by)).distinct()
    nodes = {s: walked(x, [by, "i"], "args") for s, x in sides.items()}
    g, p = (x.select(by, "i", "path", *[F.col(c).alias(f"{s}_{c}") for c in ("kind", "size", "leaf")]) for s, x in nodes.items())
    rows = g.where("path <> ''").join(p.hint("merge"), [by, "i", "path"], "left")
    call = {s: sides[s].select(by, F.col("i").alias("from"), F.col("call").alias(f"{s}_call")) for s in sides}
    same = call["g"].join(call["p"].hint("merge"), [by, "from"]).where(F.col("g_call") == F.col("p_call")).select(by, "from", F.lit(True).alias("same"))
    for s in ("g", "p"):  # who put a file out, and whether both sides call one tool there
        made = outputs(sides[s], by).withColumnRenamed("i", "from").join(same.hint("merge"), [by, "from"], "left")
        rows = rows.join(made.select(by, F.col("file").alias(f"{s}_leaf"), F.col("from").alias(f"{s}_from"), F.coalesce("same", F.lit(False)).alias(f"{s}_same")).hint("merge"), [by, f"{s}_leaf"], "left")
    gv, pv = F.col("g_leaf"), F.coalesce("p_leaf", F.when(F.col("p_kind") == "null", "None"))
    kind, there = F.col("g_kind"), F.col("p_kind").isNotNull()
    made_g, made_p = F.col("g_from").isNotNull(), F.col("p_from").isNotNull()
    role = (~made_g & ~made_p) | (made_g & made_p & (F.col("g_from") == F.col("p_from"))) | (made_g & ~made_p & F.col("g_same")) | (made_p & ~made_g & F.col("p_same"))
    alike = ((_base(gv) != "") & (_base(gv) == _base(pv))) | ((_without_hashes(_base(gv)) != "") & (_without_hashes(_base(gv)) == _without_hashes(_base(pv))))
    named = normalize_text(gv) == normalize_text(pv)
    file = looks_like_path(gv) | looks_like_path(pv)
    number = F.when(F.col("p_kind") == "boolean", (F.col("p_leaf") == "true").cast("double")).when(F.col("p_kind").isin("number", "string"), F.col("p_leaf").try_cast("double"))
    truth = F.when(F.col("p_kind") == "boolean", F.col("p_leaf") == gv).when(F.col("p_kind") == "number", F.col("p_leaf").try_cast("double") == F.when(gv == "true", 1.0).otherwise(0.0))
    match = F.when(kind.isin("object", "array"), (F.col("p_kind") == kind) & (F.col("p_size") == F.col("g_size")))
    match = match.when((kind == "string") & gv.rlike(REFERENCE), F.col("p_kind") != "null").when(kind == "number", close(gv.try_cast("double"), number) == 1.0)
    match = match.when((kind == "string") & file, named | role | alike).when(kind == "string", named).when(kind == "boolean", truth).otherwise(pv == "None")
    argument = F.get(F.split("path", "/"), F.lit(1))
    shared = rows.withColumn("ok", there & F.coalesce(match, F.lit(False))).groupBy(by, "i", argument.alias("argument")).agg(F.bool_and("ok").alias("ok"))
    shares = shared.groupBy(by, "i").agg(F.avg(F.col("ok").cast("double")).alias("share"))
    steps = sides["g"].select(by, "i", "call").join(sides["p"].select(by, "i", F.col("call").alias("own")).hint("merge"), [by, "i"], "left").join(shares.hint("merge"), [by, "i"], "left")
    score = F.when(F.col("call") == F.col("own"), F.coalesce("share", F.lit(1.0))).otherwise(0.0)
    scores = steps.groupBy(by).agg(F.avg(score).alias("score"))
    empty = sides["p"].select(by).distinct().withColumn("some", F.lit(True))
    return tasks.join(scores.hint("merge"), by, "left").join(empty.hint("merge"), by, "left").select(by, F.coalesce("score", F.when(F.col("some"), 0.0).otherwise(1.0)).alias("score"))
