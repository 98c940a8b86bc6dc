"""What a report says without a language model: roles of images, what a question asks for, the fall-back summary, and where panels stand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindermap.functions.answers import path_stem

#: Words in a file's name and the role they give it, in order.
ROLES = (
    (("before_after",), "before_after_panel"), (("board",), "situation_board"), (("chart", "bar", "pie", "line"), "chart"), (("report",), "report_page"), (("damage", "overlay", "map"), "damage_or_hazard_map"),
)
#: Words of a question and what it then asks for.
MODES = {
    "needs_recommendations": ("recommend", "recovery", "restore", "restoration", "repair", "rebuild", "reconstruction"),
    "report_style": ("report", "briefing", "summary", "situation", "overview", "board"),
    "image_focused": ("image", "scene", "caption", "visual", "remote sensing"),
}
#: The sentences of the fall-back.
ALONE = "LLM summary unavailable; using trajectory statistics only."
WITH_IMAGES = "Image-aware LLM summary unavailable; using trajectory statistics only."
NOTHING = "no prominent quantitative statistics were extracted"
RECOVERY = " Recovery should prioritize critical infrastructure, housing, and environmental stabilization in that order where feasible."
SHOWN = 4


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def image_role(path: Column) -> Column:
    """The role of an image by the words in its file's name; the first rule that fits counts."""
    name = F.lower(path_stem(path))
    role = None
    for words, told in ROLES:
        role = F.when(_any(name, words), told) if role is None else role.when(_any(name, words), told)
    return role.when(name.contains("pre") & ~name.contains("post"), "pre_disaster_image").when(name.contains("post"), "post_disaster_image").otherwise("context_image")


def task_mode(question: Column) -> dict[str, Column]:
    """What a question asks for; null questions ask for nothing."""
    q = F.lower(F.coalesce(question, F.lit("")))
    return {name: _any(q, words) for name, words in MODES.items()}


def fallback(tasks: DataFrame, statistics: DataFrame, by: str) -> DataFrame:
    """``by``, summary, recommendations (whether three stand in it) and confidence of tasks (``by``, question, images: a number). The first ``SHOWN``
    statistics (``by``, place, key, value) are named in their order; tasks without any say so."""
    shown = statistics.where(F.col("place") <= SHOWN).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(F.col("key"), F.lit("="), F.col("value").cast("string")).alias("text")))), lambda s: s["text"]), ", ").alias("shown"))
    asks = task_mode(F.col("question"))["needs_recommendations"]
    summary = F.concat(F.when(F.coalesce("images", F.lit(0)) > 0, WITH_IMAGES).otherwise(ALONE), F.lit(" Key outputs include "), F.coalesce("shown", F.lit(NOTHING)), F.lit("."), F.when(asks, RECOVERY).otherwise(""))
    return tasks.join(shown, by, "left").select(by, summary.alias("summary"), asks.alias("recommendations"), F.lit("low").alias("confidence"))


def panels(images: DataFrame, by: str, place: str, columns: int = 2, width: int = 420, height: int = 320) -> DataFrame:
    """Where the images of a temporal panel stand: row, col, x, y of each, row by row (``place`` counts from 0), and its label t1, t2..."""
    n = max(1, columns)
    row, col = F.floor(F.col(place) / n).cast("int"), (F.col(place) % n).cast("int")
    return images.select(by, place, row.alias("row"), col.alias("col"), (20 + col * (width + 20)).alias("x"), (70 + row * (height + 40)).alias("y"), F.concat(F.lit("t"), (F.col(place) + 1).cast("string")).alias("label"))


def wrapped(text: Column, width: int = 48) -> Column:
    """Words put together to lines of at most ``width`` letters; a longer word has a line of its own."""

    def add(lines: Column, word: Column) -> Column:
        last = F.element_at(lines, -1)
        fits = F.length(last) + 1 + F.length(word) <= width
        return F.when(F.size(lines) == 0, F.array(word)).when(fits, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat(last, F.lit(" "), word)))).otherwise(F.concat(lines, F.array(word)))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.aggregate(words, F.array().cast("array<string>"), add)
