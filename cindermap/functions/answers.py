"""Column functions over answers and manifests kept as JSON text: parsing, coercion, paths, keys, ratios, pixel sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cindermap.functions.scalar import once

#: Endings by which a manifest's text is a file.
FILE_ENDINGS = (".png", ".tif", ".tiff", ".jpg", ".jpeg", ".geojson", ".json", ".shp")


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value. The parser stops after the first; only one value alone fits into a list and into an object."""
    within = lambda before, after: F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))).isNotNull()
    return within("[", "]") & within('{"v":', "}")


def json_object(text: Column) -> Column:
    """The text if it is one JSON object, else null."""
    t = F.trim(text)
    return F.when(t.startswith("{") & is_json(t), t)


def parsed_answer(text: Column) -> Column:
    """The first JSON object of an answer as text; null if it has none (the answer then counts as plain text).

    Looks inside <Answer> tags and code fences; takes the whole, else the first balanced block that parses. Empty and null texts have none.
    """
    inside = lambda t, pattern: F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(t)
    body = F.trim(inside(inside(text, r"(?is)<answer>\s*(.+?)\s*</answer>"), r"(?s)```(?:json|JSON)?\s*\n?(.*?)\n?\s*```"))
    # Pieces that end with a brace; what is open is the text since the outermost brace.
    pieces = F.regexp_extract_all(body, F.lit(r"([^{}]*[{}])"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<string>").alias("blocks"))

    def step(state: Column, piece: Column) -> Column:
        opens = piece.endswith("{")
        depth = state["depth"] + F.when(opens, 1).otherwise(-1)
        text = F.when(opens & (state["depth"] == 0), F.lit("{")).when(state["depth"] > 0, F.concat(state["open"], piece)).otherwise(F.lit(""))
        closed = ~opens & (depth == 0)
        return F.struct(depth.alias("depth"), F.when(closed, "").otherwise(text).alias("open"), F.when(closed, F.concat(state["blocks"], F.array(text))).otherwise(state["blocks"]).alias("blocks"))

    blocks = F.aggregate(pieces, start, step, lambda s: s["blocks"])
    return F.coalesce(json_object(body), F.get(F.filter(blocks, lambda b: json_object(b).isNotNull()), F.lit(0)))


def coerced(value: Column) -> Column:
    """An argument as JSON text: text that itself is a JSON list or object becomes that, any other text a JSON string."""
    t = F.trim(value)
    nested = (t.startswith("[") & t.endswith("]")) | (t.startswith("{") & t.endswith("}"))
    quoted = F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    return F.when(nested & is_json(t), t).otherwise(F.when(value.isNotNull(), quoted))


def resolved_paths(manifest: Column, folder: str) -> Column:
    """A JSON manifest in which each value that ends like a file, and is not absolute, lies in ``folder``; keys stay."""
    endings = "|".join(e[1:] for e in FILE_ENDINGS)
    own = folder.rstrip("/").replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(manifest, rf'(?i)"(?!/)((?:[^"\\]|\\.)*\.(?:{endings}))"(?!\s*:)', f'"{own}/$1"')


def looks_like_path(text: Column) -> Column:
    """A separator and an ending of 1 to 6 letters, or the start of a path; at least four letters."""
    ending = text.rlike(r"\.\w{1,6}$") & text.rlike(r"[/\\]")
    return F.coalesce((F.length(text) >= 4) & (ending | text.rlike(r"^(/|D:|C:|\./|\.\./|~)")), F.lit(False))


def path_stem(text: Column) -> Column:
    """A file's name without folders and its last ending."""
    return F.regexp_replace(F.regexp_extract(text, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")


def ratio_number(text: Column) -> Column:
    """Number of a text that may end with percent signs; null if it is none."""
    return F.regexp_replace(F.trim(text.cast("string")), r"%+$", "").try_cast("double")


def is_ratio_name(field: Column) -> Column:
    """Field names that mean a share: percentage, pct, ratio or share."""
    return F.lower(field).rlike(r"percentage|_pct|pct$|_ratio|ratio$|_share|share$")


def same_key(key: Column) -> Column:
    """One spelling of a key: "Phase 2", "phase_2" and "P2" are p2, "phase t1" is t1, "rank 3" is 3; else words joined by _, the last in singular."""

    def spelled(s: Column) -> Column:
        found = lambda pattern: F.regexp_extract(s, pattern, 1)
        t, p, rank = found(r"^(?:phase[\s_]*t|t[\s_]*)(\d+)$"), found(r"^(?:phase[\s_]*|p[\s_]*)(\d+)$"), found(r"^rank[\s_]*(\d+)$")
        words = F.trim(F.regexp_replace(s, r"[\s\-_]+", "_"), F.lit("_"))
        singular = F.regexp_replace(words, r"(?<=[^_]{2}[^_s])s$", "")
        return F.when(t != "", F.concat(F.lit("t"), t)).when(p != "", F.concat(F.lit("p"), p)).when(rank != "", rank).otherwise(singular)

    return once(F.lower(F.trim(key.cast("string"))), spelled)


def pixel_size(manifest: Column) -> Column:
    """Metres a pixel of a manifest: of pre_image, post_image, or the first of temporal_images that states it; null without."""
    at = lambda path: F.get_json_object(manifest, path).try_cast("double")
    images = F.map_values(F.from_json(F.get_json_object(manifest, "$.temporal_images"), "map<string,struct<pixel_size_m:double>>"))
    first = F.get(F.filter(F.transform(images, lambda i: i["pixel_size_m"]), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(at("$.pre_image.pixel_size_m"), at("$.post_image.pixel_size_m"), first)
