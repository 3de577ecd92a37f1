"""Road names: grouping keys, normal forms, tokens and aliases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names that mean "no name", and trailing words that mark a fragment of a
# larger road (side road, main line, bridge, ramp, exit, link, tunnel, toll gate …).
NO_NAME = ["", "unnamed", "unknown", "null"]
FRAGMENT_WORDS = [
    "辅路",
    "主路",
    "主线",
    "桥区",
    "跨线桥",
    "立交桥",
    "高架桥",
    "匝道",
    "出口",
    "入口",
    "连接线",
    "联络线",
    "引桥",
    "掉头专用道",
    "掉头车道",
    "停车区",
    "服务区",
    "收费站",
    "环岛",
    "隧道",
    "桥",
]
FRAGMENT_SUFFIX = "(?:" + "|".join(FRAGMENT_WORDS) + ")+$"
BRACKET_SUFFIX = r"(?:\([^)]*\)|（[^）]*）)$"

# Expressway names and the route they belong to, tried in this order.
EXPRESSWAY_ROUTES = [
    ("京藏高速", "g6"),
    ("八达岭高速", "g6"),
    ("京新高速", "g7"),
    ("京承高速", "g45"),
    ("大广高速", "g45"),
    ("京港澳高速", "g4"),
    ("京昆高速", "g5"),
    ("京沪高速", "g2"),
    ("京哈高速", "g1"),
    ("京沈高速", "g1"),
    ("机场高速", "airport"),
]
CHINESE_DIGITS = "一二三四五六七八九十"
ROUTE_CODE = r"(?<![\p{L}\p{N}_])([gsx]\d+[a-z]?)(?![\p{L}\p{N}_])"
FAST_ROAD_SUFFIX = "(?:高速公路|高速|快速路|快速)$"
CORRIDOR_CLASSES = ["motorway", "trunk", "primary"]
TOKEN_CLASSES = [*CORRIDOR_CLASSES, "secondary"]


def group_key(name: Column, road_id: Column) -> Column:
    """Trimmed name, or a key of its own for nameless roads."""
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("edge:"), road_id.cast("string")))


def normal_name(name: Column) -> Column:
    """Lower-case, unspaced name without fragment words and brackets; null when nothing is left."""
    packed = F.regexp_replace(F.lower(name), r"\s+", "")
    stripped = F.regexp_replace(F.regexp_replace(packed, FRAGMENT_SUFFIX, ""), BRACKET_SUFFIX, "")
    final = F.when(packed.startswith("edge:"), packed).otherwise(stripped)
    return F.when(packed.isin(NO_NAME) | final.isin(NO_NAME), F.lit(None)).otherwise(final)


def road_token(key: Column, uid: Column, highway: Column, length: Column, min_m: float = 20.0, major_m: float = 200.0) -> Column:
    """Token of a segment that matters for a route; null for the rest."""
    kind = F.lower(F.coalesce(highway, F.lit("")))
    named = key.isNotNull() & (kind.isin(TOKEN_CLASSES) | (length >= major_m)) & (length >= min_m)
    bare = key.isNull() & kind.isin(CORRIDOR_CLASSES) & (length >= major_m)
    return F.when(named, F.concat(F.lit("road:"), key)).when(bare, F.concat(F.lit("edge:"), uid.cast("string")))


def alias_tokens(key: Column, highway: Column, corridor_cell: Column) -> Column:
    """Other names a road is known by: route code, ring, expressway base, corridor cell."""
    road = F.lower(key)
    code = F.nullif(F.regexp_extract(road, ROUTE_CODE, 1), F.lit(""))
    known = F.coalesce(*[F.when(road.contains(word), F.lit(route)) for word, route in EXPRESSWAY_ROUTES])
    ring = F.nullif(F.regexp_extract(road, f"([{CHINESE_DIGITS}0-9]+环)", 1), F.lit(""))
    fast = road.rlike("(?:高速|快速路|快速)$") | F.lower(F.coalesce(highway, F.lit(""))).isin("motorway", "trunk")
    base = F.regexp_replace(road, FAST_ROAD_SUFFIX, "")
    tokens = F.array(
        F.concat(F.lit("alias:route:"), code),
        F.concat(F.lit("alias:route:"), known),
        F.concat(F.lit("alias:ring:"), ring),
        F.when(fast & (F.length(base) >= 2), F.concat(F.lit("alias:express:"), base)),
        F.concat(F.lit("alias:corridor:"), corridor_cell),
    )
    return F.when(key.isNull(), F.expr("CAST(array() AS array<string>)")).otherwise(
        F.array_distinct(F.filter(tokens, lambda t: t.isNotNull()))
    )


def corridor_family(name: Column) -> Column:
    """Ring roads of all directions share a family; every other road is its own."""
    trimmed = F.trim(name)
    ring = F.regexp_extract(trimmed, f"^([东南西北]?[{CHINESE_DIGITS}]+环)(?:[东南西北中])?(?:路)?$", 1)
    return F.coalesce(F.nullif(ring, F.lit("")), F.nullif(trimmed, F.lit("")))


def is_ring(name: Column) -> Column:
    return F.trim(name).rlike(f"^[东南西北]?[{CHINESE_DIGITS}]+环")


def without_repeats(tokens: Column) -> Column:
    """Array with directly repeated entries collapsed."""
    return F.filter(tokens, lambda t, n: (n == 0) | (t != F.element_at(tokens, F.greatest(n, F.lit(1)))))
