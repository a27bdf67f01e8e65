"""Text functions: store categories, names, ids, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Store categories by the name parts that give them, first match wins.
CATEGORY_RULES = (
    ("farmers", ("farmers",)),
    ("davidjones", ("davidjones", "david jones")),
    ("hm", ("handm", "h&m", "hm")),
    ("woolworths", ("woolworths", "countdown")),
    ("jbhifi", ("jbhifi", "jb hifi", "jb hi-fi", "jb_hifi")),
    ("foodcourt", ("food_court", "foodcourt")),
    ("noelleeming", ("noelleeming", "noel leeming", "noel_leeming")),
    ("archiebrothers", ("archiebrothers", "archie brothers", "archie_brothers", "archiebros")),
    ("rebelsport", ("rebelsport", "rebel sport", "rebel_sport")),
)
PREFIX_RULES = (("rs_", "rebelsport"),)
DEFAULT_CATEGORY = "specialty"


# What charts call the categories.
CATEGORY_LABELS = {
    "farmers": "Farmers",
    "davidjones": "David Jones",
    "hm": "H&M",
    "woolworths": "Woolworths",
    "jbhifi": "JB Hi-Fi",
    "foodcourt": "Food Court",
    "noelleeming": "Noel Leeming",
    "archiebrothers": "Archie Brothers",
    "rebelsport": "Rebel Sport",
    "specialty": "Specialty",
}


def category_label(category: Column) -> Column:
    """a category's name on charts; unknown ones as they are."""
    labels = F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(labels, category), category)


def level_label(floor: Column) -> Column:
    """a floor's name on charts."""
    return F.concat(F.lit("Level "), floor)


def store_category(name: Column, rules=CATEGORY_RULES, prefixes=PREFIX_RULES) -> Column:
    """Ordered substring rules on the lower-case name, then prefixes, else the default."""
    low = F.lower(name)
    out = F.when(name.isNull() | (name == ""), F.lit(DEFAULT_CATEGORY))
    for category, parts in rules:
        hit = F.lit(False)
        for part in parts:
            hit = hit | F.contains(low, F.lit(part))
        out = out.when(hit, F.lit(category))
    for prefix, category in prefixes:
        out = out.when(F.startswith(low, F.lit(prefix)), F.lit(category))
    return out.otherwise(F.lit(DEFAULT_CATEGORY))


def person_index(text: Column) -> Column:
    """the number after agent_ or person_ anywhere, else a leading integer, else null."""
    tagged = F.regexp_extract(text, r"(?:agent_|person_)(\d+)", 1)
    leading = F.regexp_extract(text, r"^\s*([+-]?\d+)", 1)
    return F.coalesce(F.nullif(tagged, F.lit("")).try_cast("bigint"), F.nullif(leading, F.lit("")).try_cast("bigint"))


def display_name(name: Column) -> Column:
    """without the level suffix, underscores as spaces, first letter upper case."""
    s = F.regexp_replace(F.regexp_replace(name, r"_lv[1-3].*", ""), "_", " ")
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 2**31 - 1))


def plain_number(x: Column) -> Column:
    """A double as text without a trailing .0."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def half_up(x: Column) -> Column:
    """Rounds halves up, as JavaScript does."""
    return F.floor(x + F.lit(0.5))


def fixed(x: Column, digits: int) -> Column:
    """a number with exactly `digits` decimals, halves to even."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def thousands(x: Column) -> Column:
    """F12."""
    return F.format_number(x, 0)


def panel_label(panel_id: Column) -> Column:
    """P17."""
    return F.concat(F.lit("Panel "), panel_id)


def floor_label(floor: Column) -> Column:
    return F.concat(F.lit("L"), floor)


def similarity_color(score: Column) -> Column:
    """F16: grey for no similarity, else a ramp between two colours."""
    ramp = [F.floor(F.lit(a) + F.lit(b - a) * score + F.lit(0.5)).cast("int") for a, b in ((99.0, 236.0), (102.0, 72.0), (241.0, 153.0))]
    return F.when(score <= 0.0001, F.lit("rgb(75, 85, 99)")).otherwise(F.format_string("rgb(%d, %d, %d)", *ramp))
