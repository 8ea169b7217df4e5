"""Free-text captions to attributes, Column to Column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Phrases and what they stand for.
BODY = [
    ("auto rickshaw", "auto_rickshaw"), ("auto-rickshaw", "auto_rickshaw"), ("autorickshaw", "auto_rickshaw"),
    ("tuk tuk", "auto_rickshaw"), ("tuk-tuk", "auto_rickshaw"), ("three wheeler", "auto_rickshaw"),
    ("three-wheeler", "auto_rickshaw"), ("rickshaw", "auto_rickshaw"), ("sport utility vehicle", "suv"), ("suv", "suv"),
    ("jeep", "suv"), ("pick-up truck", "pickup"), ("pickup truck", "pickup"), ("pick up truck", "pickup"),
    ("pickup", "pickup"), ("pick-up", "pickup"), ("ute", "pickup"), ("hatchback", "hatchback"), ("estate car", "hatchback"),
    ("sedan", "sedan"), ("saloon", "sedan"), ("minivan", "van"), ("mini-van", "van"), ("van", "van"), ("lorry", "truck"),
    ("tanker", "truck"), ("tipper", "truck"), ("semi truck", "truck"), ("semi-truck", "truck"), ("truck", "truck"),
    ("coach", "bus"), ("minibus", "bus"), ("bus", "bus"), ("motorcycle", "motorcycle"), ("motorbike", "motorcycle"),
    ("scooter", "motorcycle"), ("moped", "motorcycle"),
]
# Colours, parts, negations and limits of captions, up to CAP.
COLOURS = [
    ("white", "white"), ("off-white", "white"), ("cream", "white"), ("silver", "silver"), ("grey", "silver"), ("gray", "silver"),
    ("black", "black"), ("dark grey", "black"), ("dark gray", "black"), ("red", "red"), ("maroon", "red"), ("crimson", "red"),
    ("blue", "blue"), ("navy", "blue"), ("teal", "blue"), ("yellow", "yellow"), ("golden", "yellow"), ("gold", "yellow"),
    ("orange", "yellow"), ("green", "green"), ("olive", "green"), ("brown", "brown"), ("beige", "brown"), ("tan", "brown"),
]
NOT_COLOURS = ["black and white", "white and black", "black-and-white"]
TINT = ["tinted", "tint", "blacked out window", "blacked-out window", "smoked glass", "dark windows", "darkened windows"]
ALLOY = ["alloy", "alloys", "chrome wheel", "chrome rim", "aftermarket wheel", "spoked wheel", "mag wheel"]
STOCK = ["steel wheel", "hubcap", "hub cap", "stock wheel", "wheel cover", "plain wheel"]
RACK = ["roof rack", "roof-rack", "luggage rack", "roof rails", "roof bars", "carrier on the roof", "roof carrier"]
MARKINGS = ["sticker", "decal", "livery", "logo", "sign", "lettering", "writing", "advertisement", "banner", "emblem", "graphic", "text"]
DAMAGE = ["dent", "dented", "scratch", "scratched", "broken", "cracked", "smashed", "damaged", "rust", "rusted", "rusty", "missing bumper", "crumpled"]
NEGATIONS = ["no", "not", "non", "without", "lacks", "lacking", "never", "isn't", "aren't", "doesn't", "does not", "is not", "are not", "free of", "devoid of"]
WINDOW = 40
CAP = 0.9

NEGATED = r"\b(" + "|".join(re.escape(n) for n in NEGATIONS) + r")\b"


def escaped(phrase: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", phrase)


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def negated(text: Column, at: Column) -> Column:
    """Whether a negation stands in the window before the 1-based place `at`."""
    start = F.greatest(at - WINDOW, F.lit(1))
    return F.substring(text, start, at - start).rlike(NEGATED)


def vocabulary_hit(text: Column, vocabulary: list[tuple[str, str]]) -> Column:
    """Value of the phrase that stands first, un-negated; the longest if several begin there. Of each phrase the
    first occurrence counts."""
    longest_first = sorted(vocabulary, key=lambda x: -len(x[0]))
    hits = []
    for rank, (phrase, value) in enumerate(longest_first):
        at = F.regexp_instr(text, F.lit(rf"\b{escaped(phrase)}\b"))
        hit = F.when((at > 0) & ~negated(text, at), F.struct(at.alias("at"), F.lit(rank).alias("rank"), F.lit(value).alias("value")))
        hits.append(F.when(F.contains(text, F.lit(phrase)), hit))  # the plain search is cheap and mostly ends it
    return F.array_min(F.filter(F.array(*hits), lambda h: h.isNotNull()))["value"]


def phrase_state(text: Column, phrases: list[str]) -> Column:
    """True if any occurrence of a phrase is un-negated, false if all are negated, null if there is none."""
    return F.array_max(F.array(*[_one_state(text, p) for p in phrases]))


def _one_state(text: Column, phrase: str) -> Column:
    parts = F.split(text, rf"\b{escaped(phrase)}")
    many = F.size(parts) - 1

    def free(i: Column) -> Column:
        place = F.aggregate(F.slice(parts, 1, i), F.lit(1), lambda s, p: s + F.length(p)) + (i - 1) * len(phrase)
        return ~negated(text, place)

    return F.when(F.contains(text, F.lit(phrase)) & (many > 0), F.exists(F.sequence(F.lit(1), F.greatest(many, F.lit(1))), free))


def mentioned(text: Column, phrases: list[str]) -> Column:
    """Phrases whose first occurrence is not negated, in the given order."""
    hits = []
    for phrase in phrases:
        at = F.regexp_instr(text, F.lit(rf"\b{escaped(phrase)}"))
        hits.append(F.when(F.contains(text, F.lit(phrase)) & (at > 0) & ~negated(text, at), F.lit(phrase)))
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def quoted(caption: Column) -> Column:
    """Lettering between quotes, 2 to 40 characters; a value is left out if its lower case is already there."""
    quote_open, quote_close = "'\"‘“", "'\"’”"
    found = F.regexp_extract_all(F.coalesce(caption, F.lit("")), F.lit(f"[{quote_open}]([^{quote_close}]{{2,40}})[{quote_close}]"), F.lit(1))
    none = F.array().cast("array<string>")
    return F.aggregate(
        F.transform(found, lambda v: F.trim(v)), none, lambda s, v: F.when((v == "") | F.array_contains(s, F.lower(v)), s).otherwise(F.concat(s, F.array(v)))
    )


def without_photo_words(text: Column) -> Column:
    """Text with phrases blanked in which a colour isn't the vehicle's."""
    for phrase in NOT_COLOURS:
        text = F.regexp_replace(text, escaped(phrase), " " * len(phrase))
    return text


def parsed(caption: Column, text: Column, masked: Column) -> dict[str, Column]:
    """The attributes of a caption by name, from its normalised text and that without photo words."""
    alloy, stock = phrase_state(text, ALLOY), phrase_state(text, STOCK)
    wheels = F.when(alloy, "alloy").when(stock, "stock").otherwise("unknown")
    lettering = quoted(caption)
    marks = F.when(F.size(lettering) > 0, lettering).otherwise(mentioned(text, MARKINGS))
    return {
        "body_type": F.coalesce(vocabulary_hit(text, BODY), F.lit("unknown")),
        "colour": vocabulary_hit(masked, COLOURS),
        "tinted_windows": phrase_state(text, TINT),
        "wheels": wheels,
        "roof_rack": phrase_state(text, RACK),
        "markings": marks,
        "damage": mentioned(text, DAMAGE),
    }


def confidence() -> Column:
    """Share of the seven fields that say something, capped; false is something."""
    some = [
        F.col("body_type") != "unknown", F.col("colour").isNotNull(), F.col("tinted_windows").isNotNull(), F.col("wheels") != "unknown",
        F.col("roof_rack").isNotNull(), F.size("markings") > 0, F.size("damage") > 0,
    ]
    n = sum((c.cast("int") for c in some[1:]), some[0].cast("int"))
    return F.floor(F.least(F.lit(CAP), n / 7.0) * 1000 + 0.5) / 1000


def description(caption: Column) -> Column:
    """What was parsed, in one line; the caption's first sentence if nothing was."""
    head = F.concat_ws(" ", "colour", F.when(F.col("body_type") != "unknown", F.translate("body_type", "_", " ")))
    line = F.concat_ws(
        "; ", F.when(head != "", head), F.when(F.col("tinted_windows"), "tinted windows"), F.when(F.col("wheels") != "unknown", F.concat("wheels", F.lit(" wheels"))),
        F.when(F.col("roof_rack"), "roof rack"), F.when(F.size("markings") > 0, F.concat(F.lit("markings: "), F.array_join("markings", ", "))),
        F.when(F.size("damage") > 0, F.concat(F.lit("damage: "), F.array_join("damage", ", "))),
    )
    first = F.trim(F.get(F.split(F.trim(F.coalesce(caption, F.lit(""))), r"(?<=[.!?])\s"), F.lit(0)))
    return F.when(line != "", line).otherwise(first)


def with_attributes(df, caption: str = "caption"):
    """Adds the parsed fields, confidence and description of a caption column."""
    out = df.withColumn("_text", normalised(F.col(caption)))  # made once, looked at some hundred times
    out = out.withColumn("_masked", without_photo_words(F.col("_text")))
    out = out.withColumns(parsed(F.col(caption), F.col("_text"), F.col("_masked"))).drop("_text", "_masked")
    return out.withColumn("attribute_confidence", confidence()).withColumn("description", description(F.col(caption)))


def worth_indexing() -> Column:
    """Two known fields, or a description of two words."""
    n = (F.col("body_type") != "unknown").cast("int") + F.col("colour").isNotNull().cast("int") + (F.size("markings") > 0).cast("int") + (F.size("damage") > 0).cast("int")
    words = F.size(F.filter(F.split(F.coalesce("description", F.lit("")), r"\s+"), lambda w: w != ""))
    return (n >= 2) | (words >= 2)
