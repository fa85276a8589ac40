"""Filename and caption expressions: scores and flags for wording that gives a place away."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

UNICODE = "(?iU)"


def any_of(text: Column, words: list[str]) -> Column:
    """Whether text holds any of the words; written as OR so that it stops at the first."""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def mentions(text: Column, words: list[str]) -> Column:
    """As any_of for short texts: one pattern, which is quicker to plan."""
    return text.rlike("|".join(words))


def count_of(text: Column, words: list[str]) -> Column:
    """How many different words of the list text holds."""
    out = F.lit(0)
    for w in words:
        out = out + text.contains(w).cast("int")
    return out


def stem(name: Column) -> Column:
    """Name without its last extension; leading dots do not begin one."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), r"^(\.*[^.].*)\.[^.]*$", "$1")


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    chars = F.split(text, "")
    n = F.length(text).cast("double")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / n
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    return F.when(F.length(text) > 0, total).otherwise(F.lit(0.0))


def points(flag: Column, value: float) -> Column:
    return flag.cast("double") * F.lit(value)


def filename_features(name: Column) -> dict[str, Column]:
    base = stem(name)
    low = F.lower(base)
    flat = F.translate(low, " _-", "")
    generic = base.rlike(UNICODE + C.GENERIC_NAME)
    fragment = mentions(low, C.RESERVE_FRAGMENTS)
    zone = low.rlike(C.ZONE_NUMBER)
    keyword = mentions(flat, [w.replace(" ", "") for w in C.LOCATION_KEYWORDS])
    distance = F.translate(base, "_", " ").rlike(UNICODE + C.DISTANCE)
    digits = low.rlike(C.COORDINATE_DIGITS)
    score = F.when(generic, F.lit(0.02)).otherwise(F.lit(0.12)) + points(fragment, 0.45) + points(zone, 0.30) + points(keyword, 0.10) + points(distance, 0.25) + points(digits, 0.20)
    return {
        "filename_leak_score": F.least(score, F.lit(1.0)),
        "filename_has_location_keyword": fragment | zone | keyword,
        "filename_has_distance_pattern": distance,
        "filename_has_coordinate_pattern": digits,
        "filename_length": F.length(base),
    }


def filename_entropy_norm(name: Column) -> Column:
    return F.least(entropy(stem(name)) / F.lit(4.5), F.lit(1.0))


def names_species(name: Column, species: list[str]) -> Column:
    """Whether a filename holds the name of a species (informative, not scored)."""
    return any_of(F.lower(stem(name)), [s.lower() for s in species])


def caption_features(caption: Column) -> dict[str, Column]:
    text = F.coalesce(caption, F.lit(""))
    low = F.lower(text)
    fragment = mentions(low, C.RESERVE_FRAGMENTS)
    distance = text.rlike(UNICODE + C.DISTANCE)
    hits = count_of(low, C.LOCATION_KEYWORDS)
    pair = text.rlike("(?U)" + C.DECIMAL_PAIR)
    score = points(fragment, 0.40) + points(distance, 0.35) + F.least(hits * F.lit(0.12), F.lit(0.36)) + points(pair, 0.45)
    return {
        "caption_leak_score": F.least(score, F.lit(1.0)),
        "caption_has_location_keyword": fragment | (hits > 0),
        "caption_has_distance_pattern": distance,
        "caption_has_coordinate_pattern": pair,
    }


def species_key(name: Column) -> Column:
    """Key of the species table; null and blank are unknown."""
    key = F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit(" "))
    return F.when(name.isNull() | (name == ""), F.lit("unknown")).otherwise(key)
