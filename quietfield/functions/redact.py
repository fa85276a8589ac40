"""Redaction of captions and safe names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def alternations(words: list[str]) -> list[str]:
    """Patterns that replace in turn as the words one after another would, with far fewer passes.

    A word that holds an earlier one never matches: that one has been replaced.  A word may
    share a pattern with earlier ones unless it can begin before one of them and overlap it.
    """
    groups: list[list[str]] = []
    for n, word in enumerate(words):
        if any(w in word for w in words[:n]):
            continue
        clash = lambda w, word=word: any(word[i:] == w[: len(word) - i] for i in range(1, len(word)))
        if groups and not any(clash(w) for w in groups[-1]):
            groups[-1].append(word)
        else:
            groups.append([word])
    return [f"(?=[{''.join(sorted({w[0] for w in g}))}])(?:{'|'.join(g)})" for g in groups]


def redact_caption(caption: Column) -> Column:
    """Distances, then reserve names, then location words are replaced, anywhere and in any case; null gives ''."""
    text = F.regexp_replace(F.coalesce(caption, F.lit("")), "(?iU)" + C.DISTANCE, "[REDACTED DISTANCE] ")
    text = reduce(lambda t, w: F.regexp_replace(t, "(?iu)" + w, "[REDACTED LOCATION]"), alternations(C.RESERVE_FRAGMENTS), text)
    text = reduce(lambda t, w: F.regexp_replace(t, "(?iu)" + w, "[REDACTED]"), alternations(C.LOCATION_KEYWORDS), text)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def safe_filename(digest: Column, stamp: Column, ext: Column) -> Column:
    """sanitized_<time>_<6 hex>.<ext>; the hex is taken from a content hash, so reruns agree."""
    clean = F.regexp_replace(F.lower(ext), r"^\.+", "")
    return F.concat(F.lit("sanitized_"), F.date_format(stamp, "yyyyMMdd_HHmmss"), F.lit("_"), F.substring(digest, 1, 6), F.lit("."), clean)


def random_safe_filename(ext: Column) -> Column:
    return safe_filename(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), F.current_timestamp(), ext)


def allowed_file(name: Column) -> Column:
    """Whether the part after the last dot is a picture extension."""
    return F.coalesce(name.contains(".") & F.lower(F.element_at(F.split(name, r"\."), -1)).isin(C.IMAGE_EXTENSIONS), F.lit(False))


def padded_box(x, y, w, h, width, height, pad: int = 6) -> Column:
    """The region to blur about a box, cut to the picture; null for an empty box (it is skipped)."""
    x0, y0 = F.greatest(F.lit(0), x - pad), F.greatest(F.lit(0), y - pad)
    x1, y1 = F.least(width, x + w + pad), F.least(height, y + h + pad)
    radius = F.greatest(F.lit(10), F.floor(F.least(w, h) / 2).cast("int"))
    return F.when((w > 0) & (h > 0) & (x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), radius.alias("radius")))
