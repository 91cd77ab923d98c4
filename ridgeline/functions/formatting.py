"""Texts of numbers, names and places."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .projection import latitude, longitude

MIB = 1024 * 1024


def fixed(x: Column, places: int) -> Column:
    """A number with so many decimals, rounded half to even on its exact value, without grouping."""
    return F.replace(F.format_number(x, places), F.lit(","), F.lit(""))


def mib(size: Column) -> Column:
    """Bytes as MiB."""
    return F.concat(fixed(size / MIB, 2), F.lit(" MB"))


def seconds_text(seconds: Column) -> Column:
    """``1h 2m 3s``, without leading parts that are zero; negative counts as zero."""
    whole = F.greatest(F.bround(seconds, 0).cast("long"), F.lit(0).cast("long"))
    h, m, s = (whole / 3600).cast("long"), ((whole % 3600) / 60).cast("long"), whole % 60
    return (
        F.when(h > 0, F.concat_ws(" ", F.concat(h, F.lit("h")), F.concat(m, F.lit("m")), F.concat(s, F.lit("s"))))
        .when(m > 0, F.concat_ws(" ", F.concat(m, F.lit("m")), F.concat(s, F.lit("s"))))
        .otherwise(F.concat(s, F.lit("s")))
    )


def point(x: Column, y: Column) -> Column:
    """A point, or null if either part is."""
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def coordinate(x: Column, y: Column) -> Column:
    """``(lat, lon)`` of a grid point with six decimals, ``N/A`` for none."""
    text = F.concat(F.lit("("), fixed(latitude(x, y), 6), F.lit(", "), fixed(longitude(x, y), 6), F.lit(")"))
    return F.when(x.isNotNull() & y.isNotNull(), text).otherwise("N/A")


def _decomposed() -> tuple[str, str, dict[str, str]]:
    """Characters with one ASCII character under compatibility decomposition, those, and what characters with several become."""
    one, to, several = [], [], {}
    for code in range(0xA0, 0x20000):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(chr(code))
            to.append(plain)
        elif len(plain) > 1:
            several[chr(code)] = plain
    return "".join(one), "".join(to), several


ONE, TO, SEVERAL = _decomposed()


def slug(name: Column) -> Column:
    """Lower-case ASCII with ``_`` for blanks: accents are taken off, ligatures and signs of several letters are spelled out, characters that don't decompose are left out.

    Only a text that has a character of several letters is taken apart.
    """
    table = F.create_map(*(F.lit(x) for pair in SEVERAL.items() for x in pair))
    one = lambda c: F.when(c <= F.lit("\x7f"), c).otherwise(F.coalesce(F.try_element_at(table, c), c))
    spelled = F.array_join(F.transform(F.split(name, ""), one), "")
    # a class of two ranges and a few letters: a longer one would be tried on every character of every text
    low = "".join(c for c in SEVERAL if c < "\u0250")
    whole = F.when(name.rlike(f"[^\\x00-\u024f]|[{low}]"), spelled).otherwise(name)
    return F.replace(F.lower(F.regexp_replace(F.translate(whole, ONE, TO), r"[^\x00-\x7F]", "")), F.lit(" "), F.lit("_"))


def chunk_slug(name: Column) -> Column:
    """Lower case with ``_`` for blanks; accents stay."""
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def profile_slug(name: Column) -> Column:
    return F.translate(F.lower(name), " åäö/", "_aao_")


def profile_key(rank: Column, tatort: Column, kommun: Column, bins: Column, samples: Column) -> Column:
    """Cache key of a profile by its zone and settings; a zone without rank says so."""
    return F.concat_ws("_", F.coalesce(rank.cast("string"), F.lit("custom")), profile_slug(tatort), profile_slug(kommun), bins.cast("string"), samples.cast("string"))


def file_name(url: Column) -> Column:
    """Last part of a URL's path, without query and fragment."""
    return F.regexp_extract(F.parse_url(url, F.lit("PATH")), r"([^/]+)/*$", 1)


def tile_path(root: Column, zone: Column, url: Column) -> Column:
    return F.concat_ws("/", root, zone, file_name(url))


def title(rank: Column, tatort: Column, kommun: Column, score: Column, otherwise: str = "custom selection") -> Column:
    """Heading of a profile: name and place in the ranking, if it has one."""
    place = F.concat(F.lit("rank "), rank.cast("string"), F.lit(", score "), fixed(score, 1))
    return F.concat(tatort, F.lit(" ("), kommun, F.lit("): "), F.when(rank.isNotNull() & score.isNotNull(), place).otherwise(otherwise))


def listed(values: Column) -> Column:
    return F.array_join(values, ", ")
