"""Licences, scores of modification and recognisability, display helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXCERPTS = ("EXCERPT_PHONOGRAM", "EXCERPT_WORK")
#: Rights layers by class (fixed values).
LAYERS = {
    "EXACT": ["phonogram", "work"], "MODIFIED": ["phonogram", "work"], "EXCERPT_PHONOGRAM": ["phonogram", "work"],
    "VERSION": ["work", "performance"], "EXCERPT_WORK": ["work"], "LYRICS": ["work"], "COMMON": [], "NONE": [],
}


def licence_name(licence: Column) -> Column:
    """``cc-by-nc-sa-3.0`` as ``CC BY-NC-SA 3.0``; other licences with spaces for underscores."""
    parts = F.split(licence, "-")
    n = F.size(parts)
    inner = F.upper(F.array_join(F.slice(parts, 2, F.greatest(n - 2, F.lit(1))), "-"))
    cc = F.concat(F.lit("CC "), inner, F.lit(" "), F.element_at(parts, -1))
    return F.when(licence.startswith("cc-") & (n > 2), cc).otherwise(F.regexp_replace(licence, "_", " "))


def attribution(artist: Column, title: Column, licence: Column) -> Column:
    return F.format_string('%s, "%s", %s', artist, title, licence_name(licence))


def modification(semitones: Column, tempo: Column) -> Column:
    """1 - (1 - key) (1 - tempo), each axis at most 1 (an octave); four places, ties to even."""
    key = F.least(F.abs(F.coalesce(semitones, F.lit(0.0))) / 12.0, F.lit(1.0))
    pace = F.least(F.abs(F.log2(F.when(tempo > 0, tempo).otherwise(F.lit(1.0)))), F.lit(1.0))
    return F.bround(1 - (1 - key) * (1 - pace), 4)


def recognisability(peak: Column) -> Column:
    return F.when(peak.isNotNull(), F.least(F.greatest(peak, F.lit(0.0)), F.lit(1.0)))


def layers(cls: Column) -> Column:
    out = F.lit(None).cast("array<string>")
    for name, of in LAYERS.items():
        out = F.when(cls == name, F.array(*map(F.lit, of)).cast("array<string>")).otherwise(out)
    return out


def span_percent(start: Column, end: Column, duration: Column) -> Column:
    """A span's share of the duration in percent, cut to the duration; NULL where one of the three is."""
    a, b = (F.least(F.greatest(x, F.lit(0.0)), duration) for x in (start, end))
    return F.when((duration > 0) & start.isNotNull() & end.isNotNull(), 100 * F.greatest(b - a, F.lit(0.0)) / duration)


def window_step(duration: Column, n: Column, width: float = 10.0) -> Column:
    return F.when((n > 1) & (duration > width), (duration - width) / (n - 1))


def candidate_position(query_s: Column, query_start: Column, candidate_start: Column) -> Column:
    at = query_s + candidate_start - query_start
    return F.when(at.isNotNull(), F.greatest(F.lit(0.0), at))


def byte_range(header: Column, size: Column) -> Column:
    """``(start, end)`` of an HTTP range header, ends inclusive; the whole file where it cannot be read, NULL where it cannot be met."""
    first, last = F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 1), F.regexp_extract(header, r"^bytes=(\d*)-(\d*)$", 2)
    good = F.coalesce(header.rlike(r"^bytes=\d*-\d*$") & ((first != "") | (last != "")), F.lit(False))
    start = F.when(first == "", F.greatest(size - F.try_to_number(last, F.lit("999999999999")).cast("long"), F.lit(0))).otherwise(first.try_cast("long"))
    end = F.when((first == "") | (last == ""), size - 1).otherwise(F.least(last.try_cast("long"), size - 1))
    met = (start < size) & (start <= end)
    return F.when(~good, F.struct(F.lit(0).cast("long").alias("start"), (size - 1).alias("end"))).when(met, F.struct(start.cast("long").alias("start"), end.alias("end")))


def percent_text(x: Column) -> Column:
    return F.format_string("%.0f%%", F.rint(x * 100))


def clock_text(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return F.when(seconds.isNotNull(), F.format_string("%d:%02d", F.floor(whole / 60), whole % 60))


def mistakes_per_hundred(precision: Column) -> Column:
    return F.round((1 - precision) * 100)


#: Multipliers of the scatter hash (fixed values).
SCATTER = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


def _times32(x: Column, factor: int) -> Column:
    """The low 32 bits of a product, unsigned; by halves, so that nothing overflows."""
    low, high = factor & 0xFFFF, factor >> 16
    return (x * F.lit(low) + F.shiftleft((x * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF))


def scatter(index: Column, seed: Column) -> Column:
    """A place in [0, 1) that looks random and is the same for the same index and seed (both small non-negative numbers)."""
    x = _times32(index.cast("long") + 1, SCATTER[0]).bitwiseXOR(_times32(seed.cast("long") + 1, SCATTER[1]))
    x = _times32(x.bitwiseXOR(F.shiftright(x, 15)), SCATTER[2])
    return (x.bitwiseXOR(F.shiftright(x, 13)) % 100_000) / F.lit(100_000.0)
