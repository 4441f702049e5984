"""Chords, intervals and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PITCH_CLASSES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")


def pitch_class(chord: Column) -> Column:
    """0 to 11, NULL for a label that is no chord."""
    root = F.regexp_extract(chord, r"^([A-G]#?)m?$", 1)
    place = F.array_position(F.array(*map(F.lit, PITCH_CLASSES)), root)
    return F.when(place > 0, (place - 1).cast("int"))


def mode(chord: Column) -> Column:
    return F.when(chord.endswith("m"), "m").otherwise("")


def degrees(chords: Column) -> Column:
    """Chords as semitones above the first, mode kept; labels as they are if one of them is no chord."""
    first = pitch_class(F.get(chords, F.lit(0)))
    moved = F.transform(chords, lambda c: F.concat(F.pmod(pitch_class(c) - first, F.lit(12)).cast("string"), mode(c)))
    return F.when(F.forall(chords, lambda c: pitch_class(c).isNotNull()), moved).otherwise(chords)


def transposition(rotation: Column) -> Column:
    """A rotation 0 to 11 as the nearest shift, -5 to 6."""
    return F.when(rotation <= 6, rotation).otherwise(rotation - 12)


def rotated(v: Column, k: Column) -> Column:
    """The array turned by ``k`` places to the right."""
    n = F.size(v)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(v, F.pmod(i - k, n)))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of doubles; 0 where either is (nearly) zero."""
    size = norm(a) * norm(b)
    return F.when(size <= 1e-12, F.lit(0.0)).otherwise(dot(a, b) / size)


def unit(v: Column) -> Column:
    """The vector at length 1; zero stays zero."""
    n = norm(v)
    return F.when(n <= 1e-8, F.transform(v, lambda x: x * 0.0)).otherwise(F.transform(v, lambda x: x / n))


def replacement_cost(x: Column, y: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(x - y) / 4.0)


def log_frequency(hertz_bin: Column, units: int = 36) -> Column:
    return F.log2(hertz_bin) * units


def landmark_hash(f1: Column, f2: Column, dt: Column) -> Column:
    """Two 9-bit frequencies and a 14-bit time difference in one number; NULL outside these ranges."""
    a, b, c = (F.rint(x).cast("long") for x in (f1, f2, dt))
    inside = a.between(0, 511) & b.between(0, 511) & c.between(1, 16383)
    return F.when(inside, F.shiftleft(a, 23).bitwiseOR(F.shiftleft(b, 14)).bitwiseOR(c))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))


def idf(size: Column, df: Column) -> Column:
    """ln(N / df), unseen patterns counting as seen once; 0 for an empty corpus."""
    return F.when(size <= 0, F.lit(0.0)).otherwise(F.ln(size / F.greatest(df, F.lit(1))))
