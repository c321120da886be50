"""Text functions: scripts, shingles, and what compares MinHash signatures; signing.py makes them."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .json_values import SPACE

# The scripts that are told apart; letters of any other are "Other".
SCRIPTS = ("Latin", "Han", "Hiragana", "Katakana", "Hangul", "Cyrillic", "Arabic", "Hebrew", "Devanagari", "Greek", "Thai")
PRIME = (1 << 31) - 1
HASHES, BANDS, ROWS = 128, 32, 4
SHINGLE = 3


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), f"{SPACE}+"), lambda t: t != "")


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """Runs of `size` neighbouring tokens joined by spaces; none for shorter texts."""
    def runs(words: Column) -> Column:
        starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), " "))

    return F.transform(F.array(tokens(text)), runs)[0]  # the outer array binds the tokens, so that they are made once


def coefficients(seed: int = 0) -> list[tuple[int, int]]:
    rng = random.Random(seed)
    return [(rng.randrange(1, PRIME), rng.randrange(PRIME)) for _ in range(HASHES)]


def similarity(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures; 0 if either is missing or the lengths differ."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(HASHES))
    return F.when(a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)), same).otherwise(F.lit(0.0))


def bands(signed: DataFrame, n: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(id, band, bucket): a signature in n bands of some rows. A layout that needs more rows than there are, or none, is the usual one.

    Signatures that are shorter than the layout have no bands.
    """
    if n < 1 or rows < 1 or n * rows > HASHES:
        n, rows = BANDS, ROWS
    keys = F.array(*(F.xxhash64(*(F.get("signature", F.lit(b * rows + k)) for k in range(rows))) for b in range(n)))
    return signed.where(F.size("signature") >= n * rows).select("id", F.posexplode(keys).alias("band", "bucket"))
