"""Column expressions of the curation domain; all stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits in their fixed order with the shares of a build with and without a sealed test.
V1_FRACTIONS = (("train", 0.80), ("validation", 0.10), ("test", 0.10))
V2_FRACTIONS = (("train", 0.80), ("validation", 0.10), ("dev_test", 0.05), ("final_test", 0.05))


def blank_to_null(s: Column) -> Column:
    return F.nullif(F.trim(s), F.lit(""))


def canonical_name(s: Column) -> Column:
    """Name without parenthesised parts, spaces squeezed, first letter upper and the rest lower case."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(s, r"\([^)]*\)", " "), r"\s+", " "))
    return blank_to_null(F.concat(F.upper(F.substring(bare, 1, 1)), F.lower(F.substring(bare, 2, 1 << 30))))


def stable_fraction(key: Column, salt: Column | str) -> Column:
    """A number in [0, 1): the first 8 bytes of sha256(salt, NUL, key) as a fraction of 2**64."""
    salt = F.lit(salt) if isinstance(salt, str) else salt
    digest = F.sha2(F.concat(salt, F.lit("\0"), key), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))


def validate_fractions(fractions: Sequence[tuple[str, float]]) -> None:
    """Raises unless the shares are named once, not negative and add up to one."""
    names = [n for n, _ in fractions]
    if len(set(names)) != len(names) or any(f < 0 for _, f in fractions) or abs(sum(f for _, f in fractions) - 1) > 1e-9:
        raise ValueError(f"shares must be distinct, not negative and add up to 1: {fractions}")


def band_of(fraction: Column, fractions: Sequence[tuple[str, float]]) -> Column:
    """The split whose cumulative share holds the fraction; the last one takes the remainder."""
    validate_fractions(fractions)
    out, edge = None, 0.0
    for name, share in fractions[:-1]:
        edge += share
        test = fraction < F.lit(round(edge, 12))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(fractions[-1][0]) if out is not None else F.lit(fractions[-1][0])


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit hashes; 64 where one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def hex_to_long(h: Column) -> Column:
    return F.conv(h, 16, -10).cast("long")


def content_path(sha: Column, ext: Column) -> Column:
    return F.concat(F.substring(sha, 1, 2), F.lit("/"), F.substring(sha, 3, 2), F.lit("/"), sha, F.lit("."), ext)


def pack_cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Row of the cell in the high bits and column in the low 16; latitudes clamp, longitudes wrap.

    As in SQL: NaN is above all numbers (``floor`` would make it 0), a null
    latitude falls in the first row and a null longitude in the last column;
    the remainder is taken twice for every sign, which rounds otherwise than
    ``pmod`` just below an edge.
    """
    rows, cols = math.ceil(180 / degrees), math.ceil(360 / degrees)
    north, full = (lat + 90.0) / degrees, F.lit(360.0)
    east = ((lon + 180.0) % full + full) % full / degrees
    row = F.when(F.isnan(north), rows - 1).otherwise(F.least(F.greatest(F.floor(north), F.lit(0)), F.lit(rows - 1))).cast("int")
    col = F.when(F.isnan(east), cols - 1).otherwise(F.least(F.floor(east), F.lit(cols - 1))).cast("int")
    return F.shiftleft(row, 16).bitwiseOR(col.bitwiseAND(0xFFFF))


def holdout_cell(lat: Column, lon: Column, degrees: float = 5.0) -> Column:
    return (F.floor(lat / degrees) * 1000 + F.floor(lon / degrees)).cast("int")


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits; the largest is taken off first."""
    z = F.transform(logits, lambda v: v.cast("double") / F.lit(temperature))
    top = F.array_max(z)
    e = F.transform(z, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def normalized_entropy(p: Column) -> Column:
    terms = F.transform(p, lambda v: F.when(v > 0, -v * F.log(v)).otherwise(F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda a, v: a + v) / F.log(F.size(p).cast("double"))


def top_k(p: Column, k: int) -> Column:
    """The k largest as (value, index); equal values by the lower index."""
    keyed = F.array_sort(F.transform(p, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
    return F.transform(F.slice(keyed, 1, k), lambda s: F.struct((-s["v"]).alias("value"), s["i"].alias("index")))


def margin(p: Column) -> Column:
    top = F.sort_array(p, asc=False)
    return F.get(top, F.lit(0)) - F.coalesce(F.get(top, F.lit(1)), F.lit(0.0))


def rejection(best: Column, gap: Column, entropy: Column, unknown: float = 0.35, least_gap: float = 0.08, most: float = 0.85) -> Column:
    """The first signal that rejects: low confidence, then high entropy, then a small margin; else null."""
    return F.when(best < unknown, "low_confidence").when(entropy > most, "high_entropy").when(gap < least_gap, "small_margin")


def certainty(best: Column, gap: Column, genus_mass: Column, unknown: float = 0.35, least_gap: float = 0.08) -> Column:
    return (
        F.when((best >= unknown) & (gap >= 2.5 * least_gap), "CONFIDENT")
        .when((best >= unknown) & (gap >= least_gap), "AMBIGUOUS")
        .when(genus_mass >= 0.55, "COARSE_ONLY")
        .otherwise("UNKNOWN")
    )


def prior_factor(share: Column, confidence: Column, low: float = 0.12, high: float = 3.0, unknown: float = 0.75) -> Column:
    """Geographic factor on a log scale; full up to confidence 0.5, fading to none at 1."""
    raw = F.when(share.isNull(), F.lit(unknown)).otherwise(F.lit(low) * F.pow(F.lit(high / low), share))
    strength = F.when(confidence <= 0.5, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), (1 - confidence) / 0.5))
    return F.exp(F.log(raw) * strength)


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def url_extension(url: Column) -> Column:
    """Lower-case extension of the path, without query or fragment; empty if there is none."""
    return F.lower(F.regexp_extract(F.regexp_replace(url, r"[?#].*$", ""), r"\.([A-Za-z0-9]{1,5})$", 1))


def base_language(tag: Column) -> Column:
    return F.lower(F.split_part(tag, F.lit("-"), F.lit(1)))


def whole_frame(sha: Column, split: Column, per_mille: int = 150) -> Column:
    """Whether a training sample is used uncropped: a fixed choice by its content hash."""
    return (split == "train") & (F.conv(F.substring(sha, 1, 8), 16, 10).cast("long") % 1000 < per_mille)


def expand_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, context: float = 0.25, least: int = 224) -> Column:
    """Box grown by a share of its size and to a least edge, shifted inside and clamped."""

    def axis(at: Column, n: Column, full: Column) -> tuple[Column, Column]:
        size = F.least(F.greatest(n * (1 + 2 * context), F.lit(float(least))), full)
        start = F.greatest(F.lit(0.0), F.least(at + n / 2 - size / 2, full - size))
        return F.rint(start).cast("int"), F.rint(size).cast("int")

    (x0, w0), (y0, h0) = axis(x, w, width), axis(y, h, height)
    return F.struct(x0.alias("x"), y0.alias("y"), w0.alias("w"), h0.alias("h"))


def image_flags(width: Column, height: Column, saturation: Column, clipped: Column, luma: Column) -> Column:
    """Names of the quality flags that measured facts raise."""
    short, long = F.least(width, height), F.greatest(width, height)
    tests = [
        (short < 96, "tiny"),
        (long / short > 4, "extreme_aspect"),
        (saturation < 0.02, "grey"),
        (clipped > 0.35, "clipped"),
        (luma < 0.06, "dark"),
        (luma > 0.94, "bright"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests]))


def tier(images: Column, groups: Column, genus_images: Column, genus_groups: Column, family_images: Column, family_groups: Column) -> Column:
    """species, genus, family or dropped by the evidence at each rank."""
    return (
        F.when((images >= 40) & (groups >= 25), "species")
        .when((genus_images >= 60) & (genus_groups >= 30), "genus")
        .when((family_images >= 60) & (family_groups >= 30), "family")
        .otherwise("dropped")
    )


def human(n: Column) -> Column:
    """A number with a unit: 950, 1.2k, 3.4M."""
    return F.when(n >= 1e6, F.format_string("%.1fM", n / 1e6)).when(n >= 1e3, F.format_string("%.1fk", n / 1e3)).otherwise(F.format_string("%.0f", n))
