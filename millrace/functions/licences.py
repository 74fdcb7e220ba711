"""Licences as a closed vocabulary: raw strings normalise to a code or fail closed."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_VERSION = re.compile(r"(?<![\d.])([1-4]\.[05])(?![\d.])")
_WORDS = {"attribution": "by", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd", "noderivs": "nd"}


def normalize(raw: str | None) -> str:
    """``CC0-1.0``, ``PDM-1.0``, ``CC-BY[-NC][-SA|-ND]-v``, ``ARR`` or ``UNKNOWN``.

    Clauses must be known, distinct and consistent (SA and ND exclude each
    other, BY is required); anything else is UNKNOWN and never assumed open.
    """
    s = (raw or "").strip().lower()
    if not s:
        return "UNKNOWN"
    if "all rights reserved" in s or s in {"c", "©", "copyright"}:
        return "ARR"
    if "publicdomain/mark" in s or s in {"pdm", "public domain mark"}:
        return "PDM-1.0"
    if "publicdomain/zero" in s or re.fullmatch(r"cc[\s_-]?0([\s_-]?(1\.0|universal))*", s):
        return "CC0-1.0"
    version = (_VERSION.search(s) or [None, "4.0"])[1]
    url = re.search(r"creativecommons\.org/licenses/([a-z-]+)", s)
    if url:
        body = url[1]
    else:
        body = re.sub(r"creative\s*commons", "cc", _VERSION.sub(" ", s))
        body = re.sub(r"\b(international|unported|generic|license|licence)\b", " ", body)
        body = re.sub(r"non[\s-]?commercial", "noncommercial", body)
        body = re.sub(r"share[\s-]?alike", "sharealike", body)
        body = re.sub(r"no[\s-]?deriv(ative)?s", "noderivs", body)
        if not re.match(r"^\s*cc[\s_-]", body):
            return "UNKNOWN"
        body = re.sub(r"^\s*cc[\s_-]+", "", body)
    clauses = [_WORDS.get(c, c) for c in re.split(r"[\s_-]+", body.strip(" -_")) if c]
    if len(set(clauses)) != len(clauses) or "by" not in clauses or not set(clauses) <= {"by", "nc", "sa", "nd"}:
        return "UNKNOWN"
    if {"sa", "nd"} <= set(clauses):
        return "UNKNOWN"
    return "CC-" + "-".join(c.upper() for c in ("by", "nc", "sa", "nd") if c in clauses) + f"-{version}"


@dataclass(frozen=True)
class Policy:
    """What a use needs of a licence."""

    commercial: bool = True
    derivatives: bool = True
    allow_share_alike: bool = True

    def admits(self, code: Column) -> Column:
        known = code.startswith("CC") | code.startswith("PDM")
        ok = known
        if self.commercial:
            ok = ok & ~code.contains("-NC")
        if self.derivatives:
            ok = ok & ~code.contains("-ND")
        if not self.allow_share_alike:
            ok = ok & ~code.contains("-SA")
        return F.coalesce(ok, F.lit(False))


def with_licence(df: DataFrame, raw_col: str, out: str = "licence", most: int = 100_000) -> DataFrame:
    """Adds the normalised code of ``raw_col``.

    The parser runs on the distinct strings, found with map-side combining and
    a null among them; the map is broadcast, and more than ``most`` distinct
    strings are an error, for a closed vocabulary has few.
    """
    spark = df.sparkSession
    seen = [r[0] for r in df.select(raw_col).distinct().limit(most + 1).collect()]
    if len(seen) > most:
        raise ValueError(f"{raw_col} has more than {most} distinct values")
    schema = T.StructType([T.StructField("_raw", T.StringType()), T.StructField(out, T.StringType())])
    known = spark.createDataFrame([(x, normalize(x)) for x in seen], schema)
    return df.join(F.broadcast(known), df[raw_col].eqNullSafe(known["_raw"]), "left").drop("_raw")


def attribution(creator: Column, code: Column, source: Column) -> Column:
    """``(c) creator, source (CODE)``; public-domain items name no right holder."""
    who = F.coalesce(F.nullif(F.trim(creator), F.lit("")), F.lit("unknown author"))
    short = F.regexp_replace(code, "-[^-]*$", "")
    free = code.startswith("CC0") | code.startswith("PDM")
    return F.when(free, F.concat(who, F.lit(", "), source, F.lit(" ("), short, F.lit(")"))).otherwise(
        F.concat(F.lit("(c) "), who, F.lit(", "), source, F.lit(" ("), short, F.lit(")"))
    )
