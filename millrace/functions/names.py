"""Scientific names into parts, by a vectorised Python function (Unicode folding has no built-in)."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = "genus string, epithet string, infra string, rank string, authorship string, hybrid boolean, uncertain boolean"
_RANKS = {"var": "variety", "subsp": "subspecies", "ssp": "subspecies", "f": "form", "forma": "form"}


def parse_name(raw: str | None) -> dict:
    """Parts of one name; a missing name has none. Marks like cf. and aff. make it uncertain."""
    out = dict(genus=None, epithet=None, infra=None, rank=None, authorship=None, hybrid=False, uncertain=False)
    s = unicodedata.normalize("NFKC", raw or "").replace("_", " ").strip()
    out["hybrid"] = bool(re.search(r"(^|\s)[×xX]\s", s + " ")) or "×" in s
    tokens = re.sub(r"(^|\s)[×xX](?=\s)|×", " ", s).split()
    out["uncertain"] = any(t.rstrip(".").lower() in {"cf", "aff", "sp", "spp", "nr"} for t in tokens)
    tokens = [t for t in tokens if t.rstrip(".").lower() not in {"cf", "aff", "sp", "spp", "nr"}]
    if not tokens or not tokens[0][:1].isalpha():
        return out
    fold = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    out["genus"], out["rank"], rest = fold(tokens[0]).capitalize(), "genus", tokens[1:]
    if rest and re.fullmatch(r"\([^)]*\)", rest[0]) and len(rest) > 1 and rest[1][:1].islower():
        rest = rest[1:]
    if rest and re.fullmatch(r"[^\W\d_][^\W\d_-]*(-[^\W\d_]+)*", rest[0]) and rest[0][0].islower():
        out["epithet"], out["rank"], rest = fold(rest[0]).lower(), "species", rest[1:]
        mark = rest[0].rstrip(".").lower() if rest else ""
        if mark in _RANKS and len(rest) > 1:
            out["infra"], out["rank"], rest = fold(rest[1]).lower(), _RANKS[mark], rest[2:]
        elif rest and rest[0].isalpha() and rest[0].islower() and rest[0] not in {"de", "von", "van", "ex", "in", "et"}:
            out["infra"], out["rank"], rest = fold(rest[0]).lower(), "subspecies", rest[1:]
    out["authorship"] = " ".join(rest) or None
    return out


def _parsed(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_name(x) for x in raw], columns=[p.split()[0] for p in PARTS.split(", ")])


def parse_scientific_name(raw: Column | str) -> Column:
    """Struct of the parts of a name column."""
    return F.pandas_udf(_parsed, PARTS)(raw)
