"""Personal data: exact base patterns, and candidate spans chosen by boosted trees; DataFrame operations only."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import boosting
from millrace.storage import staged

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns. A card run is taken with its bounds, so that only runs of 13 to 19 digits match at all. E-mails and
#: addresses begin where a run of their first characters does, or where the match before ended in it: any other start
#: in the run has the same continuation. Possessive repeats neither go back nor recurse, so long runs take linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: what might be an item of each kind in another format.
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]{2,40}(?:@|[\x20]?[\[({](?:at|AT)[\])}][\x20]?|[\x20]at[\x20])[A-Za-z0-9-]{2,40}"
    r"(?:(?:\.|[\x20]?[\[({](?:dot|DOT)[\])}][\x20]?|[\x20]dot[\x20])[A-Za-z]{2,10})++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:(?:\.|\[\.\]|[\x20]\.[\x20])[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9+])(?:(?:00|\+)[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20./-][0-9]{4}(?![0-9])",
}
#: A text without a match of these has none of the kind's base or loose patterns either.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
MAY = {
    "email": r"@|[\[({](?:at|AT)[\])}]|[\x20]at[\x20][A-Za-z0-9-]{2,40}[\x20]?[\[({.d]",
    "ip": r"[0-9](?:\.|\[\.\]|[\x20]\.[\x20])[0-9]",
    "card": "[0-9]{4}",
    "phone": "[0-9]{3}",
}
#: Words before an item that speak for a kind.
CUES = {
    "email": r"(?i)mail|contact|write",
    "ip": r"(?i)\bip\b|host|server|addr",
    "card": r"(?i)card|visa|master|credit|pay",
    "phone": r"(?i)phone|tel\b|tel[.:]|call|fax|mobile",
}
#: Words before an item that speak for a number of another sort.
OTHER = r"(?i)order|part|item|\bref|invoice|serial|version|section|chapter|page|isbn|build|release|\bsku|\blot\b|\bno[.]"
#: What the item itself must look like to be plausible, beside its checksum or ranges.
TOP = r"[^A-Za-z](?:com|org|net|edu|gov|info|biz|io|co|de|fr|es|it|nl|uk|us|eu|ch|COM|ORG|NET|EDU)$"
ISSUED = r"^(?:[3-6]|2[2-7])"
DIALLED = r"^(?:\+|00|\(|[2-9][0-9]{2}[\x20./-]{1,2}[2-9])"
FEATURES = ["length", "digits", "letters", "dots", "ats", "spaces", "separators", "slashes", "brackets", "cue", "other", "label", "glued", "plus", "spelled", "valid"]
#: Made-up examples of each kind that the trees are fitted on, half of them items.
EXAMPLES = 1_200
CONTEXT = 24
#: Matches whose places are summed up together.
GROUP = 64

_SPAN = "array<struct<kind:int,start:bigint,end:bigint,item:string>>"


def _once(column: Column) -> Column:
    """The column, in a form that Catalyst neither copies to where it is used nor merges into later projections.

    It would be evaluated once for each mention, inside a lambda once for each
    element, and the plan would grow with the power of the steps.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def _groups(name: str) -> Column:
    """The array column ``name`` in pieces of ``GROUP``.

    Appending to an array copies what is there, so long arrays are built piece
    by piece.
    """
    n = F.size(name)
    firsts = F.filter(F.sequence(F.lit(0), n), lambda i: (i % GROUP == 0) & (i < n))
    return F.transform(firsts, lambda i: F.slice(F.col(name), i + 1, F.lit(GROUP)))


def _found(df: DataFrame, name: str, kind: str, pattern: str, needs: str) -> DataFrame:
    """Adds the array ``name`` of (kind, start, end, item) of a pattern's matches; places in code points.

    The pieces between the matches and the matches themselves alternate, so
    running sums of their lengths are the places.
    """
    text, empty = F.col("_text"), F.array().cast("array<string>")
    df = df.withColumn(
        "_items", _once(F.when(text.rlike(needs), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty))
    )
    df = df.withColumn("_gaps", F.when(F.size("_items") > 0, F.split(text, pattern, -1)).otherwise(empty))
    items, gaps = F.col("_items"), F.col("_gaps")
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(items)).alias("gap"), items.alias("item"))
    none = F.array().cast(_SPAN)
    k = F.lit(KINDS.index(kind))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["gap"])
        end = start + F.char_length(p["item"])
        span = F.struct(k.alias("kind"), start.alias("start"), end.alias("end"), p["item"].alias("item"))
        return F.struct(F.array_append(acc["spans"], span).alias("spans"), end.alias("at"))

    long = lambda x: F.lit(x).cast("bigint")
    lengths = F.transform("_groups", lambda g: F.aggregate(g, long(0), lambda a, p: a + F.char_length(p["gap"]) + F.char_length(p["item"])))
    begins = F.aggregate(
        lengths,
        F.struct(F.array().cast("array<bigint>").alias("all"), long(0).alias("at")),
        lambda acc, n: F.struct(F.array_append(acc["all"], acc["at"]).alias("all"), (acc["at"] + n).alias("at")),
        lambda acc: acc["all"],
    )
    df = df.withColumn("_pairs", _once(pairs)).withColumn("_groups", _once(_groups("_pairs"))).withColumn("_begins", begins)
    found = F.zip_with(
        "_groups", "_begins", lambda g, b: F.aggregate(g, F.struct(none.alias("spans"), b.alias("at")), step, lambda acc: acc["spans"])
    )
    return df.withColumn(name, _once(F.flatten(found))).drop("_items", "_gaps", "_pairs", "_groups", "_begins")


def _digits(item: Column) -> Column:
    return F.regexp_replace(item, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the last digit checks: every second digit from the right is doubled, and its digits added."""
    values = F.reverse(F.transform(F.array_remove(F.split(digits, ""), ""), lambda d: d.cast("int")))
    terms = F.transform(
        values, lambda v, i: F.when(i % 2 == 0, v).when(v >= 5, 2 * v - 9).otherwise(2 * v)
    )
    return F.aggregate(terms, F.lit(0), lambda a, b: a + b) % 10 == 0


def _octets(item: Column) -> Column:
    parts = F.transform(F.split(item, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def with_base_spans(df: DataFrame) -> DataFrame:
    """Adds per kind the array of exact spans of ``_text``: leftmost, not overlapping, failing matches dropped."""
    for k in KINDS:
        df = _found(df, k, k, BASE[k], NEEDS[k])
    df = df.withColumn("ip", F.filter("ip", lambda s: _octets(s["item"])))
    df = df.withColumn("card", F.filter("card", lambda s: _luhn(_digits(s["item"]))))
    return df.withColumn("phone", F.filter("phone", lambda s: F.length(_digits(s["item"])).between(9, 15)))


def _apart(spans: Column, others: Column) -> Column:
    """Those ``spans`` that overlap none of ``others``."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (s["start"] < o["end"]) & (o["start"] < s["end"])))


def _plausible(kind: Column, item: Column) -> Column:
    """Whether the item has a usual ending, octets up to 255, an issuer with the right check digit, or a dialling form."""
    octets = F.regexp_replace(item, r"[\[\]\x20]", "")
    return (
        F.when(kind == 0, item.rlike(TOP))
        .when(kind == 1, _octets(octets))
        .when(kind == 2, item.rlike(ISSUED) & _luhn(_digits(item)))
        .otherwise(item.rlike(DIALLED))
    )


def _described(wide: Column, spans: Column) -> Column:
    """Candidates with the features the trees read; ``wide`` is the text in UTF-32, where a place is found at once."""

    def describe(s: Column) -> Column:
        item = s["item"]
        first = 4 * F.greatest(s["start"] - CONTEXT, F.lit(0)) + 1
        before = F.decode(F.substring(wide, first.cast("int"), (4 * F.least(s["start"], F.lit(CONTEXT))).cast("int")), "UTF-32")
        cue = F.lit(False)
        for i, k in enumerate(KINDS):
            cue = cue | ((s["kind"] == i) & before.rlike(CUES[k]))
        count = lambda p: F.regexp_count(item, F.lit(p)).cast("double")
        return F.struct(
            s["kind"].alias("kind"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.array(
                F.char_length(item).cast("double"),
                count("[0-9]"),
                count("[A-Za-z]"),
                count(r"\."),
                count("@"),
                count(r"\x20"),
                count("[_-]"),
                count("/"),
                count(r"[\[\](){}]"),
                cue.cast("double"),
                before.rlike(OTHER).cast("double"),
                before.rlike(r"[:=][\x20]?\z").cast("double"),
                before.rlike(r"[A-Za-z0-9]\z").cast("double"),
                count(r"\+"),
                count(r"(?i)[\x20\[({]dot[\x20\])}]|\[\.\]|\x20\.\x20"),
                _plausible(s["kind"], item).cast("double"),
            ).alias("x"),
        )

    return F.transform(spans, describe)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row its id, the base spans of each kind, and the other, loose candidates with features. One pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"))
    df = with_base_spans(df)
    for k in KINDS:
        df = _found(df, f"_loose_{k}", k, LOOSE[k], MAY[k])
    # most are base spans themselves: those go by hashing, before any is described or compared with all
    coded = lambda spans: F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"], s["item"]))
    others = F.array_except(coded(F.concat(*[f"_loose_{k}" for k in KINDS])), coded(F.concat(*KINDS)))
    df = df.withColumn("_parts", _once(F.transform(others, lambda x: F.split(x, ":", 4))))
    df = df.withColumn(
        "_loose",
        _once(
            F.transform(
                "_parts",
                lambda p: F.struct(p[0].cast("int").alias("kind"), p[1].cast("bigint").alias("start"), p[2].cast("bigint").alias("end"), p[3].alias("item")),
            )
        ),
    )
    df = df.withColumn("_wide", _once(F.when(F.size("_parts") > 0, F.encode("_text", "UTF-32"))))
    bare = [F.transform(k, lambda s: s.dropFields("item")).alias(k) for k in KINDS]
    return df.select("doc_id", *bare, F.when(F.size("_loose") == 0, F.lit(None)).otherwise(_described(F.col("_wide"), F.col("_loose"))).alias("loose"))


def _example(rng: random.Random, kind: int, good: bool) -> str:
    """A made-up text with one candidate of the kind: an item, or something that only looks like one."""
    word = lambda a=2, b=9: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    digits = lambda k, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(k - 1))
    cue, other = "", rng.choice(["order", "part no.", "item", "ref", "invoice", "serial", "version", "section", "page", "build", "SKU"])
    cues = [["mail", "e-mail", "contact", "write to"], ["ip", "host", "server", "address"], ["card", "visa", "pay by", "credit"], ["phone", "tel", "call", "fax", "mobile"]]
    said = rng.choice(cues[kind]) + rng.choice([" ", ": ", ":", " = "])
    wrong = other + rng.choice([" ", ": ", " # "])
    maybe = lambda: rng.choice(["", "", said])
    if kind == 0:
        user, host, top = rng.choice([word(), f"{word(1)}.{word(1)}", f"{word()}{digits(2)}", f"{word()}.{digits(2)}"]), rng.choice([word(), f"{word()}-{word()}", f"{word()}{digits(1)}"]), rng.choice("com org net edu de fr es io".split())
        o, c = rng.choice(["[]", "()", "{}"])
        if not good:
            cue, word_ = rng.choice(["", "", "", wrong, said]), word(2, 7)
            item = rng.choice([f"{word()} at {word()}.{word_.capitalize()}", f"{word()} at {word()}.{word_}", f"{word()} at {word()} dot {word_}y", f"{word()} at {word()}.{top}", f"{word()} {o}at{c} {word()}.{word_}y"])
        else:
            at, dot = rng.choice([(f" {o}at{c} ", f" {o}dot{c} "), (f"{o}at{c}", f"{o}dot{c}"), (f" {o}at{c} ", "."), (" at ", " dot "), ("@", f" {o}dot{c} "), ("@", " dot "), (f" {o}AT{c} ", f" {o}DOT{c} ")])
            cue, item = maybe(), user + at + host + dot + (f"{word(2)}{dot}" if rng.random() < 0.3 else "") + top
    elif kind == 1:
        octets = [str(rng.randint(0, 255)) for _ in range(4)]
        if good:
            how = rng.choice(["[.]", "mixed", " . "])
            cue = said if how == " . " else maybe()
            item = f"{octets[0]}[.]" + ".".join(octets[1:]) if how == "mixed" else how.join(octets)
        else:
            how = rng.choice(["large", "spaced", "version"])
            cue = wrong if how == "version" else maybe() if how == "large" else ""
            if how == "large":
                octets[rng.randrange(4)] = str(rng.randint(256, 999))
            item = (rng.choice([".", "[.]", " . "]) if how == "large" else " . ").join(octets)
    elif kind == 2:
        d = rng.choice("3456") + digits(14) if good or rng.random() < 0.6 else rng.choice("01789") + digits(14)
        last = next(c for c in "0123456789" if _checks(d + c))
        if good:
            cue = maybe()
        elif d[0] in "3456":
            if rng.random() < 0.7:
                cue, last = rng.choice(["", said, wrong]), str((int(last) + rng.randint(1, 9)) % 10)
            else:
                cue = wrong
        else:
            cue = rng.choice(["", wrong])
        d += last
        item = rng.choice([".", "_", "/", "  ", " - ", " / ", ". "]).join(d[i : i + 4] for i in range(0, 16, 4))
    else:
        area, exchange, line = digits(3, "23456789"), digits(3, "23456789"), digits(4)
        sep = rng.choice("-.")
        plain, spaced, slashed = f"{area}{sep}{exchange}{sep}{line}", f"{area} {exchange} {line}", f"{area}/{exchange}/{line}"
        if good:
            any_area = digits(3)
            # a following address or number makes the exact pattern run on and fail
            after = " " + ".".join(digits(rng.randint(2, 3), "12") for _ in range(4))
            country = rng.choice(["+1 ", f"+{digits(2, '23456789')} ", "+1-", "+1."])
            cue, item = rng.choice(
                [
                    (maybe(), f"{country}({any_area}) {exchange}-{line}{after}"),
                    (maybe(), f"{country}{any_area} {exchange} {line}{after}"),
                    (maybe(), f"({any_area}) {exchange}-{line}"),
                    (maybe(), f"00{digits(2, '123456789')} {any_area}-{exchange}-{line}"),
                    (maybe(), plain),
                    (said, spaced),
                    (said, slashed),
                ]
            )
        else:
            low = f"{digits(3, '01')}{sep}{digits(3, '01')}{sep}{line}"
            cue, item = rng.choice([(wrong, plain), (wrong, spaced), (wrong, slashed), ("", spaced), ("", slashed), ("", low), (word().upper(), plain)])
    lead = " ".join(word() for _ in range(rng.randint(4, 9))) + rng.choice([" ", " ", ". ", ", ", "\n"])
    return lead + cue + item + rng.choice(["", " ", ", ", "\n"]) + (word() if item[-1].isdigit() else "")


def _checks(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


#: (trees, cut) of each kind once they are fitted; they depend on the made-up examples alone.
_MODELS: list[tuple[tuple[float, list[boosting.Node]], float]] = []


def models(spark: SparkSession) -> list[tuple[tuple[float, list[boosting.Node]], float]]:
    """Per kind the boosted trees and the calibrated cut, fitted on seeded made-up examples and never on the tables.

    Two thirds of the examples train; on the rest the cut is the lowest
    log-odds, but 0 at least, above which 99% are items. The features come from
    :func:`candidates`, as those of any text do.
    """
    if not _MODELS:
        rng = random.Random(4)
        rows = [(k, good, _example(rng, k, good)) for k in range(len(KINDS)) for _ in range(EXAMPLES // 2) for good in (False, True)]
        docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
        found = candidates(docs).select("doc_id", F.explode("loose").alias("c")).select("doc_id", "c.kind", "c.start", "c.x").collect()
        found = sorted((r for r in found if r["kind"] == rows[r["doc_id"]][0]), key=lambda r: (r["doc_id"], r["start"]))
        fitted = []
        for k in range(len(KINDS)):
            own = [r for r in found if r["kind"] == k]
            x = np.array([r["x"] for r in own], dtype=np.float64)
            y = np.array([rows[r["doc_id"]][1] for r in own], dtype=np.float64)
            fitted.append(_trained(x, y))
        _MODELS.extend(fitted)
    return _MODELS


def _trained(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, list[boosting.Node]], float]:
    """Trees, and the cut that keeps 99% right on every third example."""
    held = np.arange(len(y)) % 3 == 0
    model = boosting.fit(x[~held], y[~held], depth=4)
    z, t = boosting.raw_scores(model, x[held]), y[held]
    order = np.argsort(-z, kind="stable")
    precision = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
    # a cut lies between different scores, or it would let in all that tie with it
    ends = np.r_[z[order][1:] < z[order][:-1], True]
    good = np.flatnonzero((precision >= 0.99) & ends & (np.arange(1, len(order) + 1) >= 10))
    if not len(good):
        raise ValueError("no cut keeps 99% right")
    # halfway to the next lower score, so that rounding of a sum does not decide
    z = z[order]
    after = z[good[-1] + 1] if good[-1] + 1 < len(z) else z[good[-1]] - 1
    return model, max(0.0, float((z[good[-1]] + after) / 2))


def redactions(found: DataFrame) -> DataFrame:
    """``found`` (from :func:`candidates`, written to a table) with ``extra``: chosen spans beside the base ones.

    Candidates of a document that overlap no base span and score above their
    kind's cut are added, of overlapping ones the first. A document's spans
    depend on its text alone.
    """
    fitted = models(found.sparkSession)

    def passes(c: Column) -> Column:
        x = [F.get(c["x"], F.lit(i)) for i in range(len(FEATURES))]
        out = F.lit(False)
        for k, (model, cut) in enumerate(fitted):
            out = F.when(c["kind"] == k, boosting.score_column(model, x) >= F.lit(cut)).otherwise(out)
        return out

    span = "array<struct<kind:int,start:bigint,end:bigint>>"
    none = F.array().cast(span)
    found = found.withColumn("_base", _once(F.concat(*KINDS)))
    free = F.when(F.size("_base") == 0, F.col("loose")).otherwise(_apart(F.col("loose"), F.col("_base")))
    slim = F.array_sort(
        F.transform(F.filter(free, passes), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    )
    found = found.withColumn("_slim", _once(F.coalesce(slim, F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>"))))

    def step(acc: Column, c: Column) -> Column:
        span = F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
        kept = F.struct(F.array_append(acc["spans"], span).alias("spans"), c["end"].alias("at"))
        return F.when(c["start"] >= acc["at"], kept).otherwise(acc)

    def group(acc: Column, g: Column) -> Column:
        got = F.aggregate(g, F.struct(none.alias("spans"), acc["at"].alias("at")), step)
        return F.transform(F.array(got), lambda x: F.struct(F.array_append(acc["all"], x["spans"]).alias("all"), x["at"].alias("at")))[0]

    start = F.struct(F.array().cast(f"array<{span}>").alias("all"), F.lit(0).cast("bigint").alias("at"))
    extra = F.flatten(F.aggregate(_groups("_slim"), start, group, lambda a: a["all"]))
    return found.withColumn("extra", extra).drop("_slim", "_base")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, by kind, then start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans.

    Null and empty texts have no spans and the digest of the empty string.
    Repeated rows are treated alike; columns beside id and text are ignored,
    whatever their names. Texts are searched whole; the patterns take linear
    time on long runs.
    """
    found = redactions(staged(candidates(docs, id_col, text_col), "pii-candidates"))
    base = F.concat(*KINDS)
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.concat(base, "extra")).alias("spans"),
    )


def redacted(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``found`` (doc_id, spans as one string) replaced by its kind in brackets."""
    spans = found.where("spans <> ''").select(F.col("doc_id").alias("_i"), F.split("spans", ",").alias("_s"))
    parts = F.transform("_s", lambda s: F.split(s, ":"))
    ordered = F.array_sort(
        F.transform(parts, lambda p: F.struct(p[1].cast("int").alias("a"), p[2].cast("int").alias("b"), p[0].alias("k")))
    )
    text = F.col(text_col)

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["a"] - acc["at"], F.lit(0)))
        return F.struct(
            F.concat(acc["out"], gap, F.lit("["), s["k"], F.lit("]")).alias("out"), F.greatest(acc["at"], s["b"]).alias("at")
        )

    clean = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        step,
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.char_length(text) - acc["at"], F.lit(0)))),
    )
    joined = docs.join(spans, docs[id_col] == spans["_i"], "left")
    new = F.when(F.col("_s").isNull(), text).otherwise(clean)
    return joined.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])
