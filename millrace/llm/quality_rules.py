"""Document rules and host verdicts with an empirical beta prior, in DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import words
from millrace.storage import staged

WINDOW = 8
#: Characters that count as symbols.
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; a document fails a rule beyond its limit."""

    min_words: int = 20
    max_repeat_pct: int = 30
    max_symbol_pct: int = 10
    max_dup_line_pct: int = 30
    #: A host is rejected when the shrunk failure rate of any rule passes this.
    max_host_rate: float = 0.9


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` from the column ``_w`` of words.

    Window hashes come by doubling (1, 2, 4, 8 words); only where two of them
    are equal are the windows compared as text.
    """

    def doubled(h: str, step: int) -> Column:
        later = F.slice(h, F.lit(1 + step), F.greatest(F.size(h) - step, F.lit(0)))
        return F.zip_with(h, later, lambda a, b: F.xxhash64(a, b))

    df = df.withColumn("_h1", F.transform("_w", lambda x: F.xxhash64(x)))
    df = df.withColumn("_h2", doubled("_h1", 1))
    df = df.withColumn("_h4", doubled("_h2", 2))
    df = df.withColumn("_h8", doubled("_h4", 4))
    df = df.withColumn("_h8", F.slice("_h8", F.lit(1), F.greatest(F.size("_w") - (WINDOW - 1), F.lit(0))))
    df = df.withColumn("_twice", F.size(F.array_distinct("_h8")) < F.size("_h8"))
    df = df.withColumn(
        "_s", F.when(F.col("_twice"), F.array_sort(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    df = df.withColumn(
        "_c",
        F.filter(
            "_s",
            lambda x, k: F.coalesce(F.get("_s", k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get("_s", k + 1)["h"] == x["h"], F.lit(False)),
        ),
    )
    df = df.withColumn(
        "_t",
        F.array_sort(
            F.transform(
                "_c",
                lambda x: F.struct(
                    x["h"].alias("h"),
                    F.array_join(F.slice("_w", x["i"] + 1, F.lit(WINDOW)), " ").alias("t"),
                    x["i"].alias("i"),
                ),
            )
        ),
    )

    def same(k: Column, x: Column) -> Column:
        return F.coalesce((F.get("_t", k)["h"] == x["h"]) & (F.get("_t", k)["t"] == x["t"]), F.lit(False))

    df = df.withColumn(
        "_p", F.array_sort(F.transform(F.filter("_t", lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))
    )
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(p - F.get("_p", k - 1), F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, b: a + b.cast("long"),
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))


def document_metrics(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the counts of each text and ``base_failed``.

    Null and empty texts have no words and fail. Columns of ``docs`` with the
    names of the counts are replaced. All is computed within the row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    has_word = lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))) > 0
    df = docs.withColumn("_w", words(F.col(text_col))).withColumn(
        "_lines", F.filter(F.split(text, "\n", -1), has_word)
    )
    df = (
        df.withColumn("n_words", F.size("_w").cast("long"))
        .withColumn("word_chars", F.char_length(F.array_join("_w", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_n_lines", F.size("_lines").cast("long"))
    )
    df = _repeat_words(df)
    # The last term is always false. It keeps filters on this column above the projections:
    # pushed below, each would copy their nested expressions once per mention.
    never = F.monotonically_increasing_id() < 0
    df = df.withColumn(
        "base_failed",
        (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))
        | never,
    )
    return df.drop("_w", "_lines", "_h1", "_h2", "_h4", "_h8", "_twice", "_s", "_c", "_t", "_p")


def rule_failures(rules: Rules = Rules()) -> dict[str, Column]:
    """What a host is judged by: one boolean per rule."""
    return {
        "base": F.col("base_failed"),
        "symbols": 100 * F.col("n_symbols") > rules.max_symbol_pct * F.col("word_chars"),
        "dup_lines": 100 * F.col("n_dup_lines") > rules.max_dup_line_pct * F.col("_n_lines"),
    }


def host_verdicts(metrics: DataFrame, host_col: str, rules: Rules = Rules()) -> DataFrame:
    """One row per host: documents, shrunk failure rate of each rule, and ``host_ok``.

    Failures are counted with map-side sums, so a host with a third of all
    rows costs no more than another. The prior of each rule is a beta
    distribution fitted to the hosts' rates by moments; a host with few
    documents is drawn to the common rate. Only two numbers per rule reach
    the driver.
    """
    fails = rule_failures(rules)
    counts = metrics.groupBy(F.col(host_col).alias("_host")).agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c.cast("long")).alias(f"_f_{k}") for k, c in fails.items()]
    )
    moments = counts.agg(
        *[F.avg(F.col(f"_f_{k}") / F.col("_n")).alias(f"m_{k}") for k in fails],
        *[F.var_pop(F.col(f"_f_{k}") / F.col("_n")).alias(f"v_{k}") for k in fails],
    ).first()
    ok = F.lit(True)
    for k in fails:
        mean, var = moments[f"m_{k}"] or 0.0, moments[f"v_{k}"] or 0.0
        strength = min(1e6, max(1.0, mean * (1 - mean) / var - 1)) if var > 0 else 1e6
        rate = (F.col(f"_f_{k}") + mean * strength) / (F.col("_n") + strength)
        counts = counts.withColumn(f"rate_{k}", rate)
        ok = ok & (rate <= rules.max_host_rate)
    return counts.withColumn("host_ok", ok)


def quality_rules(metrics: DataFrame, host_col: str = "source", rules: Rules = Rules()) -> DataFrame:
    """Metrics rows with ``kept``: false for base failures and documents of rejected hosts.

    ``metrics`` is the result of :func:`document_metrics`, best written to a
    table first, for it is read twice: by host and by row. Rows without a host
    form one host. Only rejected hosts are joined back.
    """
    bad = host_verdicts(metrics, host_col, rules).where(~F.col("host_ok")).select("_host", F.lit(True).alias("_bad"))
    joined = metrics.join(bad, metrics[host_col].eqNullSafe(bad["_host"]), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("_bad").isNull()).drop("_host", "_bad")


def passing(docs: DataFrame, host_col: str = "source", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Two passes over the texts, one for the hosts and one for the rows, which
    costs less than shuffling the texts to a table of verdicts.
    """
    # whole rows travel in one column, so no name among theirs can clash
    slim = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    hosts = host_verdicts(document_metrics(slim.select("text", "host"), "text", rules), "host", rules)
    bad = staged(hosts.where(~F.col("host_ok")).select("_host"), "rules-hosts")
    fine = document_metrics(slim, "text", rules).where(~F.col("base_failed")).select("_row", "host")
    return fine.join(bad, fine["host"].eqNullSafe(bad["_host"]), "left_anti").select("_row.*")
