"""Toxicity scores by a factorization machine over hashed terms."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.labels import PER_CLASS, taught_rows, training_labels
from millrace.llm.shingles import text_bytes, word_hashes
from millrace.llm.text import fold_of
from millrace.storage import release, staged

#: log2 of the number of hashed terms; terms the machine weighs, at most; factors of each term.
BITS, TERMS, RANK = 20, 4096, 4
#: Besides whole words, their first bytes are terms, for stems that many words share.
PREFIXES = (5, 7)
#: Bytes between terms: all of ASCII but letters.
_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _terms(texts: pa.Array, active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) for every distinct hashed term of each text; only active terms if given.

    The value of a term that occurs n times is 1 + ln n.
    """
    data, offsets = text_bytes(texts)
    h, at, *heads = word_hashes(data, offsets, _BETWEEN, PREFIXES)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    row = np.concatenate([row, *[row[x != 0] for x in heads]])
    term = (np.concatenate([h, *[x[x != 0] for x in heads]]) >> np.uint64(64 - BITS)).astype(np.int64)
    if active is not None:
        keep = active[term] >= 0
        row, term = row[keep], term[keep]
    both, n = np.unique(row << BITS | term, return_counts=True)
    return both >> BITS, both & ((1 << BITS) - 1), 1 + np.log(n)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their terms, with the values as bytes and a digest of both."""
    for b in batches:
        row, term, value = _terms(b.column("text"))
        edge = np.searchsorted(row, np.arange(len(b) + 1))
        term, value = term.astype(np.int32), value.astype(np.float32)
        parts = [(term[a:z], value[a:z].tobytes()) for a, z in zip(edge, edge[1:])]
        digests = [hashlib.blake2b(t.tobytes() + v, digest_size=16).digest() for t, v in parts]
        lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(term))
        yield pa.RecordBatch.from_arrays(
            [b.column("label"), pa.array(digests, pa.binary()), lists, pa.array([v for _, v in parts], pa.binary())],
            names=["label", "digest", "terms", "weights"],
        )


def _only(terms: np.ndarray):
    """Rows of :func:`_sampled` with nothing but the chosen ``terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, v in zip(b.column("terms"), b.column("weights").to_pylist()):
                t, v = np.asarray(t.values), np.frombuffer(v, np.float32)
                keep = np.isin(t, terms)
                out.append((t[keep].tobytes(), v[keep].tobytes()))
            cols = [pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("digest"), *cols], names=["label", "digest", "terms", "weights"])

    return run


def choose_terms(df1: np.ndarray, df0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """The ``TERMS`` terms at most whose rates differ most between the classes, from the texts of each that have them."""
    p = (df1 + df0) / (n1 + n0)
    z = np.abs(df1 / n1 - df0 / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[df1 + df0 < 8] = 0
    terms = np.sort(np.argsort(-z, kind="stable")[:TERMS])
    return terms[z[terms] > 6]


class FactorizationMachine:
    """Logistic factorization machine on weighted terms: bias, a weight and ``RANK`` factors a term.

    The pairwise part, the sum over pairs of the products of their factors,
    lets two terms together count more or less than the sum of their weights.
    """

    def __init__(self, terms: np.ndarray, weights: np.ndarray, factors: np.ndarray, bias: float) -> None:
        self.index = np.full(1 << BITS, -1, dtype=np.int32)
        self.index[terms] = np.arange(len(terms))
        self.terms, self.weights, self.factors, self.bias = terms, weights, factors, bias

    def __getstate__(self) -> tuple:
        return self.terms, self.weights, self.factors, self.bias

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def scores(self, texts: pa.Array) -> np.ndarray:
        row, term, x = _terms(texts, self.index)
        k, n = self.index[term], len(texts)
        z = self.bias + np.bincount(row, self.weights[k] * x, n)
        for f in range(self.factors.shape[1]):
            v = self.factors[k, f] * x
            z += 0.5 * (np.bincount(row, v, n) ** 2 - np.bincount(row, v * v, n))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @classmethod
    def fit(cls, sets: list[np.ndarray], values: list[np.ndarray], label: np.ndarray, share: float = 0.5, seed: int = 0, epochs: int = 300, terms: np.ndarray | None = None) -> "FactorizationMachine":
        """Fits on term sets by Adam, the classes weighed as ``share`` of label 1 and the rest.

        ``terms`` are chosen by :func:`choose_terms` where they are not given.
        """
        n1, n0 = int((label == 1).sum()), int((label == 0).sum())
        if not n1 or not n0:
            return cls(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, RANK)), 4.0 if n1 else -4.0)
        sizes = np.array([len(s) for s in sets])
        term, row = np.concatenate(sets).astype(np.int64), np.repeat(np.arange(len(sets)), sizes)
        if terms is None:
            df1, df0 = (np.bincount(term[label[row] == c], minlength=1 << BITS) for c in (1, 0))
            terms = choose_terms(df1, df0, n1, n0)
        rng = np.random.default_rng(seed)
        fm = cls(terms, np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), RANK)), 0.0)
        k = fm.index[term]
        x = np.concatenate(values).astype(np.float64)[k >= 0]
        row, k = row[k >= 0], k[k >= 0]
        weight = np.where(label == 1, share / n1, (1 - share) / n0)
        par = [fm.weights, fm.factors, np.zeros(1)]
        m, s = [np.zeros_like(x) for x in par], [np.zeros_like(x) for x in par]
        decay = [5e-5, 3e-4, 0.0]
        for t in range(1, epochs + 1):
            w, v, b = par
            vx = v[k] * x[:, None]
            sums = np.stack([np.bincount(row, vx[:, f], len(sets)) for f in range(RANK)], axis=1)
            squares = np.bincount(row, (vx**2).sum(1), len(sets))
            out = b[0] + np.bincount(row, w[k] * x, len(sets)) + 0.5 * ((sums**2).sum(1) - squares)
            d = weight * (1 / (1 + np.exp(-np.clip(out, -30, 30))) - label)
            dx = d[row] * x
            gw = np.bincount(k, dx, len(terms))
            gv = np.stack([np.bincount(k, dx * (sums[row, f] - vx[:, f]), len(terms)) for f in range(RANK)], axis=1)
            for q, g in enumerate((gw, gv, np.array([d.sum()]))):
                g = g + decay[q] * par[q]
                m[q] = 0.9 * m[q] + 0.1 * g
                s[q] = 0.99 * s[q] + 0.01 * g * g
                par[q] -= 0.1 * (m[q] / (1 - 0.9**t)) / (np.sqrt(s[q] / (1 - 0.99**t)) + 1e-8)
        fm.bias = float(par[2][0])
        return fm


def factorization_machine(
    docs: DataFrame, labels: DataFrame, column: str = "toxic", per_class: int = PER_CLASS, seed: int = 0
) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (score >= 0.5).

    At most ``2 * per_class`` labelled rows train the machine: their ids are
    broadcast (a bounded table), and of their texts only the chosen terms, at
    most ``TERMS`` each, are collected. What tasks receive is bounded as well,
    and scoring is one map over the whole texts. Null and empty texts score the
    bias; repeated rows score alike, and of rows that repeat a labelled id one
    teaches. Further columns are ignored, whatever their names.
    """
    taught = taught_rows(docs, training_labels(labels, column, per_class, seed), "text").select("label", "text")
    sampled = taught.mapInArrow(_sampled, "label int, digest binary, terms array<int>, weights binary")
    # equal term sets count once, so that copies lend their terms no weight
    once = staged(sampled.dropDuplicates(["label", "digest"]), "toxic-sample")
    n = {r["label"]: r["count"] for r in once.groupBy("label").count().collect()}
    # at most 2**BITS terms: what reaches the driver has the same bound at any size
    counts = once.select("label", F.explode("terms").alias("term")).groupBy("term").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("df1"), F.sum((F.col("label") != 1).cast("long")).alias("df0")
    )
    got = counts.where("df1 + df0 >= 8").toArrow()
    df1, df0 = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for x, c in ((df1, "df1"), (df0, "df0")):
        x[np.asarray(got.column("term").combine_chunks())] = np.asarray(got.column(c).combine_chunks())
    terms = choose_terms(df1, df0, n[1], n[0]) if len(n) == 2 else np.zeros(0, np.int64)
    got = once.mapInArrow(_only(terms), "label int, digest binary, terms binary, weights binary").collect()
    got.sort(key=lambda r: (bytes(r["digest"]), r["label"]))  # the order is fixed by content
    release(once)
    share = labels.where(F.col(column).isNotNull() & (fold_of(F.col("doc_id")) != 0)).agg(F.avg(column)).first()[0]
    model = FactorizationMachine.fit(
        [np.frombuffer(r["terms"], np.int32) for r in got],
        [np.frombuffer(r["weights"], np.float32) for r in got],
        np.array([r["label"] for r in got], np.int64),
        share or 0.5,
        seed,
        terms=terms,
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), 1000):
                part = b.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(model.scores(part.column(1)))], names=["doc_id", "score"]
                )

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
