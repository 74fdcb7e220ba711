"""Quality scores by Bradley-Terry ranking: logistic loss on feature differences of preference pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.labels import known_labels, taught_rows
from millrace.llm.shingles import shingle_sets, text_bytes, word_hashes
from millrace.llm.text import fold_of
from millrace.storage import release, staged

#: Places on the axis of scores for each unit, between which a row is divided; rows of which the last step of the cut may collect.
STEPS, LAST = 16, 20_000
#: Weight of the ridge.
RIDGE = 1e-3
#: The score at the cut between the classes.
CUT = 0.3
_CLASSES = {
    "upper": range(65, 91),
    "digit": range(48, 58),
    "symbol": b"#*$%&|<>",
    "bar": b"|",
    "bang": b"!?",
    "stop": b".,;:",
    "line": b"\n",
    "quote": b"\"'()[]{}",
    "other": range(128, 256),
}
FEATURES = ["bytes", "words", "word_bytes", "distinct_words", "top_word", "next_same", "distinct_shingles", *_CLASSES]


def _features(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text; zeros for null and empty ones. All from the whole text."""
    data, offsets = text_bytes(texts)
    hashes, at = word_hashes(data, offsets)
    sets = shingle_sets(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    member = np.zeros((256, len(_CLASSES)))
    for k, chars in enumerate(_CLASSES.values()):
        member[list(chars), k] = 1
    for i in range(len(texts)):
        n = offsets[i + 1] - offsets[i]
        if not n:
            continue
        share = (np.bincount(data[offsets[i] : offsets[i + 1]], minlength=256) @ member) / n
        w = hashes[at[i] : at[i + 1]]
        row = [np.log1p(n), np.log1p(len(w))]
        if len(w):
            _, counts = np.unique(w, return_counts=True)
            row += [n / len(w), len(counts) / len(w), counts.max() / len(w)]
            row += [(w[1:] == w[:-1]).mean() if len(w) > 1 else 0.0, len(sets[i]) / max(1, len(w) - 4)]
        else:
            row += [0.0] * 5
        out[i] = [*row, *share]
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, len(b), 500):
            part = b.slice(lo, 500)
            f = _features(part.column(1)).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(f.ravel()), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["doc_id", "features"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``features`` of every row; the texts are read once and never shuffled."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(
        _measure, "doc_id long, features array<float>"
    )


def _expand(f: np.ndarray, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
    z = np.clip((f - mean) / std, -4, 4)
    return np.hstack([z, z * z])


def _parts(taught: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """What ``f`` makes of the features and labels of each task, in an order that reruns keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = [], []
        for b in batches:
            x.append(np.asarray(b.column("features").flatten()).astype(np.float64).reshape(len(b), len(FEATURES)))
            y.append(np.asarray(b.column("label")))
        if x:
            part = f(np.concatenate(x), np.concatenate(y))
            yield pa.RecordBatch.from_arrays([pa.array([part.astype(np.float64).tobytes()], pa.binary())], names=["part"])

    rows = taught.mapInArrow(run, "part binary").collect()
    return [np.frombuffer(r) for r in sorted(bytes(r["part"]) for r in rows)]


def _divided(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place below each score, and the share of the row that goes to the one above."""
    low = np.floor(s * STEPS)
    return low.astype(np.int64), s * STEPS - low


def _placed(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows of (label, place, weight, weighted features) of the places that rows of each label come near."""
    low, up = _divided(x @ w)
    out = []
    for label in (0, 1):
        of = np.flatnonzero(y == label)
        place, at = np.unique(np.r_[low[of], low[of] + 1], return_inverse=True)
        share, rows = np.r_[1 - up[of], up[of]], np.r_[of, of]
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0]) if len(at) else np.zeros(0, int)
        weighted = np.hstack([share[:, None], x[rows] * share[:, None]])[order]
        sums = np.add.reduceat(weighted, first) if len(at) else np.zeros((0, x.shape[1] + 1))
        out.append(np.hstack([np.full((len(place), 1), label), place[:, None], sums]))
    return np.vstack(out).ravel()


def _curved(x: np.ndarray, y: np.ndarray, w: np.ndarray, places: list[np.ndarray], heights: list[np.ndarray]) -> np.ndarray:
    """Sum of the rows' squares, weighted by the heights of their label between its places."""
    s = x @ w * STEPS
    c = np.where(y == 1, np.interp(s, places[1], heights[1]), np.interp(s, places[0], heights[0]))
    return ((x * c[:, None]).T @ x).ravel()


def fit(taught: DataFrame) -> dict:
    """Weights from all preference pairs of ``taught`` (features, label): each row of label 1 is preferred to each of label 0.

    The loss is the mean of log(1 + exp(-w . (x1 - x0))) over all pairs with a
    small ridge, minimised by Newton's method. A pair counts by its difference
    of scores alone, so the rows of each label are summed at places on the axis
    of scores (each divided between the two places next to it), and pairs of
    places stand for all pairs of rows. The driver gets the sums of the tasks,
    never rows. The cut is the middle of the scores where the share of label 0
    ends. Without both labels all scores are the same.
    """
    k, n = len(FEATURES), 2 * len(FEATURES)
    sums = sum(_parts(taught, lambda x, y: np.r_[len(x), (y == 1).sum(), x.sum(0), (x * x).sum(0)]), np.zeros(2 + 2 * k))
    rows, good = int(sums[0]), int(sums[1])
    bad, w = rows - good, np.zeros(n)
    mean = sums[2 : 2 + k] / max(1, rows)
    std = np.sqrt(np.maximum(sums[2 + k :] / max(1, rows) - mean * mean, 0)) + 1e-6
    if not good or not bad:
        return {"mean": mean, "std": std, "w": w, "cut": 0.0}
    for _ in range(25):
        found = np.vstack([p.reshape(-1, n + 3) for p in _parts(taught, lambda x, y, w=w: _placed(_expand(x, mean, std), y, w))])
        places, weight, total = [], [], []
        for label in (0, 1):
            one = found[found[:, 0] == label]
            place, at = np.unique(one[:, 1], return_inverse=True)
            both = np.zeros((len(place), n + 1))
            np.add.at(both, at, one[:, 2:])
            places.append(place)
            weight.append(both[:, 0])
            total.append(both[:, 1:])
        lost = 1 / (1 + np.exp(np.clip((places[1][:, None] - places[0][None]) / STEPS, -30, 30)))
        bend = lost * (1 - lost)
        g = -(total[1].T @ (lost @ weight[0]) - total[0].T @ (lost.T @ weight[1])) / (good * bad) + RIDGE * w
        heights = [bend.T @ weight[1], bend @ weight[0]]
        square = sum(_parts(taught, lambda x, y, w=w: _curved(_expand(x, mean, std), y, w, places, heights)), np.zeros(n * n)).reshape(n, n)
        cross = total[1].T @ bend @ total[0]
        h = (square - cross - cross.T) / (good * bad) + RIDGE * np.eye(n)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return {"mean": mean, "std": std, "w": w, "cut": _cut(taught, bad, lambda x: _expand(x, mean, std) @ w)}


def _cut(taught: DataFrame, bad: int, scores: Callable[[np.ndarray], np.ndarray]) -> float:
    """The middle of the ``bad``-th and the next score of all rows, exactly."""
    ends = _parts(taught, lambda x, y: np.r_[scores(x).min(), scores(x).max()])
    lo, hi = min(p[0] for p in ends), max(p[1] for p in ends)
    return float((_ranked(taught, bad - 1, scores, lo, hi) + _ranked(taught, bad, scores, lo, hi)) / 2)


def _ranked(taught: DataFrame, k: int, scores: Callable[[np.ndarray], np.ndarray], lo: float, hi: float) -> float:
    """The score that ``k`` rows come before: counts narrow the range until few rows are in it, or equal ones."""
    while True:
        edges = np.linspace(lo, hi, 4097)

        def count(x: np.ndarray, y: np.ndarray, edges: np.ndarray = edges) -> np.ndarray:
            # how many scores are below each edge, and how many up to the last
            s = np.sort(scores(x))
            return np.r_[np.searchsorted(s, edges[:-1], "left"), np.searchsorted(s, edges[-1], "right")]

        below = sum(_parts(taught, count))
        a = min(int(np.searchsorted(below, k, "right")) - 1, 4095)
        low, high, last = edges[a], edges[a + 1], a == 4095
        if below[a + 1] - below[a] <= LAST:
            break
        if high - low <= 1e-12 * max(1.0, abs(low)):
            return float(low)
        lo, hi = low, high
    near = _parts(taught, lambda x, y: (s := scores(x))[(s >= low) & ((s <= high) if last else (s < high))])
    return float(np.sort(np.concatenate(near))[k - int(below[a])])


def bradley_terry(docs: DataFrame, labels: DataFrame, column: str = "quality") -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted.

    Features of all texts are written once to a table of about 70 bytes a row;
    every labelled row outside the held-out fold teaches (see :func:`fit`); a
    last pass over the table scores every row. Repeated rows get equal scores,
    and of rows that repeat a labelled id one teaches; null and empty texts are
    scored from zero features; texts count whole, however long. Further columns
    are ignored, whatever their names.
    """
    table = staged(measured(docs), "rank-features")
    taught = staged(taught_rows(table, known_labels(labels, column), "features", bounded=False), "rank-taught")
    model = fit(taught)
    release(taught)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column("features").flatten()).astype(np.float64).reshape(len(b), len(FEATURES))
            z = _expand(x, model["mean"], model["std"]) @ model["w"] - model["cut"] + np.log(CUT / (1 - CUT))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p)], names=["doc_id", "score"])

    scored = table.mapInArrow(score, "doc_id long, score double")
    return scored.select(
        "doc_id",
        (fold_of(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )
