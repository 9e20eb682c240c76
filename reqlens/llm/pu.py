"""Quality classifier by positive-unlabelled learning with a non-negative unbiased risk estimate.

Known are trusted positives, all other text is unlabelled, and the share of positives in it (class prior) is estimated.
With the squared loss (1 - y f)^2 / 4 and f linear in the features, the unbiased risk depends on the data only through
sums of features and of their products, taken over every document; so it is minimised exactly without a sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from reqlens.llm.common import WORD_RE, cut, ship

#: Documents labelled good that are learnt from at most (lowest hashes first): a documented bound.
POSITIVE_ROWS = 50_000
#: Fold that is held out: crc32 of the id as text, modulo FOLDS.
FOLDS, HELD_OUT = 4, 2
PREDICT_FROM = 0.7
#: Weights of the ridge, tried from the weakest until the risk of the negative class is not below zero.
RIDGES = tuple(0.01 * 3.0**e for e in range(9))
#: Positives that need no stronger ridge; with fewer it grows in proportion.
ENOUGH = 1000
SCORE_BINS = 1000

_CLASSES = 11


def _byte_classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, blank, line end, stop or comma, mark, call, other sign, lead byte, following byte."""
    out = np.full(256, 8, np.uint8)
    for i, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\v\f", b"\n", b".,;:'\"-()", b"#*$%&|<>", b"!?")):
        out[list(chars)] = i
    out[128:192], out[192:] = 10, 9
    return out


_CLASS = _byte_classes()
#: Features: shares of class pairs and of classes, both also magnified, then word and line statistics and a constant.
N_FEATURES = 2 * _CLASSES * _CLASSES + 2 * _CLASSES + 9


def features(text: str) -> np.ndarray:
    """What a score may use: the text alone. Values from 0 to 1 in steps of 1/255, so that sums over documents are exact."""
    data = _CLASS[np.frombuffer(text.encode("utf-8"), np.uint8)]
    n = max(1, len(data))
    single = np.bincount(data, minlength=_CLASSES) / n
    pairs = np.bincount(data[:-1].astype(np.int16) * _CLASSES + data[1:], minlength=_CLASSES * _CLASSES) / n
    words = WORD_RE.findall(text)
    m = max(1, len(words))
    counts = Counter(words)
    same = sum(map(eq, words, words[1:])) / m
    lines = [x for x in text.split("\n") if x.strip()]
    rest = [
        1.0, len(counts) / m, max(counts.values(), default=0) / m, same, min(1.0, 4 * same), min(1.0, sum(map(len, words)) / m / 20),
        min(1.0, np.log1p(len(words)) / 12), float(len(words) < 10), 1 - len(set(lines)) / max(1, len(lines)),
    ]
    out = np.concatenate([pairs, np.minimum(1, 12 * pairs), single, np.minimum(1, 12 * single), rest])
    return np.rint(out * 255).astype(np.uint8)


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt from; null ids count as the text ''."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def positives(labels: DataFrame, most: int = POSITIVE_ROWS) -> DataFrame:
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def solve(prior: float, mean_p: np.ndarray, square_p: np.ndarray, mean_u: np.ndarray, square_u: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """Weights that minimise the unbiased risk -prior E_P[f] + E_U[(1 + f)^2] / 4 under the weakest ridge that keeps it non-negative.

    The risk of the negative class, E_U[(1 + f)^2] / 4 - prior E_P[(1 + f)^2] / 4, is an average of losses and cannot
    truly be below 0; where its estimate is, f fits the sample's chance, and a stronger ridge is taken.
    """
    for ridge in RIDGES:
        w = np.linalg.solve(square_u / 2 + ridge * scale * np.eye(len(mean_u)), prior * mean_p - mean_u / 2)
        negative = (1 + 2 * w @ mean_u + w @ square_u @ w) / 4 - prior * (1 + 2 * w @ mean_p + w @ square_p @ w) / 4
        if negative >= 0:
            break
    return w


def _bin(f: np.ndarray) -> np.ndarray:
    return np.clip((f + 1.5) / 3 * SCORE_BINS, 0, SCORE_BINS - 1).astype(int)


def class_prior(hist_p: np.ndarray, hist_u: np.ndarray) -> float:
    """Share of positives in the unlabelled rows: the least ratio of upper tails U(score >= t) / P(score >= t).

    U holds prior * P plus negatives, so every ratio is at least the prior, and the least is near it where negatives
    score low. Tails are taken with a margin for chance, and only where a fifth of the positives are.
    """
    n_p, n_u = max(1, hist_p.sum()), max(1, hist_u.sum())
    p, u = np.cumsum(hist_p[::-1]) / n_p, np.cumsum(hist_u[::-1]) / n_u
    slack_p, slack_u = 1 / np.sqrt(n_p), 1 / np.sqrt(n_u)
    usable = p - slack_p >= 0.2
    return float(np.clip(((u + slack_u)[usable] / p[usable]).min(), 0.05, 0.99)) if usable.any() else 0.5


def pu_scores(docs: DataFrame, labels: DataFrame, most: int = POSITIVE_ROWS) -> DataFrame:
    """Quality score of every document: doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.7).

    The score is (1 + f) / 2 cut to [0, 1]: with the squared loss the best f is 2 P(good | text) - 1. Only labels of 1
    outside the held-out fold are used, as positives; every document counts as unlabelled. Null and empty texts are
    scored like others. Without positives every score is 0.5; an empty table gives no rows; repeated rows and null ids
    are scored each; extra columns are not read.

    Texts are read once: a row's features (N_FEATURES bytes) are cut into the shared checkpoint folder. Sums of
    products are integers, so that reruns agree; of these, (N_FEATURES + 1)^2 / 2 reach the driver.
    """
    ship(docs.sparkSession)
    good = positives(labels, most).select(F.col("doc_id").alias("id"), F.lit(True).alias("good"))
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(good), "id", "left")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py() or "").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bool(g) for g in batch.column(2).to_pylist()]), pa.array(found, pa.binary())], ["doc_id", "good", "x"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(rows.select("id", "text", "good").mapInArrow(extract, f"doc_id {id_type}, good boolean, x binary"))
    d = N_FEATURES
    upper = np.triu_indices(d)

    def vectors(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, d)
        return x, np.array(batch.column(0).to_pylist(), bool)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square, n = np.zeros((2, d, d)), np.zeros(2, np.int64)
        for batch in batches:
            for start in range(0, len(batch), 2000):
                x, own = vectors(batch.slice(start, 2000))
                for k, part in enumerate((x[own].astype(np.float64), x.astype(np.float64))):
                    square[k] += part.T @ part  # integers below 2**53: exact
                    n[k] += len(part)
        flat = [np.concatenate([[n[k]], square[k][upper]]).astype(np.int64) for k in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat[0]), dtype=np.int32)), *map(pa.array, flat)], ["i", "p", "u"])

    total = rows.select("good", "x").mapInArrow(sums, "i int, p long, u long").groupBy("i").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow()
    flat = np.zeros((2, 1 + len(upper[0])))
    for k, name in enumerate("pu"):
        flat[k][total["i"].to_numpy()] = total[name].to_numpy()
    weights = None
    if flat[0][0] and flat[1][0]:
        square = np.zeros((2, d, d))
        for k in range(2):
            square[k][upper] = flat[k][1:] / flat[k][0] / 255**2
            square[k] = square[k] + np.triu(square[k], 1).T
        one = 2 * _CLASSES * _CLASSES + 2 * _CLASSES  # the constant feature: products with it are the means
        stats = (square[0][one], square[0], square[1][one], square[1])
        scale = max(1.0, ENOUGH / flat[0][0])
        first = solve(0.5, *stats, scale)

        def histograms(by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                hist = np.zeros((2, SCORE_BINS), np.int64)
                for batch in batches:
                    x, own = vectors(batch)
                    at = _bin(x @ by / 255)
                    hist[0] += np.bincount(at[own], minlength=SCORE_BINS)
                    hist[1] += np.bincount(at, minlength=SCORE_BINS)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(SCORE_BINS, dtype=np.int32)), pa.array(hist[0]), pa.array(hist[1])], ["i", "p", "u"])

            found = rows.select("good", "x").mapInArrow(count, "i int, p long, u long").groupBy("i").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).toArrow().sort_by("i")
            return found["p"].to_numpy(), found["u"].to_numpy()

        weights = solve(class_prior(*histograms(first)), *stats, scale)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, d)
            scores = np.full(len(x), 0.5) if weights is None else np.clip((x @ weights / 255 + 1) / 2, 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    scored = rows.select("doc_id", "x").mapInArrow(rate, f"doc_id {id_type}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
