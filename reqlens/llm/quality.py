"""Quality rules: word, line and repetition rules, and a log-likelihood ratio of hashed n-grams.

The n-grams are three bytes of UTF-8, hashed into buckets. Two multinomials over the buckets are counted, one over
trusted documents and one over the whole raw corpus. A document's score is the mean over its n-grams of the logarithm
of the ratio of their probabilities; a document passes if the score reaches a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from reqlens.llm.common import WORD_RE, bloom, renamed, restored, ship

#: Hashed n-grams: buckets, and the share of the raw multinomial that is mixed into the target's, at any size of either.
BUCKET_BITS, MIXED = 16, 0.02
#: A document is kept if its mean log-likelihood ratio is at least this.
THRESHOLD = -0.5
#: Base rules.
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 10, 5, 20
SYMBOLS = "#*$%&|<>"


def buckets(data: bytes) -> np.ndarray:
    """Buckets of the byte trigrams of a text."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKET_BITS)


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside a window of `window` words that occurs twice or more in the text, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen = {w: i for i, w in enumerate(set(words))}
    ids = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    code = ids[:n].copy()
    size = len(seen)
    for i in range(1, window):
        # codes stay exact: they are ranked anew before they could overflow
        if size * len(seen) >= 2**63:
            code = np.unique(code, return_inverse=True)[1].astype(np.uint64)
            size = n
        code = code * np.uint64(len(seen)) + ids[i : i + n]
        size *= len(seen)
    order = np.argsort(code)
    equal = code[order[1:]] == code[order[:-1]]
    if not equal.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def measures(text: str) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = WORD_RE.findall(text)
    n = len(words)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line in lines:
            dup += 1
        elif WORD_RE.search(line):
            lines.add(line)
    repeat = repeated_words(words)
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat, n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids labelled of good quality and not toxic."""
    return labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select("doc_id").distinct()


def ratio_weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket: raw over all rows of docs, target over all trusted ones.

    Trusted rows are found by a join, for which only rows that pass a Bloom filter are dealt out. Counts
    are added up on the executors; 2**BUCKET_BITS rows reach the driver. A share of the raw distribution is mixed into
    the target, so that no weight is below log(MIXED); without trusted documents every weight is 0.
    """
    ship(docs.sparkSession)
    size = 1 << BUCKET_BITS
    rows = docs.select("doc_id", "text")
    good = trusted_ids(labels).select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"))
    may = bloom(good.select(F.xxhash64("doc_id").alias("h")), "h")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may.value.has(batch.column(2).to_numpy()))).select([0, 1])

    def count(batches: Iterator[pa.RecordBatch], of: str) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                at = buckets((text.as_py() or "").encode("utf-8"))
                if len(at) > size // 8:
                    counts += np.bincount(at, minlength=size)
                else:
                    np.add.at(counts, at, 1)
        here = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(here.astype(np.int32)), pa.array(counts[here])], names=["bucket", of])

    # a shuffle join in any case: a broadcast one would put two Python workers for each core side by side
    trusted = rows.withColumn("h", F.xxhash64("doc_id")).mapInArrow(possible, rows.schema).join(good.hint("merge"), "doc_id", "left_semi")
    zero = F.lit(0).cast("long")
    raw = rows.select("text").mapInArrow(lambda b: count(b, "raw"), "bucket int, raw long").select("bucket", "raw", zero.alias("target"))
    target = trusted.select("text").mapInArrow(lambda b: count(b, "target"), "bucket int, target long").select("bucket", zero.alias("raw"), "target")
    counted = raw.unionByName(target)
    sums = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(size), np.zeros(size)
    raw[sums["bucket"].to_numpy()], target[sums["bucket"].to_numpy()] = sums["raw"].to_numpy(), sums["target"].to_numpy()
    p = (raw + 1) / (raw.sum() + size)
    q = (1 - MIXED) * target / target.sum() + MIXED * p if target.any() else p
    return np.log(q / p)


def score(text: str, weights: np.ndarray) -> float:
    """Mean weight of a text's n-grams; 0 for texts without any."""
    at = buckets(text.encode("utf-8"))
    return float(weights[at].sum() / len(at)) if len(at) else 0.0


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep_rows: bool = False) -> DataFrame:
    """Measures and verdict of every document, or (keep_rows) the rows of docs that are kept, with all their columns.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score. Null and
    empty texts have no words and fail; repeated rows and null ids are judged like others; an empty table gives no
    rows, and without labels the ratio rejects nothing. docs needs doc_id and text, labels doc_id, quality and toxic;
    extra columns are not read, or with keep_rows passed through.
    """
    ship(docs.sparkSession)
    weights = ratio_weights(docs, labels)
    plain, old = renamed(docs, "doc_id", "text")
    source = plain if keep_rows else docs.select("doc_id", "text")
    at = source.columns.index("text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = source.schema if keep_rows else T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(at):
                text = text.as_py() or ""
                m = measures(text)
                s = score(text, weights)
                rows.append((*m, not m[-1] and s >= threshold, s))
            if keep_rows:
                yield batch.filter(pa.array([r[6] for r in rows], pa.bool_()))
            elif rows:
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()])]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *names, "base_failed", "kept", "score"])

    out = source.mapInArrow(judge, schema)
    return restored(out, old, docs.columns) if keep_rows else out
