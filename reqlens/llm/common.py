"""Shared pieces of the corpus operators: word patterns, hashes of words, lineage cuts, and bounded Bloom filters."""

from __future__ import annotations

import re
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of characters other than ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD_PATTERN)

#: Bits of a Bloom filter for each key that it holds, and the least and most bits of one (as powers of 2): 2**28 bits are
#: 32 MB on every executor, whatever the input.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 16, 28


#: Bytes of a batch of rows for Python; the setting, and its default, which is what is replaced.
BATCH_BYTES = "8m"
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder that the cluster names in spark.checkpoint.dir; set one only where none is named (tests).

    A folder of one machine would be no use to the others, so that a cluster without a named folder is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="reqlens-checkpoint-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once, into the shared checkpoint folder: a lost executor costs no recomputation of what is above."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application: they need not find it on a path of their own.

    Rows hold whole texts, and every worker's batch lies outside the JVM's heap, twice while it grows: unless the session
    says otherwise, batches for Python are kept to BATCH_BYTES.
    """
    import zipfile
    from pathlib import Path

    if spark.conf.get(_BATCH_SETTING, None) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    context = spark.sparkContext
    if getattr(context, "_reqlens_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="reqlens-")) / "reqlens_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(to))
    context._reqlens_shipped = True


def words_column(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of a text that are hashed at once, up to the next white space.
_PIECE = 1 << 20
_multipliers: list[np.ndarray] = [np.zeros(0, np.uint64)]


def _multipliers_to(n: int) -> np.ndarray:
    """Random 64-bit numbers, one for each place in a word; the same in every process."""
    if len(_multipliers[0]) < n:
        with np.errstate(over="ignore"):
            _multipliers[0] = mix64(np.arange(1, max(2 * n, 1 << 10) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _multipliers[0]


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of a UTF-8 text, equal for equal words: sums of byte times a random number of its place.

    Such sums are universal: two different words have one hash with a chance of at most 2**-56, whatever the words are.
    (In a polynomial modulo 2**64, which needs no random numbers, long words of a regular build collide for any base.)
    Words are split at ASCII white space, as bytes.split() does. No word becomes a Python object.
    """
    if len(data) > _PIECE:
        out, at = [], 0
        while at < len(data):
            m = _SPACE.search(data, at + _PIECE)
            end = m.start() if m else len(data)
            out.append(_word_hashes(data[at:end]))
            at = end
        return np.concatenate(out)
    return _word_hashes(data)


def _word_hashes(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    space = np.ones(len(b) + 2, np.int8)
    space[1:-1] = (b == 32) | (b - np.uint8(9) < 5)
    edge = np.diff(space)
    starts, ends = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    values = b[space[1:-1] == 0].astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        values *= _multipliers_to(int(sizes.max()))[place]
        return mix64(np.add.reduceat(values, first))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two parts from theirs, in order; mixed at each join, so that nothing of it is a sum that could cancel."""
    return mix64(a * np.uint64(0xD6E8FEB86659FD93) + b * np.uint64(0xA0761D6478BD642F) + np.uint64(0x8EBC6AF09C88C6E3))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, from the words' hashes, by doubling; runs of equal words have equal hashes."""
    with np.errstate(over="ignore"):
        width, power = 1, hashes
        out, have = None, 0
        while True:
            if n & width:
                shifted = power[have : len(power)]
                out = power if out is None else _joined(out[: len(shifted)], shifted[: len(out)])
                have += width
            if have == n:
                return mix64(out[: max(0, len(hashes) - n + 1)])
            power = _joined(power[:-width], power[width:]) if len(power) > width else power[:0]
            width *= 2


def renamed(docs: DataFrame, *kept: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with all columns but the kept ones named c0, c1, ..., and their old names by the new ones: nothing can clash."""
    names = {f"c{i}": c for i, c in enumerate(docs.columns) if c not in kept}
    new = {c: n for n, c in names.items()}
    return docs.select(*(F.col(f"`{c}`").alias(new.get(c, c)) for c in docs.columns)), names


def restored(rows: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """The columns of a frame that `renamed` has been given, under their old names and in their order."""
    new = {c: n for n, c in names.items()}
    return rows.select(*(F.col(new.get(c, c)).alias(c) for c in columns))


def spread(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which Spark may split the rows of a hot key over tasks.

    Adaptive execution splits a skewed partition only if the join's own exchange dealt it out. An aggregate keyed as the
    join is leaves its rows dealt out already; joining on one more key, a hash of the others, makes Spark deal both anew.
    """
    key = F.xxhash64(*on, F.lit(1)).alias("__key")
    return left.select("*", key).join(right.select("*", key), [*on, "__key"], how).drop("__key")


class Bloom:
    """A filter over a column of 64-bit hashes, sized by their number. It never misses a key, and lets some others through.

    With BITS_A_KEY bits a key that is one other key in 70. Beyond 2**MOST_BITS bits the share rises, up to all of them:
    filters only spare work, and whoever uses one must be right without it. The bits are or-ed on the executors by word of
    64 bits, so that at most 2**MOST_BITS / 64 rows reach the driver.
    """

    def __init__(self, keys: DataFrame, key: str):
        n = keys.count()
        self.bits = min(max((BITS_A_KEY * n - 1).bit_length(), LEAST_BITS), MOST_BITS)
        places = [F.shiftright(key, 4 + i * 29).bitwiseAND(F.lit((1 << self.bits) - 1)) for i in range(2)]  # two disjoint runs of a key's bits
        words = (
            keys.select(F.explode(F.array(*places)).alias("at"))
            .groupBy(F.shiftright("at", 6).cast("int").alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set"))
        )
        self.words = np.zeros(1 << (self.bits - 6), np.uint64)
        found = words.toArrow()
        self.words[found["word"].to_numpy()] = found["set"].to_numpy().view(np.uint64)

    def has(self, keys: np.ndarray) -> np.ndarray:
        """Which of the keys (int64) may be in it."""
        out = np.ones(len(keys), bool)
        for i in range(2):
            at = (keys >> np.int64(4 + i * 29)) & np.int64((1 << self.bits) - 1)
            out &= (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
        return out


def bloom(keys: DataFrame, key: str):
    """Broadcast Bloom filter of a column; `keys` is read twice and should be cut or cheap."""
    return keys.sparkSession.sparkContext.broadcast(Bloom(keys, key))
