"""Substring deduplication by a relative Lempel-Ziv parse against an index of content-defined blocks.

Every text is cut into blocks at places that its content decides: of each window of `window` words the word run
(`anchor` words) with the least hash is the anchor, and the consecutive windows of one anchor are a block. The distinct
blocks of all documents, each at its least holder, are the reference. The blocks under one anchor agree on some windows
around it, which the join on (anchor, window) tells, so that a document meets just the reference blocks that it needs.

A document is then parsed from left to right: at a window that the reference holds a factor begins, and runs as far as the
chosen reference document agrees, the one that reaches farthest; the next factor begins after its last word. A factor has
a window's words at least, and is a duplicate span. A window that no factor holds can still be a duplicate where it
crosses the end of a factor, so these windows are looked up one by one. No other window can: where the reference holds a
window, a factor that begins inside of it would reach its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from reqlens.llm.common import bloom, cut, gram_hashes, mix64, renamed, restored, ship, spread, word_hashes

#: Words of a window, and of an anchor.
WINDOW, ANCHOR = 50, 16


def _bytes(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "surrogatepass")


def blocks_of(hashes: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Blocks of a text: anchor hash, first window, number of windows, words before the anchor, block hash; and the hash of each window.

    A block has at most window - anchor + 1 windows, fewer than a window has words, so that its first and last window
    cover it: they and their distance stand for its content. Anchors of equal content in equal blocks are at equal places.
    """
    n = len(hashes) - window + 1
    none = np.zeros(0, np.int64)
    if n < 1:
        return none, none, none, none, none, np.zeros(0, np.uint64)
    grams = gram_hashes(hashes, anchor)
    span = window - anchor + 1
    at = np.empty(n, np.int64)
    for start in range(0, n, 20_000):  # very long texts by parts: the view below is span times as large
        part = np.lib.stride_tricks.sliding_window_view(grams[start : min(n, start + 20_000) + span - 1], span)
        at[start : start + len(part)] = part.argmin(1) + np.arange(start, start + len(part))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    windows = gram_hashes(hashes, window)
    with np.errstate(over="ignore"):
        block = mix64(windows[first] * np.uint64(3) + mix64(windows[first + count - 1] + count.astype(np.uint64)))
    return grams[at[first]].view(np.int64), first, count, at[first] - first, block.view(np.int64), windows


def find_references(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Of each document that shares a window with one of a smaller id: doc_id, key (hash of the text), refs.

    A ref is a block of the document (start, count, lead: words before its anchor) and a reference block of a document
    with a smaller id under the same anchor (ref_id, ref_start, ref_lead). Where the reference is the same block, that is
    all; else `windows` holds its windows' hashes, to be compared with the document's.

    First pass: (anchor, id) of every block; anchors in several documents go into a Bloom filter. Second pass: the blocks
    whose anchor may be shared, with their windows' hashes. Everything after is grouped by hashes: least holder of each
    block; where an anchor has several blocks, least holder of each window under it. Sums are combined before each
    shuffle, and hot blocks are split by `spread`. Windows are compared by 64 bits under an anchor of 64.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("key"), "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(blocks_of(word_hashes(_bytes(t)), window, anchor)[0]) for t in batch.column(1)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), list(map(len, found)))))], ["a", "doc_id"])

    seen = rows.select("doc_id", "text").mapInArrow(anchors, f"a long, doc_id {id_type}")
    shared = cut(seen.groupBy("a").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("a"))
    may = bloom(shared, "a")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "block", "doc_id", "key", "start", "count", "lead", "windows"]
        for batch in batches:
            for begin in range(0, len(batch), 256):
                ids, keys, texts = (c.slice(begin, 256) for c in batch.columns)
                parts, owner, hashes = [], [], []
                for i, text in enumerate(texts):
                    a, first, count, lead, block, windows = blocks_of(word_hashes(_bytes(text)), window, anchor)
                    here = np.flatnonzero(may.value.has(a)) if len(a) else a
                    if len(here):
                        parts.append(np.stack([a, block, first, count, lead])[:, here])
                        owner.append(np.full(len(here), i))
                        hashes += [windows[first[j] : first[j] + count[j]].tobytes() for j in here]
                if parts:
                    a, block, first, count, lead = np.concatenate(parts, 1)
                    of = pa.array(np.concatenate(owner))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(block), ids.take(of), keys.take(of), *(pa.array(x.astype(np.int32)) for x in (first, count, lead)), pa.array(hashes, pa.binary())], names)

    found = cut(rows.mapInArrow(blocks, f"a long, block long, doc_id {id_type}, key long, start int, count int, lead int, windows binary"))
    places = found.select("a", "block", "doc_id", "key", "start", "count", "lead")
    index = cut(places.groupBy("a", "block").agg(F.min(F.struct("doc_id", "start", "key")).alias("least"), F.max("doc_id").alias("most")))
    repeated = index.where("least.doc_id < most").select("a", "block", "least")
    copies = spread(places, repeated, ["a", "block"]).where("doc_id > least.doc_id")

    # where an anchor has several blocks: their windows, at their least holders
    several = cut(index.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("least.doc_id").alias("low"), F.max("most").alias("high")).where("n > 1 AND low < high").select("a"))
    open_ = bloom(several, "a")

    def in_several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(open_.value.has(batch.column(0).to_numpy())))

    holders = spread(index, several, ["a"]).select("a", "block", "least")
    held = spread(found.mapInArrow(in_several, found.schema), holders, ["a", "block"]).where("doc_id = least.doc_id AND start = least.start AND key = least.key")
    held = cut(held.groupBy("a", "block").agg(*(F.min(c).alias(c) for c in ("doc_id", "key", "start", "count", "lead", "windows"))))

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 4096):
                part = batch.slice(begin, 4096)
                hashes = part.column(3).to_pylist()
                n = np.array([len(h) // 8 for h in hashes])
                owner = pa.array(np.repeat(np.arange(len(n)), n))
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(owner) for i in range(3)), pa.array(np.frombuffer(b"".join(hashes), np.int64))], ["a", "block", "doc_id", "window"])

    single = cut(held.select("a", "block", "doc_id", "windows").mapInArrow(windows_of, f"a long, block long, doc_id {id_type}, window long"))
    lows = single.groupBy("a", "window").agg(F.min(F.struct("doc_id", "block")).alias("low"), F.max("doc_id").alias("high")).where("low.doc_id < high").select("a", "window", "low")
    pairs = spread(single, lows, ["a", "window"]).where("low.doc_id < doc_id").select("a", "block", F.col("low.block").alias("ref")).distinct()
    # a block has a window's reference at most for each of its windows; only the least holder of a block is still open
    of = held.select("a", F.col("block").alias("ref"), F.col("doc_id").alias("ref_id"), F.col("start").alias("ref_start"), F.col("lead").alias("ref_lead"), "windows")
    partly = spread(spread(pairs, of, ["a", "ref"]), held.drop("windows"), ["a", "block"])

    whole = F.struct("start", "count", "lead", F.col("least.doc_id").alias("ref_id"), F.col("least.start").alias("ref_start"), F.col("lead").alias("ref_lead"), F.lit(None).cast("binary").alias("windows"))
    refs = copies.select("doc_id", "key", whole.alias("ref")).unionByName(partly.select("doc_id", "key", F.struct("start", "count", "lead", "ref_id", "ref_start", "ref_lead", "windows").alias("ref")))
    return refs.groupBy("doc_id", "key").agg(F.collect_list("ref").alias("refs"))


def parse(windows: np.ndarray | None, refs: list[dict], size: int, window: int = WINDOW) -> tuple[list[tuple], np.ndarray]:
    """Factors (start, words, ref_id, ref_start) of a document, and which of its `size` words are duplicates.

    windows: hashes of the document's windows, needed if a ref has windows to be compared.
    """
    n = size - window + 1
    runs: dict[tuple, list[tuple[int, int]]] = {}  # windows in which a reference document agrees, by the document and its distance
    for r in refs:
        start, count = r["start"], r["count"]
        shift = r["ref_start"] + r["ref_lead"] - start - r["lead"]  # from a place here to the same place there
        spans = [(start, start + count)]
        if r["windows"] is not None:
            theirs = np.frombuffer(r["windows"], np.uint64)
            first = r["ref_start"] - shift
            low, high = max(start, first), min(start + count, first + len(theirs))
            same = np.zeros(max(0, high - low) + 2, np.int8)
            same[1:-1] = windows[low:high] == theirs[low - first : high - first] if high > low else 0
            edge = np.diff(same)
            spans = [(low + a, low + z) for a, z in zip(np.flatnonzero(edge > 0).tolist(), np.flatnonzero(edge < 0).tolist())]
        runs.setdefault((r["ref_id"], shift), []).extend(spans)
    found = []
    for (ref_id, shift), spans in runs.items():
        spans.sort()
        low, high = spans[0] if spans else (0, 0)
        for a, z in spans[1:]:
            if a > high:
                found.append((low, high, ref_id, shift))
                low = a
            high = max(high, z)
        if high > low:
            found.append((low, high, ref_id, shift))
    found.sort()
    held = np.zeros(n + 1, np.int64)  # by window: runs of the reference that hold it
    for low, high, *_ in found:
        held[low] += 1
        held[high] -= 1
    held = np.cumsum(held)[:n] > 0
    factors, edge = [], np.zeros(size + 1, np.int64)
    at, k, open_ = 0, 0, []
    while at < n:
        while k < len(found) and found[k][0] <= at:
            open_.append(found[k])
            k += 1
        open_ = [f for f in open_ if f[1] > at]
        if not open_:
            if k == len(found):
                break
            at = found[k][0]
            continue
        _, high, ref_id, shift = max(open_, key=lambda f: (f[1], f[0]))
        end = high + window - 1  # words
        factors.append((at, end - at, ref_id, at + shift))
        edge[at] += 1
        edge[end] -= 1
        crossing = np.flatnonzero(held[high : min(end, n)]) + high
        np.add.at(edge, crossing, 1)
        np.add.at(edge, crossing + window, -1)
        at = end
    return factors, np.cumsum(edge)[:-1] > 0


def _parsed(data: bytes, refs: list[dict], size: int, window: int) -> tuple[list[tuple], np.ndarray]:
    windows = gram_hashes(word_hashes(data), window) if any(r["windows"] is not None for r in refs) else None
    return parse(windows, refs, size, window)


def factorise(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Factors of every document that has any: doc_id, key (hash of the text), start, n_words, ref_id, ref_start (in words).

    The factor's words are those of document ref_id, an id smaller than doc_id, from ref_start on. Null ids, null, empty
    and short texts have none; an empty table gives no rows; extra columns are not read.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    refs = find_references(docs, window, anchor).select(F.col("doc_id").alias("__id"), "key", "refs")
    rows = docs.select("doc_id", "text").withColumn("__key", F.xxhash64("text")).join(refs, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("key")))

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, owner = [], []
            for i, (text, refs) in enumerate(zip(batch.column(2), batch.column(3).to_pylist())):
                data = _bytes(text)
                found, _ = _parsed(data, refs, len(data.split()), window)
                out += found
                owner += [i] * len(found)
            of = pa.array(owner, pa.int64())
            start, size, ref, at = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(ref, batch.column(0).type), pa.array(at, pa.int32())], ["doc_id", "key", "start", "n_words", "ref_id", "ref_start"])

    return rows.select("doc_id", "key", "text", "refs").mapInArrow(factors, f"doc_id {id_type}, key long, start int, n_words int, ref_id {id_type}, ref_start int")


def without_duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, length_col: str = "n_chars") -> DataFrame:
    """docs, with all columns, where texts lose the words that `remove_duplicate_spans` takes; others stay as they are.

    length_col, if docs has it, becomes the length of a text that lost words. Nulls, empty texts, repeated rows and an
    empty table are as there; columns may have any names.
    """
    plain, names = renamed(docs, "doc_id", "text")
    left = remove_duplicate_spans(plain, window, anchor, tuple(names), rejoin=False)
    for new, old in names.items():
        if old == length_col:
            left = left.withColumn(new, F.when(F.col("n_removed") > 0, F.char_length("text").cast(docs.schema[old].dataType)).otherwise(F.col(new)))
    return restored(left, names, docs.columns)


def remove_duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, keep: tuple[str, ...] = (), rejoin: bool = True) -> DataFrame:
    """Texts without the words covered by a window whose words also start in a document with a smaller id.

    Returns doc_id, the `keep` columns of docs, n_words, n_removed and text (kept words joined by one space; with
    rejoin=False, texts that lose nothing stay as they are). Windows are judged on the input, not on what is left. Null
    and empty texts have no words and give ''; texts under a window long lose nothing; rows with a null id neither lose
    words nor count as sources; rows with equal ids are no duplicates of each other; an empty table gives no rows; extra
    columns, whatever their names, are not read. Only texts that share a window are dealt out, to meet their references.
    """
    id_type = docs.schema["doc_id"].dataType
    found = cut(find_references(docs, window, anchor).select(F.col("doc_id").alias("__id"), F.col("key").alias("__text_key"), "refs"))
    rows = docs.select("doc_id", *keep, F.col("text").alias("__text"), F.xxhash64("text").alias("__row_key"), F.xxhash64("doc_id", F.xxhash64("text")).alias("__both"))
    may = bloom(found.select(F.xxhash64("__id", "__text_key").alias("h")), "h")
    n_keys = 1 + len(keep)

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may.value.has(batch.column(n_keys + 2).to_numpy())))

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(~may.value.has(batch.column(n_keys + 2).to_numpy())))
            for at in range(0, len(part), 512):
                yield _left(part.slice(at, 512), [None] * min(512, len(part) - at))

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                yield _left(part, part.column(n_keys + 1).to_pylist())

    def _left(part: pa.RecordBatch, refs_of: list) -> pa.RecordBatch:
        rows = []
        for text, refs in zip(part.column(n_keys), refs_of):
            data = _bytes(text)
            words = data.split()
            if not refs:
                rows.append((len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass") if rejoin else text.as_py()))
                continue
            gone = _parsed(data, refs, len(words), window)[1]
            left = [words[i] for i in np.flatnonzero(~gone)]
            rows.append((len(words), len(words) - len(left), b" ".join(left).decode("utf-8", "surrogatepass")))
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays([*part.columns[:n_keys], *columns], ["doc_id", *keep, "n_words", "n_removed", "text"])

    schema = T.StructType([T.StructField("doc_id", id_type), *(docs.schema[k] for k in keep), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType())])
    dealt = rows.mapInArrow(touched, rows.schema)
    joined = dealt.join(found, (F.col("doc_id") == F.col("__id")) & (F.col("__row_key") == F.col("__text_key")), "left").select("doc_id", *keep, "__text", "refs")
    return rows.mapInArrow(untouched, schema).unionByName(joined.mapInArrow(removed, schema))
