"""Exact set-similarity join of word n-grams by universe partition and the pigeonhole principle.

Two sets with Jaccard similarity of num / den or more differ in at most H = (den - num) (|x| + |y|) / (den + num)
n-grams. Hashing deals the n-grams into H + 1 segments, by a number of segments that depends on the size band alone.
Then in one segment the two sets agree whole, and equal segment subsets are found by their hash. Where a segment's
subset is empty or tiny, many sets share it; such a segment is left out by allocation: another one (the first), of
which the index also holds all subsets with one n-gram deleted, is searched with one difference allowed, and the
allowances still add up to more than H.

No pair of texts is ever a row. The texts of a key are compared in one task, in blocks of bounded size: first by small
parity bitmaps, which tell exactly that two sets are too different, then by the n-grams themselves. What leaves a task is
a spanning forest of the links found, at most one row a text and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reqlens.llm.common import bloom, cut, gram_hashes, mix64, renamed, restored, ship, spread, word_hashes

#: n-grams of a text, and the least similarity as a fraction.
GRAM, SIMILAR = 3, (90, 100)
#: Edges (16 bytes each) that one task joins into components at most.
ONE_TASK_EDGES = 1_000_000
#: Segments with at most so many n-grams are left out, if another can be allowed a difference instead.
TINY = 1
#: Texts, and n-grams of texts, of a block: what one task compares comes from two blocks at most.
BLOCK_TEXTS, BLOCK_GRAMS = 2048, 1_000_000
#: Least and most bits of a parity bitmap.
LEAST_BITMAP, MOST_BITMAP = 64, 8192


def gram_set(text: str | None, gram: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word n-grams of a text with A-Z lower-cased; a shorter text is one n-gram."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())  # lower() of bytes is ASCII only
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(gram_hashes(words, min(gram, len(words))))


def bands(similar: tuple[int, int], most: int) -> np.ndarray:
    """Least sizes of the size bands. The sizes similar to one in a band lie in it and its neighbours."""
    num, den = similar
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return np.array(out)


def differences(low: int, similar: tuple[int, int]) -> int:
    """H of a band as index: most differences between a set in it and a similar one of at least its size."""
    num, den = similar
    high = low * den // num
    return (den - num) * (high + high * den // num) // (den + num)


def segment_keys(grams: np.ndarray, value: np.ndarray, band: int, m: int, index: bool, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set under a band's partition into m segments, and whether each is searched (else only found).

    grams are sorted and a segment is a range of their universe, so that segments are runs. value: grams mixed anew.
    """
    with np.errstate(over="ignore"):
        segment = ((grams >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
        at = segment[starts].astype(np.int64)
        sums, sizes = np.zeros(m, np.uint64), np.zeros(m, np.int64)
        sums[at] = np.add.reduceat(value, starts)
        sizes[at] = np.diff(np.concatenate([starts, [len(grams)]]))
        place = (np.arange(m, dtype=np.uint64) + np.uint64((band << 32) + 1)) * np.uint64(0x9E3779B97F4A7C15)
        exact = mix64(sums ^ place)
        searched = np.full(m, probe)
        rest = int(sizes[1:].argmin()) + 1 if m > 1 else 0
        swap = m > 1 and sizes[rest] <= TINY and sizes[0] > TINY
        if swap:
            searched[rest] = False
        if not index:
            exact, searched = exact[searched], searched[searched]
        if not (index or swap):
            return exact, searched
        deleted = mix64((sums[0] - value[: sizes[0]]) ^ place[0])
        return np.concatenate([exact, deleted]), np.concatenate([searched, np.full(len(deleted), probe and swap)])


def keys_of(grams: np.ndarray, gram: int, similar: tuple[int, int], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of a set: in its own band as index and search, in the band below as search if a similar set may be there."""
    size = len(grams)
    band = int(np.searchsorted(edges, size, side="right")) - 1
    value, out = mix64(grams + np.uint64(gram)), []
    h = differences(int(edges[band]), similar)
    # sets that can differ in nothing are only similar if equal, and equal sets are one class
    if h:
        out.append(segment_keys(grams, value, band, h + 1, True, True))
    if band and -(-size * similar[0] // similar[1]) < edges[band] and (h := differences(int(edges[band - 1]), similar)):
        out.append(segment_keys(grams, value, band - 1, h + 1, False, True))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    return np.concatenate([k for k, _ in out]).view(np.int64), np.concatenate([f for _, f in out])


def class_hash(grams: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(grams).sum(dtype=np.uint64) + np.uint64(len(grams))], np.uint64)).view(np.int64)[0])


_EDGES: dict[tuple[int, int], np.ndarray] = {}


def _edges(similar: tuple[int, int]) -> np.ndarray:
    if similar not in _EDGES:
        _EDGES[similar] = bands(similar, 1 << 40)
    return _EDGES[similar]


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(root, nodes), pa.int64())], ["node", "least"])


def components(edges: DataFrame, in_one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Least node reachable from each node of an edge list (u, v): node, least (rows only where they differ).

    Up to `in_one_task` edges, counted first, are joined by one executor task in bounded memory. More stay distributed:
    alternating large and small stars, each round cut into the shared checkpoint folder, until nothing changes.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())
    if now.count() <= in_one_task:
        return cut(now.repartition(1).mapInArrow(_union_find, "node long, least long"))
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("least"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread(both, least, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # each u now has neighbours below it only
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread(large, least, ["u"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v")
        now = cut(small.distinct())


def parity_bitmap(grams: np.ndarray) -> bytes:
    """Bit i: whether an odd number of the n-grams fall on i. Two sets differ at least as often as their bitmaps do.

    The bits are a power of two, one for each n-gram or more, up to a bound; a wider bitmap folds into a narrower one.
    """
    width = min(max(1 << (len(grams) - 1).bit_length(), LEAST_BITMAP), MOST_BITMAP)
    odd = np.bincount((grams & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(bitmaps: list[bytes]) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, all folded to the narrowest one's width."""
    width = min(map(len, bitmaps))
    out = np.empty((len(bitmaps), width // 8), np.uint64)
    for i, b in enumerate(bitmaps):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0)
    return out


def forest(sizes: np.ndarray, near, similar: tuple[int, int], side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the rows of a block into the components of all its links.

    near(i, js) gives the least |i and j differ by| that is known for each of the rows js. A pair that is in one component
    already needs no link and is not compared. side: only rows of different sides are compared.
    """
    num, den = similar
    label, links = np.arange(len(sizes)), []
    for i in range(len(sizes) - 1):
        rest = label[i + 1 :] != label[i]
        if side is not None:
            rest &= side[i + 1 :] != side[i]
        js = np.flatnonzero(rest) + i + 1
        js = js[np.minimum(sizes[js], sizes[i]) * den >= np.maximum(sizes[js], sizes[i]) * num]
        if len(js):
            js = js[near(i, js) * (den + num) <= (sizes[js] + sizes[i]) * (den - num)]
        if len(js):
            others, first = np.unique(label[js], return_index=True)
            links += [(i, int(js[f])) for f in first]
            label[np.isin(label, others)] = label[i]
    return links


def bitmap_distance(bitmaps: list[bytes]):
    rows = _folded(bitmaps)
    return lambda i, js: np.bitwise_count(rows[js] ^ rows[i]).sum(1, dtype=np.int64)


def gram_distance(sets: list[np.ndarray]):
    """Sizes of the symmetric differences of sorted sets, for `forest`.

    Sets are held as their differences to the n-grams that more than half of them have, so that near copies, of whatever
    size, are short lists, and common n-grams are not met again for each pair.
    """
    g = len(sets)
    if g == 2:
        return lambda i, js: np.array([len(sets[0]) + len(sets[1]) - 2 * len(np.intersect1d(sets[0], sets[1], assume_unique=True))])
    owner = np.repeat(np.arange(g), list(map(len, sets)))
    _, gram, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = count > g // 2
    kept = ~common[gram]
    extra, extra_owner = gram[kept], owner[kept]
    number = np.cumsum(common) - 1
    has = np.zeros((int(common.sum()), g), bool)
    has[number[gram[~kept]], owner[~kept]] = True
    lacking, lacking_owner = np.nonzero(~has)
    sizes = np.bincount(np.concatenate([extra_owner, lacking_owner]), minlength=g)  # of the differences
    # an n-gram in one difference alone can't be shared
    twice = count[extra] > 1
    item = np.concatenate([extra[twice], lacking + len(count)])
    who = np.concatenate([extra_owner[twice], lacking_owner])
    by_item = np.argsort(item, kind="stable")
    holders = who[by_item]
    ids, starts, lengths = np.unique(item[by_item], return_index=True, return_counts=True)
    place = np.searchsorted(ids, item)
    by_row = np.argsort(who, kind="stable")
    own = np.split(place[by_row], np.cumsum(np.bincount(who, minlength=g))[:-1])

    def near(i: int, js: np.ndarray) -> np.ndarray:
        n = lengths[own[i]]
        at = np.repeat(starts[own[i]] - np.cumsum(n) + n, n) + np.arange(n.sum())
        shared = np.bincount(holders[at], minlength=g)
        return sizes[i] + sizes[js] - 2 * shared[js]

    return near


def _by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Runs of rows with one value in a column by which the rows are sorted, whatever the batches' ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(key)] if len(key) else []
        for a, z in zip(cuts, cuts[1:]):
            if held and held[0].column(column)[0] != batch.column(column)[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(rows: DataFrame, key: str, blocks) -> DataFrame:
    """Rows of a key dealt into tasks: `group`, `side`. A key of several blocks has a task for each pair of its blocks.

    In the task of two different blocks their texts are of different sides; a task of one block has one side, null.
    """
    rows = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("c", F.lit(5)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low != high, F.col("own") == high)
    return rows.withColumn("group", F.xxhash64(key, low, high)).withColumn("side", side).drop("blocks", "own", "other")


def _in_blocks(rows: DataFrame, gather, schema: str) -> DataFrame:
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(gather, schema)


def _ends(c: np.ndarray, links: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.array(links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(c[at[:, 0]]), pa.array(c[at[:, 1]])], ["u", "v"])


def _sides(t: pa.Table) -> np.ndarray | None:
    side = t.column("side").combine_chunks()
    return None if side.null_count else side.to_numpy(zero_copy_only=False)


def near_duplicates(docs: DataFrame, gram: int = GRAM, similar: tuple[int, int] = SIMILAR, block_texts: int = BLOCK_TEXTS, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Groups of documents connected by links between texts whose word n-gram sets have Jaccard similarity num / den or more.

    Returns doc_id, key (hash of the text), n_shingles (size of its set) and component_id (least doc_id reachable by
    links, its own included). Null and empty texts have empty sets and no links; rows with a null id have no links and
    no component; repeated rows are equal sets; an empty table gives no rows; extra columns are not read.

    Equal sets are one class, so that a group of copies costs as much as one text. A first pass over the texts gives the
    keys, which are counted. Those that occur twice go into a Bloom filter, and a second pass gives each row's class and
    bitmap and the keys that the filter lets through; keys with the same classes count once. The classes of a key meet in blocks of `block_texts`: their bitmaps
    leave those pairs whose sets may be similar, almost all of which are. Components of these are the clusters in which
    the sets themselves, each once, are compared, in blocks of `block_grams` n-grams. Every link lies in a cluster, as its
    ends share a key and their bitmaps can't rule it out. A key or cluster of b blocks sends each of its rows to b tasks.
    """
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")

    def keys(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys_of(grams, gram, similar, _edges(similar))

    def all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                found = [keys(x)[0] for t in batch.column(0).slice(start, 512) if len(x := gram_set(t.as_py(), gram))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found))], ["k"])

    named = rows.where("doc_id IS NOT NULL").select("doc_id", "text")
    twice = cut(named.select("text").mapInArrow(all_keys, "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k"))
    may = bloom(twice, "k")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 512):
                part = batch.slice(start, 512)
                n, c, bits, k, searched, ends = [], [], [], [], [], [0]
                for i, text in zip(part.column(0), part.column(2)):
                    x = gram_set(text.as_py(), gram)
                    own, probes = keys(x) if len(x) and i.is_valid else (np.zeros(0, np.int64), np.zeros(0, bool))
                    here = may.value.has(own)
                    own, probes = own[here], probes[here]
                    n.append(len(x))
                    c.append(class_hash(x))
                    bits.append(parity_bitmap(x) if len(own) else None)
                    k += [own[probes], own[~probes]]  # the searched ones first
                    searched.append(int(probes.sum()))
                    ends.append(ends[-1] + len(own))
                lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.concatenate(k) if k else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(bits, pa.binary()), pa.array(searched, pa.int32()), lists], ["doc_id", "key", "n", "c", "bits", "searched", "keys"])

    members = cut(rows.mapInArrow(described, f"doc_id {id_type}, key long, n long, c long, bits binary, searched int, keys array<long>"))
    classes = cut(members.where("doc_id IS NOT NULL AND n > 0").groupBy("c").agg(F.min("doc_id").alias("rep")))
    found = members.select("c", "n", "searched", F.posexplode("keys").alias("at", "k")).select("k", "c", "n", (F.col("at") < F.col("searched")).alias("searched"))
    found = found.groupBy("k", "c").agg(F.max("searched").alias("searched"), F.max("n").alias("n"))
    # keys with one class, and all but one of the keys with the same classes, have nothing to tell
    mixed = [F.expr(f"bit_xor(xxhash64(c, searched, {seed}))").alias(f"x{seed}") for seed in (1, 2)]
    groups = found.groupBy("k").agg(F.count(F.lit(1)).alias("g"), F.max("searched").alias("any"), *mixed).where("any AND g > 1")
    entries = spread(found, groups.groupBy("g", "x1", "x2").agg(F.min("k").alias("k")).select("k", "g"), ["k"])
    bits = members.where("bits IS NOT NULL").groupBy("c").agg(F.min("bits").alias("bits"))
    dealt = _dealt(entries, "k", F.ceil(F.col("g") / block_texts)).join(bits, "c").select("group", "side", "c", "n", "searched", "bits")

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, "group"):
            if len(t) < 2:
                continue
            c, searched = t.column("c").to_numpy(), t.column("searched").to_numpy()
            distance = bitmap_distance(t.column("bits").to_pylist())
            far = np.int64(1 << 40)  # a pair counts if one of the two is searched
            near = lambda i, js: np.where(searched[i] | searched[js], distance(i, js), far)
            links = forest(t.column("n").to_numpy(), near, similar, _sides(t))
            if links:
                yield _ends(c, links)

    joined = components(_in_blocks(dealt, candidates, "u long, v long"))
    joined = joined.select(F.col("node").alias("c"), "least")
    clusters = cut(joined.unionByName(joined.select(F.col("least").alias("c"), "least").distinct()).join(classes, "c"))
    have = bloom(clusters.select(F.xxhash64("rep").alias("h")), "h")

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(have.value.has(batch.column(0).to_numpy())))
            for start in range(0, len(part), 512):
                sets = [gram_set(t.as_py(), gram) for t in part.column(1).slice(start, 512)]
                yield pa.RecordBatch.from_arrays([pa.array(map(class_hash, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["c", "grams"])

    sets = named.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(chosen, "c long, grams binary")
    size = (F.octet_length("grams") / 8).alias("size")
    sets = cut(sets.groupBy("c").agg(F.min("grams").alias("grams")).join(clusters.select("c", "least"), "c").withColumn("size", size))
    totals = sets.groupBy("least").agg(F.greatest(F.ceil(F.sum("size") / block_grams), F.ceil(F.count(F.lit(1)) / block_texts)).alias("n_blocks"))
    tasks = _dealt(spread(sets, totals, ["least"]), "least", F.col("n_blocks")).select("group", "side", "c", "grams")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_group(batches, "group"):
            if len(t) < 2:
                continue
            own = [np.frombuffer(g.as_buffer(), np.uint64) for g in t.column("grams")]
            links = forest(np.array(list(map(len, own))), gram_distance(own), similar, _sides(t))
            if links:
                yield _ends(t.column("c").to_numpy(), links)

    whole = components(_in_blocks(tasks, verified, "u long, v long"))
    ids = whole.select(F.col("node").alias("c"), "least").unionByName(whole.select(F.col("least").alias("c"), "least").distinct()).join(classes, "c")
    least = ids.groupBy("least").agg(F.min("rep").alias("id"))
    final = classes.join(spread(ids.select("c", "least"), least, ["least"]).select("c", "id"), "c", "left").select("c", F.coalesce("id", "rep").alias("component"))
    out = spread(members.select("doc_id", "key", "n", "c"), final, ["c"], "left")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, gram: int = GRAM, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """Rows of docs, with all their columns, without near duplicates: of each group the document with the least id stays.

    Rows without words and rows with a null id stay; of rows equal in id and text one stays; an empty table gives no rows;
    columns may have any names. Only rows that go, or stand repeated, are dealt out by id: a Bloom filter tells them from
    the others, which pass as they are.
    """
    groups = near_duplicates(docs, gram, similar).where("doc_id IS NOT NULL")
    groups = groups.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("component_id") != F.col("doc_id")).alias("goes")).where("n > 1 OR goes")
    groups = cut(groups.select(F.col("doc_id").alias("__id"), F.col("key").alias("__text_key"), "goes"))
    may = bloom(groups.select(F.xxhash64("__id", "__text_key").alias("h")), "h")
    plain, names = renamed(docs, "doc_id", "text")
    rows = plain.withColumn("__key", F.xxhash64("text")).withColumn("__both", F.xxhash64("doc_id", "__key"))
    at = rows.columns.index("__both")

    def some(touched: bool):
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may.value.has(batch.column(at).to_numpy()) == touched))

        return pick

    touched = rows.mapInArrow(some(True), rows.schema)
    left = touched.join(groups, (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__text_key")), "left")
    # of repeated rows the first stays; rows that only look touched have no group and all stay
    one = left.where("NOT coalesce(goes, false)").where("__id IS NOT NULL").drop("__id", "__text_key", "goes").dropDuplicates(["doc_id", "__key"])
    none = left.where("__id IS NULL").drop("__id", "__text_key", "goes")
    return restored(rows.mapInArrow(some(False), rows.schema).unionByName(one).unionByName(none), names, docs.columns)
