"""Main text of web pages: a suffix array over each host's pages for repeated runs, and the structure of the markup.

Blocks of every page, but for an article's own text, stand in the suffix arrays, and runs of tokens that several pages of
the host repeat go. Structure is looked at after that: it tells what stands in an article or main element, and what is
menu, footer, form, script or comment by its tag, role or an unmistakable name though no other page repeats it. What it
leaves open, the suffix arrays alone decide: text of pages without an article, and text in an article whose name only hints
at boilerplate (share, related, promo, banner, social).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from reqlens.llm.common import cut, gram_hashes, ship, spread, word_hashes

#: Tokens of a repeated run at least, and distinct pages that must hold it.
RUN, MIN_PAGES = 8, 3
#: Tokens, and distinct pages, that one suffix array takes, on average; hosts with more are split by page.
SHARD_TOKENS, SHARD_PAGES = 200_000, 500

#: A quote opens a value only after '=', as in browsers; one that nothing closes is an ordinary character. Nothing is tried twice.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|<[!?/][^>]*+>|<[a-zA-Z/!?][^>]*+\Z|[^<]++|<", re.S)
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))")
#: Elements whose content is not markup, each up to its own end tag.
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_CHROME_TAGS = frozenset("nav footer aside form script style noscript template svg button select iframe head dialog menu object canvas map audio video textarea title noembed noframes xmp".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert dialog".split())
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification pager pagination popup reply respond sidebar signup sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Names that articles use too: inside an article the host's repeated runs decide.
_HINT_WORDS = frozenset("banner promo promotion recommended related share sharing skip social".split())
_CONTENT_WORDS = frozenset("article body content entry main post story text".split())
_COMMENT_WORDS = frozenset("comment comments disqus reply respond".split())
_MAIN_CLASSES = frozenset("article-body article-content entry-content post-body post-content story-body".split())


class _Page:
    """Blocks of a page: text, and where it stands: 'main', 'hint' (in main, under a name of boilerplate), 'chrome' or 'other'."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.zone = "other"
        self.open: list[tuple[str, str]] = []  # name, zone before it
        self.names: Counter[str] = Counter()  # of the open elements
        at, n = 0, len(html)
        while at < n:
            m = _TOKEN.match(html, at)
            if m is None:
                break
            at = m.end()
            name = m[2]
            if name is None:
                if html[m.start()] != "<" or m[0] == "<":
                    self.parts.append(unescape(m[0]) if "&" in m[0] else m[0])
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
            else:
                self._start(name, m[3])
                if name in _RAW and not m[3].endswith("/"):
                    end = _RAW[name].search(html, at)
                    at = end.end() if end else n
                    self._end(name)
        self._flush()

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts.clear()
        if text:
            self.blocks.append((text, self.zone))

    def _start(self, name: str, attributes: str) -> None:
        if name in _BLOCKS or name in _CHROME_TAGS:
            self._flush()
        elif name in ("br", "td", "th"):
            self.parts.append(" ")
        if name in _VOID:
            return
        before = self.zone
        if name in ("p", "li", "dt", "dd", "tr") and self.open and self.open[-1][0] == name:
            before = self.open.pop()[1]
            self.names[name] -= 1
            self.zone = before
        self.open.append((name, before))
        self.names[name] += 1
        self.zone = self._zone_of(name, attributes, before)

    def _zone_of(self, name: str, attributes: str, before: str) -> str:
        words, roles = set(), set()
        for m in _ATTR.finditer(attributes) if "=" in attributes else ():
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                words.update(value.split())
            elif key in ("role", "itemprop"):
                roles.update(value.split())
        parts = {p for w in words for p in re.split(r"[-_]+", w)}
        comments = bool(parts & _COMMENT_WORDS)
        if name in ("html", "body"):
            return before
        if comments:
            return "chrome"
        if name == "main" or "main" in roles:
            return "main"
        if before == "chrome":
            return before
        named = not parts & _CONTENT_WORDS
        if name in _CHROME_TAGS or roles & _CHROME_ROLES or (parts & _CHROME_WORDS and named):
            return "chrome"
        if name == "header":
            return before if before in ("main", "hint") else "chrome"
        if parts & _HINT_WORDS and named:
            return "hint" if before in ("main", "hint") else "chrome"
        if before == "hint":
            return before
        if name == "article" or "articlebody" in roles or words & _MAIN_CLASSES:
            return "main"
        return before

    def _end(self, name: str) -> None:
        if name in _BLOCKS or name in _CHROME_TAGS:
            self._flush()
        elif name in ("td", "th"):
            self.parts.append(" ")
        if not self.names[name]:
            return
        while True:
            last, zone = self.open.pop()
            self.names[last] -= 1
            if last == name:
                self.zone = zone
                return


def blocks_of(html: str) -> list[tuple[str, str]]:
    return _Page(html).blocks


def _undecided(blocks: list[tuple[str, str]]) -> bool:
    """Whether structure leaves text of a parsed page open, for the repeated runs to decide."""
    zones = {zone for _, zone in blocks}
    return "hint" in zones or ("main" not in zones and "other" in zones)


def main_text(blocks: list[tuple[str, str]], removed: dict[int, list[tuple[int, int]]] | None = None) -> str:
    """Blocks without the removed runs of tokens, which only an article's own text keeps; of these the blocks of the main element if it has any text, else all that is not chrome."""
    main = any(zone in ("main", "hint") for _, zone in blocks)
    out = []
    for i, (text, zone) in enumerate(blocks):
        if removed and i in removed and zone != "main":
            words = text.split(" ")
            gone = np.zeros(len(words), bool)
            for start, length in removed[i]:
                gone[start : start + length] = True
            text = " ".join(w for w, g in zip(words, gone) if not g)
        # the check by structure: boilerplate that the host does not repeat goes too
        if text and zone in (("main", "hint") if main else ("other",)):
            out.append(text)
    return "\n".join(out)


def suffix_array(tokens: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of a stream of tokens, and the longest common prefix of each suffix with the one before it.

    ends: end of the block of each position; a suffix ends with its block. By prefix doubling: ranks of the first 1, 2, 4,
    ... tokens, until all differ or blocks end; the ranks of all depths then give the prefixes, from the deepest down.
    Equal suffixes stand in the order of their positions.
    """
    n = len(tokens)
    here = np.arange(n)
    left = ends - here
    ranks = [np.unique(tokens, return_inverse=True)[1].astype(np.int64)]
    depth = 1
    while depth < left.max(initial=0) and ranks[-1].max() < n - 1:
        next_ = np.full(n, -1, np.int64)
        next_[: n - depth] = ranks[-1][depth:]
        next_[left <= depth] = -1
        ranks.append(np.unique(ranks[-1] * (n + 2) + next_ + 1, return_inverse=True)[1].astype(np.int64))
        depth *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, n - 1), np.int64)
    end_a, end_b = ends[a], ends[b]
    for level in range(len(ranks) - 1, -1, -1):
        at_a, at_b = np.minimum(a, n - 1), np.minimum(b, n - 1)
        same = (a < end_a) & (b < end_b) & (ranks[level][at_a] == ranks[level][at_b])
        step = np.where(same, np.minimum(1 << level, end_a - a), 0)
        common += step
        a += step
        b += step
    return order, np.concatenate([[0], common]) if n else common


def repeats(tokens: np.ndarray, ends: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of `run` tokens or more: positions in the order of the suffix array, first of each run, and tokens that its places share.

    Neighbours in the array with a common prefix of `run` tokens are places of one run; it is as long as the least prefix
    among them. Runs with one place are as long as `run`.
    """
    order, common = suffix_array(tokens, ends)
    kept = np.flatnonzero(ends[order] - order >= run)
    if not len(kept):
        return kept, kept, kept
    order = order[kept]
    # suffixes that are too short stand between others: a common prefix of two kept neighbours passes over them
    if len(kept) > 1:
        common = np.concatenate([[0], np.minimum.reduceat(common[: kept[-1] + 1], kept[:-1] + 1)])
    else:
        common = np.zeros(1, np.int64)
    first = np.flatnonzero(common < run)
    most = np.iinfo(np.int64).max
    common[first] = most
    length = np.minimum.reduceat(common, first)
    return order, first, np.where(length == most, run, length)


def host_runs(streams: DataFrame, run: int = RUN, min_pages: int = MIN_PAGES) -> DataFrame:
    """Runs of `run` tokens (or whole shorter blocks) that the pages of each host repeat.

    streams: host, deal (host and shard), split (whether the host has several), page, blocks (of tokens joined by spaces;
    '' for text that stays in any case). Returns rows of two kinds: places (page, block, start, length) of runs that stand on
    `min_pages` distinct pages of the shard alone, overlapping ones as one, with gram null and a row for each page; and for
    hosts of several shards gram, n_pages in the shard, and where these are too few, the places that the sum decides.
    """
    schema = "host string, gram long, n_pages long, places array<struct<page: long, block: int, start: int, length: int>>"

    def find(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["page"]).reset_index(drop=True)
        ids: dict[str, int] = {}
        tokens: list[int] = []
        sizes, real, row, block = [], [], [], []  # of each block
        for r, texts in enumerate(rows["blocks"]):
            for b, text in enumerate(texts):
                if not text:
                    continue
                words = text.split(" ")
                # a short block is a run as a whole: its length goes before it, and nothing else is as long
                padded = words if len(words) >= run else [f"\x00{len(words)}", *words, *["\x00"] * (run - len(words))]
                tokens += [ids.setdefault(w, len(ids)) for w in padded]
                sizes.append(len(padded))
                real.append(len(words))
                row.append(r)
                block.append(b)
        empty = pd.DataFrame({"host": [], "gram": [], "n_pages": [], "places": []}, dtype=object)
        if not tokens:
            return empty
        sizes, real, row, block = (np.array(x, np.int64) for x in (sizes, real, row, block))
        of = np.repeat(np.arange(len(sizes)), sizes)  # block of each position
        begin = np.cumsum(sizes) - sizes
        stream = np.array(tokens, np.int64)
        order, first, length = repeats(stream, (begin + sizes)[of], run)
        if not len(order):
            return empty
        group = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(order)]])))
        page_ids, page = np.unique(rows["page"].to_numpy(), return_inverse=True)
        own = page[row[of[order]]]
        n_pages = np.bincount(np.unique(group * len(page_ids) + own) // len(page_ids), minlength=len(first))
        split = bool(rows["split"].iloc[0])
        bounds = np.concatenate([first, [len(order)]])
        host, page_of = rows["host"][0], rows["page"].tolist()
        out = []
        # what the shard's pages are enough for: each place as long as the run is on all its pages
        sure = (n_pages >= min_pages)[group]
        edges = np.zeros(len(stream) + 1, np.int64)
        np.add.at(edges, order[sure], 1)
        np.add.at(edges, order[sure] + np.minimum(length[group[sure]], (begin + sizes)[of[order[sure]]] - order[sure]), -1)
        covered = np.cumsum(edges[:-1]) > 0
        new = np.ones(len(stream), bool)
        new[1:] = (of[1:] != of[:-1]) | ~covered[:-1]
        starts = np.flatnonzero(covered & new)
        ends = np.flatnonzero(covered & np.concatenate([new[1:] | ~covered[1:], [True]])) + 1
        spans: dict[int, list[dict[str, int]]] = {}
        for at, end in zip(starts.tolist(), ends.tolist()):
            k = of[at]
            place = {"start": 0, "length": int(real[k])} if real[k] < run else {"start": int(at - begin[k]), "length": end - at}
            spans.setdefault(int(row[k]), []).append({"page": page_of[row[k]], "block": int(block[k]), **place})
        out += [(host, None, None, places) for places in spans.values()]
        if split:
            named = gram_hashes(word_hashes(" ".join(w.replace(" ", "\x01") for w in ids).encode("utf-8", "surrogatepass"))[stream], run).view(np.int64)
            for g in range(len(first)):
                places = []
                for at in order[bounds[g] : bounds[g + 1]].tolist() if n_pages[g] < min_pages else ():
                    k = of[at]
                    whole = real[k] < run
                    places.append({"page": page_of[row[k]], "block": int(block[k]), "start": 0 if whole else int(at - begin[k]), "length": int(real[k]) if whole else run})
                out.append((host, int(named[order[first[g]]]), int(n_pages[g]), places))
        if not out:
            return empty
        return pd.DataFrame({"host": [r[0] for r in out], "gram": pd.array([r[1] for r in out], "Int64"), "n_pages": pd.array([r[2] for r in out], "Int64"), "places": [r[3] for r in out]})

    return streams.groupBy("deal").applyInPandas(find, schema)


def extract_main_text(pages: DataFrame, run: int = RUN, min_pages: int = MIN_PAGES, shard_tokens: int = SHARD_TOKENS, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """Main text of every page: page_id, url, text ('' if none) and n_chars (code points).

    Every page takes one way: its blocks, but for an article's own text, stand in the suffix arrays of its host, and what
    these find repeated goes: runs of `run` tokens or more (or whole shorter blocks) on `min_pages` distinct pages. Then
    structure is looked at. A page with an article or main element gives the blocks in it that are not menus, headers,
    footers, sidebars, notices, adverts, forms or comments by their tags, roles, classes or ids; what a class or id only
    hints at stays unless the host repeats it. Other pages give all blocks that are not such chrome. Undecided pages (of the
    latter kind, or with such hints) of equal blocks count as one page, so that copies of a page keep their text.

    Null and empty html give ''; null URLs form a host of their own; repeated rows and null ids are extracted each; an
    empty table gives no rows; extra columns are not read. The parsed page tells whether it has such an element, not a
    mention of one in a script, a comment or the page's chrome. A host with more than `shard_tokens` tokens or `shard_pages`
    pages is dealt out by page, copies of a page being one, and the counts of equal runs are then added up over its shards.
    """
    ship(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))

    id_type = pages.schema["page_id"].dataType.simpleString()
    schema = f"page_id {id_type}, url string, text string, n_chars long"
    kinds = {"page": pa.int64(), "stream": pa.list_(pa.string()), "n": pa.int64(), "blocks": pa.list_(pa.string()), "zones": pa.list_(pa.string())}

    def parse(*wanted: str):
        def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import xxhash

            for batch in batches:
                out: dict[str, list] = {k: [] for k in wanted}
                for html, own in zip(batch.column(3), batch.column(0).to_pylist()):
                    found = blocks_of(html.as_py() or "")
                    texts, zones = [t for t, _ in found], [z for _, z in found]
                    same = xxhash.xxh3_64_intdigest("\x1e".join(texts).encode("utf-8", "surrogatepass"))
                    page = same if _undecided(found) else xxhash.xxh3_64_intdigest(f"{own}".encode(), seed=1) ^ same
                    # blocks keep their numbers, which are those of main_text
                    stream = ["" if z == "main" else t for t, z in found]
                    row = {"page": page - (1 << 63), "stream": stream, "n": sum(t.count(" ") + 1 for t in stream if t), "blocks": texts, "zones": zones}
                    for k in wanted:
                        out[k].append(row[k])
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(out[k], kinds[k]) for k in wanted)], ["page_id", "url", "host", *wanted])

        return rows_of

    source = pages.select("page_id", "url", host.alias("host"), "html")
    given = f"page_id {id_type}, url string, host string, page long"
    streams = cut(source.mapInArrow(parse("page", "stream", "n"), f"{given}, stream array<string>, n long").where("n > 0").select("host", "page", F.col("stream").alias("blocks"), "n").distinct())
    shards = streams.groupBy("host").agg(F.ceil(F.greatest(F.sum("n") / shard_tokens, F.count(F.lit(1)) / shard_pages)).cast("int").alias("shards"))
    # dealt by one key of host and shard: by the host beside the shard, Spark would keep all shards of a host in one task
    shard = F.pmod(F.xxhash64("page"), F.col("shards")).cast("string")
    streams = spread(streams, shards, ["host"]).select("host", "page", "blocks", (F.col("shards") > 1).alias("split"), F.concat_ws("\x01", "host", shard).alias("deal"))
    runs = cut(host_runs(streams, run, min_pages))
    common = runs.where("gram IS NOT NULL").groupBy("host", "gram").agg(F.sum("n_pages").alias("n")).where(F.col("n") >= min_pages).select("host", "gram")
    summed = spread(runs.where("gram IS NOT NULL AND size(places) > 0"), common, ["host", "gram"]).select("host", "places")
    gone = summed.unionByName(runs.where("gram IS NULL").select("host", "places")).select("host", F.explode("places").alias("p")).select("host", "p.*")
    gone = gone.groupBy("host", "page").agg(F.collect_set(F.struct("block", "start", "length")).alias("removed"))

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for blocks, zones, removed in zip(*(c.to_pylist() for c in batch.columns[2:])):
                spans: dict[int, list[tuple[int, int]]] = {}
                for r in removed or []:
                    spans.setdefault(r["block"], []).append((r["start"], r["length"]))
                out.append(main_text(list(zip(blocks, zones)), spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"])

    parsed = source.mapInArrow(parse("page", "blocks", "zones"), f"{given}, blocks array<string>, zones array<string>")
    return spread(parsed, gone, ["host", "page"], "left").select("page_id", "url", "blocks", "zones", "removed").mapInArrow(cleaned, schema)
