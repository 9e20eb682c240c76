"""The corpus operators on small fixtures, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from reqlens.llm import ann, bpe, common, html, jaccard, mixing, pu, quality, sharding, substring, urlfilter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, null and empty texts, null ids, repeated rows, one long text."""
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.choice([3, 12, 60, 150, 400]))) for i in range(60)]
    passage = prose(rng, 70)
    for i in range(60, 72):
        rows.append((i, prose(rng, 40) + " " + passage + "\n" + prose(rng, 30)))
    for i in range(72, 84):  # near copies of one text
        words = rows[3][1].split() + prose(random.Random(1), 120).split()
        words[rng.randrange(len(words))] = "zz"
        rows.append((i, " ".join(words)))
    rows += [(84, rows[2][1]), (85, rows[2][1]), (86, None), (87, ""), (88, " \t\n"), (None, rows[60][1]), (None, None), (89, prose(rng, 6000)), (90, rows[60][1].upper())]
    rows += [(4, rows[4][1]), (4, rows[4][1])]
    return [(i, t, "en", None if (i or 0) % 7 == 0 else f"s{(i or 0) % 5}", len(t or "")) for i, t in rows]


def frame(spark, rows):
    """With columns whose names clash with the operators' own."""
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"key": F.lit("x"), "size": F.lit(1), "hash": F.lit(2), "score": F.lit("y"), "shard": F.lit(3), "spans": F.lit(4), "c": F.lit(5), "n": F.lit(6)})


def test_bpe_equals_library(spark, corpus):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    texts = [r[1] for r in corpus] + ["<|endoftext|> It's <|startoftext|>x", "ΑΣ Σ İ é é ﬁ", "12 3 ½   \u0085 Ᲊ \U000323b0 \U00013460", "<|end"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in bpe.bpe_encode(df, path, outputs=("ids", "ids_le", "decoded")).collect():
        e = tok.encode(texts[row["doc_id"]] or "", add_special_tokens=False)
        assert row["ids"] == e.ids and np.frombuffer(bytes(row["ids_le"]), "<u4").tolist() == e.ids and row["n_tokens"] == len(e.ids)
        assert row["decoded"] == tok.decode(e.ids, skip_special_tokens=False)
    assert bpe.bpe_encode(df.limit(0), path).count() == 0
    back = bpe.bpe_decode(bpe.bpe_encode(df, path), path).collect()
    assert all(r["decoded"] == tok.decode(tok.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in back)


def test_long_words(spark):
    """A word of any length ends in time, with the same pieces; unknown ids decode to nothing."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (255, 256, 257, 258, 3000)] + ["a" * 5000, "ab" * 2000 + "é", "x" * 300_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in bpe.bpe_encode(df, path).collect():
        assert row["ids"] == tok.encode(texts[row["doc_id"]], add_special_tokens=False).ids
    ids = spark.createDataFrame([(1, [10**9, None, *tok.encode("one two").ids, -1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.bpe_decode(ids, path).collect()} == {1: tok.decode(tok.encode("one two").ids), 2: "", 3: ""}


def test_long_merges_equal_short_ones():
    rng = random.Random(9)
    for _ in range(200):
        word = [rng.choice("abc") for _ in range(rng.randint(2, 40))]
        pieces = ["a", "b", "c"]
        ranks = {}
        for r in range(rng.randint(1, 12)):
            pair = rng.choice(pieces), rng.choice(pieces)
            ranks.setdefault(pair, r)
            pieces.append("".join(pair))
        assert bpe._merge_long(word, ranks.get) == bpe.merge_parts(word, ranks.get)


def test_merge_order():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    assert bpe.merge_parts(list("abc"), ranks.get) == ["abc"]
    assert bpe.merge_parts(list("ababab"), {("a", "b"): 0, ("ab", "ab"): 1}.get) == ["abab", "ab"]
    assert bpe.merge_parts(["x"], ranks.get) == ["x"] and bpe.merge_parts([], ranks.get) == []


def brute_mix(rows):
    size = {}
    docs = []
    for i, t, _, s, _ in rows:
        n = len(WORD.findall(t or ""))
        h = int(hashlib.md5("|".join([str(i) if i is not None else "\\N", s if s is not None else "\\N", hashlib.md5((t or "").encode()).hexdigest()]).encode()).hexdigest()[:12], 16)
        docs.append((i, s, n, h))
        size[s] = size.get(s, 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    budget, open_, target = 1.5 * sum(size.values()), set(order), {}
    while True:
        share = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if share * weight[s] >= 2 * size[s]]
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            open_.discard(s)
        if not open_:
            break
    target |= {s: share * weight[s] for s in open_}
    return docs, size, target


def test_mixing(spark, corpus):
    docs, size, target = brute_mix(corpus)
    got = mixing.mix_sources(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-12) and 0 <= r["copies"] <= 2 and r["taken"] == r["size"] * r["copies"]
        taken[r["source"]] += r["taken"]
    for s in size:  # near: within half of the largest row
        assert abs(taken[s] - target[s]) <= max(n for _, q, n, _ in docs if q == s)
    again = mixing.mix_sources(frame(spark, corpus).repartition(7)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mixed_rows(frame(spark, corpus))
    assert mixed.columns == frame(spark, corpus).columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix_sources(frame(spark, corpus).limit(0)).count() == 0


def brute_measures(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), len(words) < 10 or 100 * len(cover) > 20 * len(words)


def test_quality_rules(spark, corpus):
    rows = corpus + [(200 + i, "a b c d e " * k + "x # | <\nq\nq\n \n" * k, "en", "s", 1) for i, k in enumerate((1, 2, 9))]
    rows += [(300 + i, " ".join(w + "###" for w in r[1].split()), "en", "s", 1) for i, r in enumerate(corpus[20:26]) if r[1]]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in corpus[:60]] + [(None, 1, 0), (61, None, None), (62, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.quality_rules(frame(spark, rows), labels).collect()
    want = Counter((r[0], *brute_measures(r[1] or "")) for r in rows)
    assert Counter(tuple(r)[:7] for r in got) == want
    for r in got:
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)
    assert all(not r["kept"] for r in got if (r["doc_id"] or 0) >= 300) and all(r["kept"] for r in got if r["doc_id"] in range(60) and not r["base_failed"])
    kept = quality.quality_rules(frame(spark, rows), labels, keep_rows=True)
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(r["kept"] for r in got)
    none = quality.quality_rules(frame(spark, rows), labels.limit(0)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in none)
    assert quality.quality_rules(frame(spark, rows).limit(0), labels).count() == 0


def test_ratio_is_the_multinomials(spark, corpus):
    labels = spark.createDataFrame([(r[0], 1, 0) for r in corpus[:30]], "doc_id long, quality int, toxic int")
    got = quality.ratio_weights(frame(spark, corpus), labels)
    size = 1 << quality.BUCKET_BITS
    raw, target = np.zeros(size), np.zeros(size)
    good = {r[0] for r in corpus[:30]}
    for i, t, *_ in corpus:
        at = quality.buckets((t or "").encode())
        np.add.at(raw, at, 1)
        if i in good and i is not None:
            np.add.at(target, at, 1)
    p = (raw + 1) / (raw.sum() + size)
    assert np.allclose(got, np.log((0.98 * target / target.sum() + 0.02 * p) / p))


def test_ratio_counts_all_trusted_rows(spark):
    docs = spark.range(20_100).select(F.col("id").alias("doc_id"), F.concat(F.md5(F.col("id").cast("string")), F.when(F.col("id") % 2 == 0, "é")).alias("text"))
    got = quality.ratio_weights(docs, docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")))
    raw = np.zeros(1 << quality.BUCKET_BITS)
    for r in docs.collect():
        np.add.at(raw, quality.buckets((r["text"] or "").encode()), 1)
    p = (raw + 1) / (raw.sum() + len(raw))
    assert np.allclose(got, np.log((0.98 * raw / raw.sum() + 0.02 * p) / p))


def test_pu_classifier(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.8
        text = prose(rng, rng.randint(15, 120))
        rows.append((i, text if good else " ".join(w + rng.choice(["###", "$$$", "|"]) for w in text.split()), "en", "s", 1))
        if i % 2:
            labels.append((i, int(good), 0))
    truth = {i: q for i, q, _ in labels}
    df = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = pu.pu_scores(frame(spark, rows + [(None, None, None, None, 0), (1000, "", "en", "s", 0)]), df).collect()
    assert len(got) == 602
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    # labels of the held-out fold and labels of 0 change nothing
    other = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in labels]
    again = pu.pu_scores(frame(spark, rows), spark.createDataFrame([x for x in other if x[1] or zlib.crc32(str(x[0]).encode()) % 4 == 2], "doc_id long, quality int, toxic int")).collect()
    first = pu.pu_scores(frame(spark, rows).repartition(3), df).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in first}
    assert {r["score"] for r in pu.pu_scores(frame(spark, rows[:5]), df.limit(0)).collect()} == {0.5}
    assert pu.pu_scores(frame(spark, rows).limit(0), df).count() == 0


def test_pu_minimises_the_risk(spark):
    """Scores are those of the weights that minimise the non-negative unbiased risk, found by another way from the texts."""
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randint(15, 90)) if i % 4 else " ".join(w + "#$" for w in prose(rng, 30).split()), "en", "s", 1) for i in range(240)]
    rows += rows[:5]  # repeated rows count each
    labels = spark.createDataFrame([(i, 1, 0) for i in range(240) if i % 4 and i % 3 == 0], "doc_id long, quality int, toxic int")
    got = Counter((r["doc_id"], round(r["score"], 6)) for r in pu.pu_scores(spark.createDataFrame(rows, DOCS), labels).collect())
    good = {i for i in range(240) if i % 4 and i % 3 == 0 and zlib.crc32(str(i).encode()) % 4 != 2}
    x = np.array([pu.features(t) for _, t, *_ in rows]) / 255
    p = np.array([i in good for i, *_ in rows])
    scale = max(1.0, pu.ENOUGH / p.sum())

    def weights(prior):
        for ridge in pu.RIDGES:
            # least squares: the risk is a sum of squares over unlabelled rows and a linear term over positives
            a = np.concatenate([x / np.sqrt(2 * len(x)), np.sqrt(ridge * scale) * np.eye(x.shape[1])])
            w = np.linalg.solve(a.T @ a, prior * x[p].mean(0) - x.mean(0) / 2)
            f = x @ w
            if ((1 + f) ** 2).mean() / 4 - prior * ((1 + f[p]) ** 2).mean() / 4 >= 0:
                return w, ridge
        return w, ridge

    first, _ = weights(0.5)
    bins = pu._bin(x @ first)
    prior = pu.class_prior(np.bincount(bins[p], minlength=pu.SCORE_BINS), np.bincount(bins, minlength=pu.SCORE_BINS))
    w, ridge = weights(prior)
    assert got == Counter((i, round(float(np.clip((f + 1) / 2, 0, 1)), 6)) for (i, *_), f in zip(rows, x @ w))
    risk = lambda v: ((1 + x @ v) ** 2).mean() / 4 - prior * (x[p] @ v).mean() + ridge * scale * (v @ v) / 2
    noise = np.random.default_rng(1).normal(size=(50, len(w))) * 1e-3
    assert all(risk(w) <= risk(w + d) for d in noise)


PAGE = "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy</div>%s<footer>&copy; foot</footer></body></html>"


@pytest.mark.parametrize("body, expected", [
    ("<article><h1>Head &amp; more</h1><p><b>One\n  two<br>three</p><p>Four &lt;x&gt;", "Head & more\nOne two three\nFour <x>"),
    ("<main><p>A</p><aside>side</aside><form><p>f</p></form><div class='comments'><p>c</p></div><div class='cookie-notice'>n</div>B</main>", "A\nB"),
    ("<article><header><h1>T</h1></header><p>x &am</p><section id=comments><article class=comment>no</article></section></article>", "T\nx &am"),
    ("<div><p>plain</p><noscript>js</noscript></div>", "plain"), ("", ""), ("<article></article>", ""), ("<p>a < b", "a < b"),
])
def test_html_structure(body, expected):
    assert html.main_text(html.blocks_of(PAGE % body)) == expected


def test_html_repeated_runs(spark):
    rng = random.Random(2)
    shared = "one two three four five six seven eight nine ten"
    texts = [prose(rng, 30) for _ in range(12)]
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<body><p>{shared}</p><p>{t}</p><p>start {t} {shared} end</p><p>Short line</p></body>") for i, t in enumerate(texts)]
    rows += [(20, "http://h0.example/a", "<article><p>" + shared + "</p></article>"), (21, None, None), (22, "bad", ""), (None, "http://h0.example/n", rows[0][2])]
    rows += [(30 + i, "http://copies.example/", f"<p>{texts[0]} {texts[1]}</p>") for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "blocks": F.lit(2)})
    for limit in (200_000, 150):  # one suffix array a host, and hosts split into many
        got = {r["page_id"]: r for r in html.extract_main_text(df, shard_tokens=limit).collect()}
        assert len(got) == len(rows)
        for i, t in enumerate(texts):
            assert got[i]["text"] == f"{t}\nstart {t}", i  # "end" belongs to a run that all pages share
        assert got[20]["text"] == shared and got[21]["text"] == "" and got[22]["text"] == "" and got[30]["text"] == f"{texts[0]} {texts[1]}"
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.extract_main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("mention", [
    '<script type="application/ld+json">{"articleBody": "x"}</script>', "<style>.entry-content, .post-body {}</style>", "<!-- <main class=x> -->",
    "<section class=comments><article><p>a reader</p></article></section>", "<script>var t = '<article></article>'</script>",
])
def test_html_runs_go_where_a_container_is_only_mentioned(spark, mention):
    rng = random.Random(4)
    shared, texts = prose(rng, 12), [prose(rng, 30) for _ in range(4)]
    rows = [(i, f"http://h.example/{i}", f"<body>{mention}<p>{shared}</p><p>{t}</p></body>") for i, t in enumerate(texts)]
    df = spark.createDataFrame([*rows, (9, "http://h.example/9", f"{mention}<main><p>{shared}</p></main>")], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html.extract_main_text(df).collect()} == dict(enumerate(texts)) | {9: shared}


def test_html_hints_are_decided_by_the_host(spark):
    """What a name only hints at stays if it is unique on the host and goes if the host repeats it, whatever the structure says."""
    rng = random.Random(6)
    share = "Share this story with your friends on every network you know"
    texts = [prose(rng, 30) for _ in range(5)]
    page = '<article><h1 class="banner">Head {i}</h1><p class="social">Social policy {t}</p><p>{t}</p><div class="share">{share}</div><div class="ad">Buy {i}</div></article>'
    rows = [(i, f"http://h.example/{i}", page.format(i=i, t=t, share=share)) for i, t in enumerate(texts)]
    rows += [(9, "http://alone.example/", page.format(i=9, t=texts[0], share=share))]
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == f"Head {i}\nSocial policy {t}\n{t}"
        assert got[i] != html.main_text(html.blocks_of(rows[i][2]))  # the suffix arrays changed this text
    assert got[9] == f"Head 9\nSocial policy {texts[0]}\n{texts[0]}\n{share}"


@pytest.mark.parametrize("limit", [200_000, 40])
def test_html_pages_with_an_article_take_the_suffix_arrays_too(spark, monkeypatch, limit):
    """The arrays remove the menu that every page of the host repeats; nothing passes beside them, and articles stay whole."""
    menu = "one two three four five six seven eight nine ten"
    rows = [(i, f"http://h.example/{i}", f"<body><nav>{menu}</nav><article><p>{menu}</p><p>own {i}</p></article><footer>only here {i}</footer></body>") for i in range(6)]
    found = []
    run = html.host_runs
    monkeypatch.setattr(html, "host_runs", lambda *args: found.append(run(*args)) or found[-1])
    out = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_tokens=limit)
    assert {r["page_id"]: r["text"] for r in out.collect()} == {i: f"{menu}\nown {i}" for i in range(6)}
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    places = [p for r in found[0].collect() for p in r["places"]]
    assert len({p["page"] for p in places}) == 6 and {p["block"] for p in places if p["length"] >= 8} == {0}
    if limit > 40:  # one shard: overlapping runs are one place
        assert sorted((p["block"], p["start"], p["length"]) for p in places) == [(0, 0, 10)] * 6


def brute_text(pages, run=html.RUN, min_pages=html.MIN_PAGES):
    """Texts of pages without an article: every run of tokens is looked up on every distinct page of the host."""
    out, hosts = {}, {}
    for i, host, blocks in pages:
        hosts.setdefault(host, {}).setdefault(tuple(blocks), []).append(i)
    for distinct in hosts.values():
        def runs(block):
            w = block.split(" ")
            return [(0, len(w), (len(w), *w))] if len(w) < run else [(k, run, tuple(w[k : k + run])) for k in range(len(w) - run + 1)]

        on = Counter(r for blocks in distinct for r in {r for b in blocks for _, _, r in runs(b)})
        for blocks, ids in distinct.items():
            kept = []
            for b in blocks:
                w = b.split(" ")
                gone = {k + j for k, n, r in runs(b) if on[r] >= min_pages for j in range(n)}
                kept.append(" ".join(x for k, x in enumerate(w) if k not in gone))
            for i in ids:
                out[i] = "\n".join(k for k in kept if k)
    return out


@pytest.mark.parametrize("limit, shard_pages", [(200_000, 500), (60, 500), (200_000, 3)])
def test_html_against_brute_force(spark, limit, shard_pages):
    rng = random.Random(11)
    pool = [prose(rng, rng.choice([2, 7, 8, 9, 20])) for _ in range(12)]
    pages = []
    for i in range(40):
        blocks = [" ".join([rng.choice(pool), *rng.choices(["", prose(rng, 3)])]).strip() for _ in range(rng.randint(1, 5))] + [prose(rng, 12)]
        pages.append((i, f"h{i % 3}.example", blocks))
    pages += [(100 + i, "h0.example", pages[0][2]) for i in range(4)]
    rows = [(i, f"http://{h}/{i}", "".join(f"<p>{b}</p>" for b in blocks)) for i, h, blocks in pages]
    got = {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shard_tokens=limit, shard_pages=shard_pages).collect()}
    want = brute_text(pages)
    assert got == want and any(got[i] != "\n".join(b) for i, _, b in pages)


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 6))]
        tokens, ends = np.array([rng.randint(0, 2) for _ in range(sum(sizes))]), np.repeat(np.cumsum(sizes), sizes)
        suffix = [tuple(tokens[i : ends[i]]) for i in range(len(tokens))]
        order, common = html.suffix_array(tokens, ends)
        assert [suffix[i] for i in order] == sorted(suffix)
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert all(shared(suffix[a], suffix[b]) == c for a, b, c in zip(order, order[1:], common[1:]))
        run = rng.randint(1, 4)
        order, first, length = html.repeats(tokens, ends, run)
        want = {}
        for i, s in enumerate(suffix):
            if len(s) >= run:
                want.setdefault(s[:run], set()).add(i)
        groups = np.split(order, first[1:]) if len(first) else []
        assert {suffix[g[0]][:run]: set(g.tolist()) for g in groups} == want
        for g, n in zip(groups, length):
            assert n == (run if len(g) == 1 else min(shared(suffix[a], suffix[b]) for a in g for b in g if a != b))


@pytest.mark.parametrize("junk", ["<article>", '<p x="', "</x>", "<a b='", "<div class=ad ", "<", "<!--", "&", "a<b ", "<p " + "x" * 50])
def test_html_long_and_malformed(junk):
    import time

    began = time.perf_counter()
    assert isinstance(html.main_text(html.blocks_of("<article><p>x " + junk * 60_000)), str)
    assert time.perf_counter() - began < 10


@pytest.mark.parametrize("source, expected", [
    ('<article><p title="x>hello world</p><p>more</p></article>', "hello world\nmore"), ("<article><p title = \"a > b\" data-x='c>d'>t</p></article>", "t"), ('<article><p a"b>t</p></article>', "t"),
    ("<article><p>a</p></div></section><p>b</article><p>c", "a\nb"),
])
def test_html_quotes_and_stray_tags(source, expected):
    assert html.main_text(html.blocks_of(source)) == expected


def thue_morse(n):
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_of_a_regular_build_differ(spark):
    """Such words have one value under any polynomial modulo 2**64: they must be neither copies nor duplicates."""
    a, b = thue_morse(1024)
    h = common.word_hashes(f"{a} {b} {a}".encode())
    assert h[0] == h[2] and h[0] != h[1] and common.word_hashes(b" \n").size == 0
    x, y = thue_morse(64)  # and runs of words
    left, right = (common.gram_hashes(common.word_hashes(" ".join(w).encode()), 64) for w in (x, y))
    assert left[0] != right[0]
    rows = [(1, " ".join([a] * 60)), (2, " ".join([b] * 60)), (3, " ".join([a] * 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring.remove_duplicate_spans(df).collect()} == {1: 0, 2: 0, 3: 60}
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 1}


def test_bloom_grows_with_its_keys(spark):
    small, large = (common.Bloom(spark.range(n).select(F.xxhash64("id").alias("h")), "h") for n in (10, 20_000))
    assert small.bits == common.LEAST_BITS and large.bits == 19
    keys = np.array([r["h"] for r in spark.range(20_000).select(F.xxhash64("id").alias("h")).collect()])
    others = np.array([r["h"] for r in spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("h")).collect()])
    assert large.has(keys).all() and large.has(others).mean() < 0.03 and not small.has(others).all()


def words_of(rows):
    return {i: WORD.findall(t or "") for i, t, *_ in rows if i is not None}


def test_factors(spark, corpus):
    """Factors don't overlap, are long enough, and are the words of a document with a smaller id at the place they name."""
    rows = [r for k, r in enumerate(corpus) if r[0] != 4 or k == 4]
    words = words_of(rows)
    found = substring.factorise(frame(spark, rows)).collect()
    assert found
    by = {}
    for r in found:
        assert r["n_words"] >= 50 and r["ref_id"] < r["doc_id"]
        assert words[r["doc_id"]][r["start"] : r["start"] + r["n_words"]] == words[r["ref_id"]][r["ref_start"] : r["ref_start"] + r["n_words"]]
        by.setdefault(r["doc_id"], []).append((r["start"], r["start"] + r["n_words"]))
    for spans in by.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert substring.factorise(frame(spark, rows).limit(0)).count() == 0


def test_parse_looks_at_factor_ends():
    """Windows across the end of a factor come from another reference; the parse alone would leave them out."""
    ref = lambda i, at, first, n: {"ref_id": i, "ref_start": first, "ref_lead": 0, "start": at, "count": n, "lead": 0, "windows": None}
    factors, gone = substring.parse(None, [ref(1, 0, 100, 3), ref(2, 3, 7, 2)], 20, window=5)
    assert factors == [(0, 7, 1, 100)] and gone.tolist() == [True] * 9 + [False] * 11
    factors, gone = substring.parse(None, [ref(1, 0, 10, 4), ref(1, 4, 14, 4), ref(0, 2, 0, 3), ref(3, 12, 5, 1)], 20, window=5)
    assert factors == [(0, 12, 1, 10), (12, 5, 3, 5)] and gone.tolist() == [True] * 17 + [False] * 3
    mine, theirs = np.arange(16, dtype=np.uint64), np.array([50, 51, 4, 5, 6, 90], np.uint64)
    factors, gone = substring.parse(mine, [{"ref_id": 1, "ref_start": 30, "ref_lead": 4, "start": 2, "count": 8, "lead": 4, "windows": theirs.tobytes()}], 20, window=5)
    assert factors == [(4, 7, 1, 32)] and gone.nonzero()[0].tolist() == list(range(4, 11))


def test_shared_passages_of_many_documents(spark):
    """A passage in many documents, cut at different places, and chains in which each document takes from two others."""
    rng = random.Random(21)
    passage = prose(rng, 130).split()
    rows = []
    for i in range(80):
        a = rng.randrange(0, 60)
        z = a + rng.choice([48, 49, 50, 51, 70])
        rows.append((i, " ".join([prose(rng, rng.randint(0, 20)), *passage[a:z], prose(rng, rng.randint(0, 20)), *(rows[rng.randrange(i)][1].split()[5:80] if i else [])])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in substring.remove_duplicate_spans(df).collect()}
    assert got == {i: (n, t) for i, n, t in brute_removed(rows)} and any(n for n, _ in got.values())


def brute_removed(rows):
    first: dict = {}
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        for p in range(len(w) - 49):
            k = tuple(w[p : p + 50])
            first[k] = min(first.get(k, i), i)
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        gone = {p + k for p in range(len(w) - 49) if first[tuple(w[p : p + 50])] < i for k in range(50)}
        yield i, len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)


def test_substring_dedup(spark, corpus):
    got = substring.remove_duplicate_spans(frame(spark, corpus), keep=("lang",)).collect()
    first: dict = {}
    for i, t, *_ in corpus:
        if i is not None:
            w = WORD.findall(t or "")
            for p in range(len(w) - 49):
                k = tuple(w[p : p + 50])
                first[k] = min(first.get(k, i), i)
    want = Counter()
    for i, t, *_ in corpus:
        w = WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p : p + 50])] < i:
                gone.update(range(p, p + 50))
        want[i, "en", len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)] += 1
    assert Counter(map(tuple, got)) == want and any(r["n_removed"] for r in got)
    assert substring.remove_duplicate_spans(frame(spark, corpus).limit(0)).count() == 0


def brute_groups(rows, gram, similar):
    sets, parent = {}, {}
    for i, t, *_ in rows:
        if i is not None:
            w = (t or "").encode().lower().split()
            sets[i] = {tuple(w[k : k + gram]) for k in range(len(w) - gram + 1)} if len(w) >= gram else {tuple(w)} if w else set()
            parent[i] = i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and similar[1] * len(sets[a] & sets[b]) >= similar[0] * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("gram, similar", [(3, (90, 100)), (5, (80, 100))])
def test_jaccard_join(spark, corpus, gram, similar):
    got = jaccard.near_duplicates(frame(spark, corpus), gram, similar).collect()
    want = brute_groups(corpus, gram, similar)
    assert len(got) == len(corpus)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
    assert any(i != c for i, (_, c) in want.items())


@pytest.mark.parametrize("gram, similar", [(3, (90, 100)), (5, (80, 100))])
def test_jaccard_join_of_a_crowd_in_small_blocks(spark, gram, similar):
    """Hundreds of texts that share most of their n-grams, some just similar and some just not, over many blocks."""
    rng = random.Random(31)
    base = prose(rng, 60).split()
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = prose(rng, 1) + "z"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(base[:20]) + " " + prose(rng, 40)) for i in range(30)]
    want = brute_groups(rows, gram, similar)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for texts, grams in ((2048, 10**6), (16, 10**6), (64, 700)):
        got = jaccard.near_duplicates(df, gram, similar, texts, grams).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert len({c for _, c in want.values()}) > 40


def test_distances_are_exact():
    rng = np.random.default_rng(5)
    for g in (2, 3, 7, 40):
        base = rng.integers(0, 2**63, 50).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.random(50) < 0.8], rng.integers(0, 60, rng.integers(0, 9)).astype(np.uint64)])) for _ in range(g)]
        bitmaps = jaccard.bitmap_distance([jaccard.parity_bitmap(x) for x in sets])
        near, all_ = jaccard.gram_distance(sets), np.arange(g)
        for i in range(g - 1):
            js = all_[i + 1 :]
            true = [len(np.setxor1d(sets[i], sets[j])) for j in js]
            assert near(i, js).tolist() == true and (bitmaps(i, js) <= true).all()
    wide, small = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (900, 60))
    assert jaccard.bitmap_distance([jaccard.parity_bitmap(wide), jaccard.parity_bitmap(small)])(0, np.array([1]))[0] <= 960


def test_one_of_each(spark, corpus):
    want = brute_groups(corpus, 5, (80, 100))
    got = jaccard.one_of_each(frame(spark, corpus), 5, (80, 100))
    ids = Counter(r["doc_id"] for r in got.collect())
    assert got.columns == frame(spark, corpus).columns
    assert ids == Counter({i: 1 for i, (_, c) in want.items() if i == c}) + Counter({None: 2})
    assert jaccard.one_of_each(frame(spark, corpus).limit(0)).count() == 0


def test_pigeonhole_keys():
    """Any two similar sets share a key that one of them searches."""
    rng = np.random.default_rng(1)
    for similar in ((90, 100), (80, 100)):
        edges = jaccard.bands(similar, 10**6)
        for size in (5, 9, 10, 11, 19, 20, 40, 97, 300):
            for _ in range(60):
                x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
                d = int(len(x) * (similar[1] - similar[0]) / similar[1])
                drop, add = rng.integers(0, d + 1), rng.integers(0, d + 1)
                y = np.unique(np.concatenate([x[drop:], rng.integers(0, 2**63, add).astype(np.uint64)]))
                common = len(np.intersect1d(x, y))
                if similar[1] * common < similar[0] * (len(x) + len(y) - common) or np.array_equal(x, y):
                    continue
                (a, p), (b, q) = (jaccard.keys_of(s, 3, similar, edges) for s in (x, y))
                other = dict(zip(b.tolist(), q.tolist()))
                assert any(k in other and (f or other[k]) for k, f in zip(a.tolist(), p.tolist()))


@pytest.mark.parametrize("in_one_task", [0, 10**6])
def test_components(spark, in_one_task):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r["node"]: r["least"] for r in jaccard.components(spark.createDataFrame(pairs, "u long, v long"), in_one_task).collect()}
    for i in range(40):
        if i % 10:
            assert got[i] == i - i % 10
    assert all(got[x] == 100 for x in range(101, 160)) and all(got.get(a, a) == got.get(b, b) for a, b in pairs)


def test_sharding(spark, corpus):
    rows = corpus + [(i, "t", "en", "s", 1) for i in range(1000, 4000)]
    got = sharding.shard_rows(frame(spark, rows), shards=40).collect()
    assert len(got) == len(rows)
    for s in range(40):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got) and any(r["grown_shard"] == 40 for r in got)
    assert len({(r["doc_id"], r["shard"]) for r in got}) == len({r["doc_id"] for r in got})
    by = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert by == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sharding.shard_rows(frame(spark, rows).limit(0)).count() == 0


def spark_hash(key, leaf, seed):
    """Spark's xxhash64 of a long and two ints: each column's hash seeds the next one's."""
    import struct

    import xxhash

    h = 42
    if key is not None:
        h = xxhash.xxh64_intdigest(struct.pack("<q", key), h)
    for x in (leaf, seed):
        h = xxhash.xxh64_intdigest(struct.pack("<i", x), h)
    return h


def test_shards_against_independent_draws(spark, corpus):
    """The leaf with the least draw of all is the leaf of the descent; equal rows, however many, get slots of their own."""
    rows = corpus + [(i, "t", "en", "s", 1) for i in range(1000, 1300)] + [(7777, "same", "en", "s", 1)] * 25_000
    got = sharding.shard_rows(spark.createDataFrame(rows, DOCS)).collect()
    draw = lambda key, leaf: -math.log(((spark_hash(key, leaf, 7) >> 11) + 0.5) * 2.0**-53)
    least = {key: [min(range(n), key=lambda leaf: draw(key, leaf)) for n in (40, 41)] for key in {r["doc_id"] for r in got}}
    assert all([r["shard"], r["grown_shard"]] == least[r["doc_id"]] for r in got)
    for s in range(40):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)


def test_descent_confines_movement(spark):
    ids = spark.range(6000)
    base = [1.0] * 24
    heavier = [*base]
    heavier[9] = 3.0
    both = sharding.descend(sharding.descend(ids, F.col("id"), base, "a"), F.col("id"), heavier, "b").collect()
    assert {r["b"] for r in both if r["a"] != r["b"]} == {9}
    share = sum(r["b"] == 9 for r in both) / len(both)
    assert abs(share - 3 / 26) < 0.02 and abs(sum(r["a"] == 5 for r in both) / len(both) - 1 / 24) < 0.02
    zero = sharding.descend(ids, F.col("id"), [0.0, 1.0, 0.0, 1.0, 0.0], "s").select("s").distinct().collect()
    assert {r["s"] for r in zero} == {1, 3}


def test_url_filters(spark):
    events = spark.createDataFrame(
        [("domain", "evil.com", "2024-01-10", "add"), ("domain", "evil.com", "2024-02-01", "remove"), ("domain", "evil.com", "2024-03-01", "add"), ("host", "a.good.org", "2024-01-01", "add"),
         ("host", "a.good.org", "2024-01-01", "remove"), ("url", "x.net/p?q=1", "2024-01-05", "add"), (None, "z", "2024-01-01", "add"), ("domain", "net", "2024-01-20", "add"), ("domain", "net", "2024-01-25", "add")],
        "kind string, entry string, day string, action string",
    ).withColumn("listed_on", F.col("day").cast("date"))
    captures = [
        (1, "http://www.evil.com/a", "2024-01-09"), (2, "http://www.evil.com/a", "2024-01-10"), (3, "https://EVIL.com.", "2024-02-01"), (4, "http://evil.com", "2024-03-05"), (5, "http://notevil.com/", "2024-03-05"),
        (6, "http://a.good.org", "2024-01-02"), (7, "http://user@www.x.net:80/p?q=1#f", "2024-01-06"), (8, "http://www.x.net/p?q=1", "2024-01-21"), (9, None, "2024-01-21"), (10, "nonsense", "2024-01-21"), (11, "http://evil.com", None), (None, "http://evil.com", "2024-03-05"),
    ]
    got = urlfilter.filter_urls(spark.createDataFrame(captures, "page_id long, url string, fetched_on string").withColumn("kind", F.lit("clash")), events).collect()
    assert len(got) == len(captures)
    seen = {r["page_id"]: (r["blocked"], r["n_entries"], r["kind"], r["entry"]) for r in got}
    no = (False, 0, None, None)
    assert seen == {1: no, 2: (True, 1, "domain", "evil.com"), 3: no, 4: (True, 1, "domain", "evil.com"), 5: no, 6: no, 7: (True, 1, "url", "x.net/p?q=1"), 8: (True, 2, "url", "x.net/p?q=1"), 9: no, 10: no, 11: no, None: (True, 1, "domain", "evil.com")}
    held = [(r["entry"], str(r["since"]), str(r["until"])) for r in urlfilter.intervals(events).orderBy("entry", "since").collect()]
    assert held == [("evil.com", "2024-01-10", "2024-02-01"), ("evil.com", "2024-03-01", "None"), ("net", "2024-01-20", "None"), ("x.net/p?q=1", "2024-01-05", "None")]


def test_url_filters_relisted_and_empty(spark):
    """Entries that come and go again, against a scan of all intervals; and empty tables on either side."""
    rng = random.Random(12)
    day = lambda n: f"2024-{1 + n // 28:02d}-{1 + n % 28:02d}"
    names = [("domain", "a.com"), ("host", "x.a.com"), ("url", "x.a.com/p"), ("domain", "b.org")]
    events = [(k, e, day(rng.randrange(200)), rng.choice(["add", "remove"])) for k, e in names for _ in range(25)]
    captures = [(i, rng.choice(["http://x.a.com/p", "http://y.a.com/", "http://b.org", "http://c.org/"]), day(rng.randrange(220))) for i in range(150)] + [(150 + i, "http://x.a.com/p", day(100)) for i in range(50)]
    lists = spark.createDataFrame(events, "kind string, entry string, day string, action string").selectExpr("kind", "entry", "CAST(day AS date) AS listed_on", "action")
    pages = spark.createDataFrame(captures, "page_id long, url string, fetched_on string")
    state = {}
    for k, e in names:
        last, on = [], False
        for d in sorted({d for a, b, d, _ in events if (a, b) == (k, e)}):
            now = all(x == "add" for a, b, c, x in events if (a, b, c) == (k, e, d))
            if now != on:
                last.append((d, now))
            on = now
        state[k, e] = last
    got = {r["page_id"]: r["n_entries"] for r in urlfilter.filter_urls(pages, lists).collect()}
    hits = {"http://x.a.com/p": names[:3], "http://y.a.com/": names[:1], "http://b.org": names[3:], "http://c.org/": []}
    active = lambda n, d: next((on for at, on in reversed(state[n]) if at <= d), False)
    assert got == {i: sum(active(n, d) for n in hits[u]) for i, u, d in captures} and len(set(got.values())) > 2
    assert urlfilter.filter_urls(pages.limit(0), lists).count() == 0
    assert {r["blocked"] for r in urlfilter.filter_urls(pages, lists.limit(0)).collect()} == {False}


def vectors(n, seed=1, dims=8):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dims)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(300)]  # one common vector
    return rows + [(5000, None), (5001, [0.0] * dims), (5002, [float("nan")] * dims), (5003, [None] * dims), (5004, [float("inf")] * dims), (None, rows[0][1]), (7, rows[7][1])]


def test_nearest(spark):
    rows = vectors(700)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    got = ann.nearest(df, df.where("vec_id % 100 = 0"), k=10, shard_rows=200, least_shards=4).collect()
    good = {i: np.array(v) for i, v in rows if i is not None and v and i < 5000}
    for q in (i for i in good if i % 100 == 0):
        want = sorted((math.sqrt(reduce(add, ((a - b) * (a - b) for a, b in zip(good[q].tolist(), v.tolist())))), i) for i, v in good.items() if i != q)[:10]
        mine = sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [(s, i) for _, s, i in mine] == want and [r for r, _, _ in mine] == list(range(1, 11))
    assert ann.nearest(df.limit(0), df.where("vec_id % 100 = 0"), least_shards=2).count() == 0
    assert ann.nearest(df.where("vec_id < 4"), df.where("vec_id = 0"), least_shards=2).count() == 3


@pytest.mark.parametrize("shards", [1, 4])
def test_nearest_of_ids_with_many_vectors(spark, shards):
    rng = np.random.default_rng(6)
    rows = [(0, [0.0, 1.0])] + [(i, [float(x), 1.0]) for i in (1, 2) for x in rng.uniform(0.1, 1, 60)] + [(i, [float(i), 1.0]) for i in range(3, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id = 0"), k=10, least_shards=shards).collect()
    least = {i: min(v[0] for j, v in rows if j == i) for i in range(1, 40)}
    assert [(r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted(least.items(), key=lambda x: (x[1], x[0]))[:10]


def test_nearest_skips_cells(spark):
    """Clustered vectors: the second round reaches few cells, and the result is that of all of them, ties and crowds too."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(30, 6)) * 50
    points = np.concatenate([centres[rng.integers(0, 30, 900)] + rng.normal(size=(900, 6)), np.repeat(centres[:1], 500, axis=0)])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), k=10, shard_rows=100, least_shards=20, block_rows=7).collect()
    for q in range(0, len(rows), 50):
        d = np.sqrt(reduce(add, [(points[:, j] - points[q, j]) ** 2 for j in range(6)]))
        want = sorted((x, i) for i, x in enumerate(d.tolist()) if i != q)[:10]
        assert sorted((r["rank"], r["score"], r["vec_id"]) for r in got if r["query_id"] == q) == [(k + 1, s, i) for k, (s, i) in enumerate(want)]


def test_pruning_factor():
    rng = np.random.default_rng(3)
    points = rng.normal(size=(3000, 6))
    tree = ann.VPTree(points)
    exact, _ = tree.search(points[:100], np.arange(100), np.arange(3000), 10, 1.0)
    d = ann.distances(points[:100], points)
    d[np.arange(100), np.arange(100)] = np.inf
    assert np.array_equal(exact, np.argsort(d, 1, kind="stable")[:, :10])
    loose, _ = tree.search(points[:100], np.arange(100), np.arange(3000), 10, 3.0)
    recall = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact, loose)])
    assert 0.2 < recall <= 1.0
