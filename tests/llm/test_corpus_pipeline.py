"""The pipeline, stage by stage, against brute force on a small corpus."""

import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from reqlens.llm import quality
from test_operators import DOCS, WORD, brute_groups, brute_measures, brute_mix, brute_removed, prose

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(41)
    passage = prose(rng, 70)
    out = [(i, prose(rng, rng.choice([8, 12, 60, 150])), "en", rng.choice(["a", "b", "c", None])) for i in range(90)]
    for i in range(90, 110):  # near copies
        words = out[i % 7][1].split() + prose(random.Random(i % 7), 80).split()
        words[rng.randrange(len(words))] = "zz"
        out.append((i, " ".join(words), None, "b"))
    out += [(110 + i, f"{prose(rng, 20)} {passage}\n{prose(rng, 15)}", "fr", "c") for i in range(8)]
    out += [(120 + i, " ".join(w + "#$%&" for w in prose(rng, 40).split()), "en", "a") for i in range(6)]
    out += [(130, None, None, None), (131, "", "en", "a"), (132, "a b c d e " * 10, "en", "a"), (None, prose(rng, 30), "en", "a"), (None, None, None, None)]
    out += [out[5], out[5], (133, out[5][1], "de", "c")]
    return [(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    good = [(i, 1, 0) for i in range(0, 110, 2)] + [(120, 0, 0), (121, 1, 1), (None, 1, 0)]
    spark.createDataFrame(good, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path), {i for i, q, t in good if q and not t and i is not None}


def brute_quality(rows, good):
    size = 1 << quality.BUCKET_BITS
    raw, target = np.zeros(size), np.zeros(size)
    for i, t, *_ in rows:
        at = Counter(quality.buckets((t or "").encode()).tolist())
        for b, n in at.items():
            raw[b] += n
            target[b] += n * (i in good)
    p = (raw + 1) / (raw.sum() + size)
    weight = np.log(((1 - quality.MIXED) * target / target.sum() + quality.MIXED * p) / p)
    for r in rows:
        at = quality.buckets((r[1] or "").encode())
        if not brute_measures(r[1] or "")[-1] and (weight[at].mean() if len(at) else 0) >= quality.THRESHOLD:
            yield r


def brute_one_of_each(rows):
    groups = brute_groups(rows, 5, (80, 100))
    seen = set()
    for r in rows:
        if r[0] is None:
            yield r
        elif groups[r[0]][1] == r[0] and r[:2] not in seen:
            seen.add(r[:2])
            yield r


def brute_spans(rows):
    named = [r for r in rows if r[0] is not None]
    for r, (_, n, text) in zip(named, brute_removed(named)):
        yield (r[0], text, r[2], r[3], len(text)) if n else r
    yield from (r for r in rows if r[0] is None)


def brute_copies(rows):
    docs, size, target = brute_mix(rows)
    for s in size:
        whole = math.floor(target[s] / size[s]) if size[s] else 0
        need, upto, bound = target[s] - whole * size[s], 0, None
        by = Counter()
        for _, q, n, h in docs:
            if q == s:
                by[h] += n
        for h in sorted(by):
            upto += by[h]
            if upto > need:
                bound = h + (upto - need < need - (upto - by[h]))
                break
        for r, (_, q, _, h) in zip(rows, docs):
            if q == s:
                yield from [r] * (whole + (whole < 2 and (bound is None or h < bound)))


def test_stages_against_brute_force(spark, rows, folder):
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path, good = folder
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard", "substring_dedup", "source_mixing", "bpe"]
    docs, want = spark.read.parquet(f"{path}/documents.parquet"), rows
    columns = docs.columns
    for (name, stage), brute in zip(corpus_pipeline.STAGES, [lambda r: brute_quality(r, good), brute_one_of_each, brute_spans, brute_copies]):
        out = stage(spark, docs, path)
        assert out.columns == columns and [d for _, d in out.dtypes] == [d for _, d in docs.dtypes], name
        before, want = want, list(brute(want))
        assert Counter(map(tuple, out.collect())) == Counter(want), name
        assert Counter(before) != Counter(want), name  # each stage does something
        docs = spark.createDataFrame(want, DOCS)
    tok = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids = [(i, tuple(tok.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in want]
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in got.collect()) == Counter((i, len(x), x) for i, x in ids)


def test_stages_carry_other_columns_and_take_empty_tables(spark, rows, folder):
    path, _ = folder
    docs = spark.createDataFrame(rows, DOCS)
    extra = ["key", "n_words", "n_removed", "__key", "__id", "__both", "size", "hash", "c0", "group", "score", "spans", "threshold", "__source", "copies", "a.b"]
    wide = docs.withColumns({c: F.lit(c) for c in extra})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, wide, path)
        assert got.columns == wide.columns, name
        plain = Counter(map(tuple, stage(spark, docs, path).collect()))
        assert Counter(tuple(r)[:5] for r in got.collect()) == plain and {tuple(r)[5:] for r in got.collect()} == {tuple(extra)}, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), path).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, path).count() == len(rows)


def test_words_are_ascii(rows):
    assert WORD.findall("a\u00a0b\tc") == ["a\u00a0b", "c"]
