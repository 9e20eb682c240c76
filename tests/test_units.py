"""Section windows and trace candidates against brute force over random rows."""

import random

import pytest
from pyspark.sql import functions as F

from reqlens.functions import extract as E, text as X
from reqlens.operators import traceability as T, units as U

SCHEMA = "package_id string, doc_id string, doc_role string, pos int, section_id string, section_title string, text string"
SENTENCES = ["Система должна обеспечивать хранение журнала событий", "список и прочее", "Сервис должен передавать отчет", "таблица данных", "слово", "  мелкий текст  "]


def by_hand(rows, size):
    """Windows of sections, from (section, pos, text, alone) rows."""
    out = []
    for section in sorted({r[0] for r in rows}):
        group, own = [], 0
        for i, (_, _, text, alone) in enumerate(sorted(r for r in rows if r[0] == section)):
            if group and (len(group) >= size or (alone and own)):
                out.append((section, group[0][0], " ".join(t for _, t in group)))
                group, own = [], 0
            group.append((i, text))
            own += alone
        if group:
            out.append((section, group[0][0], " ".join(t for _, t in group)))
    return sorted(out)


def test_section_windows_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [("p", f"d{d}", "pz", i, rnd.choice(["a", "b", None, ""]) if d else "a", rnd.choice([None, "", "Раздел", "Иное"]), rnd.choice(SENTENCES)) for d in range(3) for i in range(120)]
    rows += [("p", "bare", "pz", 0, None, None, SENTENCES[0])]  # no section at all: no window
    fragments = spark.createDataFrame(rows, SCHEMA)
    got = U.section_windows(fragments, size=3, chars=10_000).collect()
    usable = U.usable_fragments(fragments).select("doc_id", F.coalesce("section_id", F.lit("")).alias("s"), "pos", F.trim("text").alias("t"), E.is_self_contained(F.col("text")).alias("sc"), "section_title").where("doc_id != 'bare'").collect()
    assert any(r.sc for r in usable) and not all(r.sc for r in usable)
    want = by_hand([((r.doc_id, r.s), r.pos, r.t, bool(r.sc)) for r in usable], 3)
    assert sorted(((g.doc_id, g.section_id or ""), g.window_start, g.text) for g in got) == want
    for g in got:
        mine = sorted((r.pos, r.section_title) for r in usable if (r.doc_id, r.s) == (g.doc_id, g.section_id or ""))
        assert g.first_pos == mine[0][0] and g.section_title == next((t for _, t in mine if t), None)
    assert U.section_windows(fragments.where("false")).count() == 0


SIDE = "package_id string, pos int, id string, text string, section string, metadata map<string,string>"


@pytest.mark.parametrize("cfg", [T.TraceConfig(top_k=3), T.TraceConfig(top_k=3, min_score=0.12), T.TraceConfig(top_k=2, section=0.4, min_score=0.25), T.TraceConfig(top_k=3, min_score=0.0)])
def test_trace_candidates_against_every_pair(spark, cfg):
    rnd = random.Random(7)
    words = ["login", "export", "report", "upload", "archive", "user", "page", "retry"]

    def side(p):
        return [("ab"[i % 2], i, f"{p}{i}", " ".join(rnd.choices(words, k=rnd.randint(0, 9))), rnd.choice([None, "", "ui", "core ui", "core"]), rnd.choice([None, {}, {"k": "1"}, {"k": "2", "z": None}])) for i in range(40)]

    reqs, tests = spark.createDataFrame(side("r"), SIDE), spark.createDataFrame(side("t"), SIDE)
    pairs = T.requirement_side(reqs).join(T.test_side(tests), "package_id").select("package_id", "req_id", "test_id", "test_pos", "req_tokens", "test_tokens", "req_section", "test_section", "req_meta", "test_meta").collect()
    want = {}
    for p in pairs:
        a, b = set(p.req_tokens), set(p.test_tokens)
        shared = set(p.req_meta) & set(p.test_meta)
        meta = sum(p.req_meta[k] == p.test_meta[k] for k in shared) / len(shared) if shared else 0.0
        raw = (cfg.lexical * (len(a & b) / len(a) if a and b else 0.0) + cfg.section * bool(set(p.req_section or []) & set(p.test_section or [])) + cfg.metadata * meta) / (cfg.lexical + cfg.section + cfg.metadata + cfg.embedding)
        if raw >= cfg.min_score:
            want.setdefault((p.package_id, p.req_id), []).append((-round(raw + 1e-12, 4), p.test_pos, p.test_id))
    got = {}
    for r in T.candidates(reqs, tests, cfg).collect():
        got.setdefault((r.package_id, r.req_id), []).append((r["rank"], r.test_id))
    assert {k: [t for _, t in sorted(v)] for k, v in got.items()} == {k: [t for *_, t in sorted(v)[: cfg.top_k]] for k, v in want.items()}
