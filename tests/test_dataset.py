"""Package folders, labelled sentences, sources and sinks."""

import json

from pyspark.sql import functions as F

from reqlens.functions import extract as E
from reqlens.operators import dataset as D, evaluate, legacy, report
from reqlens.sources import packages


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_headings_roles_and_types(spark):
    h = lambda t: one(spark, E.heading(F.col("t")), t=t)
    assert tuple(h("4.1 Требования к программе.")) == ("4.1", "Требования к программе") and tuple(h("Введение")) == ("", "Введение")
    assert h("4.3.1 Система должна хранить") is None and h("Короткая строка") is None and h("") is None and h("4 " + "слово " * 9) is None
    role = lambda t: one(spark, E.role_of_filename(F.col("t")), t=t)
    assert (role("Иванов_ТЗ.docx"), role("pz-final.pdf"), role("ПМИ 2.docx"), role("тз_пми.docx"), role("readme.md")) == ("tz", "pz", "pmi", None, None)
    small = lambda t: one(spark, E.is_small_model(F.col("t")), t=t)
    assert small("qwen2.5:3b") and not small("qwen2.5:7b") and not small(None)


def test_files_of_folders(spark):
    heads = [("a", "1.docx", "Техническое задание"), ("a", "2.docx", "Программа и методика испытаний"), ("a", "3.docx", "ТЗ, требования к программе"), ("b", "x.docx", "прочее"), ("c", "x.docx", "Техническое задание"), ("c", "y.docx", "прочее"), ("d", "p.docx", "ничего"), ("d", "q.docx", "ничего")]
    picked = D.chosen_files(spark.createDataFrame(heads, "folder string, file string, head string"))
    got = {r["folder"]: (r["tz_file"], r["pmi_file"]) for r in picked.collect()}
    assert got == {"a": ("1.docx", "2.docx"), "b": (None, None), "c": (None, None), "d": (None, None)}
    chunks = spark.createDataFrame([("a", "1.docx")] * 25 + [("a", "2.docx")] * 3, "folder string, file string")
    assert {r["folder"]: r["status"] for r in D.folder_status(picked, chunks).collect()} == {"a": "SKIP_SMALL", "b": "AMBIGUOUS_TOO_FEW_FILES", "c": "AMBIGUOUS_CLASSIFY", "d": "AMBIGUOUS_CLASSIFY"}
    assert {r["status"] for r in D.folder_status(picked.where("folder = 'a'"), chunks, 3).collect()} == {"OK"}


def test_sentences_carry_their_section(spark):
    texts = ["Настоящий документ описывает состав работ подробно.", "4. Требования к программе", "Система должна хранить журнал событий не менее 90 дней.", "Иная строка текста без всяких слов долга.", "Введение", "Здесь описано назначение всего документа кратко."]
    chunks = spark.createDataFrame([("p", "d", i, f"c{i}", t) for i, t in enumerate(texts)], "package_id string, doc_id string, pos int, chunk_id string, text string")
    got = D.chunk_sentences(chunks)
    assert [(r["pos"], r["kind"]) for r in got.orderBy("pos", "i").collect()] == [(0, "non_req"), (1, "non_req"), (2, "req"), (3, "req"), (4, "non_req"), (5, "non_req")]
    known = D.distinct_positives(spark.createDataFrame([(1, "система должна хранить журнал событий не менее 90 дней"), (2, "Система должна хранить журнал событий не менее 90 дней!"), (3, "два слова")], "pos int, text string"))
    assert known.count() == 1
    labels = {r["pos"]: (r["label"], r["reason"]) for r in D.label_sentences(got, known).collect()}
    assert labels == {0: (0, "negative"), 1: (0, "negative"), 2: (1, "positive"), 3: (None, "grey_zone"), 4: (0, "negative"), 5: (0, "negative")}
    files = spark.createDataFrame([("p", "Проект ТЗ.docx", [("4", None, "Требования", texts[2])]), ("q", "other.docx", [("4", None, "Требования", texts[2])])], f"package_id string, filename string, sections {D.SECTION_FILE}")
    assert [(r["package_id"], r["kind"]) for r in D.section_sentences(files).collect()] == [("p", "req")]


def test_split_statistics_and_caps(spark):
    rows = spark.createDataFrame([(f"p{i % 12}", int(i % 5 == 0), f"{'w ' * (i % 9 + 1)}", i) for i in range(240)], "package_id string, label int, text string, n int")
    split = evaluate.split_by_package(rows, "package_id")
    capped = evaluate.cap_negatives(split, 3, F.xxhash64("n"))
    for r in capped.groupBy("split").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q")).collect():
        assert r["q"] <= 3 * r["p"]
    words = {}
    for r in split.collect():
        words.setdefault(r["split"], []).append(len(r["text"].split()))
    for r in evaluate.split_stats(split, F.size(F.split(F.trim("text"), " "))).collect():
        w = sorted(words[r["split"]])
        assert (r["n"], r["p50"], r["p95"]) == (len(w), w[len(w) // 2], w[int(0.95 * len(w))])


def test_legacy_targets_without_chunks(spark):
    chunks = spark.createDataFrame([("p", "PMI", "c1", 0, "хранить журнал событий")], "package_id string, doc_type string, chunk_id string, pos int, text string")
    reqs = legacy.requirements(spark.createDataFrame([("p", 0, "Система должна хранить журнал"), ("p", 1, "без слова"), ("p", 2, "необходимо иное")], "package_id string, pos int, text string"))
    targets = spark.createDataFrame([("p", "PMI"), ("p", "PZ")], "package_id string, doc_type string")
    got = {(r["req_key"], r["doc_type"]): (r["status"], r["score"]) for r in legacy.match(reqs, chunks, targets).collect()}
    assert got[("TZ-RQ-00002", "PZ")] == ("MISSING", 0.0) and len(got) == 4 and got[("TZ-RQ-00001", "PMI")][1] == 0.4
    matches = legacy.match(reqs, chunks, targets)
    assert tuple(legacy.stats(matches).first()) == ("p", 2, 2, 2) and legacy.defects(matches).count() == 4


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"package_id": "p", "documents": [{"doc_id": "d", "doc_type": "TZ", "chunks": [{"chunk_id": "c", "text": " x "}, {"chunk_id": "e", "text": " "}]}]}))
    (tmp_path / "in" / "b.json").write_text(json.dumps({"filename": "tz.json", "sections": [{"sectionId": "1", "title": "t", "text": "x"}]}))
    (tmp_path / "in" / "c.json").write_text(json.dumps({"other": 1}))
    assert sorted(r["format"] for r in D.read_any(spark, str(tmp_path / "in")).collect()) == ["chunks", "sections", "unknown"]
    assert [r["text"] for r in packages.read_legacy(spark, str(tmp_path / "in" / "a.json")).collect()] == ["x"]
    (tmp_path / "dump.json").write_text(json.dumps({"document_id": "d", "sections": [{"id": "s", "section_name": "n", "level": 1}], "bq_candidates": [{"candidate_id": "1", "candidate_type": "test_step", "text": "t", "source_section_id": "s"}, {"candidate_id": "2", "candidate_type": "requirement_like", "text": "r", "source_section_id": "s", "section_category": "requirements"}]}))
    doc = D.read_dump(spark, str(tmp_path / "dump.json")).first()
    assert [f["kind"] for f in doc["fragments"]] == ["test_step", "paragraph"] and [c["req_id"] for c in doc["requirement_candidates"]] == ["2"] and doc["requirement_candidates"][0]["metadata"]["sectionCategory"] == "requirements"
    pairs = spark.createDataFrame([('a, "b"\nc', "u", 1, "x", "p"), (" ", "u", 0, "x", "p")], "tz_req_text string, pmi_unit_text string, label int, pair_type string, pkg_id string")
    packages.write_pairs(pairs, str(tmp_path / "pairs"))
    assert [r["tz_req_text"] for r in packages.read_pairs(spark, str(tmp_path / "pairs")).collect()] == ['a, "b"\nc']
    packages.write_splits(pairs.select(F.col("tz_req_text").alias("text"), "label", F.lit("train").alias("split")), str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits")).where("split = 'train'").count() == 2
    packages.write_results(pairs, str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results")).count() == 2
    report.write_sheets(str(tmp_path / "sheets"), a=pairs.select("label"), b=pairs.select("pkg_id"))
    assert spark.read.csv(str(tmp_path / "sheets" / "a"), header=True).count() == 2
    assert report.markdown_table(spark.createDataFrame([("a|b", 0.5, None)], "x string, y double, z string")) == "| x | y | z |\n| --- | --- | --- |\n| a\\|b | 0.500 |  |"


def test_fuzzy_matches_against_all_pairs(spark):
    """Every order of tokens gives the rows of all pairs, and frequent tokens make no candidates."""
    import random
    import re

    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    known = [" ".join(["the", "of", *draw.sample(words, draw.randint(1, 12))]) for _ in range(60)] + ["", "--", "one"]
    texts = [*(" ".join([w if draw.random() < 0.85 else draw.choice(["new", "x", *words]) for w in k.split()]) for k in known for _ in range(4)), "the of " * 30, "", "...", "One", "one one one"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    others = spark.createDataFrame([(k,) for k in [*known, known[0], None]], "text string")
    sets = lambda t: set(re.findall(r"[A-Za-zА-Яа-яЁё0-9]+", t.lower()))
    for least in (0.6, 0.85):
        want = set()
        for i, a in enumerate(texts):
            for b in known:
                s, t, w, ow = sets(a), sets(b), len(a.split()), len(b.split())
                if s and t and max(1, w // 2) <= ow <= 2 * w and len(s & t) >= least * len(s | t):
                    want.add(i)
        for ordered in (10_000, 20, 0):
            out = D.fuzzy_matches(rows, others, "id", least, ordered)
            assert {r["id"] for r in out.collect()} == want and len(want) > 40
    # 300 known texts share their two most frequent tokens with every row: none of them is a candidate by these
    many = spark.createDataFrame([(f"aa bb k{i} l{i}",) for i in range(300)], "text string")
    apart = spark.createDataFrame([(i, f"aa bb u{i} v{i}") for i in range(300)], "id int, text string")
    assert D.fuzzy_candidates(apart, many, "id", 0.6).count() == 0
    assert D.fuzzy_candidates(many.withColumn("id", F.monotonically_increasing_id()), many, "id", 0.6).select("id").distinct().count() == 300
