"""Values made once for each distinct text."""

from pyspark.sql import functions as F

from reqlens import lexicon as L
from reqlens.functions import score as S, text as X
from reqlens.lineage import once_each, stage
from reqlens.operators import verify

TEXTS = [
    ("Система не должна аварийно завершаться", "процессор intel, Docker и angular"), ("система должна продолжать работу", "написано на typescript"), (None, "не должно превышать 5 секунд"),
    ("не должно превышать 7 секунд", None), ("разграничение доступа", "внедрение кода"), ("Система не должна аварийно завершаться", "система должна продолжать работу"),
]


def pairs(spark):
    return stage(spark.createDataFrame([(i, *t) for i, t in enumerate(TEXTS * 2)], "id int, a string, b string"))


def test_once_each_looks_up_or_makes_in_place(spark):
    rows = pairs(spark)
    make = lambda x: F.struct(F.upper(X.text_of(x)).alias("up"), F.length(x).alias("n"))
    want = sorted(map(tuple, rows.withColumn("x", make(F.col("a"))).withColumn("y", make(F.col("b"))).collect()))
    looked_up = once_each(rows, {"x": ["a"], "y": ["b"]}, make)
    assert looked_up._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 2
    for out in (looked_up, once_each(rows, {"x": ["a"], "y": ["b"]}, make, few=3), once_each(rows, {"x": ["a"], "y": ["b"]}, make, few_bytes=20)):
        assert out.columns == ["id", "a", "b", "x", "y"]
        assert sorted(map(tuple, out.collect())) == want


def test_text_signals_are_made_for_texts_not_for_pairs(spark):
    texts = spark.createDataFrame([("COVERED", 0.9, [], "pmi", "functional", *t) for t in TEXTS], "label string, confidence double, missing_aspects array<string>, role string, req_type string, req_text string, unit_text string")
    sides = {f"{s}_{k}": v for s in ("req", "unit") for k, v in (("norm", X.normalize(F.col(f"{s}_text"))), ("tokens", X.tokens(F.col(f"{s}_text"))), ("entities", X.strings([])), ("constraints", F.array().cast("array<struct<kind:string,operator:string,value:double,unit:string>>")))}
    out = verify.verify(stage(texts.withColumns(sides)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any(p[:30] in plan for _, p in L.TOPICS)  # no topic pattern is searched for in a pair


def test_signals_of_two_texts(spark):
    rows = pairs(spark).where("id < 6").withColumns({"r": verify.text_signals(F.col("a"), X.normalize(F.col("a"))), "u": verify.text_signals(F.col("b"), X.normalize(F.col("b")))})
    r, u = F.col("r"), F.col("u")
    got = rows.select("id", verify.same_outcome(r, u), r["bound"], u["bound"], u["tech"], verify.topic_mismatch(r["topics"], u["topics"])).orderBy("id").collect()
    assert [tuple(x)[1:] for x in got] == [
        (False, False, False, ["client_lang", "container"], None), (False, False, False, ["client_lang"], None), (False, False, True, [], None),
        (False, True, False, [], None), (False, False, False, [], None), (True, False, False, [], None),
    ]


def test_entities_as_bags_of_words(spark):
    row = spark.createDataFrame([(["REST api", "Angular", " b  a b", ""], ["api rest", "angular", "A b ", "c"])], "a array<string>, b array<string>")
    old = lambda x: F.array_distinct(F.transform(x, lambda e: F.array_join(F.array_sort(F.array_distinct(F.split(F.lower(e), r"(?U)\s+"))), " ")))
    a, b = F.col("a"), F.col("b")
    got = row.select(verify.entity_overlap(a, b), S.jaccard(old(a), old(b))).first()
    assert got[0] == got[1] > 0


def test_features_are_made_for_texts_not_for_rows(spark, tmp_path):
    import __spark_entry__ as entry
    from reqlens import probes

    spark.createDataFrame([(i, i % 3 + 1) for i in range(200)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    out = entry.QUERIES["sentence_features"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "RLIKE" not in plan and "regexp" not in plan
    rows = {r["p_partkey"]: r.asDict() for r in out.collect()}
    assert len(rows) == 200
    own = probes.features(F.col("text"))
    names = ("modality", "subject", "kind", "title", "head_type", "entities")
    direct = probes.sentences(spark, str(tmp_path)).select("p_partkey", *[own[k].alias(k) for k in names], own["con"].alias("c")).collect()
    for r in direct:
        got = rows[r["p_partkey"]]
        assert all(got[k] == r[k] for k in names)
        assert got["con_value"] == (r["c"]["value"] if r["c"] else None)
