"""Nulls, empty and long texts, ties, repeats, empty tables and clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

from gridloom.llm import htmltext, langid, lmscore, mixing, neardup, outliers, packing, quality, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, block string, _row int"
GOOD = "the quick brown fox jumps over the lazy dog and then sleeps in the warm sun all day "


def docs(spark, rows=None):
    rows = rows if rows is not None else [
        (1, GOOD * 9, "en", "a", 1, 0.5, "x", 1),
        (2, None, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 0.1, "y", 2),
        (4, "### $$$ %%%", "en", None, 11, 0.1, "y", 2),
        (5, GOOD * 2000, "de", "b", 5, 0.1, "y", 2),
        (6, "eins zwei", "de", "b", 5, 0.1, "y", 2),
        (7, GOOD * 9, "en", "a", 1, 0.5, "x", 1),
        (7, GOOD * 9, "en", "a", 1, 0.5, "x", 1),
        (None, "no id", "en", "a", 1, 0.5, "x", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def labels(spark, rows=None):
    return spark.createDataFrame(rows if rows is not None else [(1, 1, 0), (3, 0, 1), (3, 0, None), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int, score string".replace(", score string", ""))


def test_quality(spark):
    got = quality.op8(spark, docs(spark), labels(spark)).collect()
    assert len(got) == 9 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.op8(spark, docs(spark, []), labels(spark, [])).count() == 0
    kept = quality.score_quality(docs(spark), quality.RuleModel(0.0, [((("f_words", ">", 3.0),), 2.0)]), "mine")
    assert kept.columns == [*docs(spark).columns, "mine"] and kept.count() == 9


def test_toxicity(spark):
    got = toxicity.op1(spark, docs(spark), labels(spark)).collect()
    assert len(got) == 9 and all(r["score"] == 0 for r in got)
    assert toxicity.op1(spark, docs(spark, []), labels(spark, [])).count() == 0
    m = toxicity.Field(-6.0, 0.0, ((0.0, -2.0), (-1.0, -1.0)), {"=idiot": 14.0})
    out = toxicity.tag_toxicity(spark.createDataFrame([(1, "You İdiot, IDIOT!", 1)], "doc_id long, text string, toxicity int"), m, "t").first()
    assert [(s["start"], s["stop"]) for s in out["t"]["spans"]] == [(11, 16)] and out["toxicity"] == 1


def test_langid(spark):
    got = {r["doc_id"]: r for r in langid.op10(spark, docs(spark)).collect()}
    assert got[2]["lang_pred"] == "und" and got[3]["lang_pred"] == "und" and got[4]["lang_pred"] == "und" and got[2]["score"] == 0
    assert langid.op10(spark, docs(spark, [])).count() == 0


def test_outliers(spark):
    got = {r["doc_id"]: r for r in outliers.op3(spark, docs(spark)).collect()}
    assert len(got) == 8 and got[2]["n_words"] == 0 and got[2]["base_failed"] and not got[2]["kept"]
    assert got[4]["n_symbols"] == 9 - 0 and got[4]["n_words"] == 3
    assert outliers.op3(spark, docs(spark, [])).count() == 0


def test_lmscore(spark):
    got = {r["doc_id"]: r for r in lmscore.op4(spark, docs(spark), labels(spark)).collect()}
    assert len(got) == 8 and got[2]["n_tokens"] == 0 and got[2]["ce_diff"] is None and got[4]["ce_diff"] is None
    assert lmscore.op4(spark, docs(spark, []), labels(spark, [])).count() == 0


def test_packing(spark):
    got = packing.op5(spark, docs(spark)).collect()
    by = {r["doc_id"]: r for r in got if r["doc_id"] in (2, 3)}
    assert by[2]["length"] == by[3]["length"] == by[2]["doc_tokens"] == 1
    assert packing.op5(spark, docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(spark), packing.tokenizer_path(), capacity=0)


def test_mixing(spark):
    got = mixing.mix(docs(spark))
    assert got.count() == 9 and got.columns[:8] == docs(spark).columns and got.select("mix.position").distinct().count() == 9
    assert mixing.op6(spark, docs(spark, [])).count() == 0


def test_neardup(spark):
    got = neardup.op7(spark, docs(spark)).collect()
    of = {r["doc_id"]: r["class_id"] for r in got}
    assert len(got) == 8 and of[1] == of[7] == 1 and all(of[i] == i for i in (2, 3, 4, 5, 6))
    d = docs(spark).withColumns({"_keep": F.lit(1), "id": F.lit(2), "root": F.lit(3), "key": F.lit(4)})
    kept = neardup.deduplicate(d)
    assert kept.columns == d.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]
    odd = d.withColumns({"row": F.lit(5), "place": F.lit(6), "a.b": F.create_map(F.lit(1), F.lit(2)), "doc_id": F.when(F.col("doc_id") != 7, F.col("doc_id"))}).unionByName(
        d.withColumns({"row": F.lit(5), "place": F.lit(6), "a.b": F.create_map(F.lit(1), F.lit(2))}))
    rows = neardup.deduplicate(odd).collect()  # every row twice, 1 three times more without an id
    assert list(rows[0].asDict()) == odd.columns and sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "3", "4", "5", "6", "None"]
    assert neardup.deduplicate(docs(spark, [])).count() == 0
    assert neardup.op7(spark, docs(spark, [])).count() == 0


def test_deduplicate_beyond_the_broadcast_bound(spark, monkeypatch):
    texts = ["one two three four five six", "one two three four five six", "quite other words stand in this one", None, ""]
    rows = [(i % 7 if i % 5 else None, texts[i % len(texts)], f"s{i % 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    order = lambda df: sorted(map(str, df.collect()))
    few = order(neardup.deduplicate(docs))
    monkeypatch.setattr(neardup, "BROADCAST_IDS", 0)
    assert few and order(neardup.deduplicate(docs)) == few


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (3, None, "<p>a &amp; b\n c<p>d", "x"), (3, None, "<p>a &amp; b\n c<p>d", "x")], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in htmltext.op9(spark, pages).collect()]
    assert sorted(got) == [(1, "", 0), (2, "", 0), (3, "a & b c d", 9), (3, "a & b c d", 9)]
    assert htmltext.op9(spark, pages.where("page_id < 0")).count() == 0


def test_topk(spark):
    rows = [(0, [1.0, 2.0], 1), (100, [0.5, -1.0], 1), (5, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (4, [1.0, 2.0], 1), (6, None, 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1), (9, [float("inf"), 1.0], 1), (10, [], 1), (11, [1.0], 1), (None, [1.0, 1.0], 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = topk.op2(spark, e).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 4), (0, 2, 5), (0, 3, 100), (100, 1, 0), (100, 2, 4), (100, 3, 5)]
    assert topk.op2(spark, e.where(F.lit(False))).count() == 0


def test_pipeline_stages_keep_rows_and_columns(spark, tmp_path):
    """Clashing names, nulls, empties, repeated rows and empty tables in every stage, by row counts."""
    import corpus_pipeline as cp

    sf = str(tmp_path)
    docs(spark).write.parquet(f"{sf}/documents.parquet")
    labels(spark).write.parquet(f"{sf}/labels.parquet")
    names = ["_quality", "quality", "_toxicity", "toxicity", "_mix", "mix", "lang_id", "row", "_row", "class_id", "place", "worker", "position"]
    d = docs(spark).drop("_row").withColumns({n: F.lit(i) for i, n in enumerate(names)})
    for (name, stage), n in zip(cp.STAGES, (9, 9, 7, 9, None), strict=True):
        got = stage(spark, d, sf)
        if n is not None:
            rows = got.collect()
            assert got.columns == d.columns and len(rows) == n, name
            assert all([r[c] for c in names] == list(range(len(names))) for r in rows), name
            empty = stage(spark, d.limit(0), sf)
            assert empty.columns == d.columns and empty.count() == 0, name
        else:
            p = got.toPandas()
            assert set(p["doc_id"].dropna()) == {1, 2, 3, 4, 5, 6, 7} and p["doc_id"].isna().sum() == 1
            assert stage(spark, d.limit(0), sf).count() == 0


def test_pipeline_stages_put_the_library_on_the_path_of_workers(spark, tmp_path):
    """A session that was started elsewhere, without this folder in PYTHONPATH, runs every stage called by itself."""
    import os
    import subprocess
    import sys

    import corpus_pipeline as cp

    sf, root = f"{tmp_path}/sf", os.path.dirname(os.path.abspath(cp.__file__))
    docs(spark).withColumn("lang", F.lit("en")).write.parquet(f"{sf}/documents.parquet")
    labels(spark).write.parquet(f"{sf}/labels.parquet")
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
import corpus_pipeline as cp
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name, stage in cp.STAGES:
    spark.sparkContext.environment.pop("PYTHONPATH", None)
    print(name, stage(spark, spark.read.parquet({sf!r} + "/documents.parquet"), {sf!r}).count(), sep=": ")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith("PYSPARK_GATEWAY")}
    done = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert [x.partition(": ")[0] for x in done.stdout.splitlines()] == [name for name, _ in cp.STAGES]


def test_own_columns_of_the_results_name_give_way(spark):
    d = docs(spark).withColumns({"toxicity": F.lit(1), "lang_id": F.lit(1), "mix": F.lit(1)})
    m = toxicity.Field(-6.0, 0.0, ((0.0, -2.0), (-1.0, -1.0)), {"=fox": 14.0})
    assert toxicity.tag_toxicity(d, m).select("toxicity.score").count() == 9
    assert langid.predict_langid(d, ["en"], __import__("numpy").zeros((1, langid.BUCKETS), "f4")).select("lang_id.lang").count() == 9
    assert mixing.mix(d).select("mix.position", "lang_id").count() == 9
    assert quality.score_quality(d, quality.RuleModel(0.0)).columns.count("score") == 1
