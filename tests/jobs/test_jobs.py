"""Both jobs: against SQL, over growing input, after a broken run, and from the command line."""

import json
import os
import shutil
import subprocess
import sys
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import queries, scene_products, stage_segments
from jobs.command import configured

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    order = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert sorted(want.columns) == cols and len(got) and order(got).equals(order(want))


def listed(df):
    return sorted(map(str, df.collect()))


def test_products_rerun_and_grow(spark, tmp_path):
    """A rerun changes nothing; more looks add strips; a setting that was there comes back."""
    vectors, out = spark.read.parquet(f"{SF}/embeddings.parquet"), f"{tmp_path}/out"
    c = scene_products.Config(side=8, strip=1, block=4)
    narrow = vectors.withColumn("embedding", F.slice("embedding", 1, 8))
    for n in (100, 100, 200):
        narrow.where(F.col("vec_id") < n).write.mode("overwrite").parquet(f"{tmp_path}/v")
        told = scene_products.run(spark, f"{tmp_path}/v", out, c)
        looks = -(-n // 16)
        assert told == {"vectors": n, "products": looks * 4, "health": looks}
        rows = listed(scene_products.read_products(spark, out))
        if n == 100:
            first = rows if not (tmp_path / "kept").exists() else first
            (tmp_path / "kept").touch()
            assert rows == first
    assert len(rows) == 13 * 4 and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    narrow.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/none")
    assert scene_products.run(spark, f"{tmp_path}/none", f"{tmp_path}/empty", c) == {"vectors": 0, "products": 0, "health": 0}


def drop(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(folder)


def layout(spark, out):
    return [tuple(r) for r in stage_segments.segments(spark, out).select("batch", "volume", "doc_id", "revision", "blocks", "lba", "payload").orderBy("volume", "lba").collect()]


def test_two_runs_over_growing_input(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    c = stage_segments.Config(volumes=2, block=4, first=1)
    drop(spark, src, [(0, "abcdefgh", "en"), (2, "", "en"), (4, "xyz", "en"), (1, "é", "fr"), (1, "é", "fr"), (None, "lost", "en"), (7, None, "de")])
    assert stage_segments.run(spark, src, out, c) == 1
    first = [(0, 0, 0, 1, 2, 1, "abcdefgh"), (0, 0, 2, 1, 1, 3, ""), (0, 0, 4, 1, 1, 4, "xyz"), (0, 1, 1, 1, 1, 1, "é")]
    assert layout(spark, out) == first
    assert stage_segments.run(spark, src, out, c) == 0 and layout(spark, out) == first
    drop(spark, src, [(4, "xyz", "en"), (4, "new words", "en"), (4, "again", "en"), (3, "three", "en")])
    assert stage_segments.run(spark, src, out, c) == 1
    both = layout(spark, out)
    assert [r for r in both if r[0] == 0] == first
    assert [r[1:6] for r in both if r[0] == 1] == [(0, 4, 2, 3, 5), (0, 4, 3, 2, 8), (1, 3, 1, 2, 2)] or [r[1:6] for r in both if r[0] == 1] == [(0, 4, 2, 2, 5), (0, 4, 3, 3, 7), (1, 3, 1, 2, 2)]
    told = {r["batch"]: (r["n_read"], r["staged"], r["known"], r["rejected"]) for r in stage_segments.journal(spark, out).collect()}
    assert told == {0: (7, 4, 1, 2), 1: (4, 3, 1, 0)}
    assert sorted(r["reason"] for r in spark.read.json(f"{out}/rejects").collect()) == ["no id", "no text"]
    for r in stage_segments.segments(spark, out).collect():
        assert r["crc"] == zlib.crc32(r["payload"].encode()) and len(r["name"]) == 32 and r["name"].startswith(f"seg_{r['doc_id']:010d} ")


def test_a_batch_that_broke_is_staged_again(spark, tmp_path, monkeypatch):
    src, out, c = f"{tmp_path}/in", f"{tmp_path}/out", stage_segments.Config(volumes=2)
    drop(spark, src, [(i, "w" * i, "en") for i in range(20)])
    stage_segments.run(spark, src, out, c)
    drop(spark, src, [(i, "v" * i, "en") for i in range(15, 40)])
    shutil.copytree(src, f"{tmp_path}/in2")
    shutil.copytree(out, f"{tmp_path}/out2")
    real = stage_segments.log.info

    def broken(*a):
        if str(a[0]).startswith("batch"):
            raise RuntimeError("lost")
        real(*a)

    monkeypatch.setattr(stage_segments.log, "info", broken)
    with pytest.raises(Exception, match="lost"):
        stage_segments.run(spark, src, out, c)
    monkeypatch.undo()
    assert stage_segments.run(spark, src, out, c) == 1
    whole = layout(spark, out)
    assert len(whole) == 45 and len({(r[1], r[5]) for r in whole}) == 45
    shutil.rmtree(f"{out}/journal/batch=1")  # as if it had ended before its journal: nothing of it counts
    assert len(layout(spark, out)) == 20


def test_one_hot_id_and_an_empty_table(spark, tmp_path):
    """A third of all rows has one id; its versions are numbered without a task that holds them all."""
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.range(600).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") + 10).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text")).write.parquet(src)
    stage_segments.run(spark, src, out, stage_segments.Config(volumes=1))
    got = stage_segments.segments(spark, out)
    assert sorted(r["revision"] for r in got.where("doc_id = 5").collect()) == list(range(1, 201))
    assert sorted(r["lba"] for r in got.collect()) == list(range(8, 608))
    spark.range(0).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(f"{tmp_path}/none")
    stage_segments.run(spark, f"{tmp_path}/none", f"{tmp_path}/out0")


def test_settings():
    assert configured(stage_segments.Config(), '{"volumes": 3}').volumes == 3
    with pytest.raises(ValueError):
        configured(stage_segments.Config(), '{"volume": 3}')
    for name, c in (("stage_segments", stage_segments.Config()), ("scene_products", scene_products.Config())):
        with open(f"{ROOT}/jobs/{name}.json") as f:
            assert configured(c, f.read()) == c and json.loads(json.dumps(vars(c))) == vars(c)


def test_command_line(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT}
    cmd = [sys.executable, "-m", "jobs.stage_segments", f"{SF}/documents.parquet", f"{tmp_path}/out", "--config", f"{ROOT}/jobs/stage_segments.json"]
    done = subprocess.run(cmd, env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "staged 200" in done.stderr, done.stderr[-2000:]
