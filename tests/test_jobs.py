"""The jobs: two runs over growing input, runs that were lost, reruns for some periods, odd rows."""

import datetime as dt
import json
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import period_marts, text_migration

ROOT = Path(__file__).resolve().parents[1]
DOCS = "doc_id long, text string, lang string, source string, extra string"
SETTINGS = {"columns": "doc_id long, text string, lang string, source string", "width_columns": {"text": 7, "source": 4}, "files_per_batch": 1}


def add(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")


def stored(spark, target):
    return {r.doc_id: r for r in text_migration.rows_of(spark, target, SETTINGS).collect()}


def test_only_new_files_are_taken(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    add(spark, source, [(1, "Ève Bé ", "fr", "a", "x"), (2, None, "fr", None, "x")])
    assert text_migration.run(spark, source, target, SETTINGS) == {"batches": 1, "rows": 2}
    assert text_migration.run(spark, source, target, SETTINGS) == {"batches": 0, "rows": 0}
    before = stored(spark, target)
    add(spark, source, [(3, "  ", "", "wide source", "x"), (4, "plain", "en", "b", "x"), (4, "plain", "en", "b", "x")])
    add(spark, source, [(5, "1234567é", None, "b", None)])
    assert text_migration.run(spark, source, target, SETTINGS) == {"batches": 2, "rows": 4}
    assert text_migration.run(spark, source, target, SETTINGS) == {"batches": 0, "rows": 0}
    after = stored(spark, target)
    assert {k: after[k] for k in before} == before and sorted(after) == [1, 2, 3, 4, 5]
    assert (after[1].text, after[1].n_chars, after[1].n_bytes, after[1].text_wide, after[1].text_split) == ("Ève Bé", 6, 8, 1, 1)
    assert (after[2].text, after[2].n_bytes, after[2].text_wide, after[2].source_wide) == (None, 0, 0, 0)
    assert (after[3].text, after[3].lang, after[3].source_wide, after[3].source_split) == (None, None, 1, 0)
    assert (after[5].text_wide, after[5].text_split) == (1, 0)
    assert text_migration.rows_of(spark, target, SETTINGS).where("doc_id = 4").count() == 2
    proofs = spark.read.parquet(f"{target}/proofs")
    assert proofs.where("not passed").count() == 0 and proofs.agg(F.sum("n_rows")).first()[0] == 6


def test_a_lost_batch_is_done_again_without_doubling(spark, tmp_path, monkeypatch):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    add(spark, source, [(i, f"text {i}", "en", "a", "x") for i in range(20)])
    proved = text_migration._proved
    monkeypatch.setattr(text_migration, "_proved", lambda *a: proved(*a).withColumn("passed", F.lit(False)))
    with pytest.raises(Exception, match="differs from what was read"):
        text_migration.run(spark, source, target, SETTINGS)
    assert len(stored(spark, target)) == 20
    monkeypatch.setattr(text_migration, "_proved", proved)
    assert text_migration.run(spark, source, target, SETTINGS) == {"batches": 1, "rows": 20}
    assert text_migration.rows_of(spark, target, SETTINGS).count() == 20


def test_proof_sees_a_changed_row(spark):
    rows = spark.createDataFrame([(1, "a", "en", "s"), (2, "b", "en", "s"), (3, "c", None, "s")], "doc_id long, text string, lang string, source string")
    made = text_migration.migrated(rows, {"text": 5})
    same = text_migration._proved(made, text_migration._totals(made, {"text": 5}), {"text": 5})
    assert same.where("passed").count() == 2
    changed = text_migration.migrated(rows.withColumn("text", F.when(F.col("doc_id") == 2, "x").otherwise(F.col("text"))), {"text": 5})
    assert text_migration._proved(changed, text_migration._totals(made, {"text": 5}), {"text": 5}).where("not passed").first().lang == "en"
    lost = text_migration._proved(made.where("lang is not null"), text_migration._totals(made, {"text": 5}), {"text": 5})
    assert [(r.lang, r.rows_read) for r in lost.where("not passed").collect()] == [(None, 1)]


def test_text_migration_sql(spark, tmp_path):
    rows = [(i, t, lang, "source of many letters" if i % 2 else "é" * 7, "x") for i, (t, lang) in enumerate([("a" * 1999 + "é", "fr"), ("a" * 2000 + "é", "fr"), (None, None), ("", "en"), ("x |y  ", "en")])]
    add(spark, str(tmp_path), rows)
    df = text_migration.job1_text_migration(spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(db.sql(f"SELECT {', '.join(df.columns)} FROM ({text_migration.JOB1_SQL})").fetchall())


def test_command_line(spark, tmp_path):
    source, target, config = f"{tmp_path}/in", f"{tmp_path}/out", tmp_path / "c.json"
    add(spark, source, [(1, "some text", "en", "a", "x")])
    config.write_text(json.dumps(SETTINGS))
    command = [sys.executable, "-m", "jobs.text_migration", "--input", source, "--output", target, "--config", str(config)]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "read 1 rows" in done.stderr
    assert stored(spark, target)[1].text_wide == 1


DAY = dt.datetime
ORDERS = [(1, 1, DAY(2020, 1, 5), 100.5), (2, 1, DAY(2020, 1, 9), 300000.0), (3, 2, DAY(2020, 2, 1), 10.0), (4, 99, DAY(2020, 2, 2), 20.0), (5, None, None, None)]
LINES = [(1, 1, DAY(2020, 1, 6), 1, 1, 5.0), (1, 1, DAY(2020, 1, 7), 1, 1, 50.0), (1, 2, DAY(2020, 1, 6), 1, 1, 7.0), (3, 1, None, None, None, None)]


def tables(spark, folder, orders=ORDERS, lines=LINES):
    mode = "overwrite"
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double").write.mode(mode).parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp_ntz, l_partkey long, l_suppkey long, l_quantity double").write.mode(mode).parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, "A", None), (2, "B", 6000.0)], "c_custkey long, c_mktsegment string, c_acctbal double").write.mode(mode).parquet(f"{folder}/customer.parquet")


def summary(spark, target):
    rows = period_marts.read(spark, target, "summary").collect()
    return sorted(((r.period_id, r.segment, r.band, r.n_orders, r.n_without_lines, r.n_high, float(r.total), float(r.quantity), float(r.largest)) for r in rows), key=str)


def test_period_marts(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    tables(spark, source)
    wrote = period_marts.run(spark, source, target)
    assert wrote["status"] == 5
    want = [("000000", None, "LOW", 1, 1, 0, 0.0, 0.0, 0.0), ("202001", "A", "LOW", 2, 1, 1, 300100.5, 12.0, 7.0), ("202002", "B", "HIGH", 1, 0, 0, 10.0, 0.0, 0.0), ("202002", None, "LOW", 1, 1, 0, 20.0, 0.0, 0.0)]
    assert summary(spark, target) == sorted(want, key=str)
    assert period_marts.run(spark, source, target) == wrote
    assert summary(spark, target) == sorted(want, key=str)
    assert period_marts.read(spark, target, "checks").where("passed").count() == 2

    # A run for some periods replaces these, takes away one that has no rows any more, and leaves the others.
    tables(spark, source, [(1, 1, DAY(2020, 1, 5), 7.0), (2, 1, DAY(2020, 3, 9), 8.0)])
    period_marts.run(spark, source, target, period_marts.default_settings("period_marts") | {"periods": ["202002", "202003"]})
    assert [(r[0], r[6]) for r in summary(spark, target)] == [("000000", 0.0), ("202001", 300100.5), ("202003", 8.0)]

    # A run for all leaves only what the source has.
    period_marts.run(spark, source, target)
    assert [(r[0], r[6]) for r in summary(spark, target)] == [("202001", 7.0), ("202003", 8.0)]


def test_period_marts_forecast_and_empty(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    tables(spark, source, [(m, 1, DAY(2020 + m // 12, m % 12 + 1, 3), 5.0 + 3 * m) for m in range(24)])
    period_marts.run(spark, source, target)
    ahead = period_marts.read(spark, target, "forecast").where("_type_ = 'FORECAST' and _lead_ > 1").orderBy("_lead_").collect()
    assert [round(r.y, 6) for r in ahead] == [5.0 + 3 * m for m in range(25, 36)] and ahead[0].month == dt.date(2022, 2, 1)
    tables(spark, source, [], [])
    assert set(period_marts.run(spark, source, target).values()) == {0}


def test_period_marts_sql(spark, tmp_path):
    tables(spark, str(tmp_path), [o for o in ORDERS if o[2]], LINES)
    df = period_marts.job2_period_marts(spark, str(tmp_path))
    db = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        db.sql(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, db.sql(f"SELECT {', '.join(df.columns)} FROM ({period_marts.JOB2_SQL})").fetchall()))


def test_period_marts_deals_lines_once_and_writes_a_period_together(spark, tmp_path):
    source, target = f"{tmp_path}/in", f"{tmp_path}/out"
    tables(spark, source, [(i, 1, DAY(2020, 1 + i % 3, 3), 5.0) for i in range(90)], [(i % 90, i % 4, DAY(2020, 1, 6), i, 1, float(i)) for i in range(600)])
    read = [spark.read.parquet(f"{source}/{t}.parquet") for t in ("orders", "lineitem", "customer")]
    plan = period_marts.order_status(*read, period_marts.default_settings("period_marts"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(l_orderkey#") == 1
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        period_marts.run(spark, source, target)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    files = spark.read.parquet(f"{target}/status").select("period_id", F.input_file_name().alias("file")).groupBy("period_id").agg(F.countDistinct("file").alias("n"), F.count("*").alias("rows")).collect()
    assert [(r.n, r.rows) for r in files] == [(1, 30)] * 3
