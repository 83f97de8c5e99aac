"""Operators over large tables against plain versions: bands, differences, reach, cycles, chains, merges."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from stepframe.operators import classify, differences, graphs, intervals, lineage, marts, steps
from stepframe.operators import keywords as keywords_
from stepframe.sources import records
from stepframe.sources.library import Libraries


def test_band_lookup(spark):
    r = random.Random(1)
    bands = [(i, r.choice([None, r.randint(-20, 60)]) if i % 9 == 0 else r.randint(-20, 60), None if i % 11 == 0 else r.randint(-20, 70), "x") for i in range(120)]
    rows = [(i, r.choice([None, float(r.randint(-25, 75)), r.random() * 50]), "y") for i in range(400)]
    b = spark.createDataFrame(bands, "band int, low int, high int, p string")
    df = spark.createDataFrame(rows, "id int, v double, at string")
    out = intervals.band_lookup(df, "v", b)
    assert out.columns == ["id", "v", "at", "band", "low", "high", "p"]
    got = sorted(((x.id, x.band) for x in out.collect()), key=str)
    want = []
    for i, v, _ in rows:
        hit = [k for k, lo, hi, _ in bands if v is not None and (lo is None or lo <= v) and (hi is None or v < hi) and (lo is None or hi is None or lo < hi)]
        want += [(i, k) for k in hit] or [(i, None)]
    assert got == sorted(want, key=str)
    plan = out._jdf.queryExecution().explainString(out._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "CartesianProduct" not in plan
    assert intervals.band_lookup(df.limit(0), "v", b).count() == 0 and intervals.band_lookup(df, "v", b.limit(0)).where("band is null").count() == 400


def test_differences_where_most_nodes_differ(spark, monkeypatch):
    """Two nodes, both unequal: still only rows of the keys that differ are given, sent or joined."""
    monkeypatch.setattr(differences, "BITS", (1,))
    l = spark.range(3000).selectExpr("id as a", "id % 7 as v")
    r = l.where("a <> 9").withColumn("v", F.when(F.col("a") % 500 == 1, -1).otherwise(F.col("v")))
    for most in (1_000_000, 2):
        monkeypatch.setattr(differences, "MOST_SENT", most, raising=False)
        _, a, b = differences.unequal_parts(l, r, ["a"], ["a", "v"])
        assert (a.count(), b.count()) == (7, 6)
        assert sorted(tuple(x) for x in differences.differences(l, r, ["a"]).collect()) == [(1, "changed", "v"), (9, "left only", ""), *[(k, "changed", "v") for k in range(501, 3000, 500)]]


def test_reconcile_counts_one_partition_in_many_tasks(spark):
    """Profiles of a table of one partition are summed in as many tasks as a shuffle has."""
    from stepframe.operators import profile

    one = spark.range(0, 500, 1, 1).selectExpr("id as a", "concat('t', id) as b")
    checks = profile.reconcile("t", one, one)
    assert checks.where("not passed").count() == 0
    plan = checks._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Repartition(?:ByExpression)? .*", plan)) >= 2


def test_band_summary(spark):
    """Numbers and least bands without a row for each match: 4,000 values in 4,000 bands that all hold them are 16 million."""
    r = random.Random(2)
    bands = [(None if i % 17 == 0 else i, r.choice([None, r.randint(-20, 60)]), None if i % 11 == 0 else r.randint(-20, 70)) for i in range(150)]
    values = [(i, r.choice([None, float(r.randint(-25, 75)), r.random() * 50])) for i in range(300)]
    got = {x.id: (x.n_bands, x.first_band) for x in intervals.band_summary(spark.createDataFrame(values, "id int, v double"), "v", spark.createDataFrame(bands, "band int, low int, high int"), "band").collect()}
    for i, v in values:
        hit = [k for k, lo, hi in bands if k is not None and v is not None and (lo is None or lo <= v) and (hi is None or v < hi) and (lo is None or hi is None or lo < hi)]
        assert got[i] == (len(hit), min(hit, default=None))
    many = intervals.band_summary(spark.range(4000).selectExpr("id % 7 + 0.5 as v"), "v", spark.range(4000).selectExpr("id as band", "-id as low", "id + 8 as high"), "band")
    assert [tuple(x) for x in many.select("n_bands", "first_band").distinct().collect()] == [(4000, 0)]
    none = spark.createDataFrame([], "band int, low int, high int")
    assert [tuple(x) for x in intervals.band_summary(spark.range(3).selectExpr("id as v"), "v", none, "band").select("n_bands", "first_band").distinct().collect()] == [(0, None)]


def test_differences(spark):
    cols = "a int, b string, v double, w string"
    left = [(i, f"k{i % 7}", i / 3, None if i % 5 == 0 else "w") for i in range(300)] + [(None, "n", 1.0, "w"), (500, "r", 1.0, "w"), (500, "r", 1.0, "w"), (501, "r", 1.0, "w"), (501, "r", 2.0, "w")]
    right = [x for x in left if x[0] != 17] + [(900, "new", None, None)]
    right = [(a, b, (v or 0) + 1 if a == 20 else v, "changed" if a in (20, 30) else w) for a, b, v, w in right]
    right.remove((500, "r", 1.0, "w"))
    l, r = spark.createDataFrame(left, cols), spark.createDataFrame(right, cols)
    got = {(x.a, x.b): (x.kind, x["columns"]) for x in differences.differences(l, r.withColumn("more", F.lit(1)), ["a", "b"]).collect()}
    assert got == {(17, "k3"): ("left only", ""), (900, "new"): ("right only", ""), (20, "k6"): ("changed", "v,w"), (30, "k2"): ("changed", "w"), (500, "r"): ("repeated", "")}
    assert differences.differences(l, l.repartition(7), ["a", "b"]).count() == 0
    _, a, b = differences.unequal_parts(l, r, ["a", "b"], l.columns)
    assert a.count() < 20 and b.count() < 20
    assert differences.differences(l.limit(0), l.limit(0), ["a", "b"]).count() == 0 and differences.differences(l.limit(0), l, ["a", "b"]).where("kind = 'right only'").count() == 303


def test_programs_of_one_file_are_read_by_many_tasks(spark):
    rows = spark.range(0, 400, 1, 1).selectExpr("concat('p', id) as program", "concat('data out.t', id, '; set stg.a; run;') as text")
    found = lineage.facts_of(rows)
    assert found.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1
    assert found.where("fact in ('READ', 'WRITE')").count() == 800


def test_upstream_of_a_hub(spark):
    """All targets read one table: no join pairs what reaches a hub with all that the hub leads to."""
    rows = [x for i in range(300) for x in (("hub", f"p{i}", "READS", "HIGH", "text"), (f"p{i}", f"t{i}", "WRITES", "HIGH", "text"))]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, relationship string, confidence string, evidence string")
    out = lineage.upstream(edges, edges.where("relationship = 'WRITES'").select("target_id"))
    assert sorted((x.target_id, x.upstream_id, x.depth) for x in out.collect()) == sorted(x for i in range(300) for x in ((f"t{i}", f"p{i}", 1), (f"t{i}", "hub", 2)))
    joins = re.findall(r"Join Inner, (.*)", out._jdf.queryExecution().optimizedPlan().toString())
    assert joins and all("target_id" in x for x in joins if "upstream_id" in x)


def plain_reach(edges, start):
    depth, front, d = {start: 0}, [start], 0
    while front:
        d += 1
        front = sorted({v for u, v in edges if u in front and v not in depth})
        depth |= {v: d for v in front}
    return depth


def random_edges(seed, n, m):
    r = random.Random(seed)
    return sorted({(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)})


@pytest.mark.parametrize("n, m", [(12, 18), (30, 36), (9, 30)])
def test_reach(spark, n, m):
    edges = random_edges(n, n, m)
    df = spark.createDataFrame(edges, "u string, v string")
    got = defaultdict(dict)
    for x in graphs.reach(df, df.select(F.col("u").alias("start"))).collect():
        got[x.start][x.node] = x.depth
    assert got == {u: plain_reach(edges, u) for u, _ in edges}


def test_reach_of_a_long_chain(spark):
    n = 5000
    chain = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    count, keep = [0], graphs.Scratch.keep

    def counted(self, df):
        count[0] += 1
        return keep(self, df)

    graphs.Scratch.keep = counted
    try:
        got = graphs.reach(chain, spark.range(1).select(F.col("id").alias("start")))
        assert got.where("depth = node").count() == n + 1
    finally:
        graphs.Scratch.keep = keep
    assert count[0] <= 2 * 15


@pytest.mark.parametrize("n, m", [(12, 18), (25, 40), (8, 24), (10, 7)])
def test_cycles_and_chains(spark, n, m):
    edges = random_edges(n + 100, n, m)
    nodes = sorted({x for e in edges for x in e})
    reached = {u: set(plain_reach(edges, u)) for u in nodes}
    root = {u: min(v for v in nodes if v in reached[u] and u in reached[v]) for u in nodes}
    size = {u: sum(root[v] == root[u] for v in nodes) for u in nodes}
    df = spark.createDataFrame(edges, "u string, v string")
    assert {x.node: x.root for x in graphs.cycles(df).collect()} == {u: root[u] for u in nodes if size[u] > 1}

    def length(c, seen=()):
        before = {root[u] for u, v in edges if root[v] == c and root[u] != c}
        return size[c] + max((length(b) for b in before), default=0)

    got = graphs.longest_chains(df, spark.createDataFrame([(u,) for u in [*nodes, "alone"]], "node string")).collect()
    assert {x.node: (x.length, x.root, x["size"]) for x in got} == {u: (length(root[u]), root[u], size[u]) for u in nodes} | {"alone": (1, "alone", 1)}


def test_contraction_changes_no_result(spark, monkeypatch):
    """Long paths, closed and open, with random edges among some of their nodes."""
    edges = sorted({*random_edges(12, 12, 13), *((f"p{i:02}", f"p{i + 1:02}") for i in range(25)), *((f"c{i}", f"c{(i + 1) % 7}") for i in range(7)), ("p03", "n1"), ("n2", "p09"), ("c2", "p20")})
    df = spark.createDataFrame(edges, "u string, v string")
    nodes = df.select(F.col("u").alias("node")).union(df.select("v"))
    starts = spark.createDataFrame([("p00",), ("n1",), ("c4",), ("none",)], "start string")

    def results():
        return [sorted(tuple(x) for x in t.collect()) for t in (graphs.reach(df, starts), graphs.cycles(df), graphs.longest_chains(df, nodes))]

    plain = results()
    monkeypatch.setattr(graphs, "FEW", 0)
    assert results() == plain


def kept_rows(monkeypatch, work):
    total, keep = [0], graphs.Scratch.keep

    def counted(self, df):
        out = keep(self, df)
        total[0] += out[1]
        return out

    monkeypatch.setattr(graphs.Scratch, "keep", counted)
    work()
    monkeypatch.setattr(graphs.Scratch, "keep", keep)
    return total[0]


def test_rows_written_for_a_long_chain_follow_its_links(spark, monkeypatch):
    """Doubling alone writes each link again for each of log2 n rounds: over 17 rows a node."""
    monkeypatch.setattr(graphs, "FEW", 500, raising=False)
    n = 6_000
    chain = spark.range(n).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = []
    rows = kept_rows(monkeypatch, lambda: got.append(graphs.reach(chain, spark.range(1).select(F.col("id").alias("start"))).where("depth = node").count()))
    assert got == [n + 1] and rows < 10 * n


def test_rows_written_for_chains_and_cycles_follow_their_links(spark, monkeypatch):
    """40 nodes each, a third closed: a round for each link wrote over 50 rows a node."""
    monkeypatch.setattr(graphs, "FEW", 500, raising=False)
    n = 6_000
    at = spark.range(n).where("id % 40 < 39 or id % 120 < 40")
    chains = at.selectExpr("id as u", "if(id % 40 = 39, id - 39, id + 1) as v")
    got = []
    rows = kept_rows(monkeypatch, lambda: got.append(graphs.longest_chains(chains, spark.range(n).toDF("node")).where("if(node % 120 < 40, length = 40 and size = 40 and root = node - node % 40, length = node % 40 + 1 and size = 1 and root = node)").count()))
    assert got == [n] and rows < 25 * n


def plain_merge(left, right):
    out = []
    for k in sorted({r[0] for r in left + right}, key=str):
        a, b = [r for r in left if r[0] == k], [r for r in right if r[0] == k]
        for p in range(max(len(a), len(b))):
            x, y = a[min(p, len(a) - 1)] if a else None, b[min(p, len(b) - 1)] if b else None
            both = y[1] if y and p < len(b) else x[1] if x and p < len(a) else (y or x)[1]
            out.append((k, both, x and x[2], y and y[2], int(bool(a)), int(bool(b))))
    return sorted(out, key=str)


def test_merge_by_position(spark):
    left = [(1, "a1", 1), (1, "a2", 2), (2, "b1", 3), (3, "c1", 4), (3, "c2", 5), (None, "n1", 6), (None, "n2", 7), (5, "only", 8)]
    right = [(1, "A1", 1), (2, "B1", 2), (2, "B2", 3), (2, None, 4), (3, "C1", 5), (3, "C2", 6), (None, "N1", 7), (4, "only", 8)]
    got = steps.merge(spark.createDataFrame(left, "k int, both string, x int"), spark.createDataFrame(right, "k int, both string, y int"), ["k"], ["x"], ["y"], "in_l", "in_r")
    assert got.columns == ["k", "both", "x", "y", "in_l", "in_r"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_merge(left, right)


def test_merge_of_one_large_key(spark):
    a, b = (spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias(c)) for n, c in ((20_000, "x"), (30_000, "y")))
    got = steps.merge(a, b, ["k"])
    assert got.count() == 30_000 and got.where("x = least(y, 19999)").count() == 30_000


def plain_hits(text, keywords):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    return {k: n for k in keywords if (n := sum(w.startswith(k) if len(k) >= 5 else w in (k, k + "s") for w in words))}


def test_keyword_hits_do_not_repeat_texts(spark):
    """200 texts of 80 kB that have 150 keywords each: repeated for each hit they would take 2.4 GB in one batch."""
    keys = spark.range(150).selectExpr("concat('keyword', id + 100) as keyword")
    text = F.concat(F.lit(" ".join(f"keyword{i + 100}" for i in range(150))), F.repeat(F.lit(" other"), 13_000))
    out = keywords_.keyword_hits(spark.range(0, 200, 1, 1).select("id", text.alias("text")), "text", keys)
    assert [tuple(x) for x in out.groupBy("hits").agg(F.count("*"), F.countDistinct("id", "keyword")).collect()] == [(1, 30_000, 30_000)]


def test_keyword_hits(spark):
    r = random.Random(3)
    keywords = ["card", "cards", "loan", "payment", "pay", "pd", "delinq", "a1b2c", "loans"]
    texts = [None, "", "Card cards CARDS loanss loans", "payments prepayment payment-pays", *[" ".join(r.choice(["pd", "pds", "delinquency", "x", "é", "a1b2c3", "loan"]) for _ in range(30)) for _ in range(40)]]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("hits", F.lit("clash"))
    got = defaultdict(dict)
    for x in keywords_.keyword_hits(df, "text", spark.createDataFrame([(k,) for k in [*keywords, None, "two words", "LOAN"]], "keyword string")).collect():
        got[x.id][x.keyword] = x.hits
    assert got == {i: h for i, t in enumerate(texts) if (h := plain_hits(t, keywords))}
    assert keywords_.keyword_hits(df, "text", df.limit(0).select(F.col("text").alias("keyword"))).collect() == []


def test_rule_texts(spark):
    df = spark.createDataFrame([(1, 0, "a_report", ["REG"], None), (2, 3, "x", [], 1.5), (None, None, None, None, None)], "n int, m int, program string, procs array<string>, v double")
    cases = {
        "n >= 1 and m == 0": [True, False, False], "not (n == 1 or m > 2)": [False, False, True], "n": [True, True, False], "m or v": [False, True, False],
        "uses('models')": [True, False, False], "name_matches(r'REPORT|rpt')": [True, False, False], "True": [True] * 3, "program == 'x'": [False, True, False], "v < 2": [True, True, True], "v != 1.5": [True, False, True],
    }
    for text, want in cases.items():
        assert [r[0] for r in df.select(classify.parse_rule(text, {"models": ["REG", "GLM"]}).column()).collect()] == want, text
    typed = classify.AnyOf((classify.AllOf((classify.Test("n", "ge", 1), classify.Test("m", "lt", 2))), classify.Not(classify.Test("v", "eq", 1.5))))
    assert classify.parse_rule("n >= 1 and m < 2 or not v == 1.5") == typed
    for bad in ("n >", "n >= 1 and", "__import__('os')", "n >= m", "uses('none')", "(n", "n ; m"):
        with pytest.raises(ValueError):
            classify.parse_rule(bad)


FIELDS = [records.Field("k"), records.Field("name", True, 7), records.Field("d", informat="yymmdd"), records.Field("v", informat="comma"), records.Field("c", True)]


def test_records_byte_by_byte(spark, tmp_path):
    lines = ["k,name,d,v,c", '1,Ève Bé,2024-01-02,"1,234.5",x', '2,"a ""q"", b",2024-13-02,$7,', "3,é", ',"  pad  ",,x, y ,more,cells', "4,ok,2020-02-29,.5,\xa0"]
    (tmp_path / "a.csv").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.csv").write_bytes(b"k,name,d,v,c\r\n5,\xe9t\xe9,1999-12-31,2,\xff\r\n")
    rows = {r.k: r for r in records.read_records(spark, f"{tmp_path}/*.csv", FIELDS).collect()}
    assert (rows[1].name, rows[1].v, str(rows[1].d)) == ("Ève B�", 1234.5, "2024-01-02")
    assert (rows[2].name, rows[2].d, rows[2].v, rows[2].c) == ('a "q",', None, 7.0, None)
    assert (rows[3].name, rows[3].d, rows[3].c) == ("é", None, None) and (rows[None].name, rows[None].c) == ("  pad", " y")
    assert rows[5].name == "�t�" and rows[5].c == "�"
    latin = {r.k: r for r in records.read_records(spark, f"{tmp_path}/b.csv", FIELDS, encoding="latin1").collect()}
    assert latin[5].name == "été" and latin[5].c == "ÿ"
    assert records.read_records(spark, f"{tmp_path}/a.csv", FIELDS, header=False).count() == 6
    with pytest.raises(ValueError):
        records.read_records(spark, f"{tmp_path}/a.csv", FIELDS, encoding="ebcdic")


def test_records_are_split(spark, tmp_path):
    rows = spark.range(20_000).select("id", F.concat(F.lit("é,"), F.col("id").cast("string")).alias("name"))
    records.write_records(rows.coalesce(1), f"{tmp_path}/t")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = records.read_records(spark, f"{tmp_path}/t", [records.Field("id"), records.Field("name", True)])
        assert df.rdd.getNumPartitions() > 5
        assert df.where("name = concat('é,', cast(cast(id as long) as string))").count() == 20_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_manifest(spark, tmp_path):
    path = f"{tmp_path}/t"
    records.write_with_manifest(spark.createDataFrame([("a", 1.0)], "name string, v double"), path, {"name": {"label": "Nom", "width": 60}})
    df, found = records.read_with_manifest(spark, path)
    assert found == {"name": {"type": "string", "label": "Nom", "width": 60}, "v": {"type": "double"}}
    assert df.schema["name"].metadata == {"label": "Nom", "width": 60} and df.count() == 1
    with pytest.raises(Exception, match="broken"):
        records.write_with_manifest(spark.range(3).select(F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("v")), path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_with_manifest(spark, path)


def test_measures(spark):
    s = spark.createDataFrame([("m", "VALIDATED"), ("m", "MANUAL_REVIEW"), ("n", "FAILED")], "method string, final_status string")
    c = spark.createDataFrame([("m", "planted_a", 1, 1), ("m", "planted_b", 0, 1), ("m", "x", 1, 0), ("n", "planted_c", 0, 1)], "method string, check string, passed int, planted int")
    a = spark.createDataFrame([("m", 0.5), ("m", None)], "method string, cost_usd double")
    g = spark.createDataFrame([(1, 1), (0, 0)], "passed int, expected_to_pass int")
    f, p = spark.createDataFrame([(0.25,), (None,)], "abs_diff double"), spark.createDataFrame([(1,), (0,)], "delinquent_flag int")
    by = {r.method: r for r in marts.measures(s, c, g, a, f, p, ["method"]).collect()}
    assert (by["m"].validated, by["m"].validation_rate, round(by["m"].checks_passed_rate, 6), by["m"].migration_checks_passed_rate, by["m"].conversion_cost, by["m"].max_forecast_diff, by["m"].late_payment_rate, by["m"].manual_review) == (1, 0.5, 0.666667, 1.0, 0.5, 0.25, 0.5, 1)
    assert by["m"].traps_passed_rate == pytest.approx(1 / 3) and by["n"].traps_passed_rate == 0.0 and by["n"].conversion_cost is None
    whole = marts.measures(s, c, g.limit(0), a.limit(0), f.limit(0), p.limit(0)).first()
    assert whole.validated == 1 and whole.migration_checks_passed_rate is None and whole.traps_passed_rate == pytest.approx(1 / 3)


def test_order_of_rows(spark):
    df = spark.createDataFrame([(3, "b"), (None, "z"), (1, "a"), (3, "a"), (2, None)], "v int, k string").repartition(4)
    assert [tuple(r) for r in steps.sort(df, ["v", "k"], ("k",)).collect()] == [(None, "z"), (1, "a"), (2, None), (3, "b"), (3, "a")]
    assert [tuple(r) for r in steps.first_rows(df, 2, [], [F.desc("v"), "k"]).orderBy("_n").collect()] == [(3, "a", 1), (3, "b", 2)]
    assert [(r.k, r["_n"]) for r in steps.first_rows(df, 1, ["v"], ["k"]).orderBy("v").collect()] == [("z", 1), ("a", 1), (None, 1), ("a", 1)]


def test_input_order_and_tables_by_key(spark, tmp_path):
    spark.createDataFrame([(i % 3, f"row {i}") for i in range(30)], "k int, t string").coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = steps.with_input_order(spark.read.parquet(f"{tmp_path}/t"))
    first = steps.first_of_key(rows, ["k"], ["_row"]).orderBy("k").collect()
    assert [r.t for r in first] == ["row 0", "row 1", "row 2"]
    lib = Libraries(spark, {"out": str(tmp_path)})
    lib.save_by("out.parts", rows.drop("_row"), "k")
    assert spark.read.parquet(f"{tmp_path}/parts/k=2").count() == 10 and lib.read("out.parts").count() == 30


def test_states_of_a_long_series_need_no_stretches(spark):
    """Last states come from sums, whatever the order of rows: no array grows row by row on the way."""
    from stepframe.functions import stats

    r = random.Random(5)
    ys = {"a": [r.random() * 50 for _ in range(3000)], "b": [7.5], None: [r.random() for _ in range(40)]}
    rows = spark.createDataFrame([(k, t, y) for k, v in ys.items() for t, y in enumerate(v)], "k string, t int, y double").repartition(5)
    states = stats.brown(rows, "t", "y", ["k"]).states
    got = {x.k: x for x in states.collect()}
    for k, v in ys.items():
        first = v[:12]
        mt, my = (len(first) + 1) / 2, sum(first) / len(first)
        stt = sum((t + 1 - mt) ** 2 for t in range(len(first)))
        slope = sum((t + 1 - mt) * (y - my) for t, y in enumerate(first)) / stt if stt else 0
        level = my - slope * mt
        s1, s2 = level - 4 * slope, level - 8 * slope
        for y in v:
            s1 = 0.2 * y + 0.8 * s1
            s2 = 0.2 * s1 + 0.8 * s2
        assert got[k].last == len(v) - 1 and got[k].s1 == pytest.approx(s1) and got[k].s2 == pytest.approx(s2) and got[k].constant == pytest.approx(2 * s1 - s2)
    assert "array_append" not in states._jdf.queryExecution().optimizedPlan().toString()
