"""Operators of the library on small frames: missing values, ties, boundaries, refusals, mutations."""

import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stepframe.functions import expr as E
from stepframe.functions import stats
from stepframe.functions.stats import brown, forecast_rows, forecast_states, kappa, ols
from stepframe.operators import classify, lineage, marts, procs, profile, steps
from stepframe.operators.order import placed
from stepframe.plans.translator import Session, Unsupported
from stepframe.sources.library import Libraries, listed, make_loans, parameter, read_delimited, read_runs, write_delimited


def test_missing_is_least(spark):
    df = spark.createDataFrame([(None, 1.0), (None, None), (1.0, None), (2.0, 1.0)], "a double, b double")
    rows = df.select(*[E.flag(E.compare(F.col("a"), op, F.col("b"))).alias(op) for op in ("lt", "le", "gt", "ge", "eq", "ne")]).collect()
    assert [tuple(r) for r in rows] == [(1, 1, 0, 0, 0, 1), (0, 1, 0, 1, 1, 0), (0, 0, 1, 1, 0, 1), (0, 0, 1, 1, 0, 1)]


def test_format_boundaries(spark):
    f = E.RangeFormat((E.Interval(None, 20000, "LOW", exclude_high=True), E.Interval(20000, 80000, "MID")), "UNKNOWN")
    df = spark.createDataFrame([(19999.9,), (20000.0,), (80000.0,), (80000.1,), (None,)], "x double")
    assert [r[0] for r in df.select(f.apply(F.col("x"))).collect()] == ["LOW", "MID", "MID", "UNKNOWN", "UNKNOWN"]


def test_byte_cut(spark):
    assert spark.range(1).select(E.cut_bytes(F.lit("Ève Bé"), 7)).first()[0] == "Ève B�"


def test_row_hash_keeps_cells_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), (None, "<NULL>")], "x string, y string")
    assert df.select(E.row_hash(df)).distinct().count() == 3


def test_first_of_key_and_groups(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 1, 9.0), (1, 2, None), (2, 1, -3.0)], "k int, o int, v double")
    assert {(r.k, r.o): r.v for r in steps.first_of_key(df, ["k", "o"], ["v"]).collect()}[1, 1] == 5.0
    g = {(r.k, r.o, r.v): r for r in steps.by_group(df, ["k"], ["o", "v"], {"s": "v"}, {"m": ("v", 0.0)}, {"c": "v"}).collect()}
    assert g[1, 2, None].s == 14.0 and g[1, 2, None].c == 9.0 and g[1, 2, None]._last == 1 and g[2, 1, -3.0].m == 0.0


def test_means_and_freq_drop_missing_classes(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0)], "c string, v double")
    assert [tuple(r) for r in procs.means(df, ["c"], "v", {"n": "n", "t": "sum"}).collect()] == [("a", 1, 2, 1, 1.0)]
    assert procs.means(df, ["c"], "v", {"n": "n"}, missing=True).count() == 2
    assert procs.freq(df, ["c"]).first().percent == 100.0


def test_ols_residual_degrees(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(50, 2)) + 1e6
    y = 3 + x @ [2.0, -1.0] + r.normal(size=50)
    got = ols(spark.createDataFrame([(float(b), *map(float, a)) for a, b in zip(x, y)], "y double, a double, b double"), "y", ["a", "b"]).first()
    m = np.column_stack([np.ones(50), x - x.mean(0)])
    beta, sse = np.linalg.lstsq(m, y, rcond=None)[:2]
    assert got.a == pytest.approx(beta[1], rel=1e-6) and got._rmse_ == pytest.approx((sse[0] / 47) ** 0.5, rel=1e-6)


def test_straight_line_is_forecast_exactly(spark):
    df = spark.range(39).select(F.expr("add_months(date'2022-01-01', cast(id as int))").alias("m"), (3.0 * (F.col("id") + 1) + 5).alias("y"))
    rows = forecast_rows(brown(df, "m", "y", lead=3)).where("month > date'2025-03-01'").orderBy("month").collect()
    assert [round(r.y, 6) for r in rows] == [125.0, 128.0, 131.0]


def test_published_forecasts(spark):
    text = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text()
    y = [float(v) for year in re.findall(r"(?m)^20\d\d: (.*)$", text) for v in year.split()]
    df = spark.createDataFrame(list(enumerate(y)), "i int, y double").select(F.expr("add_months(date'2022-01-01', i)").alias("m"), "y")
    f = brown(df, "m", "y")
    rows = forecast_rows(f).where("_type_ = 'FORECAST'").orderBy("month").collect()
    assert rows[0].y == pytest.approx(22595.778846153764, abs=1e-6) and rows[-1].y == pytest.approx(1080279.6855142922, abs=1e-6)
    states = {r["_type_"]: r.value for r in forecast_states(f).collect()}
    assert states["S1"] == pytest.approx(869698.699653, abs=1e-4) and states["LINEAR"] == pytest.approx(13161.311616, abs=1e-4)


def plain_brown(y, w=0.2, nstart=12):
    x = np.arange(1, min(len(y), nstart) + 1)
    slope, level = np.polyfit(x, y[: len(x)], 1) if len(x) > 1 else (0.0, y[0])
    s1, s2 = level - (1 - w) / w * slope, level - 2 * (1 - w) / w * slope
    fitted = []
    for v in y:
        fitted.append(2 * s1 - s2 + w / (1 - w) * (s1 - s2))
        s1 = w * v + (1 - w) * s1
        s2 = w * s1 + (1 - w) * s2
    return fitted, s1, s2


def test_forecast_of_long_and_short_series(spark, monkeypatch):
    monkeypatch.setattr(stats, "FAN", 4)
    r = np.random.default_rng(2)
    series = {None: r.normal(size=150).cumsum(), "b": r.normal(size=17), "c": [5.0], "d": r.normal(size=4)}
    rows = [(k, float(i), float(v)) for k, ys in series.items() for i, v in enumerate(ys)] + [("b", 99.0, None), ("e", 1.0, None)]
    f = brown(spark.createDataFrame(rows, "t string, m double, y double").repartition(3), "m", "y", ["t"], weight=0.3)
    fitted = {(x[0], x[1]): x[3] for x in f.rows.collect()}
    states = {x[0]: x for x in f.states.collect()}
    assert set(states) == set(series)
    for k, ys in series.items():
        want, s1, s2 = plain_brown(ys, 0.3)
        assert [fitted[k, float(i)] for i in range(len(ys))] == pytest.approx(want, abs=1e-9)
        assert (states[k].s1, states[k].s2) == pytest.approx((s1, s2), abs=1e-9)


def test_places_in_groups(spark):
    r = np.random.default_rng(3)
    rows = [(None if k == 3 else int(k), None if v == 5 else int(v), "x") for k, v in zip(r.integers(0, 4, 500), r.integers(0, 50, 500))]
    df = spark.createDataFrame(rows, "k int, v int, __n string").repartition(5)
    got = placed(df, ["k"], ["v"]).collect()
    for key in (None, 0, 1, 2):
        own = sorted([(x["_at"], x.v) for x in got if x.k == key])
        values = [v for _, v in own]
        assert [at for at, _ in own] == list(range(len(own))) and values == sorted(values, key=lambda v: (v is not None, v))
    assert sorted(x["_at"] for x in placed(df, [], ["v"]).collect()) == list(range(500)) and placed(df.limit(0), ["k"], ["v"]).collect() == []


def test_kappa(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "b")], "x string, y string")
    assert tuple(kappa(df, "x", "y").first()) == (4, 75.0, 0.5)
    assert kappa(df.where("x = 'a' and y = 'a'"), "x", "y").first().kappa is None


def test_reconcile_catches_mutations(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (2, "b", None)], "k int, t string, v double")
    assert profile.reconcile("t", df, df).where("not passed").count() == 0
    for bad in (df.limit(2), df.withColumn("v", F.coalesce("v", F.lit(0.0))), df.withColumn("k", F.col("k").cast("long")), df.withColumn("t", F.lit("a"))):
        assert profile.reconcile("t", df, bad).where("not passed").count() > 0
    assert profile.validate("t", df, df, planted=[("rows", df.agg(F.count("*").alias("n")), "3")]).where("check = 'planted_rows' and passed").count() == 1


def test_lineage(spark):
    code = {"a": 'data stg.x; infile "raw.csv"; input k; run;', "b": "%macro m(ds=, out=); data &out; set &ds; run; %mend; /* set no.thing; */ %m(ds=stg.x, out=out.y); proc sql; create table out.z as select * from out.y join stg.x on 1=1; quit;"}
    facts = lineage.facts(spark, code)
    edges = lineage.edges(facts)
    up = {(r.target_id, r.upstream_id): r.depth for r in lineage.upstream(lineage.data_edges(edges), spark.createDataFrame([("out.z",)], "target_id string")).collect()}
    assert up["out.z", "b"] == 1 and up["out.z", "stg.x"] == 2 and up["out.z", "raw.csv"] == 3 and ("out.z", "no.thing") not in up
    assert {(r.source_id, r.target_id): r.confidence for r in edges.where("evidence like 'argument%'").collect()} == {("b", "out.y"): "MEDIUM"}
    m = {r.program: r for r in lineage.measures(facts).collect()}
    assert (m["b"].joins, m["b"].macro_depth, m["b"].macros, m["a"].macro_depth) == (1, 1, 1, 0)
    nested = lineage.facts(spark, {"x": "%macro p; %q; %mend; %macro q; %p; %mend; %macro r; %p; %mend;", "y": "%q;", "z": "%none;"})
    assert {r.program: r.macro_depth for r in lineage.nesting(nested).collect()} == {"x": 3, "y": 2, "z": 0}
    levels = {r.program: r.level for r in lineage.migration_levels(spark.createDataFrame([("a", "b", 1)], "writer string, reader string, tables int"), spark.createDataFrame([("a",), ("b",)], "program string")).collect()}
    assert levels == {"a": 0, "b": 1}
    cycle = lineage.migration_levels(spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("c", "d", 1), ("d", "e", 1), ("c", "e", 1)], "writer string, reader string, tables int"), spark.createDataFrame([(x,) for x in "abcde"], "program string"))
    assert {r.program: r.level for r in cycle.collect()} == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 2} and cycle.where("in_cycle").count() == 2
    assert lineage.static_checks("x = df.rdd") == ["uses an RDD"] and not lineage.static_checks("x = 1")
    assert lineage.static_checks("p = '/data/x'", ["out.t"]) == ["names an absolute path", "does not name out.t"] and not lineage.static_checks("save('out.t')", ["out.t"])


def test_trees_and_diagrams(spark):
    rows = [("raw", "a", "LOADS"), ("a", "p", "READS"), ("b", "p", "READS"), ("p", "out", "WRITES"), ("a", "b", "WRITES"), ("out", "a", "READS")]
    edges = spark.createDataFrame([(*r, "HIGH", "text") for r in rows], lineage.EDGE)
    lines = [r.line for r in lineage.tree(edges, spark.createDataFrame([("out",)], "target_id string")).orderBy("place").collect()]
    assert lines == ["WRITES p", "  READS a", "    LOADS raw", "    READS out (see above)", "  READS b", "    WRITES a (see above)"]
    chart = [r.line for r in lineage.mermaid(edges).orderBy("place").collect()]
    assert chart[:3] == ["flowchart LR", '  n0["a"]', '  n1["b"]'] and "  n4 -->|LOADS| n0" in chart and len(chart) == 12


def test_program_facts():
    code = """* set no.one; data _null_; set ctrl.par; call symputx('LIMIT', v); call execute('run;'); run;
    data out.x; array a[3] p q r; declare hash h(dataset: 'stg.k'); set stg.y(where=(k = 1)); by k; retain top; file 'log.txt'; run;
    proc sql; connect to db as d; create table out.s as select k, sum(v) as v from connection to d (select 1) group by k; select max(v) into :top from out.x, stg.z; quit;"""
    found = {(f, s) for _, _, f, s, _ in lineage.fact_rows("p", code)}
    assert {("SYMPUT", "LIMIT"), ("EXECUTE", ""), ("ARRAY", "a"), ("HASH", "h"), ("RETAIN", "top"), ("FILE_OUT", "log.txt"), ("PASS_THROUGH", "db"), ("PASS_THROUGH", "d"), ("GROUP_BY", ""), ("INTO", "top"), ("READ", "stg.z"), ("READ", "stg.y"), ("WRITE", "out.s")} <= found
    assert ("READ", "no.one") not in found and ("WRITE", "_null_") not in found


def test_classification(spark):
    df = spark.createDataFrame([("p", "loan_status loan", "x"), ("q", "card loan", "")], "id string, out string, code string")
    got = {r.id: (r.label, r.confidence) for r in classify.keyword_area(df, "id", {"out": 3.0, "code": 0.25}, {"Lending": ["loan"], "Payments": ["card"]}).collect()}
    assert got == {"p": ("Lending", "HIGH"), "q": ("Other", "LOW")}


def test_scorecard(spark):
    s = spark.createDataFrame([("m", 1, "a", "VALIDATED", 1), ("m", 1, "b", "VALIDATED", 2), ("m", 1, "c", "NOT_SUPPORTED", 0)], "method string, run int, program_id string, final_status string, attempts int")
    c = spark.createDataFrame([("m", 1, "planted_x", True), ("m", 1, "row", False)], "method string, run int, check string, passed boolean")
    a = spark.createDataFrame([("m", 1, "rules", 6.0, None)], "method string, run int, model string, latency_s double, cost_usd double")
    r = marts.scorecard(s, a, c).first()
    assert (r.validated_first_attempt, r.validated_after_repair, r.checks_passed, r.planted_traps_passed, r.minutes) == (1, 1, "1/2", "1/1", 0.1)


def test_sources(spark, tmp_path):
    (tmp_path / "in.csv").write_text('k,name,d\n1,"Ève, Bé  ",2024-01-02\n2,\n')
    rows = read_delimited(spark, f"{tmp_path}/in.csv", "k int, name string, d date", widths={"name": 60}).collect()
    assert rows[0].name == "Ève, Bé" and rows[1].name is None and rows[1].d is None
    lib = Libraries(spark, {"out": str(tmp_path)})
    assert lib.save("out.t", spark.range(3), verify=True).where("not passed").count() == 0
    write_delimited(spark.createDataFrame([("a\nb",)], "t string"), f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first().t == "a b"
    (tmp_path / "status_rule_based_run2.csv").write_text("program\nx\n")
    assert tuple(read_runs(spark, f"{tmp_path}/status_*.csv", "status", "program string").first()) == ("x", "rule_based", 2)
    t = make_loans(spark)
    assert listed(t["macro_parameters"], "param_name") == ["DPD_THRESHOLD", "FRAUD_MIN_AMOUNT", "HIGH_PRINCIPAL"]
    with pytest.raises(ValueError):
        listed(t["macro_parameters"], "param_name", most=2)
    assert steps.extra_rows(t["loan_payments"], ["loan_id", "payment_date"]).count() == 1
    assert t["loan_payments"].where(F.col("days_past_due") > parameter(t["macro_parameters"], "DPD_THRESHOLD")).count() > 0


def test_made_tables(spark):
    t = make_loans(spark, customers=200)
    assert set(t) == {"customers", "loans", "loan_payments", "card_transactions", "client_segments", "reporting_periods", "macro_parameters"}
    rows = {k: v.count() for k, v in t.items()}
    assert rows == {"customers": 200, "loans": 400, "loan_payments": 400 * 24 + 1, "card_transactions": 2000, "client_segments": 5, "reporting_periods": 12, "macro_parameters": 3}
    c, n, p, x = (t[k] for k in ("customers", "loans", "loan_payments", "card_transactions"))
    assert c.where("annual_income is null").count() == 6 and c.where("province = 'qc'").count() == 200 and c.where("city like \"%'%\"").count() > 0
    assert c.where("octet_length(customer_name) > length(customer_name)").count() == 200
    assert [r.loan_id for r in n.join(c, "customer_id", "left_anti").collect()] == [7] and n.where("monthly_payment <= 0 or monthly_payment is null").count() == 0
    copies = p.where("loan_id = 3 and payment_date = date'2022-05-01'").select("payment_amount").distinct().count()
    assert copies == 2 and p.where("days_past_due > 30").count() > 0 and p.where("abs(payment_amount - principal_paid - interest_paid) > 0.005").count() == 1
    assert x.where("amount < 0").count() == 8 and x.where("amount = 0").count() == 2 and 0 < x.agg(F.sum("fraud_flag")).first()[0] < 60
    assert c.join(t["client_segments"], "segment_code", "left_anti").count() == 0
    assert [r.period_id for r in t["reporting_periods"].where("active_flag = 1").orderBy("period_id").collect()] == ["202309", "202310", "202311", "202312"]
    again = make_loans(spark, customers=200)
    assert all(steps.multiset_difference(t[k], again[k].repartition(3)).count() == 0 for k in t)


def test_range_lookup_is_the_same_beyond_its_bound(spark):
    bands = spark.createDataFrame([(0.0, 5.0, "a"), (3.0, 9.0, "b"), (None, 1.0, "c"), (8.0, None, "d"), (4.0, 4.0, "e")], "low double, high double, label string")
    df = spark.createDataFrame([(i, float(i)) for i in range(-2, 12)] + [(99, None)], "id int, v double")
    near, far = (sorted(((r.id, r.label) for r in E.range_lookup(df, "v", bands, max_bands=n).collect()), key=str) for n in (10, 2))
    assert near == far and (99, None) in near and (4, "a") in near and (4, "b") in near and (-2, "c") in near


def test_shared_folder(spark, monkeypatch):
    from stepframe.sources import shared

    assert shared.new_folder(spark, "x") != shared.new_folder(spark, "x") and shared.new_folder(spark, "x").startswith(shared.shared_folder(spark))

    class Session:
        def __init__(self, master, named=None):
            self.conf = type("C", (), {"get": staticmethod(lambda key, other=None: named)})
            self.sparkContext = type("S", (), {"master": master, "applicationId": "app"})

    assert shared.shared_folder(Session("spark://far", "hdfs://a/b/")) == "hdfs://a/b"
    with pytest.raises(ValueError):
        shared.shared_folder(Session("spark://far"))
    assert shared.shared_folder(Session("local[2]")) == shared.shared_folder(Session("local[2]"))


def test_translator(spark):
    s = Session(Libraries(spark, {}))
    s.tables["stg.a"] = spark.createDataFrame([(1, None, " x;y "), (2, 90000.0, "b")], "k int, v double, t string")
    out = s.run("proc format; value f low-<20000='LOW' 20000-high='HIGH' other='NA'; run; data out.b; set stg.a; if v < 20000 then c = 'L'; else c = 'H;'; d = put(v, f.); e = strip(t); run;")["out.b"].collect()
    assert [(r.c, r.d, r.e) for r in out] == [("L", "NA", "x;y"), ("H;", "HIGH", "b")]
    for code, construct in (("data b; update x y; by k; run;", "UPDATE"), ("proc tabulate data=x; run;", "procedure"), ("data b; set stg.a; x = foo(k); run;", "function"), ("data b; set stg.a; y = &gone; run;", "unresolved macro variable"), ("proc sort data=stg.a out=b nodupkey; by k; run;", "NODUPKEY without a known input order")):
        with pytest.raises(Unsupported) as e:
            Session(s.libraries).run(code) if "stg.a" not in code else _with(s, code)
        assert e.value.construct == construct


def _steps(spark, code, rows=((1, 5.0, 1.0), (1, 1.0, 1.0), (1, 7.0, 1.0), (2, 2.0, None)), schema="k int, v double, o double"):
    t = Session(Libraries(spark, {}), row_order={"stg.a": ["n"]})
    t.tables["stg.a"] = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], schema + ", n int")
    return {k: [r.asDict() for r in v.orderBy("n").collect()] if "n" in v.columns else [r.asDict() for r in v.collect()] for k, v in t.run(code).items()}


def test_translator_statement_order(spark):
    start = "data b; set stg.a; by k; if first.k then do; cum = 0; tot = 0; end; "
    assert [r["cum"] for r in _steps(spark, start + "cum + v; if v > 4; run;")["work.b"]] == [5.0, 13.0]
    assert [r["cum"] for r in _steps(spark, start + "if v > 4 then cum + v; run;")["work.b"]] == [5.0, 5.0, 12.0, 0.0]
    both = _steps(spark, start + "cum + v; z = 1; tot + o; run;")["work.b"]
    assert [(r["cum"], r["tot"], r["z"]) for r in both] == [(5.0, 1.0, 1), (6.0, 2.0, 1), (13.0, 3.0, 1), (2.0, 0.0, 1)]
    assert [r["v"] for r in _steps(spark, start + "cum + v; if last.k; run;")["work.b"]] == [7.0, 2.0]
    with pytest.raises(Unsupported):
        _steps(spark, "data b; set stg.a; by k; if v > 1; if first.k then cum = 0; cum + v; run;")
    out = _steps(spark, "data b c(keep=n w); set stg.a; w = 0; if v < 2 then do; w = 1; output c; end; else if v < 6 then delete; output b; run;")
    assert [(r["n"], r["w"]) for r in out["work.c"]] == [(1, 1)] and [r["n"] for r in out["work.b"]] == [1, 2]


def test_translator_options(spark):
    assert [r["n"] for r in _steps(spark, "data b; set stg.a(where=(k=1 and v in (1, 7))); run;")["work.b"]] == [1, 2]
    assert set(_steps(spark, "data b(drop=o rename=(v=w)); set stg.a(rename=(k=key)); rename n=m; run;")["work.b"][0]) == {"key", "w", "m"}
    with pytest.raises(Unsupported):
        _steps(spark, "data b; set stg.a(obs=5); run;")


def test_translator_sql(spark):
    rows = ((1, None, 1.0), (1, 9.0, 1.0), (2, 3.0, None))
    low = _steps(spark, "proc sql; create table b as select * from stg.a where v < 5; quit;", rows)["work.b"]
    assert [r["n"] for r in low] == [0, 2]
    out = _steps(spark, "proc sql; create table b as select a.k as key format=8., sum(v > 4) as big, count(distinct o) as kinds, max(v) as top from stg.a as a left join stg.a c on a.n = c.n and c.k = 1 group by calculated key having count(*) > 1 order by key; quit;".replace("sum(v > 4)", "sum(a.v > 4)").replace("distinct o", "distinct a.o").replace("max(v)", "max(a.v)"), rows)["work.b"]
    assert out == [{"key": 1, "big": 1, "kinds": 1, "top": 9.0}]
    best = _steps(spark, "proc sql noprint; select max(v), min(k) into :top trimmed, :low from stg.a; create table b as select n from stg.a where v = (select max(v) from stg.a) and k = &low; quit; %macro m; %if &top > 5 %then %do; data c; set b; x = &top; run; %end; %else %do; data d; set b; run; %end; %mend; %m;", rows)
    assert best["work.b"] == [{"n": 1}] and best["work.c"] == [{"n": 1, "x": 9.0}] and "work.d" not in best
    with pytest.raises(Unsupported):
        _steps(spark, "proc sql; create table b as select k, v, sum(o) as s from stg.a group by k; quit;", rows)


def _with(s, code):
    t = Session(s.libraries)
    t.tables["stg.a"] = s.tables["stg.a"]
    t.run(code)


def test_stream(spark, tmp_path):
    from stepframe.streaming.running import running_totals

    df = spark.createDataFrame([("a", "2024-01-01", 2.0), ("a", "2024-01-02", None), ("b", "2024-01-01", 1.0)], "k string, d string, v double")
    df.write.parquet(f"{tmp_path}/in")
    q = running_totals(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "k", "d", "v").writeStream.format("memory").queryName("running").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(60)
    assert {(r.k, r.running_sum) for r in spark.table("running").collect()} == {("a", 2.0), ("b", 1.0)}


def test_entry_without_training_operators(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
