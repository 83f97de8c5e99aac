"""Programs whose rows depend on the row before, and programs that read files and merge tables, against plain versions."""

import datetime as dt
import random

import pytest

from stepframe.plans.translator import Session, Unsupported
from stepframe.sources.library import Libraries

SCHEMA = "k int, j int, o int, v double, t string"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    return [(r.choice([1, 2, 3, 4, None]), r.randint(0, 2), i, r.choice([None, *map(float, range(-3, 9))]), r.choice(["a", "bb", "ccc", None])) for i in range(300)]


def session(spark, rows, name="stg.t", schema=SCHEMA, order=("o",)):
    s = Session(Libraries(spark, {}), row_order={name: list(order)})
    s.tables[name] = spark.createDataFrame(rows, schema).repartition(3)
    return s


def groups(rows, *places):
    out = {}
    for r in sorted(rows, key=lambda r: ([(r[p] is not None, r[p] or 0) for p in places], r[2])):
        out.setdefault(tuple(r[p] for p in places), []).append(r)
    return out


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def refusal(spark, rows, code):
    with pytest.raises(Unsupported) as e:
        session(spark, rows).run(code)
    return e.value.construct


def test_a_level_that_decays(spark, rows):
    made = session(spark, rows).run("data out.t; set stg.t; by k; retain c; if first.k then c = v; else c = c * 0.9 + v; run;")["out.t"]
    want = []
    for own in groups(rows, 0).values():
        c = None
        for i, r in enumerate(own):
            c = r[3] if i == 0 else None if c is None or r[3] is None else c * 0.9 + r[3]
            want.append((r[2], c))
    assert collected(made, "o", "c") == sorted(want, key=str) and made.columns == ["k", "j", "o", "v", "t", "c"]


def test_groups_inside_groups_are_found(spark, rows):
    code = "data out.t; set stg.t; by k j; retain s; if first.j then s = 0; s = s + coalesce(v, 0); if last.k then e = 1; if s > 5 then output; run;"
    want = []
    last_of_k = {max(own, key=lambda r: (r[1], r[2]))[2] for own in groups(rows, 0).values()}
    for own in groups(rows, 0, 1).values():
        s = 0.0
        for r in own:
            s += r[3] or 0
            if s > 5:
                want.append((r[2], s, 1.0 if r[2] in last_of_k else None))
    assert collected(session(spark, rows).run(code)["out.t"], "o", "s", "e") == sorted(want, key=str)


def test_text_dates_and_two_tables(spark, rows):
    code = """data out.all(drop=n) out.ends(keep=k n all_t day); length all_t $5; set stg.t; by k; retain all_t n;
      if first.k then do; all_t = ''; n = 0; end;
      n + 1; all_t = cats(all_t, t); day = mdy(2, mod(n, 28) + 1, 2020) + 1;
      output out.all; if last.k then output out.ends; run;"""
    made = session(spark, rows).run(code)
    want, ends = [], []
    for key, own in groups(rows, 0).items():
        text = ""
        for n, r in enumerate(own, 1):
            text = (text + (r[4] or ""))[:5]
            day = dt.date(2020, 2, n % 28 + 1) + dt.timedelta(1)
            want.append((r[2], text, day))
        ends.append((key[0], float(len(own)), text, day))
    assert collected(made["out.all"], "o", "all_t", "day") == sorted(want, key=str)
    assert collected(made["out.ends"], "k", "n", "all_t", "day") == sorted(ends, key=str)
    assert dict(made["out.all"].dtypes)["day"] == "date" and dict(made["out.all"].dtypes)["o"] == "int"


def test_lags_and_arrays(spark, rows):
    code = """data out.t; set stg.t; by k; array h[3] h1 h2 h3; retain h1 h2 h3;
      if first.k then do i = 1 to 3; h[i] = .; end;
      do i = 3 to 2 by -1; h[i] = h[i - 1]; end;
      h[1] = v; n = 0; do i = 1 to dim(h); if not missing(h{i}) then n = n + 1; end;
      before = lag(v); d = dif(o); if first.k then do; before = .; d = 0; end; run;"""
    want = []
    for own in groups(rows, 0).values():
        for i, r in enumerate(own):
            h = [own[i - k][3] if i >= k else None for k in range(3)]
            want.append((r[2], *h, float(sum(x is not None for x in h)), own[i - 1][3] if i else None, float(r[2] - own[i - 1][2]) if i else 0.0))
    assert collected(session(spark, rows).run(code)["out.t"], "o", "h1", "h2", "h3", "n", "before", "d") == sorted(want, key=str)


def test_a_group_larger_than_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        df = spark.range(30_000).selectExpr("cast(id % 5 > 0 as int) as k", "id as o", "cast(id % 10 as double) as v")
        s = Session(Libraries(spark, {}), row_order={"stg.t": ["o"]})
        s.tables["stg.t"] = df
        made = s.run("data out.t; set stg.t; by k; retain c; if first.k then c = 0; c = mod(c * 3 + v, 1009); if last.k; run;")["out.t"]
        got = {r.k: r.c for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {0: 0.0, 1: 0.0}
    for i in range(30_000):
        k = int(i % 5 > 0)
        want[k] = (want[k] * 3 + i % 10) % 1009
    assert got == want


def test_loops_without_groups(spark, rows):
    made = session(spark, rows).run("data out.t(drop=i); set stg.t; array a[2] v o; do i = 1 to 2; a[i] = a[i] * 2; end; if v = . then delete; run;")["out.t"]
    assert collected(made, "o", "v") == sorted(((r[2] * 2.0, r[3] * 2) for r in rows if r[3] is not None), key=str)


def test_what_groups_would_share_is_refused(spark, rows):
    head = "data out.t; set stg.t; by k; "
    for body in ("retain c 7; c = c * 0.9 + v;", "p = lag(v); d = v - p;", "retain c; if v > 3 then c = v; else c = c + 1;", "retain c; d = c; if first.k then c = v; else c = c + v;", "retain c; if first.k and v > 0 then c = 0; else c = c * 2;", "retain c; if last.k then c = 0; else c = c * 2;", "retain c; if v > 1; if first.k then c = 0; c = c * 2;", "retain c; if v > 1 then delete; if first.k then c = 0; c = c * 2;"):
        assert refusal(spark, rows, head + body + " run;") == "value carried over BY groups", body
    assert refusal(spark, rows, "data out.t; set stg.t; retain c; c = c * 2 + v; run;") == "value carried over rows without BY"
    for body, construct in (("array a[2] $ x y; a[1] = 'u';", "ARRAY of another form"), ("do while(v > 1); v = v - 1; end;", "DO of another form"), ("array a[3] x y; a[1] = 2;", "ARRAY of another size"), ("do i = 1 to 2; stop; end;", "STOP")):
        assert refusal(spark, rows, head + body + " run;") == construct, body
    assert refusal(spark, rows, "data out.t; length v 4; set stg.t; run;") == "LENGTH of a number"


def test_infile(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes("id;name;day;amount\n1;Ève Bé;05/03/2024;\"1,200\"\n2;\"a;b\"\n".encode("latin1"))
    code = f"""filename f "{tmp_path}/c.csv" encoding="latin1";
      data stg.c(where=(id > 0)); infile f dsd dlm=';' firstobs=2 truncover; length name $3; informat day ddmmyy10.;
      input id name $ day amount :comma8.; big = (amount > 1000); run;"""
    got = collected(Session(Libraries(spark, {})).run(code)["stg.c"], "id", "name", "day", "amount", "big")
    assert got == [(1.0, "Ève", dt.date(2024, 3, 5), 1200.0, 1), (2.0, "a;b", None, None, 0)]
    for options in ("dsd firstobs=2", "truncover", "dsd truncover firstobs=3", "dsd truncover obs=5"):
        with pytest.raises(Unsupported):
            Session(Libraries(spark, {})).run(f"data stg.c; infile '{tmp_path}/c.csv' {options}; input id; run;")
    with pytest.raises(Unsupported):
        Session(Libraries(spark, {})).run("data stg.c; infile nowhere dsd truncover; input id; run;")


def test_merge_and_widths(spark):
    s = Session(Libraries(spark, {}), row_order={"work.a": ["x"], "work.b": ["y"]})
    s.tables["work.a"] = spark.createDataFrame([(1, 1, "left"), (1, 2, "left"), (2, 3, "left"), (None, 4, "left")], "k int, x int, c string")
    s.tables["work.b"] = spark.createDataFrame([(1, 9, "r1"), (None, 8, "r2"), (3, 7, "r3")], "k int, y int, c string")
    made = s.run("data out.t; length c $3; merge work.a(in=p) work.b(in=q); by k; both = p and q; last = last.k; run;")["out.t"]
    assert collected(made, "k", "x", "y", "c", "both", "last") == sorted([(1, 1, 9, "r1", 1, 0), (1, 2, 9, "lef", 1, 1), (2, 3, None, "lef", 0, 1), (None, 4, 8, "r2", 1, 1), (3, None, 7, "r3", 0, 1)], key=str)
    assert made.columns == ["k", "x", "c", "y", "both", "last"]
    with pytest.raises(Unsupported):
        s.run("data out.t; merge work.a work.b; run;")


def test_texts_compare_without_trailing_blanks(spark):
    s = session(spark, [(1, 1, 1, 5.0, "ab"), (2, 1, 2, 2.0, "abc")])
    made = s.run("data out.t; set stg.t; x = (t = 'ab  '); y = (substr('q  z', 1, 2) = 'q'); z = (t in ('ab ', 'x')); w = (1 < v < 5); u = scan('one two', -1); r = round(v / 3, 0.5); run;")["out.t"]
    assert collected(made, "o", "x", "y", "z", "w", "u", "r") == [(1, 1, 1, 1, 0, "two", 1.5), (2, 0, 1, 0, 1, "two", 0.5)]


def test_means_of_several_variables_and_forecasts_by_group(spark):
    rows = [(1, 1, i, float(i), "a") for i in range(20)] + [(2, 1, i, float(2 * i + 1), "b") for i in range(15)]
    s = session(spark, rows)
    made = s.run("proc means data=stg.t nway noprint; class k; var v o; output out=out.m(drop=_type_ _freq_) sum=sv so max=top; run;")["out.m"]
    assert collected(made, "k", "sv", "so", "top") == [(1, 190.0, 190, 19.0), (2, 225.0, 105, 29.0)]
    s.tables["stg.m"] = spark.createDataFrame(rows, SCHEMA).selectExpr("k", "add_months(date'2020-01-01', o) as month", "v")
    made = s.run("proc forecast data=stg.m method=expo trend=2 lead=2 out=out.f outest=out.e; by k; id month; var v; run;")
    ahead = collected(made["out.f"].where("_lead_ > 1"), "k", "month", "v")
    assert [(k, m, round(v, 9)) for k, m, v in ahead] == [(1, dt.date(2021, 10, 1), 21.0), (2, dt.date(2021, 5, 1), 33.0)]
    assert made["out.e"].count() == 8
    for code in ("proc forecast data=stg.m method=expo out=out.f; id month; var v; output out=x; run;", "proc reg data=stg.t outest=out.r; model v = o; by k; run;"):
        with pytest.raises(Unsupported):
            s.run(code)


def test_a_row_step_deals_rows_once_and_takes_only_what_it_uses(spark, rows):
    code = "data out.t(keep=k o d); set stg.t; by k; retain d; if first.k then d = 0; else do; if v >= 2 or missing(v) then d = d - 1; else d = max(d, 3); end; run;"
    made = session(spark, rows).run(code)["out.t"]
    plan = made._jdf.queryExecution().sparkPlan().toString()
    full = made._jdf.queryExecution().executedPlan().toString()
    assert full.count("Exchange hashpartitioning") == 1
    step = next(x for x in plan.splitlines() if "MapInArrow" in x)
    given = step[step.index("[_to") :]
    assert all(f"{c}#" in given for c in "kod") and "v#" not in given
