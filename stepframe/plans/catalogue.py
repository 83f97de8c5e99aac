"""Registered queries of the library over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.stats import brown, forecast_rows, forecast_states, kappa, ols
from ..operators import classify, marts, procs, profile, steps
from ..sources.library import Libraries, parameter
from .registry import ORACLE_SQL, query
from .registry import table as _t
from .translator import Session

#: Balances with missing values made from ids, since the tables have none.
_BAL = "CASE WHEN c_custkey % 33 = 0 THEN NULL ELSE c_acctbal END"


def _balances(spark, d):
    return _t(spark, d, "customer").withColumn("bal", F.expr(_BAL))


_BANDS = [("lt", 2000, "LOW"), ("lt", 6000, "MEDIUM")]
_FORMAT = E.RangeFormat((E.Interval(None, 2000, "LOW", exclude_high=True), E.Interval(2000, 6000, "MEDIUM", exclude_high=True), E.Interval(6000, None, "HIGH")), "UNKNOWN")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    bands = _balances(spark, d).withColumn("band", E.chain([(E.compare(F.col("bal"), op, F.lit(v)), F.lit(x)) for op, v, x in _BANDS], F.lit("HIGH")))
    joined = _t(spark, d, "orders").join(bands, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "band", "o_totalprice")
    return procs.means(joined.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")), ["c_mktsegment", "band"], "o_totalprice", {"n": "n", "total": "sum"}, types=False).withColumn("total", F.col("total").cast("double"))


query(f"""SELECT c_mktsegment, CASE WHEN b IS NULL OR b < 2000 THEN 'LOW' WHEN b < 6000 THEN 'MEDIUM' ELSE 'HIGH' END AS band, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN (SELECT *, {_BAL} AS b FROM customer) ON o_custkey = c_custkey GROUP BY ALL""")(flagship)


@query(f"SELECT c_custkey, CASE WHEN b IS NULL OR b < 2000 THEN 'LOW' WHEN b < 6000 THEN 'MEDIUM' ELSE 'HIGH' END AS band, CAST(b IS NULL AS INT) AS is_missing FROM (SELECT c_custkey, {_BAL} AS b FROM customer)")
def income_band_missing_low(spark, d):
    b = F.col("bal")
    return _balances(spark, d).select("c_custkey", E.chain([(E.compare(b, op, F.lit(v)), F.lit(x)) for op, v, x in _BANDS], F.lit("HIGH")).alias("band"), E.is_missing(b).alias("is_missing"))


@query(f"SELECT c_custkey, CASE WHEN b IS NULL THEN 'UNKNOWN' WHEN b < 2000 THEN 'LOW' WHEN b < 6000 THEN 'MEDIUM' ELSE 'HIGH' END AS band FROM (SELECT c_custkey, {_BAL} AS b FROM customer)")
def format_band_other_unknown(spark, d):
    return _balances(spark, d).select("c_custkey", _FORMAT.apply(F.col("bal")).alias("band"))


@query(f"SELECT c_custkey, CAST(coalesce(b < 5000, true) AS INT) AS lt, CAST(coalesce(b <= 5000, true) AS INT) AS le, CAST(coalesce(b > 5000, false) AS INT) AS gt, CAST(coalesce(b >= 5000, false) AS INT) AS ge, CAST(coalesce(b = 5000, false) AS INT) AS eq, CAST(coalesce(b <> 5000, true) AS INT) AS ne FROM (SELECT c_custkey, {_BAL} AS b FROM customer)")
def missing_compare_matrix(spark, d):
    return _balances(spark, d).select("c_custkey", *[E.flag(E.compare(F.col("bal"), op, F.lit(5000.0))).alias(op) for op in ("lt", "le", "gt", "ge", "eq", "ne")])


@query("""SELECT c_custkey, label FROM (SELECT c_custkey, c_acctbal AS b FROM customer) LEFT JOIN (VALUES (-1000.0, 0.0, 'debt'), (0.0, 5000.0, 'some')) v(low, high, label) ON b >= low AND b < high""")
def range_lookup_bands(spark, d):
    bands = spark.createDataFrame([(-1000.0, 0.0, "debt"), (0.0, 5000.0, "some")], "low double, high double, label string")
    return E.range_lookup(_t(spark, d, "customer"), "c_acctbal", bands).select("c_custkey", "label")


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def enrich_inner_left(spark, d):
    r = _t(spark, d, "region").where("r_name <> 'ASIA'")
    out = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orphan_anti(spark, d):
    return _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def membership_semi(spark, d):
    return _t(spark, d, "orders").join(_t(spark, d, "lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


_LATE = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey"


@query(f"SELECT {_LATE}, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1")
def nodupkey_first(spark, d):
    return steps.first_of_key(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]).select(*_LATE.split(", "), "l_quantity")


_W = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey"


@query(f"""SELECT {_LATE}, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS cum_qty, greatest(max(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS max_qty,
CAST(row_number() OVER (w) = 1 AS INT) AS first_row, CAST(lead(1) OVER (w) IS NULL AS INT) AS last_row, CAST(l_quantity > 30 AS INT) AS high_flag, strftime(l_shipdate, '%Y%m') AS period_id FROM lineitem WINDOW w AS ({_W})""")
def running_delinquency(spark, d):
    rows = steps.by_group(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"], {"cum_qty": "l_quantity"}, {"max_qty": ("l_quantity", 0.0)})
    return rows.select(*_LATE.split(", "), "cum_qty", "max_qty", F.col("_first").alias("first_row"), F.col("_last").alias("last_row"), E.flag(F.col("l_quantity") > 30).alias("high_flag"), E.year_month(F.col("l_shipdate")).alias("period_id"))


@query(f"SELECT l_orderkey, cum_qty, max_qty FROM (SELECT l_orderkey, sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS cum_qty, greatest(max(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS max_qty, lead(1) OVER (w) AS nx FROM lineitem WINDOW w AS ({_W})) WHERE nx IS NULL")
def last_row_status(spark, d):
    rows = steps.by_group(_t(spark, d, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"], {"cum_qty": "l_quantity"}, {"max_qty": ("l_quantity", 0.0)})
    return steps.outputs(rows, {"status": (F.col("_last") == 1, ["l_orderkey", "cum_qty", "max_qty"])})["status"]


_STATS = {"n": "n", "total": "sum", "avg": "mean", "low": "min", "high": "max", "dev": "std"}
_STATS_SQL = "count(l_quantity) AS n, sum(l_quantity) AS total, round(avg(l_quantity), 6) AS avg, min(l_quantity) AS low, max(l_quantity) AS high, round(stddev_samp(l_quantity), 6) AS dev"


def _rounded(df):
    return df.withColumns({"avg": F.round("avg", 6), "dev": F.round("dev", 6)})


@query(f"SELECT l_returnflag, l_linestatus, CAST(3 AS INT) AS _type_, count(*) AS _freq_, {_STATS_SQL} FROM lineitem GROUP BY ALL")
def means_nway(spark, d):
    return _rounded(procs.means(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", _STATS))


@query(f"SELECT l_returnflag, l_linestatus, CAST(3 - grouping_id(l_returnflag, l_linestatus) AS INT) AS _type_, count(*) AS _freq_, {_STATS_SQL} FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def means_all_types(spark, d):
    return _rounded(procs.means_all(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", _STATS))


@query('SELECT l_returnflag, l_linestatus, count(*) AS "count", round(100.0 * count(*) / sum(count(*)) OVER (), 9) AS percent FROM lineitem GROUP BY l_returnflag, l_linestatus')
def freq_two_way(spark, d):
    return procs.freq(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]).withColumn("percent", F.round("percent", 9))


@query('SELECT o_orderpriority, count(*) AS "count", round(100.0 * count(*) / sum(count(*)) OVER (), 9) AS percent FROM orders GROUP BY o_orderpriority')
def freq_one_way(spark, d):
    return procs.freq(_t(spark, d, "orders"), ["o_orderpriority"]).withColumn("percent", F.round("percent", 9))


@query("SELECT c_mktsegment, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) > 100000 AS INT) AS high_flag FROM customer GROUP BY c_mktsegment")
def macro_summarize_flag(spark, d):
    control = spark.createDataFrame([("HIGH", "100000"), ("OTHER", "1")], "param_name string, param_value string")
    s = procs.summarize(_t(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")), ["c_mktsegment"], "c_acctbal").withColumn("total", F.col("total").cast("double"))
    return procs.flag_high(s, "total", parameter(control, "HIGH")).drop("avg")


@query("SELECT strftime(o_orderdate, '%Y%m') AS period_id, o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE strftime(o_orderdate, '%Y%m') IN ('199603', '199604', '199712') GROUP BY ALL")
def period_driver(spark, d):
    active = spark.createDataFrame([("199603", 1), ("199604", 1), ("199605", 0), ("199712", 1)], "period_id string, active int").where("active = 1")
    rows = _t(spark, d, "orders").withColumns({"period_id": E.year_month(F.col("o_orderdate")), "p": F.col("o_totalprice").cast("decimal(18,2)")}).join(active, "period_id", "left_semi")
    return procs.means(rows, ["period_id", "o_orderstatus"], "p", {"n": "n", "total": "sum"}, types=False).withColumn("total", F.col("total").cast("double"))


_MONTHS = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1"


def _monthly(spark, d):
    return _t(spark, d, "orders").groupBy(E.month_start(F.col("o_orderdate")).alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query(_MONTHS)
def monthly_totals(spark, d):
    return _monthly(spark, d)


@query("SELECT c_mktsegment, count(DISTINCT o_orderkey) AS n_orders, count(*) FILTER (o_totalprice > 200000) AS n_high, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def exec_report(spark, d):
    j = _t(spark, d, "customer").join(_t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return j.groupBy("c_mktsegment").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.sum(E.flag(F.col("o_totalprice") > 200000)).alias("n_high"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT o_orderkey, o_orderdate AS latest_day FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) - INTERVAL 10 DAY FROM orders)")
def exec_forecast_filter(spark, d):
    _t(spark, d, "orders").createOrReplaceTempView("_orders")
    return spark.sql("SELECT o_orderkey, o_orderdate AS latest_day FROM _orders WHERE o_orderdate > (SELECT max(o_orderdate) - INTERVAL 10 DAY FROM _orders)")


_BROWN = f"""WITH RECURSIVE m AS (SELECT month, total AS y, row_number() OVER (ORDER BY month) AS t FROM ({_MONTHS})),
fit AS (SELECT regr_slope(y, t) AS b, regr_intercept(y, t) AS a FROM m WHERE t <= 12),
r AS (SELECT CAST(0 AS BIGINT) AS t, a - 4 * b AS s1, a - 8 * b AS s2, CAST(NULL AS DOUBLE) AS fitted FROM fit
UNION ALL SELECT m.t, 0.2 * y + 0.8 * s1, 0.2 * (0.2 * y + 0.8 * s1) + 0.8 * s2, 2 * s1 - s2 + 0.25 * (s1 - s2) FROM r JOIN m ON m.t = r.t + 1),
e AS (SELECT s1, s2, 2 * s1 - s2 AS c, 0.25 * (s1 - s2) AS l FROM r ORDER BY t DESC LIMIT 1), last AS (SELECT max(month) AS d FROM m) """


@query(_BROWN + "SELECT month, 'ACTUAL' AS _type_, CAST(0 AS INT) AS _lead_, round(y, 3) AS y FROM m UNION ALL SELECT month, 'FORECAST', 1, round(fitted, 3) FROM r JOIN m USING (t) UNION ALL SELECT CAST(d + to_months(CAST(k AS INT)) AS DATE), 'FORECAST', CAST(k AS INT), round(c + l * k, 3) FROM e, last, range(1, 13) g(k)")
def brown_forecast(spark, d):
    return forecast_rows(brown(_monthly(spark, d), "month", "total")).withColumn("y", F.round("y", 3))


@query(_BROWN + "SELECT 'S1' AS _type_, round(s1, 3) AS value FROM e UNION ALL SELECT 'S2', round(s2, 3) FROM e UNION ALL SELECT 'CONSTANT', round(c, 3) FROM e UNION ALL SELECT 'LINEAR', round(l, 3) FROM e")
def brown_states(spark, d):
    return forecast_states(brown(_monthly(spark, d), "month", "total")).withColumn("value", F.round("value", 3))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS l_quantity, round(sqrt((regr_syy(l_extendedprice, l_quantity) - power(regr_sxy(l_extendedprice, l_quantity), 2) / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 4) AS _rmse_ FROM lineitem")
def ols_single(spark, d):
    out = ols(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])
    return out.select(*[F.round(c, 4).alias(c) for c in out.columns])


# Two regressors: the normal equations of centred moments by Cramer's rule.
@query("""WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS ma, avg(l_discount) AS mb, var_pop(l_quantity) AS aa, var_pop(l_discount) AS bb, covar_pop(l_quantity, l_discount) AS ab, covar_pop(l_extendedprice, l_quantity) AS ya, covar_pop(l_extendedprice, l_discount) AS yb, var_pop(l_extendedprice) AS yy FROM lineitem),
k AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) AS p, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS q FROM s)
SELECT round(my - p * ma - q * mb, 3) AS intercept, round(p, 3) AS l_quantity, round(q, 3) AS l_discount, round(sqrt(n * (yy - p * ya - q * yb) / (n - 3)), 3) AS _rmse_ FROM k""")
def ols_payment_model(spark, d):
    out = ols(_t(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return out.select(*[F.round(c, 3).alias(c) for c in out.columns])


def _profile_sql(table: str, numbers: list[str], texts: list[str]) -> str:
    rows = [f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, count(DISTINCT {c}) AS distinct_count, round(sum(CAST({c} AS DOUBLE)), 4) AS sum, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, CAST(NULL AS INT) AS max_chars, CAST(NULL AS INT) AS max_bytes, CAST(NULL AS BIGINT) AS bad_text FROM {table}" for c in numbers]
    rows += [f"SELECT '{c}', count(*) FILTER ({c} IS NULL), count(DISTINCT {c}), NULL, NULL, NULL, CAST(max(length({c})) AS INT), CAST(max(strlen({c})) AS INT), count(*) FILTER (contains({c}, chr(65533))) FROM {table}" for c in texts]
    return " UNION ALL ".join(rows)


@query(_profile_sql("lineitem", ["l_orderkey", "l_quantity", "l_tax"], []))
def profile_numeric(spark, d):
    return profile.profile(_t(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_tax")).withColumn("sum", F.round("sum", 4))


@query(_profile_sql("documents", ["n_chars"], ["text", "lang", "source"]))
def profile_text(spark, d):
    return profile.profile(_t(spark, d, "documents").select("n_chars", "text", "lang", "source")).withColumn("sum", F.round("sum", 4))


@query("""SELECT n_nationkey, sha256(concat_ws('|', length(a) || ':' || a, length(b) || ':' || b, length(c) || ':' || c)) AS fingerprint FROM (SELECT n_nationkey, n_name AS a, printf('%.9f', CAST(n_nationkey AS DOUBLE)) AS b, printf('%.9f', CAST(n_regionkey AS DOUBLE)) AS c FROM nation)""")
def row_fingerprint(spark, d):
    return profile.fingerprints(_t(spark, d, "nation"), ["n_nationkey"])


_MUTATED = "CASE WHEN s_suppkey % 10 = 0 THEN s_acctbal + 1 ELSE s_acctbal END"


@query(f"""WITH a AS (SELECT s_suppkey, s_acctbal FROM supplier), b AS (SELECT s_suppkey, {_MUTATED} AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT 'left' AS side, s_suppkey, s_acctbal, count(*) AS n FROM (FROM a EXCEPT ALL FROM b) GROUP BY ALL UNION ALL SELECT 'right', s_suppkey, s_acctbal, count(*) FROM (FROM b EXCEPT ALL FROM a) GROUP BY ALL""")
def multiset_diff(spark, d):
    a = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return steps.multiset_difference(a, a.where("s_suppkey % 7 <> 0").withColumn("s_acctbal", F.expr(_MUTATED)))


@query("""SELECT doc_id, left(text, k) || CASE WHEN strlen(left(text, k)) < least(12, strlen(text)) THEN '�' ELSE '' END AS cut, CAST(strlen(text) > 12 AS INT) AS was_cut, CAST(strlen(left(text, k)) < least(12, strlen(text)) OR contains(left(text, k), '�') AS INT) AS broken
FROM (SELECT doc_id, text, list_max(list_filter(range(0, 13), lambda i: strlen(left(text, i)) <= 12)) AS k FROM documents)""")
def byte_truncate_evidence(spark, d):
    cut = _t(spark, d, "documents").select("doc_id", "text", E.cut_bytes(F.col("text"), 12).alias("cut"))
    return cut.select("doc_id", "cut", E.flag(F.octet_length("text") > 12).alias("was_cut"), E.flag(F.contains("cut", F.lit("�"))).alias("broken"))


_AREAS = {"metal": ["steel", "brass", "copper", "nickel"], "colour": ["red", "blue", "green"], "finish": ["polished", "plated", "brushed"]}
_WEIGHTS = {"p_name": 3.0, "p_type": 0.25}


def _hits_sql(area: str) -> str:
    one = "len(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda w: {t}))"
    tests = {k: f"starts_with(w, '{k}')" if len(k) >= 5 else f"w IN ('{k}', '{k}s')" for k in _AREAS[area]}
    return " + ".join(f"{w} * {one.format(c=c, t=t)}" for c, w in _WEIGHTS.items() for t in tests.values())


@query(f"""WITH s AS (SELECT p_partkey, list_sort([{', '.join(f"{{'s': -({_hits_sql(a)}), 'a': '{a}'}}" for a in _AREAS)}]) AS r FROM part)
SELECT p_partkey, r[1].a AS best, CAST(-r[1].s AS DOUBLE) AS top, CAST(-r[2].s AS DOUBLE) AS runner_up, CASE WHEN -r[1].s < 0.25 OR r[1].s = r[2].s THEN 'Other' ELSE r[1].a END AS label,
CASE WHEN -r[1].s < 0.25 OR r[1].s = r[2].s THEN 'LOW' WHEN -r[1].s >= -2 * r[2].s THEN 'HIGH' ELSE 'MEDIUM' END AS confidence FROM s""")
def keyword_classify(spark, d):
    return classify.keyword_area(_t(spark, d, "part"), "p_partkey", _WEIGHTS, _AREAS, 0.25)


@query("""WITH l AS (SELECT doc_id, quality AS a, CAST(n_chars > 500 AS INT) AS b FROM labels JOIN documents USING (doc_id)), t AS (SELECT count(*) AS n, avg(CAST(a = b AS INT)) AS po, avg(a) AS pa, avg(b) AS pb FROM l)
SELECT n, round(100 * po, 1) AS agreement, round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 3) AS kappa FROM t""")
def kappa_agreement(spark, d):
    j = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").cast("int").alias("a"), (F.col("n_chars") > 500).cast("int").alias("b"))
    return kappa(j, "a", "b")


@query("SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN n END) AS F, sum(CASE WHEN o_orderstatus = 'O' THEN n END) AS O, sum(CASE WHEN o_orderstatus = 'P' THEN n END) AS P FROM (SELECT o_orderpriority, o_orderstatus, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def pivot_grid(spark, d):
    counted = _t(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").cast("double").alias("n"))
    return marts.grid(counted, "o_orderpriority", "o_orderstatus", "n", ["F", "O", "P"])


@query("SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS part, (SELECT count(*) FROM lineitem) AS whole, round(count(*) FILTER (l_discount > 0.05) / (SELECT count(*) FROM lineitem), 9) AS rate FROM lineitem GROUP BY 1")
def measures_rates(spark, d):
    return marts.filtered_rate(_t(spark, d, "lineitem"), ["l_returnflag"], F.col("l_discount") > 0.05, whole_over_all=True).withColumn("rate", F.round("rate", 9))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'Large' WHEN p_retailprice > 1500 OR p_size = 7 THEN 'Special' ELSE 'Plain' END AS label FROM part")
def rule_first_match(spark, d):
    rules = [(classify.Test("p_size", "gt", 40), "Large"), (classify.AnyOf((classify.Test("p_retailprice", "gt", 1500.0), classify.Test("p_size", "eq", 7))), "Special")]
    return _t(spark, d, "part").select("p_partkey", classify.first_rule(rules, "Plain").alias("label"))


@query("SELECT p_partkey, round(least(p_size / 20, 3) + 0.001 * p_retailprice, 2) AS score, CASE WHEN round(least(p_size / 20, 3) + 0.001 * p_retailprice, 2) >= 4 THEN 'Complex' WHEN round(least(p_size / 20, 3) + 0.001 * p_retailprice, 2) >= 3 THEN 'Moderate' ELSE 'Simple' END AS label FROM (SELECT p_partkey, p_size, round(p_retailprice / 10) * 10 AS p_retailprice FROM part)")
def rule_score_complexity(spark, d):
    part = _t(spark, d, "part").withColumn("p_retailprice", F.round(F.col("p_retailprice") / 10) * 10)
    return classify.complexity(part, "p_partkey", "p_size", {"p_retailprice": 0.001}, moderate=3.0, complex_=4.0).select("p_partkey", "score", "label")


@query("SELECT l_returnflag, l_linestatus, count(*) - 1 AS extra FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def extra_rows(spark, d):
    return steps.extra_rows(_t(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT c_mktsegment, arg_max(n_name, (k, -length(n_name))) AS best, max(k) AS top FROM (SELECT c_mktsegment, n_name, count(*) * 1000 + min(c_nationkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY 1")
def best_and_runner_up(spark, d):
    c = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("c_mktsegment", "n_name").agg((F.count("*") * 1000 + F.min("c_nationkey")).alias("k"))
    return steps.top_two(c, ["c_mktsegment"], "n_name", "k").select("c_mktsegment", "best", "top")


@query("SELECT o_orderpriority, round(100 * avg(CAST(o_orderstatus = 'F' AS INT)), 1) AS accuracy FROM orders GROUP BY 1")
def accuracy_by_group(spark, d):
    return marts.accuracy(_t(spark, d, "orders").withColumn("ok", F.col("o_orderstatus") == "F"), ["o_orderpriority"], "ok")


@query("SELECT a.user_id, a.event_type AS method_a, b.event_type AS method_b, a.n AS label_a, b.n AS label_b FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) a JOIN (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) b ON a.user_id = b.user_id AND a.event_type < b.event_type")
def method_pairs(spark, d):
    return marts.pairs(_t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")), "user_id", "event_type", "n")


@query("SELECT c_custkey, coalesce(nullif(rtrim(c_name), ''), '') AS clean, CAST(strlen(rtrim(c_name)) AS INT) AS n_bytes, upper(c_mktsegment) AS up, lower(c_mktsegment) AS low FROM customer")
def text_functions(spark, d):
    c = _t(spark, d, "customer")
    return c.select("c_custkey", F.coalesce(E.clean_text(F.col("c_name")), F.lit("")).alias("clean"), E.byte_length(F.col("c_name")).alias("n_bytes"), F.upper("c_mktsegment").alias("up"), F.lower("c_mktsegment").alias("low"))


@query("SELECT coalesce(a.s_suppkey, b.s_suppkey) AS s_suppkey, CASE WHEN b.s_suppkey IS NOT NULL THEN b.s_acctbal + 1 ELSE a.s_acctbal END AS s_acctbal FROM (FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (FROM supplier WHERE s_suppkey % 2 = 0) b ON a.s_suppkey = b.s_suppkey")
def match_merge(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return steps.merge(s.where("s_suppkey % 3 <> 0"), s.where("s_suppkey % 2 = 0").withColumn("s_acctbal", F.col("s_acctbal") + 1), ["s_suppkey"])


def _session(spark, d) -> Session:
    s = Session(Libraries(spark, {"stg": d}, files=("stg",)), row_order={"stg.lineitem": ["l_shipdate", "l_partkey", "l_suppkey"]})
    return s


_PROGRAM_CLEAN = """
/* bands; missing counts as low */
data out.clean(keep=c_custkey segment band high);
  set stg.customer;
  segment = lowcase(strip(c_mktsegment));
  high = (c_acctbal > 5000);
  if c_acctbal < 2000 then band = 'LOW';
  else if c_acctbal < 6000 then band = 'MEDIUM';
  else band = 'HIGH';
run;
"""


@query("SELECT c_custkey, lower(trim(c_mktsegment)) AS segment, CASE WHEN c_acctbal < 2000 THEN 'LOW' WHEN c_acctbal < 6000 THEN 'MEDIUM' ELSE 'HIGH' END AS band, CAST(c_acctbal > 5000 AS INT) AS high FROM customer")
def translated_program_clean(spark, d):
    return _session(spark, d).run(_PROGRAM_CLEAN)["out.clean"].select("c_custkey", "segment", "band", "high")


_PROGRAM_GROUPS = """
proc sort data=stg.lineitem out=work.one nodupkey; by l_orderkey l_linenumber; run;
data out.rows out.last(keep=l_orderkey cum top);
  set work.one;
  by l_orderkey;
  retain top;
  if first.l_orderkey then do; cum = 0; top = 0; end;
  cum + l_quantity;
  top = max(top, l_quantity);
  output out.rows;
  if last.l_orderkey then output out.last;
run;
"""


@query("SELECT l_orderkey, sum(l_quantity) AS cum, max(l_quantity) AS top FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1 GROUP BY 1")
def translated_program_groups(spark, d):
    return _session(spark, d).run(_PROGRAM_GROUPS)["out.last"].select("l_orderkey", F.col("cum").cast("double").alias("cum"), F.col("top").cast("double").alias("top"))


_PROGRAM_MACRO = """
%macro totals(ds=, class=, var=, out=);
  proc means data=&ds noprint nway; class &class; var &var; output out=&out(drop=_type_ _freq_) n=n sum=total; run;
%mend totals;
proc sql noprint; select distinct o_orderstatus into :list separated by ' ' from stg.orders order by o_orderstatus; quit;
%macro each;
  %local i s;
  %do i = 1 %to %sysfunc(countw(&list, %str( )));
    %let s = %scan(&list, &i, %str( ));
    data work.part_&s; set stg.orders; where o_orderstatus = "&s"; run;
    %totals(ds=work.part_&s, class=o_orderpriority, var=o_shippriority, out=out.sum_&s);
  %end;
%mend each;
%each;
"""


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def translated_program_macro(spark, d):
    made = _session(spark, d).run(_PROGRAM_MACRO.replace("o_shippriority", "o_custkey"))
    out = None
    for name in sorted(n for n in made if n.startswith("out.sum_")):
        rows = made[name].select(F.lit(name[-1].upper()).alias("o_orderstatus"), "o_orderpriority", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


_PROGRAM_ORDER = """
data out.late(rename=(l_orderkey=order_no) where=(cum > 60)) work.small(keep=l_orderkey l_linenumber);
  set stg.lineitem(keep=l_orderkey l_linenumber l_quantity l_discount where=(l_discount ge 0.02));
  by l_orderkey;
  if first.l_orderkey then do; cum = 0; n = 0; end;
  cum + l_quantity;
  if l_quantity < 10 then do; n + 1; output work.small; end;
  if last.l_orderkey;
  output out.late;
run;
"""


def _ordered(spark, d) -> Session:
    return Session(Libraries(spark, {"stg": d}, files=("stg",)), row_order={"stg.lineitem": ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]})


@query("SELECT l_orderkey AS order_no, CAST(sum(l_quantity) AS DOUBLE) AS cum, CAST(count(*) FILTER (l_quantity < 10) AS INT) AS n FROM lineitem WHERE l_discount >= 0.02 GROUP BY 1 HAVING sum(l_quantity) > 60")
def translated_program_order(spark, d):
    made = _ordered(spark, d).run(_PROGRAM_ORDER)["out.late"]
    return made.select("order_no", F.col("cum").cast("double").alias("cum"), F.col("n").cast("int").alias("n"))


_PROGRAM_SQL = """
data work.bal; set stg.customer; if c_custkey > 900 then bal = .; else bal = c_acctbal; run;
proc sql noprint;
  select max(n_nationkey) into :top trimmed from stg.nation;
  create table out.low as
    select n.n_name as nation, count(*) as n, sum(b.bal < 0) as below, count(distinct b.c_mktsegment) as kinds
    from work.bal as b inner join stg.nation as n on b.c_nationkey = n.n_nationkey
    where b.bal < 1000 and n.n_nationkey < &top and b.c_custkey > (select min(c_custkey) from stg.customer)
    group by calculated nation having count(*) > 1 order by n desc, nation;
quit;
"""


@query("SELECT n_name AS nation, count(*) AS n, CAST(sum(CAST(bal IS NULL OR bal < 0 AS INT)) AS BIGINT) AS below, count(DISTINCT c_mktsegment) AS kinds FROM (SELECT *, CASE WHEN c_custkey <= 900 THEN c_acctbal END AS bal FROM customer) JOIN nation ON c_nationkey = n_nationkey WHERE (bal IS NULL OR bal < 1000) AND n_nationkey < (SELECT max(n_nationkey) FROM nation) AND c_custkey > (SELECT min(c_custkey) FROM customer) GROUP BY 1 HAVING count(*) > 1")
def translated_program_sql(spark, d):
    return _session(spark, d).run(_PROGRAM_SQL)["out.low"]


_PROGRAM_TABLES = """
proc format; value size low-<10='SMALL' 10-<30='MIDDLE' 30-high='LARGE' other='NA'; run;
data work.sized; set stg.part; if p_size ne 7 then s = p_size; band = put(s, size.); run;
proc freq data=work.sized noprint; tables band*p_brand / out=out.bands; run;
"""


@query("WITH s AS (SELECT p_brand, CASE WHEN p_size = 7 THEN 'NA' WHEN p_size < 10 THEN 'SMALL' WHEN p_size < 30 THEN 'MIDDLE' ELSE 'LARGE' END AS band FROM part) SELECT band, p_brand, count(*) AS count, round(100 * count(*) / (SELECT count(*) FROM s), 9) AS percent FROM s GROUP BY ALL")
def translated_program_tables(spark, d):
    return _session(spark, d).run(_PROGRAM_TABLES)["out.bands"].withColumn("percent", F.round("percent", 9))


@query(ORACLE_SQL["ols_payment_model"])
def translated_program_reg(spark, d):
    out = _session(spark, d).run("proc reg data=stg.lineitem outest=out.model noprint; model l_extendedprice = l_quantity l_discount; run; quit;")["out.model"]
    return out.select(*[F.round(c, 3).alias(c) for c in out.columns])


@query(ORACLE_SQL["brown_forecast"])
def translated_program_forecast(spark, d):
    s = _session(spark, d)
    s.tables["work.monthly"] = _monthly(spark, d)
    out = s.run("proc forecast data=work.monthly method=expo trend=2 lead=12 out=out.fc outest=out.est; id month; var total; run;")["out.fc"]
    return out.withColumnRenamed("total", "y").withColumn("y", F.round("y", 3))


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM (SELECT o_orderkey, o_custkey FROM orders) LEFT JOIN (SELECT c_custkey AS o_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 = 0) USING (o_custkey)")
def keyed_lookup(spark, d):
    table = _t(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return steps.lookup(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), table, ["o_custkey"]).select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("SELECT s_suppkey, s_acctbal, 'old' AS run FROM supplier WHERE s_suppkey % 4 <> 0 UNION ALL SELECT s_suppkey, s_acctbal + 1, 'new' FROM supplier WHERE s_suppkey % 4 = 0")
def subset_replacement(spark, d):
    s = _t(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.lit("old").alias("run"))
    return steps.replace_subset(s, s.where("s_suppkey % 4 = 0").withColumns({"s_acctbal": F.col("s_acctbal") + 1, "run": F.lit("new")}), ["s_suppkey"])


@query("SELECT l_orderkey, arg_min(l_returnflag, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) AS best FROM lineitem GROUP BY 1")
def best_by_rank(spark, d):
    return steps.best_of(_t(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber"), ["l_orderkey"], "l_returnflag", ["R", "N", "A"], ["l_linenumber"]).select("l_orderkey", F.col("l_returnflag").alias("best"))


@query("SELECT o_orderkey, CAST(date_trunc('month', CAST(o_orderdate AS DATE)) + INTERVAL 3 MONTH AS DATE) AS due, round(o_totalprice * 0.01 / (1 - pow(1.01, -24)), 2) AS payment FROM (SELECT o_orderkey, o_orderdate, round(CAST(o_totalprice AS DOUBLE) / 100) * 100 AS o_totalprice FROM orders)")
def instalments(spark, d):
    rows = _t(spark, d, "orders").withColumn("p", F.round(F.col("o_totalprice").cast("double") / 100) * 100)
    return rows.select("o_orderkey", E.month_start(F.col("o_orderdate"), 3).alias("due"), F.round(E.annuity(F.col("p"), F.lit(0.01), F.lit(24)), 2).alias("payment"))


@query("SELECT p_partkey, array_to_string(list_filter(['steel', 'plated'], lambda r: (r = 'steel' AND regexp_matches(p_type, '(?i)steel')) OR (r = 'plated' AND regexp_matches(p_type, '(?i)\\bplated\\b'))), ',') AS rules FROM part")
def rule_triggers(spark, d):
    return classify.triggered(_t(spark, d, "part").select("p_partkey", "p_type"), "p_type", {"steel": "steel", "plated": r"\\bplated\\b"}).select("p_partkey", F.array_join("rules", ",").alias("rules"))


@query("SELECT id, n, CAST(n > 1 AS DOUBLE) AS flag, DATE '2024-01-01' + CAST(n AS INT) AS day FROM (SELECT r_regionkey AS id, CAST(r_regionkey AS DOUBLE) AS n FROM region)")
def typed_restore(spark, d):
    text = _t(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_regionkey").cast("string").alias("n"), (F.col("r_regionkey") > 1).cast("string").alias("flag"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("r_regionkey").cast("int")).cast("string").alias("day"))
    return E.apply_types(text, {"n": "double", "flag": "boolean", "day": "date"})
