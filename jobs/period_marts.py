"""Period marts: the status of each order, summaries by period, segment and balance band, and a forecast by segment.

The steps that such programs take by hand, as one plan: repeated lines go (first of each key), quantities of each
order add up to its status, customers get a band in which a missing balance counts as low, months are summed up, and
their totals are carried forward. Tables are partitioned by period; a run for some periods replaces these and leaves the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import LOG, command_line, default_settings
from stepframe.functions import expr as E
from stepframe.functions.stats import brown, forecast_rows
from stepframe.operators import steps
from stepframe.sources.shared import new_folder, remove

NAME = "period_marts"
STATUS = "o_orderkey long, segment string, band string, order_month date, total decimal(18,2), high_flag int, n_lines long, quantity decimal(18,2), largest decimal(18,2), period_id string"
SUMMARY = "segment string, band string, n_orders long, n_without_lines long, n_high long, total decimal(28,2), quantity decimal(28,2), largest decimal(18,2), period_id string"
CHECKS = "check string, expected_value string, actual_value string, passed boolean"


def order_status(orders: DataFrame, lines: DataFrame, customers: DataFrame, config: dict) -> DataFrame:
    """A row for each order: segment and band of its customer, month, total, high_flag, and the lines' number, sum and largest quantity.

    Lines of equal (order, line number) count once: the first by ship date, part and supplier. An order without lines has 0, one whose
    customer is unknown has no segment and the band of a missing balance. Missing quantities add nothing; orders without
    a date are in period 000000.
    """
    keys = ["l_orderkey", "l_linenumber"]
    # Dealt by order, lines need no other shuffle to lose their repetitions, to be added up and to meet their orders.
    dealt = lines.select(*keys, "l_shipdate", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey")
    first = steps.first_of_key(dealt, keys, ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity"]).withColumn("l_quantity", F.col("l_quantity").cast("decimal(18,2)"))
    status = first.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum(F.coalesce("l_quantity", F.lit(0))).alias("quantity"), F.greatest(F.max("l_quantity"), F.lit(0)).alias("largest"))
    band = E.chain([(E.compare(F.col("c_acctbal"), op, F.lit(v)), F.lit(label)) for op, v, label in config["bands"]], F.lit(config["top_band"]))
    known = steps.lookup(orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice"), customers.select("c_custkey", "c_mktsegment", "c_acctbal"), ["c_custkey"])
    rows = known.join(status, "o_orderkey", "left")
    nothing = F.lit(0).cast("decimal(18,2)")
    return rows.select(
        "o_orderkey", F.col("c_mktsegment").alias("segment"), band.alias("band"), E.month_start(F.col("o_orderdate")).alias("order_month"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"), E.flag(F.col("o_totalprice") > config["high_total"]).alias("high_flag"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce(F.col("quantity").cast("decimal(18,2)"), nothing).alias("quantity"), F.coalesce(F.col("largest").cast("decimal(18,2)"), nothing).alias("largest"), F.coalesce(E.year_month(F.col("o_orderdate")), F.lit("000000")).alias("period_id"),
    )


def summaries(status: DataFrame) -> DataFrame:
    """Orders, totals and quantities by period, segment and band."""
    return status.groupBy("segment", "band", "period_id").agg(F.count("*").alias("n_orders"), F.count_if(F.col("n_lines") == 0).alias("n_without_lines"), F.sum("high_flag").alias("n_high"), F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(28,2)").alias("total"), F.sum("quantity").cast("decimal(28,2)").alias("quantity"), F.max("largest").alias("largest"))


def _write(df: DataFrame, path: str, periods: list[str]) -> int:
    """Replace the periods (all, if none are named) of a partitioned table; gives the rows written.

    Partitions are overwritten as the write commits; a named period that has no rows any more is removed after that. Rows of a
    period are brought together, so files are as many as the rows need and not one for each task and period; a large period has several tasks.
    """
    spark, seen = df.sparkSession, Observation()
    df.hint("rebalance", "period_id").observe(seen, F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("period_id").isin(periods), F.col("period_id"))).alias("periods")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if periods else "static").partitionBy("period_id").parquet(path)
    for gone in sorted(set(periods) - set(seen.get["periods"])):
        remove(spark, f"{path}/period_id={gone}")
    return seen.get["n"]


def read(spark: SparkSession, target: str, table: str) -> DataFrame:
    """A table of a target: status, summary, forecast or checks."""
    kinds = {"status": STATUS, "summary": SUMMARY, "checks": CHECKS, "forecast": "segment string, month date, _type_ string, _lead_ int, y double"}
    return spark.read.schema(kinds[table]).parquet(f"{target}/{table}")


def run(spark: SparkSession, source: str, target: str, config: dict | None = None) -> dict[str, int]:
    """Build the marts of ``source``'s orders, lineitem and customer in ``target``; gives the rows written by table.

    ``periods`` of the settings (yyyyMM) are built anew, all if empty; the forecast always takes every period that the summary then has.
    The same input gives the same tables however often it is run. Checks hold the written summary against the orders read;
    the run fails if one doesn't pass. An empty source leaves empty tables.
    """
    config = config or default_settings(NAME)
    periods = [str(p) for p in config["periods"]]
    orders, lines, customers = (spark.read.parquet(f"{source}/{t}.parquet") for t in ("orders", "lineitem", "customer"))
    if periods:
        orders = orders.where(F.coalesce(E.year_month(F.col("o_orderdate")), F.lit("000000")).isin(periods))
        lines = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    wrote = {"status": _write(order_status(orders, lines, customers, config), f"{target}/status", periods)}
    some = F.col("period_id").isin(periods) if periods else F.lit(True)
    wrote["summary"] = _write(summaries(read(spark, target, "status").where(some)), f"{target}/summary", periods)

    want = orders.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), F.lit(0)).cast("decimal(28,2)").alias("t"))
    got = read(spark, target, "summary").where(some).agg(F.coalesce(F.sum("n_orders"), F.lit(0)).alias("gn"), F.coalesce(F.sum("total"), F.lit(0)).cast("decimal(28,2)").alias("gt"))
    pairs = [("orders", "n", "gn"), ("total", "t", "gt")]
    checks = want.crossJoin(got).select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(a).cast("string").alias("expected_value"), F.col(b).cast("string").alias("actual_value"), (F.col(a) == F.col(b)).alias("passed")) for name, a, b in pairs])).alias("x")).select("x.*")
    checks.coalesce(1).write.mode("overwrite").parquet(f"{target}/checks")

    f = config["forecast"]
    monthly = read(spark, target, "summary").where("period_id <> '000000' and segment is not null").groupBy("segment", F.to_date("period_id", "yyyyMM").alias("month")).agg(F.sum("total").cast("double").alias("total"))
    forecast = forecast_rows(brown(monthly, "month", "total", ["segment"], f["weight"], f["nstart"], f["lead"]), ["segment"])
    seen = Observation()
    forecast.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").partitionBy("segment").parquet(f"{target}/forecast")
    wrote["forecast"] = seen.get["n"]
    failed = [r.check for r in read(spark, target, "checks").where("not passed").collect()]
    for table, n in wrote.items():
        LOG.info("%s: read %s/{orders,lineitem,customer}.parquet, wrote %d rows to %s/%s", NAME, source, n, target, table)
    if failed:
        raise RuntimeError(f"{target}: checks failed: {', '.join(failed)}")
    return wrote


def job2_period_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_folder(spark, "period-marts")
    run(spark, sf_dir, target)
    run(spark, sf_dir, target)
    money = {c: F.col(c).cast("double") for c in ("total", "quantity", "largest")}
    return read(spark, target, "summary").withColumns(money)


JOB2_SQL = """WITH one AS (SELECT l_orderkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem) WHERE k = 1),
s AS (SELECT l_orderkey, count(*) AS n_lines, sum(CAST(l_quantity AS DECIMAL(18,2))) AS quantity, max(l_quantity) AS largest FROM one GROUP BY 1)
SELECT c_mktsegment AS segment, CASE WHEN c_acctbal IS NULL OR c_acctbal < 2000 THEN 'LOW' WHEN c_acctbal < 6000 THEN 'MEDIUM' ELSE 'HIGH' END AS band, strftime(o_orderdate, '%Y%m') AS period_id, count(*) AS n_orders, count(*) FILTER (n_lines IS NULL) AS n_without_lines, count(*) FILTER (o_totalprice > 200000) AS n_high,
CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(sum(coalesce(quantity, 0)) AS DOUBLE) AS quantity, CAST(max(coalesce(largest, 0)) AS DOUBLE) AS largest
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY ALL"""

if __name__ == "__main__":
    command_line(NAME, "Build order status, period summaries and forecasts.", run)
