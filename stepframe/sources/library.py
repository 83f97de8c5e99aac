"""Libraries of tables, delimited and Parquet sources, sinks and parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import annuity, clean_text, cut_bytes


@dataclass
class Libraries:
    """Names of the form library.table. A library is a folder; ``work`` and one-part names are kept in memory, lazily.

    ``files``: libraries whose tables are single files ``<table>.parquet``; others are folders ``<table>``.
    """

    spark: SparkSession
    folders: dict[str, str]
    files: tuple[str, ...] = ()
    work: dict[str, DataFrame] = field(default_factory=dict)

    def split(self, name: str) -> tuple[str, str]:
        lib, _, table = name.lower().rpartition(".")
        return lib or "work", table

    def path(self, name: str) -> str:
        lib, table = self.split(name)
        return f"{self.folders[lib]}/{table}{'.parquet' if lib in self.files else ''}"

    def read(self, name: str) -> DataFrame:
        lib, table = self.split(name)
        if lib == "work":
            return self.work[table]
        df = self.spark.read.parquet(self.path(name))
        return df.toDF(*[c.lower() for c in df.columns])

    def save(self, name: str, df: DataFrame, verify: bool = False) -> DataFrame:
        """Overwrite the table; gives what was written, or the check rows of a read-back if ``verify``."""
        lib, table = self.split(name)
        if lib == "work":
            self.work[table] = df
            return df
        df.write.mode("overwrite").parquet(self.path(name))
        back = self.spark.read.parquet(self.path(name))
        if verify:
            from ..operators.profile import reconcile

            return reconcile(name, df, back)
        return back

    def save_by(self, name: str, df: DataFrame, key: str) -> None:
        """One job for all values of a key; a reader of one value reads that folder only."""
        df.write.mode("overwrite").partitionBy(key).parquet(self.path(name))


def read_delimited(spark: SparkSession, path: str, schema: str, delimiter: str = ",", header: bool = True, encoding: str = "UTF-8", widths: dict[str, int] | None = None) -> DataFrame:
    """Typed delimited text: quoted delimiters, short rows filled with missing, dates as yyyy-MM-dd.

    ``widths`` cuts columns at so many bytes. Texts lose trailing blanks; empty texts are missing.
    """
    df = spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE").option("sep", delimiter).option("dateFormat", "yyyy-MM-dd").option("encoding", encoding).csv(path)
    texts = {c: cut_bytes(F.col(c), (widths or {})[c]) if c in (widths or {}) else F.col(c) for c, t in df.dtypes if t == "string"}
    return df.withColumns({c: clean_text(x) for c, x in texts.items()}) if texts else df


def write_delimited(df: DataFrame, path: str) -> None:
    """UTF-8 with a header; line breaks in texts become a space, quotes in them are doubled, blanks at their ends stay."""
    texts = {c: F.regexp_replace(c, "[\\r\\n]+", " ") for c, t in df.dtypes if t == "string"}
    (df.withColumns(texts) if texts else df).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def read_runs(spark: SparkSession, glob: str, kind: str, schema: str) -> DataFrame:
    """All files <kind>_<method>_run<k>.csv; method and run come from the names."""
    df = spark.read.schema(schema).option("header", True).csv(glob)
    name = F.col("_metadata.file_name")
    pattern = f"^{kind}_(.+)_run(\\d+)\\.csv$"
    return df.select("*", F.regexp_extract(name, pattern, 1).alias("method"), F.regexp_extract(name, pattern, 2).cast("int").alias("run"))


def parameter(control: DataFrame, name: str, kind: str = "double") -> Column:
    """A text setting as a typed scalar subquery; a text that doesn't fit fails."""
    value = control.where(F.col("param_name") == name).select(F.max("param_value").alias("v"))
    return value.select(F.when(F.col("v").isNotNull() & F.col("v").try_cast(kind).isNull(), F.raise_error(F.lit(f"{name} is not a {kind}"))).otherwise(F.col("v").try_cast(kind)).alias("v")).scalar()


def listed(df: DataFrame, column: str, order: str | None = None, most: int = 10_000) -> list:
    """An ordered list of a control table's values, for table names only known at run time; more than ``most`` are refused."""
    rows = df.select(column).orderBy(order or column).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} values of {column}")
    return [r[0] for r in rows]


def make_loans(spark: SparkSession, customers: int = 50, months: int = 24, seed: int = 42) -> dict[str, DataFrame]:
    """The seven made tables of a small lender, with the usual traps planted; values follow from ids and the seed by hash, so they are
    alike in any partitioning and grow with ``customers`` and ``months``.

    Traps: accented and long names, a city with an apostrophe, provinces in lower case, missing incomes (each 33rd customer), an orphan
    loan (7), one repeated payment key whose copies differ (loan 3, the fifth month), late payments, negative and zero
    amounts of cards (each 200th and each 1000th), settings held as text, and periods of which the last four are active.
    """

    def h(c, n, salt):
        return F.pmod(F.xxhash64(F.col(c), F.lit(salt + seed)), F.lit(n))

    def pick(c, salt, values):
        return F.element_at(F.array(*map(F.lit, values)), (1 + h(c, len(values), salt)).cast("int"))

    first = F.lit("2022-01-01").cast("date")
    codes = ["BASE", "PLUS", "YOUNG", "SENIOR", "FIRM"]
    c = spark.range(1, customers + 1).withColumnRenamed("id", "customer_id")
    c = c.select(
        "customer_id", F.concat(F.lit("Ève-Béatrice O'Neill "), F.col("customer_id").cast("string")).alias("customer_name"), pick("customer_id", 6, ["Orford", "L'Avenir", "Saint-Élie", "Val-d'Or"]).alias("city"), F.lit("qc").alias("province"), pick("customer_id", 7, codes).alias("segment_code"),
        F.when(F.col("customer_id") % 33 == 0, None).otherwise((8000 + h("customer_id", 200_000, 1)).cast("double")).alias("annual_income"), F.date_add(F.lit("2010-01-01").cast("date"), h("customer_id", 4000, 8).cast("int")).alias("customer_since"),
    )
    n = spark.range(1, 2 * customers + 1).withColumnRenamed("id", "loan_id")
    n = n.select(
        "loan_id", F.when(F.col("loan_id") == 7, 10**6).otherwise(1 + h("loan_id", customers, 2)).cast("long").alias("customer_id"), pick("loan_id", 9, ["home", "car", "study"]).alias("loan_type"), F.add_months(first, -h("loan_id", 36, 10).cast("int")).alias("origination_date"),
        (5000 + h("loan_id", 90_000, 3)).cast("double").alias("principal"), ((2 + h("loan_id", 5, 4)) / 100).alias("interest_rate"), (12 * (1 + h("loan_id", 5, 5))).cast("double").alias("term_months"), pick("loan_id", 11, ["open", "closed", "frozen"]).alias("status"),
    ).withColumn("monthly_payment", F.round(annuity(F.col("principal"), F.col("interest_rate") / 12, F.col("term_months")), 2))
    p = n.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(months - 1)))).withColumn("interest_paid", F.round(F.col("principal") * F.col("interest_rate") / 12, 2))
    p = p.select("loan_id", F.add_months(first, F.col("m")).alias("payment_date"), F.round(F.col("interest_paid") + 100, 2).alias("payment_amount"), F.lit(100.0).alias("principal_paid"), "interest_paid", F.element_at(F.array(F.lit(0.0), F.lit(0.0), F.lit(15.0), F.lit(45.0)), (1 + F.pmod(F.xxhash64("loan_id", "m", F.lit(seed)), F.lit(4))).cast("int")).alias("days_past_due"))
    p = p.unionByName(p.where("loan_id = 3 and payment_date = date'2022-05-01'").withColumn("payment_amount", F.lit(1.0)))
    t = spark.range(1, 10 * customers + 1).withColumnRenamed("id", "transaction_id")
    amount = F.when(F.col("transaction_id") % 1000 == 0, 0.0).when(F.col("transaction_id") % 200 == 0, -(1 + h("transaction_id", 20_000, 12)) / 100).otherwise((1 + h("transaction_id", 60_000, 12)) / 100)
    t = t.select("transaction_id", (1 + h("transaction_id", customers, 13)).alias("customer_id"), F.date_add(F.lit("2025-01-01").cast("date"), h("transaction_id", 365, 14).cast("int")).alias("transaction_date"), pick("transaction_id", 15, ["food", "fuel", "travel", "health", "home", "other"]).alias("merchant_category"), amount.alias("amount"), (h("transaction_id", 100, 16) == 0).cast("double").alias("fraud_flag"))
    segments = [(code, f"Clientèle {code.lower()}", band, low, low + 40_000.0) for code, band, low in zip(codes, ["B", "A", "C", "A", "D"], [0.0, 40_000.0, 0.0, 20_000.0, 60_000.0])]
    last = spark.range(max(0, months - 12), months).select(F.add_months(first, F.col("id").cast("int")).alias("period_start"), (F.col("id") >= months - 4).cast("double").alias("active_flag"))
    return {
        "customers": c, "loans": n, "loan_payments": p, "card_transactions": t,
        "client_segments": spark.createDataFrame(segments, "segment_code string, segment_name string, risk_band string, min_income double, max_income double"),
        "reporting_periods": last.select(F.date_format("period_start", "yyyyMM").alias("period_id"), "period_start", F.date_format("period_start", "yyyy-MM").alias("period_label"), "active_flag"),
        "macro_parameters": spark.createDataFrame([("DPD_THRESHOLD", "30"), ("FRAUD_MIN_AMOUNT", "400"), ("HIGH_PRINCIPAL", "60000")], "param_name string, param_value string"),
    }
