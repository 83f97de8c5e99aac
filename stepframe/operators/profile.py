"""Profiles, row fingerprints and reconciliation of two tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import row_hash
from .order import spread

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
CHECK = "table string, column string, check string, expected_value string, actual_value string, passed boolean"


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: null_count, distinct, sum, min, max (of numbers), max_chars, max_bytes, bad_text (U+FFFD).

    One aggregation over all columns, turned into rows. Distinct texts are counted by 128-bit hashes, so no text is
    shuffled; two texts would have to share both halves to count as one.
    """
    aggs, rows = [], []
    for i, (name, kind) in enumerate(df.dtypes):
        c = F.col(f"`{name}`")
        is_number, is_text = kind.startswith(_NUMBERS), kind == "string"
        null = F.lit(None)
        aggs += [
            F.count_if(c.isNull()).alias(f"a{i}"), F.countDistinct(F.when(c.isNotNull(), F.struct(F.xxhash64(c), F.xxhash64(F.lit(i), c))) if is_text else c).alias(f"b{i}"),
            (F.sum(c.cast("double")) if is_number else F.max(null.cast("double"))).alias(f"c{i}"),
            (F.min(c.cast("double")) if is_number else F.max(null.cast("double"))).alias(f"d{i}"), (F.max(c.cast("double")) if is_number else F.max(null.cast("double"))).alias(f"e{i}"),
            (F.max(F.length(c)) if is_text else F.max(null.cast("int"))).alias(f"f{i}"), (F.max(F.octet_length(c)) if is_text else F.max(null.cast("int"))).alias(f"g{i}"),
            (F.count_if(F.contains(c, F.lit("�"))) if is_text else F.max(null.cast("bigint"))).alias(f"h{i}"),
        ]
        rows.append(f"'{name}', a{i}, b{i}, c{i}, d{i}, e{i}, f{i}, g{i}, h{i}")
    return df.agg(*aggs).selectExpr(f"stack({len(rows)}, {', '.join(rows)}) as (column, null_count, distinct_count, sum, min, max, max_chars, max_bytes, bad_text)")


def fingerprints(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return df.select(*(keys or []), row_hash(df).alias("fingerprint"))


def _check(table: str, column, name, expected, actual, passed):
    return F.struct(F.lit(table).alias("table"), column.alias("column"), name.alias("check"), expected.cast("string").alias("expected_value"), actual.cast("string").alias("actual_value"), F.coalesce(passed, F.lit(False)).alias("passed"))


def reconcile(name: str, expected: DataFrame, actual: DataFrame, tolerance: float = 1e-6, rounding: int | None = None) -> DataFrame:
    """Check rows of two tables: rows, columns, types, each column's profile, and the multiset of row fingerprints.

    Numbers agree within ``tolerance``, absolute or relative. Row order doesn't matter. Fingerprints of the columns that
    both have are counted, so a lost duplicate shows. ``rounding`` rounds numbers before they are fingerprinted.
    """
    spark = expected.sparkSession
    left, right = sorted(expected.columns), sorted(actual.columns)
    kinds, other = dict(expected.dtypes), dict(actual.dtypes)
    both = [c for c in left if c in other]
    static = [(name, "*", "columns", ",".join(left), ",".join(right), left == right)]
    static += [(name, c, "type", kinds[c], other[c], kinds[c] == other[c]) for c in both]
    static += [(name, c, "missing column", "present", "absent", False) for c in left if c not in other]
    out = [spark.createDataFrame(static, CHECK)]
    n = expected.agg(F.count("*").alias("a")).crossJoin(actual.agg(F.count("*").alias("b")))
    out.append(n.select(_check(name, F.lit("*"), F.lit("row_count"), F.col("a"), F.col("b"), F.col("a") == F.col("b")).alias("x")).select("x.*"))
    if both:
        # Rows of one small file would count the distinct values of all its columns in one task.
        a, b = profile(spread(expected.select(*both))), profile(spread(actual.select(*both)))
        m = a.alias("a").join(b.alias("b"), "column")
        checks = []
        for c in ("null_count", "distinct_count", "sum", "min", "max", "max_chars", "max_bytes", "bad_text"):
            x, y = F.col(f"a.{c}"), F.col(f"b.{c}")
            near = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)), F.lit(False))
            checks.append(_check(name, F.col("column"), F.lit(c), x, y, near))
        out.append(m.select(F.explode(F.array(*checks)).alias("x")).select("x.*").where("expected_value is not null or actual_value is not null"))

        def prints(df):
            kind = dict(df.dtypes)
            cols = [F.round(F.col(f"`{c}`"), rounding).alias(c) if rounding is not None and kind[c] in ("double", "float") else F.col(f"`{c}`") for c in both]
            picked = df.select(*cols)
            return picked.select(row_hash(picked).alias("h"))

        counted = prints(expected).withColumn("d", F.lit(1)).unionByName(prints(actual).withColumn("d", F.lit(-1))).groupBy("h").agg(F.sum("d").alias("d"))
        sides = counted.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("a"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("b"))
        out += [sides.select(_check(name, F.lit("*"), F.lit(check), F.lit(0), F.col(c), F.col(c) == 0).alias("x")).select("x.*") for check, c in (("rows only in expected", "a"), ("rows only in actual", "b"))]
    return reduce(DataFrame.unionByName, out)


def with_expectation(checks: DataFrame, expected_to_pass: bool = True) -> DataFrame:
    return checks.withColumns({"expected_to_pass": F.lit(expected_to_pass), "as_expected": F.col("passed") == F.lit(expected_to_pass)})


def validate(name: str, expected: DataFrame, actual: DataFrame, columns: list[str] | None = None, allow: tuple[str, list[str]] | None = None, planted: list[tuple[str, DataFrame, str]] | None = None) -> DataFrame:
    """Reconcile the reproducible part (columns, and rows whose text column is in a list) and add planted checks.

    planted: (check, one-row table with a count, expected count).
    """

    def part(df):
        if allow:
            df = df.where(F.upper(F.col(allow[0])).isin([v.upper() for v in allow[1]]))
        return df.select(*columns) if columns else df

    out = reconcile(name, part(expected), part(actual))
    for check, table, want in planted or []:
        got = F.col(table.columns[0])
        out = out.unionByName(table.select(_check(name, F.lit("*"), F.lit(f"planted_{check}"), F.lit(want), got, got.cast("string") == want).alias("x")).select("x.*"))
    return out


def library_status(status: DataFrame, includes: DataFrame) -> DataFrame:
    """A program without tables of its own (status null) is VALIDATED if all that include it are, else MANUAL_REVIEW."""
    users = includes.join(status, "program_id").groupBy(F.col("included").alias("program_id")).agg(F.bool_and(F.coalesce(F.col("status") == "VALIDATED", F.lit(False))).alias("_all"))
    out = status.join(users, "program_id", "left")
    return out.select("program_id", F.coalesce("status", F.when(F.col("_all"), "VALIDATED").otherwise("MANUAL_REVIEW")).alias("status"))
