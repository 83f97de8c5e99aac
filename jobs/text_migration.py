"""Incremental migration of text tables to typed, partitioned Parquet, with proof of what arrived.

Files that came since the last run are taken up by a file stream with a checkpoint, cleaned, measured against the byte
widths that the old tables declared, and written by batch and language. Each batch is read back and held against what was
read: rows, bytes and an order-free sum of row fingerprints. Widths report which columns would have been cut, and how many cuts would
split a character, so that too small a width is found before it loses text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs.common import LOG, command_line, default_settings
from stepframe.functions.expr import clean_text, cut_bytes, flag, row_hash
from stepframe.sources.shared import new_folder

NAME = "text_migration"
BROKEN = "�"


def migrated(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Cleaned columns, ``n_chars``, ``n_bytes`` of the text, ``<column>_wide`` and ``<column>_split`` (0/1), and ``fingerprint``.

    Trailing blanks go and empty texts are missing, which also holds for the language. ``_wide``: more bytes than the declared width;
    ``_split``: the cut there would leave half a character. A missing text is neither. The text itself is never cut.
    """
    cleaned = rows.select(*[clean_text(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in rows.schema.fields])
    sized = {"n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")}
    for c, n in widths.items():
        kept = cut_bytes(F.col(c), n)
        sized[f"{c}_wide"] = flag(F.octet_length(c) > n)
        sized[f"{c}_split"] = flag((F.octet_length(c) > n) & ~F.startswith(F.col(c), kept))
    return cleaned.withColumns(sized | {"fingerprint": row_hash(cleaned)})


def _totals(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """One row for each language; ``prints`` sums parts of the fingerprints, so that row order doesn't matter and repeated rows count."""
    part = F.conv(F.substring("fingerprint", 1, 15), 16, 10).cast("decimal(38,0)")
    marks = [F.sum(f"{c}_{k}").alias(f"{c}_{k}") for c in widths for k in ("wide", "split")]
    return rows.groupBy("lang").agg(F.count("*").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"), F.sum(part).alias("prints"), *marks)


def _proved(written: DataFrame, read: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Totals of what was written by language, and ``passed``: what was read has the same rows, bytes and fingerprints."""
    want = read.select(F.col("lang").alias("_lang"), F.col("n_rows").alias("_rows"), F.col("n_bytes").alias("_bytes"), F.col("prints").alias("_prints"))
    both = _totals(written, widths).join(want, F.col("lang").eqNullSafe(F.col("_lang")), "full_outer")
    same = F.col("n_rows").eqNullSafe(F.col("_rows")) & F.col("n_bytes").eqNullSafe(F.col("_bytes")) & F.col("prints").eqNullSafe(F.col("_prints"))
    return both.select(F.coalesce("lang", "_lang").alias("lang"), *[c for c in _totals(written, widths).columns if c != "lang"], F.col("_rows").alias("rows_read"), same.alias("passed"))


def run(spark: SparkSession, source: str, target: str, config: dict | None = None) -> dict[str, int]:
    """Take up the files of ``source``/documents.parquet that are new since the last run into ``target``; gives batches and rows taken.

    ``target`` gets rows (by batch and language), proofs (by batch) and checkpoint. A batch that a lost run left half done is done again with
    the same files and overwrites its own partitions only. A batch whose proof fails ends the run with an error and is done again next
    time. An empty or unchanged source takes nothing. Repeated rows stay as they are; columns that the settings don't name aren't read.
    """
    config = config or default_settings(NAME)
    widths, done = config["width_columns"], {"batches": 0, "rows": 0}
    # A pattern, since a stream from a plain path takes a folder only, and a table may be one file.
    files = f"{source}/documents.parque[t]"
    stream = spark.readStream.schema(config["columns"]).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(files)

    def batch(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        here = migrated(rows, widths).withColumn("batch", F.lit(number).cast("long"))
        own = {"partitionOverwriteMode": "dynamic"}
        here.write.mode("overwrite").options(**own).partitionBy("batch", "lang").parquet(f"{target}/rows")
        written = rows_of(session, target, config).where(F.col("batch") == number)
        proof = _proved(written, _totals(here, widths), widths).withColumn("batch", F.lit(number).cast("long"))
        proof.coalesce(1).write.mode("overwrite").options(**own).partitionBy("batch").parquet(f"{target}/proofs")
        n, failed = session.read.parquet(f"{target}/proofs").where(F.col("batch") == number).agg(F.coalesce(F.sum("n_rows"), F.lit(0)), F.count_if(~F.col("passed"))).first()
        if failed:
            raise RuntimeError(f"batch {number}: what was written to {target}/rows differs from what was read in {failed} languages")
        done["batches"] += 1
        done["rows"] += n
        LOG.info("batch %d: read %d rows of %s/documents.parquet, wrote them to %s/rows; read back and proved", number, n, source, target)

    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("%s: %d rows in %d new batches", target, done["rows"], done["batches"])
    return done


def rows_of(spark: SparkSession, target: str, config: dict | None = None) -> DataFrame:
    """All rows that a target has, with their batch."""
    config = config or default_settings(NAME)
    marks = [f"{c}_{k} int" for c in config["width_columns"] for k in ("wide", "split")]
    return spark.read.schema(", ".join([config["columns"], "n_chars long", "n_bytes long", *marks, "fingerprint string", "batch long"])).parquet(f"{target}/rows")


def job1_text_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = new_folder(spark, "text-migration")
    run(spark, sf_dir, target)
    run(spark, sf_dir, target)
    return rows_of(spark, target).select("doc_id", "lang", "source", "n_chars", "n_bytes", "text_wide", "text_split", "source_wide", "source_split", "fingerprint")


def _marks_sql(c: str, n: int) -> str:
    # A cut splits a character if the byte after it goes on with one: bytes 128 to 191 do.
    return f"CAST(coalesce(strlen({c}) > {n}, false) AS INT) AS {c}_wide, CAST(coalesce(strlen({c}) > {n} AND substr(hex(encode({c})), {2 * n + 1}, 1) IN ('8', '9', 'A', 'B'), false) AS INT) AS {c}_split"


JOB1_SQL = f"""WITH c AS (SELECT doc_id, nullif(rtrim(text, ' '), '') AS text, nullif(rtrim(lang, ' '), '') AS lang, nullif(rtrim(source, ' '), '') AS source FROM documents),
k AS (SELECT *, coalesce(printf('%.9f', CAST(doc_id AS DOUBLE)), '<NULL>') AS a, coalesce(lang, '<NULL>') AS b, coalesce(source, '<NULL>') AS d, coalesce(text, '<NULL>') AS e FROM c)
SELECT doc_id, lang, source, coalesce(length(text), 0) AS n_chars, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, {_marks_sql('text', 2000)}, {_marks_sql('source', 12)},
sha256(concat_ws('|', length(a) || ':' || a, length(b) || ':' || b, length(d) || ':' || d, length(e) || ':' || e)) AS fingerprint FROM k"""

if __name__ == "__main__":
    command_line(NAME, "Take new documents into a partitioned table, with proof of what arrived.", run)
