"""Delimited records read byte for byte, typed by layouts; tables written with a manifest of labels and widths."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import clean_text

#: One character for each byte, so that nothing is lost on the way from a file's bytes to a field's.
BYTEWISE = "ISO-8859-1"
ENCODINGS = {"utf-8": "UTF-8", "utf8": "UTF-8", "latin1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "us-ascii": "US-ASCII", "ascii": "US-ASCII"}
#: How texts are read as numbers and dates: the type, and the format of a date.
INFORMATS = {"best": ("double", None), "comma": ("double", None), "yymmdd": ("date", "yyyy-MM-dd"), "mmddyy": ("date", "MM/dd/yyyy"), "ddmmyy": ("date", "dd/MM/yyyy"), "date": ("date", "ddMMMyyyy")}


@dataclass(frozen=True)
class Field:
    """A column of a record: a text of at most ``width`` bytes (None: any), or a number or date by its informat."""

    name: str
    text: bool = False
    width: int | None = None
    informat: str = "best"


def decoded(raw: Column, encoding: str, width: int | None = None) -> Column:
    """Text from bytes, cut at ``width`` bytes first; half characters and bytes that UTF-8 doesn't have become U+FFFD. Trailing blanks go,
    an empty text is missing."""
    name = ENCODINGS.get(encoding.lower())
    if name is None:
        raise ValueError(f"encoding {encoding}")
    raw = raw if width is None else F.substring(raw, 1, width)
    return clean_text(F.make_valid_utf8(raw.cast("string")) if name == "UTF-8" else F.decode(raw, name))


def read_records(spark: SparkSession, path: str, fields: list[Field], encoding: str = "utf-8", delimiter: str = ",", header: bool = True) -> DataFrame:
    """Records of delimited files: quoted delimiters, doubled quotes, short records filled with missing, long ones cut.

    Spark's reader splits files at record ends, taking one character for each byte; the bytes of each field are then cut and decoded
    on their own, so a half character spoils one field and no more. ``header``: the first record of each file is left
    out. A text that is no number or date of its informat is missing.
    """
    schema = ", ".join(f"`{f.name}` string" for f in fields)
    options = {"encoding": BYTEWISE, "header": header, "enforceSchema": True, "mode": "PERMISSIVE", "sep": delimiter, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows = spark.read.schema(schema).options(**options).csv(path)

    def typed(f: Field) -> Column:
        raw = F.encode(F.col(f"`{f.name}`"), BYTEWISE)
        if f.text:
            return decoded(raw, encoding, f.width)
        kind, form = INFORMATS[f.informat]
        text = F.trim(F.col(f"`{f.name}`"))
        if form:
            return F.to_date(F.try_to_timestamp(F.nullif(text, F.lit("")), F.lit(form)))
        return F.nullif(F.translate(text, ",$", "") if f.informat == "comma" else text, F.lit("")).try_cast(kind)

    return rows.select(*[typed(f).alias(f.name) for f in fields])


def write_records(df: DataFrame, path: str, encoding: str = "utf-8", header: bool = True) -> None:
    """Delimited text with quotes where they are needed; a character that the encoding lacks becomes its mark for that."""
    df.write.mode("overwrite").options(header=header, encoding=ENCODINGS[encoding.lower()], escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


MANIFEST = "_manifest"


def write_with_manifest(df: DataFrame, path: str, labels: dict[str, dict] | None = None) -> None:
    """A Parquet table whose columns keep their labels, formats and widths, and beside it a manifest of them in JSON.

    Spark writes the table first and the manifest only once that has succeeded, after taking an old one away: a manifest means a whole table.
    """
    from .shared import remove

    spark = df.sparkSession
    for name, data in (labels or {}).items():
        df = df.withMetadata(name, data)
    remove(spark, f"{path}/{MANIFEST}")
    df.write.mode("overwrite").parquet(path)
    lines = [json.dumps({"column": f.name, "type": f.dataType.simpleString(), **(f.metadata or {})}, ensure_ascii=False, sort_keys=True) for f in df.schema.fields]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/{MANIFEST}")


def read_with_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, dict]]:
    """The table and its columns' labels, formats and widths; without a manifest, the table was not written to its end."""
    found = [json.loads(r[0]) for r in spark.read.text(f"{path}/{MANIFEST}").collect()]
    return spark.read.parquet(path), {x.pop("column"): x for x in found}
