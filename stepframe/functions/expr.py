"""Column expressions with the value semantics of step programs: a missing number is less than every number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """NaN becomes missing."""
    return F.when(F.isnan(c), None).otherwise(c)


def less(a: Column, b: Column) -> Column:
    return (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))


_OPERATORS = {
    "lt": less,
    "gt": lambda a, b: less(b, a),
    "le": lambda a, b: ~less(b, a),
    "ge": lambda a, b: ~less(a, b),
    "eq": lambda a, b: a.eqNullSafe(b),
    "ne": lambda a, b: ~a.eqNullSafe(b),
}
SYMBOLS = {"<": "lt", "<=": "le", ">": "gt", ">=": "ge", "=": "eq", "^=": "ne", "~=": "ne", "<>": "ne"}


def compare(a: Column, op: str, b: Column) -> Column:
    """Comparison by word or symbol; never unknown."""
    return _OPERATORS[SYMBOLS.get(op, op)](a, b)


def flag(condition: Column) -> Column:
    """1 or 0; unknown is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def is_missing(c: Column) -> Column:
    return c.isNull().cast("int")


def chain(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """IF / ELSE IF / ELSE: the first true branch; without ELSE the given current value, or missing."""
    out = F.when(branches[0][0], branches[0][1])
    for condition, value in branches[1:]:
        out = out.when(condition, value)
    return out.otherwise(otherwise if otherwise is not None else F.lit(None))


@dataclass(frozen=True)
class Interval:
    """low to high with a label; None is open; bounds are closed unless excluded."""

    low: float | None
    high: float | None
    label: str
    exclude_low: bool = False
    exclude_high: bool = False


@dataclass(frozen=True)
class RangeFormat:
    """A value format: intervals in order and a label for everything else, missing included."""

    intervals: tuple[Interval, ...]
    other: str | None = None

    def apply(self, c: Column) -> Column:
        branches = []
        for i in self.intervals:
            inside = c.isNotNull()
            if i.low is not None:
                inside = inside & (c > i.low if i.exclude_low else c >= i.low)
            if i.high is not None:
                inside = inside & (c < i.high if i.exclude_high else c <= i.high)
            branches.append((inside, F.lit(i.label)))
        return chain(branches, F.lit(self.other) if self.other is not None else c.cast("string"))


def range_lookup(df: DataFrame, value: str, bands: DataFrame, low: str = "low", high: str = "high", max_bands: int = 10_000) -> DataFrame:
    """Left join to each band with low <= value < high. Up to ``max_bands`` bands are counted and broadcast; more are looked up by
    ``band_lookup``, with the same rows."""
    n = bands.limit(max_bands + 1).count()
    if n > max_bands:
        from ..operators.intervals import band_lookup

        return band_lookup(df, value, bands, low, high)
    above = F.col(low).isNull() | (F.col(value) >= F.col(low))
    below = F.col(high).isNull() | (F.col(value) < F.col(high))
    return df.join(F.broadcast(bands), F.col(value).isNotNull() & above & below, "left")


def cut_bytes(c: Column, n: int) -> Column:
    """The first n bytes; a character cut in half becomes U+FFFD."""
    return F.make_valid_utf8(F.substring(c.cast("binary"), 1, n).cast("string"))


def clean_text(c: Column) -> Column:
    """Trailing blanks go; an empty text is missing."""
    return F.nullif(F.rtrim(c), F.lit(""))


def byte_length(c: Column) -> Column:
    """Bytes without trailing blanks."""
    return F.octet_length(F.rtrim(c))


def month_start(d: Column, shift: int = 0) -> Column:
    start = F.trunc(d, "MM")
    return F.add_months(start, shift) if shift else start


def year_month(d: Column) -> Column:
    return F.date_format(d, "yyyyMM")


def nth_word(c: Column, n: Column | int, separators: str = " ") -> Column:
    """The n-th word, from the end if n is negative; missing if there is none. ``separators`` stand inside a character class."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.when(n != 0, F.try_element_at(F.filter(F.split(c, f"[{separators}]+"), lambda w: w != ""), n))


def count_words(c: Column, separators: str = " ") -> Column:
    return F.size(F.filter(F.split(c, f"[{separators}]+"), lambda w: w != ""))


def cell_text(c: Column, kind: str) -> Column:
    """Canonical text of a cell: missing, numbers to 9 places, dates as timestamps, booleans as numbers."""
    if kind == "boolean":
        c, kind = c.cast("double"), "double"
    if kind in ("date", "timestamp", "timestamp_ntz"):
        text = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    elif kind == "string":
        text = c
    else:
        text = F.format_string("%.9f", c.cast("double"))
    return F.when(c.isNull(), F.lit("<NULL>")).otherwise(text)


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of the cells in order of column name; each cell has its length before it, so cells can't run together."""
    kinds = dict(df.dtypes)
    cells = [cell_text(F.col(f"`{c}`"), kinds[c]) for c in sorted(columns or df.columns)]
    return F.sha2(F.concat_ws("|", *[F.concat(F.length(x).cast("string"), F.lit(":"), x) for x in cells]), 256)


def tokens(c: Column) -> Column:
    """Lower-case runs of letters a-z and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def keyword_hits(words: Column, keyword: str) -> Column:
    """Words that begin with a keyword of 5 or more letters, or equal a shorter one or its plural."""
    test = (lambda w: w.startswith(keyword)) if len(keyword) >= 5 else (lambda w: w.isin(keyword, f"{keyword}s"))
    return F.size(F.filter(words, test))


def annuity(principal: Column, monthly_rate: Column, months: Column) -> Column:
    return principal * monthly_rate / (1 - F.pow(1 + monthly_rate, -months))


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns restored to named types; a text that doesn't fit fails with the column's name. Booleans become 1.0 / 0.0."""
    out = {}
    for name, kind in types.items():
        c = F.col(name)
        want = F.when(c.isNull(), None).when(F.lower(c).isin("true", "1"), 1.0).when(F.lower(c).isin("false", "0"), 0.0) if kind == "boolean" else c.try_cast(kind)
        out[name] = F.when(c.isNotNull() & want.isNull(), F.raise_error(F.concat(F.lit(f"{name}: not a {kind}: "), c))).otherwise(want)
    return df.withColumns(out)
