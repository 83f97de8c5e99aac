"""Rows in which two large tables differ, found without shuffling what is alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cell_text
from .graphs import Scratch
from .order import join_same

#: Nodes of the two levels of the tree, by their number of bits.
BITS = (8, 8)
#: Keys that differ are sent to all tasks up to this number; more are joined.
MOST_SENT = 1_000_000


def _cell(df: DataFrame, c: str, other: DataFrame) -> Column:
    """A cell as it is where both tables have one type for it, else as text; 0 has no sign."""
    kind = dict(df.dtypes)[c]
    if kind != dict(other.dtypes)[c]:
        return cell_text(F.col(f"`{c}`"), kind)
    return F.when(F.col(f"`{c}`") == 0, F.lit(0).cast(kind)).otherwise(F.col(f"`{c}`")) if kind in ("float", "double") else F.col(f"`{c}`")


def _prints(df: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Adds a hash of the key and, twice, of the row; missing cells count with their place."""

    def both(names):
        return [x for c in names for x in (F.col(f"`{c}`").isNull(), _cell(df, c, other))]

    return df.withColumns({"__key": F.xxhash64(*both(keys)), "__p": F.xxhash64(F.lit(1), *both(columns)), "__q": F.xxhash64(F.lit(2), *both(columns))})


def _sum(c: str) -> Column:
    """Without order, and without limit; equal rows count as often as they occur."""
    return F.sum(F.col(c).cast("decimal(38,0)"))


def _node(depth: int) -> Column:
    return F.pmod(F.shiftrightunsigned("__key", 64 - sum(BITS[:depth])), F.lit(2 ** sum(BITS[:depth])))


def unequal_parts(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, rows of left, rows of right): the unequal nodes of the lowest level, and the rows that lie in them.

    Keys are spread over a tree by their hash. For each node of a level both tables give a count and an order-free sum of row
    hashes, which combine before the shuffle; only nodes that differ are looked into at the next level, and only rows in the lowest
    unequal nodes are given. There are at most 2^16 nodes, so their lists are broadcast. Among the rows of the lowest unequal nodes, which in
    large tables are most, only hashes of keys and rows are shuffled, to find the keys that differ; the rows of other keys are left where they are.
    """
    a, b = _prints(left, right, keys, columns), _prints(right, left, keys, columns)
    nodes = None
    for depth in range(1, len(BITS) + 1):
        sides = [x if nodes is None else x.join(F.broadcast(nodes), _node(depth - 1) == F.col("__node"), "left_semi") for x in (a, b)]
        sums = [x.groupBy(_node(depth).alias("__node")).agg(F.count("*").alias("n"), _sum("__p").alias("s"), _sum("__q").alias("u")) for x in sides]
        other = sums[1].toDF("__other", "m", "t", "v")
        both = sums[0].join(other, F.col("__node") == F.col("__other"), "full_outer")
        nodes = both.where(~(F.col("n").eqNullSafe(F.col("m")) & F.col("s").eqNullSafe(F.col("t")) & F.col("u").eqNullSafe(F.col("v")))).select(F.coalesce("__node", "__other").alias("__node"))
    inside = [x.join(F.broadcast(nodes), _node(len(BITS)) == F.col("__node"), "left_semi") for x in (a, b)]
    # Sums of halves can't overflow; they are compared, not shown.
    halves = [F.shiftright(c, 32) if high else F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)) for c in ("__p", "__q") for high in (True, False)]
    signed = [x.select("__key", F.lit(sign).cast("long").alias("d"), *[(h * sign).alias(f"h{i}") for i, h in enumerate(halves)]) for x, sign in zip(inside, (1, -1), strict=True)]
    odd = signed[0].unionByName(signed[1]).groupBy("__key").agg(F.sum("d").alias("d"), *[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)]).where("d <> 0 or h0 <> 0 or h1 <> 0 or h2 <> 0 or h3 <> 0").select("__key")
    odd, n = Scratch(left.sparkSession, "unequal").keep(odd)
    if n <= MOST_SENT:
        odd = F.broadcast(odd)
    return nodes, *[x.join(odd, "__key", "left_semi").drop("__key") for x in inside]


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Each key whose rows differ: keys, ``kind`` and ``columns``.

    kind is "left only" or "right only" where one table has no row of the key, "changed" where both have one row, and ``columns`` then lists those that
    differ (missing equals missing; columns of other types in the two tables compare as text, numbers to 9 places), "repeated" where
    a table has more than one and the multisets differ. Compares the columns that both tables have. A missing key is a key.
    """
    columns = [c for c in left.columns if c in right.columns]
    values = [c for c in columns if c not in keys]
    _, a, b = unequal_parts(left, right, keys, columns)

    def one(rows: DataFrame, own: DataFrame, other: DataFrame, side: str) -> DataFrame:
        cells = F.struct(F.lit(0).alias("_"), *[_cell(own, c, other).alias(c) for c in values])
        return rows.groupBy(*keys).agg(F.count("*").alias(f"__n{side}"), _sum("__p").alias(f"__s{side}"), _sum("__q").alias(f"__t{side}"), F.first(cells).alias(f"__c{side}"))

    both = join_same(one(a, left, right, "a"), one(b, right, left, "b"), keys, "full_outer")
    same = F.col("__na").eqNullSafe(F.col("__nb")) & F.col("__sa").eqNullSafe(F.col("__sb")) & F.col("__ta").eqNullSafe(F.col("__tb"))
    both = both.where(~same)
    kind = F.when(F.col("__nb").isNull(), "left only").when(F.col("__na").isNull(), "right only").when((F.col("__na") == 1) & (F.col("__nb") == 1), "changed").otherwise("repeated")
    changed = [F.when(~F.col("__ca").getField(c).eqNullSafe(F.col("__cb").getField(c)), F.lit(c)) for c in values]
    listed = F.array_join(F.filter(F.array(*changed), lambda x: x.isNotNull()), ",") if changed else F.lit("")
    return both.select(*keys, kind.alias("kind"), F.when(kind == "changed", listed).otherwise(F.lit("")).alias("columns"))
