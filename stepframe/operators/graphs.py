"""Reachability, cycles and levels of directed graphs held in tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_folder, remove

#: Edges that are worth no contraction.
FEW = 100_000


class Scratch:
    """Tables on the way, in one folder of the shared place: each is written once, counted as it is written, and can be let go."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.folder, self.made, self.held = spark, new_folder(spark, tag), 0, {}

    def keep(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The table as read back, and its rows."""
        self.made += 1
        path, seen = f"{self.folder}/{self.made}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held[id(out)] = (out, path)
        return out, seen.get["n"]

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            remove(self.spark, self.held.pop(id(t))[1])


def _coin(node: str, k: int) -> Column:
    return F.xxhash64(node, F.lit(k)).bitwiseAND(F.lit(1).cast("long")) == 1


def _goes(k: int) -> Column:
    """Whether an edge's end leaves in round k: it isn't held, and of it and the edge's beginning only it throws a one. So of neighbours one leaves at most."""
    return F.col("free") & ~_coin("u", k) & _coin("v", k)


def contracted(work: Scratch, edges: DataFrame, n: int, held: DataFrame | None = None) -> list[DataFrame]:
    """Edges (u, v, w, free, via) after each round in which nodes of one way in and one way out, or none, leave; at first all.

    ``edges`` (u, v, w) are ``n`` and distinct; nodes of ``held`` (node) stay. Where u -> x -> v, an edge u -> v of summed w and via x takes the place of both; an end is
    dropped. A quarter of the nodes of long paths leaves in each round, so all rounds together hold some four times the edges. Ends at ``FEW`` edges, or
    when a round takes few. Edges with u = v are in the round that they come up in only.
    """
    many = lambda c: edges.groupBy(F.col(c).alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node")
    stay = many("u").union(many("v"))
    stay = (stay.union(held.select("node")) if held is not None else stay).distinct().select(F.col("node").alias("v"), F.lit(False).alias("free"))
    kind = edges.schema["u"].dataType
    now, n = work.keep(edges.join(stay, "v", "left").select("u", "v", F.col("w").cast("long").alias("w"), F.coalesce("free", F.lit(True)).alias("free"), F.lit(None).cast(kind).alias("via")))
    out, before = [now], 2 * n
    while n > FEW and n <= 0.95 * before:
        k = len(out) - 1
        live = now.where("u <> v")
        gone = live.where(_goes(k)).select(F.col("v").alias("x"), F.col("u").alias("p"), F.col("w").alias("more"))
        rest = live.where(~_goes(k))
        met = rest.where(_coin("u", k)).join(gone, F.col("u") == F.col("x"), "left")
        met = met.select(F.coalesce("p", "u").alias("u"), "v", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), "free", F.col("x").alias("via"))
        same = rest.where(~_coin("u", k)).withColumn("via", F.lit(None).cast(kind))
        before = n
        now, n = work.keep(met.unionByName(same))
        out.append(now)
    return out


def _left(rounds: list[DataFrame]) -> list[DataFrame]:
    """(node, p, w): nodes that left in each round, and the node and distance that they were reached from."""
    return [r.where("u <> v").where(_goes(k)).select(F.col("v").alias("node"), F.col("u").alias("p"), "w") for k, r in enumerate(rounds[:-1])]


def _returned(work: Scratch, known: DataFrame, rounds: list[DataFrame], value: str) -> DataFrame:
    """``known`` (node, value, more columns) with a row for each node that left: its value is that of the node before it and their distance."""
    for k, gone in reversed(list(enumerate(_left(rounds)))):
        before = known.where(~_coin("node", k)).withColumnRenamed("node", "p")
        new = before.join(gone, "p").withColumn(value, (F.col(value) + F.col("w")).cast(known.schema[value].dataType))
        known = known.unionByName(work.keep(new.select(*known.columns))[0])
    return known


def reach(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth): nodes that edges (u, v) lead to from each node of ``starts`` (start), at their least depth; a start at depth 0.

    Paths are contracted first, see ``contracted``, so a long chain costs rows in proportion to its links. Then path doubling on what is left: round k joins what is known with walks of exactly 2^k edges, and these with themselves; so the rounds grow with
    the logarithm of the depth. Ends when a round brings no new pair and no shorter way, which also ends cycles. Nodes that left come back last, round by round.
    """
    work = Scratch(edges.sparkSession, "reach")
    jump, jumps = work.keep(edges.select("u", "v", F.lit(1).cast("long").alias("w")).where("u <> v").distinct())
    known, n = work.keep(starts.select("start").where("start is not null").distinct().select("start", F.col("start").alias("node"), F.lit(0).alias("depth")))
    rounds, total = [], 0
    if jumps > FEW:
        rounds = contracted(work, jump, jumps, known.select("node"))
        work.drop(jump)
        jump, jumps = work.keep(rounds[-1].where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w")))
    while jumps:
        further = known.join(jump, F.col("node") == F.col("u")).select("start", F.col("v").alias("node"), (F.col("depth") + F.col("w")).cast("int").alias("depth"))
        seen = Observation()
        now, more = work.keep(known.unionByName(further).groupBy("start", "node").agg(F.min("depth").alias("depth")).observe(seen, F.sum(F.col("depth").cast("decimal(38,0)")).alias("total")))
        work.drop(known)
        known, grown, n, total = now, (more, seen.get["total"]) != (n, total), more, seen.get["total"]
        if not grown:
            break
        twice = jump.join(jump.select(F.col("u").alias("v"), F.col("v").alias("to"), F.col("w").alias("more")), "v").select("u", F.col("to").alias("v"), (F.col("w") + F.col("more")).alias("w"))
        now, jumps = work.keep(twice.where("u <> v").groupBy("u", "v").agg(F.min("w").alias("w")))
        work.drop(jump)
        jump = now
    work.drop(jump)
    return _returned(work, known, rounds, "depth").select("start", "node", "depth")


def cycles(edges: DataFrame) -> DataFrame:
    """(node, root): nodes of edges (u, v) that lie on a cycle with others; nodes of one strongly connected component have its least node as root.

    Edges that lead out of nothing or into nothing go first. Then the least node that reaches a node colours it; what reaches the
    colour's own node inside the colour is its component; it goes, and the rest is done again. Rounds grow with the depth of what
    is left and with the number of components in a line, not with rows. Paths are contracted before all that, see ``contracted``: a node that left is on a
    cycle if those before and after it are one node or on a cycle together.
    """
    work = Scratch(edges.sparkSession, "cycles")
    core, n = work.keep(edges.select("u", "v").where("u <> v").distinct())
    if n <= FEW:
        return _cycles_of(work, core, n)
    rounds = contracted(work, core.withColumn("w", F.lit(0)), n)
    work.drop(core)
    on = _cycles_of(work, *work.keep(rounds[-1].where("u <> v").select("u", "v").distinct()))
    for k, r in reversed(list(enumerate(rounds[1:]))):
        via, before = r.where("via is not null").select("via", "u", "v"), on.where(~_coin("node", k)).select(F.col("node").alias("u"), "root")
        loops = via.where("u = v").join(before, "u", "left").select("u", "via", F.coalesce("root", "u").alias("root"), F.col("root").isNull().alias("alone"))
        own = F.explode(F.array(F.struct(F.col("via").alias("node"), "root"), F.when(F.col("alone"), F.struct(F.col("u").alias("node"), "root")))).alias("x")
        loops = loops.select(own).where("x is not null").select("x.*").distinct()
        paths = via.where("u <> v").join(before, "u").join(on.select(F.col("node").alias("v"), F.col("root").alias("after")), "v").where("root = after").select(F.col("via").alias("node"), "root")
        on = on.unionByName(work.keep(loops.unionByName(paths))[0])
    least = on.groupBy("root").agg(F.min("node").alias("least"))
    return on.join(least, "root").select("node", F.col("least").alias("root"))


def _cycles_of(work: Scratch, core: DataFrame, n: int) -> DataFrame:
    found, nodes = [], core.select(F.col("u").alias("node"), F.col("u").alias("root"))
    while True:
        while n:
            ins, outs = core.select(F.col("v").alias("u")).distinct(), core.select(F.col("u").alias("v")).distinct()
            now, left = work.keep(core.join(ins, "u", "left_semi").join(outs, "v", "left_semi").select("u", "v"))
            work.drop(core)
            core, same = now, left == n
            n = left
            if same:
                break
        if not n:
            break
        colour, _ = work.keep(core.select(F.col("u").alias("node")).union(core.select("v")).distinct().withColumn("root", F.col("node")))
        moved = 1
        while moved:
            least = core.join(colour, F.col("u") == F.col("node")).groupBy(F.col("v").alias("node")).agg(F.min("root").alias("up"))
            seen, now = Observation(), colour.join(least, "node", "left").select("node", F.least("root", "up").alias("root"), (F.col("up") < F.col("root")).alias("moved"))
            now, _ = work.keep(now.observe(seen, F.count_if("moved").alias("moved")).drop("moved"))
            work.drop(colour)
            colour, moved = now, seen.get["moved"]
        inside = core.join(colour.withColumnsRenamed({"node": "u"}), "u").join(colour.select(F.col("node").alias("v"), F.col("root").alias("r")), "v").where("root = r").select("u", "v", "root")
        inside, _ = work.keep(inside)
        back, size = work.keep(colour.where("node = root"))
        while True:
            more = inside.join(back.select(F.col("node").alias("v"), "root"), ["v", "root"]).select(F.col("u").alias("node"), "root")
            now, count = work.keep(back.unionByName(more).distinct())
            work.drop(back)
            back, grown, size = now, count > size, count
            if not grown:
                break
        found.append(back)
        gone = back.select("node")
        now, n = work.keep(core.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v"))
        work.drop(core, colour, inside)
        core = now
    work.drop(core)
    if not found:
        return work.spark.createDataFrame([], nodes.schema)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    # A node that only began a colour lies on no cycle.
    return out.join(out.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root"), "root", "left_semi").select("node", "root")


def longest_chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, length, root, size): nodes on the longest chain of edges (u, v) that ends in each node of ``nodes`` (node), itself included.

    Nodes that are on a cycle together stand for one another: all ``size`` of them count, and all have the same length and root.
    Paths are contracted first, see ``contracted``; then there is one joined round for each link of the longest chain between the components that are left.
    """
    spark = edges.sparkSession
    work = Scratch(spark, "chains")
    on = cycles(edges)
    both = nodes.select("node").distinct().join(on, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    both, _ = work.keep(both.join(both.groupBy("root").agg(F.count("*").alias("size")), "root").select("node", "root", "size"))
    up, down = both.select(F.col("node").alias("u"), F.col("root").alias("a")), both.select(F.col("node").alias("v"), F.col("root").alias("b"), F.col("size").alias("w"))
    links, n = work.keep(edges.select("u", "v").join(up, "u").join(down, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"), "w").distinct())
    rounds = contracted(work, links, n) if n > FEW else []
    length = both.select(F.col("root").alias("node"), F.col("size").alias("length")).distinct()
    if rounds:
        away = [gone.select("node") for gone in _left(rounds)]
        length = length.join(reduce(DataFrame.union, away), "node", "left_anti") if away else length
    length, _ = work.keep(length)
    if rounds:
        work.drop(links)
        links, n = work.keep(rounds[-1].where("u <> v").groupBy("u", "v").agg(F.max("w").alias("w")))
    moved = n
    while moved:
        most = links.join(length.withColumnRenamed("node", "u"), "u").groupBy(F.col("v").alias("node")).agg(F.max(F.col("length") + F.col("w")).alias("before"))
        seen, now = Observation(), length.join(most, "node", "left").select("node", F.greatest("length", "before").alias("length"), (F.col("before") > F.col("length")).alias("moved"))
        now, _ = work.keep(now.observe(seen, F.count_if("moved").alias("moved")).drop("moved"))
        work.drop(length)
        length, moved = now, seen.get["moved"]
    work.drop(links)
    length = _returned(work, length, rounds, "length").withColumnRenamed("node", "root")
    return both.join(length, "root").select("node", "length", "root", "size")
