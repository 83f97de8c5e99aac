"""Mixing sources to target weights by iterative proportional fitting (operator 8)."""

from __future__ import annotations

import zlib
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, documents, key_of_id, saved, tokenizer_path, whole_row
from .encoding import encoder, slices

MARGINS = ("source", "lang", "topic")
#: Cells up to which raking runs on the driver (a row of about 100 bytes each); beyond it, as DataFrame joins.
DRIVER_CELLS = 100_000
#: Raking, on the driver or not, ends after so many rounds, or when no marginal share was off by as much as the tolerance.
ROUNDS, TOLERANCE = 100, 1e-9


def _topic_table(topics: int, buckets: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(buckets, topics)).astype(np.float32)


def word_bucket(word: bytes, buckets: int) -> int:
    """The bucket of a lower-cased word; words of up to 3 bytes have none (-1)."""
    return zlib.crc32(word) % buckets if len(word) > 3 else -1


def topic_of(counts: np.ndarray, table: np.ndarray) -> int:
    """The strongest of fixed random projections of the text's hashed word counts, square roots taken."""
    return int(np.argmax(np.sqrt(counts, dtype=np.float32) @ table)) if counts.any() else 0


class _Buckets:
    """Buckets of the encoder's pieces, kept beside it."""

    def __init__(self):
        self.index, self.own = None, np.zeros(0, np.int64)

    def get(self, enc, buckets: int) -> np.ndarray:
        if self.index is not enc.index:
            self.index, self.own = enc.index, np.zeros(0, np.int64)
        if len(self.index) > len(self.own):
            new = [word_bucket(w, buckets) for w in islice(self.index, len(self.own), None)]
            self.own = np.concatenate([self.own, np.array(new, np.int64)])
        return self.own


def measured(docs: DataFrame, tokenizer: str | None = None, topics: int = 4, buckets: int = 4096, seed: int = 5) -> DataFrame:
    """(doc_id, th, source, lang, topic, tokens, u): hash of the text, token counts with an end id, a hashed topic, a hash in [0, 1).

    Row by row; repeated rows each get theirs; an empty table gives no rows. u depends on the doc_id only, so a document is drawn alike in any order and partitioning. Null source or
    lang is the empty string; null texts have one token and topic 0; a null doc_id has the hash of null.
    """
    path = tokenizer or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text")

    def run(batches):
        table, enc, kept = _topic_table(topics, buckets, seed), encoder(path), _Buckets()
        for batch in batches:
            for first, texts in slices(batch):
                pieces, counts = enc.pieces(texts, lower=True)
                bucket = kept.get(enc, buckets)[pieces]
                lengths = np.concatenate([[0], np.cumsum(enc.lengths[pieces])])
                ends = np.cumsum(counts)
                tokens = lengths[ends] - lengths[ends - counts] + 1
                topic = []
                for a, b in zip((ends - counts).tolist(), ends.tolist()):
                    own = bucket[a:b]
                    topic.append(topic_of(np.bincount(own[own >= 0], minlength=buckets), table))
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("th"), own.column("source"), own.column("lang"), pa.array([f"t{t}" for t in topic], pa.string()), pa.array(tokens)], names=["doc_id", "th", "source", "lang", "topic", "tokens"])

    out = rows.mapInArrow(run, "doc_id long, th long, source string, lang string, topic string, tokens long")
    return out.withColumn("u", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(23)), 11) / F.lit(float(1 << 53)))


def tempered(shares: dict, power: float) -> dict:
    """Target shares proportional to shares to a power: under 1 it moves weight from the largest to the rest."""
    raised = {k: v**power for k, v in shares.items() if v > 0}
    return {k: v / sum(raised.values()) for k, v in raised.items()}


def rake(cells: pd.DataFrame, targets: dict[str, dict], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, bool]:
    """Weights of ``cells`` (margin columns, tokens) that sum to 1 and have the target marginals as nearly as they can, and whether all
    marginals were met to the tolerance; targets that no weights meet end after ``rounds`` with the last margin met.

    Each pass scales the weights of a margin's values to its targets. Values without a target get weight 0; targets
    without cells are left out and the rest scaled to 1.
    """
    w = cells["tokens"].to_numpy(float)
    w = w / max(w.sum(), 1e-300)
    codes, met = {m: pd.factorize(cells[m]) for m in targets}, False
    for _ in range(rounds):
        moved = 0.0
        for m, target in targets.items():
            code, values = codes[m]
            now = np.bincount(code, w, len(values))
            want = np.array([target.get(v, 0.0) for v in values], float)
            want = want / max(want[now > 0].sum(), 1e-300)
            factor = np.divide(want, now, out=np.zeros(len(now)), where=now > 0)
            moved = max(moved, float(np.abs(now - np.where(now > 0, want, 0)).max(initial=0)))
            w = w * factor[code]
        if met := moved < tolerance:
            break
    return w / max(w.sum(), 1e-300), met


def rake_table(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """The same on a table of any size, with the same end: adds ``weight`` and ``converged``. ``targets``: for each margin, a table
    (margin, share)."""
    total = F.greatest(F.col("_all"), F.lit(1e-300))
    first = cells.crossJoin(F.broadcast(cells.agg(F.sum("tokens").cast("double").alias("_all"))))
    now = saved(first.select(*cells.columns, (F.col("tokens") / total).alias("weight"), F.lit(0.0).alias("_moved")), "raked")
    met = False
    for _ in range(rounds):
        out, used = now.withColumn("_moved", F.lit(0.0)), [now]
        for m, target in targets.items():
            # Written, so that the next margin doesn't compute the ones before it again.
            sums = saved(out.groupBy(m).agg(F.sum("weight").alias("_now")).join(target, m, "left").select(m, "_now", F.when(F.col("_now") > 0, F.coalesce("share", F.lit(0.0))).otherwise(0.0).alias("_want")), "sums")
            used.append(sums)
            wanted = sums.crossJoin(F.broadcast(sums.agg(F.sum("_want").alias("_all")))).select(m, "_now", (F.col("_want") / total).alias("_want"))
            factor = F.when(F.col("_now") > 0, F.col("_want") / F.col("_now")).otherwise(0.0)
            out = out.join(wanted, m).select(*cells.columns, (F.col("weight") * factor).alias("weight"), F.greatest("_moved", F.abs(F.col("_now") - F.col("_want"))).alias("_moved"))
        now = saved(out, "raked")
        for table in used:
            discard(table)
        if met := (now.agg(F.max("_moved")).first()[0] or 0.0) < tolerance:
            break
    return now.drop("_moved").withColumn("converged", F.lit(met))


def inclusion(cells: DataFrame, targets: dict[str, dict] | None, power: float, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Adds ``weight`` (share of the mixture), ``converged`` (whether all marginals were met) and ``probability`` of drawing a document of
    the cell.

    The mixture is as large as it can be without repeating documents: the probability is weight over tokens, scaled so
    that the largest is 1. Marginal targets not given are the present shares raised to ``power``.
    """
    spark = cells.sparkSession
    if cells.limit(driver_cells + 1).count() <= driver_cells:
        pdf = cells.toPandas().sort_values(list(MARGINS), ignore_index=True)
        total = max(float(pdf["tokens"].sum()), 1.0)
        full = {m: (targets or {}).get(m) or tempered((pdf.groupby(m)["tokens"].sum() / total).to_dict(), power) for m in MARGINS}
        pdf["weight"], met = rake(pdf, full)
        rows = [(*map(str, r[:3]), int(r[3]), float(r[4])) for r in pdf[[*MARGINS, "tokens", "weight"]].itertuples(index=False)]
        out = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, weight double").withColumn("converged", F.lit(met))
    else:
        want = {}
        for m in MARGINS:
            if given := (targets or {}).get(m):
                want[m] = spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{m} string, share double")
            else:
                raised = cells.groupBy(m).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
                want[m] = raised.crossJoin(F.broadcast(raised.agg(F.sum("p").alias("all")))).select(m, (F.col("p") / F.col("all")).alias("share"))
        out = rake_table(cells, want)
        out = out.crossJoin(F.broadcast(out.agg(F.sum("weight").alias("_all")))).withColumn("weight", F.col("weight") / F.col("_all")).drop("_all")
    rate = F.col("weight") / F.greatest(F.col("tokens"), F.lit(1))
    top = out.agg(F.max(rate).alias("_top"))
    return out.crossJoin(F.broadcast(top)).withColumn("probability", F.when(F.col("_top") > 0, F.least(F.lit(1.0), rate / F.col("_top"))).otherwise(0.0)).drop("_top")


def mix(docs: DataFrame, targets: dict[str, dict] | None = None, power: float = 0.9, tokenizer: str | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Per document: source, lang, topic, tokens, its cell's weight and probability, whether raking converged, and whether it is drawn.

    A document is drawn if the hash of its doc_id is under its probability, so expected tokens have the raked
    proportions. Cells are summed before the shuffle, so a source with most rows costs one row for each task. The join
    that gives probabilities back to documents is by cell; Spark broadcasts the cells if its threshold allows and else
    splits hot cells. An empty table gives no rows; repeated rows are drawn alike.
    """
    return _mixed(docs, targets, power, tokenizer, driver_cells).drop("th")


def _mixed(docs: DataFrame, targets: dict[str, dict] | None, power: float, tokenizer: str | None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    rows = saved(measured(docs, tokenizer), "measured")
    cells = rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"))
    odds = inclusion(cells, targets, power, driver_cells).select(*MARGINS, "weight", "probability", "converged")
    return rows.join(odds, list(MARGINS)).select("doc_id", "th", *MARGINS, "tokens", "weight", "probability", "converged", (F.col("u") < F.col("probability")).alias("drawn"))


def draw(docs: DataFrame, targets: dict[str, dict] | None = None, power: float = 0.9, tokenizer: str | None = None) -> DataFrame:
    """The drawn documents, all columns.

    Each row is drawn by its own cell; rows that repeat an id, text, source and language are drawn or left together. Null texts have
    one token, null source and lang are the empty string, rows of null doc_id share a hash. An empty table gives no rows.
    """
    same = ["_key", "_th", "_source", "_lang"]
    chosen = _mixed(docs, targets, power, tokenizer).where("drawn").select(key_of_id().alias("_key"), F.col("th").alias("_th"), F.col("source").alias("_source"), F.col("lang").alias("_lang")).distinct()
    rows = docs.select(whole_row(docs), key_of_id().alias("_key"), F.xxhash64("text").alias("_th"), F.coalesce("source", F.lit("")).alias("_source"), F.coalesce("lang", F.lit("")).alias("_lang"))
    return rows.join(chosen, same, "left_semi").select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


__all__ = ["MARGINS", "draw", "inclusion", "measured", "mix", "op8_mixing", "rake", "rake_table", "tempered", "topic_of"]
