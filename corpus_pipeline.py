"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. ``run`` writes each stage's result as
Parquet in the shared folder and reads it again as the next one's documents. All stages but the last return the columns
of documents. SQL can't express the robust estimates, SimHash, the network or the tokenizer, so ORACLE_SQL is None and
tests hold each stage against its operator's brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepframe.llm.common import documents, saved
from stepframe.llm.mixing import draw
from stepframe.llm.packing import digest, pack_documents
from stepframe.llm.quality import keep_good
from stepframe.llm.secrets import redact, trained_on
from stepframe.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie far out for their language and source go.

    Null and empty texts fail the base rules and go; null lang and source count as the empty string; rows that repeat a
    document stay or go together; an empty table stays empty.
    """
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of least doc_id, of each group of near-duplicates (five-word shingles, similarity 0.8 or more) stays.

    SimHash links those within 2 of 64 bits, each link checked exactly; MinHash bands then complete what is alike but farther apart.

    Of ties the one of least text hash stays, and of rows that repeat id and text one. A null doc_id counts as the least; rows
    of null or equal doc_id in other groups stay. Null and empty texts are one group; an empty table stays empty.
    """
    return keep_one(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays.

    Null texts stay null; repeated rows stay, each with the same marks; ``n_chars`` is the new length; an empty table stays empty.
    """
    return redact(docs, trained_on(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that tokens have tempered shares of source, language and topic.

    Null source and lang count as the empty string, null texts as one token; rows that repeat a document are drawn or
    left together, rows of null doc_id share a hash; an empty table stays empty.
    """
    return draw(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 ids.

    Null and empty texts are one end id; repeated rows are packed each; an empty table gives no pieces.
    """
    return digest(pack_documents(docs))


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", simhash_near_dedup), ("secret scans", secret_scans), ("mixing sources to target weights", mix_sources), ("packing", packing)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
