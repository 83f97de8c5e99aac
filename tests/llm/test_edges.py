"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names: each operator has a defined result."""

import pytest
from pyspark.sql import functions as F

from stepframe.llm import mixing, packing, quality, scoring, secrets, simhash, substrings, token_counts, token_files, winnowing
from stepframe.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, _key string, th string, fp string, part string, ids string, bucket string, grp string, u string, ranges string, _hash string, tokens string, c string, rid string"


@pytest.fixture(scope="module")
def odd(spark):
    long = "lorem ipsum dolor sit amet " * 4000
    rows = [(None, "null id text of a few words", "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, long, "en", "a"), (3, long, "en", "a"), (4, "same id, first text", "en", "b"), (4, "same id, second text", "en", "b"), (5, "word", "en", None), (6, " \n\t ", "xx", "b"), (7, "Ünïcode — ßtraße 日本語 \x85   İ", "de", "b"), (None, None, None, None), (8, "a\x00b 😀 emoji", "en", "b"), (9, long + "tail", "en", "a")]
    return spark.createDataFrame([(*r, 0, *["x"] * 14) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def model():
    return secrets.train(secrets.made_findings([], 600))


def files(docs):
    spark = docs.sparkSession
    path = new_path(spark, "t")
    token_files.write_token_files(docs, path)
    return token_files.read_token_files(spark, path)


CASES = {
    "token_files": (files, 13), "packing": (packing.pack_documents, None), "winnowing": (winnowing.compare_with_edits, 13), "fingerprints": (winnowing.fingerprints, 13),
    "simhash": (simhash.near_duplicates, 13), "scoring": (scoring.scores, 13), "token_counts": (token_counts.token_counts, 13), "mixing": (mixing.mix, 13),
    "quality": (quality.judged, 13), "substrings": (substrings.remove_repeats, 13), "keep_one": (simhash.keep_one, None), "keep_good": (quality.keep_good, None), "draw": (mixing.draw, None),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_rows(odd, name):
    op, n = CASES[name]
    got = op(odd).collect()
    assert n is None or len(got) == n


@pytest.mark.parametrize("name", CASES)
def test_empty_table(none, name):
    assert CASES[name][0](none).collect() == []


def test_secrets(odd, none, model):
    assert secrets.scan(odd, model).count() == 13 and secrets.scan(none, model).count() == 0
    clean = secrets.redact(odd, model)
    assert clean.columns == odd.columns and clean.where("text is null").count() == 2
    assert secrets.corpus_findings(none, 10) == ([], []) and secrets.corpus_findings(odd, 10)[1]


def test_stages_keep_columns(odd):
    for op in (simhash.keep_one, quality.keep_good, mixing.draw):
        assert op(odd).columns == odd.columns


def test_defined_results(odd):
    near = {r.doc_id: r for r in simhash.near_duplicates(odd.where("doc_id in (1, 2, 6)")).collect()}
    assert {r.fp for r in near.values()} == {0} and {r.component for r in near.values()} == {1}
    packed = packing.pack_documents(odd.where("doc_id = 1")).collect()
    assert [(r.length, r.ids) for r in packed] == [(1, [2])]
    assert winnowing.compare_with_edits(odd.where("doc_id = 5")).first().near_next == 1.0
    cut = {r.doc_id: r for r in substrings.remove_repeats(odd.where("doc_id in (3, 9)")).collect()}
    assert cut[3].n_removed == 0 and cut[9].n_removed == 20_000 and cut[9].kept == "tail"
    assert quality.judged(odd).where(F.col("kept") & (F.col("n_words") < 20)).count() == 0


def test_near_dedup_keeps_unrelated_rows_of_one_id(spark):
    texts = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = spark.createDataFrame([(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[0]), (5, texts[2]), (6, texts[1] + " x")], "doc_id long, text string")
    got = simhash.keep_one(rows).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, texts[0]), (0, texts[1]), (5, texts[2])]


def test_stages_on_odd_rows(spark, odd, none):
    """What each stage of the pipeline says of nulls, repeated rows, clashing names and empty tables."""
    import corpus_pipeline as P

    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en", "a"), (1, words, "en", "a"), (2, words + " end", "en", "a"), (None, words.replace("word", "other"), None, None), (3, None, "en", "a"), (4, "", "en", "a")]
    docs = spark.createDataFrame([(*r, 0, *["x"] * 14) for r in rows], SCHEMA)
    good = P.quality_rules(spark, docs, "")
    assert sorted((r.doc_id or 0) for r in good.collect()) == [0, 1, 1, 2] and good.columns == docs.columns
    one = P.simhash_near_dedup(spark, docs, "")
    assert sorted((r.doc_id or 0, r.text or "") for r in one.collect()) == [(0, words.replace("word", "other")), (1, words), (3, "")]
    clean = P.secret_scans(spark, docs.withColumn("text", F.concat("text", F.lit(" password=hunter22"))), "")
    assert clean.count() == 6 and clean.where("text like '%[REDACTED]' and n_chars = length(text)").count() == 5 and clean.where("text is null").count() == 1
    drawn = P.mix_sources(spark, docs, "")
    assert drawn.columns == docs.columns and drawn.where("doc_id = 1").count() in (0, 2)
    packed = P.packing(spark, docs, "")
    twice = packed.where("doc_id = 1").collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens and packed.where("doc_id in (3, 4) and length = 1").count() == 2
    for _, stage in P.STAGES:
        assert stage(spark, none, "").collect() == []
