"""Many keywords looked for at once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keywords that one automaton holds; it is sent to each worker whole.
MOST = 1_000_000
#: Hits that are given out at a time, about.
ROWS = 50_000
WORD = re.compile("[a-z0-9]+")


def automaton(keywords: list[str]):
    """One automaton with failure links over all keywords, to be run over words with a blank before and after each.

    A keyword of 5 letters or more is found where a word begins with it, a shorter one where a word equals it or its plural.
    """
    import ahocorasick

    patterns: dict[str, list[str]] = {}
    for k in keywords:
        for p in (f" {k}",) if len(k) >= 5 else (f" {k} ", f" {k}s "):
            patterns.setdefault(p, []).append(k)
    made = ahocorasick.Automaton()
    for p, own in patterns.items():
        made.add_word(p, own)
    made.make_automaton()
    return made


def keyword_hits(df: DataFrame, text: str, keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """For each row and each keyword that its text has: the row's other columns, ``keyword``, ``hits`` (words that match it).

    Texts are taken in lower case, in words of a-z and digits; keywords likewise, and one that isn't a single such word can't be met. Each text is gone
    through once whatever the number of keywords, of which there may be ``MOST``. Rows without a hit, null texts and null keywords give nothing.
    """
    words = [r[0] for r in keywords.select(F.lower(keyword)).where(F.col(keyword).isNotNull()).distinct().limit(MOST + 1).collect()]
    if len(words) > MOST:
        raise ValueError(f"more than {MOST} keywords")
    words = [w for w in words if WORD.fullmatch(w)]
    sent = df.sparkSession.sparkContext.broadcast(words)
    kept = [c for c in df.columns if c not in (text, "keyword", "hits")]
    rows = df.select(*[f"`{c}`" for c in kept], F.lower(F.col(f"`{text}`")).alias("__text"))
    names = [*kept, "keyword", "hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(sent.value) if sent.value else None
        for batch in batches:
            own_columns, place, keys, hits = batch.select(kept), [], [], []

            def made() -> pa.RecordBatch:
                # Only what is given out is repeated for each hit; the text is not.
                some = [c.take(pa.array(place, pa.int64())) for c in own_columns.columns]
                return pa.RecordBatch.from_arrays([*some, pa.array(keys, pa.string()), pa.array(hits, pa.int64())], names=names)

            for i, t in enumerate(batch.column("__text") if found else ()):
                t = t.as_py()
                # A blank ends one word and begins the next.
                counts = Counter(k for _, own in found.iter(f" {' '.join(WORD.findall(t))} ") for k in own) if t else {}
                place += [i] * len(counts)
                keys += counts.keys()
                hits += counts.values()
                if len(hits) >= ROWS:
                    yield made()
                    place, keys, hits = [], [], []
            yield made()

    return rows.mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], T.StructField("keyword", T.StringType()), T.StructField("hits", T.LongType())]))
