"""Rule-based labels, keyword areas and complexity scores of rows of facts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import compare, keyword_hits, tokens


@dataclass(frozen=True)
class Test:
    """A typed predicate on a column: fact, comparison (or "matches", "holds" for a fact alone, "has one of" for an array), value."""

    fact: str
    op: str
    value: object

    def column(self) -> Column:
        if self.op == "matches":
            return F.coalesce(F.col(self.fact).rlike(self.value), F.lit(False))
        if self.op == "holds":
            return F.coalesce(F.col(self.fact).cast("double") != 0, F.lit(False))
        if self.op == "has one of":
            return F.coalesce(F.arrays_overlap(F.col(self.fact), F.array(*map(F.lit, self.value))), F.lit(False))
        return compare(F.col(self.fact), self.op, F.lit(self.value))


@dataclass(frozen=True)
class AnyOf:
    tests: tuple

    def column(self) -> Column:
        out = F.lit(False)
        for t in self.tests:
            out = out | t.column()
        return out


@dataclass(frozen=True)
class AllOf:
    tests: tuple

    def column(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.column()
        return out


@dataclass(frozen=True)
class Not:
    test: object

    def column(self) -> Column:
        return ~self.test.column()


@dataclass(frozen=True)
class Always:
    holds: bool = True

    def column(self) -> Column:
        return F.lit(self.holds)


def parse_rule(text: str, groups: dict[str, list[str]] | None = None, uses: str = "procs", name: str = "program"):
    """A condition of a rule file as typed tests, without evaluating it as code.

    ``fact >= 1``, a fact alone (it is there and not 0), ``and``, ``or``, ``not``, brackets, True and False, ``uses('group')`` (the array
    ``uses`` has one of the group's words) and ``name_matches(r'pattern')`` (on column ``name``, in any case). Anything
    else is refused with its place.
    """
    found = [(m.lastgroup, m[0], m.start()) for m in _RULE.finditer(text) if m.lastgroup != "space"] + [("end", "", len(text))]
    at = 0

    def peek():
        return found[at][1]

    def take(*kinds: str) -> str:
        nonlocal at
        kind, value, place = found[at]
        if kind not in kinds and value not in kinds:
            raise ValueError(f"rule {text!r}: {value or 'end'!r} at {place}")
        at += 1
        return value

    def either():
        tests = [both()]
        while peek() == "or":
            take("or")
            tests.append(both())
        return tests[0] if len(tests) == 1 else AnyOf(tuple(tests))

    def both():
        tests = [single()]
        while peek() == "and":
            take("and")
            tests.append(single())
        return tests[0] if len(tests) == 1 else AllOf(tuple(tests))

    def single():
        if peek() == "not":
            take("not")
            return Not(single())
        if peek() == "(":
            take("(")
            test = either()
            take(")")
            return test
        word = take("name")
        if word in ("True", "False"):
            return Always(word == "True")
        if word in ("uses", "name_matches") and peek() == "(":
            take("(")
            value = take("text").removeprefix("r")[1:-1]
            take(")")
            if word == "name_matches":
                return Test(name, "matches", f"(?i){value}")
            if value not in (groups or {}):
                raise ValueError(f"rule {text!r}: no group {value!r}")
            return Test(uses, "has one of", tuple(groups[value]))
        if found[at][0] != "op":
            return Test(word, "holds", None)
        op = take("op")
        value = take("number", "text")
        kind = float(value) if "." in value else int(value) if value[0] in "-0123456789" else value.removeprefix("r")[1:-1]
        return Test(word, _COMPARISONS[op], kind)

    out = either()
    take("end")
    return out


_COMPARISONS = {"==": "eq", "!=": "ne", "<=": "le", ">=": "ge", "<": "lt", ">": "gt"}
_RULE = re.compile(r"(?P<space>\s+)|(?P<number>-?\d+(?:\.\d+)?)|(?P<text>r?'[^']*'|r?\"[^\"]*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|<|>)|(?P<other>.)")


def first_rule(rules: list[tuple[object, str]], otherwise: str) -> Column:
    """The label of the first rule that holds; one CASE expression, no evaluation of text."""
    out = F.lit(otherwise)
    for test, label in reversed(rules):
        out = F.when(test.column(), F.lit(label)).otherwise(out)
    return out


def keyword_area(df: DataFrame, key: str, sources: dict[str, float], areas: dict[str, list[str]], min_score: float = 2.0) -> DataFrame:
    """(key, best, top, runner_up, label, confidence): weighted hits of each area's keywords in the source columns.

    Under ``min_score`` or on a tie the label is Other with LOW confidence; else HIGH if the top is at least twice the
    second, MEDIUM if not. Scores are an array in the row, so nothing is shuffled.
    """
    words = df.select(key, *[tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in sources])
    scores = []
    for area, keywords in areas.items():
        total = F.lit(0.0)
        for c, weight in sources.items():
            for k in keywords:
                total = total + weight * keyword_hits(F.col(c), k)
        scores.append(F.struct((-total).alias("s"), F.lit(area).alias("area")))
    ranked = words.withColumn("r", F.array_sort(F.array(*scores)))
    top, second = -F.get("r", F.lit(0))["s"], F.coalesce(-F.get("r", F.lit(1))["s"], F.lit(0.0))
    out = ranked.select(key, F.get("r", F.lit(0))["area"].alias("best"), top.alias("top"), second.alias("runner_up"))
    weak = (F.col("top") < min_score) | (F.col("top") == F.col("runner_up"))
    return out.withColumns({"label": F.when(weak, "Other").otherwise(F.col("best")), "confidence": F.when(weak, "LOW").when(F.col("top") >= 2 * F.col("runner_up"), "HIGH").otherwise("MEDIUM")})


def complexity(df: DataFrame, key: str, lines: str, weights: dict[str, float], per_lines: int = 20, most: float = 3.0, moderate: float = 5.0, complex_: float = 10.0) -> DataFrame:
    """(key, score, label, drivers): capped line points plus weighted facts, and the three largest parts."""
    parts = {"lines": F.least(F.col(lines) / per_lines, F.lit(most))} | {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * w for f, w in weights.items()}
    score = F.round(sum(parts.values(), F.lit(0.0)), 2)
    ranked = F.slice(F.array_sort(F.filter(F.array(*[F.struct((-v).alias("v"), F.lit(n).alias("n")) for n, v in parts.items()]), lambda x: x["v"] < 0)), 1, 3)
    out = df.select(key, score.alias("score"), F.array_join(F.transform(ranked, lambda x: x["n"]), ", ").alias("drivers"))
    return out.withColumn("label", F.when(F.col("score") >= complex_, "Complex").when(F.col("score") >= moderate, "Moderate").otherwise("Simple"))


def triggered(df: DataFrame, text: str, triggers: dict[str, str]) -> DataFrame:
    """Adds ``rules``: the names of the patterns that a text matches, in any case."""
    names = F.array(*[F.when(F.col(text).rlike(f"(?i){p}"), n) for n, p in triggers.items()])
    return df.withColumn("rules", F.filter(names, lambda x: x.isNotNull()))
