"""Step programs to Spark plans: macros, then statements, then typed steps, then lazy DataFrames.

What isn't understood is refused with its construct and statement, never guessed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions.stats import brown, forecast_rows, forecast_states, ols
from ..operators import procs
from ..operators.steps import first_of_key, merge, sort
from ..sources.library import Libraries
from ..sources.records import INFORMATS, Field, read_records
from .lexer import Statement, Token, closing, name_at, statements, tokens

#: Values that INTO may bring to the driver: settings and lists of names.
INTO_MOST = 10_000


class Unsupported(Exception):
    def __init__(self, construct: str, statement: str = ""):
        super().__init__(f"{construct}: {statement}" if statement else construct)
        self.construct = construct


# ---------------------------------------------------------------- macros


@dataclass
class Macros:
    """Text substitution: %let, &name, %macro with positional and keyword parameters, %do over numbers, %include."""

    session: "Session"
    values: dict[str, str] = field(default_factory=dict)
    bodies: dict[str, tuple[list[tuple[str, str]], list[str]]] = field(default_factory=dict)

    def substitute(self, text: str, local: dict[str, str]) -> str:
        def put(m):
            name = m[1].lower()
            if name in local:
                return local[name]
            if name in self.values:
                return self.values[name]
            raise Unsupported("unresolved macro variable", m[0])

        # Macro variables stand in double quotes and bare text, not in single quotes.
        parts = re.split(r"('[^']*')", text)
        text = "".join(p if p.startswith("'") else re.sub(r"&(\w+)\.?", put, p) for p in parts)

        def call(m):
            name, args = m[1].lower(), [a.strip() for a in m[2].split(",")]
            sep = re.sub(r"%str\((.*)\)", r"\1", args[-1]) or " "
            if name == "scan":
                words = [w for w in args[0].split(" ") if w] if sep.isspace() else args[0].split(sep)
                return words[int(args[1]) - 1]
            return str(len(args[0].split()))

        text = re.sub(r"%(scan)\(((?:[^()]|%str\([^()]*\))*)\)", call, text)
        return re.sub(r"%sysfunc\((countw)\(((?:[^()]|%str\([^()]*\))*)\)\)", call, text)

    def holds(self, condition: str, local: dict[str, str]) -> bool:
        """A comparison of two texts, as numbers where both are; a single text holds if it is a number other than 0."""
        m = re.match(r"(.*?)\s*(<=|>=|\^=|~=|<>|=|<|>|\b(?:eq|ne|lt|le|gt|ge)\b)\s*(.*)$", self.substitute(condition, local), re.I)
        if not m:
            return (self.substitute(condition, local).strip() or "0") != "0"
        a, b = m[1].strip(), m[3].strip()
        number = r"-?\d+(?:\.\d+)?"
        if re.fullmatch(number, a) and re.fullmatch(number, b):
            a, b = float(a), float(b)
        op = E.SYMBOLS.get(m[2], m[2].lower())
        return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]

    def branch(self, statements: list[str], i: int, local, true: bool, first: str) -> int:
        """Runs the side of an %if that holds; gives the place after both."""

        def side(i: int, text: str) -> tuple[list[str], int]:
            if text.lower() != "%do":
                return [text], i + 1
            depth, end = 1, i + 1
            while depth:
                if end >= len(statements):
                    raise Unsupported("condition without end", statements[i])
                depth += bool(re.search(r"%do\b", statements[end], re.I)) - bool(re.match(r"%end\b", statements[end], re.I))
                end += 1
            return statements[i + 1 : end - 1], end

        then, after = side(i, first)
        other: list[str] = []
        if after < len(statements) and (m := re.match(r"%else\s+(.+)$", statements[after], re.I)):
            other, after = side(after, m[1])
        self.run(then if true else other, local)
        return after

    def run(self, statements: list[str], local: dict[str, str] | None = None):
        """Feeds expanded statements to the session, in order, so that values read at run time are known in time."""
        local, i = local or {}, 0
        while i < len(statements):
            s = statements[i]
            low = s.lower()
            if m := re.match(r"%macro\s+(\w+)\s*(?:\((.*)\))?$", s, re.I):
                end = next((j for j in range(i, len(statements)) if statements[j].lower().startswith("%mend")), None)
                if end is None:
                    raise Unsupported("macro without end", s)
                names = [p.partition("=") for p in (m[2] or "").split(",") if p.strip()]
                self.bodies[m[1].lower()] = ([(n.strip().lower(), d.strip()) for n, _, d in names], statements[i + 1 : end])
                i = end + 1
                continue
            if low.startswith(("%local", "%global")):
                pass
            elif m := re.match(r"%let\s+(\w+)\s*=\s*(.*)$", s, re.I):
                (local if local else self.values)[m[1].lower()] = self.substitute(m[2], local)
            elif m := re.match(r"%include\s+[\"']([^\"']+)[\"']$", s, re.I):
                self.run([x.text for x in statements(self.session.include(m[1]))], local)
            elif m := re.match(r"%do\s+(\w+)\s*=\s*(.+?)\s+%to\s+(.+)$", s, re.I):
                depth, end = 1, i + 1
                while depth:
                    if end >= len(statements):
                        raise Unsupported("loop without end", s)
                    depth += bool(re.match(r"%do\b", statements[end], re.I)) - bool(re.match(r"%end\b", statements[end], re.I))
                    end += 1
                low_, high = (int(self.substitute(x, local)) for x in (m[2], m[3]))
                for k in range(low_, high + 1):
                    local[m[1].lower()] = str(k)
                    self.run(statements[i + 1 : end - 1], local)
                i = end
                continue
            elif m := re.match(r"%if\s+(.+?)\s+%then\s+(.+)$", s, re.I):
                i = self.branch(statements, i, local, self.holds(m[1], local), m[2])
                continue
            elif (m := re.match(r"%(\w+)\s*(?:\((.*)\))?$", s)) and m[1].lower() in self.bodies:
                params, body = self.bodies[m[1].lower()]
                own = dict(params)
                for place, a in enumerate(x for x in self.substitute(m[2] or "", local).split(",") if x.strip()):
                    k, eq, v = a.partition("=")
                    if eq:
                        own[k.strip().lower()] = v.strip()
                    else:
                        own[params[place][0]] = a.strip()
                self.run(body, own)
            elif low.startswith("%"):
                raise Unsupported("macro statement", s)
            else:
                self.session.statement(self.substitute(s, local))
            i += 1


# ---------------------------------------------------------------- expressions

_WORDS = {"lt", "le", "gt", "ge", "eq", "ne"}
_AGGREGATES = {"sum": F.sum, "avg": F.avg, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "n": F.count, "std": F.stddev, "nmiss": lambda c: F.count_if(c.isNull())}


class Columns:
    """What an expression is made of where it becomes a Column."""

    lit, flag, compare, coalesce, concat, divide, power = F.lit, E.flag, E.compare, F.coalesce, F.concat, F.try_divide, F.pow
    largest, smallest, year_month = F.greatest, F.least, E.year_month
    #: Functions of one argument.
    SIMPLE = {"strip": F.trim, "trim": F.rtrim, "upcase": F.upper, "lowcase": F.lower, "missing": E.is_missing, "length": E.byte_length, "abs": F.abs, "year": F.year, "month": F.month, "day": F.day, "sqrt": F.sqrt, "log": F.log, "exp": F.exp, "int": lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)), "floor": F.floor, "ceil": F.ceil, "countw": E.count_words}

    @staticmethod
    def text(value: str) -> Column:
        return F.lit(value)

    @staticmethod
    def trimmed(c: Column) -> Column:
        return F.rtrim(c)

    @staticmethod
    def same(a: Column, b: Column) -> Column:
        return a.eqNullSafe(b)

    @staticmethod
    def known(c: Column) -> Column:
        return c.isNotNull()

    @staticmethod
    def truth(c: Column) -> Column:
        return F.coalesce(c != 0, F.lit(False))

    @staticmethod
    def missing() -> Column:
        return F.lit(None).cast("double")

    @staticmethod
    def day(text: str) -> Column:
        return F.to_date(F.lit(text), "ddMMMyyyy")

    @staticmethod
    def case(branches: list, otherwise) -> Column:
        out = F.when(*branches[0])
        for b in branches[1:]:
            out = out.when(*b)
        return out if otherwise is None else out.otherwise(otherwise)

    @staticmethod
    def formatted(c: Column, fmt: E.RangeFormat) -> Column:
        return fmt.apply(c)

    @staticmethod
    def months(day: Column, shift: Column) -> Column:
        return F.add_months(E.month_start(day), shift.cast("int"))

    @staticmethod
    def rounded(c: Column, unit: Column | None) -> Column:
        return F.round(c) if unit is None else F.round(c / unit) * unit

    @staticmethod
    def part(c: Column, start: Column, size: Column | None) -> Column:
        return F.substr(c, start.cast("int"), *([] if size is None else [size.cast("int")]))

    @staticmethod
    def word(c: Column, n: Column, separators: str) -> Column:
        return E.nth_word(c, n.cast("int"), separators)

    @staticmethod
    def remainder(a: Column, b: Column) -> Column:
        return F.when(b != 0, a % b)

    @staticmethod
    def date_of(m: Column, d: Column, y: Column) -> Column:
        return F.try_make_date(y.cast("int"), m.cast("int"), d.cast("int")) if hasattr(F, "try_make_date") else F.make_date(y.cast("int"), m.cast("int"), d.cast("int"))


class Expression:
    """A recursive-descent parser from tokens to a Column; comparisons are missing-aware and give 1 or 0.

    ``names`` gives the column of a name; without it, names are columns. ``query`` turns the tokens of a sub-query into a column.
    With ``aggregate``, calls of one argument by an aggregate's name are aggregates, and ``aggregated`` says if there was one.
    With ``plain_equality`` the equality of two names is SQL's, so that a join on it stays an equi-join.
    """

    kit = Columns

    def __init__(self, items, formats: dict[str, E.RangeFormat], names=None, query=None, aggregate: bool = False, plain_equality: bool = False):
        self.items = tuple(tokens(items)) if isinstance(items, str) else tuple(items)
        self.formats, self.names, self.query, self.aggregate, self.plain_equality = formats, names or (lambda parts: self._column(parts)), query, aggregate, plain_equality
        self.at, self.aggregated = 0, False

    @staticmethod
    def _column(parts: list[str]) -> Column:
        if len(parts) == 2 and parts[0] in ("first", "last"):
            return F.col(f"_{parts[0]}_{parts[1]}")
        if len(parts) > 1:
            raise Unsupported("name", ".".join(parts))
        return F.col(f"`{parts[0]}`")

    @property
    def text(self) -> str:
        return " ".join(t.text for t in self.items)

    def peek(self, ahead: int = 0) -> Token:
        return self.items[self.at + ahead] if self.at + ahead < len(self.items) else Token("end", "", 0, 0)

    def take(self, value: str | None = None) -> Token:
        t = self.peek()
        if t.kind == "end" or value is not None and t.low != value:
            raise Unsupported("expression", self.text)
        self.at += 1
        return t

    def word(self, *values: str) -> bool:
        """Takes the next words if they are these."""
        if all(self.peek(i).low == v and self.peek(i).kind != "str" for i, v in enumerate(values)):
            self.at += len(values)
            return True
        return False

    def value(self) -> Column:
        out, boolean = self.either()
        if self.at != len(self.items):
            raise Unsupported("expression", self.text)
        return self.kit.flag(out) if boolean else out

    def condition(self) -> Column:
        out, boolean = self.either()
        if self.at != len(self.items):
            raise Unsupported("expression", self.text)
        return out if boolean else self.kit.truth(out)

    def _bool(self, x):
        return x[0] if x[1] else self.kit.truth(x[0])

    def either(self):
        left = self.both()
        while self.word("or") or self.word("|"):
            left = (self._bool(left) | self._bool(self.both()), True)
        return left

    def both(self):
        left = self.negated()
        while self.word("and") or self.word("&"):
            left = (self._bool(left) & self._bool(self.negated()), True)
        return left

    def negated(self):
        if self.word("not") or self.word("^") or self.word("~"):
            return ~self._bool(self.negated()), True
        first = self.at
        left = self.sum()
        op = self.peek().low
        if self.peek().kind != "str" and (op in E.SYMBOLS or op in _WORDS):
            out = None
            while self.peek().kind != "str" and ((op := self.peek().low) in E.SYMBOLS or op in _WORDS):
                self.take()
                second = self.at
                right = self.sum()
                a, b = self._padded(left, right, first, second)
                if self.plain_equality and E.SYMBOLS.get(op, op) == "eq" and all(t.kind == "name" or t.text == "." for t in (*self.items[first : second - 1], *self.items[second : self.at])):
                    test = a == b
                else:
                    test = self.kit.compare(a, op, b)
                # 1 < v < 6 holds if both comparisons do.
                out = test if out is None else out & test
                left, first = right, second
            return out, True
        inverted = self.word("not")
        test = None
        if self.word("in"):
            self.take("(")
            test = self.kit.lit(False)
            while not self.word(")"):
                second = self.at
                a, b = self._padded(left, self.sum(), first, second)
                test = test | self.kit.same(a, b)
                self.word(",")
        elif self.word("between"):
            low = self._num(self.sum())
            self.take("and")
            test = self.kit.compare(self._num(left), "ge", low) & self.kit.compare(self._num(left), "le", self._num(self.sum()))
        elif self.word("is", "not", "null") or self.word("is", "not", "missing"):
            test = self.kit.known(self._num(left))
        elif self.word("is", "null") or self.word("is", "missing"):
            test = ~self.kit.known(self._num(left))
        if test is None:
            if inverted:
                raise Unsupported("expression", self.text)
            return left
        return (~test if inverted else test), True

    def _padded(self, left, right, first: int, second: int):
        """Both sides of a comparison. Trailing blanks don't count against a text: they go from the text, and from the other side unless it is
        a plain name, whose column has none since tables lose them as they are read."""
        a, b = self._num(left), self._num(right)
        texts = [len(part) == 1 and part[0].kind == "str" for part in (self.items[first : second - 1], self.items[second : self.at])]
        if not any(texts):
            return a, b
        out = []
        for side, part, text in zip((a, b), (self.items[first : second - 1], self.items[second : self.at]), texts):
            plain = all(t.kind == "name" or t.text == "." for t in part)
            out.append(self.kit.text(part[0].value.rstrip(" ")) if text else side if plain else self.kit.trimmed(side))
        return tuple(out)

    def _num(self, x):
        return self.kit.flag(x[0]) if x[1] else x[0]

    def sum(self):
        left = self.product()
        while self.peek().text in ("+", "-", "||"):
            op = self.take().text
            a, b = self._num(left), self._num(self.product())
            left = ({"+": lambda: a + b, "-": lambda: a - b, "||": lambda: self.kit.concat(a, b)}[op](), False)
        return left

    def product(self):
        left = self.unary()
        while self.peek().text in ("*", "/", "**"):
            op = self.take().text
            a, b = self._num(left), self._num(self.unary())
            left = ({"*": lambda: a * b, "/": lambda: self.kit.divide(a, b), "**": lambda: self.kit.power(a, b)}[op](), False)
        return left

    def unary(self):
        if self.peek().text == "-":
            self.take()
            return -self._num(self.unary()), False
        t = self.take()
        if t.kind == "num":
            return self.kit.lit(float(t.text) if "." in t.text or "e" in t.low else int(t.text)), False
        if t.kind == "str":
            if self.peek().low == "d" and self.peek().start == t.end:
                self.take()
                return self.kit.day(t.value), False
            return self.kit.text(t.value), False
        if t.text == "(":
            if self.peek().low == "select" and self.query:
                end = closing(self.items, self.at - 1)
                inside, self.at = self.items[self.at : end], end + 1
                return self.query(inside), False
            inside = self.either()
            self.take(")")
            return inside
        if t.text == ".":
            return self.kit.missing(), False
        if t.kind != "name":
            raise Unsupported("expression", self.text)
        if t.low == "case":
            return self.case(), False
        if self.peek().text in ("[", "{"):
            return self.element(t.low), False
        if self.peek().text == "(":
            return self.call(t.low), False
        parts = [t.low]
        while self.peek().text == "." and self.peek(1).kind == "name" and self.peek().start == t.end:
            self.take()
            t = self.take()
            parts.append(t.low)
        if parts == ["calculated"] and self.peek().kind == "name":
            parts = ["calculated", self.take().low]
        return self.names(parts), False

    def element(self, name: str):
        raise Unsupported("ARRAY", self.text)

    def case(self) -> Column:
        branches, otherwise = [], None
        while self.word("when"):
            test = self._bool(self.either())
            self.take("then")
            branches.append((test, self._num(self.either())))
        if not branches:
            raise Unsupported("expression", self.text)
        if self.word("else"):
            otherwise = self._num(self.either())
        self.take("end")
        return self.kit.case(branches, otherwise)

    def call(self, name: str) -> Column:
        kit = self.kit
        self.take("(")
        if name == "put":
            x = self._num(self.either())
            self.take(",")
            fmt = self.take().low.rstrip(".")
            while not self.word(")"):
                self.take()
            if fmt in ("yymmn6", "yymmn"):
                return kit.year_month(x)
            if fmt not in self.formats:
                raise Unsupported("format", fmt)
            return kit.formatted(x, self.formats[fmt])
        if self.aggregate and name == "count":
            distinct = self.word("distinct")
            if self.word("*", ")"):
                self.aggregated = True
                return F.count(F.lit(1))
            x = self._num(self.either())
            self.take(")")
            self.aggregated = True
            return F.countDistinct(x) if distinct else F.count(x)
        if name == "intnx":
            if self.take().value.lower() != "month":
                raise Unsupported("interval", self.text)
            self.take(",")
            day = self._num(self.either())
            self.take(",")
            shift = self._num(self.either())
            if self.word(",") and self.take().value.lower() not in ("b", "beginning"):
                raise Unsupported("alignment", self.text)
            self.take(")")
            return kit.months(day, shift)
        args, last = [], None
        while not self.word(")"):
            last = self.peek()
            args.append(self._num(self.either()))
            self.word(",")
        if self.aggregate and len(args) == 1 and name in _AGGREGATES:
            self.aggregated = True
            return _AGGREGATES[name](args[0])
        if name in kit.SIMPLE and len(args) == 1:
            return kit.SIMPLE[name](*args)
        if name in ("max", "min") and len(args) > 1:
            return (kit.largest if name == "max" else kit.smallest)(*args)
        if name == "sum" and args:
            out = kit.coalesce(args[0], kit.lit(0))
            for a in args[1:]:
                out = out + kit.coalesce(a, kit.lit(0))
            return out
        if name == "round" and len(args) in (1, 2):
            return kit.rounded(args[0], args[1] if len(args) == 2 else None)
        if name == "coalesce" and args:
            return kit.coalesce(*args)
        if name == "substr" and len(args) in (2, 3):
            return kit.part(*args, *([None] if len(args) == 2 else []))
        if name == "scan" and (len(args) == 2 or len(args) == 3 and last.kind == "str"):
            return kit.word(args[0], args[1], re.escape(last.value) if len(args) == 3 else " ")
        if name == "mod" and len(args) == 2:
            return kit.remainder(*args)
        if name == "mdy" and len(args) == 3:
            return kit.date_of(*args)
        if name == "cats" and args:
            return kit.concat(*[kit.coalesce(kit.SIMPLE["strip"](a), kit.text("")) for a in args])
        if name in ("lag", "dif"):
            raise Unsupported("LAG", self.text)
        raise Unsupported("function", name)


# ---------------------------------------------------------------- steps


@dataclass
class Table:
    """A table of a statement, with its data set options."""

    name: str
    keep: list[str] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)
    rename: dict[str, str] = field(default_factory=dict)
    where: tuple = ()
    flag: str = ""

    def shape(self, df: DataFrame, session: "Session", also: tuple[str, ...] = ()) -> DataFrame:
        """Columns are kept or dropped, then renamed, then rows are filtered. ``also`` stay in any case."""
        df = df.select(*self.keep, *also) if self.keep else df
        df = df.drop(*self.drop).withColumnsRenamed(self.rename)
        return df.where(session.expression(self.where).condition()) if self.where else df


def _pairs(items) -> dict[str, str]:
    words = [t.low for t in items if t.text not in ("(", ")")]
    if len(words) % 3 or any(words[i + 1] != "=" for i in range(0, len(words), 3)):
        raise Unsupported("rename", " ".join(words))
    return {words[i]: words[i + 2] for i in range(0, len(words), 3)}


def _table_at(items, at: int) -> tuple[Table, int]:
    name, after = name_at(items, at)
    if not name:
        raise Unsupported("table", " ".join(t.text for t in items))
    out = Table(name)
    if after < len(items) and items[after].text == "(":
        end, at = closing(items, after), after + 1
        while at < end:
            key = items[at].low
            if at + 1 >= end or items[at + 1].text != "=":
                raise Unsupported("data set option", items[at].text)
            stop = at + 2
            if items[stop].text == "(":
                stop = closing(items, stop) + 1
            else:
                while stop < end and not (stop + 1 < end and items[stop + 1].text == "="):
                    stop += 1
            value = items[at + 2 : stop]
            if key == "keep":
                out.keep = [t.low for t in value]
            elif key == "drop":
                out.drop = [t.low for t in value]
            elif key == "rename":
                out.rename = _pairs(value)
            elif key == "where":
                out.where = value
            elif key == "in":
                out.flag = value[0].low
            else:
                raise Unsupported("data set option", key)
            at = stop
        after = end + 1
    return out, after


def _tables(items, at: int) -> list[Table]:
    out = []
    while at < len(items):
        table, at = _table_at(items, at)
        out.append(table)
    return out


def _option(s: Statement, name: str) -> Table | None:
    """The table that an option of a procedure names."""
    for i in range(len(s.tokens) - 2):
        if s.tokens[i].low == name and s.tokens[i + 1].text == "=":
            return _table_at(s.tokens, i + 2)[0]
    return None


def _number(s: Statement, name: str, otherwise: float) -> float:
    found = _option(s, name) if any(t.low == name for t in s.tokens) else None
    return float(found.name) if found else otherwise


#: What a DATA step as one plan can't say and one that goes through the rows of a group can.
ROWWISE = ("RETAIN of another form", "accumulator changed twice", "sum without a start at FIRST.", "accumulator read before its statement", "start at FIRST. after rows were left out", "ARRAY", "LAG", "DO")


class _DataStep:
    """Runs the statements of a DATA step in their order on a plan: each sees the values and rows that those before it left.

    ``first.k`` and ``last.k`` are columns made before any filter but WHERE. Sums and retained maxima are windows over the
    rows that reach their statement. A condition becomes a column before what it governs runs.
    """

    IGNORED = ("format", "label", "attrib")

    def __init__(self, session: "Session", block: list[Statement]):
        self.session, self.block, self.made, self.hidden = session, block, 0, []
        self.targets = _tables(block[0].tokens, 1)
        self.by, self.retained, self.keep, self.drop, self.rename = [], {}, [], [], {}
        self.starts: dict[str, tuple[int, object]] = {}
        self.done: set[str] = set()
        self.emitted: dict[str, list[DataFrame]] = {}
        self.filtered = False
        self.widths: dict[str, int] = {}
        self.informats: dict[str, str] = {}
        self.sources: list[Table] = []
        self.merging, self.infile, self.input = False, None, None
        self.body, self.wheres, self.first_widths = [], [], []
        self._read()
        self.sums = {w[0].low for s in self.body for w in self._sum_tokens(s)}
        self.always = any(t.low == "output" for s in self.body for t in s.tokens)
        self._open()
        self.go()

    def _read(self) -> None:
        """Sorts the statements into what the step reads, what it declares and what it does."""
        for s in self.block[1:]:
            words = [t.low for t in s.tokens]
            if words[1:2] == ["="] or words[1:2] == ["+"]:
                self.body.append(s)
            elif s.head in ("set", "merge"):
                tables = _tables(s.tokens, 1)
                if self.sources or self.infile or len(tables) != (2 if s.head == "merge" else 1):
                    raise Unsupported(f"{s.head.upper()} of several tables", s.text)
                self.sources, self.merging = tables, s.head == "merge"
                # Widths declared before a table is read hold for its texts too.
                self.first_widths = list(self.widths)
            elif s.head == "infile":
                if self.sources or self.infile:
                    raise Unsupported("INFILE beside another source", s.text)
                self.infile = s
            elif s.head == "input":
                self.input = s
            elif s.head == "length":
                self._lengths(s)
            elif s.head == "informat":
                self._informats(s)
            elif s.head in self.IGNORED:
                continue
            elif s.head == "by":
                self.by = words[1:]
                if "descending" in self.by:
                    raise Unsupported("BY DESCENDING", s.text)
            elif s.head == "retain":
                self._retain(s)
            elif s.head == "array":
                self._array(s)
            elif s.head in ("keep", "drop"):
                getattr(self, s.head).extend(words[1:])
            elif s.head == "rename":
                self.rename |= _pairs(s.tokens[1:])
            elif s.head == "where":
                self.wheres.append(s)
            elif s.head in ("call", "link", "goto", "update", "modify", "select", "put", "file", "declare", "dcl"):
                raise Unsupported(s.head.upper(), s.text)
            else:
                self.body.append(s)
        if not self.sources and not self.infile:
            raise Unsupported("DATA step without SET", self.block[0].text)
        if self.merging and not self.by:
            raise Unsupported("MERGE without BY", self.block[0].text)

    def _lengths(self, s: Statement) -> None:
        """LENGTH: texts are cut at so many bytes; numbers keep all eight, and shorter ones are refused."""
        names, at = [], 1
        while at < len(s.tokens):
            t = s.tokens[at]
            if t.kind == "name":
                names.append(t.low)
            else:
                text = t.text == "$"
                at += text
                if at >= len(s.tokens) or not s.tokens[at].text.rstrip(".").isdigit() or not names:
                    raise Unsupported("LENGTH", s.text)
                n = int(s.tokens[at].text.rstrip("."))
                if not text and n != 8:
                    raise Unsupported("LENGTH of a number", s.text)
                if text:
                    self.widths |= {k: n for k in names}
                names = []
            at += 1
        if names:
            raise Unsupported("LENGTH", s.text)

    def _informats(self, s: Statement) -> None:
        names, at = [], 1
        while at < len(s.tokens):
            if s.tokens[at].kind != "name":
                raise Unsupported("INFORMAT", s.text)
            last = at + 1 < len(s.tokens) and s.tokens[at + 1].text == "."
            if last:
                self.informats |= {k: self._informat(s.tokens[at].low, s) for k in names}
                names = []
            else:
                names.append(s.tokens[at].low)
            at += 1 + last
        if names:
            raise Unsupported("INFORMAT", s.text)

    @staticmethod
    def _informat(name: str, s: Statement) -> str:
        known = name.rstrip("0123456789")
        if known not in INFORMATS:
            raise Unsupported("informat", name)
        return known

    def _fields(self) -> DataFrame:
        """The rows of INFILE: delimited records (DSD), short ones filled (TRUNCOVER or MISSOVER), columns as INPUT lists them."""
        s, options = self.infile, {}
        if self.input is None:
            raise Unsupported("INFILE without INPUT", s.text)
        at = 2
        while at < len(s.tokens):
            key = s.tokens[at].low
            if at + 2 < len(s.tokens) and s.tokens[at + 1].text == "=":
                options[key], at = s.tokens[at + 2].value, at + 3
            else:
                options[key], at = "", at + 1
        if bad := set(options) - {"dsd", "firstobs", "truncover", "missover", "dlm", "delimiter", "encoding", "lrecl"}:
            raise Unsupported("INFILE option", ", ".join(sorted(bad)))
        if "dsd" not in options or not {"truncover", "missover"} & set(options) or options.get("firstobs", "1") not in ("1", "2"):
            raise Unsupported("INFILE of another form", s.text)
        path, encoding = self.session.file(s.tokens[1])
        fields, at, items = [], 1, self.input.tokens
        while at < len(items):
            name, text, informat = items[at].low, False, None
            if items[at].kind != "name":
                raise Unsupported("INPUT of another form", self.input.text)
            at += 1
            if at < len(items) and items[at].text == ":":
                at += 1
                text = at < len(items) and items[at].text == "$"
                if not text:
                    informat = self._informat(items[at].low, self.input)
                at += 1
                if at < len(items) and items[at].kind == "num":
                    self.widths.setdefault(name, int(items[at].text.rstrip("."))) if text else None
                    at += 1
                at += at < len(items) and items[at].text == "."
            elif at < len(items) and items[at].text == "$":
                text, at = True, at + 1
            text = text or name in self.widths
            fields.append(Field(name, text, self.widths.get(name, 8 if text else None), informat or self.informats.get(name, "best")))
        return read_records(self.session.libraries.spark, path, fields, options.get("encoding") or encoding, options.get("dlm") or options.get("delimiter") or ",", options.get("firstobs") == "2")

    def _open(self) -> None:
        """The rows that the step reads, with what gives them their order, and marks of BY groups."""
        session = self.session
        if self.infile:
            self.name, self.order, df = "infile", {}, self._fields()
        elif self.merging:
            sides, orders = [], []
            for t in self.sources:
                name = t.name if "." in t.name else f"work.{t.name}"
                sides.append(t.shape(session.read(t.name), session))
                orders.append([c for c in dict.fromkeys([*session.sorted_by.get(name, []), *session.row_order.get(name, [])]) if c in sides[-1].columns and c not in self.by] or None)
            self.name = self.sources[0].name if "." in self.sources[0].name else f"work.{self.sources[0].name}"
            df = merge(sides[0], sides[1], self.by, *orders, *[t.flag or None for t in self.sources], place="_order_0")
            self.order = {"": "_order_0"}
            self.hidden += ["_order_0", *[t.flag for t in self.sources if t.flag]]
        else:
            source = self.sources[0]
            self.name = source.name if "." in source.name else f"work.{source.name}"
            # What gives rows their order stays, whatever columns are kept.
            order = list(dict.fromkeys([*session.sorted_by.get(self.name, []), *session.row_order.get(self.name, [])])) if self.by else []
            self.order = {c: f"_order_{i}" for i, c in enumerate(order)}
            self.hidden += self.order.values()
            df = source.shape(session.read(source.name).withColumns({h: F.col(c) for c, h in self.order.items()}), session, tuple(self.hidden))
        cut = [c for c in self.first_widths if c in df.columns and dict(df.dtypes)[c] == "string"]
        self.df = df.withColumns({c: E.cut_bytes(F.col(c), self.widths[c]) for c in cut}) if cut else df
        for s in self.wheres:
            self.df = self.df.where(session.expression(s.tokens[1:]).condition())
        if self.by:
            self._mark_groups()

    def go(self) -> None:
        self.execute(self.body, None)
        for t in self.targets:
            rows = self.emitted.get(t.name, []) if self.always else [self._row(self.df)]
            if not rows:
                rows = [self._row(self.df).limit(0)]
            out = rows[0]
            for x in rows[1:]:
                out = out.unionByName(x, allowMissingColumns=True)
            self.session.write(t.name, t.shape(out, self.session), self.session.sorted_by.get(self.name))

    def _array(self, s: Statement) -> None:
        raise Unsupported("ARRAY", s.text)

    def _sum_tokens(self, s: Statement):
        """Sum statements anywhere in a statement: name + expression."""
        for start in [0, *[i + 1 for i, t in enumerate(s.tokens) if t.low in ("then", "else")]]:
            part = s.tokens[start:]
            if len(part) > 2 and part[0].kind == "name" and part[1].text == "+" and part[0].low not in ("if", "else"):
                yield part

    def _retain(self, s: Statement) -> None:
        names: list[str] = []
        for t in s.tokens[1:]:
            if t.kind == "name":
                names.append(t.low)
                self.retained[t.low] = None
            elif t.kind == "num":
                for n in names:
                    self.retained[n] = float(t.text) if "." in t.text else int(t.text)
                names = []
            else:
                raise Unsupported("RETAIN of another form", s.text)

    def _row(self, df: DataFrame) -> DataFrame:
        rows = df.drop(*self.hidden)
        return (rows.select(*self.keep) if self.keep else rows.drop(*self.drop)).withColumnsRenamed(self.rename)

    def _window(self, keys: list[str]):
        if not self.order:
            raise Unsupported("BY group without a known order", self.name)
        order = [*[c for c in self.by if c not in keys], *self.order.values()]
        return Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])

    def _mark_groups(self) -> None:
        marks = {}
        for i, k in enumerate(self.by):
            w = self._window(self.by[: i + 1])
            marks[f"_first_{k}"] = (F.row_number().over(w) == 1).cast("int")
            marks[f"_last_{k}"] = F.lead(F.lit(0), 1, 1).over(w)
        self.df = self.df.withColumns(marks)
        self.hidden += marks

    def _condition(self, items) -> str:
        """A column for a condition, as its value is now."""
        self.made += 1
        name = f"_if_{self.made}"
        self.df = self.df.withColumn(name, self.session.expression(items).condition())
        self.hidden.append(name)
        return name

    def _mask(self, *parts: Column | None) -> str | None:
        live = [p for p in parts if p is not None]
        if not live:
            return None
        self.made += 1
        name = f"_if_{self.made}"
        test = live[0]
        for p in live[1:]:
            test = test & p
        self.df = self.df.withColumn(name, test)
        self.hidden.append(name)
        return name

    def execute(self, body: list[Statement], mask: str | None, first: str | None = None) -> None:
        """``first``: the BY variable whose first row is the mask, if it is."""
        i = 0
        while i < len(body):
            s = body[i]
            if s.head == "if" and any(t.low == "then" and t.kind == "name" for t in s.tokens):
                i = self._chain(body, i, mask)
            elif s.head == "do" and len(s.tokens) == 1:
                inner, i = self._group(body, i)
                self.execute(inner, mask, first)
            else:
                self.one(s, s.tokens, mask, first)
                i += 1

    @staticmethod
    def _group(body, i: int) -> tuple[list[Statement], int]:
        """The statements between DO and its END, and the place after it."""
        depth, at = 1, i + 1
        while depth:
            if at >= len(body):
                raise Unsupported("DO without END", body[i].text)
            opens = body[at].tokens[-1].low == "do" or body[at].head == "do"
            depth += opens - (body[at].head == "end" and len(body[at].tokens) == 1)
            at += 1
        return body[i + 1 : at - 1], at

    def _chain(self, body, i: int, mask: str | None) -> int:
        """IF THEN and the ELSE statements after it: the first true branch runs."""
        before: list[str] = []
        while i < len(body):
            items = body[i].tokens
            if before:
                if items[0].low != "else":
                    break
                items = items[1:]
            first = None
            outer = [F.col(mask)] if mask else []
            if items and items[0].low == "if" and any(t.low == "then" for t in items):
                then = next(k for k, t in enumerate(items) if t.low == "then" and t.kind == "name")
                test = self._condition(items[1:then])
                own = self._mask(*outer, *[~F.col(b) for b in before], F.col(test))
                if [t.low for t in items[1:then]][:2] == ["first", "."] and then == 4 and not before and not mask:
                    first = items[3].low
                before.append(test)
                items = items[then + 1 :]
                last = False
            elif before:
                own = self._mask(*outer, *[~F.col(b) for b in before])
                last = True
            else:
                raise Unsupported("IF", body[i].text)
            if [t.low for t in items] == ["do"]:
                inner, i = self._group(body, i)
                self.execute(inner, own, first)
            else:
                self.one(body[i], items, own, first)
                i += 1
            if last:
                break
        return i

    def one(self, s: Statement, items, mask: str | None, first: str | None) -> None:
        words = [t.low for t in items]
        if words[:1] == ["output"]:
            self._output(words, items, mask)
        elif words == ["delete"]:
            self.df = self.df.where(~F.col(mask)) if mask else self.df.limit(0)
            self.filtered = True
        elif words[:1] == ["if"]:
            test = self.session.expression(items[1:]).condition()
            self.df = self.df.where(~F.col(mask) | test if mask else test)
            self.filtered = True
        elif len(words) > 2 and words[1] == "+" and items[0].kind == "name":
            self._sum(s, words[0], items[2:], mask)
        elif len(words) > 2 and words[1] == "=" and items[0].kind == "name":
            self._assign(s, words[0], items[2:], mask, first)
        else:
            counted = len(words) > 2 and words[1] in ("[", "{", "(")
            raise Unsupported("ARRAY" if counted else words[0].upper() if words and words[0] in ("do", "end", "else", "return", "stop", "abort") else "statement", s.text)

    def _output(self, words, items, mask) -> None:
        names = [t.name for t in _tables(items, 1)] if len(words) > 1 else [t.name for t in self.targets]
        rows = self._row(self.df.where(F.col(mask)) if mask else self.df)
        for n in names:
            if n not in [t.name for t in self.targets]:
                raise Unsupported("OUTPUT to another table", n)
            self.emitted.setdefault(n, []).append(rows)

    def _running(self, s: Statement, name: str) -> tuple:
        """The window over which an accumulator runs, and its start."""
        if name in self.done:
            raise Unsupported("accumulator changed twice", s.text)
        self.done.add(name)
        if name not in self.starts:
            raise Unsupported("sum without a start at FIRST.", s.text)
        level, start = self.starts[name]
        return self._window(self.by[:level]).rowsBetween(Window.unboundedPreceding, 0), start

    def _sum(self, s, name, items, mask) -> None:
        window, start = self._running(s, name)
        self._unread(items, s)
        value = F.coalesce(self.session.expression(items).value(), F.lit(0))
        self.df = self.df.withColumn(name, F.lit(start) + F.sum(F.when(F.col(mask), value).otherwise(F.lit(0)) if mask else value).over(window))

    def _unread(self, items, s) -> None:
        for t in items:
            if (t.low in self.sums or t.low in self.retained) and t.low not in self.done:
                raise Unsupported("accumulator read before its statement", s.text)

    def _assign(self, s, name, items, mask, first) -> None:
        accumulator = name in self.sums or name in self.retained
        words = [t.low for t in items]
        if accumulator and first and all(t.kind == "num" or t.text == "-" for t in items):
            if self.filtered:
                raise Unsupported("start at FIRST. after rows were left out", s.text)
            if first not in self.by:
                raise Unsupported("FIRST. without BY", s.text)
            text = "".join(words)
            self.starts[name] = (self.by.index(first) + 1, float(text) if "." in text else int(text))
            return
        if accumulator:
            if name in self.sums or words[:3] != ["max", "(", name] or words[3:4] != [","] or words[-1] != ")" or mask:
                raise Unsupported("RETAIN of another form", s.text)
            window, start = self._running(s, name)
            value = self.session.expression(items[4:-1]).value()
            self.df = self.df.withColumn(name, F.greatest(F.max(value).over(window), F.lit(start)))
            return
        self._unread(items, s)
        value = self.session.expression(items).value()
        if name in self.widths:
            value = E.cut_bytes(value, self.widths[name])
        if mask:
            value = F.when(F.col(mask), value).otherwise(F.col(f"`{name}`") if name in self.df.columns else F.lit(None))
        self.df = self.df.withColumn(name, value)


class _Select:
    """A SELECT as operators on plans; WHERE, HAVING and CASE have missing-aware comparisons. A join's equality of two columns
    follows SQL, so missing keys don't meet."""

    CLAUSES = ("from", "where", "group", "having", "order", "into")

    def __init__(self, session: "Session", items):
        self.session, self.named, self.into = session, {}, None
        parts = self._clauses(items)
        if "from" not in parts:
            raise Unsupported("SELECT without FROM", " ".join(t.text for t in items))
        self.into = parts.get("into")
        df = self._from(parts["from"])
        if "where" in parts:
            self._name_items(parts["select"], df)
            df = df.where(self._expression(parts["where"]).condition())
        self.result = self._project(df, parts)

    def _clauses(self, items) -> dict[str, tuple]:
        out, depth, now, start = {}, 0, "select", 1
        for i, t in enumerate(items):
            depth += (t.text == "(") - (t.text == ")")
            if not depth and i and t.kind == "name" and t.low in self.CLAUSES:
                out[now] = items[start:i]
                now, start = t.low, i + 2 if t.low in ("group", "order") else i + 1
        out[now] = items[start:]
        return out

    def _expression(self, items, **more) -> Expression:
        return Expression(items, self.session.formats, names=self._name, query=self._scalar, **more)

    def _name(self, parts: list[str]) -> Column:
        if parts[0] == "calculated":
            if parts[1] not in self.named:
                raise Unsupported("CALCULATED", parts[1])
            return self.named[parts[1]]
        return F.col(".".join(f"`{p}`" for p in parts))

    def _scalar(self, items) -> Column:
        return _Select(self.session, items).result.scalar()

    def _source(self, items, at: int) -> tuple[DataFrame, int]:
        if items[at].text == "(":
            end = closing(items, at)
            df, at, alias = _Select(self.session, items[at + 1 : end]).result, end + 1, None
        else:
            table, at = _table_at(items, at)
            df, alias = table.shape(self.session.read(table.name), self.session), table.name.split(".")[-1]
        at += at < len(items) and items[at].low == "as"
        if at < len(items) and items[at].kind == "name" and items[at].low not in ("inner", "left", "right", "full", "join", "on", "cross"):
            alias, at = items[at].low, at + 1
        return (df.alias(alias) if alias else df), at

    def _from(self, items) -> DataFrame:
        df, at = self._source(items, 0)
        while at < len(items):
            kind = "inner"
            if items[at].low in ("inner", "left", "right", "full"):
                kind, at = items[at].low, at + 1
                at += items[at].low == "outer"
            if items[at].low != "join":
                raise Unsupported("FROM", " ".join(t.text for t in items))
            other, at = self._source(items, at + 1)
            if at >= len(items) or items[at].low != "on":
                raise Unsupported("JOIN without ON", " ".join(t.text for t in items))
            end, depth = at + 1, 0
            while end < len(items) and (depth or items[end].low not in ("inner", "left", "right", "full", "join") or items[end + 1].text == "."):
                depth += (items[end].text == "(") - (items[end].text == ")")
                end += 1
            df = df.join(other, self._expression(items[at + 1 : end], plain_equality=True).condition(), kind)
            at = end
        return df

    @staticmethod
    def _split(items) -> list[tuple]:
        out, depth, start = [], 0, 0
        for i, t in enumerate(items):
            depth += (t.text == "(") - (t.text == ")")
            if t.text == "," and not depth:
                out.append(items[start:i])
                start = i + 1
        return [*out, items[start:]]

    def _name_items(self, items, df: DataFrame) -> list[tuple[str | None, Column, bool, str]]:
        """(name, column, whether it aggregates, text) of each selected item; a star has no name."""
        out = []
        items = items[1:] if items and items[0].low == "distinct" else items
        for n, part in enumerate(self._split(items)):
            words = [t.low for t in part]
            if words == ["*"] or len(words) == 3 and words[1:] == [".", "*"]:
                out.append((None, F.col("*") if len(words) == 1 else F.col(f"{words[0]}.*"), False, ""))
                continue
            end = next((i for i, w in enumerate(words) if w in ("format", "label", "length", "informat") and words[i + 1 : i + 2] == ["="]), len(part))
            part, words = part[:end], words[:end]
            name = words[-1] if len(words) > 2 and words[-2] == "as" else None
            part = part[:-2] if name else part
            name = name or (words[-1] if all(t.kind == "name" or t.text == "." for t in part) else f"_c{n}")
            made = self._expression(part, aggregate=True)
            column = made.value()
            self.named[name] = column
            out.append((name, column, made.aggregated, " ".join(t.low for t in part)))
        return out

    def _project(self, df: DataFrame, parts) -> DataFrame:
        chosen = self._name_items(parts["select"], df)
        keys = []
        for part in self._split(parts["group"]) if "group" in parts else ():
            text = " ".join(t.low for t in part)
            bare = text.removeprefix("calculated ")
            found = next((c for c in chosen if c[0] == bare or c[3] == text), None)
            if len(part) == 1 and part[0].kind == "num":
                found = chosen[int(part[0].text) - 1]
            keys.append((found[1] if found else self._expression(part).value(), found))
        if keys or any(c[2] for c in chosen) or "having" in parts:
            df, after = self._grouped(df, chosen, keys, parts.get("having"))
        else:
            after = [c[1].alias(c[0]) if c[0] else c[1] for c in chosen]
        order = self._order(parts["order"], chosen) if "order" in parts else None
        distinct = parts["select"][:1] and parts["select"][0].low == "distinct"
        if distinct:
            df = df.select(*after).distinct()
            return df.orderBy(*order) if order else df
        return df.select(*after).orderBy(*order) if order else df.select(*after)

    def _grouped(self, df, chosen, keys, having):
        places = [next((k for k, (_, f) in enumerate(keys) if f is c), None) for c in chosen]
        for c, k in zip(chosen, places):
            if not c[2] and k is None:
                raise Unsupported("column that is neither grouped nor aggregated", c[3] or "*")
        sums = [c[1].alias(f"_a{i}") for i, c in enumerate(chosen) if c[2]]
        if having is not None:
            sums.append(self._expression(having, aggregate=True).condition().alias("_having"))
        grouped = df.groupBy(*[k.alias(f"_k{i}") for i, (k, _) in enumerate(keys)])
        out = grouped.agg(*sums) if sums else df.select(*[k.alias(f"_k{i}") for i, (k, _) in enumerate(keys)]).distinct()
        out = out.where("_having") if having is not None else out
        return out, [F.col(f"_a{i}" if c[2] else f"_k{k}").alias(c[0]) for i, (c, k) in enumerate(zip(chosen, places))]

    def _order(self, items, chosen) -> list[Column]:
        out = []
        for part in self._split(items):
            down = part[-1].low in ("desc", "descending")
            part = part[:-1] if down or part[-1].low in ("asc", "ascending") else part
            text = " ".join(t.low for t in part).removeprefix("calculated ")
            found = next((c[0] for c in chosen if c[0] == text or c[3] == text), None)
            if len(part) == 1 and part[0].kind == "num":
                found = chosen[int(part[0].text) - 1][0]
            if found is None and any(c[0] is None for c in chosen):
                found = part[-1].low
            if found is None:
                raise Unsupported("ORDER BY", text)
            out.append(F.col(f"`{found}`").desc_nulls_last() if down else F.col(f"`{found}`").asc_nulls_first())
        return out


class Session:
    """Runs programs over libraries. Tables a program makes are lazy until saved; ``tables`` has the work of the run.

    ``row_order`` names the columns that stand for a table's input order where a step depends on it (keep-first).
    ``save``: write permanent tables; without it they stay plans.
    """

    def __init__(self, libraries: Libraries, includes: dict[str, str] | None = None, row_order: dict[str, list[str]] | None = None, save: bool = False):
        self.libraries, self.includes, self.row_order, self.saving = libraries, includes or {}, row_order or {}, save
        self.tables: dict[str, DataFrame] = {}
        self.sorted_by: dict[str, list[str]] = {}
        self.order: dict[str, tuple] = {}
        self.formats: dict[str, E.RangeFormat] = {}
        self.files: dict[str, tuple[str, str]] = {}
        self.macros = Macros(self)
        self.block: list[Statement] = []

    def include(self, path: str) -> str:
        name = path.rsplit("/", 1)[-1]
        if name not in self.includes:
            raise Unsupported("include", path)
        return self.includes[name]

    def read(self, name: str) -> DataFrame:
        name = name.lower() if "." in name else f"work.{name.lower()}"
        return self.tables[name] if name in self.tables else self.libraries.read(name)

    def write(self, name: str, df: DataFrame, order: list[str] | None = None) -> None:
        name = name.lower() if "." in name else f"work.{name.lower()}"
        self.tables[name] = self.libraries.save(name, df) if self.saving and not name.startswith("work.") else df
        self.order.pop(name, None)
        self.sorted_by[name] = order or []

    def run(self, program: str) -> dict[str, DataFrame]:
        """The tables that a program makes; sorted ones are sorted here, as nothing before needs their rows in order."""
        before = set(self.tables)
        self.macros.run([s.text for s in statements(program)])
        if self.block:
            self.finish()
        return {k: sort(v, *self.order[k]) if k in self.order else v for k, v in self.tables.items() if k not in before}

    def statement(self, text: str) -> None:
        found = statements(text)
        if not found:
            return
        s = found[0]
        words = [t.low for t in s.tokens]
        starts = s.head in ("proc", "data") and words[1:2] != ["="]
        if starts and self.block:
            self.finish()
        if words in (["run"], ["quit"]):
            if self.block and not (words == ["run"] and [t.low for t in self.block[0].tokens[:2]] == ["proc", "sql"]):
                self.finish()
        elif self.block and [t.low for t in self.block[0].tokens[:2]] == ["proc", "sql"]:
            # Each statement runs at once, as the next may use what it reads.
            self.proc_sql([self.block[0], s])
        elif starts or self.block:
            self.block.append(s)
        elif s.head == "filename":
            self._filename(s)
        elif s.head not in ("libname", "options", "title", "footnote", "ods"):
            raise Unsupported("statement", s.text)

    def _filename(self, s: Statement) -> None:
        paths = [i for i, t in enumerate(s.tokens) if t.kind == "str" and (i < 1 or s.tokens[i - 1].text != "=")]
        if len(s.tokens) < 3 or not paths:
            raise Unsupported("FILENAME", s.text)
        encoding = next((s.tokens[i + 2].value for i in range(len(s.tokens) - 2) if s.tokens[i].low == "encoding" and s.tokens[i + 1].text == "="), "utf-8")
        self.files[s.tokens[1].low] = (s.tokens[paths[0]].value, encoding)

    def file(self, t: Token) -> tuple[str, str]:
        """(path, encoding) of a file that INFILE names by its path or by FILENAME."""
        if t.kind == "str":
            return t.value, "utf-8"
        if t.low not in self.files:
            raise Unsupported("file without FILENAME", t.text)
        return self.files[t.low]

    def finish(self) -> None:
        block, self.block = self.block, []
        if block[0].head == "data":
            try:
                _DataStep(self, block)
            except Unsupported as e:
                if e.construct not in ROWWISE:
                    raise
                from .rowstep import RowStep

                RowStep(self, block)
            return None
        kind = block[0].tokens[1].low
        step = getattr(self, f"proc_{kind}", None)
        if step is None:
            raise Unsupported("procedure", kind)
        return step(block)

    def expression(self, items) -> Expression:
        return Expression(items, self.formats)

    def source(self, s: Statement) -> tuple[Table, DataFrame]:
        """The table that a procedure reads."""
        table = _option(s, "data")
        if table is None:
            raise Unsupported("procedure without DATA=", s.text)
        return table, table.shape(self.read(table.name), self)

    def target(self, s: Statement, option: str, df: DataFrame, keys: list[str] | None = None) -> None:
        table = _option(s, option)
        if table is None:
            raise Unsupported(f"{option.upper()}= is missing", s.text)
        self.write(table.name, table.shape(df, self), keys)

    @staticmethod
    def words(block: list[Statement], head: str) -> list[str] | None:
        return next(([t.low for t in s.tokens[1:]] for s in block[1:] if s.head == head), None)

    def filtered(self, df: DataFrame, block: list[Statement]) -> DataFrame:
        for s in block[1:]:
            if s.head == "where":
                df = df.where(self.expression(s.tokens[1:]).condition())
        return df

    # -- PROC

    def proc_sort(self, block):
        """Keeps the order in mind; rows are sorted only where a table leaves the session."""
        s = block[0]
        table, df = self.source(s)
        target = _option(s, "out") or Table(table.name)
        words = self.words(block, "by")
        if not words:
            raise Unsupported("SORT without BY", s.text)
        down = tuple(b for a, b in zip(words, words[1:]) if a == "descending")
        keys = [w for w in words if w != "descending"]
        df = self.filtered(df, block)
        flags = {t.low for t in s.tokens}
        if flags & {"nodup", "noduprecs", "dupout"}:
            raise Unsupported("SORT option", s.text)
        if "nodupkey" in flags:
            full = table.name if "." in table.name else f"work.{table.name}"
            order = self.row_order.get(full)
            if order is None:
                raise Unsupported("NODUPKEY without a known input order", full)
            df = first_of_key(df, keys, order)
        self.write(target.name, target.shape(df, self), [] if down else keys)
        self.order[target.name if "." in target.name else f"work.{target.name}"] = (keys, down)

    def proc_means(self, block):
        s = block[0]
        classes, var = self.words(block, "class") or [], self.words(block, "var")
        output = next((x for x in block[1:] if x.head == "output"), None)
        for x in block[1:]:
            if x.head not in ("class", "var", "output", "where"):
                raise Unsupported(f"MEANS with {x.head.upper()}", x.text)
        if not var or not output:
            raise Unsupported("MEANS without VAR and OUTPUT", s.text)
        target, at, stats = None, 1, {}
        while at < len(output.tokens):
            if at + 2 >= len(output.tokens) or output.tokens[at + 1].text != "=":
                raise Unsupported("OUTPUT", output.text)
            if output.tokens[at].low == "out":
                target, at = _table_at(output.tokens, at + 2)
            else:
                # A name for each variable, in their order; fewer names leave the last ones out.
                kind, at = output.tokens[at].low, at + 2
                names = []
                while at < len(output.tokens) and output.tokens[at].kind == "name" and not (at + 1 < len(output.tokens) and output.tokens[at + 1].text == "="):
                    names.append(output.tokens[at].low)
                    at += 1
                if not names or len(names) > len(var):
                    raise Unsupported("OUTPUT", output.text)
                stats |= {n: (kind, v) for n, v in zip(names, var)}
        if bad := {k for k, _ in stats.values()} - set(procs.STATISTICS):
            raise Unsupported("statistic", ", ".join(sorted(bad)))
        if target is None:
            raise Unsupported("OUTPUT without OUT=", output.text)
        call = procs.means if any(t.low == "nway" for t in s.tokens) or not classes else procs.means_all
        df = self.filtered(self.source(s)[1], block)
        self.write(target.name, target.shape(call(df, classes, var[0], stats), self), classes)

    proc_summary = proc_means

    def proc_freq(self, block):
        s = next((x for x in block[1:] if x.head in ("tables", "table")), None)
        cut = next((i for i, t in enumerate(s.tokens) if t.text == "/"), None) if s else None
        if cut is None or not _option(s, "out"):
            raise Unsupported("FREQ", s.text if s else block[0].text)
        names = s.tokens[1:cut]
        if any((t.text == "*") != bool(i % 2) for i, t in enumerate(names)):
            raise Unsupported("FREQ of several tables", s.text)
        columns = [t.low for t in names[::2]]
        self.target(s, "out", procs.freq(self.filtered(self.source(block[0])[1], block), columns), columns)

    def proc_format(self, block):
        for s in block[1:]:
            if s.head != "value" or len(s.tokens) < 2 or s.tokens[1].kind != "name":
                raise Unsupported("FORMAT", s.text)
            intervals, other, at = [], None, 2
            while at < len(s.tokens):
                equal = next((i for i in range(at, len(s.tokens)) if s.tokens[i].text == "="), None)
                if equal is None or equal + 1 >= len(s.tokens) or s.tokens[equal + 1].kind != "str":
                    raise Unsupported("range", s.text)
                label, bounds = s.tokens[equal + 1].value, "".join(t.low for t in s.tokens[at:equal])
                at = equal + 2
                if bounds == "other":
                    other = label
                    continue
                m = re.fullmatch(r"(low|-?[\d.]+)(<)?(?:-(<)?(high|-?[\d.]+))?", bounds)
                if not m:
                    raise Unsupported("range", bounds)
                low, high = m[1], m[4] or m[1]
                intervals.append(E.Interval(None if low == "low" else float(low), None if high == "high" else float(high), label, bool(m[2]), bool(m[3])))
            self.formats[s.tokens[1].low] = E.RangeFormat(tuple(intervals), other)

    def proc_sql(self, block):
        for s in block[1:]:
            words = [t.low for t in s.tokens]
            if words[:2] == ["create", "table"]:
                table, at = _table_at(s.tokens, 2)
                if words[at : at + 2] != ["as", "select"]:
                    raise Unsupported("SQL", s.text)
                self.write(table.name, table.shape(_Select(self, s.tokens[at + 1 :]).result, self))
            elif words[:1] == ["select"]:
                made = _Select(self, s.tokens)
                if not made.into:
                    raise Unsupported("SELECT without a table", s.text)
                self._into(made, s)
            else:
                raise Unsupported("SQL", s.text)

    def _into(self, made: _Select, s: Statement) -> None:
        """Macro variables from the first row, or all rows with a separator: settings and lists of names."""
        wanted = []
        for part in _Select._split(made.into):
            if len(part) < 2 or part[0].text != ":":
                raise Unsupported("INTO", s.text)
            words = [t.low for t in part[2:]]
            if words not in ([], ["trimmed"], ["notrim"]) and words[:2] != ["separated", "by"]:
                raise Unsupported("INTO", s.text)
            wanted.append((part[1].low, part[4].value if words[:2] == ["separated", "by"] else None))
        listed = any(sep is not None for _, sep in wanted)
        rows = made.result.limit(INTO_MOST + 1 if listed else 1).collect()
        if len(rows) > INTO_MOST:
            raise Unsupported("INTO of over 10,000 values", s.text)
        for i, (name, sep) in enumerate(wanted):
            own = ["" if r[i] is None else str(r[i]).strip() for r in rows]
            self.macros.values[name] = sep.join(own) if sep is not None else (own[0] if own else "")

    def proc_reg(self, block):
        s = next((x for x in block[1:] if x.head == "model"), None)
        if s is None or len(s.tokens) < 4 or s.tokens[2].text != "=" or any(t.kind != "name" for t in s.tokens[3:]):
            raise Unsupported("REG", block[0].text)
        self._only(block, "model", "where")
        self.target(block[0], "outest", ols(self.filtered(self.source(block[0])[1], block), s.tokens[1].low, [t.low for t in s.tokens[3:]]))

    def proc_forecast(self, block):
        s = block[0]
        method = _option(s, "method")
        if method is None or method.name != "expo" or _number(s, "trend", 2) != 2:
            raise Unsupported("FORECAST method", s.text)
        self._only(block, "id", "var", "by", "where")
        time, var, by = (self.words(block, w) for w in ("id", "var", "by"))
        if not time or not var or len(var) != 1:
            raise Unsupported("FORECAST without ID and one VAR", s.text)
        fitted = brown(self.filtered(self.source(s)[1], block), time[0], var[0], by, weight=_number(s, "weight", 0.2), nstart=int(_number(s, "nstart", 12)), lead=int(_number(s, "lead", 12)))
        self.target(s, "out", forecast_rows(fitted, by).withColumnsRenamed({"month": time[0], "y": var[0]}), by)
        if _option(s, "outest"):
            self.target(s, "outest", forecast_states(fitted, by), by)

    @staticmethod
    def _only(block: list[Statement], *heads: str) -> None:
        """Refuses a procedure's other statements, which would change its result."""
        for x in block[1:]:
            if x.head not in heads:
                raise Unsupported(f"{block[0].tokens[1].text.upper()} with {x.head.upper()}", x.text)
