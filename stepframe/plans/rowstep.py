"""DATA steps whose values depend on the row before in any way: the rows of a BY group are gone through in order.

The statements become one Python function of a record of values, as source text. Rows are dealt out by BY group and sorted; each task runs the function over
its rows, batch by batch, and keeps the record from one batch to the next, so a group may be larger than a batch or memory.
Groups are independent only if nothing is carried from one into the next: each retained value must have been set in a group's first
row before it is read, which is checked beforehand; a step that doesn't is refused.
"""

from __future__ import annotations

import datetime as dt
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from itertools import repeat

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import RangeFormat
from ..sources.shared import new_folder
from .lexer import Statement
from .translator import Expression, Unsupported, _DataStep, _tables


class Source:
    """What the source text of a step's function refers to: objects by name, and names of its own."""

    def __init__(self):
        self.objects: dict[str, object] = {}
        self.n = 0

    def of(self, value) -> str:
        name = f"_g{len(self.objects)}"
        self.objects[name] = value
        return name

    def name(self) -> str:
        self.n += 1
        return f"_v{self.n}"


class Cell:
    """A value of the record: how it is got, and whether it is a number, a text or a date. ``reads``: the names it depends on.

    ``code``: the same as an expression in source text; without one, the text calls ``get``.
    """

    def __init__(self, get: Callable, kind: str = "number", reads: frozenset = frozenset(), code: Callable | None = None):
        self.get, self.kind, self.reads = get, kind, reads
        self.code = code or (lambda s: f"{s.of(get)}(r)")

    def _two(self, other: Cell, f: Callable, kind: str | None = None, code: str = "") -> Cell:
        a, b = self.get, other.get

        def get(r):
            x, y = a(r), b(r)
            return None if x is None or y is None else f(x, y)

        def text(s):
            x, y = s.name(), s.name()
            both = code.format(x=x, y=y, f=s.of(f)) if code else f"{s.of(f)}({x}, {y})"
            return f"(None if (({x} := {self.code(s)}) is None) | (({y} := {other.code(s)}) is None) else {both})"

        return Cell(get, kind or self.kind, self.reads | other.reads, text)

    def __add__(self, other):
        return self._two(other, _plus, None, "{x} + {y} if {x}.__class__ is float else {f}({x}, {y})")

    def __sub__(self, other):
        days = self.kind == "date" and other.kind == "date"
        return self._two(other, _minus, "number" if days else None, "{x} - {y} if {x}.__class__ is float else {f}({x}, {y})")

    def __mul__(self, other):
        return self._two(other, lambda x, y: x * y, None, "{x} * {y}")

    def __neg__(self):
        get = self.get

        def text(s):
            x = s.name()
            return f"(None if ({x} := {self.code(s)}) is None else -{x})"

        return Cell(lambda r: None if (x := get(r)) is None else -x, self.kind, self.reads, text)

    def __invert__(self):
        get = self.get
        return Cell(lambda r: not get(r), "boolean", self.reads, lambda s: f"(not {self.code(s)})")

    def __and__(self, other):
        a, b = self.get, other.get
        return Cell(lambda r: a(r) and b(r), "boolean", self.reads | other.reads, lambda s: f"({self.code(s)} and {other.code(s)})")

    def __or__(self, other):
        a, b = self.get, other.get
        return Cell(lambda r: a(r) or b(r), "boolean", self.reads | other.reads, lambda s: f"({self.code(s)} or {other.code(s)})")


def _plus(x, y):
    return x + dt.timedelta(days=int(y)) if isinstance(x, dt.date) else x + y


def _minus(x, y):
    if isinstance(x, dt.date):
        return (x - y).days if isinstance(y, dt.date) else x - dt.timedelta(days=int(y))
    return x - y


def _less(x, y) -> bool:
    return y is not None and (x is None or x < y)


_TESTS = {"lt": _less, "gt": lambda x, y: _less(y, x), "le": lambda x, y: not _less(y, x), "ge": lambda x, y: not _less(x, y), "eq": lambda x, y: x == y, "ne": lambda x, y: x != y}
#: The same as text: where one of the two is missing, and where none is.
_TEXTS = {
    "lt": ("{y} is not None", "{x} < {y}"), "gt": ("{x} is not None", "{y} < {x}"), "le": ("{x} is None", "not {y} < {x}"), "ge": ("{y} is None", "not {x} < {y}"),
}
_SIGNS = {"<": "lt", "<=": "le", ">": "gt", ">=": "ge", "=": "eq", "^=": "ne", "~=": "ne", "<>": "ne"}


def _whole(x: float) -> float:
    """To the nearest whole number, halves away from 0."""
    return float(Decimal(repr(float(x))).quantize(Decimal(1), ROUND_HALF_UP)) if math.isfinite(x) else x


def _one(f: Callable, kind: str = "number") -> Callable:
    """A function of one value that is missing where the value is, or where the value isn't in its domain."""

    def make(c: Cell) -> Cell:
        def get(r):
            x = c.get(r)
            return of(x)

        def of(x):
            try:
                return None if x is None else f(x)
            except (ValueError, OverflowError):
                return None

        return Cell(get, kind, c.reads, lambda s: f"{s.of(of)}({c.code(s)})")

    return make


class Cells:
    """What an expression is made of where it becomes a function of the record."""

    SIMPLE = {
        "strip": _one(lambda x: x.strip(" "), "text"), "trim": _one(lambda x: x.rstrip(" "), "text"), "upcase": _one(str.upper, "text"), "lowcase": _one(str.lower, "text"),
        "missing": lambda c: Cell(lambda r: int(c.get(r) is None), "number", c.reads, lambda s: f"(1 if {c.code(s)} is None else 0)"), "length": _one(lambda x: len(x.rstrip(" ").encode())), "abs": _one(abs), "year": _one(lambda x: x.year), "month": _one(lambda x: x.month), "day": _one(lambda x: x.day),
        "sqrt": _one(math.sqrt), "log": _one(lambda x: math.log(x)), "exp": _one(math.exp), "int": _one(math.trunc), "floor": _one(math.floor), "ceil": _one(math.ceil), "countw": _one(lambda x: len(x.split())),
    }

    @staticmethod
    def lit(value) -> Cell:
        plain = value is None or isinstance(value, (bool, int, str)) or isinstance(value, float) and math.isfinite(value)
        return Cell(lambda r: value, "boolean" if isinstance(value, bool) else "number", code=(lambda s: f"({value!r})") if plain else None)

    @staticmethod
    def text(value: str) -> Cell:
        return Cell(lambda r: value, "text", code=lambda s: repr(str(value)))

    @staticmethod
    def trimmed(c: Cell) -> Cell:
        return Cells.SIMPLE["trim"](c) if c.kind == "text" else c

    @staticmethod
    def missing() -> Cell:
        return Cell(lambda r: None, "number", code=lambda s: "None")

    @staticmethod
    def day(text: str) -> Cell:
        value = dt.datetime.strptime(text, "%d%b%Y").date()
        return Cell(lambda r: value, "date", code=lambda s: s.of(value))

    @staticmethod
    def flag(c: Cell) -> Cell:
        return Cell(lambda r: int(c.get(r)), "number", c.reads, lambda s: f"int({c.code(s)})")

    @staticmethod
    def truth(c: Cell) -> Cell:
        return Cell(lambda r: bool(c.get(r)), "boolean", c.reads, lambda s: f"bool({c.code(s)})")

    @staticmethod
    def known(c: Cell) -> Cell:
        return Cell(lambda r: c.get(r) is not None, "boolean", c.reads, lambda s: f"({c.code(s)} is not None)")

    @staticmethod
    def compare(a: Cell, op: str, b: Cell) -> Cell:
        op = _SIGNS.get(op, op)
        test = _TESTS[op]

        def text(s):
            if op not in _TEXTS:
                return f"({a.code(s)} {'==' if op == 'eq' else '!='} {b.code(s)})"
            x, y = s.name(), s.name()
            one, none = (t.format(x=x, y=y) for t in _TEXTS[op])
            if op in ("lt", "gt"):
                one = f"{one} and {x if op == 'lt' else y} is None"
            else:
                one = f"{one} or {y if op == 'le' else x} is not None"
            return f"(({one}) if (({x} := {a.code(s)}) is None) | (({y} := {b.code(s)}) is None) else {none})"

        return Cell(lambda r: test(a.get(r), b.get(r)), "boolean", a.reads | b.reads, text)

    @staticmethod
    def same(a: Cell, b: Cell) -> Cell:
        return Cells.compare(a, "eq", b)

    @staticmethod
    def coalesce(*cells: Cell) -> Cell:
        def text(s):
            parts = [(s.name(), c) for c in cells]
            return f"({' '.join(f'{x} if ({x} := {c.code(s)}) is not None else' for x, c in parts)} None)"

        return Cell(lambda r: next((x for c in cells if (x := c.get(r)) is not None), None), cells[0].kind, frozenset().union(*[c.reads for c in cells]), text)

    @staticmethod
    def concat(*cells: Cell) -> Cell:
        def get(r):
            parts = [c.get(r) for c in cells]
            return None if None in parts else "".join(map(str, parts))

        return Cell(get, "text", frozenset().union(*[c.reads for c in cells]))

    @staticmethod
    def divide(a: Cell, b: Cell) -> Cell:
        return a._two(b, lambda x, y: x / y if y else None, "number", "{x} / {y} if {y} else None")

    @staticmethod
    def power(a: Cell, b: Cell) -> Cell:
        return a._two(b, lambda x, y: float(x) ** y, "number")

    @staticmethod
    def _among(pick: Callable) -> Callable:
        def make(*cells: Cell) -> Cell:
            def get(r):
                return of(*[c.get(r) for c in cells])

            def of(*values):
                known = [x for x in values if x is not None]
                return pick(known) if known else None

            return Cell(get, cells[0].kind, frozenset().union(*[c.reads for c in cells]), lambda s: f"{s.of(of)}({', '.join(c.code(s) for c in cells)})")

        return make

    @staticmethod
    def case(branches: list, otherwise: Cell | None) -> Cell:
        def get(r):
            for test, value in branches:
                if test.get(r):
                    return value.get(r)
            return otherwise.get(r) if otherwise else None

        def text(s):
            return f"({' '.join(f'{value.code(s)} if {test.code(s)} else' for test, value in branches)} {otherwise.code(s) if otherwise else None})"

        return Cell(get, branches[0][1].kind, frozenset().union(*[x.reads for b in branches for x in b], otherwise.reads if otherwise else ()), text)

    @staticmethod
    def formatted(c: Cell, fmt: RangeFormat) -> Cell:
        def inside(x, i):
            return (i.low is None or (x > i.low if i.exclude_low else x >= i.low)) and (i.high is None or (x < i.high if i.exclude_high else x <= i.high))

        def get(r):
            x = c.get(r)
            found = None if x is None else next((i.label for i in fmt.intervals if inside(x, i)), None)
            return found if found is not None else fmt.other if fmt.other is not None or x is None else str(x)

        return Cell(get, "text", c.reads)

    year_month = staticmethod(_one(lambda x: f"{x:%Y%m}", "text"))

    @staticmethod
    def months(day: Cell, shift: Cell) -> Cell:
        def get(x, n):
            at = x.year * 12 + x.month - 1 + int(n)
            return dt.date(at // 12, at % 12 + 1, 1)

        return day._two(shift, get, "date")

    @staticmethod
    def rounded(c: Cell, unit: Cell | None) -> Cell:
        return _one(_whole)(c) if unit is None else c._two(unit, lambda x, u: _whole(x / u) * u if u else None)

    @staticmethod
    def part(c: Cell, start: Cell, size: Cell | None) -> Cell:
        rest = c._two(start, lambda x, n: x[max(0, int(n) - 1) :], "text")
        return rest if size is None else rest._two(size, lambda x, n: x[: int(n)], "text")

    @staticmethod
    def word(c: Cell, n: Cell, separators: str) -> Cell:
        def get(x, k):
            words = [w for w in re.split(f"[{separators}]+", x) if w]
            k = int(k)
            return words[k - 1 if k > 0 else k] if 0 < abs(k) <= len(words) else None

        return c._two(n, get, "text")

    @staticmethod
    def remainder(a: Cell, b: Cell) -> Cell:
        return a._two(b, lambda x, y: math.fmod(x, y) if y else None)

    @staticmethod
    def date_of(m: Cell, d: Cell, y: Cell) -> Cell:
        def get(r):
            parts = [c.get(r) for c in (y, m, d)]
            try:
                return None if None in parts else dt.date(*map(int, parts))
            except ValueError:
                return None

        return Cell(get, "date", m.reads | d.reads | y.reads)


Cells.largest, Cells.smallest = staticmethod(Cells._among(max)), staticmethod(Cells._among(min))


class RowExpression(Expression):
    """The expressions of a step as functions of the record."""

    kit = Cells

    def __init__(self, items, step: RowStep):
        super().__init__(items, step.session.formats, names=step.cell)
        self.step = step

    def element(self, name: str) -> Cell:
        if name not in self.step.arrays:
            raise Unsupported("ARRAY", self.text)
        close = {"[": "]", "{": "}", "(": ")"}[self.take().text]
        index = self._num(self.either())
        self.take(close)
        return self.step.element(name, index)

    def call(self, name: str) -> Cell:
        if name in self.step.arrays:
            return self.element(name)
        if name == "dim" and self.peek(1).low in self.step.arrays:
            self.take("(")
            n = len(self.step.arrays[self.take().low])
            self.take(")")
            return Cells.lit(n)
        if name in ("lag", "dif"):
            self.take("(")
            inside = self._num(self.either())
            self.take(")")
            return self.step.lag(inside, name == "dif")
        return super().call(name)


@dataclass
class _Carry:
    """What is known in a group's first row: names that still hold what the group before left (``held``), or a LAG of it (``stale``), array
    elements set by a loop's variable, names read while held, and the FIRST. that hold."""

    held: set
    stale: set
    elements: set
    read: set
    first: set

    def side(self) -> _Carry:
        return _Carry(set(self.held), set(self.stale), set(self.elements), self.read, self.first)

    def reads(self, names) -> None:
        self.read |= set(names) & (self.held | self.stale)


@dataclass
class _Act:
    """A statement: a function of the record, true if the row goes on, how it changes what is carried, and lines of source text
    that do the same and return False where the row ends; without these the function is called."""

    run: Callable
    carry: Callable
    code: Callable | None = None

    def lines(self, s: Source) -> list[str]:
        return self.code(s) if self.code else [f"if not {s.of(self.run)}(r):", "    return False"]


def _inside(lines: list[str]) -> list[str]:
    return [f"    {x}" for x in lines or ["pass"]]


def _compiled(source: str, objects: dict) -> Callable:
    names = dict(objects)
    exec(source, names)
    return names["run"]


class RowStep(_DataStep):
    """A DATA step that goes through the rows of each BY group."""

    def __init__(self, session, block):
        self.arrays: dict[str, list[str]] = {}
        self.kinds: dict[str, str] = {}
        self.places: dict[str, int] = {}
        self.lags = 0
        self.set_names: set[str] = set()
        self.touched: set[str] = set()
        self.typed: set[str] = set()
        self.shown: list[int] = []
        super().__init__(session, block)

    # -- declarations

    def _retain(self, s: Statement) -> None:
        """RETAIN a b 0 c 'x': each value is the start of the names before it."""
        names, items, sign = [], list(s.tokens[1:]), 1
        for t in items:
            if t.kind == "name":
                names.append(t.low)
                self.retained[t.low] = None
                continue
            if t.text == "-":
                sign = -1
                continue
            if t.kind == "num":
                value = sign * (float(t.text) if "." in t.text else int(t.text))
            elif t.kind == "str":
                value = t.value
            elif t.text == ".":
                value = None
            else:
                raise Unsupported("RETAIN of another form", s.text)
            self.retained |= {n: value for n in names}
            names, sign = [], 1

    def _array(self, s: Statement) -> None:
        """ARRAY a[3] x y z; a[*] x y z; a[3]: then its columns are a1 to a3."""
        words = [t.low for t in s.tokens]
        if len(words) < 5 or words[2] not in ("[", "{", "(") or words[4] not in ("]", "}", ")") or "$" in words or "_temporary_" in words:
            raise Unsupported("ARRAY of another form", s.text)
        names = words[5:]
        if words[3] != "*":
            n = int(words[3]) if words[3].isdigit() else -1
            names = names or [f"{words[1]}{i + 1}" for i in range(n)]
            if len(names) != n:
                raise Unsupported("ARRAY of another size", s.text)
        if not names or any(not re.fullmatch(r"[a-z_]\w*", x) for x in names):
            raise Unsupported("ARRAY of another form", s.text)
        self.arrays[words[1]] = names

    # -- names

    def place(self, name: str, kind: str | None = None) -> int:
        """Where the record has a name; a name seen for the first time is a column of this step."""
        self.touched.add(name)
        if name not in self.places:
            self.places[name] = len(self.places)
            self.kinds[name] = kind or "number"
        return self.places[name]

    def cell(self, parts: list[str]) -> Cell:
        if len(parts) == 2 and parts[0] in ("first", "last"):
            parts = [f"_{parts[0]}_{parts[1]}"]
            if parts[0] not in self.places:
                raise Unsupported("FIRST. or LAST. without BY", parts[0])
        if len(parts) > 1:
            raise Unsupported("name", ".".join(parts))
        i = self.place(parts[0])
        return Cell(lambda r: r[i], self.kinds[parts[0]], frozenset([parts[0]]), lambda s: f"r[{i}]")

    def element(self, name: str, index: Cell) -> Cell:
        own = [self.place(c) for c in self.arrays[name]]

        def get(r):
            k = index.get(r)
            if k is None or not 1 <= k <= len(own):
                raise IndexError(f"{name}[{k}]")
            return r[own[int(k) - 1]]

        def bad(k):
            raise IndexError(f"{name}[{k}]")

        def text(s):
            k = s.name()
            return f"(r[{s.of(tuple(own))}[int({k}) - 1]] if ({k} := {index.code(s)}) is not None and 1 <= {k} <= {len(own)} else {s.of(bad)}({k}))"

        return Cell(get, self.kinds[self.arrays[name][0]], index.reads | frozenset(self.arrays[name]), text)

    def lag(self, inside: Cell, difference: bool) -> Cell:
        """The value of the row before; it belongs to the group before in a group's first row, so nothing may read it there."""
        self.lags += 1
        name = f"_lag_{self.lags}"
        i = self.place(name, inside.kind)
        self.hidden.append(name)
        self.retained[name] = None

        def get(r):
            before, r[i] = r[i], inside.get(r)
            return before if not difference else None if before is None or r[i] is None else _minus(r[i], before)

        def of(before, now):
            return None if before is None or now is None else _minus(now, before)

        def text(s):
            # The value of the row before is read, then the record takes this row's.
            before, keep = s.name(), s.of(lambda r, x: r.__setitem__(i, x))
            put = f"({before} := r[{i}], {keep}(r, {inside.code(s)}))"
            return f"({s.of(of)}({put}[0], r[{i}]))" if difference else f"({put}[0])"

        return Cell(get, "number" if difference else inside.kind, inside.reads | {name}, text)

    def value(self, items) -> Cell:
        return RowExpression(items, self).value()

    # -- statements

    def go(self) -> None:
        for f in self.df.schema.fields:
            if f.name in self.order.values():
                continue
            kind = {"string": "text", "date": "date"}.get(f.dataType.simpleString(), "number")
            if kind == "number" and not isinstance(f.dataType, (T.NumericType, T.BooleanType)):
                kind = "other"
            self.place(f.name, kind)
        self.given = len(self.places)
        # From here on it holds the names that statements use.
        self.touched.clear()
        for name, start in self.retained.items():
            self.place(name, "text" if isinstance(start, str) else "number")
        for name in self.sums:
            self.retained.setdefault(name, 0)
            self.place(name)
        for names in self.arrays.values():
            for n in names:
                self.place(n)
        acts = self._acts(self.body)
        if not self.by:
            if held := self._carried(acts, []):
                raise Unsupported("value carried over rows without BY", ", ".join(sorted(held)))
            return self._run(acts, [])
        level = next((n for n in range(len(self.by), 0, -1) if not self._carried(acts, self.by[n - 1 :])), 0)
        if not level:
            raise Unsupported("value carried over BY groups", ", ".join(sorted(self._carried(acts, self.by))))
        return self._run(acts, self.by[:level])

    def _carried(self, acts: list[_Act], sure: list[str]) -> set[str]:
        """Names of which a group's first row (where FIRST. of all in ``sure`` holds) may read or leave what the group before had."""
        state = _Carry(set(self.retained) & self.set_names, set(), set(), set(), {f"_first_{k}" for k in sure})
        for a in acts:
            a.carry(state)
        return state.read | state.held | state.stale

    def _acts(self, body: list[Statement]) -> list[_Act]:
        out, i = [], 0
        while i < len(body):
            s = body[i]
            words = [t.low for t in s.tokens]
            if s.head == "if" and any(t.low == "then" and t.kind == "name" for t in s.tokens):
                act, i = self._branches(body, i)
                out.append(act)
            elif s.head == "do":
                inner, i = self._group(body, i)
                out.append(self._sequence(self._acts(inner)) if len(words) == 1 else self._loop(s.tokens, inner))
            else:
                out.append(self._simple(s, s.tokens))
                i += 1
        return out

    @staticmethod
    def _sequence(acts: list[_Act]) -> _Act:
        runs = [a.run for a in acts]

        def run(r):
            for f in runs:
                if not f(r):
                    return False
            return True

        def carry(state):
            for a in acts:
                a.carry(state)

        return _Act(run, carry, lambda s: [x for a in acts for x in a.lines(s)])

    def _branches(self, body, i: int) -> tuple[_Act, int]:
        sides, otherwise = [], None
        while i < len(body):
            items = body[i].tokens
            if sides:
                if items[0].low != "else":
                    break
                items = items[1:]
            if items and items[0].low == "if" and any(t.low == "then" for t in items):
                then = next(k for k, t in enumerate(items) if t.low == "then" and t.kind == "name")
                test, items = RowExpression(items[1:then], self).condition(), items[then + 1 :]
                plain = [t.low for t in body[i].tokens if t.low != "else"][1:4]
                first = f"_first_{plain[2]}" if plain[:2] == ["first", "."] and then == 4 else None
            elif sides:
                test = first = None
            else:
                raise Unsupported("IF", body[i].text)
            if items and items[0].low == "do":
                inner, i = self._group(body, i)
                act = self._sequence(self._acts(inner)) if len(items) == 1 else self._loop(items, inner)
            else:
                act, i = self._simple(body[i], items), i + 1
            if test is None:
                otherwise = act
                break
            sides.append((test, act, first))

        tests, last = [(test.get, act.run) for test, act, _ in sides], otherwise.run if otherwise else None

        def run(r):
            for test, act in tests:
                if test(r):
                    return act(r)
            return last(r) if last else True

        def carry(state):
            ends, sure = [], False
            for test, act, first in sides:
                state.reads(test.reads)
                ends.append(state.side())
                act.carry(ends[-1])
                if first in state.first:
                    sure = True
                    break
            if not sure:
                ends.append(state.side())
                if otherwise:
                    otherwise.carry(ends[-1])
            # A name is free of the group before if every side that may run sets it.
            state.held = set().union(*[e.held for e in ends])
            state.stale = set().union(*[e.stale for e in ends])
            state.elements = set.intersection(*[e.elements for e in ends])

        def code(s):
            out = []
            for k, (test, act, _) in enumerate(sides):
                out += [f"{'elif' if k else 'if'} {test.code(s)}:", *_inside(act.lines(s))]
            return out + (["else:", *_inside(otherwise.lines(s))] if otherwise else [])

        return _Act(run, carry, code), i

    def _loop(self, items, inner: list[Statement]) -> _Act:
        """DO i = a TO b (BY c): counted, from a by c while it hasn't passed b; both are read once."""
        words = [t.low for t in items]
        if len(words) < 6 or words[2] != "=" or "to" not in words or {"while", "until"} & set(words) or items[1].kind != "name":
            raise Unsupported("DO of another form", " ".join(words))
        to = words.index("to")
        by = words.index("by") if "by" in words[to:] else len(words)
        low, high = self.value(items[3:to]), self.value(items[to + 1 : by])
        step = self.value(items[by + 1 :]) if by < len(words) else Cells.lit(1)
        i = self.place(words[1])
        self.set_names.add(words[1])
        inside = self._sequence(self._acts(inner))
        body, first, last, by_one = inside.run, low.get, high.get, by == len(words)

        def run(r):
            k, end, n = first(r), last(r), step.get(r)
            if not n or k is None or end is None:
                raise ValueError(f"bounds of DO: {k} {end} {n}")
            while k <= end if n > 0 else k >= end:
                r[i] = k
                if not body(r):
                    return False
                k = r[i] + n
            r[i] = k
            return True

        def carry(state):
            state.reads(low.reads | high.reads | step.reads)
            state.held.discard(words[1])
            mine = state.side()
            inside.carry(mine)
            # The body may not run at all, so what it sets isn't sure to be set; but all elements are, where it sets the one of its own number from 1 to the size.
            state.stale |= mine.stale
            if by_one and not low.reads | high.reads:
                for name, names in self.arrays.items():
                    if (name, words[1]) in mine.elements and low.get([]) == 1 and high.get([]) == len(names):
                        state.held -= set(names)

        def bad(*bounds):
            raise ValueError(f"bounds of DO: {' '.join(map(str, bounds))}")

        def code(s):
            k, end, n = s.name(), s.name(), s.name()
            out = [f"{k}, {end}, {n} = {low.code(s)}, {high.code(s)}, {step.code(s)}", f"if not {n} or {k} is None or {end} is None:", f"    {s.of(bad)}({k}, {end}, {n})"]
            return [*out, f"while {k} <= {end} if {n} > 0 else {k} >= {end}:", *_inside([f"r[{i}] = {k}", *inside.lines(s), f"{k} = r[{i}] + {n}"]), f"r[{i}] = {k}"]

        return _Act(run, carry, code)

    def _assigned(self, name: str, value: Cell) -> _Act:
        self.set_names.add(name)
        i = self.place(name)
        if i >= self.given and name not in self.typed:
            self.typed.add(name)
            self.kinds[name] = value.kind if value.kind in ("text", "date") else "number"
        width, get = self.widths.get(name) if self.kinds[name] == "text" else None, value.get

        def run(r):
            x = get(r)
            r[i] = x if width is None or x is None else x.encode()[:width].decode("utf-8", "replace")
            return True

        def carry(state):
            state.reads(value.reads)
            state.held.discard(name)
            state.stale.discard(name)
            if any(n.startswith("_lag_") for n in value.reads):
                state.stale.add(name)

        return _Act(run, carry, None if width is not None else lambda s: [f"r[{i}] = {value.code(s)}"])

    def _simple(self, s: Statement, items) -> _Act:
        words = [t.low for t in items]

        def leaves(state):
            # A group's first row may end here, and leave what it hasn't set yet as the group before had it.
            state.read |= state.held

        if words[:1] == ["output"]:
            names = [t.name for t in _tables(items, 1)] if len(words) > 1 else [t.name for t in self.targets]
            known, shown = [t.name for t in self.targets], self.shown
            if bad := [n for n in names if n not in known]:
                raise Unsupported("OUTPUT to another table", bad[0])
            to = [known.index(n) for n in names]

            def output(r):
                r[-1] += [(t, [r[i] for i in shown]) for t in to]
                return True

            return _Act(output, lambda state: state.reads(self.retained.keys() | state.stale))
        if words == ["delete"]:
            return _Act(lambda r: False, leaves, lambda s: ["return False"])
        if words[:1] == ["if"]:
            test = RowExpression(items[1:], self).condition()
            return _Act(test.get, lambda state: (state.reads(test.reads), leaves(state)), lambda s: [f"if not {test.code(s)}:", "    return False"])
        if len(words) > 2 and words[1] == "+" and items[0].kind == "name":
            value, i = self.value(items[2:]), self.place(words[0])
            self.set_names.add(words[0])

            def add(r):
                r[i] = (r[i] or 0) + (value.get(r) or 0)
                return True

            return _Act(add, lambda state: state.reads(value.reads | {words[0]}), lambda s: [f"r[{i}] = (r[{i}] or 0) + ({value.code(s)} or 0)"])
        if len(words) > 2 and words[1] == "=" and items[0].kind == "name":
            return self._assigned(words[0], self.value(items[2:]))
        if len(words) > 5 and words[0] in self.arrays and words[1] in ("[", "{", "("):
            equal = next((k for k, t in enumerate(items) if t.text == "=" and items[k - 1].text in ("]", "}", ")")), None)
            if equal is not None:
                return self._assigned_element(words[0], items[2 : equal - 1], self.value(items[equal + 1 :]))
        raise Unsupported(words[0].upper() if words and words[0] in ("do", "end", "else", "return", "stop", "abort") else "statement", s.text)

    def _assigned_element(self, name: str, place, value: Cell) -> _Act:
        names = self.arrays[name]
        index, get = self.value(place), value.get
        at, own = index.get, [self.place(c) for c in names]
        self.set_names |= set(names)

        def run(r):
            k = at(r)
            if k is None or not 1 <= k <= len(own):
                raise IndexError(f"{name}[{k}]")
            r[own[int(k) - 1]] = get(r)
            return True

        def carry(state):
            state.reads(value.reads | index.reads)
            if not index.reads and 1 <= (k := index.get([])) <= len(own):
                state.held.discard(names[int(k) - 1])
            elif len(place) == 1:
                state.elements.add((name, place[0].low))
            if any(n.startswith("_lag_") for n in value.reads):
                state.stale |= set(names)

        def bad(k):
            raise IndexError(f"{name}[{k}]")

        def code(s):
            k = s.name()
            return [f"{k} = {index.code(s)}", f"if {k} is None or not 1 <= {k} <= {len(own)}:", f"    {s.of(bad)}({k})", f"r[{s.of(tuple(own))}[int({k}) - 1]] = {value.code(s)}"]

        return _Act(run, carry, code)

    # -- rows

    def _mark_groups(self) -> None:
        """FIRST. and LAST. of the first key need its rows in one task, which then goes through them: they are dealt out once."""
        self.df = self.df.repartition(self.by[0])
        super()._mark_groups()

    def _wanted(self) -> list[str]:
        """Columns that a target keeps."""
        own = {c: c for c in self.places if c not in self.hidden}
        own = {c: self.rename.get(c.lower(), c) for c in own if (c.lower() in self.keep if self.keep else c.lower() not in self.drop)}
        return [c for c, n in own.items() if any((not t.keep or n.lower() in t.keep) and n.lower() not in t.drop for t in self.targets)]

    def _run(self, acts: list[_Act], group: list[str]) -> None:
        whole = self._sequence(acts)
        plain, refers = whole.run, Source()
        source: str | None = None
        try:
            source = "\n".join(["def run(r):", *_inside(whole.lines(refers)), "    return True"])
            compile(source, "step", "exec")
        except (SyntaxError, RecursionError, MemoryError):
            # Nested too deeply for the language.
            source = None
        objects = refers.objects
        columns = self._wanted()
        given = self.df.drop(*self.order.values()).schema
        changed = self.set_names
        # What the table has and no statement sets stays in Arrow; only the rest of a written row comes from the record.
        same = {c for c in columns if c in given.names and c not in changed}
        self.shown += [self.places[c] for c in columns if c not in same]

        def kind(c: str):
            if c in given.names and c not in changed:
                return given[c].dataType
            return {"text": T.StringType(), "date": T.DateType()}.get(self.kinds[c], T.DoubleType())

        schema = T.StructType([T.StructField("_to", T.IntegerType()), *[T.StructField(c, kind(c)) for c in columns]])
        arrow = pa.schema([("_to", pa.int32()), *[(c, _arrow(kind(c))) for c in columns]])
        floats = [k for k, c in enumerate(c for c in columns if c not in same) if isinstance(kind(c), T.DoubleType)]
        # A retained name that the table has too is read anew in each row.
        starts = [(self.places[n], v) for n, v in self.retained.items() if self.places[n] >= self.given]
        marks = [f"_first_{group[-1]}"] if group else []
        used = self.touched | set(marks)
        size, names, always, everywhere = len(self.places), given.names, self.always, list(range(len(self.targets)))
        numbers = [n for n in names if isinstance(given[n].dataType, T.DecimalType)]
        first = self.places[marks[0]] if group else None
        kept = [i for i, _ in starts]
        shown = self.shown

        def emit(r, to):
            for t in to:
                r[-1].append((t, [r[i] for i in shown]))

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            run = _compiled(source, objects) if source else plain
            record, rest = [None] * size + [[]], [None] * (size - len(names))
            for batch in batches:
                cells = [batch.column(n).to_pylist() if n in used else repeat(None, len(batch)) for n in names]
                cells = [[None if x is None else float(x) for x in c] if n in numbers and n in used else c for n, c in zip(names, cells)]
                out, to_, at = [], [], []
                for k, row in enumerate(zip(*cells)):
                    held = [record[i] for i in kept]
                    record = [*row, *rest, []]
                    for i, v in starts if first is None or row[first] == 1 else zip(kept, held):
                        record[i] = v
                    if run(record) and not always:
                        emit(record, everywhere)
                    for to, values in record[-1]:
                        to_.append(to)
                        at.append(k)
                        out.append(values)
                made = [list(c) for c in zip(*out)] if out else [[] for _ in shown]
                for k in floats:
                    made[k] = [None if v is None else float(v) for v in made[k]]
                own, at = iter(made), pa.array(at, pa.int64())
                out = [batch.column(c).take(at).cast(t) if c in same else pa.array(next(own), t) for c, t in zip(columns, arrow.types[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(to_, pa.int32()), *out], schema=arrow)

        rows = self.df
        if group:
            # Rows of equal first keys are in one partition since their groups were marked.
            rows = rows.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in [*self.by, *self.order.values()]])
        read = [n for n in names if n in used or n in same]
        made = rows.select(*(read or names[:1])).mapInArrow(go, schema)
        if len(self.targets) > 1:
            # Several tables from one pass over the rows.
            path = new_folder(self.session.libraries.spark, "step")
            made.write.parquet(path)
            made = self.session.libraries.spark.read.schema(schema).parquet(path)
        for k, t in enumerate(self.targets):
            out = self._row(made.where(F.col("_to") == k).drop("_to"))
            self.session.write(t.name, t.shape(out, self.session), self.session.sorted_by.get(self.name))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
