"""Conditions on one source line, as Spark columns and as SQL text for DuckDB.

The SQL side serves the queries' oracles; it covers what RE2 can express, so patterns avoid look-around.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A clause: literals of which every line that satisfies the predicate holds at least one; true: in its folded form.
Clause = frozenset[tuple[str, bool]]


class Predicate:
    def expr(self, line: str) -> str:
        """Spark SQL over a column's name; a whole registry is one text to parse, where columns would be thousands of calls."""
        raise NotImplementedError

    def column(self, line: Column) -> Column:
        raise NotImplementedError

    def clauses(self) -> list[Clause]:
        """What must hold for any line that satisfies the predicate: a cheap test of a whole text before its lines."""
        return []

    def __and__(self, other: Predicate) -> Predicate:
        return _Both(self, other, "AND")

    def __or__(self, other: Predicate) -> Predicate:
        return _Both(self, other, "OR")

    def __invert__(self) -> Predicate:
        return _Not(self)


def sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strongest(clauses):
    """The clause whose shortest literal is longest."""
    return max(clauses, key=lambda c: (min(len(t[0]) for t in c), -len(c)), default=None)


def _literals(items) -> set[tuple[str]] | None:
    """Literals of a parsed pattern of which every match holds at least one."""
    found, run = [], ""
    for kind, arg in [*items, (None, None)]:
        if kind is op.LITERAL:
            run += chr(arg)
            continue
        if kind is op.AT:
            continue  # takes no characters
        if run:
            found.append({(run,)})
            run = ""
        if kind is op.SUBPATTERN:
            found.append(_literals(arg[3]))
        elif kind is op.BRANCH:
            ways = [_literals(x) for x in arg[1]]
            found.append(None if None in ways else set().union(*ways))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0]:
            found.append(_literals(arg[2]))
    return _strongest([x for x in found if x])


def folded(text: Column) -> Column:
    """Text in which every letter that a pattern without case takes for an ASCII letter is that lower-case letter."""
    return F.lower(F.translate(text, "\u0131\u0130\u017f\u212a", "iisk"))


def spark_text(s: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def may_match(cases: list[Predicate], text: str, low: str) -> str | None:
    """Spark SQL for whether a text (and its folded form) can hold a line for any of the predicates; None where there is no such test."""
    ways = []
    for case in cases:
        every = ["(" + " OR ".join(f"contains({low if fold else text}, {spark_text(t)})" for t, fold in sorted(c)) + ")" for c in case.clauses()]
        if not every:
            return None
        ways.append(" AND ".join(every))
    return " OR ".join(ways)


@dataclass(frozen=True)
class Match(Predicate):
    """The pattern occurs in the stripped line; Unicode classes, as in Python."""

    pattern: str
    ignore_case: bool = False

    def column(self, line: Column) -> Column:
        return line.rlike(self._java())

    def _java(self) -> str:
        return ("(?iU)" if self.ignore_case else "(?U)") + self.pattern

    def expr(self, line: str) -> str:
        return f"{line} RLIKE {spark_text(self._java())}"

    def clauses(self) -> list[Clause]:
        found = _literals(_parser.parse(self.pattern))
        return [frozenset((t.lower() if self.ignore_case else t, self.ignore_case) for (t,) in found)] if found else []

    def sql(self, line: str) -> str:
        return f"regexp_matches({line}, {sql_text(self.pattern)}{", 'i'" if self.ignore_case else ''})"


@dataclass(frozen=True)
class Has(Predicate):
    """The text occurs in the stripped line, or in its lower-cased form."""

    text: str
    lower: bool = False

    def column(self, line: Column) -> Column:
        return (F.lower(line) if self.lower else line).contains(self.text)

    def expr(self, line: str) -> str:
        return f"contains({f'lower({line})' if self.lower else line}, {spark_text(self.text)})"

    def clauses(self) -> list[Clause]:
        return [frozenset([(self.text, self.lower)])]

    def sql(self, line: str) -> str:
        return f"contains({f'lower({line})' if self.lower else line}, {sql_text(self.text)})"


@dataclass(frozen=True)
class Starts(Predicate):
    text: str

    def column(self, line: Column) -> Column:
        return line.startswith(self.text)

    def expr(self, line: str) -> str:
        return f"startswith({line}, {spark_text(self.text)})"

    def clauses(self) -> list[Clause]:
        return [frozenset([(self.text, False)])]

    def sql(self, line: str) -> str:
        return f"starts_with({line}, {sql_text(self.text)})"


@dataclass(frozen=True)
class Fact(Predicate):
    """A boolean column that the scan attaches to each line, from the file's syntax tree. Has no SQL form."""

    name: str
    names: tuple[str, ...] = ()  # of which a file with this fact holds one, if it is in ASCII

    def column(self, line: Column) -> Column:
        return F.col(self.name)

    def expr(self, line: str) -> str:
        return self.name

    def clauses(self) -> list[Clause]:
        return [frozenset((n, False) for n in self.names)] if self.names else []

    def sql(self, line: str) -> str:
        raise NotImplementedError(f"{self.name} comes from a syntax tree")


@dataclass(frozen=True)
class _Both(Predicate):
    left: Predicate
    right: Predicate
    word: str

    def column(self, line: Column) -> Column:
        a, b = self.left.column(line), self.right.column(line)
        return a & b if self.word == "AND" else a | b

    def expr(self, line: str) -> str:
        return f"({self.left.expr(line)} {self.word} {self.right.expr(line)})"

    def clauses(self) -> list[Clause]:
        a, b = self.left.clauses(), self.right.clauses()
        if self.word == "AND":
            return a + b
        return [_strongest(a) | _strongest(b)] if a and b else []

    def sql(self, line: str) -> str:
        return f"({self.left.sql(line)} {self.word} {self.right.sql(line)})"


@dataclass(frozen=True)
class _Not(Predicate):
    of: Predicate

    def column(self, line: Column) -> Column:
        return ~self.of.column(line)

    def expr(self, line: str) -> str:
        return f"(NOT {self.of.expr(line)})"

    def sql(self, line: str) -> str:
        return f"(NOT {self.of.sql(line)})"


def any_of(*texts: str, lower: bool = False) -> Predicate:
    out: Predicate = Has(texts[0], lower)
    for t in texts[1:]:
        out = out | Has(t, lower)
    return out
