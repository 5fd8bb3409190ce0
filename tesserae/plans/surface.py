"""A small SQL surface over leaves, in text or as a dict.

    SELECT MEAN(value), MAX(k) WHERE location LIKE 'd%' AND value > MEAN(value) + STD(value) AND CORRELATION(value, k) < 0.5
    GROUP BY time

Conditions on a plane compare its labels, and may refer to statistics of all leaves. Conditions on a statistic hold for
the groups that are selected. As a dict: {"select": ["MEAN(value)"], "where": {"value": {">": "MEAN(value) + STD(value)"},
"CORRELATION(value, k)": {"<": 0.5}}, "group": ["time"]}; a string that is a number, a statistic or arithmetic of them
counts as such, any other as text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import stats
from tesserae.operators import sketch
from tesserae.operators.sketch import CONFIG, SketchConfig

#: Statistics by name: of one feature, or of two.
ONE = {"MEAN": stats.mean, "STD": stats.std, "VAR": stats.variance, "MIN": lambda f: F.col(f"min_{f}"), "MAX": lambda f: F.col(f"max_{f}"), "SUM": lambda f: stats.mean(f) * F.col("n"), "ERROR": stats.standard_error}
TWO = {"CORRELATION": stats.correlation, "SLOPE": stats.slope, "INTERCEPT": stats.intercept}
COMPARE = {"=": "==", "==": "==", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
_TOKEN = re.compile(r"\s*(?:('(?:[^']|'')*')|(\d+(?:\.\d*)?(?:[eE][-+]?\d+)?)|([A-Za-z_]\w*)|(<=|>=|<>|!=|==|[-+*/(),<>=]))")


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip().rstrip(";")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at:]!r}")
        out.append(m[0].strip())
        at = m.end()
    return out


@dataclass
class Select:
    """select: (name, statistic) pairs; where: conditions on labels; having: conditions on statistics, as
    (left, operator, right) of expression trees; group: planes."""

    select: list[tuple[str, tuple]]
    where: list[tuple] = field(default_factory=list)
    having: list[tuple] = field(default_factory=list)
    group: list[str] = field(default_factory=list)


class _Parser:
    """Recursive descent. Trees: ("stat", name, features), ("plane", name), ("value", x), (operator, left, right)."""

    def __init__(self, words: list[str], config: SketchConfig):
        self.words, self.at, self.config = words, 0, config

    def peek(self) -> str:
        return self.words[self.at].upper() if self.at < len(self.words) else ""

    def next(self, *expected: str) -> str:
        if self.at >= len(self.words) or (expected and self.peek() not in expected):
            raise ValueError(f"expected {' or '.join(expected) or 'more'} at {' '.join(self.words[self.at :]) or 'the end'}")
        self.at += 1
        return self.words[self.at - 1]

    def term(self) -> tuple:
        word = self.next()
        if word == "(":
            out = self.sum()
            self.next(")")
            return out
        if word == "-":
            return "-", ("value", 0.0), self.term()
        if word[0] == "'":
            return "value", word[1:-1].replace("''", "'")
        if word[0].isdigit():
            return "value", float(word)
        if self.peek() != "(":
            if word not in self.config.planes:
                raise ValueError(f"no such plane: {word}")
            return "plane", word
        name, names = word.upper(), []
        self.next("(")
        while self.peek() != ")":
            names.append(self.next())
            if self.peek() == ",":
                self.next(",")
        self.next(")")
        wanted = 0 if name == "COUNT" else 1 if name in ONE else 2 if name in TWO else None
        if wanted is None or len(names) != wanted or any(f not in self.config.features for f in names):
            raise ValueError(f"no such statistic: {word}({', '.join(names)})")
        return "stat", name, tuple(names)

    def product(self) -> tuple:
        out = self.term()
        while self.peek() in ("*", "/"):
            out = (self.next(), out, self.term())
        return out

    def sum(self) -> tuple:
        out = self.product()
        while self.peek() in ("+", "-"):
            out = (self.next(), out, self.product())
        return out

    def condition(self) -> tuple:
        left = self.sum()
        if self.peek() == "LIKE":
            self.next()
            right = self.term()
            if left[0] != "plane" or right[0] != "value" or not isinstance(right[1], str):
                raise ValueError("LIKE compares a plane with a text")
            return left, "LIKE", right
        return left, COMPARE[self.next(*COMPARE)], self.sum()

    def end(self) -> None:
        if self.at < len(self.words):
            raise ValueError(f"cannot read {' '.join(self.words[self.at :])}")


def _planes(tree: tuple) -> bool:
    return tree[0] == "plane" or any(_planes(x) for x in tree[1:] if isinstance(x, tuple) and x and isinstance(x[0], str) and tree[0] != "stat")


def _name(tree: tuple) -> str:
    return "_".join([tree[1], *tree[2]]).lower()


def _sorted(out: Select, conditions: list[tuple]) -> Select:
    for left, op, right in conditions:
        on_labels = _planes(left) or _planes(right)
        if not on_labels and left[0] == "value":
            raise ValueError("a condition needs a plane or a statistic on its left")
        (out.where if on_labels else out.having).append((left, op, right))
    return out


def parse(text: str, config: SketchConfig = CONFIG) -> Select:
    """ValueError for what the surface does not know."""
    p = _Parser(tokens(text), config)
    p.next("SELECT")
    out, conditions = Select([]), []
    while True:
        tree = p.term()
        if tree[0] != "stat":
            raise ValueError("only statistics can be selected")
        out.select.append((_name(tree), tree))
        if p.peek() != ",":
            break
        p.next(",")
    if p.peek() == "WHERE":
        p.next()
        conditions.append(p.condition())
        while p.peek() == "AND":
            p.next()
            conditions.append(p.condition())
    if p.peek() == "GROUP":
        p.next()
        p.next("BY")
        out.group.append(p.term()[1])
        while p.peek() == ",":
            p.next()
            out.group.append(p.term()[1])
    p.end()
    return _sorted(out, conditions)


def from_dict(d: dict, config: SketchConfig = CONFIG) -> Select:
    """The key-value form."""

    def tree(x: object) -> tuple:
        if not isinstance(x, str):
            return "value", float(x)
        try:
            p = _Parser(tokens(x), config)
            out = p.sum()
            p.end()
            return out
        except ValueError:
            return "value", x

    out = Select([(_name(t), t) for t in map(tree, d["select"])], group=list(d.get("group", [])))
    if any(t[0] != "stat" for _, t in out.select):
        raise ValueError("only statistics can be selected")
    return _sorted(out, [(tree(left), op if op == "LIKE" else COMPARE[op], tree(right)) for left, terms in d.get("where", {}).items() for op, right in terms.items()])


def _column(tree: tuple, whole: dict[tuple, str] | None) -> Column:
    """whole: columns with the statistics of all leaves, for conditions on labels; else statistics are of the row."""
    kind = tree[0]
    if kind == "value":
        return F.lit(tree[1])
    if kind == "plane":
        return F.col(tree[1])
    if kind == "stat":
        if whole is not None:
            return F.col(whole[tree])
        return F.col("n") if tree[1] == "COUNT" else (ONE | TWO)[tree[1]](*tree[2])
    left, right = _column(tree[1], whole), _column(tree[2], whole)
    return {"+": left + right, "-": left - right, "*": left * right, "/": left / right}[kind]


def _holds(condition: tuple, whole: dict[tuple, str] | None) -> Column:
    (left, op, right) = condition
    a, b = _column(left, whole), _column(right, whole)
    return a.like(right[1]) if op == "LIKE" else {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def _stats_in(tree: tuple) -> set[tuple]:
    return {tree} if tree[0] == "stat" else {s for x in tree[1:] if isinstance(x, tuple) for s in _stats_in(x)}


def run(leaves: DataFrame, query: Select | str | dict, config: SketchConfig = CONFIG) -> DataFrame:
    """The groups (one, without GROUP BY) that hold the conditions, with the statistics selected. Statistics in
    conditions on labels take one more aggregate over all leaves, a single row."""
    q = parse(query, config) if isinstance(query, str) else from_dict(query, config) if isinstance(query, dict) else query
    needed = sorted({s for left, _, right in q.where for s in _stats_in(left) | _stats_in(right)})
    whole = {s: f"_whole{i}" for i, s in enumerate(needed)}
    own = leaves
    if needed:
        row = leaves.agg(*sketch.merged(config)).select(*[_column(s, None).alias(whole[s]) for s in needed])
        own = own.crossJoin(F.broadcast(row))
    for c in q.where:
        own = own.where(_holds(c, whole))
    out = own.groupBy(*q.group).agg(*sketch.merged(config))
    for c in q.having:
        out = out.where(_holds(c, None))
    return out.select(*q.group, *[_column(s, None).alias(name) for name, s in q.select])
