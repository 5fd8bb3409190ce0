"""Queries over a sketch: predicates on its planes.

Terms on one feature are alternatives (OR), different features are conditions (AND). A null label never satisfies a
condition.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.exprs import lit

#: Symbols of operators and what they mean. Fixed values.
SYMBOLS = {"==": "eq", "=": "eq", "!=": "ne", "/=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge", "[]": "closed", "()": "open", "[)": "from", "(]": "upto", "[=": "starts", "=]": "ends"}
RANGES = ("closed", "open", "from", "upto")
_TEXT = {"eq": "{c} = {a}", "ne": "{c} <> {a}", "lt": "{c} < {a}", "le": "{c} <= {a}", "gt": "{c} > {a}", "ge": "{c} >= {a}", "closed": "({c} >= {a} AND {c} <= {b})", "open": "({c} > {a} AND {c} < {b})", "from": "({c} >= {a} AND {c} < {b})", "upto": "({c} > {a} AND {c} <= {b})", "starts": "{c} LIKE {a}", "ends": "{c} LIKE {a}"}


@dataclass(frozen=True)
class Expr:
    """feature op value, or feature op (value, value2) for a range."""

    feature: str
    op: str
    value: object
    value2: object = None

    def __post_init__(self):
        if self.op not in SYMBOLS:
            raise ValueError(f"unknown operator {self.op!r}")
        if (self.kind in RANGES) != (self.value2 is not None):
            raise ValueError("a range takes two operands, any other operator one")
        if self.kind in RANGES and self.value > self.value2:
            raise ValueError("a range must not start above its end")

    @property
    def kind(self) -> str:
        return SYMBOLS[self.op]

    def to_sql(self) -> str:
        a = self.value
        if self.kind in ("starts", "ends"):
            if any(c in str(a) for c in "%_\\"):
                raise ValueError("a prefix or suffix must not have %, _ or a backslash")
            a = f"{a}%" if self.kind == "starts" else f"%{a}"
        return _TEXT[self.kind].format(c=self.feature, a=lit(a), b=lit(self.value2))

    def to_dict(self) -> dict:
        return {"feature": self.feature, "op": self.op, "value": self.value} | ({"value2": self.value2} if self.value2 is not None else {})


@dataclass
class Query:
    """A set of terms. partitioned: the table has a partition column of so many first characters of the location, p1, p2
    and so on; check() finds it."""

    terms: list[Expr] = field(default_factory=list)
    partitioned: int = 0

    def add(self, *terms: Expr) -> Query:
        self.terms += terms
        return self

    @classmethod
    def from_dict(cls, d: dict) -> Query:
        return cls([Expr(**t) for t in d["terms"]])

    def to_dict(self) -> dict:
        return {"terms": [t.to_dict() for t in self.terms]}

    def features(self) -> list[str]:
        return list(dict.fromkeys(t.feature for t in self.terms))

    def check(self, columns: list[str], unknown: str = "raise") -> Query:
        """The query without terms on features that columns lack (unknown="ignore"); "prune" makes it match nothing."""
        missing = [f for f in self.features() if f not in columns]
        if not missing or unknown == "ignore":
            return Query([t for t in self.terms if t.feature not in missing], next((k for k in range(1, 13) if f"p{k}" in columns), 0))
        if unknown == "prune":
            return Never()
        raise ValueError(f"no such plane: {', '.join(missing)}")

    def predicate(self) -> Column:
        by = [reduce(or_, [F.expr(t.to_sql()) for t in self.terms if t.feature == f]) for f in self.features()]
        return reduce(and_, by + self.implied(), F.lit(True))

    def implied(self) -> list[Column]:
        """Conditions on the partition column that follow from those on location; they let a scan skip folders."""
        own, k = [t for t in self.terms if t.feature == "location"], self.partitioned
        if not k or not own or any(t.kind not in ("eq", "starts") or not t.value for t in own):
            return []
        place = F.col(f"p{k}")
        return [reduce(or_, [place == t.value[:k] if len(t.value) >= k else place.startswith(t.value) for t in own])]

    def where(self) -> str:
        return " AND ".join("(" + " OR ".join(t.to_sql() for t in self.terms if t.feature == f) + ")" for f in self.features()) or "TRUE"

    def to_sql(self, table: str = "leaves", select: str = "*") -> str:
        return f"SELECT {select} FROM {table} WHERE {self.where()}"


class Never(Query):
    """Matches nothing."""

    def predicate(self) -> Column:
        return F.lit(False)

    def where(self) -> str:
        return "FALSE"
