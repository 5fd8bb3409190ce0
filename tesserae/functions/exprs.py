"""Scalar expressions, as SQL text that Spark and other engines read alike.

Each function takes and returns SQL text; `F.expr` makes a column of it. Nothing here needs a Python UDF.
"""

from __future__ import annotations

#: Characters of a geohash by their values. A fixed value.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
HOUR = 3_600_000


def lit(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value!r} AS DOUBLE)" if isinstance(value, float) else repr(value)


def _cell(value: str, low: int, span: int, bits: int) -> str:
    """Index of the cell a coordinate lies in. A value on a cell's upper edge belongs to that cell; the lowest edge of
    all belongs to the first."""
    return f"greatest(CAST(0 AS BIGINT), least(CAST({2**bits - 1} AS BIGINT), CAST(ceil((CAST({value} AS DOUBLE) - {low}) * {2**bits} / {span}) AS BIGINT) - 1))"


def _char(bits: list[str]) -> str:
    return f"substr('{ALPHABET}', CAST(1 + " + " + ".join(f"{2 ** (4 - k)} * {b}" for k, b in enumerate(bits)) + " AS INT), 1)"


def _absent(*values: str) -> str:
    return " OR ".join(f"{v} IS NULL OR isnan(CAST({v} AS DOUBLE))" for v in values)


def geohash(lat: str, lon: str, precision: int = 5) -> str:
    """Geohash; longitude takes the first bit, and a coordinate on a middle line falls into the lower half. Null if a
    coordinate is null or NaN; one outside the globe counts as the nearest on its edge."""
    n = 5 * precision
    of = [(_cell(lon, -180, 360, (n + 1) // 2), (n + 1) // 2), (_cell(lat, -90, 180, n // 2), n // 2)]
    bits = [f"(({of[k % 2][0]}) >> {of[k % 2][1] - 1 - k // 2} & 1)" for k in range(n)]
    code = " || ".join(_char(bits[5 * c : 5 * c + 5]) for c in range(precision))
    # a null suffix, and not a condition around it all, in whose branches cells would be computed once for each bit
    return f"({code} || (CASE WHEN {_absent(lat, lon)} THEN NULL ELSE '' END))"


def geohash_of_box(lat_lo: str, lat_hi: str, lon_lo: str, lon_hi: str, precision: int = 5) -> str:
    return geohash(f"(({lat_lo} + {lat_hi}) / 2)", f"(({lon_lo} + {lon_hi}) / 2)", precision)


def geohash_digit(h: str, place: int) -> str:
    """The value of a character, from place 1."""
    return f"(CAST(instr('{ALPHABET}', substr(lower({h}), {place}, 1)) AS BIGINT) - 1)"


def geohash_to_long(h: str, length: int) -> str:
    """Five bits a character, the first one the most significant; up to 12 characters."""
    return "(" + " + ".join(f"{geohash_digit(h, i)} * CAST({32 ** (length - i)} AS BIGINT)" for i in range(1, length + 1)) + ")"


def geohash_to_long_rev(h: str, length: int) -> str:
    """Five bits a character, the last one the most significant."""
    return "(" + " + ".join(f"{geohash_digit(h, i)} * CAST({32 ** (i - 1)} AS BIGINT)" for i in range(1, length + 1)) + ")"


def geohash_bits(h: str, length: int) -> list[str]:
    """The bits, most significant first, as integers."""
    return [f"({geohash_digit(h, c)} >> {4 - k} & 1)" for c in range(1, length + 1) for k in range(5)]


def geohash_box(h: str, length: int) -> dict[str, str]:
    """Lower and upper bounds of latitude and longitude."""
    bits, out = geohash_bits(h, length), {}
    for name, first, low, span in (("lon", 0, -180, 360), ("lat", 1, -90, 180)):
        own = bits[first::2]
        index = "(" + " + ".join(f"{b} * CAST({2 ** (len(own) - 1 - k)} AS BIGINT)" for k, b in enumerate(own)) + ")"
        out[f"{name}_lo"] = f"({low} + {index} * CAST({span / 2 ** len(own)!r} AS DOUBLE))"
        out[f"{name}_hi"] = f"({low} + ({index} + 1) * CAST({span / 2 ** len(own)!r} AS DOUBLE))"
    return out


def prefix(h: str, n: int) -> str:
    return f"substr({h}, 1, {n})"


def quantize(value: str, ticks: list[float]) -> str:
    """The greatest tick at or below a value; below the first tick, the first; null for null."""
    arms = " ".join(f"WHEN {value} >= {lit(float(t))} THEN {lit(float(t))}" for t in reversed(ticks[1:]))
    return f"(CASE WHEN {value} IS NULL THEN NULL {arms} ELSE {lit(float(ticks[0]))} END)"


def next_tick(value: str, ticks: list[float]) -> str:
    """The least tick above a value, or null."""
    return "(CASE WHEN " + f"{value} IS NULL THEN NULL " + " ".join(f"WHEN {value} < {lit(float(t))} THEN {lit(float(t))}" for t in ticks) + " ELSE NULL END)"


def prev_tick(value: str, ticks: list[float]) -> str:
    """The greatest tick below a value, or null."""
    return "(CASE WHEN " + f"{value} IS NULL THEN NULL " + " ".join(f"WHEN {value} > {lit(float(t))} THEN {lit(float(t))}" for t in reversed(ticks)) + " ELSE NULL END)"


def first_tick(ticks: list[float]) -> str:
    return lit(float(ticks[0]))


def last_tick(ticks: list[float]) -> str:
    return lit(float(ticks[-1]))


def num_ticks(ticks: list[float]) -> str:
    return f"CAST({len(ticks)} AS BIGINT)"


class Quantizer:
    """A set of ticks and the expressions over them; add and remove build it up."""

    def __init__(self, ticks: list[float] = ()):
        self.ticks = sorted({float(t) for t in ticks})

    @classmethod
    def linear(cls, start: float, end: float, step: float) -> Quantizer:
        return cls(linear_ticks(start, end, step))

    def add(self, *ticks: float) -> Quantizer:
        return Quantizer([*self.ticks, *ticks])

    def remove(self, *ticks: float) -> Quantizer:
        return Quantizer([t for t in self.ticks if t not in ticks])

    def _own(self) -> list[float]:
        if not self.ticks:
            raise ValueError("a quantizer needs a tick")
        return self.ticks

    def quantize(self, value: str) -> str:
        return quantize(value, self._own())

    def next(self, value: str) -> str:
        return next_tick(value, self._own())

    def prev(self, value: str) -> str:
        return prev_tick(value, self._own())

    def midpoint(self, value: str) -> str:
        return bin_midpoint(value, self._own())


def bin_midpoint(value: str, ticks: list[float]) -> str:
    """The middle of a value's bin; of the open last bin, its tick."""
    q = quantize(value, ticks)
    return f"({q} + coalesce(({next_tick(q, ticks)} - {q}) / 2, 0))"


def linear_ticks(start: float, end: float, step: float) -> list[float]:
    """start, start + step, ... while below end, by repeated addition."""
    if step <= 0:
        raise ValueError("the step must be positive")
    out, at = [], start
    while at < end:
        out.append(at)
        at += step
    return out


def time_bucket(ms: str, hours: int = 6) -> str:
    """End of the bucket (start, end] a time in epoch milliseconds lies in; a boundary closes its bucket."""
    return f"(CAST(ceil({ms} / {hours * HOUR}.0) AS BIGINT) * {hours * HOUR})"


#: Of the Rothfusz regression: coefficients of 1, t, r, tr, t2, r2, t2r, tr2, t2r2. Fixed values.
HEAT = (-42.379, 2.04901523, 10.14333127, -0.22475541, -0.00683783, -0.05481717, 0.00122874, 0.00085282, -0.00000199)


def heat_index(t: str, r: str) -> str:
    """Heat index in degrees Fahrenheit of a temperature in them and a relative humidity in per cent."""
    terms = ("1", t, r, f"{t} * {r}", f"{t} * {t}", f"{r} * {r}", f"{t} * {t} * {r}", f"{t} * {r} * {r}", f"{t} * {t} * {r} * {r}")
    return "(" + " + ".join(f"{lit(c)} * {x}" for c, x in zip(HEAT, terms, strict=True)) + ")"


def memory_bytes(vertices: str, leaves: str, planes: int) -> str:
    """Bytes a tree of so many vertices and leaves would take, with time and location among the planes."""
    leaf = 8 + 32 * planes + 8 * planes * (planes - 1) // 2
    return f"(16 * {vertices} + {leaf} * {leaves})"


def arithmetic(left: str, op: str, right: str, kind: str) -> str:
    """left op right in the left operand's type: `kind` is bigint, int, float or double. Division of integers cuts off
    towards zero and stays exact for any bigint."""
    cast = f"CAST({right} AS {kind})"
    if op == "/" and kind in ("bigint", "int"):
        return f"CAST((CAST({left} AS DECIMAL(38, 0)) - CAST({left} % {cast} AS DECIMAL(38, 0))) / CAST({cast} AS DECIMAL(38, 0)) AS {kind})"
    return f"CAST({left} {op} {cast} AS {kind})"


def convert(value: str, kind: str, of_number: bool = True) -> str:
    """A value in another type, or null where it has none there. Numbers lose their fraction on the way to integers."""
    if kind.lower() in ("bigint", "int") and of_number:
        value = f"(CASE WHEN {value} >= 0 THEN floor({value}) ELSE ceil({value}) END)"
    return f"TRY_CAST({value} AS {kind})"


def type_of(value: object) -> str:
    """The type a plain value is stored as; TypeError for bytes and anything else that has none."""
    if isinstance(value, bool) or not isinstance(value, int | float | str):
        raise TypeError(f"no feature type for {type(value).__name__}")
    if isinstance(value, int):
        return "int" if -(2**31) <= value < 2**31 else "bigint"
    return "double" if isinstance(value, float) else "string"


def compare(left: str, op: str, right: str) -> str:
    """Typed comparison in which null is below everything and equal to null."""
    both, lo, hi = f"{left} IS NULL AND {right} IS NULL", f"{left} IS NULL AND {right} IS NOT NULL", f"{left} IS NOT NULL AND {right} IS NULL"
    if op not in ("<", "<=", ">", ">=", "="):
        raise ValueError(f"unknown comparison {op}")
    return f"(CASE WHEN {both} THEN {'TRUE' if '=' in op else 'FALSE'} WHEN {lo} THEN {'TRUE' if '<' in op else 'FALSE'} WHEN {hi} THEN {'TRUE' if '>' in op else 'FALSE'} ELSE {left} {op} {right} END)"


def array_offset(index: list[int], dims: list[int]) -> int:
    """Place of an element in row-major order, from 1."""
    at = 0
    for i, d in zip(index, dims, strict=True):
        if not 0 <= i < d:
            raise IndexError(f"{i} is outside a dimension of {d}")
        at = at * d + i
    return at + 1


def array_place(index: list[str], dims: list[int]) -> str:
    """The same for indexes that are columns; null where one is out of bounds."""
    inside = " AND ".join(f"{i} >= 0 AND {i} < {d}" for i, d in zip(index, dims, strict=True))
    at = "0"
    for i, d in zip(index, dims, strict=True):
        at = f"({at} * {d} + {i})"
    return f"CAST(CASE WHEN {inside} THEN {at} + 1 END AS INT)"


def array_get(array: str, place: str) -> str:
    return f"(CASE WHEN {place} IS NOT NULL THEN {array}[{place} - 1] END)"


def array_set(array: str, place: str, value: str) -> str:
    """The array with one element replaced; unchanged where the place is null. An element erased is one set to NULL."""
    return f"transform({array}, (x, i) -> CASE WHEN i + 1 = {place} THEN {value} ELSE x END)"


def leading_planes(columns: list[str], planes: list[str]) -> list[str]:
    """The active planes among columns, in plane order; planes without a column become nulls, but for those at the end."""
    known = [k for k, p in enumerate(planes) if p in columns]
    return [p if p in columns else f"CAST(NULL AS DOUBLE) AS {p}" for p in planes[: known[-1] + 1 if known else 0]]


def check_types(types: dict[str, str], planes: dict[str, str]) -> None:
    """TypeError if a column has another type than its plane."""
    wrong = [f"{p}: {types[p]}, not {t}" for p, t in planes.items() if p in types and types[p] != t]
    if wrong:
        raise TypeError("; ".join(wrong))
