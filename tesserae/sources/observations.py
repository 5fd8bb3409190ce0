"""Observations: what the engine reads, and the readers."""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.functions import exprs

#: The observations view of the events table: (name, SQL in Spark, SQL elsewhere).
VIEW = (
    ("obs_id", "event_id", "event_id"),
    ("ms", "unix_millis(CAST(ts AS TIMESTAMP))", "(epoch_us(ts) // 1000)"),
    ("user_id", "user_id", "user_id"),
    ("event_type", "event_type", "event_type"),
    ("lat", "CAST((user_id * 37 + event_id % 11) % 180 - 90 + CAST(0.3 AS DOUBLE) AS FLOAT)", "CAST((user_id * 37 + event_id % 11) % 180 - 90 + CAST(0.3 AS DOUBLE) AS FLOAT)"),
    ("lon", "CAST((user_id * 53 + event_id % 17) % 360 - 180 + CAST(0.3 AS DOUBLE) AS FLOAT)", "CAST((user_id * 53 + event_id % 17) % 360 - 180 + CAST(0.3 AS DOUBLE) AS FLOAT)"),
    ("value", "value", "value"),
    ("k", "CAST(get_json_object(props, '$.k') AS DOUBLE)", "CAST(json_extract_string(props, '$.k') AS DOUBLE)"),
    ("err", "CAST(CAST(event_type = 'error' AS INT) AS DOUBLE)", "CAST(CAST(event_type = 'error' AS INT) AS DOUBLE)"),
)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(*[F.expr(sql).alias(name) for name, sql, _ in VIEW])


def observations_sql() -> str:
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, _, sql in VIEW) + " FROM events"


def read_points(spark: SparkSession, path: str, precision: int | None = None, prefix_only: int | None = None) -> DataFrame:
    """(lat, lon) from lines of two numbers with three blanks between; other lines are left out. precision adds their
    geohash as location; prefix_only leaves nothing but its first so many characters, as prefix."""
    parts = F.split("value", "   ")
    lines = spark.read.text(path).where(F.size(parts) == 2)
    out = lines.select(parts[0].try_cast("float").alias("lat"), parts[1].try_cast("float").alias("lon")).where("lat is not null and lon is not null")
    if prefix_only is not None:
        return out.select(F.expr(exprs.geohash("lat", "lon", max(prefix_only, 1))).alias("prefix"))
    return out if precision is None else out.withColumn("location", F.expr(exprs.geohash("lat", "lon", precision)))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; broken lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def ingest_filter(df: DataFrame, keep: Column | None = None) -> DataFrame:
    """The hook before a sketch: rows that are kept, all by default."""
    return df if keep is None else df.where(keep)


def from_values(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A table of plain values, with the widest type among each column's; TypeError where a value has none."""
    order = ["int", "bigint", "double", "string"]
    types = [max((exprs.type_of(r[k]) for r in rows if r[k] is not None), key=order.index, default="string") for k in range(len(names))]
    fit = {"int": int, "bigint": int, "double": float, "string": str}
    plain = [tuple(None if v is None else fit[t](v) for v, t in zip(r, types, strict=True)) for r in rows]
    return spark.createDataFrame(plain, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def sine_delay(elapsed_ms: str, slice_ms: int) -> str:
    """Milliseconds to wait between records under a sine-wave load, of the time since the start: between 3 and 12."""
    return f"CAST(round(3 + 4.5 * (1 - sin(radians(({elapsed_ms} % {slice_ms}) * 360.0 / {slice_ms})))) AS BIGINT)"


BLOB = "lat float, lon float, name string, time_start long, time_end long, features map<string,double>, texts map<string,string>, arrays map<string,struct<dims:array<int>,data:array<double>>>"
#: Number of a feature's type in a file and how struct reads it. Fixed values.
_KINDS = {0: None, 1: ">i", 2: ">q", 3: ">f", 4: ">d", 5: "text", 6: "bytes"}
#: Records are handed on by so many.
SLICE = 2_000


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        out = struct.unpack_from(form, self.data, self.at)[0]
        self.at += struct.calcsize(form)
        return out

    def raw(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the file is cut short")
        self.at += n
        return self.data[self.at - n : self.at]

    def text(self) -> str:
        """Two bytes of length, then UTF-8 in which zero takes two bytes and astral characters are surrogate pairs."""
        own = self.raw(self.take(">H")).replace(b"\xc0\x80", b"\0").decode("utf-8", "surrogatepass")
        return own.encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def feature(self):
        """(name, value) of a scalar feature."""
        name, kind = self.text(), _KINDS[self.take(">i")]
        return name, None if kind is None else self.text() if kind == "text" else self.raw(self.take(">i")) if kind == "bytes" else self.take(kind)

    def array(self) -> tuple:
        """(name, (dims, data)) of an array of features, in row-major order."""
        name = self.text() if self.take("?") else ""
        if self.take("?"):
            self.take(">i")  # the elements name their types as well
        dims = [self.take(">i") for _ in range(self.take(">i"))]
        data = [self.feature()[1] for _ in range(self.take(">i"))]
        return name, (dims, [float(x) if isinstance(x, int | float) else None for x in data])


def _blob_row(lat: float, lon: float, payload: bytes) -> tuple:
    """One observation: place, name, times, scalar features by name, strings by name, arrays by name."""
    b = _Bytes(payload)
    name, times = b.text(), (None, None)
    if b.take("?"):
        times = (b.take(">q"), b.take(">q"))
    if b.take("?"):
        has_range, has_point = b.take("?"), b.take("?")
        if has_range:
            b.raw(16)
            b.raw(8 if b.take("?") else 0)
        b.raw(8 if has_point else 0)
    own = dict(b.feature() for _ in range(b.take(">i")))
    arrays = dict(b.array() for _ in range(b.take(">i")))
    features = {k: None if v is None else float(v) for k, v in own.items() if not isinstance(v, str | bytes)}
    return lat, lon, name, *times, features, {k: v for k, v in own.items() if isinstance(v, str)}, arrays


def read_blobs(spark: SparkSession, path: str, precision: int = 5, as_long: bool = False) -> DataFrame:
    """Observation files: a count, then per record latitude, longitude, length and the observation, big-endian. A task
    reads a file at a time and hands its records on in slices. Files must end in .mblob; others below the path are an
    error. Folders named year=<year> give the column year, on which a filter skips them. as_long packs the geohash into
    an integer, location_code."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path)
    other = every.select("path").where(~F.col("path").endswith(".mblob")).limit(1).collect()
    if other:
        raise ValueError(f"not an observation file: {other[0]['path']}")
    partitions = [c for c in every.columns if c not in ("path", "modificationTime", "length", "content")]
    columns = [c.split()[0] for c in re.split(", (?=[a-z_]+ )", BLOB)]

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for _, file in pdf.iterrows():
                b, out = _Bytes(bytes(file["content"])), []
                fixed = {c: file[c] for c in partitions}
                for k in range(n := b.take(">i")):
                    lat, lon = b.take(">f"), b.take(">f")
                    out.append(_blob_row(lat, lon, b.raw(b.take(">i"))))
                    if len(out) == SLICE or k == n - 1:
                        yield pd.DataFrame(out, columns=columns).astype({"time_start": "Int64", "time_end": "Int64"}).assign(**fixed)
                        out = []

    schema = ", ".join([BLOB, *[f"{c} {dict(every.dtypes)[c]}" for c in partitions]])
    out = every.select("content", *partitions).mapInPandas(rows, schema).withColumn("location", F.expr(exprs.geohash("lat", "lon", precision)))
    return out.withColumn("location_code", F.expr(exprs.geohash_to_long("location", precision))) if as_long else out


def _text(s: str) -> bytes:
    units = s.encode("utf-16-be", "surrogatepass")
    points = (chr(int.from_bytes(units[i : i + 2], "big")) for i in range(0, len(units), 2))
    raw = "".join(points).encode("utf-8", "surrogatepass").replace(b"\0", b"\xc0\x80")
    return struct.pack(">H", len(raw)) + raw


def _number(name: str, value: float | None) -> bytes:
    return _text(name) + (struct.pack(">i", 0) if value is None else struct.pack(">id", 4, value))


def blob_bytes(rows: list[dict]) -> bytes:
    """An observation file of rows (lat, lon, name, time_start, time_end, features, texts, arrays), of which all but the
    first three may be missing; the counterpart of read_blobs."""
    out = [struct.pack(">i", len(rows))]
    for r in rows:
        start, end = r.get("time_start"), r.get("time_end")
        body = _text(r["name"]) + (struct.pack(">?", False) if start is None else struct.pack(">?qq", True, start, start if end is None else end))
        scalars, texts, arrays = r.get("features") or {}, r.get("texts") or {}, r.get("arrays") or {}
        body += struct.pack(">?i", False, len(scalars) + len(texts))
        body += b"".join(_number(k, v) for k, v in scalars.items()) + b"".join(_text(k) + struct.pack(">i", 5) + _text(v) for k, v in texts.items())
        body += struct.pack(">i", len(arrays))
        for k, (dims, data) in arrays.items():
            body += struct.pack(">?", True) + _text(k) + struct.pack(">?i", False, len(dims)) + b"".join(struct.pack(">i", d) for d in dims)
            body += struct.pack(">i", len(data)) + b"".join(_number("", x) for x in data)
        body += struct.pack(">ii", 0, 0)  # no node, no path
        out += [struct.pack(">ffi", r["lat"], r["lon"], len(body)), body]
    return b"".join(out)


def write_blobs(df: DataFrame, path: str, records: int = 50_000) -> DataFrame:
    """Writes a table with the columns of read_blobs as observation files of up to so many records and returns their
    list (file, n_records). A repeated task writes files of other names; only those listed count."""
    path = re.sub("^file:/+", "file:///", path if ":/" in path else f"file://{path}").rstrip("/")
    columns = [c for c in ("lat", "lon", "name", "time_start", "time_end", "features", "texts", "arrays") if c in df.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        held: list[dict] = []

        def close() -> pd.DataFrame:
            name = f"{uuid.uuid4().hex}.mblob"
            with store.open_output_stream(f"{base}/{name}") as f:
                f.write(blob_bytes(held))
            return pd.DataFrame({"file": [f"{path}/{name}"], "n_records": [len(held)]})

        for pdf in frames:
            for r in pdf.to_dict("records"):
                for k in ("time_start", "time_end"):
                    r[k] = None if k not in r or pd.isna(r[k]) else int(r[k])
                for k in ("features", "texts", "arrays"):
                    r[k] = dict(r[k]) if r.get(k) is not None else {}
                r["features"] = {k: None if pd.isna(v) else float(v) for k, v in r["features"].items()}
                r["arrays"] = {k: ([int(d) for d in (v["dims"] if isinstance(v, dict) else v[0])], [None if x is None or x != x else float(x) for x in (v["data"] if isinstance(v, dict) else v[1])]) for k, v in r["arrays"].items()}
                held.append(r)
                if len(held) >= records:
                    yield close()
                    held = []
        if held:
            yield close()

    return df.select(*columns).mapInPandas(run, "file string, n_records long")
