"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import shared_folder

#: Text of printable ASCII, tab, line feed, carriage return and Latin-1 letters. On it every Unicode
#: version, regular-expression library and normal form agrees.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")


class Scratch:
    """Written tables in the shared folder. They cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.made, self.n = spark, shared_folder(spark, name), {}, 0

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and returns the written table; call drop(name) when nothing reads it any more."""
        key, self.n = f"{name}-{self.n}", self.n + 1
        path = f"{self.root}/{key}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[key] = path
        return out

    def folder(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str, last: int = 0) -> None:
        """Removes the written tables of these names, but for so many of the last ones of each."""
        for name in names:
            keys = [k for k in self.made if k.rsplit("-", 1)[0] == name]
            for key in keys[: len(keys) - last]:
                self._remove(self.made.pop(key))

    def keep(self, *names: str) -> None:
        """Removes all written tables but those of these names."""
        self.drop(*{key.rsplit("-", 1)[0] for key in self.made} - set(names))

    def close(self) -> None:
        """Removes all that is left, the result's own tables included; call it when the result has been read."""
        self.made.clear()
        self._remove(self.root)

    def _remove(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)


#: Bounds of an Arrow batch of texts, for operators whose tasks hold two texts a row or much else beside them.
SMALL = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written within it passes through Python in small batches; the session's own bounds then hold again."""
    before = {key: spark.conf.get(key, None) for key in SMALL}
    try:
        for key, value in SMALL.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; a default only, every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def per_text(schema: str, make) -> Column:
    """A function of the column text by Arrow batches. make() runs once in a task and returns the work on a list of
    texts (None for null), which gives a DataFrame of as many rows. Other columns do not pass through Python. It counts
    as nondeterministic, so that the optimizer never runs it twice for a filter on its result."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = make()
        for texts in batches:
            yield work([t if isinstance(t, str) else None for t in texts])

    return F.pandas_udf(run, schema).asNondeterministic()(F.col("text").cast("string"))
