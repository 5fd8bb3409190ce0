"""Streaming sketches: deltas of leaves, checkpoints and restore."""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tesserae.operators import engine, sketch
from tesserae.operators.sketch import CONFIG, SketchConfig
from tesserae.sources.observations import VIEW


def source(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The observations of a folder of event files, as a replayable stream."""
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return events.select(*[F.expr(sql).alias(name) for name, sql, _ in VIEW], F.col("ts").cast("timestamp").alias("ts"))


def leaves(stream: DataFrame, config: SketchConfig = CONFIG) -> DataFrame:
    """The leaf table as a streaming aggregate, for update or complete mode. Late rows are always merged, so its state
    grows with the distinct paths; give the stream a watermark to bound it."""
    return sketch.build(stream, config)


def tumbling(stream: DataFrame, hours: int = 6, late: str | None = None) -> DataFrame:
    """Counts per bucket (start, end], labelled by its end; with late, a watermark."""
    own = stream.withColumn("_t", F.col("ts") - F.expr("INTERVAL 1 MICROSECOND"))
    own = own.withWatermark("_t", late) if late else own
    return own.groupBy(F.window("_t", f"{hours} hours")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.end").alias("bucket"), "n", "total")


class Processor:
    """What a stream's batches go through. Subclasses replace what they need; the sketch's own way is the default.
    process: what a batch becomes; merge: two states into one; split: a state without and with a prefix; answer: a query
    on a state."""

    def __init__(self, config: SketchConfig = CONFIG):
        self.config = config

    def process(self, batch: DataFrame, batch_id: int) -> DataFrame:
        return sketch.build(batch, self.config)

    def merge(self, *states: DataFrame) -> DataFrame:
        return sketch.merge(*states, config=self.config)

    def split(self, state: DataFrame, prefix: str) -> tuple[DataFrame, DataFrame]:
        return sketch.split(state, prefix)

    def answer(self, state: DataFrame, kind: str, spec: dict) -> DataFrame:
        return engine.query(state, kind, spec)


def deduplicated(stream: DataFrame, keys: list[str], late: str, ts: str = "ts") -> DataFrame:
    """Without rows that repeat the keys of one not older than `late`, as after a source sends a batch again. The state
    holds the keys of that span only."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def write_deltas(stream: DataFrame, path: str, checkpoint: str, config: SketchConfig = CONFIG, replica: str | None = None, processor: Processor | None = None) -> StreamingQuery:
    """Appends each batch's own leaves under batch=<id>; a batch that is run again replaces its folder. With a replica,
    each delta is written there as well before the batch counts as done; either folder restores the whole."""
    own = processor or Processor(config)

    def append(batch: DataFrame, batch_id: int) -> None:
        delta = f"{path}/batch={batch_id}"
        own.process(batch, batch_id).write.mode("overwrite").parquet(delta)
        if replica:
            batch.sparkSession.read.parquet(delta).write.mode("overwrite").parquet(f"{replica}/batch={batch_id}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def continuous(stream: DataFrame, queries: dict[str, tuple[str, dict]], path: str, checkpoint: str, on_answer: Callable[[str, int, DataFrame], None], processor: Processor | None = None) -> StreamingQuery:
    """Queries (kind, spec) by name that are answered again after each batch, over all deltas so far under path."""
    own = processor or Processor()

    def run(batch: DataFrame, batch_id: int) -> None:
        own.process(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        state = own.merge(batch.sparkSession.read.parquet(path).drop("batch"))
        for name, (kind, spec) in queries.items():
            on_answer(name, batch_id, own.answer(state, kind, spec))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restore(spark: SparkSession, path: str, config: SketchConfig = CONFIG) -> DataFrame:
    """The leaf table from all deltas."""
    return sketch.merge(spark.read.parquet(path).drop("batch"), config=config)


#: Metrics of a finished batch by name, functions of its progress.
METRICS: dict[str, Callable] = {"rows": lambda p: p.numInputRows, "throughput": lambda p: p.processedRowsPerSecond, "state_rows": lambda p: sum(o.numRowsTotal for o in p.stateOperators)}


class Metrics(StreamingQueryListener):
    """Writes a file per metric below a folder of the driver, <name>.csv, with a line (time, batch, value) for each
    finished batch. processors: further metrics, or others instead of those of the same name."""

    def __init__(self, folder: str, processors: dict[str, Callable] | None = None):
        self.folder, self.processors = folder, METRICS | (processors or {})

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.record(event.progress)

    def record(self, progress) -> None:
        for name, of in self.processors.items():
            with open(f"{self.folder}/{name}.csv", "a", newline="", encoding="utf-8") as f:
                csv.writer(f).writerow([progress.timestamp, progress.batchId, of(progress)])

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
