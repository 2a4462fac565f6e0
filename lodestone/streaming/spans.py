"""Spans as a stream: payload files in, spans out; and a rolling anomaly judge per operation."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources import otlp


def ingest(spark: SparkSession, source: str, out: str, rejects: str, checkpoint: str) -> StreamingQuery:
    """Reads each new payload file (one JSON payload a file), adds its spans to out, or its id to rejects.

    Each micro-batch has a folder of its own (batch=N) that a retry writes anew, so no span is stored twice.
    """
    files = spark.readStream.format("text").option("wholetext", "true").load(source).selectExpr("_metadata.file_name AS payload_id", "value AS json")

    def append(batch: DataFrame, number: int) -> None:
        otlp.flatten(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        otlp.rejected(batch).write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    return files.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def judge(stream: DataFrame, k: float = 3, window: int = 100, order: tuple[str, ...] = ("start_ns", "seq")) -> DataFrame:
    """service_name, name, span_id, duration_ns, is_anomaly: each span against the last `window` of its operation: judged
    first, then learnt.

    Micro-batches follow each other as they arrive, so a late span is judged when it comes; within one, an operation's
    spans are taken by those columns of `order` that the stream has (without any, as Spark delivers them).
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    by = [c for c in order if c in stream.columns]

    def run(key: tuple[str, str], batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else (), window)
        total, squares = sum(held), sum(x * x for x in held)
        pdf = pd.concat([b[["span_id", "duration_ns", *by]] for b in batches])
        if by:
            pdf = pdf.sort_values(by, kind="stable")
        out = []
        for d in pdf.duration_ns.tolist():
            n = len(held)
            out.append(n >= 2 and (n * d - total) ** 2 > k * k * (n * squares - total * total))
            if n == window:
                total, squares = total - held[0], squares - held[0] ** 2
            held.append(d)
            total, squares = total + d, squares + d * d
        state.update(([*held],))
        yield pd.DataFrame({"service_name": key[0], "name": key[1], "span_id": pdf.span_id, "duration_ns": pdf.duration_ns, "is_anomaly": out})

    schema = "service_name string, name string, span_id string, duration_ns long, is_anomaly boolean"
    return stream.groupBy("service_name", "name").applyInPandasWithState(run, schema, "held array<long>", "append", "NoTimeout")
