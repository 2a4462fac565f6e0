"""Payload files as a stream, and the rolling judge."""

import json

from lodestone.sources import otlp
from lodestone.streaming import spans as stream
from tests.test_spans import payload, plain_anomaly


def test_ingest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps(payload(spanId="one")))
    (source / "b.json").write_text(json.dumps(payload(traceId="")))

    def run():
        stream.ingest(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()

    run()
    assert [r.span_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["one"]
    assert [r.payload_id for r in spark.read.parquet(f"{tmp_path}/bad").collect()] == ["b.json"]
    (source / "c.json").write_text(json.dumps(payload(spanId="two")))
    run()
    assert sorted(r.span_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["one", "two"]
    assert otlp.PAYLOAD.startswith("struct")


def test_judge(spark, tmp_path):
    values = [10, 20, 30, 40, 50, 100, 20, 20, 20, 20, 25, 500]
    rows = [("api", "op", f"s{i}", v) for i, v in enumerate(values)]
    schema = "service_name string, name string, span_id string, duration_ns long"
    for part in (rows[:5], rows[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = stream.judge(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2, 4).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
    got = {r.span_id: r.is_anomaly for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {f"s{i}": plain_anomaly(values[max(0, i - 4) : i], v, 2) for i, v in enumerate(values)}


def test_a_retried_batch_adds_nothing(spark, tmp_path):
    """Without the log of finished batches the same files come again under the same number."""
    import shutil

    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text(json.dumps(payload(spanId="one")))
    for _ in range(2):
        stream.ingest(spark, str(source), f"{tmp_path}/out", f"{tmp_path}/bad", f"{tmp_path}/cp").awaitTermination()
        shutil.rmtree(tmp_path / "cp" / "commits")
    assert [r.span_id for r in spark.read.parquet(f"{tmp_path}/out").collect()] == ["one"]


def test_judge_takes_a_batch_in_order(spark, tmp_path):
    values = [10, 20, 30, 40, 50, 100, 20, 20, 20, 20, 25, 500]
    rows = [("api", "op", f"s{i}", v, i) for i, v in enumerate(values)][::-1]
    schema = "service_name string, name string, span_id string, duration_ns long, seq long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    stream.judge(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2, 4).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = {r.span_id: r.is_anomaly for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {f"s{i}": plain_anomaly(values[max(0, i - 4) : i], v, 2) for i, v in enumerate(values)}
