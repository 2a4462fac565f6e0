"""Registered queries over spans, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.span_filter import attribute, field
from lodestone.operators import spans as S
from lodestone.plans.trace_table import SQL as SPANS
from lodestone.plans.trace_table import spans
from lodestone.sources import otlp

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of the span table; sql reads it as `spans`."""

    def register(f):
        Q[f.__name__] = lambda spark, sf_dir: f(spans(spark, sf_dir))
        if sql:
            SQL[f.__name__] = f"WITH RECURSIVE spans AS ({SPANS}), {sql[5:].lstrip()}" if sql.startswith("WITH ") else f"WITH spans AS ({SPANS}) {sql}"
        return f

    return register


def _cols(df):
    return df.select("seq", "trace_id", "span_id", "start_ns", "end_ns", "status_code")


_OUT = "seq, trace_id, span_id, start_ns, end_ns, status_code"
_MID = 1_704_070_000_000_000_000


@query(f"SELECT {_OUT} FROM spans WHERE start_ns <= {_MID} + 200000000000000 AND end_ns >= {_MID}")
def span_scan_range(s):
    return _cols(S.scan_range(s, _MID, _MID + 200_000_000_000_000))


@query(f"SELECT {_OUT} FROM spans WHERE service_name = 'purchase'")
def span_by_service(s):
    return _cols(S.by_service(s, "purchase"))


@query(f"SELECT {_OUT} FROM spans WHERE trace_id = 't7'")
def span_by_trace(s):
    return _cols(S.by_trace(s, "t7"))


@query(f"SELECT {_OUT} FROM spans WHERE seq = 77")
def span_get(s):
    return _cols(S.get_span(s, 77))


@query("SELECT count(*) AS n FROM spans")
def span_size(s):
    return S.size(s)


@query(f"SELECT {_OUT} FROM spans WHERE (duration_ns > 20000000 AND NOT status_code = 'error') OR (service_name = 'view' AND k >= 50)")
def span_filter_compound(s):
    return _cols(s.filter(((field("duration") > 20_000_000) & ~(field("status") == "error")) | ((field("service") == "view") & (attribute("k") >= 50))))


@query(f"SELECT {_OUT} FROM spans WHERE (k IS NULL OR k <> 3) AND status_code <> 'ok'")
def span_filter_not_missing(s):
    return _cols(s.filter(~(attribute("k") == 3) & ~(attribute("absent") != "x") & (field("status") != "ok")))


@query(
    "SELECT service_name, sum(duration_ns) / count(*) AS avg_ns, min(duration_ns) AS min_ns, max(duration_ns) AS max_ns, quantile_disc(duration_ns, 0.5) AS p50_ns, quantile_disc(duration_ns, 0.95) AS p95_ns, quantile_disc(duration_ns, 0.99) AS p99_ns "
    "FROM spans GROUP BY service_name"
)
def duration_stats(s):
    return S.duration_stats(s, ["service_name"])


@query("SELECT service_name, min(seq) AS first_seq FROM spans GROUP BY service_name")
def service_map_nodes(s):
    return S.service_nodes(s)


@query(
    "WITH p AS (SELECT span_id, service_name, row_number() OVER (PARTITION BY span_id ORDER BY seq DESC) AS r FROM spans) "
    "SELECT p.service_name AS from_service, c.service_name AS to_service, count(*) AS call_count FROM spans c JOIN p ON c.parent_span_id = p.span_id AND p.r = 1 WHERE p.service_name <> c.service_name GROUP BY 1, 2"
)
def service_map_edges(s):
    return S.service_edges(s)


def _judged_sql(frame: str) -> str:
    w = f"OVER (PARTITION BY service_name, name ORDER BY start_ns, seq ROWS BETWEEN {frame} AND 1 PRECEDING)"
    return (
        f"WITH j AS (SELECT seq, CAST(duration_ns AS HUGEINT) AS d, CAST(count(*) {w} AS HUGEINT) AS n, CAST(sum(CAST(duration_ns AS HUGEINT)) {w} AS HUGEINT) AS t, CAST(sum(CAST(duration_ns AS HUGEINT) * duration_ns) {w} AS HUGEINT) AS q FROM spans) "
        "SELECT seq, coalesce(n >= 2 AND (n * d - t) * (n * d - t) > 9 * (n * q - t * t), false) AS is_anomaly FROM j"
    )


@query(_judged_sql("UNBOUNDED PRECEDING"))
def anomalies_expanding(s):
    return S.anomalies_expanding(s, k=3).select("seq", "is_anomaly")


@query(_judged_sql("100 PRECEDING"))
def anomalies_rolling(s):
    return S.anomalies_rolling(s, k=3, window=100).select("seq", "is_anomaly")


_DEPTH = (
    "WITH f AS (SELECT trace_id AS ft, min(start_ns) AS first_ns FROM spans GROUP BY trace_id), "
    "d AS (SELECT seq, trace_id, span_id, start_ns, duration_ns, CAST(0 AS BIGINT) AS depth FROM spans WHERE parent_span_id IS NULL "
    "UNION ALL SELECT c.seq, c.trace_id, c.span_id, c.start_ns, c.duration_ns, d.depth + 1 FROM spans c JOIN d ON c.trace_id = d.trace_id AND c.parent_span_id = d.span_id)"
)


@query(f"{_DEPTH} SELECT seq, start_ns - first_ns AS start_offset_ns, depth FROM d JOIN f ON d.trace_id = f.ft")
def flame_offset_depth(s):
    return S.flame_nodes(s).select("seq", "start_offset_ns", "depth")


@query(
    f"{_DEPTH}, m AS (SELECT trace_id AS mt, CAST(max(start_ns - first_ns + duration_ns) AS DOUBLE) AS total FROM d JOIN f ON d.trace_id = f.ft GROUP BY 1) "
    "SELECT seq, CASE WHEN total > 0 THEN CAST(start_ns - first_ns AS DOUBLE) / total * 1000.0 ELSE 0.0 END AS x, depth * 20.0 AS y, "
    "CASE WHEN total > 0 THEN greatest(CAST(duration_ns AS DOUBLE) / total * 1000.0, 1.0) ELSE 1000.0 END AS width FROM d JOIN f ON d.trace_id = f.ft JOIN m ON d.trace_id = m.mt"
)
def flame_layout(s):
    out = S.flame_layout(S.flame_nodes(s), 1000, 20).select("seq", "x", "y", "width")
    return out


@query(
    "WITH n AS (SELECT service_name, row_number() OVER (ORDER BY min(seq)) - 1 AS i, count(*) OVER () AS n FROM spans GROUP BY service_name) "
    "SELECT service_name, round(400 + 240 * cos(i * 2 * pi() / n - pi() / 2), 6) AS x, round(300 + 240 * sin(i * 2 * pi() / n - pi() / 2), 6) AS y FROM n"
)
def map_layout(s):
    return S.map_layout(S.service_nodes(s), 800, 600).select("service_name", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(
    "WITH n AS (SELECT service_name, row_number() OVER (ORDER BY min(seq)) - 1 AS i, count(*) OVER () AS n FROM spans GROUP BY service_name), "
    "l AS (SELECT service_name, 400 + 240 * cos(i * 2 * pi() / n - pi() / 2) AS x, 300 + 240 * sin(i * 2 * pi() / n - pi() / 2) AS y FROM n), "
    "p AS (SELECT span_id, service_name, row_number() OVER (PARTITION BY span_id ORDER BY seq DESC) AS r FROM spans), "
    "e AS (SELECT p.service_name AS a, c.service_name AS b, count(*) AS call_count FROM spans c JOIN p ON c.parent_span_id = p.span_id AND p.r = 1 WHERE p.service_name <> c.service_name GROUP BY 1, 2) "
    "SELECT a AS from_service, b AS to_service, call_count, round(l.x, 6) AS x1, round(l.y, 6) AS y1, round(m.x, 6) AS x2, round(m.y, 6) AS y2 FROM e JOIN l ON l.service_name = a JOIN l m ON m.service_name = b"
)
def map_lines(s):
    lines = S.map_lines(S.service_edges(s), S.map_layout(S.service_nodes(s), 800, 600))
    return lines.select("from_service", "to_service", "call_count", *[F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")])


@query(f"SELECT seq, CAST(start_ns AS VARCHAR) AS start_ns, CAST(end_ns AS VARCHAR) AS end_ns, CAST(duration_ns AS VARCHAR) AS duration_ns FROM spans")
def span_serialized(s):
    return S.serialized(s).select("seq", "start_ns", "end_ns", "duration_ns")


@query("SELECT trace_id, span_id, parent_span_id, name, service_name, start_ns, end_ns, duration_ns, k, status_code FROM spans")
def otlp_round_trip(s):
    payloads = otlp.build(s).withColumn("payload_id", F.concat_ws("/", "service_name", "part"))
    back = otlp.flatten(payloads)
    return back.select("trace_id", "span_id", "parent_span_id", "name", "service_name", "start_ns", "end_ns", "duration_ns", F.try_element_at("attributes", F.lit("k"))["n"].alias("k"), "status_code")


@query("SELECT span_id AS payload_id FROM spans WHERE (status_code = 'error' AND seq % 7 = 0) OR k = 5")
def otlp_rejects(s):
    """Payloads of one span each; some spans have no trace id, some an attribute without a known kind of value."""
    spoilt = (F.col("status_code") == "error") & (F.col("seq") % 7 == 0)
    empty = F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("double").alias("n"), F.lit(None).cast("boolean").alias("b"))
    attributes = F.when(F.try_element_at("attributes", F.lit("k"))["n"] == 5, F.create_map(F.lit("odd"), empty)).otherwise(F.col("attributes"))
    one = s.withColumns({"service_name": F.col("span_id"), "trace_id": F.when(~spoilt, F.col("trace_id")), "attributes": attributes})
    return otlp.rejected(otlp.build(one).withColumnRenamed("service_name", "payload_id"))
