"""Span operators on small hand-made traces."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions.span_filter import attribute, field
from lodestone.operators import spans as S
from lodestone.sources import otlp

SCHEMA = "seq long, trace_id string, span_id string, parent_span_id string, name string, service_name string, start_ns long, end_ns long, duration_ns long, attributes map<string,struct<s:string,n:double,b:boolean>>, status_code string"
EPOCH = 1_700_000_000_000_000_001


def make(spark, rows):
    full = []
    for i, r in enumerate(rows):
        r = {"trace": "t", "span": f"s{i}", "up": None, "name": "op", "service": "svc", "start": 0, "ns": 1, "attributes": {}, "status": "unset"} | r
        full.append((i, r["trace"], r["span"], r["up"], r["name"], r["service"], r["start"], r["start"] + r["ns"], r["ns"], r["attributes"], r["status"]))
    return spark.createDataFrame(full, SCHEMA)


def test_ranges_overlap(spark):
    s = make(spark, [{"start": a, "ns": b - a} for a, b in ((0, 100), (200, 300), (250, 400), (500, 600))])
    assert sorted(r.seq for r in S.scan_range(s, 150, 350).collect()) == [1, 2]
    assert sorted(r.seq for r in S.scan_range(s, 100, 200).collect()) == [0, 1]


def test_duration_stats(spark):
    s = make(spark, [{"ns": n} for n in range(10, 101, 10)])
    (r,) = S.duration_stats(s, []).collect()
    assert (r.avg_ns, r.min_ns, r.max_ns, r.p50_ns, r.p95_ns, r.p99_ns) == (55.0, 10, 100, 50, 100, 100)
    (r,) = S.duration_stats(make(spark, [{"ns": n} for n in (100, 10, 50, 20)]), ["service_name"]).collect()
    assert r.p50_ns == 20
    assert [tuple(r) for r in S.duration_stats(s.filter("false"), []).collect()] == [(0, 0, 0, 0, 0, 0)]


def test_service_map(spark):
    s = make(spark, [{"span": "g", "service": "gateway"}, {"span": "a", "up": "g", "service": "auth"}, {"span": "d", "up": "a", "service": "db"}, {"span": "o", "up": "g", "service": "orders"}, {"span": "x", "up": "g", "service": "gateway"}, {"span": "y", "up": "gone", "service": "auth"}, {"span": "o2", "up": "g", "service": "orders", "trace": "t2"}])
    assert [r.service_name for r in S.service_nodes(s).orderBy("first_seq").collect()] == ["gateway", "auth", "db", "orders"]
    assert {tuple(r) for r in S.service_edges(s).collect()} == {("gateway", "auth", 1), ("auth", "db", 1), ("gateway", "orders", 2)}


def plain_anomaly(history, x, k):
    if len(history) < 2:
        return False
    mean = sum(history) / len(history)
    sd = math.sqrt(sum((h - mean) ** 2 for h in history) / len(history))
    return x != mean if sd == 0 else abs(x - mean) > k * sd


def test_anomalies(spark):
    for values, k in (([10, 20, 30, 40, 50, 44], 1), ([10, 20, 30, 40, 50, 45], 1), ([5, 5, 5, 6, 5], 3), ([5_000_000] * 10 + [5_000_000_000], 3), (list(range(1, 120)) + [10_000], 2)):
        s = make(spark, [{"start": EPOCH + i * 50, "ns": v} for i, v in enumerate(values)])
        got = [r.is_anomaly for r in S.anomalies_expanding(s, k, bucket_ns=700).orderBy("seq").collect()]
        assert got == [plain_anomaly(values[:i], v, k) for i, v in enumerate(values)]
        for window, chunk in ((100, 20_000), (3, 10), (5, 7)):
            got = [r.is_anomaly for r in S.anomalies_rolling(s, k, window, chunk).orderBy("seq").collect()]
            assert got == [plain_anomaly(values[max(0, i - window) : i], v, k) for i, v in enumerate(values)]
    with pytest.raises(ValueError, match="at least 2"):
        S.anomalies_rolling(s, 3, 1)


def test_rolling_ties(spark):
    # spans that start together, more of them than window and chunk, over several chunks, then single ones
    starts = [0] * 17 + [1] * 2 + [2] * 45 + list(range(3, 20)) + [30] * 8
    values = [(i * 37) % 11 + (500 if i % 13 == 0 else 0) for i in range(len(starts))]
    s = make(spark, [{"start": EPOCH + a * 50, "ns": v} for a, v in zip(starts, values)]).repartition(3)
    for window, chunk in ((5, 7), (3, 10), (2, 2), (9, 4)):
        got = [r.is_anomaly for r in S.anomalies_rolling(s, 1.5, window, chunk).orderBy("seq").collect()]
        assert got == [plain_anomaly(values[max(0, i - window) : i], v, 1.5) for i, v in enumerate(values)], (window, chunk)
    again = make(spark, [{"start": EPOCH, "ns": 5}] * 30 + [{"start": EPOCH + 1, "ns": 9}]).withColumn("seq", F.when(F.col("seq") == 30, 1).otherwise(0))
    got = S.anomalies_rolling(again, 3, 4, 8).collect()
    assert len(got) == 31 and [r.duration_ns for r in got if r.is_anomaly] == [9]


def test_rolling_sums_are_carried(spark):
    # nulls among the durations, some near the largest whose squares still fit, windows of any size and over chunk borders
    values = [None if i % 5 == 2 else (i * 37) % 11 + (10**15 if i % 41 == 0 else 0) for i in range(150)]
    s = make(spark, [{"start": EPOCH + i // 2, "ns": v or 0} for i, v in enumerate(values)]).withColumn("duration_ns", F.when(F.col("seq") % 5 != 2, F.col("duration_ns"))).repartition(3)
    for window, chunk in ((2, 2), (7, 7), (7, 10), (60, 64), (200, 20_000)):
        judged = S.anomalies_rolling(s, 2, window, chunk)
        want = []
        for i, x in enumerate(values):
            held = [h for h in values[max(0, i - window) : i] if h is not None]
            n, t, q = len(held), sum(held), sum(h * h for h in held)
            want.append(x is not None and n >= 2 and (n * x - t) ** 2 > 4 * (n * q - t * t))
        assert [r.is_anomaly for r in judged.orderBy("seq").collect()] == want and any(want), (window, chunk)
    # no row is added up once for each window it is in, and columns that nobody reads are not carried along
    plan = S.anomalies_rolling(s, 3, 100).select("seq", "is_anomaly")._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding$(), -1" in plan and "-100, -1)" not in plan
    assert "attributes" not in plan.split("Scan ExistingRDD")[0]


def plain_depths(rows):
    up = {r["span"]: r.get("up") for r in rows}

    def depth(s, seen):
        if up[s] is None or s in seen or up[s] not in up:
            return 0
        return 1 + depth(up[s], seen | {s})

    return [depth(r["span"], frozenset()) for r in rows]


def test_flamegraph(spark):
    rows = [{"span": "r", "start": EPOCH + 1000, "ns": 4000}, {"span": "c", "up": "r", "start": EPOCH + 1500, "ns": 1500}, {"span": "g", "up": "c", "start": EPOCH + 2000, "ns": 500}, {"span": "lost", "up": "nowhere", "start": EPOCH + 1000}, {"span": "self", "up": "self", "start": EPOCH + 1000}, {"span": "x", "up": "y", "start": EPOCH + 1000}, {"span": "y", "up": "x", "start": EPOCH + 1000}, {"span": "tail", "up": "x", "start": EPOCH + 1000}]
    rows += [{"span": f"d{i}", "up": f"d{i - 1}" if i else None, "start": EPOCH + 1000} for i in range(150)]
    nodes = S.flame_nodes(make(spark, rows)).orderBy("seq").collect()
    assert [r.depth for r in nodes] == plain_depths(rows)
    assert [r.start_offset_ns for r in nodes[:3]] == [0, 500, 1000]
    laid = S.flame_layout(S.flame_nodes(make(spark, rows[:3])), 800, 20).orderBy("seq").collect()
    assert [(r.x, r.y, r.width, r.height) for r in laid] == [(0.0, 0.0, 800.0, 20.0), (100.0, 20.0, 300.0, 20.0), (200.0, 40.0, 100.0, 20.0)]
    flat = S.flame_layout(S.flame_nodes(make(spark, [{"ns": 0}])), 800, 20).first()
    assert (flat.x, flat.width) == (0.0, 800.0)


def test_map_layout(spark):
    one = S.map_layout(S.service_nodes(make(spark, [{}])), 400, 200).first()
    assert (one.x, one.y) == (200.0, 100.0)
    s = make(spark, [{"service": c, "span": c, "up": u} for c, u in (("a", None), ("b", "a"), ("c", "a"), ("d", "gone"))])
    layout = S.map_layout(S.service_nodes(s), 400, 200)
    assert [(round(r.x), round(r.y)) for r in layout.collect()] == [(200, 20), (280, 100), (200, 180), (120, 100)]
    lines = S.map_lines(S.service_edges(s).unionAll(spark.createDataFrame([("a", "unknown", 1)], "a string, b string, c long")), layout)
    assert lines.count() == 2


def test_filters(spark):
    a = lambda s=None, n=None, b=None: (s, n, b)
    s = make(spark, [{"service": "x", "ns": 150_000_000, "attributes": {"m": a(s="GET"), "k": a(n=5.0), "ok": a(b=True)}}, {"service": "y", "ns": 5, "status": "error"}])
    seqs = lambda c: [r.seq for r in s.filter(c).orderBy("seq").collect()]
    assert seqs(field("duration") > 100_000_000) == [0]
    assert seqs(field("duration") <= 5) == [1]
    assert seqs(field("service") == "x") == [0]
    assert seqs(field("service") != "x") == [1]
    assert seqs(field("service") > "a") == []  # ordering is for numbers
    assert seqs(field("service") != 3) == [0, 1]  # another type differs
    assert seqs(attribute("m") == "GET") == [0]
    assert seqs(attribute("m") != "GET") == []  # missing passes no test
    assert seqs(~(attribute("m") == "GET")) == [1]
    assert seqs(attribute("k") >= 5) == [0]
    assert seqs((attribute("ok") == True) | (field("status") == "error")) == [0, 1]  # noqa: E712
    assert seqs(attribute("k") == "5") == []
    with pytest.raises(ValueError, match="unknown field"):
        field("nope")


def payload(**span):
    base = {"traceId": "t1", "spanId": "s1", "name": "op", "startTimeUnixNano": str(EPOCH), "endTimeUnixNano": EPOCH + 50, "attributes": []}
    return {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}, "scopeSpans": [{"spans": [base | span]}]}]}


def flat(spark, *payloads):
    df = spark.createDataFrame([(i, json.dumps(p) if not isinstance(p, str) else p) for i, p in enumerate(payloads)], "payload_id long, json string")
    return otlp.flatten(df).orderBy("place").collect(), [r.payload_id for r in otlp.rejected(df).collect()]


def test_payloads(spark):
    attributes = [{"key": "a", "value": {"stringValue": "x"}}, {"key": "b", "value": {"intValue": "200"}}, {"key": "c", "value": {"doubleValue": 1.5}}, {"key": "d", "value": {"boolValue": False}}, {"key": "a", "value": {"stringValue": "last"}}]
    (r,), bad = flat(spark, payload(attributes=attributes, parentSpanId="", status={"code": 2}))
    assert (r.start_ns, r.end_ns, r.duration_ns, r.parent_span_id, r.status_code, r.service_name) == (EPOCH, EPOCH + 50, 50, None, "error", "api")
    got = {k: tuple(v) for k, v in r.attributes.items()}
    assert got == {"a": ("last", None, None), "b": (None, 200.0, None), "c": (None, 1.5, None), "d": (None, None, False)}
    assert bad == []
    rows, bad = flat(spark, payload(traceId=""), payload(attributes=[{"key": "k", "value": {}}]), payload(), "{not json", {}, {"resourceSpans": [{"scopeSpans": [{"spans": [payload()["resourceSpans"][0]["scopeSpans"][0]["spans"][0]]}]}]})
    assert [r.service_name for r in rows] == ["api", "unknown_service"]
    assert 0 in bad and 1 in bad and 2 not in bad and 4 not in bad
    assert rows[1].attributes == {}


def test_payload_round_trip(spark):
    a = {"m": ("GET", None, None), "k": (None, 5.0, None), "ok": (None, None, True)}
    s = make(spark, [{"span": f"s{i}", "trace": f"t{i % 5}", "up": f"s{i - 1}" if i % 3 else None, "service": f"v{i % 2}", "start": EPOCH + i, "ns": 7, "attributes": a if i % 2 else {}, "status": ("ok", "error", "unset")[i % 3]} for i in range(30)])
    built = otlp.build(s, per_payload=4)
    assert built.count() > 2
    back = otlp.flatten(built.withColumn("payload_id", F.concat_ws("/", "service_name", "part")))
    columns = [c for c in s.columns if c not in ("seq", "attributes")]
    assert sorted(map(str, back.select(*columns).collect())) == sorted(map(str, s.select(*columns).collect()))
    assert {r.span_id: {k: tuple(v) for k, v in r.attributes.items()} for r in back.collect()} == {r.span_id: {k: tuple(v) for k, v in r.attributes.items()} for r in s.collect()}


def test_busy_trace_makes_many_payloads(spark):
    s = make(spark, [{"trace": "hot"} for _ in range(2000)] + [{"trace": f"t{i}"} for i in range(1000)])
    built = otlp.build(s, per_payload=100)
    sizes = [r.json.count('"traceId"') for r in built.collect()]
    assert sum(sizes) == 3000 and len(sizes) == 30 and max(sizes) < 200


def test_serialized(spark):
    assert S.serialized(make(spark, [{"start": EPOCH}])).first().start_ns == str(EPOCH)
    assert S.by_trace(make(spark, [{}, {"trace": "u"}]), "u").count() == 1
    assert S.by_service(make(spark, [{}, {"service": "u"}]), "u").count() == 1


def test_get_and_size(spark):
    s = make(spark, [{}, {"span": "second"}])
    assert S.get_span(s, 1).first().span_id == "second" and S.get_span(s, 1).columns == s.columns
    assert S.size(s).first().n == 2 and S.size(s.filter("false")).first().n == 0
    with pytest.raises(Exception, match="no span at 2"):
        S.get_span(s, 2).collect()


def test_anomalies_keep_columns_of_any_name(spark):
    values = [5, 5, 5, 6, 5, 900, 5]
    s = make(spark, [{"start": EPOCH + i, "ns": v} for i, v in enumerate(values)])
    names = ["_b", "_d", "_q", "n1", "t1", "q1", "_c", "_i", "b", "d", "q", "i", "c", "s", "row", "first", "before", "is_anomaly"]
    odd = s.withColumns({n: F.concat(F.lit(n), F.col("seq")) for n in names})
    for judged in (S.anomalies_expanding(odd), S.anomalies_rolling(odd, 3, 3, 4)):
        rows = judged.orderBy("seq").collect()
        assert all(r[n] == f"{n}{r.seq}" for r in rows for n in names[:-1])
        assert rows[5].is_anomaly is True and rows[0].is_anomaly is False
