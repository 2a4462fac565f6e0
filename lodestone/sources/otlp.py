"""Trace payloads as nested JSON: reading them into spans, and writing spans as payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VALUE = "struct<stringValue:string,boolValue:boolean,doubleValue:double,intValue:string>"
_ATTRIBUTES = f"array<struct<key:string,value:{_VALUE}>>"
_SPAN = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_ATTRIBUTES},status:struct<code:int>>"
PAYLOAD = f"struct<resourceSpans:array<struct<resource:struct<attributes:{_ATTRIBUTES}>,scopeSpans:array<struct<spans:array<{_SPAN}>>>>>>"
_STORED = "struct<s:string,n:double,b:boolean>"


def _value(v: Column) -> Column:
    """Text before truth before number; one slot is set."""
    none = lambda kind: F.lit(None).cast(kind)
    number = F.coalesce(v["doubleValue"], v["intValue"].cast("double"))
    return F.when(v["stringValue"].isNotNull(), F.struct(v["stringValue"].alias("s"), none("double").alias("n"), none("boolean").alias("b"))).otherwise(
        F.when(v["boolValue"].isNotNull(), F.struct(none("string").alias("s"), none("double").alias("n"), v["boolValue"].alias("b"))).otherwise(F.struct(none("string").alias("s"), number.alias("n"), none("boolean").alias("b")))
    )


def _attributes(a: Column) -> Column:
    """A map; of a repeated key the last stays; without attributes empty."""
    held = F.coalesce(a, F.expr(f"CAST(array() AS {_ATTRIBUTES})"))
    last = F.filter(held, lambda x, i: ~F.exists(F.slice(held, i + 2, F.greatest(F.size(held), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["key"].alias("key"), _value(x["value"]).alias("value"))))


def _whole(number: Column) -> Column:
    """Nanoseconds from decimal text; a fraction is cut off."""
    return F.regexp_extract(number, r"^\s*(-?\d+)", 1).cast("bigint")


def _bad(payload: Column) -> Column:
    """Any span without a trace or span id, or any attribute without a known kind of value, spoils the whole payload."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    unknown = lambda a: F.coalesce(F.exists(a, lambda x: F.coalesce(x["value"]["stringValue"], x["value"]["boolValue"].cast("string"), x["value"]["doubleValue"].cast("string"), x["value"]["intValue"]).isNull()), F.lit(False))
    span = lambda s: empty(s["traceId"]) | empty(s["spanId"]) | unknown(s["attributes"])
    inner = lambda c: F.coalesce(F.exists(c["spans"], span), F.lit(False))
    resource = lambda r: F.coalesce(F.exists(r["scopeSpans"], inner), F.lit(False)) | unknown(r["resource"]["attributes"])
    return payload.isNull() | F.coalesce(F.exists(payload["resourceSpans"], resource), F.lit(False))


def parsed(payloads: DataFrame, id_col: str = "payload_id", json_col: str = "json") -> DataFrame:
    """payload_id, payload and bad, one row a payload."""
    read = payloads.select(F.col(id_col).alias("payload_id"), F.from_json(F.col(json_col), PAYLOAD).alias("payload"))
    return read.withColumn("bad", _bad(F.col("payload")))


def rejected(payloads: DataFrame, id_col: str = "payload_id", json_col: str = "json") -> DataFrame:
    """The ids of payloads that are turned down as a whole."""
    return parsed(payloads, id_col, json_col).filter("bad").select("payload_id")


def flatten(payloads: DataFrame, id_col: str = "payload_id", json_col: str = "json") -> DataFrame:
    """The spans of good payloads; `place` (payload_id and three positions) is their order."""
    good = parsed(payloads, id_col, json_col).filter("NOT bad")
    r = good.select("payload_id", F.posexplode("payload.resourceSpans").alias("ri", "r"))
    named = F.filter("r.resource.attributes", lambda x: x["key"] == "service.name")
    service = F.coalesce(F.get(named, F.size(named) - 1)["value"]["stringValue"], F.lit("unknown_service"))
    c = r.select("payload_id", "ri", service.alias("service_name"), F.posexplode("r.scopeSpans").alias("ci", "c"))
    s = c.select("payload_id", "ri", "service_name", "ci", F.posexplode("c.spans").alias("si", "s"))
    start, end = _whole(F.col("s.startTimeUnixNano")), _whole(F.col("s.endTimeUnixNano"))
    code = F.col("s.status.code")
    return s.select(
        F.struct("payload_id", "ri", "ci", "si").alias("place"), F.col("s.traceId").alias("trace_id"), F.col("s.spanId").alias("span_id"), F.nullif(F.col("s.parentSpanId"), F.lit("")).alias("parent_span_id"),
        F.col("s.name").alias("name"), "service_name", start.alias("start_ns"), end.alias("end_ns"), (end - start).alias("duration_ns"), _attributes(F.col("s.attributes")).alias("attributes"),
        F.when(code == 1, "ok").when(code == 2, "error").otherwise("unset").alias("status_code"),
    )


def build(spans: DataFrame, per_payload: int = 10_000) -> DataFrame:
    """service_name, part and json: payloads of one service each, of about per_payload spans, in seq order.

    Spans are dealt to parts by a hash of span_id and seq, so a busy service makes many payloads, not one, and so does a
    busy trace: a payload need not hold a whole trace.
    """
    none = lambda kind: F.lit(None).cast(kind)
    kv = F.transform(F.map_entries("attributes"), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"]["s"].alias("stringValue"), e["value"]["b"].alias("boolValue"), e["value"]["n"].alias("doubleValue"), none("string").alias("intValue")).alias("value")))
    code = F.when(F.col("status_code") == "ok", 1).when(F.col("status_code") == "error", 2).otherwise(0)
    span = F.struct(
        F.col("seq"), F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), F.col("name"), F.col("start_ns").cast("string").alias("startTimeUnixNano"),
        F.col("end_ns").cast("string").alias("endTimeUnixNano"), kv.alias("attributes"), F.struct(code.alias("code")).alias("status"),
    )
    sizes = spans.groupBy(F.col("service_name").alias("s_name")).agg(F.ceil(F.count(F.lit(1)) / per_payload).alias("parts"))
    dealt = spans.join(sizes, F.col("service_name") == F.col("s_name")).withColumn("part", F.pmod(F.xxhash64("span_id", "seq"), "parts"))
    held = dealt.groupBy("service_name", "part").agg(F.transform(F.array_sort(F.collect_list(span)), lambda s: s.dropFields("seq")).alias("spans"))
    text = F.struct(F.col("service_name").alias("stringValue"))
    resource = F.struct(F.array(F.struct(F.lit("service.name").alias("key"), text.alias("value"))).alias("attributes"))
    payload = F.struct(F.array(F.struct(resource.alias("resource"), F.array(F.struct(F.col("spans").alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    return held.select("service_name", "part", F.to_json(payload).alias("json"))
