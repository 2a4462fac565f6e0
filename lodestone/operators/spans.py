"""Trace spans: selection, duration statistics, service map, anomalies, flamegraph.

A span table has seq, trace_id, span_id, parent_span_id, name, service_name, start_ns, end_ns, duration_ns (long),
attributes (map of name to struct s, n, b) and status_code.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan_range(spans: DataFrame, lo: int, hi: int) -> DataFrame:
    """Spans that overlap [lo, hi], ends included."""
    return spans.filter((F.col("start_ns") <= hi) & (F.col("end_ns") >= lo))


def by_service(spans: DataFrame, name: str) -> DataFrame:
    return spans.filter(F.col("service_name") == name)


def by_trace(spans: DataFrame, trace_id: str) -> DataFrame:
    return spans.filter(F.col("trace_id") == trace_id).orderBy("seq")


def size(spans: DataFrame) -> DataFrame:
    """n: how many spans are stored."""
    return spans.agg(F.count(F.lit(1)).alias("n"))


def get_span(spans: DataFrame, seq: int) -> DataFrame:
    """The span stored at seq; reading it raises if there is none."""
    found = spans.filter(F.col("seq") == seq).agg(F.first(F.struct("*")).alias("row"))
    return found.select(F.when(F.col("row").isNotNull(), F.col("row")).otherwise(F.raise_error(F.lit(f"no span at {seq}")).cast(found.schema["row"].dataType)).alias("row")).select("row.*")


def _before(counts: DataFrame, keys: list[str], order: str, width: int) -> DataFrame:
    """counts (keys, order, c) with `before`, the sum of c over smaller values of order, and `all`, that over the keys.

    Values are cut into buckets of a width: sums run within a bucket, and over one row a bucket, so that no group of keys
    is sorted in one task.
    """
    cut = counts.withColumn("_b", F.expr(f"{order} div {width}"))
    sums = cut.groupBy(*keys, "_b").agg(F.sum("c").alias("s"))
    ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*[F.col(c).alias(f"k_{c}") for c in (*keys, "_b")], F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("ahead"), F.sum("s").over(Window.partitionBy(*keys)).alias("all"))
    own = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    run = cut.withColumn("run", F.coalesce(F.sum("c").over(own), F.lit(0)))
    both = run.join(carried, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in (*keys, "_b")]))
    return both.select(*keys, order, "c", (F.col("ahead") + F.col("run")).alias("before"), "all")


def duration_stats(spans: DataFrame, keys: list[str], width: int = 1_000_000) -> DataFrame:
    """avg, min, max and exact nearest-rank p50, p95, p99 of durations, by keys; 0 of nothing.

    Ranks are read off running counts of distinct durations, in buckets of `width` nanoseconds.
    """
    counts = spans.filter("duration_ns IS NOT NULL").groupBy(*keys, "duration_ns").agg(F.count(F.lit(1)).alias("c"))
    ranked = _before(counts, keys, "duration_ns", width)
    upto = F.col("before") + F.col("c")
    rank = lambda p: F.min(F.when(upto >= F.greatest(F.lit(1), F.ceil(F.col("all") * F.lit(p).cast("decimal(4,2)"))), F.col("duration_ns")))
    whole = F.sum(F.col("duration_ns").cast("decimal(38,0)") * F.col("c"))
    out = ranked.groupBy(*keys).agg((whole.cast("double") / F.sum("c")).alias("avg_ns"), F.min("duration_ns").alias("min_ns"), F.max("duration_ns").alias("max_ns"), rank(0.5).alias("p50_ns"), rank(0.95).alias("p95_ns"), rank(0.99).alias("p99_ns"))
    return out if keys else out.na.fill(0)


def service_nodes(spans: DataFrame) -> DataFrame:
    """Services, with the seq of their first span (their order)."""
    return spans.groupBy("service_name").agg(F.min("seq").alias("first_seq"))


def service_edges(spans: DataFrame) -> DataFrame:
    """Calls between services: a span whose parent (by span_id, of equal ids the last by seq) belongs to another."""
    parents = spans.groupBy(F.col("span_id").alias("p_id")).agg(F.max_by("service_name", "seq").alias("from_service"))
    calls = spans.select("parent_span_id", F.col("service_name").alias("to_service")).groupBy("parent_span_id", "to_service").agg(F.count(F.lit(1)).alias("c"))
    joined = calls.join(parents, F.col("parent_span_id") == F.col("p_id")).filter("from_service != to_service")
    return joined.groupBy("from_service", "to_service").agg(F.sum("c").alias("call_count"))


def _judged(n, total, squares, x, k: float):
    """x lies over k population standard deviations from the mean of n values; exact in whole numbers.

    |x - mean| > k sd is (n x - total)^2 > k^2 (n squares - total^2); with sd 0 it says x differs from the mean.
    """
    big = lambda c: c.cast("decimal(38,0)")
    off = big(n) * big(x) - total
    spread = big(n) * squares - total * total
    return F.coalesce(n >= 2, F.lit(False)) & F.coalesce(big(off) * big(off) > big(spread) * F.lit(k * k).cast("decimal(10,4)"), F.lit(False))


_OP = ["service_name", "name"]


def _held(spans: DataFrame) -> DataFrame:
    """What anomaly tests need of each span, and its columns under numbers, so that they may have any names and those that
    nobody reads are not carried along."""
    d = F.col("duration_ns").cast("decimal(38,0)")
    needed = [*_OP, "start_ns", "seq", "duration_ns", "d", "q"]
    whole = spans.select(*needed[:-2], d.alias("d"), (d * d).cast("decimal(38,0)").alias("q"), F.struct("*").alias("row"))
    return whole.select(*needed, *[F.col("row").getField(c).alias(f"_{i}") for i, c in enumerate(spans.columns)])


def _big(c: str):
    return F.coalesce(F.col(c), F.lit(0)).cast("decimal(38,0)")


def _on(mark: str, keys: list[str]):
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"{mark}_{c}")) for c in keys])


def _marked(mark: str, keys: list[str]) -> list:
    return [F.col(c).alias(f"{mark}_{c}") for c in keys]


def _with_anomaly(judged: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans' columns and is_anomaly, which takes the place of a column of that name."""
    return judged.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(spans.columns) if c != "is_anomaly"], "is_anomaly")


def anomalies_expanding(spans: DataFrame, k: float = 3, bucket_ns: int = 86_400_000_000_000) -> DataFrame:
    """spans with is_anomaly: judged by all earlier spans of its operation (service_name, name) by start and seq.

    An operation is cut into time buckets: running sums within a bucket, and one row a bucket for what came before, so a
    frequent operation is no single task.
    """
    held = _held(spans).withColumn("b", F.expr(f"start_ns div {bucket_ns}"))
    zero = F.lit(0).cast("decimal(38,0)")
    total = lambda c, w: F.coalesce(F.sum(c).over(w).cast("decimal(38,0)"), zero)
    before = Window.partitionBy(*_OP).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy(*_OP, "b").agg(F.count("d").alias("n"), F.sum("d").cast("decimal(38,0)").alias("t"), F.sum("q").cast("decimal(38,0)").alias("u"))
    carried = sums.select(*_marked("k", [*_OP, "b"]), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), total("t", before).alias("t0"), total("u", before).alias("q0"))
    own = Window.partitionBy(*_OP, "b").orderBy("start_ns", "seq").rowsBetween(Window.unboundedPreceding, -1)
    run = held.withColumns({"n1": F.count("d").over(own), "t1": total("d", own), "q1": total("q", own)})
    both = run.join(carried, _on("k", [*_OP, "b"]))
    n, t, q = (F.col(f"{c}1") + F.col(f"{c}0") for c in "ntq")
    return _with_anomaly(both.withColumn("is_anomaly", _judged(n, t.cast("decimal(38,0)"), q.cast("decimal(38,0)"), F.col("duration_ns"), k)), spans)


def anomalies_rolling(spans: DataFrame, k: float = 3, window: int = 100, chunk: int = 20_000, bucket_ns: int = 86_400_000_000_000) -> DataFrame:
    """spans with is_anomaly: judged by the last `window` spans of its operation.

    Operations are cut into chunks of `chunk` rows (`window` at least); each chunk gets the window rows before it as context.
    Sums over the last rows are carried from row to row: the row before comes in, the one that far back goes out, so a row
    costs the same for any window.
    """
    if window < 2:
        raise ValueError("window must be at least 2")
    chunk = max(chunk, window)
    # each row has a place of its own: rows before its start, before its range of seq among spans that start together, and in it
    cut = _held(spans).withColumn("s", F.expr(f"seq div {chunk}"))
    start, part = [*_OP, "start_ns"], [*_OP, "start_ns", "s"]
    tied = cut.groupBy(*part).agg(F.count(F.lit(1)).alias("c"))
    starts = _before(tied.groupBy(*start).agg(F.sum("c").alias("c")), _OP, "start_ns", bucket_ns).select(*_marked("f", start), "before")
    ahead = Window.partitionBy(*start).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    parts = tied.withColumn("ahead", F.coalesce(F.sum("c").over(ahead), F.lit(0))).join(starts, _on("f", start))
    firsts = parts.select(*_marked("k", part), (F.col("before") + F.col("ahead")).alias("first"))
    own = Window.partitionBy(*part).orderBy("seq", "duration_ns")
    placed = cut.join(firsts, _on("k", part)).withColumn("i", F.col("first") + F.row_number().over(own) - 1).withColumn("c", F.expr(f"i div {chunk}"))
    near = placed.withColumn("c", F.explode(F.when(F.col("i") % chunk >= chunk - window, F.array(F.col("c"), F.col("c") + 1)).otherwise(F.array(F.col("c")))))
    order = Window.partitionBy(*_OP, "c").orderBy("i")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    figures = lambda c: {"n": F.when(F.col(c).isNull(), 0).otherwise(1), "t": _big(c), "q": (_big(c) * _big(c)).cast("decimal(38,0)")}
    comes, goes = figures("duration_ns"), figures("gone")
    held = near.withColumn("gone", F.lag("duration_ns", window).over(order)).withColumns({f"{f}1": (comes[f] - goes[f]) for f in comes})
    sums = held.withColumns({"n": F.sum("n1").over(before), "t": F.sum("t1").over(before).cast("decimal(38,0)"), "q": F.sum("q1").over(before).cast("decimal(38,0)")})
    judged = sums.withColumn("is_anomaly", _judged(F.col("n"), F.col("t"), F.col("q"), F.col("duration_ns"), k))
    return _with_anomaly(judged.filter(F.expr(f"c = i div {chunk}")), spans)


def _twice_as_far(jump: DataFrame) -> DataFrame:
    """jump: trace_id, span_id, up (an ancestor that may have more above it) and depth (how far up that is)."""
    over = jump.select(F.col("trace_id").alias("o_trace"), F.col("span_id").alias("o_span"), F.col("up").alias("o_up"), F.col("depth").alias("o_depth"))
    joined = jump.join(over, (F.col("trace_id") == F.col("o_trace")) & (F.col("up") == F.col("o_span")), "left")
    return joined.select("trace_id", "span_id", F.col("o_up").alias("up"), (F.col("depth") + F.coalesce("o_depth", F.lit(0))).alias("depth"))


def flame_nodes(spans: DataFrame, rounds: int = 20) -> DataFrame:
    """spans with start_offset_ns (from the trace's first start) and depth (how many ancestors are in the trace).

    Depths come by pointer doubling: each join takes every span to the ancestor twice as far up, so a trace of depth d
    takes log2(d) joins, two of them between checkpoints.  How many are needed is told by jobs while the plan is made.  Only
    spans on or below a cycle of parents, which never reach a root, are walked in Python, as are those deeper than `rounds`
    doublings tell (a million).
    """
    first = spans.groupBy(F.col("trace_id").alias("f_trace")).agg(F.min("start_ns").alias("first_ns"))
    nodes = spans.groupBy("trace_id", "span_id").agg(F.max_by(F.struct("parent_span_id"), "seq").alias("p")).select("trace_id", "span_id", F.col("p.parent_span_id").alias("up"))
    ids = nodes.select(F.col("trace_id").alias("i_trace"), F.col("span_id").alias("i_span"))
    known = (F.col("trace_id") == F.col("i_trace")) & (F.col("up") == F.col("i_span"))
    jump = nodes.join(ids, known, "left").select("trace_id", "span_id", F.col("i_span").alias("up"), F.when(F.col("i_span").isNull(), 0).otherwise(1).cast("bigint").alias("depth"))
    largest = nodes.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 1
    for _ in range(0, min(rounds, math.ceil(math.log2(largest)) + 1), 2):
        jump = jump.checkpoint() if nodes.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else jump.cache()
        if jump.filter("up IS NOT NULL").isEmpty():
            break
        jump = _twice_as_far(_twice_as_far(jump))
    looped = jump.filter("up IS NOT NULL").select("trace_id", "span_id")
    depths = jump.filter("up IS NULL").select("trace_id", "span_id", "depth")
    if not looped.isEmpty():
        walked = nodes.join(looped, ["trace_id", "span_id"]).groupBy("trace_id").applyInPandas(_walk, "trace_id string, span_id string, depth long")
        depths = depths.unionByName(walked)
    at = depths.select(F.col("trace_id").alias("d_trace"), F.col("span_id").alias("d_span"), F.col("depth").alias("d"))
    out = spans.join(at, (F.col("trace_id") == F.col("d_trace")) & (F.col("parent_span_id") == F.col("d_span")), "left").join(first, F.col("trace_id") == F.col("f_trace"))
    own = at.select(F.col("d_trace").alias("e_trace"), F.col("d_span").alias("e_span"), F.col("d").alias("e"))
    out = out.join(own, (F.col("trace_id") == F.col("e_trace")) & (F.col("span_id") == F.col("e_span")), "left")
    # the span itself if it is the one its id stands for, else one below its parent
    return out.select(*spans.columns, (F.col("start_ns") - F.col("first_ns")).alias("start_offset_ns"), F.coalesce(F.when(F.col("parent_span_id").isNull(), 0), F.col("e"), F.col("d") + 1, F.lit(0)).cast("bigint").alias("depth"))


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Depths of spans that lead into a cycle of parents: the distinct spans met on the way up."""
    up = dict(zip(pdf.span_id, pdf.up))

    def depth(s: str) -> int:
        seen: set[str] = set()
        while s in up and s not in seen:
            seen.add(s)
            s = up[s]
        return len(seen)

    return pd.DataFrame({"trace_id": pdf.trace_id, "span_id": pdf.span_id, "depth": [depth(s) for s in pdf.span_id]})


def flame_layout(nodes: DataFrame, width: float, row_height: float) -> DataFrame:
    """trace_id, span_id, x, y, width, height: each trace scaled to the whole width."""
    end = nodes.groupBy(F.col("trace_id").alias("t")).agg(F.greatest(F.lit(0), F.max(F.col("start_offset_ns") + F.col("duration_ns"))).cast("double").alias("total"))
    flat = F.col("total") <= 0
    share = lambda c: F.col(c).cast("double") / F.when(~flat, F.col("total")) * F.lit(float(width))
    return nodes.join(end, F.col("trace_id") == F.col("t")).select(
        "trace_id", "seq", "span_id", F.when(flat, 0.0).otherwise(share("start_offset_ns")).alias("x"), (F.col("depth") * F.lit(float(row_height))).alias("y"),
        F.when(flat, F.lit(float(width))).otherwise(F.greatest(share("duration_ns"), F.lit(1.0))).alias("width"), F.lit(float(row_height)).alias("height"),
    )


def map_layout(nodes: DataFrame, width: float, height: float) -> DataFrame:
    """service_name, x, y: services in order on a circle from twelve o'clock on; a single one in the middle."""
    w = Window.orderBy("first_seq")
    # one row a service: few enough for one task
    placed = nodes.withColumns({"i": F.row_number().over(w) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})
    r = 0.4 * min(width, height)
    angle = F.col("i") / F.col("n") * F.lit(2 * math.pi) - F.lit(math.pi / 2)
    at = lambda mid, f: F.when(F.col("n") == 1, F.lit(mid)).otherwise(F.lit(mid) + F.lit(r) * f(angle))
    return placed.select("service_name", at(width / 2, F.cos).alias("x"), at(height / 2, F.sin).alias("y"))


def map_lines(edges: DataFrame, layout: DataFrame) -> DataFrame:
    """Edges with the places of both ends; an edge with an unknown end is left out."""
    a = layout.select(F.col("service_name").alias("from_service"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = layout.select(F.col("service_name").alias("to_service"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return edges.join(a, "from_service").join(b, "to_service")


def serialized(spans: DataFrame) -> DataFrame:
    """Nanosecond fields as decimal text."""
    return spans.withColumns({c: F.col(c).cast("string") for c in ("start_ns", "end_ns", "duration_ns", "start_offset_ns") if c in spans.columns})
