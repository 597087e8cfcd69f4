"""Step 9 queries: the streaming twin (rows come from the landed tables)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.gates import gate_image
from ..session import shared_path
from ..sources import fixtures as FX
from ..sources.tables import table
from ..streaming import author_state as ST
from . import twins as TW
from .catalog import register


def _deliveries(spark, df, ts_col, run_id):
    """The two deliveries of a stand-in landing folder: the rows up to the middle of the time
    span (and those without a time), then the rest."""
    bounds = df.agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi"))
    mid = bounds.select(F.col("lo") + (F.col("hi") - F.col("lo")) / 2).scalar()
    early = F.coalesce(F.col(ts_col) <= mid, F.lit(True))
    return shared_path(spark, "landing", run_id), [df.where(early), df.where(~early)]


@register("stream_scan", TW.with_ctes(TW.PACKAGES, TW.GATED, body="select package_id, gate from gated"))
def q_stream_scan(spark, sf):
    """Resumable scan of landed package files, started once per delivery, gated in
    the stream with a stream-static join to the type table."""
    run_id = uuid.uuid4().hex
    p = FX.packages(spark, sf)
    table_, checkpoint = ST.stream_table(spark, run_id)
    landing, deliveries = _deliveries(spark, p, "release_ts", run_id)
    for rows in deliveries:
        ST.land(rows, landing)
        src = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 3).parquet(landing)
        ST.run_batches(gate_image(src, FX.image_types(spark, sf)).select("package_id", "gate"), ST.scan_batches(table_), checkpoint)
    return table_.read("row").select("package_id", "gate")


@register("stream_author_context", """
select event_id, user_id, round(case when p1 is null then value when p2 is null then p1 else 0.6 * p1 + 0.4 * p2 end, 6) as ctx
from (select event_id, user_id, value, lag(value, 1) over w as p1, lag(value, 2) over w as p2 from events
      window w as (partition by user_id order by ts, event_id))""")
def q_stream_author_context(spark, sf):
    """Per-user context over ``array(value)`` with the state kept beside the output; equals
    the batch window over the same events."""
    run_id = uuid.uuid4().hex
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", F.array(F.col("value").cast("double")).alias("f"))
    table_, checkpoint = ST.stream_table(spark, run_id)
    landing, deliveries = _deliveries(spark, ev, "ts", run_id)
    for rows in deliveries:
        ST.land(rows, landing)
        src = spark.readStream.schema(ev.schema).parquet(landing)
        ST.run_batches(src, ST.context_batch(table_, "user_id", "event_id", "ts", "f"), checkpoint)
    return table_.read("row").select("event_id", "user_id", F.round(F.col("ctx")[0], 6).alias("ctx"))


@register("stream_sink", TW.with_ctes(TW.PACKAGES, TW.GATED, body="select package_id, gate from gated"))
def q_stream_sink(spark, sf):
    """One row per package although the first delivery comes twice and the query is
    restarted from its checkpoint in between."""
    run_id = uuid.uuid4().hex
    p = FX.packages(spark, sf)
    table_, checkpoint = ST.stream_table(spark, run_id)
    landing, (early, later) = _deliveries(spark, p, "release_ts", run_id)
    for rows in (early, later, early):
        ST.land(rows, landing)
        src = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 3).parquet(landing)
        out = gate_image(src, FX.image_types(spark, sf)).select("package_id", "gate")
        ST.run_batches(out, ST.new_ids_batch(table_, "package_id"), checkpoint)
    return table_.read("row").select("package_id", "gate")
