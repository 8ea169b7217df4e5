"""Streams run over the stored events to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_plate
from ..sources import domain as d
from ..sources.files import replay
from ..streaming import live
from . import query
from .movement import CONSENSUS


def _events(spark, sf_dir):
    return replay(spark, "parquet", sf_dir, d.raw(spark, sf_dir, "events").schema, pattern="events.parquet")


def _stream(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.expr("concat('cam', lpad(cast((event_id * 7 + user_id) % 30 + 1 as string), 2, '0'))").alias("camera_id"), F.col("user_id").alias("track_id")
    )


@query(
    """with w as (select 'cam' || lpad(((event_id * 7 + user_id) % 30 + 1)::varchar, 2, '0') as camera_id, epoch_us(ts) // 3600000000 * 3600 as start_s from events)
    select camera_id, start_s, count(*) as n from w where (start_s + 3600) * 1000000 <= (select max(epoch_us(ts)) // 1000 * 1000 from events) - 600000000 group by all"""
)
def stream_window_counts(spark, sf_dir):
    return live.run_to_end(live.window_counts(_stream(spark, sf_dir)), "windows")


@query(
    """with e as (select 'cam' || lpad(((event_id * 7 + user_id) % 30 + 1)::varchar, 2, '0') as camera_id, user_id as track_id, epoch_us(ts) as us from events),
    g as (select *, coalesce(us - lag(us) over w >= 21600000000, true) as fresh from e window w as (partition by camera_id, track_id order by us)),
    v as (select *, sum(fresh::int) over (partition by camera_id, track_id order by us) as visit from g)
    select camera_id, track_id, min(us) as start_us, count(*) as n from v group by camera_id, track_id, visit having max(us) + 21600000000 <= (select max(epoch_us(ts)) // 1000 * 1000 from events) - 600000000"""
)
def stream_session_visits(spark, sf_dir):
    return live.run_to_end(live.visits(_stream(spark, sf_dir)), "visits")


@query(CONSENSUS, d.SIGHTINGS)
def stream_vote(spark, sf_dir):
    s = d.sightings_of(_events(spark, sf_dir)).where("plate_text is not null")
    reads = s.select("camera_id", "track_id", F.col("id").alias("seq"), clean_plate(F.col("plate_text")).alias("text"), F.coalesce("plate_conf", F.lit(0.5)).alias("conf"))
    return newest_verdicts(live.run_to_end(live.voted(reads), "votes"))


def newest_verdicts(votes):
    """A track's verdict is that of its newest read."""
    out = votes.groupBy("camera_id", "track_id").agg(F.max_by(F.struct("plate", "confidence", "voters"), "newest_seq").alias("v"))
    return out.select("camera_id", "track_id", "v.plate", F.round("v.confidence", 6).alias("confidence"), F.col("v.voters").cast("long").alias("voters"))
