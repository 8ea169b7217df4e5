"""Streams: alerts by micro-batch, windows, visits and plate votes in keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import matching
from ..params import CONFUSED, FOLDED, Match, Vote
from ..sources.storage import shared_path


STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(stream: DataFrame, tag: str, mode: str = "append", at: str | None = None, keyed: bool = False) -> DataFrame:
    """Runs a stream over all that is there now and returns what it has written. Rows, state and offsets are in the
    folder `at`: a later call with the same folder goes on where the last one stopped, with its state, and returns the
    rows of both. Without `at` a new folder of the shared one is taken. Streams of streaming.keyed need keyed=True,
    which keeps their state in RocksDB."""
    spark = stream.sparkSession
    root = at or shared_path(spark, tag)
    out, store = f"{root}/rows", spark.conf.get(STORE)
    if keyed:
        spark.conf.set(STORE, ROCKS)
    try:
        query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, store)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def window_counts(sightings: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per camera and tumbling window of event time `ts`; a window is given out once it is closed."""
    w = F.window("ts", width)
    return sightings.withWatermark("ts", late).groupBy(w, "camera_id").agg(F.count("*").alias("n")).select("camera_id", F.unix_seconds("window.start").alias("start_s"), "n")


def visits(sightings: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Runs of sightings of one track at one camera with no pause of `gap`."""
    w = F.session_window("ts", gap)
    out = sightings.withWatermark("ts", late).groupBy(w, "camera_id", "track_id").agg(F.count("*").alias("n"))
    return out.select("camera_id", "track_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def live_alerts(sightings: DataFrame, watchlist: Callable[[], DataFrame], path: str, params: Match = Match(), interval: str | None = "1 second"):
    """Starts a query that scores each micro-batch against the watchlist as it is then, and appends the alerts, reasons
    and all, to path/rows; its offsets are in path/state, so that a restart goes on. A batch that is tried again writes
    to the same place, so it counts once. Without an interval it ends with what is there now."""

    def score(batch: DataFrame, number: int) -> None:
        found = matching.alerts(batch, watchlist(), params)
        found.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/rows")

    when = {"processingTime": interval} if interval else {"availableNow": True}
    return sightings.writeStream.foreachBatch(score).option("checkpointLocation", f"{path}/state").trigger(**when).start()


FOLD = str.maketrans(CONFUSED, FOLDED)


def vote(reads: list[tuple[int, str, float]], min_voters: int) -> tuple[str, float, int]:
    """Plate, confidence and voters of one track's held reads (seq, text, conf) in order: the rules of
    operators.votes.consensus for the few reads that a state holds."""
    lengths: dict[int, list[tuple[int, str, float]]] = {}
    for read in reads:
        lengths.setdefault(len(read[1]), []).append(read)
    cohort = max(lengths.values(), key=lambda c: (len(c), sum(conf for *_, conf in c), -c[0][0]))
    if len(cohort) < min_voters:
        _, text, conf = max(reads, key=lambda r: (r[2], -r[0]))
        return text, conf, 1
    plate, share = "", 0.0
    for i in range(len(cohort[0][1])):
        groups: dict[str, list[tuple[float, int, str]]] = {}
        for seq, text, conf in cohort:
            groups.setdefault(text[i].translate(FOLD), []).append((conf, -seq, text[i]))
        weight = {ch: sum(g[0] for g in members) for ch, members in groups.items()}
        best = max(groups, key=lambda ch: (weight[ch], max(g[1] for g in groups[ch])))
        plate += max(groups[best])[2]
        share += weight[best] / total if (total := sum(weight.values())) > 0 else 0.0
    return plate, share / len(plate), len(cohort)


VOTES = "cameras array<string>, tracks array<long>, ats array<long>, counts array<int>, seqs array<long>, texts array<string>, confs array<double>"


def part_votes(batches: Iterator[pd.DataFrame], state: GroupState, params: Vote, idle_ms: int | None) -> Iterator[pd.DataFrame]:
    """The step of `voted` for one part."""
    now = state.getCurrentProcessingTimeMs() if idle_ms else 0
    held: dict[tuple, list] = {}
    seen: dict[tuple, int] = {}
    if state.exists:
        cameras, tracks, ats, counts, *kept = state.get
        reads = zip(*kept, strict=True)
        for camera, track, at, n in zip(cameras, tracks, ats, counts, strict=True):
            held[camera, track], seen[camera, track] = list(islice(reads, n)), at
    fresh = set()
    for b in batches:
        own = set()
        for camera, track, seq, text, conf in zip(b["camera_id"], b["track"], b["seq"], b["text"], b["conf"], strict=True):
            k = camera, None if track is None else int(track)
            own.add(k)
            if len(text) >= params.min_chars:
                held.setdefault(k, []).append((int(seq), text, float(conf)))
        for k in own & held.keys():
            held[k] = sorted(held[k])[-params.max_reads :]
        fresh |= own
    seen |= dict.fromkeys(fresh, now)
    if idle_ms:
        held = {k: v for k, v in held.items() if seen[k] + idle_ms > now}
    if held:
        every = [r for v in held.values() for r in v]
        state.update((*map(list, zip(*held, strict=True)), [seen[k] for k in held], [len(v) for v in held.values()], *map(list, zip(*every, strict=True))))
        if idle_ms:
            state.setTimeoutDuration(max(1, min(seen[k] for k in held) + idle_ms - now))
    elif state.exists:
        state.remove()
    told = [(*k, *vote(held[k], params.min_voters), len(held[k]), held[k][-1][0]) for k in fresh & held.keys()]
    if told:
        out = pd.DataFrame(told, columns=["camera_id", "track_id", "plate", "confidence", "voters", "reads", "newest_seq"])
        yield out.assign(track_id=pd.array([t[1] for t in told], dtype="Int64"))


def voted(reads: DataFrame, params: Vote = Vote(), idle_ms: int | None = None, parts: int = 1024) -> DataFrame:
    """Keyed state over reads (camera_id, track_id, seq, text, conf): of each camera and track the newest reads, and after
    each batch with reads of it their consensus: plate, confidence, voters, reads held and the newest seq. The row of the largest
    newest_seq is a track's verdict. With idle_ms, tracks that fall silent are dropped; a run to the end of what is
    there needs none. Tracks are many and have few reads each, so they are dealt into `parts`, which are the keys: a batch
    calls Python once for each part that it touches; a part's tracks and its reads of a batch are held meanwhile."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        yield from part_votes(batches, state, params, idle_ms)

    dealt = reads.select(
        F.pmod(F.xxhash64("camera_id", "track_id"), F.lit(parts)).alias("part"), "camera_id", F.col("track_id").cast("string").alias("track"), "seq", "text", "conf"
    )
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return dealt.groupBy("part").applyInPandasWithState(
        step, "camera_id string, track_id long, plate string, confidence double, voters int, reads int, newest_seq long", VOTES, "append", timeout
    )


def enriched(sightings: DataFrame, described: DataFrame, within: str = "1 hour", bound_s: float = 3.0, late: str = "10 minutes") -> DataFrame:
    """Sightings (id, camera_id, ts) with the description of each (id, made_ts) that arrives, by a join of two streams:
    id, camera_id, delay_s and whether it came later than bound_s after its sighting. None within `within` is dropped;
    what waits for its partner is in state until the watermarks pass that."""
    a = sightings.withWatermark("ts", late)
    b = described.withWatermark("made_ts", late).withColumnRenamed("id", "of")
    met = a.join(b, F.expr(f"of = id and made_ts >= ts and made_ts <= ts + interval {within}"))
    delay = (F.unix_micros("made_ts") - F.unix_micros("ts")) / 1_000_000
    return met.select("id", "camera_id", F.floor(delay).alias("delay_s"), (delay > bound_s).alias("late"))


def in_slices(rows: DataFrame, at: str, cuts: list, run: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What `run(stream, folder)` gives for rows that come in one after another: those before the first cut of the column
    `at`, then those before the next, and at last the rest. The stream is stopped and started again between slices."""
    spark = rows.sparkSession
    root, out = shared_path(spark, "slices"), None
    for lo, hi in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if lo is None else rows.where(F.col(at) >= F.lit(lo))
        part = part if hi is None else part.where(F.col(at) < F.lit(hi))
        part.write.mode("append").parquet(f"{root}/in")
        out = run(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), f"{root}/run")
    return out
