"""Structured Streaming forms of the time-based operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def available(stream: DataFrame, cutoff: str | Column, column: str = "available_at") -> DataFrame:
    """Rows available at the cutoff, which itself counts: a stateless filter."""
    at = F.to_timestamp(F.lit(cutoff)) if isinstance(cutoff, str) else cutoff
    return stream.where(F.col(column) <= at)


def gap_sessions(points: DataFrame, time: str = "at", key: str = "track_id", gap_s: int = 120, late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n) of parts of tracks: points that follow within the gap belong together; single points are left out."""
    s = points.withWatermark(time, late).groupBy(key, F.session_window(time, f"{gap_s} seconds").alias("w")).agg(F.count("*").alias("n"), F.max(time).alias("end"))
    return s.where("n >= 2").select(key, F.col("w.start").alias("start"), "end", "n")


def new_uploads(tracks: DataFrame, fingerprint: list[str], time: str = "at", late: str = "1 day") -> DataFrame:
    """Uploads whose fingerprint was not seen within the watermark."""
    return tracks.withWatermark(time, late).dropDuplicatesWithinWatermark(fingerprint)


def commit_batches(stream: DataFrame, commit: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch with its number to ``commit``; a repeated number means a replay after a failure."""
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def clean_points(stream: DataFrame, max_speed: float) -> DataFrame:
    """The points (track_id, seq, x, y, t) of a stream that ``clean_tracks`` keeps: the state of a track is the point it kept last.

    A track's points must arrive in order from one micro-batch to the next; inside one they are sorted by ``seq``. The state survives a
    restart from the query's checkpoint.
    """
    schema = "track_id long, seq long, x double, y double, t long"

    def run(key, frames, state: GroupState):
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        keep = []
        for x, y, t in zip(rows["x"].tolist(), rows["y"].tolist(), rows["t"].tolist(), strict=True):
            dt = None if last is None else (t - last[2]) / 1000.0
            ok = last is None or dt > 0 and ((x - last[0]) ** 2 + (y - last[1]) ** 2) ** 0.5 / dt <= max_speed
            keep.append(ok)
            if ok:
                last = (x, y, t)
        state.update(last)
        yield rows[keep]

    points = stream.select(*[F.col(c).cast(t).alias(c) for c, t in (p.split() for p in schema.split(", "))])
    return points.groupBy("track_id").applyInPandasWithState(run, schema, "x double, y double, t long", "append", GroupStateTimeout.NoTimeout)


def request_outcomes(stream: DataFrame, keys: list[str], order: str, request: str, key_id: str = "event_id") -> DataFrame:
    """(key_id, outcome) of a stream of requests: new, replayed or a conflict, as ``first_responses`` tells of a table; the state of a key is its first request.

    Requests of a key are taken in the order of their micro-batches, inside one by ``order`` and then by ``key_id``.
    """
    rows = stream.select(F.col(key_id).cast("long").alias("id"), F.col(order).alias("at"), F.col(request).cast("string").alias("body"), F.concat_ws("\x1f", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("k"))

    def run(key, frames, state: GroupState):
        pdf = pd.concat(list(frames)).sort_values(["at", "id"], kind="stable")
        first = state.get if state.exists else None
        out = []
        for i, body in zip(pdf["id"].tolist(), pdf["body"].tolist(), strict=True):
            out.append((i, "new" if first is None else "replayed" if first[0] == body else "conflict"))
            first = first or (body,)
        state.update(first)
        yield pd.DataFrame(out, columns=[key_id, "outcome"])

    return rows.groupBy("k").applyInPandasWithState(run, f"{key_id} long, outcome string", "body string", "append", GroupStateTimeout.NoTimeout)
