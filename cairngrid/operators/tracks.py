"""Tracks: points (track_id, seq, x, y, t) with t in epoch milliseconds; the order is that of seq."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.operators.surface import checkpointed

MAX_GAP_S = 120.0
MAX_SPEED = 4.0
STATIONARY_SPEED = 0.15
VEHICLE_SPEED = 3.0
AIRCRAFT_SPEED = 10.0
MIN_RUN_S = 60.0


def _steps(points: DataFrame) -> DataFrame:
    w = W.partitionBy("track_id").orderBy("seq")
    before = points.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w), "pt": F.lag("t").over(w), "i": F.row_number().over(w) - 1})
    dx, dy = F.col("x") - F.col("px"), F.col("y") - F.col("py")
    return before.withColumns({"dt": (F.col("t") - F.col("pt")) / 1000.0, "d": F.sqrt(dx * dx + dy * dy)})


def assess_tracks(points: DataFrame, max_gap_s: float = MAX_GAP_S, max_speed: float = MAX_SPEED) -> DataFrame:
    """One row per track: n, ordered, length_m, duration_s, n_gaps, gaps, n_jumps, jumps, quality, fingerprint.

    Every point is held against the one before it, kept or not: no forward time is unordered, more than the gap a gap, faster
    than the speed an impossible jump; jumps count in the length.
    """
    s = _steps(points)
    gap, jump = F.col("dt") > max_gap_s, (F.col("dt") > 0) & (F.try_divide("d", "dt") > max_speed)
    line = F.concat_ws(",", F.col("x").cast("string"), F.col("y").cast("string"), F.col("t").cast("string"))
    agg = s.groupBy("track_id").agg(
        F.count("*").alias("n"),
        F.min(F.coalesce(F.col("dt") > 0, F.lit(True))).alias("ordered"),
        F.coalesce(F.sum("d"), F.lit(0.0)).alias("length_m"),
        ((F.max_by("t", "seq") - F.min_by("t", "seq")) / 1000.0).alias("duration_s"),
        F.array_sort(F.collect_list(F.when(gap, F.struct((F.col("i") - 1).alias("from_index"), F.col("dt").alias("seconds"))))).alias("gaps"),
        F.array_sort(F.collect_list(F.when(jump, F.col("i")))).alias("jumps"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("v")))), lambda r: r["v"]), ";"), 256).alias("fingerprint"),
    )
    quality = F.when((F.size("jumps") > 0) | ~F.col("ordered"), "suspect").when(F.size("gaps") > 0, "gappy").otherwise("good")
    return agg.withColumns({"n_gaps": F.size("gaps"), "n_jumps": F.size("jumps"), "quality": quality})


def clean_tracks(points: DataFrame, max_speed: float = MAX_SPEED) -> DataFrame:
    """Points that follow the last kept point forward in time and not too fast.

    The comparison is with the last *kept* point, so it runs in order; a track of any length is still spread over tasks. Points are dealt out in ranges of
    track and order and every range is walked at once, as if the track that goes on in it began there. Then each range is told the point kept
    last before it (one per range on the driver), and those that had assumed another are walked again, until none has; a few points
    after a boundary both walks keep the same ones, so this mostly takes one more round over few rows.
    """
    names = ["track_id", "seq", "x", "y", "t"]
    rows = points.select(*names)
    ranges = checkpointed(rows.repartitionByRange("track_id", "seq").sortWithinPartitions("track_id", "seq").withColumn("range_", F.spark_partition_id()))
    schema = ranges.withColumn("kept", F.lit(True)).schema

    def walk(before: dict[int, tuple]):
        def run(frames):
            track, last = None, None
            for k, pdf in enumerate(f for f in frames if len(f)):
                ids, keep = pdf["track_id"].tolist(), []
                if not k and (told := before.get(int(pdf["range_"].iloc[0]))):
                    track, last = told[0], told[1:]
                for i, x, y, t in zip(ids, pdf["x"].tolist(), pdf["y"].tolist(), pdf["t"].tolist(), strict=True):
                    if i != track:
                        track, last = i, None
                    dt = None if last is None else (t - last[2]) / 1000.0
                    ok = last is None or dt > 0 and ((x - last[0]) ** 2 + (y - last[1]) ** 2) ** 0.5 / dt <= max_speed
                    keep.append(ok)
                    if ok:
                        last = (x, y, t)
                pdf["kept"] = keep
                yield pdf

        return run

    done, assumed = checkpointed(ranges.mapInPandas(walk({}), schema)), {}
    while True:
        place = F.struct("track_id", "seq")
        kept = F.when(F.col("kept"), F.struct("track_id", "x", "y", "t"))
        ends = done.groupBy("range_").agg(F.min("track_id").alias("first"), F.max("track_id").alias("last"), F.max_by(kept, F.when(F.col("kept"), place)).alias("p")).orderBy("range_").collect()  # one row per range
        before, carried = {}, None
        for r in ends:
            if carried and carried[0] == r["first"]:
                before[r["range_"]] = carried
            own = tuple(r["p"]) if r["p"] else None
            # where nothing of the last track is kept, the point from before still counts
            carried = own if own and own[0] == r["last"] else carried if carried and carried[0] == r["last"] else None
        wrong = [r for r in {*before, *assumed} if before.get(r) != assumed.get(r)]
        if not wrong:
            return done.where("kept").select(*names)
        again = ranges.where(F.col("range_").isin(wrong)).mapInPandas(walk(before), schema)
        done, assumed = checkpointed(done.where(~F.col("range_").isin(wrong)).unionByName(again)), before


def split_at_gaps(points: DataFrame, max_gap_s: float = MAX_GAP_S) -> DataFrame:
    """Points with ``part``, which begins anew after more than the gap; parts of a single point are left out."""
    w = W.partitionBy("track_id").orderBy("seq")
    flagged = _steps(points).withColumn("new", (F.coalesce("dt", F.lit(0.0)) > max_gap_s).cast("int")).withColumn("part", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    n = F.count("*").over(W.partitionBy("track_id", "part"))
    return flagged.withColumn("n_", n).where("n_ >= 2").select("track_id", "part", "seq", "x", "y", "t")


def classify(points: DataFrame, half_window_ms: int = 30_000, stretch_ms: int = 3_600_000) -> DataFrame:
    """Points with ``speed`` between the first and last point within the half window, and ``kind``.

    A track is cut into stretches of time that also see the points up to a half window beyond their ends, so a long one is spread over tasks.
    """
    size = max(stretch_ms, 4 * half_window_ms)  # so that most points are seen once
    at = lambda shift: F.floor((F.col("t") + shift) / size)
    seen = points.withColumns({"own_": at(0), "stretch_": F.explode(F.sequence(at(-half_window_ms), at(half_window_ms)))})
    w = W.partitionBy("track_id", "stretch_").orderBy("t").rangeBetween(-half_window_ms, half_window_ms)
    p = F.struct("x", "y", "t")
    s = seen.withColumns({"a": F.min_by(p, F.struct("t", "seq")).over(w), "b": F.max_by(p, F.struct("t", "seq")).over(w)}).where("own_ = stretch_")
    dx, dy, dt = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"), (F.col("b.t") - F.col("a.t")) / 1000.0
    s = s.withColumn("speed", F.coalesce(F.try_divide(F.sqrt(dx * dx + dy * dy), dt), F.lit(0.0)))
    kind = F.when(F.col("speed") < STATIONARY_SPEED, "stationary").when(F.col("speed") > VEHICLE_SPEED, "vehicle").otherwise("foot")
    return s.withColumn("kind", kind).drop("a", "b", "own_", "stretch_")


def _runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Neighbouring rows (track_id, kind, from_seq, to_seq, t0, t1, n) of one kind as one row, per ``by``."""
    w = W.partitionBy(*by).orderBy("from_seq")
    new = (~F.col("kind").eqNullSafe(F.lag("kind").over(w))).cast("int")
    numbered = rows.withColumn("new_", new).withColumn("run_", F.sum("new_").over(w.rowsBetween(W.unboundedPreceding, 0)))
    ends = [F.min("from_seq").alias("from_seq"), F.max("to_seq").alias("to_seq"), F.min_by("t0", "from_seq").alias("t0"), F.max_by("t1", "to_seq").alias("t1"), F.sum("n").alias("n")]
    return numbered.groupBy(*by, "run_").agg(F.first("kind").alias("kind"), *ends).drop("run_")


def segment_tracks(points: DataFrame, min_run_s: float = MIN_RUN_S, half_window_ms: int = 30_000) -> DataFrame:
    """(track_id, segment, kind, from_seq, to_seq, n, seconds) of runs of movement.

    Runs of one kind are formed; a short run that is not on foot becomes foot; then a short run on foot between two others takes the kind
    before it (its neighbours are not on foot, so no such change depends on another); neighbours of one kind merge; a segment has two points at least. A run
    lasts until the next one's first point. Points are put into runs within ranges of their track; only runs meet by track.
    """
    rows = classify(points, half_window_ms).select("track_id", F.col("seq").cast("long").alias("from_seq"), F.col("seq").cast("long").alias("to_seq"), F.col("t").alias("t0"), F.col("t").alias("t1"), "kind", F.lit(1).alias("n"))
    ranges = checkpointed(rows.repartitionByRange("track_id", "from_seq").withColumn("range_", F.spark_partition_id()))
    w = W.partitionBy("track_id").orderBy("from_seq")
    seconds = (F.coalesce(F.lead("t0").over(w), "t1") - F.col("t0")) / 1000.0
    runs = _runs(_runs(ranges, ["track_id", "range_"]), ["track_id"]).withColumn("s", seconds)
    short = F.col("s") < min_run_s
    runs = _runs(runs.withColumn("kind", F.when(short, "foot").otherwise(F.col("kind"))), ["track_id"]).withColumns({"s": seconds, "before": F.lag("kind").over(w), "after": F.lead("kind").over(w)})
    between = (F.col("kind") == "foot") & short & F.col("before").isNotNull() & F.col("after").isNotNull()
    runs = _runs(runs.withColumn("kind", F.when(between, F.col("before")).otherwise(F.col("kind"))), ["track_id"]).withColumn("seconds", seconds).where("n >= 2")
    return runs.select(F.col("track_id").cast("long").alias("track_id"), (F.row_number().over(w) - 1).cast("int").alias("segment"), "kind", "from_seq", "to_seq", F.col("n").cast("int").alias("n"), "seconds")


def track_reports(points: DataFrame, max_gap_s: float = MAX_GAP_S, max_speed: float = MAX_SPEED, min_run_s: float = MIN_RUN_S) -> DataFrame:
    """One row per track: the assessment of what was recorded, median speed and aircraft flag of the cleaned points, and their segments in order."""
    clean = checkpointed(clean_tracks(points, max_speed))
    parts = segment_tracks(clean, min_run_s).groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("segment", "kind", "from_seq", "to_seq", "n", "seconds"))).alias("segments"))
    report = assess_tracks(points, max_gap_s, max_speed).join(median_speed(clean), "track_id", "left").join(parts, "track_id", "left")
    return report.withColumn("segments", F.coalesce("segments", F.array().cast(parts.schema["segments"].dataType)))


def median_speed(points: DataFrame) -> DataFrame:
    """(track_id, median_speed, aircraft): upper median of the speeds with forward time; 0 without any."""
    s = _steps(points).withColumn("v", F.when(F.col("dt") > 0, F.col("d") / F.col("dt")))
    agg = s.groupBy("track_id").agg(F.sort_array(F.collect_list("v")).alias("v"))
    m = F.coalesce(F.get("v", F.floor(F.size("v") / 2).cast("int")), F.lit(0.0))
    return agg.select("track_id", m.alias("median_speed"), (m > AIRCRAFT_SPEED).alias("aircraft"))
