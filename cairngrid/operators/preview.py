"""Compositions: what a search would change, and corridors along trails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.functions import spherical as sph
from cairngrid.functions.geometry import Grid
from cairngrid.operators import outlines, pod, tracks, trails, updates
from cairngrid.operators.surface import running_before


def walked_legs(points: DataFrame, max_speed: float, max_gap_s: float) -> DataFrame:
    """(track_id, ax, ay, bx, by): legs of the cleaned tracks; no leg crosses a gap."""
    parts = tracks.split_at_gaps(tracks.clean_tracks(points, max_speed), max_gap_s)
    w = W.partitionBy("track_id", "part").orderBy("seq")
    rows = parts.withColumns({"ax": F.lag("x").over(w), "ay": F.lag("y").over(w)}).where("ax is not null")
    return rows.select("track_id", "ax", "ay", F.col("x").alias("bx"), F.col("y").alias("by"))


def search_preview(prior: DataFrame, cells: DataFrame, points: DataFrame, grid: Grid, outline: list[tuple[float, float]], sweep_width: float, clip_buffer: float = 0.0, max_speed: float = tracks.MAX_SPEED, max_gap_s: float = tracks.MAX_GAP_S) -> DataFrame:
    """(cell_id, coverage, pod, prior, posterior, outside, z) of an unsuccessful search along recorded tracks.

    Tracks are cleaned and split at gaps, their legs counted per cell, coverage turned into detection inside the assignment's outline
    (and within ``clip_buffer`` of it), and the prior updated by what was not found.
    """
    done = pod.achieved_pod(cells, walked_legs(points, max_speed, max_gap_s), grid, outline, sweep_width, clip_buffer)
    # exp(-coverage) is 1 - pod, which itself rounds to 0 where coverage is large
    missed = prior.select("cell_id").join(done.select("cell_id", "coverage"), "cell_id", "left").select("cell_id", F.exp(-F.coalesce("coverage", F.lit(0.0))).alias("lr"))
    after = updates.apply_likelihood(prior, missed).select("cell_id", F.col("p").alias("posterior"), "outside", "z")
    before = prior.select("cell_id", F.col("p").alias("prior"))
    return done.select("cell_id", "coverage", "pod").join(before, "cell_id").join(after, "cell_id")


def trail_corridors(cells: DataFrame, lines: DataFrame, bands: list[tuple[float, float]], piece_length: float, half_width: float, key: str = "line_id") -> tuple[DataFrame, DataFrame]:
    """(name, key, band, part, piece, length, ends) and (name, cell_id): corridors along trails in rings around the origin.

    Overlapping bands are merged, lines are clipped to each, every part is split into equal pieces of about ``piece_length`` metres,
    and a corridor holds the cells within ``half_width`` (5 to 1000 m) of its piece. Names are T-1, T-2, ... by line, band, part and piece.
    """
    if not 5 <= half_width <= 1000:
        raise ValueError("the half width must be 5 to 1000 m")
    named, parts = _pieces(lines, bands, piece_length, key)
    walked = _piece_lines(parts, named, key)
    return named, trails.corridor_cells(cells, walked, half_width, "name")


def trail_segments(lines: DataFrame, bands: list[tuple[float, float]], piece_length: float, half_width: float, group: str, key: str = "line_id", tolerance: float = 1.0) -> DataFrame:
    """(name, key, band, part, piece, length, rings): the corridors of trails as outlines, outer ring first, for a search map.

    Trails of a ``group`` (a file) that meet end to end are joined first, within ``tolerance``; ``key`` is then the smallest line of each.
    """
    if not 5 <= half_width <= 1000:
        raise ValueError("the half width must be 5 to 1000 m")
    if not 100 <= piece_length <= 20_000:
        raise ValueError("the piece length must be 100 m to 20 km")
    joined = trails.join_lines(lines, group, tolerance, key).select(F.struct(group, F.col("joined").alias("line")).alias(key), "seq", "x", "y")
    named, parts = _pieces(joined, bands, piece_length, key)
    outlines_ = outlines.corridor_outlines(_piece_lines(parts, named, key), half_width, "name")
    rings = outlines_.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("rings"))
    return named.join(rings, "name").select("name", F.col(f"{key}.{group}").alias(group), F.col(f"{key}.line").alias(key), "band", "part", "piece", "length", "rings")


def _pieces(lines: DataFrame, bands: list[tuple[float, float]], piece_length: float, key: str) -> tuple[DataFrame, DataFrame]:
    """(named pieces with their ends, parts of the lines inside the merged bands)."""
    spark = lines.sparkSession
    merged = sph.merge_bands(spark.createDataFrame([("b", float(i), float(o)) for i, o in bands], "key string, inner double, outer double"), "key").orderBy("inner").collect()  # as many rows as bands were asked for
    parts = None
    for b, m in enumerate(merged):
        one = trails.clip_to_band(lines, m["inner"], m["outer"], key).withColumn("band", F.lit(b))
        parts = one if parts is None else parts.unionByName(one)
    place = F.struct(F.col(key), "band", "part")
    pieces = trails.split_evenly(parts.select(place.alias("place"), "seq", "x", "y"), piece_length, "place")
    numbered = running_before(pieces.withColumn("one", F.lit(1)), [], [F.col("place"), F.col("piece")], "one", "before")
    named = numbered.select(F.concat(F.lit("T-"), (F.col("before") + 1).cast("string")).alias("name"), F.col(f"place.{key}").alias(key), "place.band", "place.part", "piece", "length", "x0", "y0", "x1", "y1")
    return named, parts


def _piece_lines(parts: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """(name, seq, x, y): each piece as a line, its part's vertices between its two ends."""
    w = W.partitionBy(key, "band", "part").orderBy("seq")
    v = parts.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    step = F.coalesce(F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))), F.lit(0.0))
    v = v.withColumn("at", F.sum(step).over(w.rowsBetween(W.unboundedPreceding, 0))).select(key, "band", "part", F.col("x").alias("vx"), F.col("y").alias("vy"), "at")
    lo, hi = (F.col("piece") - 1) * F.col("length"), F.col("piece") * F.col("length")
    inner = named.join(v, [key, "band", "part"]).where((F.col("at") > lo + 1e-9) & (F.col("at") < hi - 1e-9)).select("name", "at", F.col("vx").alias("x"), F.col("vy").alias("y"))
    ends = named.select("name", F.explode(F.array(F.struct(lo.alias("at"), F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(hi.alias("at"), F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("e")).select("name", "e.*")
    return inner.unionByName(ends).withColumn("seq", F.row_number().over(W.partitionBy("name").orderBy("at")).cast("int")).drop("at")
