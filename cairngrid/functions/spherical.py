"""Spherical geometry and search-map features as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS = 6_371_008.8
STEP_DEG = 5.0


def round_half_up(c: Column, digits: int = 7) -> Column:
    """floor(x * 10^n + 1/2) / 10^n: ties go up also below zero."""
    k = 10.0**digits
    return F.floor(c * k + 0.5) / k


def destination(lat: Column, lng: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """(lat, lng) after ``metres`` along a bearing; the longitude stays in [-180, 180)."""
    a, p, t = metres / RADIUS, F.radians(lat), F.radians(bearing)
    lat2 = F.asin(F.sin(p) * F.cos(a) + F.cos(p) * F.sin(a) * F.cos(t))
    lng2 = F.radians(lng) + F.atan2(F.sin(t) * F.sin(a) * F.cos(p), F.cos(a) - F.sin(p) * F.sin(lat2))
    return F.degrees(lat2), (F.degrees(lng2) + 540) % 360 - 180


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def to_local(lat: Column, lng: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """Equirectangular metres (x, y) about an origin."""
    return F.radians(lng - lng0) * F.cos(F.radians(lat0)) * RADIUS, F.radians(lat - lat0) * RADIUS


def to_lnglat(x: Column, y: Column, lat0: Column, lng0: Column) -> tuple[Column, Column]:
    """(lat, lng) of local metres."""
    return lat0 + F.degrees(y / RADIUS), lng0 + F.degrees(x / (RADIUS * F.cos(F.radians(lat0))))


def _on_circle(lat: Column, lng: Column, metres: Column, start: Column, end: Column, places) -> Column:
    """Array of (lat, lng) at ``places(n)`` of the n steps of an arc: ``destination`` of each, with what all points share worked out once a row."""
    a, p = metres / RADIUS, F.radians(lat)
    fixed = {"sa": F.sin(a), "ca": F.cos(a), "sp": F.sin(p), "cp": F.cos(p), "g": F.radians(lng), "from": start, "turn": end - start, "n": F.greatest(F.lit(1), F.ceil((end - start) / STEP_DEG)).cast("int")}

    def along(c: Column) -> Column:
        def spot(i):
            t = F.radians(c["from"] + c["turn"] * i / c["n"])
            return F.struct(t.alias("t"), F.asin(c["sp"] * c["ca"] + c["cp"] * c["sa"] * F.cos(t)).alias("p"))

        def point(q):
            b = F.degrees(c["g"] + F.atan2(F.sin(q["t"]) * c["sa"] * c["cp"], c["ca"] - c["sp"] * F.sin(q["p"])))
            return F.struct(round_half_up(F.degrees(q["p"])).alias("lat"), round_half_up((b + 540) % 360 - 180).alias("lng"))

        return F.transform(F.transform(places(c["n"]), spot), point)

    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in fixed.items()])), along), F.lit(0))


def arc(lat: Column, lng: Column, metres: Column, start: Column, end: Column) -> Column:
    """Array of (lat, lng) along a circle, both ends included, in steps of 5 degrees at most."""
    return _on_circle(lat, lng, metres, start, end, lambda n: F.sequence(F.lit(0), n))


def _point(lat: Column, lng: Column) -> Column:
    return F.array(F.struct(round_half_up(lat).alias("lat"), round_half_up(lng).alias("lng")))


def ring_line(lat: Column, lng: Column, metres: Column) -> Column:
    """A closed circle of 73 points, the last equal to the first."""
    return _on_circle(lat, lng, metres, F.lit(0.0), F.lit(360.0), lambda n: F.concat(F.sequence(F.lit(0), n - 1), F.array(F.lit(0))))


def wedge_polygon(lat: Column, lng: Column, metres: Column, bearing: Column, angle: Column) -> Column:
    """Apex, arc and apex again."""
    apex = _point(lat, lng)
    return F.concat(apex, arc(lat, lng, metres, bearing - angle / 2, bearing + angle / 2), apex)


def sector_polygon(lat: Column, lng: Column, inner: Column, outer: Column, start: Column, end: Column) -> Column:
    """Outer arc, inner arc backwards (or the centre), and the first point again."""
    back = F.when(inner > 0, _on_circle(lat, lng, inner, start, end, lambda n: F.sequence(n, F.lit(0)))).otherwise(_point(lat, lng))
    return F.concat(arc(lat, lng, outer, start, end), back, _on_circle(lat, lng, outer, start, end, lambda n: F.array(F.lit(0))))


def sector_name(i: Column, sectors: int) -> Column:
    """Compass names for 8 and 4 sectors, else S1, S2, ..."""
    # Compass names clockwise from north.
    names = {8: ["N", "NE", "E", "SE", "S", "SW", "W", "NW"], 4: ["N", "E", "S", "W"]}.get(sectors)
    return F.get(F.array(*map(F.lit, names)), i.cast("int")) if names else F.concat(F.lit("S"), (i + 1).cast("string"))


def _nearest(v: Column, digits: int) -> Column:
    """``v`` to one or two decimals by its exact binary value, exact halves to the even digit, as C's printf rounds (Java rounds the shortest decimal up)."""
    unit = 10**digits
    n = F.floor(F.abs(v) * unit + 0.5)
    # the product may have been rounded up to a half: 2 * unit * v - (2 * n - 1) from multiples of v by powers of two, none of whose differences is rounded before the last
    past = F.abs(v) * {1: 16, 2: 128}[digits] - (2 * n - 1)
    for power in {1: (4,), 2: (64, 8)}[digits]:
        past = past + F.abs(v) * power
    n = F.when((past < 0) | ((past == 0) & (n % 2 == 1)), n - 1).otherwise(n)
    return F.when(F.abs(v) < 1e12, F.signum(v) * n / unit).otherwise(v)


def format_km(km: Column) -> Column:
    """Two decimals below 10 km, one from there on, without trailing zeros; rounded by the exact value, exact halves to even."""
    text = F.when(km < 10, F.format_string("%.2f", _nearest(km, 2))).otherwise(F.format_string("%.1f", _nearest(km, 1)))
    return F.regexp_replace(text, r"\.?0+$", "")


def merge_bands(bands: DataFrame, key: str) -> DataFrame:
    """(key, inner, outer): overlapping and touching bands joined, per key."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy("inner", "outer")
    far = F.max("outer").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = (F.coalesce(F.col("inner") > far, F.lit(True))).cast("int")
    rows = bands.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy(key, "run").agg(F.min("inner").alias("inner"), F.max("outer").alias("outer")).drop("run")


def bands_for(rings: DataFrame, key: str, chosen: list[int]) -> DataFrame:
    """(key, percent, inner, outer): the band between the ring before and each chosen ring; rings (key, percent, distance)."""
    from pyspark.sql import Window as W

    w = W.partitionBy(key).orderBy("percent")
    rows = rings.withColumn("inner", F.lag("distance", 1, 0.0).over(w))
    return rows.where(F.col("percent").isin(chosen)).select(key, "percent", "inner", F.col("distance").alias("outer"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out over all tasks by its keys, for steps that make many rows or long arrays of each row: a small file would be one task, whatever comes of it."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *keys)


def tiles_for(points: DataFrame, key: str, tile_lat: float, tile_lng: float, south: float, west: float, margin_m: float = 6000.0) -> DataFrame:
    """(key, tile) of all tiles i_j that meet the box of lat, lng and radius_m plus a margin."""
    points = spread(points, key)  # a row becomes as many tiles as its box has
    r = F.col("radius_m") + margin_m
    dlat = F.degrees(r / RADIUS)
    dlng = F.degrees(r / (RADIUS * F.cos(F.radians("lat"))))
    at = lambda v, o, s: F.floor((v - o) / s).cast("int")
    i = F.explode(F.sequence(at(F.col("lat") - dlat, south, tile_lat), at(F.col("lat") + dlat, south, tile_lat)))
    rows = points.select(key, "lng", dlng.alias("d"), i.alias("i")).select(key, "lng", "d", F.concat(F.col("i").cast("string"), F.lit("_")).alias("row"))
    j = F.explode(F.sequence(at(F.col("lng") - F.col("d"), west, tile_lng), at(F.col("lng") + F.col("d"), west, tile_lng)))
    return rows.select(key, "row", j.alias("j")).select(key, F.concat("row", F.col("j").cast("string")).alias("tile"))


def inside_coverage(lat: Column, lng: Column, regions: list[tuple[float, float, float, float]]) -> Column:
    """Whether a point lies in some region (south, west, north, east), borders included."""
    out = F.lit(False)
    for south, west, north, east in regions:
        out = out | (lat.between(south, north) & lng.between(west, east))
    return out


def format_latlng(lat: Column, lng: Column, digits: int = 5) -> Column:
    return F.format_string(f"%.{digits}f, %.{digits}f", lat, lng)
