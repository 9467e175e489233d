"""Trail lines (line_id, seq, x, y) in local metres: clipping to bands, joining, splitting, corridors, cost surfaces."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.functions.spherical import spread
from cairngrid.operators.chains import chain_order
from cairngrid.operators.surface import checkpointed

EPS = 1e-9


def legs(lines: DataFrame, key: str = "line_id") -> DataFrame:
    w = W.partitionBy(key).orderBy("seq")
    rows = lines.withColumns({"x0": F.lag("x").over(w), "y0": F.lag("y").over(w)})
    return rows.where("x0 is not null").select(key, (F.col("seq") - 1).alias("leg"), "x0", "y0", F.col("x").alias("x1"), F.col("y").alias("y1"))


def clip_to_band(lines: DataFrame, inner: float, outer: float, key: str = "line_id") -> DataFrame:
    """(key, part, seq, x, y): the parts of lines inside a ring around the origin, cut where they cross its circles.

    A leg crosses each circle twice at most, so its cuts are an array of up to six places; pieces whose middle is inside
    stay, and neighbours join to parts.
    """
    e = legs(lines, key)
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    a, b = dx * dx + dy * dy, F.col("x0") * dx + F.col("y0") * dy

    def cuts(r: float):
        c = F.col("x0") * F.col("x0") + F.col("y0") * F.col("y0") - r * r
        root = b * b - a * c
        s = F.sqrt(F.greatest(root, F.lit(0.0)))
        return [F.when((root > 0) & (a > 0), F.try_divide(-b - s, a)), F.when((root > 0) & (a > 0), F.try_divide(-b + s, a))]

    inside = [F.when((t > 0) & (t < 1), t) for t in [*cuts(outer), *(cuts(inner) if inner > 0 else [])]]
    t = F.array_sort(F.array_distinct(F.array_compact(F.array(F.lit(0.0), *inside, F.lit(1.0)))))
    p = e.withColumn("t", t).select(key, "leg", "x0", "y0", "x1", "y1", "t", F.posexplode(F.slice("t", F.lit(1), F.size("t") - 1)).alias("k", "ta")).withColumn("tb", F.get("t", F.col("k") + 1))
    at = lambda t, p0, p1: F.col(p0) + (F.col(p1) - F.col(p0)) * t
    m = (F.col("ta") + F.col("tb")) / 2
    r = F.sqrt(at(m, "x0", "x1") * at(m, "x0", "x1") + at(m, "y0", "y1") * at(m, "y0", "y1"))
    pieces = p.withColumns({"in_": (r >= inner) & (r <= outer), "ax": at(F.col("ta"), "x0", "x1"), "ay": at(F.col("ta"), "y0", "y1"), "bx": at(F.col("tb"), "x0", "x1"), "by": at(F.col("tb"), "y0", "y1")})
    w = W.partitionBy(key).orderBy("leg", "k")
    new = (F.col("in_") & ~F.coalesce(F.lag("in_").over(w), F.lit(False))).cast("int")
    parts = pieces.withColumn("new", new).withColumn("part", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).where("in_")
    parts = parts.where(F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay"))) > EPS)
    v = W.partitionBy(key, "part").orderBy("leg", "k")
    first = parts.withColumn("n", F.row_number().over(v))
    start = first.where("n = 1").select(key, "part", F.lit(0).alias("seq"), F.col("ax").alias("x"), F.col("ay").alias("y"))
    return start.unionByName(first.select(key, "part", F.col("n").alias("seq"), F.col("bx").alias("x"), F.col("by").alias("y")))


def walk_lines(lines: DataFrame, start_ms: int, speed: float, gaps: list[tuple[float, float]] = (), step: float = 20.0, key: str = "line_id") -> DataFrame:
    """(key, seq, x, y, t): recorded walks along lines at constant speed, a point every ``step`` metres at most.

    Points whose way along the line lies inside a gap (metres from, to) are left out, as where a receiver was off. A point where two legs meet comes once.
    """
    w = W.partitionBy(key).orderBy("leg")
    e = legs(spread(lines, key), key).withColumn("len", F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))))
    e = e.withColumns({"from": F.coalesce(F.sum("len").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)), "n": F.greatest(F.lit(1), F.ceil(F.col("len") / step)).cast("int"), "first": F.row_number().over(w) == 1})
    way = lambda k: F.col("from") + k / F.col("n") * F.col("len")

    def on(k: Column) -> Column:
        out = F.lit(True)
        for a, b in gaps:
            out = out & ~((way(k) > a) & (way(k) < b))
        return out

    # points are numbered by their legs' counts, so that legs are sorted and not points
    e = e.withColumn("ks", F.filter(F.sequence(F.when(F.col("first"), 0).otherwise(1), F.col("n")), on) if gaps else F.sequence(F.when(F.col("first"), 0).otherwise(1), F.col("n")))
    e = e.withColumn("before", F.coalesce(F.sum(F.size("ks")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    p = e.select("*", F.posexplode("ks").alias("i", "k")).withColumn("f", F.col("k") / F.col("n"))
    place = lambda p0, p1: F.col(p0) + F.col("f") * (F.col(p1) - F.col(p0))
    return p.select(key, (F.col("before") + F.col("i") + 1).cast("long").alias("seq"), place("x0", "x1").alias("x"), place("y0", "y1").alias("y"), F.floor(start_ms + way(F.col("k")) * 1000 / speed + 0.5).alias("t"))


def split_evenly(lines: DataFrame, target: float, key: str = "line_id") -> DataFrame:
    """(key, piece, length, x0, y0, x1, y1): n = max(1, round(length / target)) pieces of equal length, with their ends."""
    w = W.partitionBy(key).orderBy("leg")
    e = legs(lines, key).withColumn("len", F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))))
    e = e.withColumns({"to": F.sum("len").over(w.rowsBetween(W.unboundedPreceding, 0)), "total": F.sum("len").over(W.partitionBy(key))}).withColumn("from", F.col("to") - F.col("len"))
    n = F.greatest(F.lit(1), F.floor(F.col("total") / target + 0.5)).cast("int")
    ends = e.groupBy(key).agg(F.max("total").alias("total")).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n")))).withColumn("d", F.col("total") * F.col("i") / F.col("n"))
    j = ends.join(e.drop("total"), key).where((F.col("len") > 0) & (F.col("d") >= F.col("from") - 1e-6) & (F.col("d") <= F.col("to") + 1e-6))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("d") - F.col("from")) / F.col("len")))
    spot = j.groupBy(key, "i").agg(F.min_by(F.struct((F.col("x0") + (F.col("x1") - F.col("x0")) * t).alias("x"), (F.col("y0") + (F.col("y1") - F.col("y0")) * t).alias("y"), (F.col("total") / F.col("n")).alias("length")), "leg").alias("p"))
    v = W.partitionBy(key).orderBy("i")
    return spot.withColumn("a", F.lag("p").over(v)).where("a is not null").select(key, F.col("i").alias("piece"), F.col("p.length").alias("length"), F.col("a.x").alias("x0"), F.col("a.y").alias("y0"), F.col("p.x").alias("x1"), F.col("p.y").alias("y1"))


def join_lines(lines: DataFrame, group: str, tolerance: float = 1.0, key: str = "line_id") -> DataFrame:
    """(group, joined, seq, x, y): lines of a group (a file) joined where exactly two ends meet, up to a loop; ``joined`` is the smallest line of each.

    A joined line runs the way its smallest line runs; a loop starts there. Where two lines meet, the point of the one nearer to the smallest line
    is kept. Each line is a node once in either direction and follows the line that it leads into; chains are ordered by pointer doubling,
    so a file or a joined line of any length is spread over tasks.
    """
    spot = lambda p: F.struct(F.floor(p["x"] / tolerance + 0.5).alias("u"), F.floor(p["y"] / tolerance + 0.5).alias("v"))
    at = F.struct("seq", "x", "y")
    ends = checkpointed(lines.groupBy(F.col(group).alias("g"), F.col(key).alias("line")).agg(F.min_by(at, "seq").alias("a"), F.max_by(at, "seq").alias("b"), F.count("*").alias("n")))
    tips = ends.select("g", "line", "n", F.explode(F.array(F.struct(F.lit(0).alias("end"), spot(F.col("a")).alias("spot")), F.struct(F.lit(1).alias("end"), spot(F.col("b")).alias("spot")))).alias("e")).select("g", "line", "n", "e.*")
    tip = F.struct("line", "end", "n")
    pairs = tips.groupBy("g", "spot").agg(F.count("*").alias("k"), F.min(tip).alias("p"), F.max(tip).alias("q")).where("k = 2 and p.line <> q.line")
    # a line is left through end 1 and entered through end 0 as it runs (way 0), the other way round when reversed (way 1)
    both = pairs.select("g", F.explode(F.array(F.struct(F.col("p").alias("from"), F.col("q").alias("to")), F.struct(F.col("q").alias("from"), F.col("p").alias("to")))).alias("m")).select("g", "m.*")
    node = lambda line, way: F.struct(F.col("g"), F.col(line).alias("line"), way.alias("way"))
    before = both.select(node("to.line", F.col("to.end")).alias("node"), node("from.line", 1 - F.col("from.end")).alias("prev"), (F.col("from.n") - 1).alias("step"))
    nodes = ends.select("g", "line", F.explode(F.array(F.lit(0), F.lit(1))).alias("way")).select(node("line", F.col("way")).alias("node"))
    order = checkpointed(chain_order(nodes.join(before, "node", "left")))
    # of a chain and its reverse the one counts that holds its smallest line as it runs
    first = order.groupBy("head").agg(F.min_by(F.struct("node", "far"), "node").alias("s")).where("s.node.way = 0")
    placed = order.join(first, "head").select(F.col("node.g").alias(group), F.col("node.line").alias(key), F.col("node.way").alias("way"), "far", F.col("s.node.line").alias("joined"), F.col("s.far").alias("start"))
    p = lines.join(placed, [group, key]).join(ends.select(F.col("g").alias(group), F.col("line").alias(key), "n", F.col("a.seq").alias("lo"), F.col("b.seq").alias("hi")), [group, key])
    k = F.when(F.col("way") == 0, F.row_number().over(W.partitionBy(group, key).orderBy("seq")) - 1).otherwise(F.row_number().over(W.partitionBy(group, key).orderBy(F.desc("seq"))) - 1)
    p = p.withColumn("k", k)
    kept = (F.col("far") == F.col("start")) | ((F.col("far") > F.col("start")) & (F.col("k") > 0)) | ((F.col("far") < F.col("start")) & (F.col("k") < F.col("n") - 1))
    return p.where(kept).select(group, "joined", (F.col("far") + F.col("k")).cast("long").alias("seq"), "x", "y")


def corridor_cells(cells: DataFrame, lines: DataFrame, half_width: float, key: str = "line_id") -> DataFrame:
    """(key, cell_id): cells whose centre lies within ``half_width`` of a line: exact membership of its rounded buffer.

    Legs reach cells through the coarse squares they may touch, so no cell meets every leg.
    """
    side = max(half_width * 2, 1.0) * 4
    e = legs(lines, key)
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - half_width) / side), F.floor((F.greatest(a, b) + half_width) / side))
    e = e.withColumn("sx", F.explode(span("x0", "x1"))).withColumn("sy", F.explode(span("y0", "y1")))
    c = cells.select("cell_id", "cx", "cy", F.floor(F.col("cx") / side).alias("sx"), F.floor(F.col("cy") / side).alias("sy"))
    from cairngrid.functions.geometry import segment_distance

    d = segment_distance(F.col("cx"), F.col("cy"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return c.join(e, ["sx", "sy"]).where(d <= half_width).select(key, "cell_id").distinct()


def _relax(mult: np.ndarray, cost: np.ndarray, own: np.ndarray, seeds: list[int], cell_size: float, width: int) -> None:
    """Lower ``cost`` of the cells ``own`` of a window (its rows of ``width`` cells one after the other), starting from the cells ``seeds``."""
    steps = [(a * width + b, cell_size * (math.sqrt(2) if a and b else 1.0)) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    m, best, free = mult.tolist(), cost.tolist(), (own & (mult >= 0) & (mult < np.inf)).tolist()
    heap = [(best[i], i) for i in seeds]
    heapq.heapify(heap)
    while heap:
        d, i = heapq.heappop(heap)
        if d > best[i]:
            continue
        for step, length in steps:
            k = i + step
            if 0 <= k < len(m) and free[k]:
                v = d + length * (m[i] + m[k]) / 2
                if v < best[k]:
                    best[k] = v
                    heapq.heappush(heap, (v, k))
    cost[:] = best


def cost_distance(cells: DataFrame, start: DataFrame, cols: int, cell_size: float, by: str = "grid_id", tile: int = 512) -> DataFrame:
    """(by, cell_id, cost) from start cells over cells (by, cell_id, mult): 8 neighbours, a step costs its length times the mean multiplier.

    A negative, null or infinite multiplier cannot be entered; from a start of infinite cost, or without one, nothing is reached. A grid is cut into
    tiles of ``tile`` cells a side, one row each; where the grid is narrower, a tile is as wide as the grid and holds as many cells, so a long strip takes few rounds. A tile that hears of lower costs at its edge settles its own cells with a queue and
    tells its neighbours which of its edge cells became cheaper, until nobody has news; only tiles with news are worked on.
    """
    keys = [by, "ty", "tx"]
    row, col = F.floor(F.col("cell_id") / cols), F.col("cell_id") % cols
    across = min(tile, cols)
    down = tile * tile // across
    place = {"ty": F.floor(row / down).cast("int"), "tx": F.floor(col / across).cast("int")}
    whole = cells.select(by, F.col("cell_id").cast("long").alias("cell_id"), F.col("mult").cast("double").alias("mult")).withColumns(place)
    each = F.array_sort(F.collect_list(F.struct("cell_id", "mult")))
    state = whole.groupBy(*keys).agg(each.alias("c")).select(*keys, F.col("c.cell_id").alias("ids"), F.col("c.mult").alias("mult"), F.transform("c", lambda x: F.lit(float("inf"))).alias("cost"), F.lit(None).cast("array<struct<cell_id:bigint,mult:double,cost:double>>").alias("news"))
    state = checkpointed(state)
    last = state.groupBy(F.col(by).alias("g_")).agg(F.max(F.array_max("ids")).alias("last"))
    asked = start.toDF(*start.columns).select(*[F.expr(f"coalesce({c}, {c})").alias(c) for c in (by, "cell_id")]).join(last, F.col(by) == F.col("g_"), "left")  # may stem from ``cells``
    inside = F.when(F.col("last").isNull() | (F.col("cell_id") < 0) | (F.col("cell_id") > F.col("last")), F.raise_error(F.lit("a start lies outside the grid")).cast("bigint")).otherwise(F.col("cell_id").cast("long"))
    first = asked.select(by, inside.alias("cell_id"), F.lit(None).cast("double").alias("mult"), F.lit(0.0).alias("cost")).withColumns(place)
    heard = lambda rows: rows.groupBy(*keys).agg(F.collect_list(F.struct("cell_id", "mult", "cost")).alias("heard"))
    schema = state.schema

    def settle(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                ids, said = np.asarray(r.ids, np.int64), np.array([h["cell_id"] for h in r.heard], np.int64)
                ty, tx, width = int(r.ty), int(r.tx), across + 2
                height = int(max(ids.max(), said.max()) // cols) - ty * down + 3
                spot = lambda ids, ty=ty, tx=tx, width=width: (ids // cols - ty * down + 1) * width + ids % cols - tx * across + 1
                mult, cost, own = np.full(height * width, np.nan), np.full(height * width, np.inf), np.zeros(height * width, bool)
                mine = spot(ids)
                mult[mine], cost[mine], own[mine] = np.array(r.mult, float), np.asarray(r.cost, float), True
                told = spot(said)
                value, around = np.array([h["cost"] for h in r.heard], float), np.array([h["mult"] for h in r.heard], float)
                beside = ~own[told] & ~np.isnan(around)
                mult[told[beside]] = around[beside]
                ok = mult[told] < np.inf
                before = cost[mine]
                np.minimum.at(cost, told[ok], value[ok])
                _relax(mult, cost, own, np.unique(told[ok]).tolist(), cell_size, width)
                y, x = ids // cols - ty * down, ids % cols - tx * across
                edge = (cost[mine] < before) & ((y == 0) | (y == down - 1) | (x == 0) & (tx > 0) | (x == across - 1) & ((tx + 1) * across < cols))
                news = [{"cell_id": int(i), "mult": float(m), "cost": float(c)} for i, m, c in zip(ids[edge], mult[mine][edge], cost[mine][edge], strict=True)]
                out.append((r[0], ty, tx, r.ids, r.mult, cost[mine], news))
            yield pd.DataFrame(out, columns=schema.names)

    messages = heard(first)
    while True:
        worked = state.join(messages, keys).select(*state.columns, "heard").mapInPandas(settle, schema)
        state = checkpointed(state.join(messages, keys, "left_anti").withColumn("news", F.lit(None).cast(schema["news"].dataType)).unionByName(worked))
        said = state.where(F.size("news") > 0).select(*keys, F.explode("news").alias("n")).select(F.col(by), F.col("ty").alias("y0"), F.col("tx").alias("x0"), "n.*")
        around = F.array_distinct(F.array(*[F.struct(F.floor((row + a) / down).cast("int").alias("ty"), F.floor((col + b) / across).cast("int").alias("tx")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
        sent = said.withColumn("t", F.explode(around)).select(by, "cell_id", "mult", "cost", "t.*", "y0", "x0").where("ty <> y0 or tx <> x0").drop("y0", "x0")
        if sent.isEmpty():
            break
        messages = heard(sent)
    return state.select(by, F.explode(F.arrays_zip("ids", "cost")).alias("c")).select(by, F.col("c.ids").alias("cell_id"), F.col("c.cost").alias("cost"))
