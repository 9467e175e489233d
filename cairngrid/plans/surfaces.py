"""Catalogue: surfaces, priors, updates, detection and evaluation on the part raster."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairngrid.functions import geometry as geo
from cairngrid.functions.spherical import spread
from cairngrid.operators import evaluation, pod, priors, surface, updates
from cairngrid.plans.base import CELL, CELLS, cells, grid, literal, query, rounded, table

POINT = (2520.0, 1980.0)
RINGS = [(0.0, 500.0, 0.25), (500.0, 1000.0, 0.25), (1000.0, 1600.0, 0.25), (1600.0, 2500.0, 0.2), (2500.0, 4000.0, 0.05)]
ROUTE = [(300.0, 200.0), (2600.0, 1900.0), (4700.0, 700.0)]
POLYGON = [(510.0, 420.0), (3010.0, 380.0), (3640.0, 2210.0), (1980.0, 1240.0), (760.0, 2790.0)]
WALK = [(120.0, 90.0), (4710.0, 1830.0), (830.0, 2240.0), (3320.0, 610.0)]
AREA = CELL * CELL


def _n(v: float) -> str:
    return f"({float(v)!r}e0)" if "e" not in repr(float(v)) else f"({float(v)!r})"


def _seg(a, b) -> str:
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = f"greatest(0e0, least(1e0, ((cx-{_n(a[0])})*{_n(dx)} + (cy-{_n(a[1])})*{_n(dy)}) / {_n(dx * dx + dy * dy)}))"
    x, y = f"(cx - ({_n(a[0])} + {t}*{_n(dx)}))", f"(cy - ({_n(a[1])} + {t}*{_n(dy)}))"
    return f"sqrt({x}*{x} + {y}*{y})"


def _line_sql(line) -> str:
    parts = [_seg(a, b) for a, b in zip(line, line[1:], strict=False)]
    return parts[0] if len(parts) == 1 else f"least({', '.join(parts)})"


def _inside_sql(poly) -> str:
    parts = [f"CASE WHEN ({_n(a[1])} > cy) <> ({_n(b[1])} > cy) AND cx < {_n(b[0] - a[0])}*(cy-{_n(a[1])})/{_n(b[1] - a[1])}+{_n(a[0])} THEN 1 ELSE 0 END" for a, b in zip(poly, poly[1:] + poly[:1], strict=True)]
    return f"(({' + '.join(parts)}) % 2 = 1)"


def _ring_case(d: str = "d") -> str:
    return "CASE " + " ".join(f"WHEN {d} < {_n(o)} THEN {k}" for k, (_, o, _) in enumerate(RINGS)) + " END"


RING_ROWS = ", ".join(f"({k}, {_n(p)}, pi()*{_n(o * o - i * i)})" for k, (i, o, p) in enumerate(RINGS))


def _ring_sql(offsets: str) -> str:
    """Ring prior as common table expressions ending in ``ring(cell_id, p, outside)``; offsets(off, ox, oy, w)."""
    return f"""{CELLS}, offs AS ({offsets}), rt(ring, prob, annulus) AS (VALUES {RING_ROWS}),
placed AS (SELECT cell_id, ok, off, w, {_ring_case("sqrt((cx-ox)*(cx-ox)+(cy-oy)*(cy-oy))")} AS ring FROM cells CROSS JOIN offs),
cnt AS (SELECT off, placed.ring, max(prob) AS prob, max(annulus) AS annulus, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS nv, sum(CASE WHEN ok THEN 0 ELSE 1 END) AS nm FROM placed JOIN rt ON placed.ring = rt.ring GROUP BY off, placed.ring),
sh AS (SELECT off, ring, prob * least(1e0/nv, {_n(AREA)}/greatest(annulus - nm*{_n(AREA)}, nv*{_n(AREA)})) AS share FROM cnt WHERE nv > 0),
got AS (SELECT cell_id, sum(w*share) AS p FROM placed JOIN sh ON placed.off = sh.off AND placed.ring = sh.ring WHERE ok GROUP BY cell_id),
ring0 AS (SELECT c.cell_id, coalesce(g.p, 0e0) AS p FROM cells c LEFT JOIN got g ON c.cell_id = g.cell_id),
ring AS (SELECT cell_id, p, (SELECT greatest(0e0, 1e0 - sum(p)) FROM ring0) AS outside FROM ring0)"""


POINT_OFFSET = f"SELECT 0 AS off, {_n(POINT[0])} AS ox, {_n(POINT[1])} AS oy, 1e0 AS w"
UNIFORM = "uni AS (SELECT cell_id, CASE WHEN ok THEN 1e0 ELSE 0e0 END / (SELECT sum(CASE WHEN ok THEN 1e0 ELSE 0e0 END) FROM cells) * 0.8e0 AS p, 0.2e0 AS outside FROM cells)"
CORRIDOR = f"""near AS (SELECT cell_id, CASE WHEN ok AND {_line_sql(ROUTE)} <= 600e0 THEN exp(-({_line_sql(ROUTE)})/250e0) ELSE 0e0 END AS m FROM cells),
cor AS (SELECT cell_id, m / (SELECT sum(m) FROM near) * 0.9e0 AS p, 0.1e0 AS outside FROM near)"""


def uniform(spark, d):
    return priors.uniform_prior(cells(spark, d), 0.2, F.col("ok"))


def rings(spark, d, sigma=0.0):
    return priors.distance_ring_prior(spark, spread(cells(spark, d), "cell_id"), POINT, RINGS, CELL, sigma, F.col("ok"))


def corridor(spark, d):
    return priors.route_corridor(cells(spark, d), ROUTE, 250.0, 600.0, 0.1, F.col("ok"))


@query(f"WITH {CELLS}, {UNIFORM} SELECT cell_id, round(p, 9) AS p, round(outside, 9) AS outside FROM uni")
def q01_uniform_prior(spark, d):
    return rounded(uniform(spark, d))


MASS = "m AS (SELECT l_partkey AS cell_id, sum(l_quantity) AS mass FROM lineitem GROUP BY 1), nz AS (SELECT cell_id, mass / (SELECT sum(mass) + 100e0 FROM m) AS p, 100e0 / (SELECT sum(mass) + 100e0 FROM m) AS outside, (SELECT sum(mass) + 100e0 FROM m) AS z FROM m)"


def quantity(spark, d):
    m = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cell_id")).agg(F.sum("l_quantity").alias("mass"))
    return surface.normalize(m.withColumn("outside_mass", F.lit(100.0)))


@query(f"WITH {MASS} SELECT cell_id, round(p, 9) AS p, round(outside, 9) AS outside, round(z, 6) AS z FROM nz")
def q02_normalize(spark, d):
    return quantity(spark, d).select("cell_id", F.round("p", 9).alias("p"), F.round("outside", 9).alias("outside"), F.round("z", 6).alias("z"))


@query(f"WITH {MASS} SELECT count(*) AS n_cells, sum(CASE WHEN p < 0 THEN 1 ELSE 0 END)::BIGINT AS n_bad, round(max(outside), 9) AS outside, round(sum(p) + max(outside), 9) AS total, CASE WHEN count(*) <> 1 THEN 'cell count' ELSE '' END AS problems FROM nz")
def q03_invariants(spark, d):
    out = surface.check_invariants(quantity(spark, d), cell_count=1)
    return rounded(out.withColumn("problems", F.array_join("problems", ",")))


@query(f"WITH {CELLS}, {UNIFORM} SELECT cell_id, round(p / 10000e0 * 1e6, 9) AS density FROM uni")
def q04_densities(spark, d):
    return surface.densities(uniform(spark, d), AREA).select("cell_id", F.round(F.col("density") * 1e6, 9).alias("density"))


@query(f"WITH {_ring_sql(POINT_OFFSET)} SELECT cell_id, round(p, 9) AS p, round(outside, 9) AS outside FROM ring")
def q05_ring_prior(spark, d):
    return rounded(rings(spark, d))


SIGMA_OFFSETS = f"""SELECT (i.i+4)*9+(j.j+4) AS off, {_n(POINT[0])} + i.i*112.5e0 AS ox, {_n(POINT[1])} + j.j*112.5e0 AS oy,
 exp(-((i.i*0.75e0)*(i.i*0.75e0)+(j.j*0.75e0)*(j.j*0.75e0))/2e0) / sum(exp(-((i.i*0.75e0)*(i.i*0.75e0)+(j.j*0.75e0)*(j.j*0.75e0))/2e0)) OVER () AS w
 FROM (SELECT unnest(range(-4, 5)) AS i) i CROSS JOIN (SELECT unnest(range(-4, 5)) AS j) j WHERE (i.i*0.75e0)*(i.i*0.75e0)+(j.j*0.75e0)*(j.j*0.75e0) <= 9e0"""


@query(f"WITH {_ring_sql(SIGMA_OFFSETS)} SELECT cell_id, round(p, 9) AS p, round(outside, 9) AS outside FROM ring")
def q06_ring_prior_sigma(spark, d):
    return rounded(rings(spark, d, 150.0))


TABLE_SQL = "rt AS (SELECT p_partkey // 4 AS table_id, p_partkey % 4 AS seq, 500e0 * (p_partkey % 4 + 1) + p_size * 30 AS distance_m, CASE WHEN p_size > 45 THEN 1.2e0 ELSE 0.24e0 * (p_partkey % 4 + 1) END AS cumulative, CASE WHEN p_size % 4 > 0 THEN 2000e0 + p_size * 60 END AS tail_m FROM part)"
TABLE_STEPS = "st AS (SELECT *, lag(distance_m, 1, 0e0) OVER w AS d0, lag(cumulative, 1, 0e0) OVER w AS c0, lead(seq) OVER w IS NULL AS is_last FROM rt WINDOW w AS (PARTITION BY table_id ORDER BY seq))"


def _tables(spark, d):
    """Four parts each as the rings of one table."""
    k, n = F.col("p_partkey"), F.col("p_size")
    step = k % 4 + 1
    return table(spark, d, "part").select(F.floor(k / 4).alias("table_id"), (k % 4).alias("seq"), (500.0 * step + n * 30).alias("distance_m"), F.when(n > 45, 1.2).otherwise(0.24 * step).alias("cumulative"), F.when(n % 4 > 0, 2000.0 + n * 60).alias("tail_m"))


@query(f"""WITH {TABLE_SQL}, {TABLE_STEPS}
SELECT table_id, seq, 'distance does not increase' AS problem FROM st WHERE NOT distance_m > d0
UNION ALL SELECT table_id, seq, 'cumulative probability decreases or exceeds 1' FROM st WHERE cumulative < c0 OR cumulative > 1
UNION ALL SELECT table_id, seq, 'no tail distance' FROM st WHERE is_last AND cumulative < 1 - 1e-10 AND tail_m IS NULL
UNION ALL SELECT table_id, seq, 'tail inside last ring' FROM st WHERE is_last AND tail_m <= distance_m""")
def q07_ring_table_validate(spark, d):
    return priors.validate_ring_table(_tables(spark, d))


@query(f"""WITH {TABLE_SQL}, {TABLE_STEPS}
SELECT table_id, round(d0, 9) AS inner_m, round(distance_m, 9) AS outer_m, round(cumulative - c0, 9) AS prob FROM st
UNION ALL SELECT table_id, round(distance_m, 9), round(tail_m, 9), round(1 - cumulative, 9) FROM st WHERE is_last AND cumulative < 1 - 1e-10 AND tail_m IS NOT NULL""")
def q07b_rings_from_table(spark, d):
    return rounded(priors.rings_from_table(_tables(spark, d)).withColumnsRenamed({"inner": "inner_m", "outer": "outer_m"}))


@query(f"WITH {CELLS}, {CORRIDOR} SELECT cell_id, round(p, 9) AS p, round(outside, 9) AS outside FROM cor")
def q08_route_corridor(spark, d):
    return rounded(corridor(spark, d))


@query(f"WITH {CELLS}, {CORRIDOR}, {UNIFORM} SELECT c.cell_id, round(0.6e0*c.p + 0.4e0*u.p, 9) AS p, round(0.6e0*c.outside + 0.4e0*u.outside, 9) AS outside FROM cor c JOIN uni u ON c.cell_id = u.cell_id")
def q09_route_weighted(spark, d):
    return rounded(priors.route_weighted_prior(corridor(spark, d), uniform(spark, d), 0.6))


MIX = f"""{_ring_sql(POINT_OFFSET)}, {CORRIDOR}, {UNIFORM},
mix AS (SELECT r.cell_id, 0.45e0*r.p AS p_ring, 0.4e0*c.p AS p_route, 0.15e0*u.p AS p_uniform, 0.45e0*r.p + 0.4e0*c.p + 0.15e0*u.p AS p, 0.45e0*r.outside + 0.4e0*c.outside + 0.15e0*u.outside AS outside
 FROM ring r JOIN cor c ON r.cell_id = c.cell_id JOIN uni u ON r.cell_id = u.cell_id)"""


def mixed(spark, d):
    return priors.mixture([("ring", 0.45, rings(spark, d)), ("route", 0.4, corridor(spark, d)), ("uniform", 0.15, uniform(spark, d))])


@query(f"WITH {MIX} SELECT cell_id, round(p, 9) AS p, round(outside, 9) AS outside, round(p_ring, 9) AS p_ring, round(p_route, 9) AS p_route, round(p_uniform, 9) AS p_uniform FROM mix")
def q10_mixture(spark, d):
    c = F.col("contributions")
    return rounded(mixed(spark, d).select("cell_id", "p", "outside", c["ring"].alias("p_ring"), c["route"].alias("p_route"), c["uniform"].alias("p_uniform")))


@query(f"WITH {CELLS} SELECT cell_id, round(CASE WHEN p_retailprice <= 950e0 THEN 1e0 ELSE 0e0 END / (SELECT sum(CASE WHEN p_retailprice <= 950e0 THEN 1e0 ELSE 0e0 END) FROM cells) * 0.95e0, 9) AS p, 0.05e0 AS outside FROM cells")
def q11_reachable(spark, d):
    return rounded(priors.reachable_prior(cells(spark, d), F.col("p_retailprice"), 950.0, 0.05))


LR = "lrs AS (SELECT l_partkey AS cell_id, avg(l_discount) * 40e0 AS lr FROM lineitem GROUP BY 1)"


def likelihood(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("cell_id")).agg((F.avg("l_discount") * 40).alias("lr"))


@query(f"WITH {CELLS}, {UNIFORM}, {LR}, j AS (SELECT u.cell_id, u.p * l.lr AS m, u.outside * 0.5e0 AS mo FROM uni u JOIN lrs l ON u.cell_id = l.cell_id), z AS (SELECT sum(m) + max(mo) AS z FROM j) SELECT cell_id, round(m / z.z, 9) AS p, round(mo / z.z, 9) AS outside, round(z.z, 9) AS z FROM j CROSS JOIN z")
def q13_likelihood(spark, d):
    return rounded(updates.apply_likelihood(uniform(spark, d), likelihood(spark, d), 0.5))


GAUSS = f"""gk0 AS (SELECT cell_id, {_n(AREA)} / (2e0*pi()*360000e0) * exp(-((cx-1830e0)*(cx-1830e0)+(cy-2070e0)*(cy-2070e0)) / 720000e0) AS f0 FROM cells), gk AS (SELECT cell_id, f0 / (SELECT greatest(1e0, sum(f0)) FROM gk0) AS f FROM gk0)"""
POST = "pj AS (SELECT u.cell_id, u.p * (1e0 - {q} + {q} * (SELECT count(*) FROM {k}) * {k}.f) AS m, u.outside * (1e0 - {q}) AS mo FROM uni u JOIN {k} ON u.cell_id = {k}.cell_id), pz AS (SELECT sum(m) + max(mo) AS z FROM pj) SELECT cell_id, round(m / pz.z, 9) AS p, round(mo / pz.z, 9) AS outside, round(pz.z, 9) AS z FROM pj CROSS JOIN pz"


def gauss(spark, d):
    return updates.gaussian_kernel(cells(spark, d), 1830.0, 2070.0, 600.0, AREA)


def kernel_posterior(prior, kernel, q):
    field = updates.kernel_likelihood(kernel, q)
    return updates.apply_likelihood(prior, field, 1 - q)


@query(f"WITH {CELLS}, {UNIFORM}, {GAUSS}, " + POST.format(q="0.42e0", k="gk"))
def q14_gauss_kernel(spark, d):
    return rounded(kernel_posterior(uniform(spark, d), gauss(spark, d), 0.42))


WEDGE = f"""wi AS (SELECT cell_id, sqrt((cx-{_n(POINT[0])})*(cx-{_n(POINT[0])})+(cy-{_n(POINT[1])})*(cy-{_n(POINT[1])})) AS d, degrees(atan2(cx-{_n(POINT[0])}, cy-{_n(POINT[1])})) AS az FROM cells),
ww AS (SELECT cell_id, d > 0 AND d <= 1800e0 AND abs(((((az - 265e0) % 360e0) + 540e0) % 360e0) - 180e0) <= 25e0 AS inw FROM wi), wn AS (SELECT sum(CASE WHEN inw THEN 1e0 ELSE 0e0 END) AS n FROM ww),
wk AS (SELECT cell_id, CASE WHEN inw THEN least(1e0, n*{_n(AREA)}/(radians(50e0)/2e0*1800e0*1800e0))/n ELSE 0e0 END AS f FROM ww CROSS JOIN wn)"""


@query(f"WITH {CELLS}, {UNIFORM}, {WEDGE}, " + POST.format(q="0.3e0", k="wk"))
def q15_wedge_kernel(spark, d):
    return rounded(kernel_posterior(uniform(spark, d), updates.wedge_kernel(cells(spark, d), *POINT, 265.0, 25.0, 1800.0, AREA), 0.3))


@query(f"WITH {LR}, s AS (SELECT least(min(lr), 0.5e0) AS min_lr, greatest(max(lr), 0.5e0) AS max_lr FROM lrs) SELECT round(min_lr, 9) AS min_lr, round(max_lr, 9) AS max_lr, round(max_lr / min_lr, 9) AS spread, max_lr / min_lr > 100 AS extreme FROM s")
def q16_lr_summary(spark, d):
    return rounded(updates.summarize_likelihood(likelihood(spark, d), 0.5))


PODS = "pods AS (SELECT l_partkey AS cell_id, 1e0 - exp(-avg(l_tax) * 20e0) AS pod FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)"


def tax_pod(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'A'")
    return li.groupBy(F.col("l_partkey").alias("cell_id")).agg(pod.exponential_pod(F.avg("l_tax") * 20).alias("pod"))


@query(f"WITH {CELLS}, {UNIFORM}, {PODS}, j AS (SELECT u.cell_id, u.p * (1e0 - coalesce(pods.pod, 0e0)) AS m, u.outside AS mo FROM uni u LEFT JOIN pods ON u.cell_id = pods.cell_id), z AS (SELECT sum(m) + max(mo) AS z FROM j) SELECT cell_id, round(m / z.z, 9) AS p, round(mo / z.z, 9) AS outside, round(z.z, 9) AS z FROM j CROSS JOIN z")
def q17_no_find(spark, d):
    return rounded(updates.no_find_update(uniform(spark, d), tax_pod(spark, d)))


@query(f"WITH {CELLS}, {UNIFORM}, {PODS} SELECT round(sum(u.p * pods.pod), 9) AS pos FROM uni u JOIN pods ON u.cell_id = pods.cell_id")
def q18_pos(spark, d):
    return rounded(updates.probability_of_success(uniform(spark, d), tax_pod(spark, d)))


@query("WITH e AS (SELECT user_id, value / 1000e0 AS pod FROM events), a AS (SELECT user_id, 1e0 - product(1e0 - pod) AS ind, max(pod) AS best FROM e GROUP BY 1) SELECT user_id, round(ind, 9) AS d0, round(ind - 0.5e0*(ind-best), 9) AS d05, round(best, 9) AS d1 FROM a")
def q19_cumulative_pod(spark, d):
    e = table(spark, d, "events").select("user_id", (F.col("value") / 1000).alias("pod"))
    out = None
    for name, dep in (("d0", 0.0), ("d05", 0.5), ("d1", 1.0)):
        one = updates.cumulative_pod(e, ["user_id"], dep).withColumnRenamed("pod", name)
        out = one if out is None else out.join(one, "user_id")
    return rounded(out)


@query("SELECT l_suppkey, round(1e0 - product(1e0 - l_tax) - 0.25e0*(1e0 - product(1e0 - l_tax) - max(l_tax)), 9) AS pod FROM lineitem GROUP BY 1")
def q20_combine_pod(spark, d):
    return rounded(pod.combine_pod_surfaces(table(spark, d, "lineitem").select("l_suppkey", F.col("l_tax").alias("pod")), ["l_suppkey"], 0.25))


WHY = "checked against the map sheet"


@query(f"WITH {CELLS}, {UNIFORM}, j AS (SELECT u.cell_id, u.p * (CASE WHEN c.p_size > 30 THEN 2e0 ELSE 0.5e0 END) AS m, u.outside AS mo FROM uni u JOIN cells c ON u.cell_id = c.cell_id), z AS (SELECT sum(m) + max(mo) AS z FROM j) SELECT cell_id, round(m / z.z, 9) AS p, round(mo / z.z, 9) AS outside FROM j CROSS JOIN z")
def q21_manual_adjust(spark, d):
    factors = cells(spark, d).select("cell_id", F.when(F.col("p_size") > 30, 2.0).otherwise(0.5).alias("factor"))
    return rounded(updates.apply_manual_adjustment(uniform(spark, d), factors, WHY).drop("z"))


@query(f"WITH {CELLS}, {UNIFORM} SELECT cell_id, round(p * 0.65e0 / 0.8e0, 9) AS p, 0.35e0 AS outside FROM uni")
def q22_set_outside(spark, d):
    return rounded(updates.set_outside_probability(uniform(spark, d), 0.35, WHY))


NOFIND = f"{CELLS}, {UNIFORM}, {PODS}, nj AS (SELECT u.cell_id, u.p AS a, u.outside AS oa, u.p * (1e0 - coalesce(pods.pod, 0e0)) AS m FROM uni u LEFT JOIN pods ON u.cell_id = pods.cell_id), nzz AS (SELECT sum(m) + max(oa) AS z FROM nj), nf AS (SELECT cell_id, a, oa, m / nzz.z AS b, oa / nzz.z AS ob FROM nj CROSS JOIN nzz)"


def _transfer(spark, d):
    prior = uniform(spark, d)
    zones = cells(spark, d).select("cell_id", F.col("p_brand").alias("zone"))
    return updates.transfer_summary(prior, updates.no_find_update(prior, tax_pod(spark, d)), zones)


@query(f"WITH {NOFIND} SELECT p_brand AS zone, round(sum(a), 9) AS prior, round(sum(b), 9) AS posterior, round(sum(b) - sum(a), 9) AS change FROM nf JOIN cells ON nf.cell_id = cells.cell_id GROUP BY 1")
def q23_transfer_summary(spark, d):
    return rounded(_transfer(spark, d)[1])


@query(f"WITH {NOFIND} SELECT round((sum(abs(b - a)) + max(abs(ob - oa))) / 2e0, 9) AS moved FROM nf")
def q23b_moved(spark, d):
    return rounded(_transfer(spark, d)[0])


@query(f"WITH {CELLS}, {UNIFORM}, {GAUSS}, v(variant, q) AS (VALUES ('low', 0.3e0), ('central', 0.56e0), ('high', 0.9e0)), j AS (SELECT variant, u.cell_id, u.p * (1e0 - q + q * (SELECT count(*) FROM gk) * gk.f) AS m, u.outside * (1e0 - q) AS mo FROM uni u JOIN gk ON u.cell_id = gk.cell_id CROSS JOIN v), z AS (SELECT variant, sum(m) + max(mo) AS z FROM j GROUP BY 1) SELECT j.variant, cell_id, round(m / z.z, 9) AS p, round(mo / z.z, 9) AS outside, round(z.z, 9) AS z FROM j JOIN z ON j.variant = z.variant")
def q24_sensitivity(spark, d):
    return rounded(updates.sensitivity(uniform(spark, d), gauss(spark, d), 0.8, 0.7))


@query(f"WITH {MIX}, s AS (SELECT cell_id, p, coalesce(sum(p) OVER (ORDER BY p DESC, cell_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS before, sum(p) OVER () AS total FROM mix) SELECT level, cell_id, round(p, 9) AS p FROM s CROSS JOIN (VALUES (0.5e0), (0.7e0)) AS l(level) WHERE before < level AND total >= level")
def q25_hpd(spark, d):
    levels = literal(spark, "level double", [(0.5,), (0.7,)])
    s = mixed(spark, d).select("cell_id", "p").crossJoin(F.broadcast(levels))
    return updates.highest_density(s, F.col("level"), ["level"]).select("level", "cell_id", F.round("p", 9).alias("p"))


@query(f"""WITH {MIX}, r AS (SELECT cell_id, round(p, 7) AS p, round(outside, 7) AS outside FROM mix), f AS (SELECT s_suppkey AS find_id, CASE WHEN s_suppkey % 10 = 0 THEN -1 ELSE s_suppkey * 7 % 2000 END AS cell_id FROM supplier),
n AS (SELECT count(*) AS n, max(outside) AS o FROM r), k AS (SELECT row_number() OVER (ORDER BY p DESC) AS rn, p FROM r),
tops AS (SELECT sum(CASE WHEN rn <= greatest(1, floor(n*0.1e0+0.5e0)) THEN p END) AS top10, sum(CASE WHEN rn <= greatest(1, floor(n*0.25e0+0.5e0)) THEN p END) AS top25, sum(CASE WHEN rn <= greatest(1, floor(n*0.5e0+0.5e0)) THEN p END) AS top50 FROM k CROSS JOIN n),
c AS (SELECT p AS pp, count(*) AS ties, sum(count(*)) OVER (ORDER BY p DESC) - count(*) AS higher FROM r GROUP BY p)
SELECT find_id, round(CASE WHEN f.cell_id >= 0 THEN r.p ELSE n.o END, 9) AS p, round(CASE WHEN f.cell_id >= 0 THEN r.p * 100e0 END, 9) AS density_km2, round(CASE WHEN f.cell_id >= 0 THEN (higher + (ties-1)/2e0)/n END, 9) AS rank,
 round(CASE WHEN f.cell_id >= 0 THEN (higher + ties)::DOUBLE/n END, 9) AS capture, round(top10, 9) AS top10, round(top25, 9) AS top25, round(top50, 9) AS top50, round(ln(greatest(CASE WHEN f.cell_id >= 0 THEN r.p ELSE n.o END, 1e-9)), 9) AS log_score, f.cell_id < 0 AS outside
FROM f LEFT JOIN r ON f.cell_id = r.cell_id LEFT JOIN c ON r.p = c.pp CROSS JOIN n CROSS JOIN tops""")
def q26_case_metrics(spark, d):
    s = mixed(spark, d).select("cell_id", F.round("p", 7).alias("p"), F.round("outside", 7).alias("outside"))
    key = F.col("s_suppkey")
    finds = table(spark, d, "supplier").select(key.alias("find_id"), F.when(key % 10 == 0, -1).otherwise(key * 7 % 2000).cast("long").alias("cell_id"))
    return rounded(evaluation.case_metrics(s, finds, AREA))


CUTOFF = "2024-01-10 12:00:00"


@query(f"SELECT event_id, user_id FROM events WHERE ts <= TIMESTAMP '{CUTOFF}'")
def q27_filter_available(spark, d):
    return evaluation.filter_available(table(spark, d, "events"), CUTOFF, "ts").select("event_id", "user_id")


LEAK = "CASE WHEN event_type = 'error' THEN '{\"Found_at\": {\"x\": 1, \"findings\": 2}, \"ok\": [3, [{\"a.b\": {\"found_by\": [1]}}, {\"deep\": [[{\"findings\": null}]]}]]}' WHEN event_type = 'view' THEN 'no json' ELSE props END"


@query(f"""SELECT event_id, 'late' AS problem FROM events WHERE ts > TIMESTAMP '{CUTOFF}'
UNION ALL SELECT event_id, '$.Found_at' FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, unnest(['$.Found_at.findings', '$.ok[1][0].a.b.found_by', '$.ok[1][1].deep[0][0].findings']) FROM events WHERE event_type = 'error'""")
def q28_leakage(spark, d):
    e = table(spark, d, "events")
    late = evaluation.late_items(e, CUTOFF, "ts").select("event_id", F.lit("late").alias("problem"))
    keys = evaluation.outcome_keys(e.withColumn("payload", F.expr(LEAK)), "event_id", "payload")
    return late.unionByName(keys.withColumnRenamed("path", "problem"))


@query(f"WITH {CELLS} SELECT cell_id FROM cells WHERE {_inside_sql(POLYGON)}")
def q35_rasterize_polygon(spark, d):
    return cells(spark, d).where(geo.in_polygon(F.col("cx"), F.col("cy"), POLYGON)).select("cell_id")


@query(f"WITH {CELLS} SELECT cell_id, round(CASE WHEN {_inside_sql(POLYGON)} THEN 0.5e0 ELSE 0e0 END, 9) AS coverage, {_inside_sql(POLYGON)} AS in_assignment, round(1e0 - exp(-(CASE WHEN {_inside_sql(POLYGON)} THEN 0.5e0 ELSE 0e0 END)), 9) AS pod FROM cells")
def q36_planned_pod(spark, d):
    return rounded(pod.planned_pod(cells(spark, d), POLYGON, 20.0, 40.0))


LEG_ROWS = ", ".join(f"({i}, {_n(a[0])}, {_n(a[1])}, {_n(b[0])}, {_n(b[1])})" for i, (a, b) in enumerate(zip(WALK, WALK[1:], strict=False)))
LENGTHS = f"""legs(leg, ax, ay, ex, ey) AS (VALUES {LEG_ROWS}), lg AS (SELECT *, sqrt((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)) AS len FROM legs), pn AS (SELECT *, greatest(1, ceil(len / 25e0))::BIGINT AS n FROM lg),
pc AS (SELECT len / n AS part, ax + (ex-ax) * ((k + 0.5e0) / n) AS x, ay + (ey-ay) * ((k + 0.5e0) / n) AS y FROM (SELECT *, unnest(range(n)) AS k FROM pn)),
lc AS (SELECT (floor(y / 100e0) * 50 + floor(x / 100e0))::BIGINT AS cell_id, sum(part) AS length FROM pc WHERE x >= 0 AND x < 5000e0 AND y >= 0 AND y < 1000000e0 GROUP BY 1)"""


def _walk(spark):
    return geo.line_legs(spark, WALK)


@query("""WITH tl AS (SELECT s_suppkey // 10 AS line_id, s_suppkey % 10 AS seq, s_suppkey * 7919 % 6000 - 500e0 AS x, s_suppkey * 104729 % 6000 - 500e0 AS y FROM supplier), legs AS (SELECT line_id, x AS ex, y AS ey, lag(x) OVER w AS ax, lag(y) OVER w AS ay FROM tl WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
lg AS (SELECT *, sqrt((ex-ax)*(ex-ax)+(ey-ay)*(ey-ay)) AS len FROM legs WHERE ax IS NOT NULL), pn AS (SELECT *, greatest(1, ceil(len / 25e0))::BIGINT AS n FROM lg WHERE len > 0),
pc AS (SELECT line_id, len / n AS part, ax + (ex-ax) * ((k + 0.5e0) / n) AS x, ay + (ey-ay) * ((k + 0.5e0) / n) AS y FROM (SELECT *, unnest(range(n)) AS k FROM pn))
SELECT line_id, (floor(y / 100e0) * 50 + floor(x / 100e0))::BIGINT AS cell_id, round(sum(part), 6) AS length FROM pc WHERE x >= 0 AND x < 5000e0 AND y >= 0 AND y < 1000000e0 GROUP BY ALL""")
def q37_rasterize_line(spark, d):
    """The lengths of the suppliers' lines in every cell."""
    k = F.col("s_suppkey")
    w = W.partitionBy("line_id").orderBy("seq")
    points = table(spark, d, "supplier").select(F.floor(k / 10).alias("line_id"), (k % 10).alias("seq"), (k * 7919 % 6000 - 500.0).alias("bx"), (k * 104729 % 6000 - 500.0).alias("by"))
    legs = points.withColumns({"ax": F.lag("bx").over(w), "ay": F.lag("by").over(w)}).where("ax is not null")
    return geo.rasterize_legs(legs, grid(10_000), ["line_id"]).withColumn("length", F.round("length", 6))


EDGE = f"({_line_sql(POLYGON + POLYGON[:1])})"
ACHIEVED = f"""{CELLS}, {LENGTHS}, ac AS (SELECT c.cell_id, CASE WHEN {_inside_sql(POLYGON)} OR {EDGE} <= 50e0 THEN coalesce(l.length * 20e0 / 10000e0, 0e0) ELSE 0e0 END AS coverage, {_inside_sql(POLYGON)} AS in_assignment FROM cells c LEFT JOIN lc l ON c.cell_id = l.cell_id)"""


@query(f"WITH {ACHIEVED} SELECT cell_id, round(coverage, 9) AS coverage, in_assignment, round(1e0 - exp(-coverage), 9) AS pod FROM ac")
def q38_achieved_pod(spark, d):
    return rounded(pod.achieved_pod(cells(spark, d), _walk(spark), grid(10_000), POLYGON, 20.0, 50.0))


@query(f"WITH {ACHIEVED} SELECT count(*) AS cells, coalesce(round(avg(coverage), 9), 0e0) AS mean_coverage, coalesce(round(avg(1e0 - exp(-coverage)), 9), 0e0) AS mean_pod FROM ac WHERE in_assignment")
def q38b_pod_summary(spark, d):
    return rounded(pod.summarise(pod.achieved_pod(cells(spark, d), _walk(spark), grid(10_000), POLYGON, 20.0, 50.0)))


@query(f"WITH {CELLS} SELECT cell_id, round({_line_sql(WALK)}, 6) AS d FROM cells")
def q42_polyline_distance(spark, d):
    return cells(spark, d).select("cell_id", F.round(geo.polyline_distance(F.col("cx"), F.col("cy"), WALK), 6).alias("d"))


@query(f"WITH {NOFIND} SELECT CASE WHEN p_size <= 17 THEN 'low' WHEN p_size <= 34 THEN 'mid' ELSE 'high' END AS zone, count(*) AS n, round(sum(a), 9) AS prior, round(sum(b), 9) AS posterior FROM nf JOIN cells ON nf.cell_id = cells.cell_id GROUP BY 1")
def q72_zone_table(spark, d):
    prior = uniform(spark, d)
    post = updates.no_find_update(prior, tax_pod(spark, d)).select("cell_id", F.col("p").alias("b"))
    zone = F.when(F.col("p_size") <= 17, "low").when(F.col("p_size") <= 34, "mid").otherwise("high").alias("zone")
    j = prior.join(post, "cell_id").join(cells(spark, d).select("cell_id", zone), "cell_id")
    return rounded(j.groupBy("zone").agg(F.count("*").alias("n"), F.sum("p").alias("prior"), F.sum("b").alias("posterior")))
