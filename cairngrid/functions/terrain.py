"""The invented terrain of the built-in exercise: lattice noise and open water, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairngrid.functions.geometry import polyline_distance

# The multipliers and the seed of the lattice hash, and the exercise's lake (centre and half axes in metres); terrain depends on each.
HASH_X, HASH_Y, HASH_SEED, HASH_MIX = 374761393, 668265263, 0x5BD1E995, 1274126177
LAKE = (4550.0, 3650.0, 420.0, 300.0)
# The exercise's trail, creek and cliff in metres, and the names of its zones.
TRAIL = [(800, 600), (1300, 950), (1750, 1250), (2250, 1600), (2700, 2050), (3050, 2400), (3500, 2800), (3900, 3150), (4150, 3380)]
CREEK = [(1500, 4400), (1750, 3700), (2000, 3000), (2150, 2300), (2250, 1600), (2550, 1000), (3000, 450), (3500, 0)]
CLIFF = [(3300, 1150), (3900, 1450), (4600, 1650), (5600, 1800)]
ZONES = ["Trail corridor", "Creek drainage", "North basin", "East slopes", "South & west slopes"]
_WORD = 0xFFFFFFFF


def lattice_hash(i: Column, j: Column) -> Column:
    """A number from 0 to 1 for a lattice point, by 32-bit arithmetic in longs."""
    word = lambda c: c.bitwiseAND(F.lit(_WORD))
    h = word(i.cast("long") * HASH_X + j.cast("long") * HASH_Y).bitwiseXOR(F.lit(HASH_SEED))
    h = word(h.bitwiseXOR(F.shiftrightunsigned(h, 13)) * HASH_MIX)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16)) / float(_WORD)


def value_noise(x: Column, y: Column) -> Column:
    """Smooth noise: the hashes of the four lattice points around, blended by cubic steps."""
    i, j = F.floor(x), F.floor(y)
    ease = lambda t: t * t * (3 - 2 * t)
    u, v = ease(x - i), ease(y - j)
    corner = {(a, b): lattice_hash(i + a, j + b) for a in (0, 1) for b in (0, 1)}
    south = corner[0, 0] * (1 - u) + corner[1, 0] * u
    north = corner[0, 1] * (1 - u) + corner[1, 1] * u
    return south * (1 - v) + north * v


def in_lake(x: Column, y: Column, lake: tuple[float, float, float, float] = LAKE) -> Column:
    cx, cy, rx, ry = lake
    a, b = (x - cx) / rx, (y - cy) / ry
    return a * a + b * b <= 1


def land_mask(x: Column, y: Column) -> Column:
    """Cells that may hold probability: all but open water."""
    return ~in_lake(x, y)


def elevation(x: Column, y: Column) -> Column:
    """Metres above the sea: a slope to the north, rising away from the middle, two sizes of noise, a valley along the creek and a step at the cliff."""
    slope = 1450 + y * 0.12 + F.abs(x - 3000) * 0.05
    rough = 160 * value_noise(x / 900, y / 900) + 60 * value_noise(x / 300 + 7, y / 300 + 3)
    valley = 70 * F.exp(-polyline_distance(x, y, CREEK) / 220)
    return slope + rough - valley + F.when(polyline_distance(x, y, CLIFF) < 60, 40.0).otherwise(0.0)


def on_cliff(x: Column, y: Column) -> Column:
    return polyline_distance(x, y, CLIFF) < 45


def zone(x: Column, y: Column) -> Column:
    """Place of a point's zone in ZONES: by the trail, then by the creek, then by the side of the map."""
    return F.when(polyline_distance(x, y, TRAIL) < 200, 0).when(polyline_distance(x, y, CREEK) < 250, 1).when(y > 3000, 2).when(x > 3000, 3).otherwise(4)
