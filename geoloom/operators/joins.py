"""Spatial joins as equality joins on grid cells: no cross join, no side that has to be broadcast.

Frames of points have ``_lat`` and ``_lng``; both sides keep their other columns, and an error is raised where these clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import distance, haversine_share, lng_reach
from ..functions.units import DISTANCE_DECIMALS, EARTH_RADIUS_KM, checked_radius, per_km
from ..plans.shared import cut

#: The narrowest band of latitude, so that tiny radii don't make cell numbers overflow.
LEAST_BAND = 1e-4
#: Half the circumference in kilometres, rounded up: no two points are farther apart.
FARTHEST_KM = 20_016.0
#: Cells of zones are this many degrees, halved by their level. Level of rings that fit no grid, the plane as one cell.
PLANE, WHOLE = 1024.0, 99
#: Up to so many edges in a band are tested by compiled code.
UNROLLED = 6
#: So many cells are sent to all executors at most.
FEW_CELLS = 100_000


def _checked_names(left: DataFrame, names: list[str], how: str) -> None:
    clash = sorted({c.lower() for c in left.columns} & {c.lower() for c in names}) if how == "inner" else []
    if clash:
        raise ValueError(f"both sides have columns {clash}; rename them on one side")


#: Bands of latitude a radius, and cells a reach in longitude, of the radius join.
FINE_BANDS, FINE_CELLS = 4, 2


def _cells_around(band: Column, width: float, angle: float, bands: int) -> Column:
    """How many cells a band of latitude has: as wide as half of what a circle around a point of it or a neighbour spans."""
    if width == 360.0:
        return F.lit(1).cast("long")
    edge = F.least(F.lit(90.0), F.greatest(F.abs((band - bands) * width - 90.0), F.abs((band + bands + 1) * width - 90.0)))
    return F.greatest(F.lit(1.0), F.floor(180.0 * FINE_CELLS / F.greatest(lng_reach(edge, F.lit(angle)), F.lit(1e-4)))).cast("long")


def _within(radius: float, unit: str) -> Column:
    """``distance(...) <= radius``, where the haversine's square decides alone for all pairs but those about the radius."""
    pad = 0.5 * 10.0**-DISTANCE_DECIMALS  # distances are compared after rounding
    share = haversine_share("_lat", "_lng", "_gl_lat", "_gl_lng")

    def at(r: float, more: float) -> float:
        angle = r / per_km(unit) / EARTH_RADIUS_KM * (1 + more)
        return math.inf if angle >= math.pi else math.sin(angle / 2) ** 2 * (1 + more)

    exact = distance("_lat", "_lng", "_gl_lat", "_gl_lng", unit) <= radius
    if at(radius + pad, 1e-9) == math.inf:
        return exact
    sure = share <= (at(radius - pad, -1e-9) if pad < radius else -1.0)
    return (share <= at(radius + pad, 1e-9) + 1e-30) & (sure | exact)


def radius_join(left: DataFrame, right: DataFrame, radius: float, unit: str = "km", how: str = "inner") -> DataFrame:
    """Pairs within ``radius`` (rounded distance), with ``_distance``; ``how`` may be inner, left_semi or left_anti.

    The sphere is cut into bands of latitude a quarter of a radius high, each into cells about a radius wide. The left
    side lies in one cell, the right side in those its circle can touch (some thirty, or the bands around a pole),
    and both meet by equality. Rows without coordinates meet nothing.
    """
    radius, factor = checked_radius(radius), per_km(unit)
    angle = (radius + 0.5 * 10.0**-DISTANCE_DECIMALS) / factor / EARTH_RADIUS_KM * (1 + 1e-9) + 1e-12
    width = max(math.degrees(angle) * (1 + 1e-9), LEAST_BAND)
    bands = FINE_BANDS if width > LEAST_BAND * FINE_BANDS else 1
    if width > 60:  # a circle of more than a sixth of the globe: one cell
        width, bands = 360.0, 1
    width /= bands
    top = math.ceil(180.0 / width)

    def cell(lng: Column, n: Column) -> Column:
        return F.floor((lng + 180.0) / 360.0 * n)

    band = F.least(F.floor((F.col("_lat") + 90.0) / width), F.lit(top - 1)).cast("long")
    here = left.where("_lat is not null and _lng is not null").withColumn("_gl_b", band)
    here = here.withColumn("_gl_n", _cells_around(F.col("_gl_b"), width, angle, bands)).withColumn("_gl_c", F.pmod(cell(F.col("_lng"), F.col("_gl_n")), F.col("_gl_n"))).drop("_gl_n")
    names = [c for c in right.columns if c not in ("_ord", "_lat", "_lng")]
    _checked_names(left, names, how)
    other = right.where("_lat is not null and _lng is not null").select(*names, F.col("_lat").alias("_gl_lat"), F.col("_lng").alias("_gl_lng"))
    own = F.least(F.floor((F.col("_gl_lat") + 90.0) / width), F.lit(top - 1)).cast("long")
    other = other.withColumn("_gl_band", F.explode(F.sequence(F.greatest(own - bands, F.lit(0).cast("long")), F.least(own + bands, F.lit(top - 1).cast("long")))))
    other = other.withColumn("_gl_m", _cells_around(F.col("_gl_band"), width, angle, bands))
    reach = lng_reach("_gl_lat", F.lit(angle)) + 1e-9
    first, last = cell(F.col("_gl_lng") - reach, F.col("_gl_m")), cell(F.col("_gl_lng") + reach, F.col("_gl_m"))
    all_ = F.sequence(F.lit(0).cast("long"), F.col("_gl_m") - 1)
    some = F.array_distinct(F.transform(F.sequence(first, F.least(last, first + F.col("_gl_m") - 1)), lambda x: F.pmod(x, F.col("_gl_m"))))
    other = other.withColumn("_gl_cell", F.explode(F.when(reach >= 180.0, all_).otherwise(some))).drop("_gl_m")
    if width == 360.0:  # one cell: the left side is dealt out by its coordinates, and the right side meets each part
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        here = here.withColumn("_gl_c", F.pmod(F.xxhash64("_lat", "_lng"), F.lit(parts)))
        other = other.withColumn("_gl_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    if not left.isStreaming:  # a broadcast would leave all pairs to the tasks that read the left side, perhaps one
        other = other.hint("merge")
    met = (F.col("_gl_b") == F.col("_gl_band")) & (F.col("_gl_c") == F.col("_gl_cell")) & _within(radius, unit)
    out = here.join(other, met, how)
    if how == "inner":
        out = out.withColumn("_distance", distance("_lat", "_lng", "_gl_lat", "_gl_lng", unit))
    return out.drop("_gl_b", "_gl_c", "_gl_band", "_gl_cell", "_gl_lat", "_gl_lng")


def _edges(ring: str) -> Column:
    """The ring's edges without nulls, each from a point to the one before it; ``lo`` to ``hi`` are its latitudes. A level one crosses nothing, but bounds."""
    n = F.size(ring)

    def edge(a: Column, i: Column) -> Column:
        b = F.get(ring, (i + n - 1) % n)
        return F.struct(F.least(a["lat"], b["lat"]).alias("lo"), F.greatest(a["lat"], b["lat"]).alias("hi"), a["lng"].alias("ax"), a["lat"].alias("ay"), (b["lng"] - a["lng"]).alias("dx"), F.nullif(b["lat"] - a["lat"], F.lit(0.0)).alias("dy"), (a["lat"] + b["lat"]).isNotNull().alias("known"))

    return F.filter(F.transform(ring, edge), lambda e: e["known"] & e["dx"].isNotNull())


def _crossed(e: Column) -> Column:
    """Whether the edge lies east of the point: the terms of :func:`geoloom.functions.geo.in_ring`, in their order."""
    y, x = F.col("_lat"), F.col("_lng")
    return F.coalesce((y >= e["lo"]) & (y < e["hi"]) & (x < e["dx"] * (y - e["ay"]) / e["dy"] + e["ax"]), F.lit(False))


def _odd(edges: str, unrolled: bool) -> Column:
    """Whether the point crosses an odd number of edges; unrolled for a few, so that the join is compiled."""
    if not unrolled:
        return F.size(F.filter(edges, _crossed)) % 2 == 1
    out = _crossed(F.get(edges, F.lit(0)))
    for i in range(1, UNROLLED):
        out = out != _crossed(F.get(edges, F.lit(i)))
    return out


def _fineness(points: DataFrame) -> int:
    """k, where a zone's box is cut into at most 2^k cells a side: twice as many for four times the points, so that as many points stay near a zone's edge."""
    if points.isStreaming:
        return 5
    return max(4, min(10, round(math.log2(max(points.count(), 1)) / 2) - 4))


def _size(level: str) -> Column:
    return F.lit(PLANE) * F.pow(F.lit(2.0), -F.col(level))


def _bands(zones: DataFrame, names: list[str], ring: str, k: int) -> DataFrame:
    """A row for each band of latitude of each zone: ``names``, the grid (_gl_zx, _gl_zy), _gl_zb, and the edges in the band.

    A zone has its own grid level in each direction, at which its box spans at most 2^k cells. Sizes are powers of
    two, so a division by them is exact. Rings with coordinates that are null, not finite or beyond 1e6 are on level
    ``WHOLE``, the plane as one cell.
    """
    box = zones.select(*names, F.col(ring).alias("_gl_ring")).repartition(F.xxhash64("_gl_ring")).withColumn("_gl_edges", _edges("_gl_ring"))
    wild = F.exists("_gl_ring", lambda p: ~F.coalesce((F.abs(p["lng"]) <= 1e6) & (F.abs(p["lat"]) <= 1e6), F.lit(False)))
    box = box.withColumn("_gl_wild", wild).drop("_gl_ring")
    west, east = F.transform("_gl_edges", lambda e: F.least(e["ax"], e["ax"] + e["dx"])), F.transform("_gl_edges", lambda e: F.greatest(e["ax"], e["ax"] + e["dx"]))
    low, high = F.array_min(F.transform("_gl_edges", lambda e: e["lo"])), F.array_max(F.transform("_gl_edges", lambda e: e["hi"]))

    def level(span: Column) -> Column:
        fit = F.floor(F.log2(F.lit(PLANE) / F.greatest(span, F.lit(1e-9)))) + k
        return F.when(F.col("_gl_wild"), WHOLE).otherwise(F.greatest(F.lit(-12), F.least(F.lit(30), fit))).cast("int")

    box = box.withColumns({"_gl_zx": level(F.array_max(east) - F.array_min(west)), "_gl_zy": level(high - low), "_gl_y0": low, "_gl_y1": high})
    box = cut(box.withColumns({"_gl_w": _size("_gl_zx"), "_gl_h": _size("_gl_zy")}))  # else filters behind are carried out on the rings' formula
    every = F.when(F.col("_gl_wild"), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.floor(F.col("_gl_y0") / F.col("_gl_h")), F.floor(F.col("_gl_y1") / F.col("_gl_h"))))
    out = box.select(*names, "_gl_wild", "_gl_zx", "_gl_zy", "_gl_w", "_gl_h", "_gl_edges", F.explode(every).alias("_gl_zb"))
    out = out.withColumns({"_gl_y0": F.col("_gl_zb") * F.col("_gl_h"), "_gl_y1": (F.col("_gl_zb") + 1) * F.col("_gl_h")})
    return out.withColumn("_gl_edges", F.filter("_gl_edges", lambda e: F.col("_gl_wild") | ((e["hi"] > F.col("_gl_y0")) & (e["lo"] < F.col("_gl_y1")))))


def _cover(bands: DataFrame) -> DataFrame:
    """``bands`` with the cells that an edge touches (_gl_cells) and the runs (a to b) of cells that lie inside whole (_gl_runs).

    All points of a cell that no edge touches, padded by far more than the test's rounding, cross as many edges east of
    it or differ by an even number, so one test in the middle of the band decides for all.
    """
    size, south, north = F.col("_gl_w"), F.col("_gl_y0"), F.col("_gl_y1")

    def reach(e: Column) -> Column:
        def at(y: Column) -> Column:
            return e["dx"] * (y - e["ay"]) / e["dy"] + e["ax"]

        middle = (south + north) / 2
        pad = (F.abs(e["ax"]) + F.abs(e["dx"]) + 1.0) * 1e-12
        return F.struct(F.coalesce(at(F.greatest(e["lo"], south)), e["ax"]).alias("p"), F.coalesce(at(F.least(e["hi"], north)), e["ax"] + e["dx"]).alias("q"), pad.alias("pad"), ((e["lo"] <= middle) & (middle < e["hi"])).alias("mid"))

    def span(r: Column) -> Column:
        return F.struct(F.floor((F.least(r["p"], r["q"]) - r["pad"]) / size).alias("a"), F.floor((F.greatest(r["p"], r["q"]) + r["pad"]) / size).alias("b"), r["mid"].alias("mid"))

    out = bands.withColumn("_gl_spans", F.when(~F.col("_gl_wild"), F.transform(F.transform("_gl_edges", reach), span)))
    touched = F.sort_array(F.array_distinct(F.flatten(F.transform("_gl_spans", lambda r: F.sequence(r["a"], r["b"])))))
    out = out.withColumn("_gl_cells", F.coalesce(touched, F.array(F.lit(0).cast("long"))))

    def gap(c: Column, i: Column) -> Column:
        return F.struct((c + 1).alias("a"), (F.get("_gl_cells", i + 1) - 1).alias("b"))

    def inside(g: Column) -> Column:
        return F.when(g["b"] >= g["a"], F.size(F.filter("_gl_spans", lambda r: r["mid"] & (r["a"] >= g["a"]))) % 2 == 1).otherwise(False)

    return out.withColumn("_gl_runs", F.coalesce(F.filter(F.transform("_gl_cells", gap), inside), F.array().cast("array<struct<a:bigint,b:bigint>>"))).drop("_gl_spans", "_gl_wild", "_gl_w", "_gl_h", "_gl_y0", "_gl_y1")


def _levels(bands: DataFrame) -> tuple[list, int]:
    """The grids that zones use, and the most edges of one in a band: all that the driver learns."""
    found = bands.groupBy("_gl_zx", "_gl_zy").agg(F.max(F.size("_gl_edges")).alias("n")).collect()
    return sorted((r["_gl_zx"], r["_gl_zy"]) for r in found), max((r["n"] for r in found), default=0)


def _placed(points: DataFrame, levels: list) -> DataFrame:
    """Every point with its band and cell on each grid; those without coordinates are left out."""
    grids = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in levels)).cast("array<struct<x:int,y:int>>")
    here = points.where("_lat is not null and _lng is not null and not isnan(_lat) and not isnan(_lng)").withColumn("_gl_g", F.explode(grids))
    here = here.withColumns({"_gl_x": F.col("_gl_g.x"), "_gl_y": F.col("_gl_g.y")}).drop("_gl_g")
    whole = F.col("_gl_x") == WHOLE
    return here.withColumns({"_gl_b": F.when(whole, 0).otherwise(F.floor(F.col("_lat") / _size("_gl_y"))).cast("long"), "_gl_c": F.when(whole, 0).otherwise(F.floor(F.col("_lng") / _size("_gl_x"))).cast("long")})


SAME = "_gl_x = _gl_zx and _gl_y = _gl_zy and _gl_b = _gl_zb and _gl_c = _gl_cell"


def _tested(here: DataFrame, cells: DataFrame, most: int, how: str = "inner") -> list[DataFrame]:
    """Points joined to rows of zones and cells, and tested where these have edges: one join for few edges, one for many if there are such.

    The cells of a zone are many more rows than Spark takes them for, hence no broadcast.
    """
    few = F.col("_gl_edges").isNull() | (F.size("_gl_edges") <= UNROLLED)
    parts = [here.join(cells.where(few).hint("merge"), F.expr(SAME) & (F.col("_gl_edges").isNull() | _odd("_gl_edges", True)), how)]
    if most > UNROLLED:
        parts.append(here.join(cells.where(F.size("_gl_edges") > UNROLLED).hint("merge"), F.expr(SAME) & _odd("_gl_edges", False), how))
    return parts


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def zone_join(points: DataFrame, zones: DataFrame, ring: str = "ring", how: str = "inner") -> DataFrame:
    """Points and the zones whose ring (array of (lng, lat)) holds them; the ring is left out of the result.

    A zone is cut into cells on the grid of its size. Cells that lie inside whole give their points without a test, in
    those at its edge only the edges of the band are tested; a point looks into its cell of every grid that some zone uses.
    """
    names = [c for c in zones.columns if c not in ("_ord", "_lat", "_lng", ring)]
    _checked_names(points, names, how)
    if how != "inner":
        return _held(points, zones, ring, how)
    bands = _bands(zones, names, ring, max(3, _fineness(points) - 1))
    levels, most = _levels(bands)
    edge = F.transform("_gl_cells", lambda c: F.struct(c.alias("cell"), F.col("_gl_edges").alias("edges")))
    whole = F.transform(F.flatten(F.transform("_gl_runs", lambda r: F.sequence(r["a"], r["b"]))), lambda c: F.struct(c.alias("cell"), F.lit(None).alias("edges")))
    cells = _cover(bands).select(*names, "_gl_zx", "_gl_zy", "_gl_zb", F.explode(F.concat(edge, whole)).alias("_gl_one"))
    cells = cells.select(*names, "_gl_zx", "_gl_zy", "_gl_zb", F.col("_gl_one.cell").alias("_gl_cell"), F.col("_gl_one.edges").alias("_gl_edges"))
    spread = points if points.isStreaming else points.repartition(F.xxhash64("_lat", "_lng"))
    out = _union(_tested(_placed(spread, levels), cells, most))
    return out.drop(*(c for c in out.columns if c.startswith("_gl_")))


def _touched(cover: DataFrame, names: list[str]) -> DataFrame:
    cell = F.explode(F.transform("_gl_cells", lambda c: F.struct(c.alias("c"))))
    return cover.select(*names, "_gl_zx", "_gl_zy", "_gl_zb", cell.alias("_gl_one"), "_gl_edges").withColumn("_gl_cell", F.col("_gl_one.c")).drop("_gl_one")


def _ends(cover: DataFrame, names: list[str], first: int, last: int, signs: tuple[int, int]) -> DataFrame:
    """Two rows a run of inner cells: its first cell plus ``first`` and its last plus ``last``, with their signs."""
    ends = F.flatten(F.transform("_gl_runs", lambda r: F.array(F.struct((r["a"] + first).alias("at"), F.lit(signs[0]).cast("long").alias("sign")), F.struct((r["b"] + last).alias("at"), F.lit(signs[1]).cast("long").alias("sign")))))
    one = cover.select(*names, F.col("_gl_zx").alias("_gl_x"), F.col("_gl_zy").alias("_gl_y"), F.col("_gl_zb").alias("_gl_b"), F.explode(ends).alias("_gl_e"))
    return one.select(*names, "_gl_x", "_gl_y", "_gl_b", F.col("_gl_e.at").alias("_gl_c"), F.col("_gl_e.sign").alias("_gl_sign"))


def _held(points: DataFrame, zones: DataFrame, ring: str, how: str) -> DataFrame:
    """Points in some zone (left_semi) or none (left_anti), chosen by their places.

    Runs of inner cells are counted along each band, so the places they cover are found without a pair of place and zone;
    only the others are tested.
    """
    from pyspark.sql import Window

    places = points.where("_lat is not null and _lng is not null").select("_lat", "_lng").distinct()
    bands = _bands(zones, [], ring, _fineness(points))
    levels, most = _levels(bands)
    cover = _cover(bands)
    ends = _ends(cover, [], 0, 1, (1, -1)).groupBy("_gl_x", "_gl_y", "_gl_b", "_gl_c").agg(F.sum("_gl_sign").alias("_gl_sign"))
    along = Window.partitionBy("_gl_x", "_gl_y", "_gl_b").orderBy("_gl_c").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = _placed(places, levels).unionByName(ends, allowMissingColumns=True).withColumn("_gl_n", F.sum("_gl_sign").over(along))
    sure = cut(met.where("_gl_sign is null and _gl_n > 0").select(F.col("_lat").alias("_gl_a"), F.col("_lng").alias("_gl_o")).distinct())
    rest = cut(places.join(sure, F.expr("_lat = _gl_a and _lng = _gl_o"), "left_anti"))
    left = _placed(rest, levels)
    cells = left.select("_gl_x", "_gl_y", "_gl_b", F.col("_gl_c")).distinct()
    near = _touched(cover, [])
    if cells.count() <= FEW_CELLS:
        near = near.join(F.broadcast(cells), F.expr("_gl_x = _gl_zx and _gl_y = _gl_zy and _gl_b = _gl_zb and _gl_c = _gl_cell"), "left_semi")
    more = [p.select(F.col("_lat").alias("_gl_a"), F.col("_lng").alias("_gl_o")) for p in _tested(left, near, most, "left_semi")]
    hit = _union([sure, _union(more).distinct()])
    return points.join(hit, F.expr("_lat = _gl_a and _lng = _gl_o"), how)


def zone_counts(points: DataFrame, zones: DataFrame, key: str, ring: str = "ring") -> DataFrame:
    """How many points each zone holds; zones without any are left out.

    Points are counted by cell and added up along each band, so a run of inner cells is the difference of two sums;
    only points in cells at a zone's edge meet that zone.
    """
    from pyspark.sql import Window

    _checked_names(points, [c for c in zones.columns if c not in ("_ord", "_lat", "_lng", ring)], "inner")
    places = points.where("_lat is not null and _lng is not null").groupBy("_lat", "_lng").agg(F.count("*").alias("_gl_n"))
    bands = _bands(zones, [key], ring, _fineness(points))
    levels, most = _levels(bands)
    cover, here = _cover(bands), _placed(places, levels)
    parts = [p.groupBy(key).agg(F.sum("_gl_n").alias("n_points")) for p in _tested(here, _touched(cover, [key]), most)]
    by_cell = here.groupBy("_gl_x", "_gl_y", "_gl_b", "_gl_c").agg(F.sum("_gl_n").alias("_gl_n"))
    along = Window.partitionBy("_gl_x", "_gl_y", "_gl_b").orderBy("_gl_c").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    met = _ends(cover, [key], -1, 0, (-1, 1)).unionByName(by_cell, allowMissingColumns=True).withColumn("_gl_sum", F.sum("_gl_n").over(along))
    parts.append(met.where("_gl_sign is not null").groupBy(key).agg(F.sum(F.col("_gl_sign") * F.coalesce("_gl_sum", F.lit(0))).alias("n_points")))
    return _union(parts).groupBy(key).agg(F.sum("n_points").alias("n_points")).where("n_points > 0")


def knn_join(points: DataFrame, key: str, centers: DataFrame, center_key: str, k: int = 1, unit: str = "km") -> DataFrame:
    """(key, center_key, _distance, rank) of the ``k`` nearest centers of each point; ties by ``center_key``.

    Every row of ``points`` is a point of its own, also where keys repeat or are null; those without coordinates have no center.

    Rings of growing radius: points that have ``k`` centers in a ring are done, the others go on with a larger one,
    until the ring is the whole globe. The first radius follows from the number of centers.
    """
    from pyspark.sql import Window

    todo = cut(points.where("_lat is not null and _lng is not null").select(key, "_lat", "_lng", F.monotonically_increasing_id().alias("_gl_row")))
    there = centers.select(center_key, "_lat", "_lng")
    n = there.count()
    radius = min(FARTHEST_KM, 2 * EARTH_RADIUS_KM * math.sqrt(2.0 * k / max(n, 1)))
    w = Window.partitionBy("_gl_row").orderBy("_distance", center_key)
    parts = []
    while True:
        last = radius >= FARTHEST_KM
        met = radius_join(todo, there, radius * per_km(unit), unit)
        met = met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        if last:
            parts.append(met.select(key, center_key, "_distance", "rank"))
            break
        met = cut(met.select("_gl_row", key, center_key, "_distance", "rank"))
        full = met.where(F.col("rank") == k).select(F.col("_gl_row").alias("_gl_k"))
        parts.append(met.join(full, F.col("_gl_row") == F.col("_gl_k"), "left_semi").drop("_gl_row"))
        todo = cut(todo.join(full, F.col("_gl_row") == F.col("_gl_k"), "left_anti"))
        if todo.isEmpty():
            break
        radius = min(FARTHEST_KM, 2 * radius)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
