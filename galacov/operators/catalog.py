"""Cleaning, weighting and placing the points of a catalog."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galacov.functions import cosmology, geometry


def redshift_cut(points: DataFrame, low: float, high: float, z: str = "z") -> DataFrame:
    """low <= z < high; the condition reaches the scan."""
    return points.where((F.col(z) >= low) & (F.col(z) < high))


def status_mask(points: DataFrame, mask: int, status: str = "status") -> DataFrame:
    """Rows whose status has all bits of the mask."""
    return points.where(F.col(status).bitwiseAND(F.lit(mask)) == mask)


def parse_fkp(text: str) -> bool | tuple[float, str]:
    """'P0,NZ' is a number and a column; otherwise a yes or no."""
    if "," in text:
        p0, _, nz = text.partition(",")
        return float(p0), nz
    return text.strip().lower() in ("1", "true", "yes", "y", "t", "on")


def weighted(points: DataFrame, weight: str | None = None, fkp: bool | tuple[float, str] = False, fkp_weight: str = "w_fkp") -> DataFrame:
    """With w: 1 where there is no weight, times the optimal weight, given or from a density n(z)."""
    w = F.lit(1.0) if weight is None else F.coalesce(F.col(weight), F.lit(1.0))
    if isinstance(fkp, tuple):
        w = w / (1 + F.lit(float(fkp[0])) * F.col(fkp[1]))
    elif fkp:
        w = w * F.col(fkp_weight)
    return points.withColumn("w", w)


def normalised(points: DataFrame, w: str = "w") -> DataFrame:
    """Weights that sum to 1. The total is one row, joined to every task; no window over the whole table."""
    total = points.agg(F.sum(w).alias("__total"))
    return points.crossJoin(F.broadcast(total)).withColumn(w, F.col(w) / F.col("__total")).drop("__total")


def inverted(points: DataFrame, w: str = "w") -> DataFrame:
    return points.withColumn(w, -F.col(w))


def balanced(points: DataFrame, w: str = "w") -> DataFrame:
    """Negative weights scaled so that all sum to 0; needs weights of both signs."""
    sums = points.agg(F.sum(F.when(F.col(w) > 0, F.col(w))).alias("__pos"), F.sum(F.when(F.col(w) < 0, F.col(w))).alias("__neg"))
    out = points.crossJoin(F.broadcast(sums))
    failed = F.raise_error(F.lit("balancing needs weights of both signs")).cast("double")
    scaled = F.when(F.col("__pos").isNull() | F.col("__neg").isNull(), failed).when(F.col(w) < 0, F.col(w) * (-F.col("__pos") / F.col("__neg"))).otherwise(F.col(w))
    return out.withColumn(w, scaled).drop("__pos", "__neg")


def rescaled(points: DataFrame, factor: float, box: float = 1.0) -> DataFrame:
    """Coordinates times a factor; a factor that is not positive means the box's side."""
    f = F.lit(float(factor if factor > 0 else box))
    return points.withColumns({c: F.col(c) * f for c in ("x", "y", "z")})


def sky_to_cartesian(ra: Column, dec: Column, distance: Column) -> list[Column]:
    theta, phi = F.radians(F.lit(90.0) - dec), F.radians(ra)
    return [distance * F.sin(theta) * F.cos(phi), distance * F.sin(theta) * F.sin(phi), distance * F.cos(theta)]


def sky_catalog_to_xyz(points: DataFrame, om: float = cosmology.OMEGA_M, ok: float = cosmology.OMEGA_K, w: float = cosmology.W) -> DataFrame:
    """(ra, dec, z) to x, y, z in Mpc/h."""
    far = points.withColumn("__d", cosmology.comoving_distance(F.col("z"), om, ok, w))
    x, y, z = sky_to_cartesian(F.col("ra"), F.col("dec"), F.col("__d"))
    return far.withColumns({"x": x, "y": y, "z": z}).drop("__d")


def cartesian_to_sky(x: Column, y: Column, z: Column) -> list[Column]:
    """ra in [0, 360), dec, distance."""
    r = geometry.separation(x, y, z)
    ra = F.degrees(F.atan2(y, x))
    return [F.when(ra < 0, ra + 360).otherwise(ra), F.lit(90.0) - F.degrees(F.acos(z / r)), r]


def positions(points: DataFrame, kind: str) -> DataFrame:
    """x, y, z from columns of one of the three position formats: rdd (ra, dec, distance), xyz, pos (an array)."""
    if kind == "xyz":
        return points
    if kind == "pos":
        return points.withColumns({c: F.col("pos")[i] for i, c in enumerate("xyz")})
    if kind == "rdd":
        x, y, z = sky_to_cartesian(F.col("ra"), F.col("dec"), F.col("distance"))
        return points.withColumns({"x": x, "y": y, "z": z})
    raise ValueError(f"position type {kind}")


def hashed(key: Column, seed: str) -> Column:
    """A 32-bit whole number from md5, the same in any engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 8), 16, 10).cast("long")


def half(points: DataFrame, key: str = "id", seed: str = "half") -> DataFrame:
    return points.withColumn("half", (hashed(F.col(key), seed) % 2).cast("int"))


def subset(points: DataFrame, n: int, key: str = "id", seed: str = "subset", buckets: int = 4096) -> DataFrame:
    """Exactly n rows (or all), those of the smallest hashes. Counts by hash range tell the range that the n-th row lies in:
    rows below it all stay, and only its own are sorted."""
    h = hashed(F.col(key), seed)
    width = (1 << 32) // buckets
    counts = points.groupBy(F.floor(h / width).cast("int").alias("b")).agg(F.count("*").alias("n")).orderBy("b").collect()  # `buckets` rows at most
    left = n
    for r in counts:
        if r["n"] >= left:
            break
        left -= r["n"]
    else:
        return points
    low, high = r["b"] * width, (r["b"] + 1) * width
    last = points.where((h >= low) & (h < high)).orderBy(h, F.col(key)).limit(left)
    return points.where(h < low).unionByName(last)


def bounding_box(tables: list[DataFrame]) -> DataFrame:
    """One row over all tracers: the smallest corner and the sides."""
    every = tables[0].select("x", "y", "z")
    for t in tables[1:]:
        every = every.unionByName(t.select("x", "y", "z"))
    ends = every.agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    return ends.select(*[f"{c}_min" for c in "xyz"], *[(F.col(f"{c}_max") - F.col(f"{c}_min")).alias(f"{c}_size") for c in "xyz"])


def cuboid(sizes: tuple[float, float, float], nside: int, safety: float = 1 + 1 / 4096) -> tuple[float, tuple[int, int, int]]:
    """Cell side and cells along each axis: the longest side, a little enlarged, gets nside cells."""
    cell = max(sizes) * safety / nside
    return cell, tuple(max(1, math.ceil(s * safety / cell)) for s in sizes)


def cells(points: DataFrame, cell: float, corner: tuple[float, float, float] = (0.0, 0.0, 0.0), periodic: int | None = None) -> DataFrame:
    """With the whole numbers cx, cy, cz of each point's cell."""
    def index(c: str, low: float) -> Column:
        i = F.floor((F.col(c) - F.lit(float(low))) / F.lit(float(cell))).cast("long")
        return F.pmod(i, F.lit(periodic)) if periodic else i

    return points.withColumns({f"c{c}": index(c, low) for c, low in zip("xyz", corner, strict=True)})


def histogram(celled: DataFrame) -> DataFrame:
    """Per filled cell: points, points of each half, sums of weights by sign."""
    return celled.groupBy("cx", "cy", "cz").agg(
        F.count("*").alias("np"), F.sum(F.when(F.col("half") == 0, 1).otherwise(0)).alias("np1"), F.sum(F.when(F.col("half") == 1, 1).otherwise(0)).alias("np2"),
        F.sum(F.when(F.col("w") >= 0, F.col("w")).otherwise(0.0)).alias("w_pos"), F.sum(F.when(F.col("w") < 0, F.col("w")).otherwise(0.0)).alias("w_neg"))


def numbered(celled: DataFrame) -> DataFrame:
    """Each point's number inside its cell and its cell's start in cell order. Starts are running sums over slabs of
    cells (one x each) and then inside a slab, so no task sorts all cells."""
    filled = celled.groupBy("cx", "cy", "cz").agg(F.count("*").alias("np"))
    slabs = filled.groupBy("cx").agg(F.sum("np").alias("n"))
    before = Window.orderBy("cx").rowsBetween(Window.unboundedPreceding, -1)
    slabs = slabs.select("cx", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("slab"))
    inside = Window.partitionBy("cx").orderBy("cy", "cz").rowsBetween(Window.unboundedPreceding, -1)
    starts = filled.withColumn("in_slab", F.coalesce(F.sum("np").over(inside), F.lit(0))).join(slabs, "cx")
    starts = starts.select("cx", "cy", "cz", "np", (F.col("slab") + F.col("in_slab")).alias("start"))
    own = F.row_number().over(Window.partitionBy("cx", "cy", "cz").orderBy("id")) - 1
    return celled.withColumn("pos", own).join(starts, ["cx", "cy", "cz"])


def tuned_nside(points: DataFrame, nside: int, tries: int = 3, least: float = 2, most: float = 16) -> tuple[int, float]:
    """An odd number of cells for which the mean of filled cells lies in [least, most]; each try is one aggregation."""
    ends = bounding_box([points]).first()
    corner, sizes = tuple(ends[f"{c}_min"] for c in "xyz"), tuple(ends[f"{c}_size"] for c in "xyz")
    for _ in range(tries + 1):
        nside += 1 - nside % 2
        cell, _ = cuboid(sizes, nside)
        mean = cells(points, cell, corner).groupBy("cx", "cy", "cz").count().agg(F.avg("count")).first()[0]
        if least <= mean <= most:
            return nside, mean
        nside = max(1, int(nside * (mean / math.sqrt(least * most)) ** (1 / 3)))
    raise ValueError(f"no grid in {tries} tries: {mean:.3g} points in a filled cell")


def compact_jackknives(points: DataFrame, known: DataFrame, label: str = "jack") -> DataFrame:
    """Labels as dense numbers in the order of the known ones; a point with an unknown label is an error."""
    dense = known.select(F.col(label).alias("__label")).distinct()
    dense = dense.withColumn("__dense", F.dense_rank().over(Window.orderBy("__label")) - 1)
    out = points.join(F.broadcast(dense), F.col(label) == F.col("__label"), "left")
    checked = F.coalesce(F.col("__dense"), F.raise_error(F.concat(F.lit("unknown jackknife region "), F.col(label).cast("string"))).cast("int"))
    return out.withColumn(label, checked).drop("__label", "__dense")


def same_labels(a: DataFrame, b: DataFrame, label: str = "jack") -> bool:
    """Whether two tables have the same set of labels."""
    x, y = a.select(label).distinct(), b.select(label).distinct()
    return x.exceptAll(y).union(y.exceptAll(x)).limit(1).count() == 0


def healpix_ring(x: Column, y: Column, z: Column, nside: int) -> Column:
    """Pixel number in the RING scheme of the direction (x, y, z), from the published formulas (Gorski et al., 2005)."""
    r = geometry.separation(x, y, z)
    c = z / r
    phi = F.atan2(y, x)
    tt = F.pmod(phi / F.lit(math.pi / 2), F.lit(4.0))
    n, n4, total = F.lit(nside), 4 * nside, 12 * nside * nside
    up = F.floor(nside * (0.5 + tt) - nside * 0.75 * c).cast("long")
    down = F.floor(nside * (0.5 + tt) + nside * 0.75 * c).cast("long")
    ring = n + 1 + up - down
    shift = F.when(ring % 2 == 0, 1).otherwise(0)
    place = F.pmod(F.floor((up + down - n + shift + 1) / 2).cast("long"), F.lit(n4))
    belt = 2 * nside * (nside - 1) + (ring - 1) * n4 + place
    tp = tt - F.floor(tt)
    rest = nside * F.sqrt(3 * (1 - F.abs(c)))
    cap = F.floor(tp * rest).cast("long") + F.floor((1 - tp) * rest).cast("long") + 1
    turn = F.pmod(F.floor(tt * cap).cast("long"), 4 * cap)
    caps = F.when(c > 0, 2 * cap * (cap - 1) + turn).otherwise(F.lit(total) - 2 * cap * (cap + 1) + turn)
    return F.when(F.abs(c) <= 2 / 3, belt).otherwise(caps).cast("long")


def nearest_region(points: DataFrame, centres: DataFrame) -> DataFrame:
    """jack: the centre (jack, ux, uy, uz) nearest in angle. There are as many centres as regions; they travel as one
    array, and a point picks its own without a join."""
    table = centres.agg(F.collect_list(F.struct("jack", "ux", "uy", "uz")).alias("__c"))
    r = geometry.separation(F.col("x"), F.col("y"), F.col("z"))
    own = points.crossJoin(F.broadcast(table))
    scored = F.transform("__c", lambda c: F.struct((-(c["ux"] * F.col("x") + c["uy"] * F.col("y") + c["uz"] * F.col("z")) / r).alias("d"), c["jack"].alias("jack")))
    return own.withColumn("jack", F.array_min(scored)["jack"]).drop("__c")


def kmeans_regions(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """k angular regions by k-means over unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    r = geometry.separation(F.col("x"), F.col("y"), F.col("z"))
    unit = points.withColumns({f"u{c}": F.col(c) / r for c in "xyz"})
    model = KMeans(k=k, seed=seed, featuresCol="__u").fit(VectorAssembler(inputCols=["ux", "uy", "uz"], outputCol="__u").transform(unit))
    found = [(i, *map(float, c)) for i, c in enumerate(model.clusterCenters())]
    return nearest_region(points, points.sparkSession.createDataFrame(found, "jack int, ux double, uy double, uz double"))


def uniform_points(spark, n: int, box: float, seed: str = "uniform") -> DataFrame:
    """n points in a cube, from hashes of their numbers."""
    ids = spark.range(n)
    return ids.withColumns({c: hashed(F.col("id"), f"{seed}-{c}") / F.lit(2.0**32) * F.lit(float(box)) for c in "xyz"}).withColumn("w", F.lit(1.0))
