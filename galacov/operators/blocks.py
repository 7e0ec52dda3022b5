"""Sums over pairs, triples, quadruples and triangles of points, without a row for any of them.

Points are put into compact leaves of a few dozen; a task takes some leaves, finds the points within reach of each by the
leaves' boxes, and adds up there with arrays and matrix products. Only the sums leave a task, so disk and memory don't grow
with the number of tuples; time does, as the tuples are counted exactly.

Catalogs of at most `SENT` points (counted first) go to all executors whole. Of larger ones, points are copied into the
cells around their own, cells as wide as the reach, and a task gets the points of a cell with those around it.

Separations and cosines are computed in the same order of operations as the columns of operators.pairs.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most points of catalogs that are sent to all executors, about 64 bytes each.
SENT = 2_000_000
#: Numbers of an array that a task works on at once: a megabyte of doubles, which stays in a core's cache.
SOME = 1 << 17


# ---- points ----------------------------------------------------------------------------------------------------------
def halves(place: np.ndarray, rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """rows cut at medians along the widest axis until none has more than `leaf`."""
    out, open_ = [], [rows]
    while open_:
        r = open_.pop()
        if len(r) <= leaf:
            if len(r):
                out.append(r)
            continue
        p = place[:, r]
        axis = int(np.argmax(p.max(axis=1) - p.min(axis=1)))
        cut = leaf * max(1, len(r) // leaf // 2)
        order = np.argpartition(p[axis], cut)
        open_ += [r[order[cut:]], r[order[:cut]]]
    return out


class Cloud:
    """Points in the order of their leaves. rank: an order in which every pair comes once. own: how many of the leaves
    (the first ones) are the task's own."""

    def __init__(self, t: dict[str, np.ndarray], leaf: int, box: float | None = None):
        xyz = np.stack([t[c] for c in "xyz"])
        place = xyz % box if box else xyz
        whole = t.get("own")
        groups = [np.arange(xyz.shape[1])] if whole is None else [np.flatnonzero(whole), np.flatnonzero(~whole)]
        parts = [halves(place, g, leaf) for g in groups]
        self.own, leaves = len(parts[0]), [r for p in parts for r in p]
        order = np.concatenate(leaves) if leaves else np.zeros(0, np.int64)
        self.box, self.xyz = box, np.ascontiguousarray(xyz[:, order])
        self.id, self.w, self.valid = t["id"][order], t["w"][order], t["valid"][order]
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in leaves])]).astype(np.int64)
        self.low = np.array([place[:, r].min(axis=1) for r in leaves]).reshape(-1, 3)
        self.high = np.array([place[:, r].max(axis=1) for r in leaves]).reshape(-1, 3)
        self.place = self.xyz if not box else np.ascontiguousarray(place[:, order])
        self.rank = np.arange(len(order)) if whole is None else np.argsort(np.argsort(self.id, kind="stable"))
        self.last = np.array([self.rank[a:b].max() for a, b in zip(self.start, self.start[1:])], np.int64)
        for c in ("jack", "half"):
            if c in t:  # the label's number; labels in order, none last
                seen = t[f"{c}_known"][order]
                labels, code = np.unique(t[c][order][seen], return_inverse=True)
                full = np.full(len(order), len(labels))
                full[seen] = code
                setattr(self, c, full)
                setattr(self, f"{c}s", labels)

    def gaps(self, low: np.ndarray, high: np.ndarray, to_low: np.ndarray, to_high: np.ndarray) -> np.ndarray:
        """Squared distances of boxes; of a point, low is high."""
        far = np.abs((low + high) - (to_low + to_high)) / 2
        if self.box:
            far = np.minimum(far, self.box - far)
        return (np.maximum(far - (high - low + to_high - to_low) / 2, 0) ** 2).sum(axis=-1)

    def near(self, low: np.ndarray, high: np.ndarray, reach: float, after: int | None = None) -> np.ndarray:
        """Points that lie within reach of a box, of leaves that have ranks beyond `after`."""
        limit = reach**2 * (1 + 1e-9) + 1e-9
        close = self.gaps(self.low, self.high, low, high) < limit
        if after is not None:
            close &= self.last > after
        at = np.flatnonzero(close)
        if not len(at):
            return np.zeros(0, np.int64)
        rows = np.concatenate([np.arange(self.start[k], self.start[k + 1]) for k in at])
        return rows[self.within(rows, low, high, reach)]

    def within(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, reach: float) -> np.ndarray:
        p = self.place[:, rows].T
        return self.gaps(p, p, low, high) < reach**2 * (1 + 1e-9) + 1e-9


def columns_of(points: DataFrame, carry: Sequence[str], side: int) -> DataFrame:
    """Points with a place and an id; a weight that is missing is 0 and not valid."""
    here = [c for c in carry if c != "w"]
    labels = [c for n in here for c in (F.coalesce(F.col(n).cast("long"), F.lit(0)).alias(n), F.col(n).isNotNull().alias(f"{n}_known"))]
    out = points.where(" and ".join(["id is not null"] + [f"abs(cast({c} as double)) < double('Infinity')" for c in "xyz"]))
    return out.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.coalesce(F.col("w").cast("double"), F.lit(0.0)).alias("w"),
                      F.col("w").isNotNull().alias("valid"), *labels, F.lit(side).alias("side"))


def arrays(t: pa.Table) -> dict[str, np.ndarray]:
    return {c: t.column(c).to_numpy() for c in t.column_names}


def chosen(got: dict[str, np.ndarray], side: int) -> dict[str, np.ndarray]:
    return {c: v[got["side"] == side] for c, v in got.items()}


def over_leaves(left: DataFrame, right: DataFrame | None, reach: float, sums, schema: str, carry: Sequence[str] = ("w",), box: float | None = None,
                leaf: int = 64, sent: int | None = None) -> DataFrame:
    """Rows of sums: for each task sums.begin(a, b), then sums.add(state, a, b, k) for its leaves k of a, then
    sums.rows(state, a, b) -> a list of columns. a has the points of left, b those of right (or a's)."""
    spark = left.sparkSession
    points = columns_of(left, carry, 1)
    if right is not None:
        points = points.unionByName(columns_of(right, carry, 2))
    alone = cloudpickle.dumps(sums)  # it may hold functions
    names, types = zip(*[(f.split()[0], {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}[f.split()[1]]) for f in schema.split(", ")], strict=True)
    batch = lambda cols: pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=False) for c, t in zip(cols, types, strict=True)], names=list(names))
    if points.count() <= (SENT if sent is None else sent):
        got = arrays(points.toArrow())
        a = Cloud(chosen(got, 1), leaf, box)
        b = a if right is None else Cloud(chosen(got, 2), leaf, box)
        many = max(1, min(a.own, 6 * spark.sparkContext.defaultParallelism))
        whole = spark.sparkContext.broadcast((a, None if right is None else b))

        def run(batches):
            here, there = whole.value
            there, work = here if there is None else there, pickle.loads(alone)
            for rows in batches:
                for part in rows.column(0).to_pylist():  # leaves in turn, so that each task has some of every region
                    state = work.begin(here, there)
                    for k in range(part, here.own, many):
                        work.add(state, here, there, k)
                    yield batch(work.rows(state, here, there))

        return spark.range(0, many, 1, many).mapInArrow(run, schema)

    from galacov.operators import catalog, pairs

    whole = int(box // reach) if box else None
    if box and not whole:
        raise ValueError("the box is smaller than the largest distance")
    celled = catalog.cells(points, box / whole if box else reach, periodic=whole)
    celled = celled.withColumns({f"o{c}": F.col(f"c{c}") for c in "xyz"})
    copies = pairs.neighbours(celled, whole).withColumn("own", F.expr("ox = cx and oy = cy and oz = cz")).drop("home", "ox", "oy", "oz")

    def run_group(t: pa.Table) -> pa.Table:
        got, work = arrays(t.drop_columns(["cx", "cy", "cz"])), pickle.loads(alone)
        a = Cloud(chosen(got, 1), leaf, box)
        b = a if right_is_none else Cloud(chosen(got, 2), leaf, box)
        state = work.begin(a, b)
        for k in range(a.own):
            work.add(state, a, b, k)
        return pa.Table.from_batches([batch(work.rows(state, a, b))])

    right_is_none = right is None
    return copies.groupBy("cx", "cy", "cz").applyInArrow(run_group, schema)


# ---- pairs -----------------------------------------------------------------------------------------------------------
def differences(a: Cloud, i: np.ndarray | slice, b: Cloud, j: np.ndarray) -> list[np.ndarray]:
    d = [a.xyz[c, i][:, None] - b.xyz[c, j][None] for c in range(3)]
    if a.box:
        d = [x - a.box * np.round(x / a.box) for x in d]
    return d


def cosines(a: Cloud, i: np.ndarray, b: Cloud, j: np.ndarray, d: list[np.ndarray], s: np.ndarray) -> np.ndarray:
    """|cos| of the angle between a pair and its line of sight: the z axis in a box, else from the origin."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if a.box:
            return np.minimum(np.abs(d[2]) / s, 1.0)
        m = [a.xyz[c, i] + b.xyz[c, j] for c in range(3)]
        dot = d[0] * m[0] + d[1] * m[1] + d[2] * m[2]
        return np.minimum(np.abs(dot) / (np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) * np.sqrt(m[0] * m[0] + m[1] * m[1] + m[2] * m[2])), 1.0)


def met(a: Cloud, rows: np.ndarray, b: Cloud, others: np.ndarray, r_max: float, r_min: float = 0.0, once: bool = False):
    """(i, j, s, mu) in pieces: numbers in a and b of pairs with r_min <= s < r_max and s > 0, of different points where a is
    b; once: the smaller rank first."""
    step = max(1, SOME // max(1, len(rows)))
    top = float(r_max) ** 2 * (1 + 1e-12)
    for at in range(0, len(others), step):
        j = others[at : at + step]
        d = differences(a, rows, b, j)
        s2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
        hit = (s2 > 0) & (s2 < top)
        if once and b.rank[j].min() <= a.rank[rows].max():
            hit &= a.rank[rows][:, None] < b.rank[j][None]
        flat = np.flatnonzero(hit)
        if not len(flat):
            continue
        i, k = np.divmod(flat, len(j))
        i, k, s = rows[i], j[k], np.sqrt(s2.ravel()[flat])
        keep = (s >= r_min) & (s < r_max)
        if a is b:
            keep &= a.id[i] != b.id[k]
        if not keep.all():
            flat, i, k, s = flat[keep], i[keep], k[keep], s[keep]
        yield i, k, s, cosines(a, i, b, k, [x.ravel()[flat] for x in d], s)


def radial_bins(edges: Sequence[tuple[float, float]], s: np.ndarray) -> np.ndarray:
    """Bin or -1."""
    out = np.full(len(s), -1)
    for n, (lo, hi) in reversed(list(enumerate(edges))):
        out[(s >= lo) & (s < hi)] = n
    return out


def flat_bins(bins, s: np.ndarray, mu: np.ndarray) -> np.ndarray:
    """r_bin x n_mu + mu_bin, or -1."""
    r = radial_bins(bins.edges, s)
    if bins.n_mu == 1 and bins.mu_low == 0 and bins.mu_high == 1:
        return r
    with np.errstate(invalid="ignore"):
        m = np.minimum(np.floor((mu - bins.mu_low) / ((bins.mu_high - bins.mu_low) / bins.n_mu)), bins.n_mu - 1)
        inside = (r >= 0) & (mu >= bins.mu_low) & (mu <= bins.mu_high)
    return np.where(inside, r * bins.n_mu + np.where(inside, m, 0).astype(np.int64), -1)


@dataclass
class PairSums:
    """Sums over pairs by keys. each(a, i, b, j, s, mu) -> a list of (keys, values) with keys a list of (numbers, how many)
    and one number below 0 for a pair that counts nowhere; values are arrays. n counts pairs, valid those whose weights are
    both there. labels: which keys are numbers of regions or halves. same: pairs of one catalog, each met once."""

    r_max: float
    r_min: float
    same: bool
    each: Callable
    width: int
    labels: tuple = ()

    def begin(self, a: Cloud, b: Cloud) -> dict:
        return {}

    def add(self, state: dict, a: Cloud, b: Cloud, k: int) -> None:
        rows = np.arange(a.start[k], a.start[k + 1])
        others = b.near(a.low[k], a.high[k], self.r_max, int(a.rank[rows].min()) if self.same else None)
        for i, j, s, mu in met(a, rows, b, others, self.r_max, self.r_min, self.same):
            valid = a.valid[i] & b.valid[j]
            valid = None if valid.all() else valid
            for keys, values in self.each(a, i, b, j, s, mu):
                sizes = tuple(n for _, n in keys)
                code, ok = np.zeros(len(i), np.int64), None
                for v, n in keys:
                    code = code * n + v
                    ok = v >= 0 if ok is None else ok & (v >= 0)
                full = int(np.prod(sizes))
                got = [code[ok]] if not ok.all() else [code]
                pick = (lambda x: x) if ok.all() else (lambda x: x[ok])  # noqa: B023
                n = np.bincount(got[0], minlength=full)
                sums = np.stack([n, n if valid is None else np.bincount(got[0], pick(valid), full), *[np.bincount(got[0], pick(v), full) for v in values]])
                state[sizes] = state[sizes] + sums if sizes in state else sums

    def rows(self, state: dict, a: Cloud, b: Cloud) -> list:
        width = self.width
        if not state:
            return [[] for _ in range(width)]
        ((sizes, sums),) = state.items()
        at = np.flatnonzero(sums[0])
        cols = []
        for p, (size, place) in enumerate(zip(sizes, np.unravel_index(at, sizes), strict=True)):
            name = dict(self.labels).get(p)
            known = None if name is None else region_labels(name, a, b)
            cols.append(place if known is None else pa.array([known[v] if v < len(known) else None for v in place], pa.int32()))
        return [*cols, sums[0][at].astype(np.int64), sums[1][at].astype(np.int64), *[v[at] for v in sums[2:]]]


def region_labels(name: str, a: Cloud, b: Cloud) -> list[int]:
    """Labels of both catalogs, in order."""
    return np.union1d(getattr(a, f"{name}s"), getattr(b, f"{name}s")).tolist()


def region(name: str, a: Cloud, b: Cloud, c: Cloud, i: np.ndarray) -> tuple[np.ndarray, int]:
    """Numbers, among the labels of a and b, of the labels of c's points i, the last for none; and how many there are."""
    if a is b:
        return getattr(c, name)[i], len(getattr(c, f"{name}s")) + 1
    known = np.array(region_labels(name, a, b))
    own = getattr(c, f"{name}s")
    place = np.append(np.searchsorted(known, own), len(known))
    return place[getattr(c, name)[i]], len(known) + 1


def pair_sums(left: DataFrame, right: DataFrame | None, r_max: float, r_min: float, each: Callable, keys: Sequence[str], values: Sequence[str], box: float | None = None,
              carry: Sequence[str] = ("w",), labels: dict[str, str] | None = None, sent: int | None = None) -> DataFrame:
    """keys, n and values: sums over pairs, of one catalog (right is None) each once. labels: keys that are regions
    ("jack") or halves ("half"). A value is null where no pair has both weights."""
    keys = list(keys)
    schema = ", ".join([f"{k} int" for k in keys] + ["n long", "valid long"] + [f"{v} double" for v in values])
    marks = tuple((keys.index(k), v) for k, v in (labels or {}).items())
    sums = PairSums(r_max, r_min, right is None, each, len(keys) + 2 + len(values), marks)
    got = over_leaves(left, right, r_max, sums, schema, carry, box, sent=sent)
    total = got.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("valid").alias("valid"), *[F.sum(v).alias(v) for v in values])
    return total.select(*keys, "n", *[F.when(F.col("valid") > 0, F.col(v)).alias(v) for v in values])
