"""Sums over pairs and tuples by blocks: brute force, both plans, and no row for a pair."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from galacov.operators import blocks, catalog, jackknife, pairs, power, terms, triples, tuples
from galacov.plans import pair_queries, term_queries

BINS = pairs.Bins(((5.0, 15.0), (15.0, 30.0)), n_mu=2)


def cloud(n=120, seed=5, side=90.0):
    """Points with copies at the same place, and weights and regions that may be missing."""
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, side, (n, 3)) + 300
    xyz[n - 6 :] = xyz[:6]
    return xyz, 1 + rng.integers(0, 4, n) / 8, rng.integers(-1, 3, n)


def frame(spark, xyz, w, jack, lost=()):
    rows = [(i, *map(float, p), None if i in lost else float(a), None if i in lost else int(j)) for i, (p, a, j) in enumerate(zip(xyz, w, jack))]
    return spark.createDataFrame(rows, "id long, x double, y double, z double, w double, jack int")


def flat_table(a, b, box=None):
    d = a[:, None] - b[None]
    if box:
        d = d - box * np.round(d / box)
    s = np.sqrt((d**2).sum(-1))
    with np.errstate(all="ignore"):
        mu = np.abs(d[..., 2]) / s if box else np.abs((d * (a[:, None] + b[None])).sum(-1)) / (s * np.sqrt(((a[:, None] + b[None]) ** 2).sum(-1)))
    r = np.where((s >= 5) & (s < 15), 0, np.where((s >= 15) & (s < 30), 1, -1))
    return np.where(r >= 0, r * 2 + np.minimum((np.nan_to_num(mu) * 2).astype(int), 1), -1)


@pytest.mark.parametrize("sent", [blocks.SENT, 0])
@pytest.mark.parametrize("box", [None, 95.0, 61.0])
def test_counts(spark, monkeypatch, sent, box):
    """Of one catalog and of two, in a box and not, with the points sent whole and by cells; also with less than three cells
    along the box."""
    monkeypatch.setattr(blocks, "SENT", sent)
    xyz, w, j = cloud()
    p = frame(spark, xyz, w, j, lost=(3, 50))
    whole = np.where(np.isin(np.arange(len(w)), (3, 50)), 0, w)
    flat = flat_table(xyz, xyz, box)
    np.fill_diagonal(flat, -1)
    for table, f, v in ((pairs.count(p, None, BINS, box), flat, whole[:, None] * whole[None]),
                        (pairs.count(p.where("id < 60"), p.where("id >= 60"), BINS, box), flat[:60, 60:], whole[:60, None] * whole[None, 60:])):
        got = {r["r_bin"] * 2 + r["mu_bin"]: (r["npairs"], r["wpairs"]) for r in table.collect()}
        assert got == {k: ((f == k).sum(), v[f == k].sum()) for k in range(4)}


@pytest.mark.parametrize("sent", [blocks.SENT, 0])
def test_regions(spark, monkeypatch, sent):
    """Counts by region, of any labels and none, within a catalog and across; halves by the other plan."""
    monkeypatch.setattr(blocks, "SENT", sent)
    xyz, w, j = cloud()
    p = frame(spark, xyz, w, j)
    flat = flat_table(xyz, xyz)
    np.fill_diagonal(flat, -1)
    v = w[:, None] * w[None] / 2
    for table, rows, cols in ((jackknife.pair_counts(p, BINS), slice(None), slice(None)), (jackknife.cross_counts(p.where("id < 60 and jack != 2"), p.where("id >= 60"), BINS), slice(0, 60), slice(60, None))):
        want, f, h = {}, flat[rows, cols].copy(), v[rows, cols]
        ja, jb = j[rows], j[cols]
        if len(ja) == 60:
            f[ja == 2] = -1
        for a, b in np.argwhere(f >= 0):
            for k in (ja[a], jb[b]):
                key = (k, f[a, b])
                want[key] = want.get(key, 0) + h[a, b]
        assert {(r["jack"], r["r_bin"] * 2 + r["mu_bin"]): r["value"] for r in table.collect()} == want
    lost = frame(spark, xyz, w, j, lost=(4, 9))
    for q in (p, lost):
        q = catalog.half(q)
        one = {tuple(r)[:3]: tuple(r)[3:] for r in jackknife.half_counts(q, BINS, lambda s, m: 40.0 / (s * s), arrays=True).collect()}
        two = {tuple(r)[:3]: tuple(r)[3:] for r in jackknife.half_counts(q, BINS, lambda s, m: 40.0 / (s * s)).collect()}
        assert set(one) == set(two)
        for k, x in one.items():
            assert x == two[k] or x == pytest.approx(two[k], rel=1e-12), k


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_row_for_a_pair(spark, sf):
    """Counts are plans without a join of points by cells: pairs stay in their task."""
    for name in ("pair_counts", "pair_counts_periodic", "xi_natural", "wrap_mu", "fix_negative_bins", "skip_radial_bins", "jack_pair_counts", "jack_data_cov", "jack_disconnected"):
        text = plan(pair_queries.__dict__[name](spark, sf))
        assert "MapInArrow" in text and "cx#" not in text, name


def test_a_crowd_at_one_place(spark):
    """Most points in one cell: leaves stay small, and tasks share them."""
    rng = np.random.default_rng(1)
    xyz = np.concatenate([rng.uniform(0, 1, (3000, 3)), rng.uniform(0, 30, (50, 3))]) + 100
    c = blocks.Cloud({"id": np.arange(3050), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "w": np.ones(3050), "valid": np.ones(3050, bool)}, 64)
    assert np.diff(c.start).max() <= 64 and c.own == len(c.start) - 1 and sorted(c.id.tolist()) == list(range(3050))
    flat = flat_table(xyz, xyz)
    np.fill_diagonal(flat, -1)
    got = pairs.count(frame(spark, xyz, np.ones(3050), np.zeros(3050)), None, BINS).collect()
    assert {r["r_bin"] * 2 + r["mu_bin"]: r["npairs"] for r in got} == {k: (flat == k).sum() for k in range(4)}


def xi_of(s, mu):
    """Of columns or arrays; it has an angle, so that mu has to be right."""
    return 40.0 / (s * s) * (1 + 0.5 * mu * mu)


def close(got, want, rel=1e-9):
    assert set(got) == set(want) and len(got)
    scale = max(map(abs, want.values()))
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=rel, abs=rel * scale), k


def values(df):
    keys = [c for c in df.columns if c != "value"]
    return {tuple(r[k] for k in keys): r["value"] for r in df.collect()}


@pytest.mark.parametrize("sent", [blocks.SENT, 0])
@pytest.mark.parametrize("n, side", [(60, 60.0), (24, 58.0)])
def test_terms(spark, monkeypatch, sent, n, side):
    """Three and four points as the joins of tables of tuples give them, in bins and moments, plain and with regions; with copies
    at one place, a weight of 0, and so few points that groups stay empty."""
    monkeypatch.setattr(blocks, "SENT", sent)
    xyz, w, j = cloud(n, side=side)
    w[2] = 0
    p = frame(spark, xyz, w, j).cache()
    leg, link = terms.legs(p, BINS, xi_of, carry=("w", "jack")), terms.links(p, 25.0, xi_of)
    bins, volumes = tuples.binned(BINS), [2.0, 3.0]
    small = dict(leaf=8)
    three, four = tuples.sums(p, bins, 25.0, xi_of, False, **small), tuples.sums(p, bins, 25.0, xi_of, True, **small)
    by_bin = lambda t, v: values(t.groupBy("a", "b").agg(F.sum(v).alias("value")))
    w3, w4 = F.col("w_i") * F.col("w_j") * F.col("w_j") * F.col("w_k") * F.col("x"), F.col("w_i") * F.col("w_j") * F.col("w_k") * F.col("w_l") * F.col("x") * F.col("y")
    t3, t4 = terms.triples(leg, link, ("w", "jack")).cache(), terms.quads(leg, link, ("w", "jack")).cache()
    for got, t, v in ((three, t3, w3), (four, t4, w4)):
        close(values(got.where("kind = 0 and n > 0").select("a", "b", "value")), by_bin(t, v))
    weight = jackknife.flat(jackknife.weights(jackknife.pair_counts(p, BINS)), BINS.n_mu).select("jack", "bin", "weight")
    weight = spark.createDataFrame(weight.collect(), weight.schema)
    products = jackknife.product_weights(weight)
    for is_four, join in ((False, terms.c3_jack), (True, terms.c4_jack)):
        got = tuples.sums(p, bins, 25.0, xi_of, is_four, regions=True, **small)
        close(values(tuples.jackknifed(got, weight, products, is_four)), values(join(leg, link, weight, products)))
    phi = lambda r, mu: 1.0 + 0.25 * mu
    moments = tuples.accumulated(BINS, 2, phi, volumes)
    for is_four, t, v in ((False, t3, w3), (True, t4, w4)):
        got = tuples.moments(tuples.sums(p, moments, 25.0, xi_of, is_four, **small).where("kind = 0 and n > 0"), 2)
        close(values(got), values(terms.accumulated(t, v, 2, phi, volumes)))


def test_two_points(spark):
    xyz, w, j = cloud()
    p = frame(spark, xyz, w, j)
    leg = terms.legs(p, BINS, xi_of, carry=("w", "jack"))
    close(values(tuples.two(p, tuples.binned(BINS), xi_of).select(F.col("g").alias("a"), F.col("v0").alias("value"))), values(terms.c2(leg)))
    phi, volumes = (lambda r, mu: 1.0 + 0.25 * mu), [2.0, 3.0]
    v = 2 * F.col("w_i") * F.col("w_i") * F.col("w_j") * F.col("w_j") * (1 + F.col("xi"))
    got = tuples.moments(tuples.spread(tuples.two(p, tuples.accumulated(BINS, 2, phi, volumes), xi_of), 2), 2)
    close(values(got), values(terms.accumulated(leg, v, 2, phi, volumes, ("r_bin", "mu"))))
    shells, coef = [(0.05, 0.1), (0.1, 0.4)], (1.0, 0.01, 0.0, 0.125, 0.0, 0.0, 0.0, 0.0, 0.0001)
    got = power.placed(tuples.spread(tuples.two(p, power.leg_of(BINS, 28.0, shells, 2, coef), xi_of), 4), 2)
    close(values(got), values(power.two_point_term(leg, 28.0, shells, 2, coef=F.array(*map(F.lit, coef)))))


def test_shell_table():
    """The table is the quadrature's value, and that of l = 0 the closed form."""
    r = np.linspace(0.01, 60, 777)
    for l, lo, hi in ((0, 0.05, 0.1), (2, 0.1, 0.2), (4, 0.3, 0.5)):
        assert np.abs(power.shell_table(l, lo, hi, 60.0)(r) - power.shell_mean(l, lo, hi, r)).max() < 1e-13
    f = lambda x: np.sin(x) - x * np.cos(x)
    assert np.abs(power.shell_table(0, 0.05, 0.1, 60.0)(r[99:]) - 3 * (f(0.1 * r) - f(0.05 * r))[99:] / (r[99:] ** 3 * (0.1**3 - 0.05**3))).max() < 1e-12


@pytest.mark.parametrize("sent", [blocks.SENT, 0])
def test_triangles(spark, monkeypatch, sent):
    monkeypatch.setattr(blocks, "SENT", sent)
    xyz, w, j = cloud(70, side=60.0)
    p = frame(spark, xyz, w, j)
    bins = pairs.Bins(BINS.edges, 4, -1.0, 1.0)
    near = lambda s: 0 if 5 <= s < 15 else 1
    want, two = {}, {}
    for t in itertools.combinations(range(70), 3):
        s = {frozenset(q): np.linalg.norm(xyz[q[0]] - xyz[q[1]]) for q in itertools.combinations(t, 2)}
        if not all(5 <= v < 30 for v in s.values()):
            continue
        own, v = [], w[list(t)].prod()
        for c in t:
            o1, o2 = (q for q in t if q != c)
            a, b, far = s[frozenset((c, o1))], s[frozenset((c, o2))], s[frozenset((o1, o2))]
            own.append((*sorted((near(a), near(b))), min(int(((a * a + b * b - far * far) / (2 * a * b) + 1) / 0.5), 3)))
        for c in own:
            want[c] = (want.get(c, (0, 0))[0] + 1, want.get(c, (0, 0))[1] + 2 * v)
            for c2 in own:
                two[(*c, *c2)] = two.get((*c, *c2), 0) + v * v * (9 + 9 * sum(40 / x**2 for x in s.values()))
    assert {(r["r1"], r["r2"], r["mu_bin"]): (r["n"], r["rrr"]) for r in triples.counts(p, bins).collect()} == want
    got = triples.three_point_term(p, bins, lambda s, mu: 40.0 / (s * s))
    close({(r["r1"], r["r2"], r["mu_a"], r["r3"], r["r4"], r["mu_b"]): r["value"] for r in got.collect()}, two)


def test_no_row_for_a_tuple(spark, sf):
    for name in ("c2_exact", "c2_legendre_projected", "c2_legendre_accumulated", "c3_exact", "c3_legendre_projected", "c3_legendre_accumulated", "c3_jack", "c4_exact",
                 "c4_legendre_projected", "c4_legendre_accumulated", "c4_jack", "power_c2_monopole", "power_c3_monopole", "power_c4_monopole", "triple_counts", "c3_3pcf_exact"):
        text = plan(term_queries.__dict__[name](spark, sf))
        assert "MapInArrow" in text and "cx#" not in text and "ArrowEvalPython" not in text, name


def test_a_full_block_has_pieces(spark, monkeypatch):
    """The sampler's tasks share a block with many points, with the same draws in either plan, and all points are tried."""
    from galacov.operators import sampler
    from galacov.plans import sampling_queries

    monkeypatch.setattr(sampler, "PIECE", 16)
    xyz, w, j = cloud(100)
    p = frame(spark, xyz, w, j)
    q = frame(spark, xyz + 1.0, w, j)
    own = dict(bins=BINS, xi={k: sampling_queries.xi_table() for k in ((1, 1), (1, 2), (2, 2))}, xi_cut=25.0, cell=20.0, n2=2, n3=2, n4=2, loops=2, loops_per_sample=1, second=q)
    one, two = (values(sampler.sample(p, **own, sent=sent)) for sent in (sampler.SENT, 0))
    close(one, two)
    assert sum(v for k, v in one.items() if "tried" in k) == 100 * 7 * 2 * 8
    rng = [sampler.rng_of(1, 0, 0, n).random(4).tolist() for n in (0, 1)]
    assert rng[0] != rng[1] and rng[0] == sampler.rng_of(1, 0, 0).random(4).tolist()
