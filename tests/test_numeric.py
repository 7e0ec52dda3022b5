"""Numeric steps against closed forms and brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from galacov.functions import cosmology, geometry
from galacov.functions.interpolation import CorrelationFunction
from galacov.operators import calibration, catalog, correction, covariance, jackknife, multipoles, pairs, sampler, terms
from galacov.plans import config, post_process, run

BINS = pairs.Bins(((5.0, 15.0), (15.0, 30.0)), n_mu=2)


def small(n=40, seed=3, box=60.0):
    rng = np.random.default_rng(seed)
    xyz = rng.uniform(0, box, (n, 3)) + 100
    return xyz, 1 + rng.integers(0, 4, n) / 8, rng.integers(0, 3, n)


def frame(spark, xyz, w, jack):
    return spark.createDataFrame([(i, *map(float, p), float(a), int(j)) for i, (p, a, j) in enumerate(zip(xyz, w, jack))], "id long, x double, y double, z double, w double, jack int")


def xi_np(s, mu=None):
    return 40.0 / s**2


def xi_col(s, mu):
    return F.lit(40.0) / (s * s)


def tables(xyz):
    d = xyz[:, None] - xyz[None]
    m = xyz[:, None] + xyz[None]
    s = np.sqrt((d**2).sum(-1))
    with np.errstate(all="ignore"):
        mu = np.abs((d * m).sum(-1)) / (s * np.sqrt((m**2).sum(-1)))
    a = np.full(s.shape, -1)
    for i, (lo, hi) in enumerate(BINS.edges):
        a[(s >= lo) & (s < hi)] = i
    a = np.where(a >= 0, a * 2 + np.minimum((np.nan_to_num(mu) * 2).astype(int), 1), -1)
    np.fill_diagonal(a, -1)
    return s, a


def brute(xyz, w, cut):
    s, a = tables(xyz)
    n = len(w)
    with np.errstate(divide="ignore"):
        x = np.where((s > 0) & (s < cut), xi_np(s), 0)
    full = np.where(s > 0, xi_np(np.where(s > 0, s, 1)), 0)
    c2, c3, c4 = np.zeros(4), np.zeros((4, 4)), np.zeros((4, 4))
    for i, j in itertools.permutations(range(n), 2):
        if a[i, j] < 0:
            continue
        c2[a[i, j]] += 2 * w[i] ** 2 * w[j] ** 2 * (1 + full[i, j])
        for k in range(n):
            if k in (i, j) or x[i, k] == 0:
                continue
            if a[j, k] >= 0:
                c3[a[i, j], a[j, k]] += 4 * w[i] * w[j] ** 2 * w[k] * x[i, k]
            for m in range(n):
                if m not in (i, j, k) and a[k, m] >= 0 and x[j, m]:
                    c4[a[i, j], a[k, m]] += 2 * w[i] * w[j] * w[k] * w[m] * x[i, k] * x[j, m]
    return c2, c3, c4


def test_exact_terms_against_loops(spark):
    xyz, w, j = small(24)
    p = frame(spark, xyz, w, j)
    c2, c3, c4 = brute(xyz, w, 35.0)
    leg, link = terms.legs(p, BINS, xi_col), terms.links(p, 35.0, xi_col)
    got = {r["a"]: r["value"] for r in terms.c2(leg).collect()}
    assert all(np.isclose(got.get(a, 0), c2[a]) for a in range(4))
    for table, want in ((terms.c3(leg, link), c3), (terms.c4(leg, link), c4)):
        assert np.allclose(calibration.matrix(table.toDF("row", "col", "value"), 4), want)


def test_sampled_terms_near_exact(spark):
    xyz, w, j = small(60)
    p = frame(spark, xyz, w, j)
    r = np.arange(1.0, 61.0)
    xi = CorrelationFunction(r, [0.25, 0.75], np.repeat(xi_np(r)[:, None], 2, axis=1))
    s, a = tables(xyz)
    rr = np.array([(w[:, None] * w[None])[a == b].sum() for b in range(4)])
    c2 = np.array([(2 * (w[:, None] * w[None]) ** 2 * (1 + xi_np(np.where(s > 0, s, 1))))[a == b].sum() for b in range(4)])
    got = sampler.sample(p, BINS, xi, 35.0, cell=12.0, n2=40, n3=2, n4=2, loops=64, loops_per_sample=4, seed=5).toPandas()
    for name, want in (("rr", rr), ("c2", c2)):
        per = got[got.term == name].pivot_table(index="subsample", columns="row", values="value", fill_value=0).reindex(columns=range(4), fill_value=0)
        error = per.std() / np.sqrt(len(per))
        assert (np.abs(per.mean() - want) < 5 * error + 0.02 * want).all(), (per.mean(), want, error)


def test_sampling_does_not_depend_on_partitions(spark):
    p = frame(spark, *small(50))
    r = np.arange(1.0, 61.0)
    xi = CorrelationFunction(r, [0.5], (40 / r**2)[:, None])
    one = sampler.sample(p, BINS, xi, 30.0, 12.0, loops=4, loops_per_sample=2, seed=9)
    two = sampler.sample(p.repartition(7), BINS, xi, 30.0, 12.0, loops=4, loops_per_sample=2, seed=9)
    key = ["term", "subsample", "row", "col"]
    a, b = (t.toPandas().sort_values(key).reset_index(drop=True) for t in (one, two))
    assert a[key].equals(b[key]) and np.allclose(a["value"], b["value"])


def table_of(r=np.arange(1.0, 61.0)):
    return CorrelationFunction(r, [0.25, 0.75], np.repeat(xi_np(r)[:, None], 2, axis=1))


def by_place(found, names=("term", "subsample", "row", "col")):
    return {tuple(r[n] for n in names): r["value"] for r in found.collect()}


def same_sums(one, two):
    assert one.keys() == two.keys() and all(np.isclose(v, two[k]) for k, v in one.items())


def test_blocks_with_halos_draw_the_same(spark):
    """A catalog that is sent whole and one that is dealt by block, of one or two tracers, open or periodic."""
    xyz, w, j = small(90, box=120.0)
    p, q = frame(spark, xyz, w, j), frame(spark, xyz[::-1] + 3.0, w, j)
    for how in ({}, {"second": q}, {"box": 480.0}):
        xi = {k: table_of() for k in ((1, 1), (1, 2), (2, 2))} if "second" in how else table_of()
        names = ("term", "subsample", "row", "col") + (("t1", "t2", "t3", "t4") if "second" in how else ())
        own = dict(loops=4, loops_per_sample=2, seed=9, side=6, **how)
        one = sampler.sample(p, BINS, xi, 30.0, 12.0, **own)
        same_sums(by_place(one, names), by_place(sampler.sample(p, BINS, xi, 30.0, 12.0, sent=10, **own), names))


def near(got, want, names, subsamples):
    """Means over subsamples agree with exact sums within their scatter."""
    for name, exact in want.items():
        rows = got[got.term == name]
        per = np.zeros((subsamples, *exact.shape))
        for r in rows.itertuples():
            per[r.subsample, r.row, r.col] += r.value
        error = per.std(axis=0, ddof=1) / np.sqrt(subsamples)
        assert (np.abs(per.mean(axis=0) - exact) < 5 * error + 0.03 * np.abs(exact).max()).all(), (name, per.mean(axis=0), exact, error)


def test_sampled_jackknife_terms_near_exact(spark):
    xyz, w, j = small(40)
    p = frame(spark, xyz, w, j)
    weight = jackknife.flat(jackknife.weights(jackknife.pair_counts(p, BINS)), BINS.n_mu).select("jack", "bin", "weight")
    products = jackknife.product_weights(weight)
    leg, link = terms.legs(p, BINS, xi_col, carry=("w", "jack")), terms.links(p, 35.0, xi_col)
    square = lambda t: calibration.matrix(t.toDF("row", "col", "value"), 4)
    two = terms.c2_jack(leg, weight, products).select("a", F.col("a").alias("b"), "value")
    want = {"c2j": square(two), "c3j": square(terms.c3_jack(leg, link, weight, products)), "c4j": square(terms.c4_jack(leg, link, weight, products))}
    arrays, product = sampler.jack_arrays(weight, 4)
    tensor = {((1, 1), (1, 1)): (arrays, arrays, product)}
    got = sampler.sample(catalog.half(p), BINS, table_of(), 35.0, cell=12.0, n2=30, n3=12, n4=8, loops=96, loops_per_sample=6, seed=5, jack=tensor).toPandas()
    near(got, want, want, 16)
    halves = jackknife.half_counts(catalog.half(p), BINS, xi_col).toPandas()
    for h in (0, 1):
        for name, col in (("rr", "rr"), ("ee", "ee")):
            exact = np.zeros((arrays.shape[0], 4))
            for r in halves[halves.half == h].itertuples():
                exact[r.jack, r.bin] = getattr(r, col)
            near(got, {f"{name}{h + 1}": exact}, None, 16)


def test_sampled_moments_near_exact(spark):
    xyz, w, j = small(40)
    p = frame(spark, xyz, w, j)
    leg, link = terms.legs(p, BINS, xi_col), terms.links(p, 35.0, xi_col)
    volumes = [4 * np.pi / 3 * (hi**3 - lo**3) for lo, hi in BINS.edges]
    phi = lambda r, mu: 1.0 + 0.5 * r + 0.25 * mu
    v = {"c2": 2 * F.col("w_i") ** 2 * F.col("w_j") ** 2 * (1 + F.col("xi")), "c3": 4 * F.col("w_i") * F.col("w_j") ** 2 * F.col("w_k") * F.col("x"), "c4": 2 * F.col("w_i") * F.col("w_j") * F.col("w_k") * F.col("w_l") * F.col("x") * F.col("y")}
    want = {}
    for name, t, second in (("c2", leg, ("r_bin", "mu")), ("c3", terms.triples(leg, link), ("r_b", "mu_b")), ("c4", terms.quads(leg, link), ("r_b", "mu_b"))):
        exact = np.zeros((6, 6))
        for r in terms.accumulated(t, v[name], 4, phi, volumes, second).collect():
            exact[r["r_a"] * 3 + r["p"] // 2, r["r_b"] * 3 + r["q"] // 2] = r["value"]
        want[name] = exact
    got = sampler.sample(p, BINS, table_of(), 35.0, cell=12.0, n2=30, n3=12, n4=8, loops=96, loops_per_sample=6, seed=7, legendre=(4, phi, volumes)).toPandas()
    near(got, want, want, 16)


def test_two_tracers_of_one_catalog(spark):
    """A catalog split in two: the combinations' sums, over all tracers, are those of the whole catalog."""
    xyz, w, j = small(40)
    s, a = tables(xyz)
    p = frame(spark, xyz, w, j)
    one, two = p.where("id % 2 = 0"), p.where("id % 2 = 1")
    odd = np.arange(len(w)) % 2
    xi = {k: table_of() for k in ((1, 1), (1, 2), (2, 2))}
    got = sampler.sample(one, BINS, xi, 35.0, cell=12.0, n2=40, n3=4, n4=2, loops=64, loops_per_sample=4, seed=3, second=two).toPandas()
    for t1, t2 in ((1, 1), (1, 2), (2, 2)):
        own = got[(got.t1 == t1) & (got.t2 == t2) & (got.term == "rr")]
        combos = own[["t3", "t4"]].drop_duplicates().shape[0]
        exact = np.array([(w[:, None] * w[None])[(a == b) & (odd[:, None] == t1 - 1) & (odd[None] == t2 - 1)].sum() for b in range(4)])
        mean = own.groupby("row").value.sum().reindex(range(4), fill_value=0) / 16 / combos
        assert np.allclose(mean, exact, rtol=0.1, atol=0.05 * exact.max()), (t1, t2, mean, exact)
    assert len(got[["t1", "t2", "t3", "t4"]].drop_duplicates()) == 7


def test_interpolation():
    r, mu = np.linspace(1, 60, 80), np.linspace(0.05, 0.95, 12)
    f = lambda r, m: np.exp(-r / 40) * (1 + 0.3 * m**2) / r**2 * 50
    xi = CorrelationFunction(r, mu, f(r[:, None], mu[None]))
    assert np.allclose(xi(r[5:-5], 0.5), f(r[5:-5], 0.5), rtol=2e-3)
    assert np.allclose(xi(120.0, 0.5), xi(60.0, 0.5) / 16)
    assert np.isclose(xi(0.5, 0.5), xi(0.3, 0.5))
    with pytest.raises(ValueError):
        CorrelationFunction([1, 1], [0.5], [[1], [1]])


def test_distances():
    z = np.array([0.1, 0.5, 2.0])
    assert np.allclose(cosmology.line_of_sight(z, 1.0, 0, -1), 2 * cosmology.HUBBLE_DISTANCE * (1 - 1 / np.sqrt(1 + z)))
    assert np.allclose(cosmology.line_of_sight(z, 0.0, 0, -1), cosmology.HUBBLE_DISTANCE * z)
    assert np.allclose(cosmology.transverse(z, 0.3, 1e-9), cosmology.line_of_sight(z, 0.3, 1e-9), rtol=1e-6)
    assert np.allclose(cosmology.luminosity(z) / cosmology.angular_diameter(z), (1 + z) ** 2)


def test_kernels():
    assert np.allclose(sampler.dawson(np.array([0.5, 1.0, 3.0])), [0.4244363835, 0.5380795069, 0.1782710306])
    rng = np.random.default_rng(0)
    p = np.array([0.1, 0.5, 0.0, 0.4])
    got = np.bincount(sampler.draw(sampler.alias_table(p), rng.random(200000), rng.random(200000)), minlength=4) / 200000
    assert np.allclose(got, p, atol=0.01) and got[2] == 0


def test_mu_of_one_is_in_the_last_bin(spark):
    got = spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "m double").select(geometry.uniform_bin(F.col("m"), 0, 1, 4).alias("b")).collect()
    assert [r["b"] for r in got] == [0, 2, 3]


def test_calibration_on_known_matrices():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(5, 5))
    c2, c4 = np.eye(5) * 0.5, a @ a.T + np.eye(5)
    c3 = np.diag(rng.uniform(0.1, 1, 5))
    assert np.isclose(calibration.fit_alpha(c4 + 1.3 * c3 + 1.69 * c2, c2, c3, c4), 1.3, atol=1e-5)
    assert calibration.r_inv(c4, c4) < 1e-12 and abs(calibration.kl_divergence(c4, c4)) < 1e-12 and np.isclose(calibration.chi2_reduced(c4, c4), 1)
    parts = np.array([c4 + 0.01 * (m + m.T) for m in rng.normal(size=(10, 5, 5))])
    d, psi = calibration.precision(parts, parts.mean(axis=0))
    assert np.abs(d).max() < 0.1 and calibration.effective_samples(np.eye(5) * 0.01) > 500 and psi.shape == (5, 5)
    with pytest.raises(ValueError):
        calibration.positive_definite(-np.eye(3))


def test_jackknife_counts_sum_to_all(spark):
    p = frame(spark, *small())
    own = jackknife.pair_counts(p, BINS).groupBy("r_bin", "mu_bin").agg(F.sum("value").alias("v")).collect()
    every = {(r["r_bin"], r["mu_bin"]): r["wpairs"] for r in pairs.count(p, None, BINS).collect()}
    assert all(np.isclose(r["v"], every[r["r_bin"], r["mu_bin"]]) for r in own)


def test_periodic_counts_do_not_move(spark):
    xyz, w, j = small(80, box=100.0)
    one = pairs.count(frame(spark, xyz - 100, w, j), None, BINS, box=100.0).collect()
    two = pairs.count(frame(spark, (xyz - 100 + 37.5) % 100, w, j), None, BINS, box=100.0).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_multipoles_and_back(spark):
    rows = [(r, m, 1.0 + 0.5 * r) for r in range(3) for m in range(6)]
    xi = spark.createDataFrame(rows, "r_bin int, mu_bin int, xi double")
    out = multipoles.to_multipoles(xi, multipoles.mu_factors(spark, 6, 4))
    back = multipoles.from_multipoles(out, multipoles.mu_factors(spark, 6, 4, inverse=True))
    assert all(np.isclose(r["xi"], 1 + 0.5 * r["r_bin"]) for r in back.collect())


def test_smoothing_keeps_polynomials(spark):
    r = {i: 5.0 + i for i in range(9)}
    rows = [(i, 0, (1 + 2 * i - 0.5 * i * i) / r[i] ** 2) for i in r]
    got = multipoles.smoothed(spark.createDataFrame(rows, "r_bin int, l int, xi_l double"), r, 5, 2).collect()
    want = {i: v for i, _, v in rows}
    assert all(np.isclose(x["xi_l"], want[x["r_bin"]]) for x in got)


def test_projection_is_linear(spark):
    term = spark.createDataFrame([(a, b, float(a + 2 * b)) for a in range(4) for b in range(4)], "a int, b int, value double")
    f = multipoles.mu_factors(spark, 2, 2)
    once = terms.projected(term, f, 2).collect()
    twice = terms.projected(term.withColumn("value", F.col("value") * 2), f, 2).collect()
    one = {tuple(r[:4]): r[4] for r in once}
    assert all(np.isclose(2 * one[tuple(r[:4])], r[4]) for r in twice)


def test_config_rules():
    for bad in (dict(mode="x"), dict(max_l=2), dict(mode=config.PROJECTED, max_l=3), dict(mode=config.ACCUMULATED, max_l=4, jackknife=True), dict(loops=10, loops_per_sample=3), dict(tracers=3)):
        with pytest.raises(ValueError):
            config.RunConfig(**bad)
    c = config.parse("-bins 20 60 10 -mbin 4 -n2 7 -seed 3 -loops 64".split())
    assert c.n_bins == 40 and c.n2 == 7 and c.quads((10,)) == 10 * 7 * 10 * 20 * 64


def test_post_process(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(4, 4))
    c4 = base @ base.T + 4 * np.eye(4)
    rows = []
    for s in range(6):
        noise = rng.normal(scale=0.02, size=(4, 4))
        for t, m in (("c2", np.eye(4)), ("c3", np.diag([0.5, 1, 1.5, 2.0])), ("c4", c4 + noise)):
            rows += [(t, s, r, c, float(m[r, c])) for r in range(4) for c in range(4)]
    table = spark.createDataFrame(rows, "term string, subsample int, row int, col int, value double")
    c = config.RunConfig(bins=pairs.Bins(((1.0, 2.0), (2.0, 3.0)), n_mu=2), loops=6, loops_per_sample=1)
    out = post_process.automatic(table, c)
    assert post_process.automatic(table, c, dry_run=True) == "fixed" and out.N_eff > 10
    mean = c4 + np.mean([0], axis=0) + np.diag([0.5, 1, 1.5, 2.0]) * 1.4 + np.eye(4) * 1.96
    assert abs(post_process.automatic(table, c, sample=mean).shot_noise_rescaling[0] - 1.4) < 0.1
    check = post_process.split_half_check(table, c, 1.0)
    assert check["halves"]["r_inv"][0] < 0.1
    with pytest.raises(ValueError):
        post_process.automatic(table, c, data_covariance=mean)


def test_run_end_to_end(spark):
    xyz, w, j = small(120, box=50.0)
    p = frame(spark, xyz, w, j)
    r = np.arange(1.0, 61.0)
    xi = CorrelationFunction(r, [0.5], (10 / r**2)[:, None])
    c = config.RunConfig(bins=pairs.Bins(((10.0, 20.0), (20.0, 30.0)), n_mu=1), xi_cut=30.0, loops=32, loops_per_sample=4, n2=20, n3=10, n4=10, seed=2)
    out = run.run(p, xi, c, cell=10.0)
    assert out.full_theory_covariance.shape == (2, 2) and np.linalg.eigvalsh(out.full_theory_covariance).min() > 0
    exact = run.exact_terms(catalog.normalised(p), xi_col_small, c)
    full = covariance.combined_alpha(exact, 1.0)
    want = calibration.matrix(covariance.symmetrised(full), 2)
    assert np.allclose(np.diag(out.full_theory_covariance), np.diag(want), rtol=0.35)


def test_runs_in_every_mode(spark):
    xyz, w, j = small(90, box=45.0)
    p = frame(spark, xyz, w, j)
    r = np.arange(1.0, 61.0)
    xi = CorrelationFunction(r, [0.25, 0.75], np.repeat((0.5 / r**2)[:, None], 2, axis=1))
    bins = pairs.Bins(((10.0, 20.0), (20.0, 30.0)), n_mu=2)
    own = dict(bins=bins, xi_cut=30.0, loops=16, loops_per_sample=4, n2=20, n3=8, n4=6, seed=2)
    # Jackknife: the rescaling that made the target is found again, with the disconnected part.
    c = config.RunConfig(jackknife=True, **own)
    jack = run.tensors({(1, 1): run.jackknife_weights(catalog.normalised(p), c)}, 4)
    raw = run.raw_sums(catalog.normalised(p), xi, c, 10.0, None, jack).cache()
    found = run.raw_terms(catalog.normalised(p), xi, c, jack=jack, raw=raw)
    full, parts = post_process.matrices(post_process.selected(found, c), 4)
    rr = run.vector(run.pair_counts(catalog.normalised(p), c), 4)
    extra = post_process.disconnected(raw, rr, jack[(1, 1), (1, 1)][2], c)
    target = full["c4j"] + extra.mean(axis=0) + 1.3 * full["c3j"] + 1.69 * full["c2j"]
    out = run.run(p, xi, c, data_covariance=target, cell=10.0)
    assert abs(out.shot_noise_rescaling[0] - 1.3) < 0.2 and out.jackknife_theory_covariance.shape == (4, 4)
    halves = jackknife.disconnected(jackknife.half_counts(catalog.half(catalog.normalised(p)), bins, lambda s, m: F.lit(0.5) / (s * s)), run.pair_counts(catalog.normalised(p), c), jackknife.product_weights(run.jackknife_weights(catalog.normalised(p), c)))
    exact = calibration.matrix(halves.toDF("row", "col", "value"), 4)
    # The sampled halves: exact ones through the same formula.
    counts = jackknife.half_counts(catalog.half(catalog.normalised(p)), bins, lambda s, m: F.lit(0.5) / (s * s))
    sums = None
    for h in (0, 1):
        for name in ("rr", "ee"):
            part = counts.where(F.col("half") == h).select(F.lit(f"{name}{h + 1}").alias("term"), F.lit(0).alias("subsample"), F.col("jack").alias("row"), F.col("bin").alias("col"), F.col(name).alias("value"))
            sums = part if sums is None else sums.unionByName(part)
    assert np.allclose(post_process.disconnected(sums, rr, jack[(1, 1), (1, 1)][2], c)[0], (exact + exact.T) / 2)
    # Projected and accumulated moments, and mocks.
    for mode in (config.PROJECTED, config.ACCUMULATED):
        c = config.RunConfig(mode=mode, max_l=2, norms=(2.0,), **own)
        found = run.raw_terms(catalog.normalised(p), xi, c, cell=10.0)
        full, _ = post_process.matrices(post_process.selected(found, c), 4)
        assert {"c2", "c3", "c4"} <= set(full) and all(np.isfinite(m).all() and m.any() for m in full.values())
    with pytest.raises(ValueError):
        run.run(p, xi, config.RunConfig(**own), second=p)


def test_two_tracer_run(spark):
    """Tracers of the same kind: their terms are alike."""
    xyz, w, j = small(120, box=50.0)
    p = frame(spark, xyz, w, j)
    r = np.arange(1.0, 61.0)
    xi = CorrelationFunction(r, [0.5], (10 / r**2)[:, None])
    own = dict(bins=pairs.Bins(((10.0, 20.0), (20.0, 30.0)), n_mu=1), xi_cut=30.0, loops=48, loops_per_sample=6, n2=20, n3=10, n4=6, seed=2)
    c = config.RunConfig(tracers=2, norms=(1.0, 1.0), alphas=(1.0, 1.0), **own)
    q = frame(spark, 250.0 - xyz, w, j)  # another catalog of the same kind
    found = run.raw_terms(catalog.normalised(p), {k: xi for k in run.PAIRS}, c, cell=10.0, second=catalog.normalised(q))
    parts = {k: v.mean(axis=0) for k, v in post_process.tracer_matrices(found, c).items()}
    assert {k for k in parts if k[0] == "c2"} == {("c2", x, y) for x in (1, 2) for y in (1, 2)}
    assert {k for k in parts if k[0] == "c3"} == {("c3", x, y, z) for x in (1, 2) for y in (1, 2) for z in (1, 2)}
    assert len([k for k in parts if k[0] == "c4"]) == 16
    for kind in ("c2", "c3"):
        diagonal = {k: np.diag(m) for k, m in parts.items() if k[0] == kind}
        mean = np.mean(list(diagonal.values()), axis=0)
        assert all(np.allclose(d, mean, rtol=0.6) for d in diagonal.values()), diagonal
    out = run.run(p, {k: xi for k in run.PAIRS}, c, cell=10.0, second=q)
    want = post_process.blocks_of(post_process.tracer_matrices(found, c), (1.0, 1.0)).mean(axis=0)
    assert out.full_theory_covariance.shape == (6, 6) and np.allclose(out.full_theory_covariance, want)


def xi_col_small(s, mu):
    return F.lit(10.0) / (s * s)


def test_refined_function_keeps_its_averages(spark):
    """Averages over all pairs of the refined function are the target."""
    from galacov.operators import refinement

    xyz, w, j = small(300, box=80.0)
    p = frame(spark, xyz, w, j)
    target = np.array([[1.2, 1.0], [0.5, 0.4]])
    found = refinement.refined(p, BINS, target, iterations=30)
    s, a = tables(xyz)
    d = xyz[:, None] - xyz[None]
    m = xyz[:, None] + xyz[None]
    with np.errstate(invalid="ignore", divide="ignore"):
        mu = np.abs((d * m).sum(axis=2)) / (np.sqrt((d**2).sum(axis=2)) * np.sqrt((m**2).sum(axis=2)))
    ww = w[:, None] * w[None]
    means = [(ww * found(np.where(s > 0, s, 1), np.nan_to_num(mu)))[a == b].sum() / ww[a == b].sum() for b in range(4)]
    assert np.allclose(means, target.ravel(), rtol=2e-3), means


def test_survey_correction_of_uniform_points(spark):
    """Close to 1 for separations that are small against the volume."""
    from galacov.operators import correction

    p = catalog.uniform_points(spark, 3000, 400.0).withColumn("w", F.lit(1.0))
    bins = pairs.Bins(((10.0, 25.0), (25.0, 40.0)), n_mu=6)
    d = correction.density(p, 3000.0)
    got = correction.fitted(pairs.count(p, None, bins).withColumnRenamed("wpairs", "rr"), bins, d)
    for r in got.collect():
        c = [x * d["n"] ** 2 * d["volume"] for x in r["coef"]]
        assert all(0.8 < c[0] + m * (c[1] + m * c[2]) < 1.4 for m in (0.0, 0.3, 0.6)), c


def test_errors(spark):
    p = frame(spark, *small(5))
    with pytest.raises(Exception, match="both signs"):
        catalog.balanced(p).collect()
    with pytest.raises(Exception, match="unknown jackknife"):
        catalog.compact_jackknives(p, spark.createDataFrame([(99,)], "jack int")).collect()
    assert catalog.parse_fkp("10000,NZ") == (10000.0, "NZ") and catalog.parse_fkp("true") is True


def brute_volume(p):
    """Over all triangles with every point on one side."""
    total = 0.0
    for i, j, k in itertools.combinations(range(len(p)), 3):
        n = np.cross(p[j] - p[i], p[k] - p[i])
        side = (p - p[i]) @ n
        if (side < 1e-12).all() or (side > -1e-12).all():
            total += abs(n @ (p[i] - p.mean(axis=0))) / 6
    return total


def test_hull_has_every_vertex(spark):
    rng = np.random.default_rng(8)
    for p in (rng.normal(size=(40, 3)), rng.random((40, 3)) * [1, 5, 30] + 300):
        assert np.isclose(correction.hull_volume(p), brute_volume(p), rtol=1e-9)
    lattice = np.array(list(itertools.product(range(5), repeat=3)), float)
    assert np.isclose(correction.hull_volume(lattice), 64) and correction.hull_volume(lattice[:25]) == 0
    p = rng.normal(size=(5000, 3))
    p /= np.linalg.norm(p, axis=1)[:, None]
    inner = np.concatenate([p, p * 0.6])
    df = spark.createDataFrame(inner.tolist(), "x double, y double, z double").repartition(20)
    found = correction.extremes(df)
    assert len(found) == len(p) and set(map(tuple, found)) == set(map(tuple, p))  # all on the sphere, none inside
    assert np.isclose(correction.hull_volume(found), correction.hull_volume(inner), rtol=1e-12)
