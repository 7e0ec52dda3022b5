"""Text and table formats there and back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from galacov.operators import covariance
from galacov.sources import binning, tables
from galacov.streaming import subsamples


def test_particles(spark, tmp_path):
    f = tmp_path / "p.txt"
    f.write_text("# x y z w j\n\n1 2 3 0.5 1\n 4 5 6 1 2\n7 8 9 2 0\n")
    got = [tuple(r) for r in tables.particles(spark, str(f), rescale=2.0, invert_after=2).orderBy("id").collect()]
    assert got == [(2.0, 4.0, 6.0, 0.5, 1, 0), (8.0, 10.0, 12.0, 1.0, 2, 1), (14.0, 16.0, 18.0, -2.0, 0, 2)]
    assert tables.particles(spark, str(f), limit=1).count() == 1
    f.write_text("1 2 3\n")
    with pytest.raises(Exception, match="fewer than 4"):
        tables.particles(spark, str(f)).collect()


def test_order_of_files_and_splits(spark, tmp_path):
    """Files by name and lines from their beginning, in however many splits."""
    for name, lo, n in (("b", 5, 400), ("a", 0, 5), ("c", 405, 20)):
        (tmp_path / f"{name}.txt").write_text("# head\n" + "".join(f"{lo + i} 0 0 1\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        got = tables.particles(spark, str(tmp_path)).collect()
        assert len(got) == 425 and all(r["x"] == r["id"] for r in got)
        (tmp_path / "m").mkdir()
        (tmp_path / "m" / "c4_n2_m1_11,11_3.txt").write_text("".join(" ".join(str(40 * r + c) for c in range(40)) + "\n" for r in range(40)))
        cells = tables.text_matrices(spark, str(tmp_path / "m")).collect()
        assert len(cells) == 1600 and all(r["value"] == 40 * r["row"] + r["col"] and r["subsample"] == 3 for r in cells)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_results_in_every_order(tmp_path):
    cov = np.arange(144.0).reshape(12, 12)
    np.savez(tmp_path / "r.npz", full_theory_covariance=cov, full_theory_D_matrix=np.eye(12) * 0.1, shot_noise_rescaling=np.array([1.1, 0.9]))
    told = []
    one = tables.load_result(str(tmp_path / "r.npz"), max_l=4, tell=told.append)
    r, l = np.divmod(np.arange(12), 3)
    want = np.zeros_like(cov)
    for i in range(12):
        for j in range(12):
            want[l[i] * 4 + r[i], l[j] * 4 + r[j]] = cov[i, j]
    assert np.array_equal(one, want) and "1.00e-01" in told[0]
    tables.export_result(str(tmp_path / "r.npz"), str(tmp_path / "cross.txt"), tracers=2, cross=True, tell=told.append)
    got, alphas = tables.read_covariance(str(tmp_path / "cross.txt"))
    assert np.array_equal(got, cov[4:8, 4:8]) and alphas == (1.1, 0.9)
    assert np.array_equal(tables.reordered(cov, 2, 2), cov[np.ix_(o := [0, 2, 1, 3, 4, 6, 5, 7, 8, 10, 9, 11], o)])
    assert tables.counts_format(["a.npy", "b.npy"]) == "npy"
    with pytest.raises(ValueError):
        tables.counts_format(["a.npy", "b.txt"])
    with pytest.raises(ValueError):
        tables.reordered(cov, 4, 2)


def test_bins(spark, tmp_path):
    binning.write(binning.hybrid(spark, 1, 100, 10, 3, 9), str(tmp_path / "b"))
    got = binning.edges(binning.read(spark, str(tmp_path / "b")))
    assert len(got) == 12 and got[0][0] == 1 and got[-1][1] == 100
    with pytest.raises(ValueError):
        binning.logarithmic(spark, 0, 10, 3)


def test_xi_file(spark, tmp_path):
    r, mu, xi = np.array([1.0, 2.0, 3.0]), np.array([0.25, 0.75]), np.arange(6.0).reshape(3, 2)
    tables.write_xi(str(tmp_path / "x"), r, mu, xi)
    assert np.allclose(tables.read_xi(str(tmp_path / "x"))[2], xi) and tables.xi_table(spark, str(tmp_path / "x")).count() == 6


def test_counts_and_weights(spark, tmp_path):
    (tmp_path / "w").write_text("3 0.1 0.2\n5 0.3 0.4\n")
    got = {(r["jack"], r["bin"]): r["weight"] for r in tables.wide(spark, str(tmp_path / "w")).collect()}
    assert got == {(3, 0): 0.1, (3, 1): 0.2, (5, 0): 0.3, (5, 1): 0.4}
    (tmp_path / "c").write_text("5\n6\n7\n")
    assert [tuple(r) for r in tables.column(spark, str(tmp_path / "c")).orderBy("bin").select("bin", "rr").collect()] == [(0, 5.0), (1, 6.0), (2, 7.0)]
    (tmp_path / "k").write_text("1 2 3 4 5 6 7\n")
    assert tables.coefficients(spark, str(tmp_path / "k")).first()["coef"][6] == 7


def test_terms_and_matrices(spark, tmp_path):
    rows = [(t, s, r, c, float(s + r + c)) for t in ("c2", "c4") for s in range(4) for r in range(2) for c in range(2)]
    df = spark.createDataFrame(rows, "term string, subsample int, row int, col int, value double")
    tables.write_terms(df, str(tmp_path / "t"))
    assert tables.read_terms(spark, str(tmp_path / "t"), ["c2"], 2).count() == 8
    with pytest.raises(Exception):
        tables.write_terms(df, str(tmp_path / "t"))
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "c4_n2_m1_11,11_0.txt").write_text("1 2\n3 4\n")
    (tmp_path / "m" / "c4_n2_m1_11,11_full.txt").write_text("5 6\n7 8\n")
    got = {(r["subsample"], r["row"], r["col"]): r["value"] for r in tables.text_matrices(spark, str(tmp_path / "m")).collect()}
    assert got[0, 1, 0] == 3 and got[None, 0, 1] == 6 and len(got) == 8


def test_results(tmp_path):
    cov = np.diag(np.arange(1.0, 7.0))
    tables.export_covariance(str(tmp_path / "c"), cov, (1.5, 2.0))
    tables.cross_of(str(tmp_path / "c"), str(tmp_path / "x"))
    back, alphas = tables.read_covariance(str(tmp_path / "x"))
    assert np.allclose(back, np.diag([3.0, 4.0])) and alphas == (1.5, 2.0)


def test_running_means(spark, tmp_path):
    rows = [("c2", s, 0, 0, float(s)) for s in range(4)]
    df = spark.createDataFrame(rows, "term string, subsample int, row int, col int, value double")
    df.where("subsample < 2").write.parquet(str(tmp_path / "in"))
    q = subsamples.watch(spark, str(tmp_path / "in"), df.schema, "means", str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
        df.where("subsample >= 2").write.mode("append").parquet(str(tmp_path / "in"))
        q.processAllAvailable()
        got = spark.table("means").first()
    finally:
        q.stop()
    assert got["value"] == 1.5 and got["n"] == 4
    assert covariance.full(df).first()["value"] == 1.5
    assert df.agg(F.count("*")).first()[0] == 4


def test_command_line(spark, tmp_path):
    """Catalog, binning and correlation function as files; a stored result and a log come out."""
    from galacov.plans import command

    rng = np.random.default_rng(3)
    np.savetxt(tmp_path / "p.txt", np.column_stack([rng.uniform(100, 145, (90, 3)), 1 + rng.integers(0, 4, 90) / 8, rng.integers(0, 3, 90)]))
    r = np.arange(1.0, 61.0)
    tables.write_xi(str(tmp_path / "xi.txt"), r, [0.25, 0.75], np.repeat((0.5 / r**2)[:, None], 2, axis=1))
    (tmp_path / "bins.txt").write_text("10 20\n20 30\n")
    args = ["-in", str(tmp_path / "p.txt"), "-cor", str(tmp_path / "xi.txt"), "-binfile", str(tmp_path / "bins.txt"), "-output", str(tmp_path / "out"),
            "-mode", "s_mu", "-xi_cut", "30", "-loops", "8", "-loops_per_sample", "2", "-n2", "10", "-n3", "4", "-n4", "4", "-nside", "9"]
    path = command.main(args, spark)
    with np.load(path) as f:
        assert f["full_theory_covariance"].shape == (2, 2) and f["individual_theory_covariances"].shape == (4, 2, 2)
    log = (tmp_path / "out" / "log.txt").read_text()
    assert "90 points" in log and "sampling took" in log and "saved" in log
    with pytest.raises(FileExistsError):
        command.main(args, spark)
    with pytest.raises(ValueError):
        command.split_arguments(["-in", "x"])


def test_sky_rows_at_one_place(spark, tmp_path):
    """Two events at the same place, of which one has the status: the other is not taken for it, nor does either come twice."""
    import duckdb

    from galacov.plans import registry

    rows = [(5, 7, 20.0, '{"k": 3}'), (5 + 121, 7, 20.0, '{"k": 4}'), (5 + 242, 367, 20.0, '{"k": 7}'), (8, 7, 20.0, '{"k": 3}')]
    e = spark.createDataFrame(rows, "event_id long, user_id long, value double, props string")
    e.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.execute(registry.oracle_sql()["sky_catalog_scan"]).fetchall())
    got = registry.queries()["sky_catalog_scan"](spark, str(tmp_path)).select("id", "ra", "dec", "z", "w")
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) == 3
