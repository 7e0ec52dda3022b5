"""Covariances as long tables: sample covariances, symmetries, selection, combination. Matrices of bins are small, so
joins against them broadcast, but the raw terms and mocks are distributed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_covariance(mocks: DataFrame, value: str = "xi", mock: str = "mock", bin_: str = "bin") -> DataFrame:
    """row, col, value: the sample covariance over mocks of every pair of bins."""
    a = mocks.select(mock, F.col(bin_).alias("row"), F.col(value).alias("va"))
    b = mocks.select(mock, F.col(bin_).alias("col"), F.col(value).alias("vb"))
    return a.join(b, mock).groupBy("row", "col").agg(F.covar_samp("va", "vb").alias("value"))


def symmetrised(matrix: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(A + A^T) / 2."""
    turned = matrix.select(*keys, F.col("col").alias("row"), F.col("row").alias("col"), "value")
    return matrix.select(*keys, "row", "col", "value").unionByName(turned).groupBy(*keys, "row", "col").agg((F.sum("value") / 2).alias("value"))


def combined_alpha(terms: DataFrame, alpha: float) -> DataFrame:
    """C4 + alpha C3 + alpha^2 C2 of (term, row, col, value)."""
    power = F.when(F.col("term") == "c4", 1.0).when(F.col("term") == "c3", float(alpha)).when(F.col("term") == "c2", float(alpha) ** 2)
    return terms.groupBy("row", "col").agg(F.sum(F.col("value") * power).alias("value"))


def tracer_images(terms: DataFrame) -> DataFrame:
    """Terms (term, t1, t2, t3, t4, row, col, value) under their index symmetries, averaged over all that give the same
    place. c2: swap of the pair. c3 (t1: the repeated point, then the other of each pair): swap of pairs with transpose.
    c4: swaps inside a pair (with the same swap in the other, so that links stay), swap of pairs with transpose."""
    t = lambda *order: [F.col(f"t{i}").alias(f"t{k}") for k, i in enumerate(order, 1)]
    same, turned = [F.col("row"), F.col("col")], [F.col("col").alias("row"), F.col("row").alias("col")]

    def image(name: str, order: tuple, transpose: bool) -> DataFrame:
        return terms.where(F.col("term") == name).select("term", *t(*order), *(turned if transpose else same), "value")

    wanted = [("c2", (1, 2, 3, 4), False), ("c2", (2, 1, 4, 3), False), ("c3", (1, 2, 3, 4), False), ("c3", (1, 3, 2, 4), True)]
    wanted += [("c4", o, tr) for o, tr in (((1, 2, 3, 4), False), ((2, 1, 3, 4), False), ((1, 2, 4, 3), False), ((2, 1, 4, 3), False), ((3, 4, 1, 2), True), ((4, 3, 1, 2), True), ((3, 4, 2, 1), True), ((4, 3, 2, 1), True))]
    out = None
    for w in wanted:
        out = image(*w) if out is None else out.unionByName(image(*w))
    return out.groupBy("term", "t1", "t2", "t3", "t4", "row", "col").agg(F.avg("value").alias("value"))


def combined_multi(c2: DataFrame, c3: DataFrame, c4: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """Two-tracer covariance. c4: (t1, t2, t3, t4, row, col, value); c3: (t1, t2, t3, ...), t1 the repeated particle;
    c2: (t1, t2, ...). C = C4_XYZW + a_X/4 (d_XW C3_X,YZ + d_XZ C3_X,YW) + a_Y/4 (d_YW C3_Y,XZ + d_YZ C3_Y,XW)
    + a_X a_Y / 2 (d_XW d_YZ + d_XZ d_YW) C2_XY."""
    alpha = lambda c: F.when(F.col(c) == 1, float(alphas[0])).otherwise(float(alphas[1]))
    delta = lambda p, q: F.when(F.col(p) == F.col(q), 1.0).otherwise(0.0)
    key = ["row", "col"]
    out = c4
    for n, (r, p, q) in enumerate((("t1", "t2", "t3"), ("t1", "t2", "t4"), ("t2", "t1", "t3"), ("t2", "t1", "t4"))):
        part = c3.select(F.col("t1").alias(f"r{n}"), F.col("t2").alias(f"p{n}"), F.col("t3").alias(f"q{n}"), F.col("row").alias(f"i{n}"), F.col("col").alias(f"j{n}"), F.col("value").alias(f"v{n}"))
        out = out.join(F.broadcast(part), (F.col(r) == F.col(f"r{n}")) & (F.col(p) == F.col(f"p{n}")) & (F.col(q) == F.col(f"q{n}")) & (F.col("row") == F.col(f"i{n}")) & (F.col("col") == F.col(f"j{n}")), "left")
    two = c2.select(F.col("t1").alias("x"), F.col("t2").alias("y"), F.col("row").alias("i"), F.col("col").alias("j"), F.col("value").alias("w"))
    out = out.join(F.broadcast(two), (F.col("t1") == F.col("x")) & (F.col("t2") == F.col("y")) & (F.col("row") == F.col("i")) & (F.col("col") == F.col("j")), "left")
    out = out.fillna(0.0, ["v0", "v1", "v2", "v3", "w"])
    ax, ay = alpha("t1"), alpha("t2")
    value = (F.col("value") + ax / 4 * (delta("t1", "t4") * F.col("v0") + delta("t1", "t3") * F.col("v1")) + ay / 4 * (delta("t2", "t4") * F.col("v2") + delta("t2", "t3") * F.col("v3"))
             + ax * ay / 2 * (delta("t1", "t4") * delta("t2", "t3") + delta("t1", "t3") * delta("t2", "t4")) * F.col("w"))
    return out.select("t1", "t2", "t3", "t4", *key, value.alias("value"))


def blocks(matrix: DataFrame, n: int, order: Sequence[tuple[int, int]] = ((1, 1), (1, 2), (2, 2))) -> DataFrame:
    """Places of tracer blocks in one matrix: pairs in the given order, n bins each, the whole symmetrised."""
    def block(x: str, y: str) -> Column:
        out = None
        for k, (a, b) in enumerate(order):
            hit = ((F.col(x) == a) & (F.col(y) == b)) | ((F.col(x) == b) & (F.col(y) == a))
            out = F.when(hit, F.lit(k)) if out is None else out.when(hit, F.lit(k))
        return out

    placed = matrix.select((block("t1", "t2") * n + F.col("row")).alias("row"), (block("t3", "t4") * n + F.col("col")).alias("col"), "value")
    return symmetrised(placed.groupBy("row", "col").agg(F.avg("value").alias("value")))


def kept_bins(matrix: DataFrame, n_r: int, n_inner: int, skip: tuple[int, int] = (0, 0), keep_inner: int | None = None, r_outer: bool = True, inner_first: bool = False) -> DataFrame:
    """Without the first and last radial bins and the top inner ones (bins of mu or multipoles), numbered anew.
    r_outer: order of the input; inner_first: the output has the inner index outermost."""
    keep = n_inner if keep_inner is None else keep_inner
    n_kept = n_r - skip[0] - skip[1]

    def split(c: str) -> tuple[Column, Column]:
        if r_outer:
            return F.expr(f"cast({c} div {n_inner} as int)"), (F.col(c) % n_inner).cast("int")
        return (F.col(c) % n_r).cast("int"), F.expr(f"cast({c} div {n_r} as int)")

    out = matrix
    for c in ("row", "col"):
        r, i = split(c)
        out = out.withColumn("__r", r).withColumn("__i", i).where((F.col("__r") >= skip[0]) & (F.col("__r") < n_r - skip[1]) & (F.col("__i") < keep))
        new = F.col("__i") * n_kept + F.col("__r") - skip[0] if inner_first else (F.col("__r") - skip[0]) * keep + F.col("__i")
        out = out.withColumn(c, new.cast("int"))
    return out.drop("__r", "__i")


def legendre_reordered(matrix: DataFrame, n_r: int, n_l: int, tracers: int = 1) -> DataFrame:
    """(r, l) to (l, r) order inside each tracer block."""
    size = n_r * n_l

    def moved(c: str) -> Column:
        block, rest = F.expr(f"cast({c} div {size} as int)"), F.col(c) % size
        return (block * size + (rest % n_l) * n_r + F.floor(rest / n_l)).cast("int")

    return matrix.select(moved("row").alias("row"), moved("col").alias("col"), "value")


def cross_block(matrix: DataFrame, n: int) -> DataFrame:
    """The middle block of a two-tracer covariance."""
    inside = (F.col("row") >= n) & (F.col("row") < 2 * n) & (F.col("col") >= n) & (F.col("col") < 2 * n)
    return matrix.where(inside).select((F.col("row") - n).cast("int").alias("row"), (F.col("col") - n).cast("int").alias("col"), "value")


def regions_combined(cov1: DataFrame, cov2: DataFrame, weights1: DataFrame, weights2: DataFrame) -> DataFrame:
    """sum_k w_a w_b C_ab / (W_a W_b) over two regions; weights: (bin, weight), the pair counts."""
    both = weights1.select("bin", F.col("weight").alias("w1")).join(weights2.select("bin", F.col("weight").alias("w2")), "bin")
    share = both.select("bin", (F.col("w1") / (F.col("w1") + F.col("w2"))).alias("s1"), (F.col("w2") / (F.col("w1") + F.col("w2"))).alias("s2"))
    parts = cov1.withColumn("k", F.lit(1)).unionByName(cov2.withColumn("k", F.lit(2)))
    out = parts.join(F.broadcast(share.select(F.col("bin").alias("row"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))), "row")
    out = out.join(F.broadcast(share.select(F.col("bin").alias("col"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))), "col")
    scale = F.when(F.col("k") == 1, F.col("a1") * F.col("b1")).otherwise(F.col("a2") * F.col("b2"))
    return out.groupBy("row", "col").agg(F.sum(F.col("value") * scale).alias("value"))


def jacobian(weights: DataFrame, factors: DataFrame, inverse: DataFrame, n_r: int) -> DataFrame:
    """bin_in, bin_out, value: P[(l, r), (l', r)] = sum_mu L[l, mu] w(r, mu) F[mu, l'], l outermost. weights: (r_bin,
    mu_bin, weight), the shares of one region; l in steps of 2."""
    left = inverse.select("mu_bin", F.col("l").alias("l1"), F.col("factor").alias("f1"))
    right = factors.select("mu_bin", F.col("l").alias("l2"), F.col("factor").alias("f2"))
    met = weights.join(F.broadcast(left), "mu_bin").join(F.broadcast(right), "mu_bin")
    place = lambda l: (F.col(l) / 2 * n_r + F.col("r_bin")).cast("int")
    return met.groupBy(place("l1").alias("bin_in"), place("l2").alias("bin_out")).agg(F.sum(F.col("weight") * F.col("f1") * F.col("f2")).alias("value"))


def transformed(matrix: DataFrame, p: DataFrame) -> DataFrame:
    """P^T C P: two joins with sums between."""
    half = matrix.join(F.broadcast(p.select(F.col("bin_in").alias("row"), F.col("bin_out").alias("new_row"), F.col("value").alias("pv"))), "row")
    half = half.groupBy("new_row", "col").agg(F.sum(F.col("value") * F.col("pv")).alias("value"))
    out = half.join(F.broadcast(p.select(F.col("bin_in").alias("col"), F.col("bin_out").alias("new_col"), F.col("value").alias("pv"))), "col")
    return out.groupBy(F.col("new_row").alias("row"), F.col("new_col").alias("col")).agg(F.sum(F.col("value") * F.col("pv")).alias("value"))


def regions_combined_legendre(cov1: DataFrame, cov2: DataFrame, p1: DataFrame, p2: DataFrame) -> DataFrame:
    """C = sum_k P_k^T C_k P_k."""
    return transformed(cov1, p1).unionByName(transformed(cov2, p2)).groupBy("row", "col").agg(F.sum("value").alias("value"))


def tracers_concatenated(matrix: DataFrame, n: int, bias: tuple[float, float]) -> DataFrame:
    """From the blocks 11, 12, 22 of n bins to one tracer of both: weights b1^2, 2 b1 b2, b2^2 over their sum."""
    b1, b2 = bias
    total = (b1 + b2) ** 2
    share = F.array(*[F.lit(v / total) for v in (b1 * b1, 2 * b1 * b2, b2 * b2)])
    at = lambda c: F.element_at(share, F.floor(F.col(c) / n).cast("int") + 1)
    return matrix.groupBy((F.col("row") % n).cast("int").alias("row"), (F.col("col") % n).cast("int").alias("col")).agg(F.sum(F.col("value") * at("row") * at("col")).alias("value"))


# ---- raw terms by subsample ------------------------------------------------------------------------------------------
def collapsed(terms: DataFrame, factor: int) -> DataFrame:
    """Means of `factor` adjacent subsamples; a last group that is not full goes."""
    group = F.expr(f"cast(subsample div {factor} as int)")
    out = terms.groupBy("term", group.alias("subsample"), "row", "col").agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return out.where(F.col("n") == factor).drop("n")


def full(terms: DataFrame) -> DataFrame:
    """The mean of all subsamples."""
    return terms.groupBy("term", "row", "col").agg(F.avg("value").alias("value"))


def selected(terms: DataFrame, samples: None | int | Sequence[int] = None) -> DataFrame:
    """All subsamples, the first so many, or those listed."""
    if samples is None:
        return terms
    if isinstance(samples, int):
        return terms.where(F.col("subsample") < samples)
    return terms.where(F.col("subsample").isin(*samples))


def complete(terms: DataFrame) -> DataFrame:
    """term, n: subsamples of each term; the smallest n is what all terms have."""
    return terms.groupBy("term").agg(F.count_distinct("subsample").alias("n"))


def equalised(terms: DataFrame) -> DataFrame:
    """Only subsamples that all terms have."""
    least = complete(terms).agg(F.min("n").alias("least"))
    return terms.crossJoin(F.broadcast(least)).where("subsample < least").drop("least")


def concatenated(runs: Sequence[DataFrame]) -> DataFrame:
    """Subsamples of several runs, numbered on, over the terms that all have."""
    names = runs[0].select("term").distinct()
    for r in runs[1:]:
        names = names.intersect(r.select("term").distinct())
    out, start = None, None
    for r in runs:
        own = r.join(F.broadcast(names), "term", "left_semi")
        if start is not None:
            own = own.crossJoin(F.broadcast(start)).withColumn("subsample", (F.col("subsample") + F.col("__from")).cast("int")).drop("__from")
        out = own if out is None else out.unionByName(own)
        start = out.agg((F.max("subsample") + 1).alias("__from"))
    return out


def diagonal(term: DataFrame) -> DataFrame:
    """A term by bin as a matrix of its diagonal."""
    return term.select(F.col("bin").alias("row"), F.col("bin").alias("col"), "value")


def frobenius_change(terms: DataFrame, last: int) -> DataFrame:
    """term, change: per cent by which the mean of subsamples up to `last` differs from that up to the one before."""
    before = terms.where(F.col("subsample") < last).groupBy("term", "row", "col").agg(F.avg("value").alias("old"))
    after = terms.where(F.col("subsample") <= last).groupBy("term", "row", "col").agg(F.avg("value").alias("new"))
    both = after.join(before, ["term", "row", "col"])
    d = F.col("new") - F.col("old")
    return both.groupBy("term").agg((100 * F.sqrt(F.sum(d * d)) / F.sqrt(F.sum(F.col("new") * F.col("new")))).alias("change"))


def halves(terms: DataFrame, n: int, alternate: bool = False) -> DataFrame:
    """half, term, row, col, value: means of the two halves of n subsamples, first and second or even and odd."""
    side = F.col("subsample") % 2 if alternate else F.when(F.col("subsample") < n // 2, 0).otherwise(1)
    return terms.where(F.col("subsample") < n).groupBy(side.cast("int").alias("half"), "term", "row", "col").agg(F.avg("value").alias("value"))


def renumbered(matrix: DataFrame) -> DataFrame:
    """Bins as dense numbers."""
    return matrix.select((F.dense_rank().over(Window.orderBy("row")) - 1).alias("row"), (F.dense_rank().over(Window.orderBy("col")) - 1).alias("col"), "value")
