"""The 2-, 3- and 4-point covariance terms as joins over tables of pairs.

Exact: every tuple of distinct points whose legs lie inside the cutoffs. A pair table `legs` has the binned pairs, `links`
the pairs within the correlation function's cutoff with its value. The cost is that of the joins, so this form is for
catalogs whose legs and links are few per point; operators.sampler draws the same sums for larger ones. The plain terms
sum over i first; jackknife weights and moments, which belong to whole tuples, are taken from the tables of tuples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galacov.operators import pairs as pairing

Xi = Callable[[Column, Column], Column]


def legs(points: DataFrame, bins: pairing.Bins, xi: Xi, box: float | None = None, carry: tuple[str, ...] = ("w",), right: DataFrame | None = None) -> DataFrame:
    """i, j, a (bin), s, mu, xi and the carried columns with suffixes _i and _j, of ordered pairs."""
    met = pairing.pairs(points, points if right is None else right, bins.r_max, bins.r_min, box, carry=carry, same=right is None)
    met = pairing.binned(met, bins)
    cols = [F.col(f"{c}{k}").alias(f"{c}_{n}") for c in carry for k, n in ((1, "i"), (2, "j"))]
    return met.select(F.col("id1").alias("i"), F.col("id2").alias("j"), (F.col("r_bin") * bins.n_mu + F.col("mu_bin")).cast("int").alias("a"), "r_bin", "s", "mu", xi(F.col("s"), F.col("mu")).alias("xi"), *cols)


def links(points: DataFrame, cut: float, xi: Xi, box: float | None = None, right: DataFrame | None = None) -> DataFrame:
    """i, k, x: pairs within the cutoff and their correlation."""
    met = pairing.pairs(points, points if right is None else right, cut, 0.0, box, carry=("w",), same=right is None)
    return met.select(F.col("id1").alias("i"), F.col("id2").alias("k"), xi(F.col("s"), F.col("mu")).alias("x"))


def c2(leg: DataFrame) -> DataFrame:
    """a, value: 2 sum w_i^2 w_j^2 (1 + xi_ij)."""
    v = 2 * F.col("w_i") * F.col("w_i") * F.col("w_j") * F.col("w_j") * (1 + F.col("xi"))
    return leg.groupBy("a").agg(F.sum(v).alias("value"))


def triples(leg: DataFrame, link: DataFrame, carry: tuple[str, ...] = ("w",)) -> DataFrame:
    """i, j, k with the bins a of ij and b of jk and x of ik."""
    second = leg.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("a").alias("b"), F.col("mu").alias("mu_b"), F.col("s").alias("s_b"), F.col("r_bin").alias("r_b"), *[F.col(f"{c}_j").alias(f"{c}_k") for c in carry])
    return leg.join(link, "i").join(second, ["j", "k"]).where("i != k")


def bridges(leg: DataFrame, link: DataFrame) -> DataFrame:
    """j, k, a, w_j and t = sum over i of w_i x_ik over the pairs ij in bin a: what the sums over three and four points have
    in common. It is summed up before anything else is joined, so rows grow as points x legs x links and no further."""
    met = leg.join(link, "i").where("k != j")
    return met.groupBy("j", "k", "a").agg(F.max("w_j").alias("w_j"), F.sum(F.col("w_i") * F.col("x")).alias("t"))


def c3(leg: DataFrame, link: DataFrame) -> DataFrame:
    """a, b, value: 4 sum w_i w_j^2 w_k xi_ik. leg and link: ordered pairs of one catalog."""
    second = leg.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("a").alias("b"), F.col("w_j").alias("w_k"))
    met = bridges(leg, link).join(second, ["j", "k"])
    return met.groupBy("a", "b").agg(F.sum(4 * F.col("w_j") * F.col("w_j") * F.col("w_k") * F.col("t")).alias("value"))


def quads(leg: DataFrame, link: DataFrame, carry: tuple[str, ...] = ("w",)) -> DataFrame:
    """i, j, k, l with the bins a of ij and b of kl, x of ik and y of jl."""
    other = leg.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("a").alias("b"), F.col("mu").alias("mu_b"), F.col("s").alias("s_b"), F.col("r_bin").alias("r_b"), *[F.col(f"{c}_{o}").alias(f"{c}_{n}") for c in carry for o, n in (("i", "k"), ("j", "l"))])
    second = link.select(F.col("i").alias("j"), F.col("k").alias("l"), F.col("x").alias("y"))
    return leg.join(link, "i").where("k != j").join(second, "j").where("l != i and l != k").join(other, ["k", "l"])


def c4(leg: DataFrame, link: DataFrame) -> DataFrame:
    """a, b, value: 2 sum w_i w_j w_k w_l xi_ik xi_jl. leg and link: ordered pairs of one catalog.

    The sum over i and that over l are bridges from j to k and from k to j; their product over all j, k has the tuples in
    which i is l as well, which are a sum over single points and are taken off again."""
    own = bridges(leg, link)
    back = own.select(F.col("j").alias("k"), F.col("k").alias("j"), F.col("a").alias("b"), F.col("w_j").alias("w_k"), F.col("t").alias("u"))
    whole = own.join(back, ["j", "k"]).groupBy("a", "b").agg(F.sum(2 * F.col("w_j") * F.col("w_k") * F.col("t") * F.col("u")).alias("value"))
    both = leg.join(link.withColumnRenamed("k", "j"), ["i", "j"]).select("i", "a", "w_i", (F.col("w_j") * F.col("x")).alias("v"))
    at = both.groupBy("i", "a").agg(F.max("w_i").alias("w_i"), F.sum("v").alias("v"), F.sum(F.col("v") * F.col("v")).alias("vv"))
    met = at.join(at.select("i", F.col("a").alias("b"), F.col("v").alias("u")), "i")
    again = F.when(F.col("a") == F.col("b"), F.col("vv")).otherwise(0.0)  # j is k
    same = met.groupBy("a", "b").agg((-F.sum(2 * F.col("w_i") * F.col("w_i") * (F.col("v") * F.col("u") - again))).alias("value"))
    return whole.unionByName(same).groupBy("a", "b").agg(F.sum("value").alias("value"))


def divided(term: DataFrame, rr: DataFrame, norm: float, points: int) -> DataFrame:
    """Terms over norm^points RR'_a RR'_b, where RR' = RR / norm^2. rr: (bin, rr)."""
    second = "b" if "b" in term.columns else "a"
    one = rr.select(F.col("bin").alias("a"), (F.col("rr") / F.lit(norm**2)).alias("ra"))
    out = term.join(one, "a")
    if second == "b":
        out = out.join(rr.select(F.col("bin").alias("b"), (F.col("rr") / F.lit(norm**2)).alias("rb")), "b")
    else:
        out = out.withColumn("rb", F.col("ra"))
    keys = ["a", "b"] if second == "b" else ["a"]
    return out.select(*keys, (F.col("value") / (F.lit(norm**points) * F.col("ra") * F.col("rb"))).alias("value"))


# ---- jackknife -------------------------------------------------------------------------------------------------------
def tensor(ji: str, jj: str, jk: str, jl: str, wa: tuple[str, str], wb: tuple[str, str], product: str) -> Column:
    """Weight of a tuple: a quarter of the region matches across the two pairs, minus half the weights of each point's
    region in the other pair's bin, plus the sum of products. wb: weights of i's and j's regions in bin b; wa: of k's and
    l's in bin a."""
    same = [F.when(F.col(p) == F.col(q), 1.0).otherwise(0.0) for p, q in ((ji, jk), (jj, jk), (ji, jl), (jj, jl))]
    return 0.25 * (same[0] + same[1] + same[2] + same[3]) - 0.5 * (F.col(wb[0]) + F.col(wb[1]) + F.col(wa[0]) + F.col(wa[1])) + F.col(product)


def with_tensor(tuples: DataFrame, roles: tuple[str, str, str, str], weights: DataFrame, products: DataFrame) -> DataFrame:
    """tuples with q / (1 - sum w w); roles: the jackknife columns of the two pairs' points. weights: (jack, bin, weight),
    regions x bins; products: bins x bins. Both are small whatever the catalog."""
    out = tuples
    for n, (role, bin_) in enumerate(((roles[0], "b"), (roles[1], "b"), (roles[2], "a"), (roles[3], "a"))):
        w = weights.select(F.col("jack").alias(f"__j{n}"), F.col("bin").alias(f"__b{n}"), F.col("weight").alias(f"__w{n}"))
        out = out.join(F.broadcast(w), (F.col(role) == F.col(f"__j{n}")) & (F.col(bin_) == F.col(f"__b{n}")), "left").fillna(0.0, [f"__w{n}"])
    out = out.join(F.broadcast(products.select(F.col("bin_a").alias("__pa"), F.col("bin_b").alias("__pb"), F.col("value").alias("__p"))), (F.col("a") == F.col("__pa")) & (F.col("b") == F.col("__pb")))
    q = tensor(*roles, wa=("__w2", "__w3"), wb=("__w0", "__w1"), product="__p")
    return out.withColumn("q", q / (1 - F.col("__p")))


def c2_jack(leg: DataFrame, weights: DataFrame, products: DataFrame) -> DataFrame:
    t = with_tensor(leg.withColumn("b", F.col("a")), ("jack_i", "jack_j", "jack_i", "jack_j"), weights, products)
    v = 2 * F.col("w_i") * F.col("w_i") * F.col("w_j") * F.col("w_j") * (1 + F.col("xi")) * F.col("q")
    return t.groupBy("a").agg(F.sum(v).alias("value"))


def c3_jack(leg: DataFrame, link: DataFrame, weights: DataFrame, products: DataFrame) -> DataFrame:
    t = with_tensor(triples(leg, link, ("w", "jack")), ("jack_i", "jack_j", "jack_j", "jack_k"), weights, products)
    v = 4 * F.col("w_i") * F.col("w_j") * F.col("w_j") * F.col("w_k") * F.col("x") * F.col("q")
    return t.groupBy("a", "b").agg(F.sum(v).alias("value"))


def c4_jack(leg: DataFrame, link: DataFrame, weights: DataFrame, products: DataFrame) -> DataFrame:
    t = with_tensor(quads(leg, link, ("w", "jack")), ("jack_i", "jack_j", "jack_k", "jack_l"), weights, products)
    v = 2 * F.col("w_i") * F.col("w_j") * F.col("w_k") * F.col("w_l") * F.col("x") * F.col("y") * F.col("q")
    return t.groupBy("a", "b").agg(F.sum(v).alias("value"))


# ---- Legendre --------------------------------------------------------------------------------------------------------
def projected(term: DataFrame, factors: DataFrame, n_mu: int) -> DataFrame:
    """A term in (s, mu) bins as r_a, p, r_b, q: linear, so it acts on the sums and not on every tuple. factors:
    (mu_bin, l, factor)."""
    t = term if "b" in term.columns else term.withColumn("b", F.col("a"))
    t = t.select(F.expr(f"cast(a div {n_mu} as int)").alias("r_a"), (F.col("a") % n_mu).alias("ma"), F.expr(f"cast(b div {n_mu} as int)").alias("r_b"), (F.col("b") % n_mu).alias("mb"), "value")
    fa = factors.select(F.col("mu_bin").alias("ma"), F.col("l").alias("p"), F.col("factor").alias("fa"))
    fb = factors.select(F.col("mu_bin").alias("mb"), F.col("l").alias("q"), F.col("factor").alias("fb"))
    met = t.join(F.broadcast(fa), "ma").join(F.broadcast(fb), "mb")  # bins of mu x multipoles
    return met.groupBy("r_a", "p", "r_b", "q").agg(F.sum(F.col("value") * F.col("fa") * F.col("fb")).alias("value"))


def accumulated(tuples: DataFrame, value: Column, max_l: int, phi: Callable[[Column, Column], Column], volumes: list[float], second: tuple[str, str] = ("r_b", "mu_b")) -> DataFrame:
    """Sums over tuples of value x Phi_a P_p(mu_a) Phi_b P_q(mu_b) x (2p + 1)(2q + 1) / (V_a V_b). tuples: with r_bin, mu
    and the second pair's radial bin and mu."""
    from galacov.functions import geometry

    ls = list(range(0, max_l + 1, 2))

    def volume(r: str) -> Column:
        out = F.when(F.col(r) == 0, float(volumes[0]))
        for i, v in enumerate(volumes[1:], 1):
            out = out.when(F.col(r) == i, float(v))
        return out

    def side(r: str, mu: str) -> Column:
        f = phi(F.col(r), F.col(mu)) / volume(r)
        return F.array(*[F.struct(F.lit(l).alias("l"), (f * geometry.legendre(l, F.col(mu)) * (2 * l + 1)).alias("f")) for l in ls])

    out = tuples.select(F.col("r_bin").alias("r_a"), F.col(second[0]).alias("r_b"), value.alias("v"), side("r_bin", "mu").alias("sa"), side(*second).alias("sb"))
    out = out.withColumn("x", F.explode("sa")).withColumn("y", F.explode("sb"))
    return out.groupBy("r_a", F.col("x.l").alias("p"), "r_b", F.col("y.l").alias("q")).agg(F.sum(F.col("v") * F.col("x.f") * F.col("y.f")).alias("value"))
