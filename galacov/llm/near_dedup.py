"""Near-dedup with ProbMinHash: signatures whose parts agree with the probability Jaccard similarity of two weighted
shingle sets, banded into candidate buckets, every link verified exactly.

Elements are the five-word shingles of a text (words: lower-cased runs between white space; a shorter text is one
shingle), weighted by how often they occur. The similarity is the probability Jaccard
J(u, v) = sum over common d of 1 / sum_d' max(u_d'/u_d, v_d'/v_d); for shingles that occur once each it is the plain
Jaccard of the sets. Each element's arrivals form a Poisson process whose rate is its weight; an arrival falls into a
random one of the signature's parts, and the earliest arrival of each part wins. An element stops once its next arrival
is later than all parts' present winners (Ertl, "ProbMinHash", algorithm 1).

Texts with the same words are one node, made by an aggregation that combines in the map tasks. A bucket holds the nodes
that agree in a whole band. Links: two nodes that share a bucket and have J >= threshold. Classes: connected components.

Not all pairs of a bucket are made. First each bucket's nodes are compared with one leader of it, the node that meets
most others; what links is one class. Only nodes of different classes are still open, and of these 1 - J, which is a
metric, spares those whose distances from the leader differ by more than 1 - threshold. Buckets with few open pairs for
their size (`band_open` times their nodes) have them compared as rows. In the others nodes are dealt into blocks of about
`block` nodes, large classes apart, and the open blocks are compared two at a time by one matrix product over their
common shingles; of what they link only a spanning forest leaves the task. So the rows made are linear in a bucket's
nodes but for one part in `block`, and no link between two nodes of a bucket is lost. The comparisons inside the blocks
are as many as there are open pairs; a group of texts just below the threshold from each other costs its square in
multiplications, not in rows.

Chance of missing a link of similarity s by banding: (1 - s^4)^24, below 4e-6 at 0.8.

Cases: null counts as empty; texts without words are one class. Rows that repeat an id with the same words are one row
of the result, with different words one row each, and each text has its own class. A class stays by its smallest id.
Null ids are left as rows of their own class. Ids may be of any type that has an order. An empty table gives no rows.
Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, quoted, staged, text_or_empty, trimmed

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 4
#: Open pairs for each node of a bucket that are compared as rows; nodes and words of a block in the other buckets.
BAND_OPEN, BLOCK, BLOCK_WORDS = 4, 1024, 1 << 19
#: Most nodes that are sent to all tasks to pick their texts; with more, texts are shuffled instead.
SENT = 200_000
#: Shingles that a worker handles at once, and columns of a matrix in it.
CHUNK, COLUMNS = 1 << 19, 2048
KEY = ["k1", "k2", "k3"]


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[\s\p{Z}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of texts words[offsets[i]:offsets[i+1]], and the text of each. A text of one to
    k - 1 words has one shingle of all its words."""
    words = words.view(np.uint64) if words.dtype == np.int64 else words.astype(np.uint64)
    counts = np.diff(offsets)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), n)
    first = offsets[:-1][text] + np.arange(len(text)) - (np.cumsum(n) - n)[text]
    length = np.minimum(counts, k)[text]
    h = np.full(len(text), 0x51ED270B, np.uint64)
    for j in range(k):
        in_text = j < length
        h = np.where(in_text, mix(h * np.uint64(0x9E3779B97F4A7C15) + words[np.minimum(first + j, len(words) - 1)]), h)
    return h, text


def weighted(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle) with their counts, ordered by text and shingle."""
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return h[at], text[at], np.diff(np.append(at, len(h))).astype(float)


def signatures(h: np.ndarray, text: np.ndarray, weight: np.ndarray, n_texts: int, parts: int) -> np.ndarray:
    """ProbMinHash1 of n_texts texts, all at once: the i-th arrivals of all elements that are still in the race."""
    best = np.full(n_texts * parts, np.inf)
    winner = np.zeros(n_texts * parts, np.uint64)
    live = np.arange(len(h))
    time = np.zeros(len(h))
    arrival = 0
    while len(live):
        arrival += 1
        r = mix(h[live] + np.uint64((arrival * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time[live] -= np.log(u) / weight[live]
        part = (mix(r) % np.uint64(parts)).astype(np.int64)
        slot, t = text[live] * parts + part, time[live]
        np.minimum.at(best, slot, t)
        won = best[slot] == t
        winner[slot[won]] = h[live[won]]
        latest = best.reshape(n_texts, parts).max(axis=1)
        live = live[t < latest[text[live]]]
    return winner.reshape(n_texts, parts)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        out[:, b] = h
    return out.view(np.int64)


def chunks_of(offsets: np.ndarray, most: int = CHUNK):
    """Ranges of texts that hold about `most` words together."""
    at = 0
    while at < len(offsets) - 1:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), len(offsets) - 1)
        yield at, to
        at = to


def list_parts(column) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def probability_jaccard(h1: np.ndarray, w1: np.ndarray, h2: np.ndarray, w2: np.ndarray) -> float:
    """Exactly, in n log n: with the elements sorted by u/v, the inner sum is a suffix sum of u over u_d plus a prefix
    sum of v over v_d."""
    common, a, b = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    u = np.concatenate([w1[a], np.delete(w1, a), np.zeros(len(h2) - len(b))])
    v = np.concatenate([w2[b], np.zeros(len(h1) - len(a)), np.delete(w2, b)])
    with np.errstate(divide="ignore"):
        ratio = u / v
    order = np.argsort(ratio, kind="stable")
    u, v, both = u[order], v[order], (np.arange(len(ratio)) < len(common))[order]
    right = np.cumsum(u[::-1])[::-1]
    left = np.cumsum(v) - v
    return float((1.0 / (right[both] / u[both] + left[both] / v[both])).sum())


def similarity(words1: np.ndarray, words2: np.ndarray, k: int = SHINGLE) -> float:
    def own(w):
        h, text = shingles(w, np.array([0, len(w)]), k)
        h, _, c = weighted(h, text)
        return h, c

    return probability_jaccard(*own(words1), *own(words2))


def nodes_of(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, KEY, times) of each id and words; nodes (node, KEY, first, copies), one for different words; and the
    words (id, KEY, words) of all rows."""
    words = word_hashes(text_or_empty(text_col))
    text = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), words.alias("words"))
    text = text.select("id", F.xxhash64("words").alias("k1"), F.hash("words", F.lit(7)).alias("k2"), F.size("words").alias("k3"), "words")
    rows = staged(text.select("id", *KEY).groupBy("id", *KEY).agg(F.count("*").alias("times")), "rows")
    nodes = rows.groupBy(*KEY).agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    return rows, staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes"), text


def picked(text: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, words) of the given nodes, once each."""
    nodes = nodes.select("node", F.col("first").alias("id"), *KEY)
    if nodes.count() <= SENT:
        nodes = F.broadcast(nodes)
    return text.join(nodes, ["id", *KEY]).select("node", "words").dropDuplicates(["node"])


def bands_of(text: DataFrame, bands: int, rows: int, k: int) -> DataFrame:
    """id, KEY, buckets: the keys of all bands of each text that has words. text: id, KEY, words."""
    def run(batches):
        for b in batches:
            flat, offsets = list_parts(b.column(4))
            for lo, hi in chunks_of(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                h, of, weight = weighted(*shingles(flat[offsets[lo] : offsets[hi]], own, k))
                keys = band_keys(signatures(h, of, weight, hi - lo, bands * rows), bands, rows)
                some = pa.array(np.diff(own) > 0)
                each = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo).filter(some) for i in range(4)), each.filter(some)], names=["id", *KEY, "buckets"])
        trimmed()

    return text.mapInArrow(run, f"id {text.dtypes[0][1]}, k1 long, k2 int, k3 int, buckets array<long>")


def similarities_of(x: np.ndarray, xo: np.ndarray, y: np.ndarray, yo: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Of texts x[i] and y[i], all rows at once. Exact where the similarity reaches the floor; below it the result may be
    the upper bound that told so: the smaller share of weight on common shingles."""
    n = len(xo) - 1
    h1, t1, w1 = weighted(*shingles(x, xo, k))
    h2, t2, w2 = weighted(*shingles(y, yo, k))
    h, t, side = np.concatenate([h1, h2]), np.concatenate([t1, t2]), np.repeat([0, 1], [len(h1), len(h2)])
    order = np.lexsort((side, h, t))
    h, t = h[order], t[order]
    at = np.flatnonzero((h[1:] == h[:-1]) & (t[1:] == t[:-1])) if len(h) else np.zeros(0, int)
    one, two = order[at], order[at + 1] - len(h1)
    row = t1[one]
    total1, total2 = np.bincount(t1, w1, n), np.bincount(t2, w2, n)
    size1, size2, common = np.bincount(t1, minlength=n), np.bincount(t2, minlength=n), np.bincount(row, minlength=n)
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.nan_to_num(common / (size1 + size2 - common))
        bound = np.nan_to_num(np.minimum(np.bincount(row, w1[one], n) / total1, np.bincount(row, w2[two], n) / total2))
    once = (total1 == size1) & (total2 == size2)
    out = np.where(once, plain, bound)
    ends1, ends2 = np.cumsum(size1), np.cumsum(size2)
    for i in np.flatnonzero(~once & (bound >= floor)):
        p, q = slice(ends1[i] - size1[i], ends1[i]), slice(ends2[i] - size2[i], ends2[i])
        out[i] = probability_jaccard(h1[p], w1[p], h2[q], w2[q])
    return out


def similarities(pairs: DataFrame, words: DataFrame, k: int, floor: float) -> DataFrame:
    """a, b, sim of the pairs (a, b); below the floor sim may be an upper bound."""
    def run(batches):
        for batch in batches:
            x, xo = list_parts(batch.column(2))
            y, yo = list_parts(batch.column(3))
            for lo, hi in chunks_of(xo + yo):
                sim = similarities_of(x[xo[lo] : xo[hi]], xo[lo : hi + 1] - xo[lo], y[yo[lo] : yo[hi]], yo[lo : hi + 1] - yo[lo], k, floor)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sim, pa.float64())], names=["a", "b", "sim"])
        trimmed()

    left = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long, sim double")


def components(links: DataFrame, name: str = "classes") -> DataFrame:
    """(node, root) of each node that has a link, root being the smallest node of its component: alternating large-star
    and small-star steps (Kiveris et al., 2014), in which no node's links meet in one place but as a minimum."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), name)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        step = staged(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
        ends = step.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(step.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        edges = step
        if not ends.where("up > 1 or (up > 0 and down > 0)").limit(1).count():  # each node hangs on a root
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """nodes with root, the class of column node."""
    return nodes.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node"))


def split_buckets(held: DataFrame, near: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(bucket) where open pairs are few for the bucket's nodes, and where they are not. held: bucket, node, leader, root
    and d, the distance from the leader. Open is a pair of different classes, unless one node is within `near` of the
    leader and the other more than that farther away."""
    lead, close, middle = F.col("lead"), F.col("d") <= near, F.col("d") <= 2 * near
    own = held.groupBy("bucket", "root").agg(
        F.count("*").alias("f"), F.count(F.when(close, 1)).alias("c"), F.count(F.when(middle, 1)).alias("m"), F.max(F.col("node") == F.col("leader")).alias("lead"))
    inner, outer = (lambda c: F.sum(F.when(lead, c).otherwise(0))), (lambda c: F.sum(F.when(lead, 0).otherwise(c)))
    sums = own.groupBy("bucket").agg(
        F.sum("f").alias("n"), inner(F.col("c")).alias("close"), inner(F.col("f") - F.col("c")).alias("rest"), outer(F.col("f")).alias("out"),
        outer(F.col("m")).alias("mid"), outer(F.col("f") * F.col("f")).alias("ff"))
    pairs = F.expr("close * mid + rest * out + (out * out - ff) / 2")
    open_ = staged(sums.select("bucket", "n", pairs.alias("pairs")).where("pairs > 0"), "open")
    return open_.where(F.col("pairs") <= most * F.col("n")).select("bucket"), open_.where(F.col("pairs") > most * F.col("n")).select("bucket")


def apart(x: str, y: str, near: float) -> str:
    """SQL: the leader tells that two nodes cannot link."""
    return f"(({x}.d <= {near!r} and {y}.d - {x}.d > {near!r}) or ({y}.d <= {near!r} and {x}.d - {y}.d > {near!r}))"


def open_pairs(few: DataFrame, near: float) -> DataFrame:
    """(a, b): the open pairs of these buckets. Two nodes that share many buckets meet in the first of these only; a node
    has no more buckets than there are bands."""
    own = few.groupBy("node").agg(F.collect_list("bucket").alias("all"))
    few = few.join(own, "node")
    x, y = few.alias("x"), few.alias("y")
    first = F.expr(f"x.node < y.node and x.root != y.root and not {apart('x', 'y', near)} and array_min(array_intersect(x.all, y.all)) = x.bucket")
    return x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & first).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def dealt(held: DataFrame, near: float, block: int, most_words: int) -> DataFrame:
    """held with its block (c, p): classes of half a block or more have blocks of their own (c is the class); the others
    share blocks, those near the leader (c = -1) and those far from it (c = -2) apart. w: a node's words."""
    sizes = held.groupBy("bucket", "root").agg(F.count("*").alias("f"), F.sum("w").alias("fw"), F.min("d").alias("d0"))
    label = F.when((F.col("f") >= block // 2) | (F.col("fw") >= most_words // 2), F.col("root")).when(F.col("d0") <= 2 * near, -1).otherwise(-2)
    sizes = sizes.withColumn("c", label)
    parts = sizes.groupBy("bucket", "c").agg(F.greatest(F.ceil(F.sum("f") / block), F.ceil(F.sum("fw") / most_words)).alias("parts"))
    placed = held.join(sizes.select("bucket", "root", "c"), ["bucket", "root"]).join(parts, ["bucket", "c"])
    spot = F.xxhash64(F.when(F.col("c") < 0, F.col("root")).otherwise(F.col("node")))
    return placed.select("bucket", "node", "root", "d", "c", F.pmod(spot, F.col("parts")).alias("p"))


def forest(h: np.ndarray, text: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray, root: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links (i, j) between texts left[i] and right[j] of different classes that reach the threshold, enough of them to
    connect all that link. (text, h, weight) as `weighted` gives them; root: a class for each text."""
    n = len(root)
    _, column, often = np.unique(h, return_inverse=True, return_counts=True)
    common = often > 1
    column = (np.cumsum(common) - 1)[column] * common[column] - ~common[column]
    total, size = np.bincount(text, weight, n), np.bincount(text, minlength=n)
    once = total == size
    plain = bool(once.all())
    at = np.flatnonzero(column >= 0)
    at = at[np.argsort(column[at], kind="stable")]
    ends = np.searchsorted(column[at], np.arange(0, common.sum() + COLUMNS, COLUMNS))
    place = np.full((2, n), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    shape = (len(left), len(right))
    both = np.zeros(shape, np.float32)
    shares = None if plain else (np.zeros(shape, np.float32), np.zeros(shape, np.float32))
    for k in range(len(ends) - 1):
        own = at[ends[k] : ends[k + 1]]
        marks, weights = [], []
        for side, m in enumerate(shape):
            some = own[place[side, text[own]] >= 0]
            where = (place[side, text[some]], column[some] - k * COLUMNS)
            one = np.zeros((m, COLUMNS), np.float32)
            one[where] = 1
            marks.append(one)
            if shares:
                one = np.zeros((m, COLUMNS), np.float32)
                one[where] = weight[some] / total[text[some]]
                weights.append(one)
        both += marks[0] @ marks[1].T
        if shares:
            shares[0][:] += weights[0] @ marks[1].T
            shares[1][:] += marks[0] @ weights[1].T
    union = size[left][:, None] + size[right][None, :] - both
    bound = np.divide(both, union, out=np.zeros(shape), where=union > 0)
    exact = once[left][:, None] & once[right][None, :]
    if shares:
        bound = np.where(exact, bound, np.minimum(*shares) + 1e-5)  # single precision
    open_ = (root[left][:, None] != root[right][None, :]) & (bound >= threshold)
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    found = []
    for sure in (True, False):
        i, j = np.nonzero(open_ & (exact == sure))
        if sure:  # one link for each two classes
            _, some = np.unique(np.stack([root[left][i], root[right][j]]), axis=1, return_index=True) if len(i) else (None, np.zeros(0, int))
        else:
            some = np.argsort(-bound[i, j], kind="stable")
        for x, y in zip(i[some].tolist(), j[some].tolist(), strict=True):
            u, v = left[x], right[y]
            a, b = find(int(root[u])), find(int(root[v]))
            if a == b:
                continue
            if not sure:
                p, q = text == u, text == v
                if probability_jaccard(h[p], weight[p], h[q], weight[q]) < threshold:
                    continue
            parent[a] = b
            found.append((int(u), int(v)))
    return found


def block_links(large: DataFrame, words: DataFrame, near: float, k: int, threshold: float, block: int, most_words: int) -> DataFrame:
    """(a, b): links of these buckets' open blocks, enough to connect what links. large: bucket, node, root, d, w."""
    placed = staged(dealt(large, near, block, most_words), "placed")
    blocks = placed.groupBy("bucket", "c", "p").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    x, y = blocks.alias("x"), blocks.alias("y")
    ordered = "(x.c < y.c or (x.c = y.c and x.p <= y.p)) and not (x.c = y.c and x.c >= 0)"
    skipped = f"((x.d1 <= {near!r} and y.d0 - x.d1 > {near!r}) or (y.d1 <= {near!r} and x.d0 - y.d1 > {near!r}))"
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & F.expr(f"{ordered} and not {skipped}"))
    pairs = staged(pairs.select("x.bucket", F.col("x.c").alias("c1"), F.col("x.p").alias("p1"), F.col("y.c").alias("c2"), F.col("y.p").alias("p2")).withColumn("pair", F.monotonically_increasing_id()), "block_pairs")
    one = pairs.select("pair", "bucket", F.col("c1").alias("c"), F.col("p1").alias("p"), F.expr("c1 = c2 and p1 = p2").alias("l"), F.lit(True).alias("left"))
    two = pairs.where("not (c1 = c2 and p1 = p2)").select("pair", "bucket", F.col("c2").alias("c"), F.col("p2").alias("p"), F.lit(True).alias("l"), F.lit(False).alias("left"))
    sides = one.unionByName(two).select("pair", "bucket", "c", "p", "left", F.col("l").alias("right")).join(placed, ["bucket", "c", "p"]).select("pair", "node", "root", "left", "right")
    full = sides.join(words, "node").select("pair", "node", "root", "left", "right", "words")

    def run(group):
        t = group.combine_chunks()
        flat, offsets = list_parts(t.column("words").combine_chunks())
        h, text, weight = weighted(*shingles(flat, offsets, k))
        left, right = (np.flatnonzero(t.column(c).to_numpy(zero_copy_only=False)) for c in ("left", "right"))
        node = t.column("node").to_numpy()
        found = forest(h, text, weight, left, right, t.column("root").to_numpy(), threshold)
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(node[at[:, 0]], pa.int64()), "b": pa.array(node[at[:, 1]], pa.int64())})

    return full.groupBy("pair").applyInArrow(run, "a long, b long")


def classes_of(docs: DataFrame, id_col: str, text_col: str, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
               k: int = SHINGLE, band_open: int = BAND_OPEN, block: int = BLOCK, block_words: int = BLOCK_WORDS) -> DataFrame:
    """id, KEY, times (rows with that id and words), class_id, class_size, kept; null ids are not in it."""
    each, nodes, text = nodes_of(docs, id_col, text_col)
    made = bands_of(text, bands, rows, k).join(nodes.select("node", F.col("first").alias("id"), *KEY), ["id", *KEY]).dropDuplicates(["node"])
    keys = staged(made.select("node", F.explode("buckets").alias("bucket")), "bands")
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    bucket = staged(keys.join(sizes, "bucket"), "buckets")
    crowd = staged(nodes.join(bucket.select("node").distinct(), "node"), "crowd")
    words = staged(picked(text, crowd), "words")

    # Leaders. A text that the copies of a group were made from meets most of them.
    near = 1 - threshold + 1e-9
    scores = bucket.groupBy("node").agg(F.sum("n").alias("score"))
    lead = bucket.join(scores, "node").groupBy("bucket").agg(F.max(F.struct("score", "node")).alias("top"))
    led = staged(bucket.join(lead.select("bucket", F.col("top.node").alias("leader")), "bucket").select("bucket", "node", "leader"), "led")
    met = staged(led.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "met")
    known = staged(similarities(met, words, k, threshold - 1e-9), "sims")
    links = known.where(F.col("sim") >= 1 - near).select("a", "b")
    classes = components(links)

    # What is still open.
    held = led.join(known.select(F.col("a").alias("leader"), F.col("b").alias("node"), (1 - F.col("sim")).alias("d")), ["leader", "node"], "left").fillna(0.0, ["d"])
    held = staged(rooted(held, classes).select("bucket", "node", "leader", "root", "d"), "held")
    few, large = split_buckets(held, near, band_open)
    pairs = open_pairs(held.join(few, "bucket"), near)
    either = known.select("a", "b").unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
    fresh = staged(pairs.join(either, ["a", "b"], "left_anti"), "fresh")
    more = similarities(fresh, words, k, threshold - 1e-9).where(F.col("sim") >= 1 - near).select("a", "b")
    wide = held.join(large, "bucket").join(nodes.select("node", F.col("k3").alias("w")), "node")
    more = more.unionByName(block_links(wide, words, near, k, threshold - 1e-9, block, block_words))
    more = staged(more, "links")
    if more.limit(1).count():
        classes = components(classes.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))

    whole = staged(rooted(nodes, classes), "whole")
    heads = whole.groupBy("root").agg(F.min(F.struct("first", *KEY)).alias("head"), F.sum("copies").alias("class_size"))
    own = whole.join(heads, "root").select(*KEY, F.col("head.first").alias("class_id"), "class_size", F.expr("head.k1 = k1 and head.k2 = k2 and head.k3 = k3").alias("heads"))
    found = each.join(own, KEY)
    return found.select("id", *KEY, "times", "class_id", "class_size", (F.col("heads") & (F.col("id") == F.col("class_id"))).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each id and words: id_col, class_id (smallest id of the class), class_size, kept."""
    found = classes_of(docs, id_col, text_col, **how).select(F.col("id").alias(id_col), "class_id", "class_size", "kept")
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col), F.lit(None).cast(found.schema["class_id"].dataType).alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"))
    return found.unionByName(nameless)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay, one document of each class, with all their columns; rows without an id stay."""
    names = private(docs, "id", *KEY, "times")
    stays = staged(classes_of(docs, id_col, text_col, **how).where("kept").select("id", *KEY, "times"), "stays").toDF(*names)
    words = word_hashes(text_or_empty(text_col))
    own = docs.where(F.col(id_col).isNotNull()).withColumn(names[1], F.xxhash64(words)).withColumn(names[2], F.hash(words, F.lit(7))).withColumn(names[3], F.size(words)).withColumn(names[0], F.col(id_col))
    once = own.join(stays.where(F.col(names[4]) == 1), names[:4], "left_semi")
    again = own.join(stays.where(F.col(names[4]) > 1), names[:4], "left_semi").dropDuplicates(names[:4])
    plain = [quoted(c) for c in docs.columns]
    return once.select(*plain).unionByName(again.select(*plain)).unionByName(docs.where(F.col(id_col).isNull()))
