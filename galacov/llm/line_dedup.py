"""Line dedup by an exact set-similarity join. DataFrame functions only.

A text's lines (between line feeds) are sets of words (lower-cased, between white space). Two lines match when the
Jaccard similarity of their sets is at least 4/5; a line goes if an earlier one (by document id, then line number)
matches it. Equal sets are one class (told by 96 bits of hash and
their size), named by its first line; the join runs over classes.

Words are ordered by rarity: a count of sets for each of SLOTS hash slots, on a log scale, then the word's hash. Any
fixed order gives exact results, so the counts are taken from one document in SAMPLE, and their table is bounded. With sizes m <= n, a match needs an overlap of
at least ceil(4 (m + n) / 9) and m >= 4 n / 5 (length filter); so the first common word lies in the first
n - ceil(4 n / 5) + 1 words of the longer set and the first m - ceil(8 m / 9) + 1 of the shorter one (prefix filter), and
the words from there on must still suffice in both (positional filter). A parity bit for each of 64 hash slots (128
between sets above LONG words) bounds the symmetric difference from below, and 256 further ones, made for the sets of candidate pairs only, spare most of what
remains from moving its words. Candidates are verified on 64-bit hashes of all their words.

Large groups of near copies have links by the square of their size, so most of these are counted without a row for
each. A pivot is the majority of the words of sampled sets that share three of their extreme hashes. A set A that finds
pivot P has d = |A xor P| and t = 9 d - |A|; sets A and B of one pivot differ by at most d(A) + d(B) words, so they match
wherever t(A) + t(B) <= 0. A running sum over t counts these, with the earliest of them, and the join leaves them out; all
other pairs go through it. Pivots decide on work only, never on results, whatever the sample holds.

A frequent line is one row for each map task; a frequent word is in a prefix only of lines that have no rarer ones, and
the join on it is one that Spark splits where it is skewed. Sets below 4 words match only their equals.

Ids are whole numbers. Cases: a null text counts as empty and has one line without words; such lines always stay. Rows without an id are left
out; rows that repeat an id are lines of the same place, and only texts that differ add lines. An empty table gives no
rows. Only id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import private, quoted, staged, text_or_empty

SLOTS, SLOT_BITS = 1 << 16, 16
#: White space other than spaces and line feeds.
ODD_SPACE = r"[\s\p{Z}&&[^ \n]]"
#: Most candidate sets that are sent to all tasks (some 150 bytes each there) to pick their texts; with more, texts are
#: shuffled instead.
SENT = 500_000
HASH_BITS = 57
#: Words beyond which a set has a second word of parity bits: 64 slots tell little about long lines.
LONG = 48
BITS = ["bits", "more"]
SET = ["s1", "s2", "n"]
#: Of this many documents one is sampled, for the order of words and for pivots; neither changes a result.
SAMPLE = 8
#: Sampled sets that a pivot has to settle, those that vote on its words, and the most words and pivots (sets that find
#: none are joined like all others).
GROUP, VOTES, PIVOT_WORDS, PIVOTS = 6, 16, 1000, 2048
#: What a set has of its pivot, if any: the pivot's number (0: none) and t.
OWN = ["pivot", "t"]


def long(x) -> Column:
    return F.lit(x).cast("long")


def spaced(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, text with every white space but line feeds as a space."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text"))
    plain = F.octet_length("text") == F.length("text")  # ASCII, where few characters are white space
    for c in "\t\v\f\r":
        plain = plain & ~F.contains("text", F.lit(c))
    return own.withColumn("text", F.when(plain, F.col("text")).when(F.rlike("text", F.lit(ODD_SPACE)), F.regexp_replace("text", ODD_SPACE, " ")).otherwise(F.col("text")))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spaced(docs, id_col, text_col).select("doc", F.posexplode(F.split("text", "\n")).alias("line", "text"))


def hashes(line: Column) -> Column:
    """64-bit hashes of a line's different words; what stands between two spaces is no word."""
    each = F.transform(F.split(F.lower(line), " "), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(each), F.xxhash64(F.lit("")))


def sampled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """s, h: the different sets of one document in SAMPLE, as their sorted words."""
    some = docs.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), long(SAMPLE)) == 0)
    sets = lines_of(some, id_col, text_col).select(F.sort_array(hashes(F.col("text"))).alias("h")).where(F.size("h") > 0)
    return staged(sets.select(F.xxhash64("h").alias("s"), "h").dropDuplicates(["s"]), "sample")


def slot_ranks(sample: DataFrame) -> list[int]:
    """The log-scaled counts of all slots (0 for none); SLOTS rows at most come to the driver."""
    counts = sample.select(F.explode("h").alias("h")).groupBy(F.col("h").bitwiseAND(long(SLOTS - 1)).alias("slot")).agg(F.count("*").alias("n"))
    ranks = [0] * SLOTS
    for row in counts.select("slot", F.floor(F.log2("n")).cast("int").alias("rank")).collect():
        ranks[row["slot"]] = row["rank"]
    return ranks


def marks(h: str) -> Column:
    """Names of triples among the least and the largest words of the sorted h; near copies share some of them, also where
    words at one end differ."""
    return F.array(*[F.xxhash64(*[F.element_at(h, i) for i in some]) for some in ((1, 2, -1), (1, 2, -2), (2, 3, -1), (1, -1, -2), (2, -1, -2), (1, -2, -3))])


def off_pivot(h: str, words: str) -> Column:
    """t of the set h for a pivot of these words."""
    return 9 * (F.size(h) + F.size(words) - 2 * F.size(F.array_intersect(h, words))) - F.size(h)


def pivots_of(sample: DataFrame) -> DataFrame:
    """pivot (from 1, those that settle most sets first), words, marks; PIVOTS rows at most. Below 9 words nothing but the pivot itself
    can have t <= 0."""
    each = sample.where(F.size("h") >= 9).select("s", F.explode(marks("h")).alias("mark"))
    often = each.groupBy("mark").agg(F.count("*").alias("n")).where(F.col("n") >= GROUP)
    voters = each.join(often, "mark").where(F.pmod(F.xxhash64("s"), F.ceil(F.col("n") / VOTES)) == 0)
    voters = staged(voters.join(sample, "s"), "voters")
    total = voters.groupBy("mark").agg(F.count("*").alias("voters"))
    votes = voters.select("mark", F.explode("h").alias("word")).groupBy("mark", "word").agg(F.count("*").alias("votes"))
    most = votes.join(total, "mark").where(2 * F.col("votes") > F.col("voters")).groupBy("mark").agg(F.sort_array(F.collect_list("word")).alias("words"))
    most = most.where(F.size("words") <= PIVOT_WORDS)
    near = voters.join(most, "mark").where(off_pivot("h", "words") <= 0).groupBy("mark", "words").agg((F.count("*") * F.ceil(F.first("n") / VOTES)).alias("settled"))
    best = near.where(F.col("settled") >= GROUP).groupBy("words").agg(F.max("settled").alias("settled"), F.collect_list("mark").alias("marks"))
    best = best.orderBy(F.desc("settled"), F.xxhash64("words")).limit(PIVOTS)
    number = F.row_number().over(Window.orderBy(F.desc("settled"), F.xxhash64("words")))
    return staged(best.select(number.alias("pivot"), "words", "marks"), "pivots")


def mark_table(pivots: DataFrame) -> list[int]:
    """For each slot of marks, the upper bits of a mark and its pivot's number; of marks that meet, the one whose pivot settles more."""
    found = [0] * SLOTS
    for row in sorted(pivots.select("pivot", "marks").collect(), reverse=True):
        for mark in row["marks"]:
            found[mark & (SLOTS - 1)] = (mark >> SLOT_BITS & 0xFFFFFFFF) << SLOT_BITS | row["pivot"]
    return found


def longest_prefix(n: Column) -> Column:
    return n - F.ceil(4 * n / 5).cast("int") + 1


def parity(words: str, bit, lane=None) -> Column:
    """64 parity bits: bit(word) flips for each word (of which lane(word) holds)."""
    one = lambda w: F.call_function("shiftleft", long(1), bit(w).cast("int"))
    flip = one if lane is None else lambda w: F.when(lane(w), one(w)).otherwise(long(0))
    return F.aggregate(words, long(0), lambda acc, w: acc.bitwiseXOR(flip(w)))


def constant(numbers: list[int]) -> Column:
    """An array that is folded into one."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<long>")


def keyed(lines: DataFrame, ranks: list[int], pivots: DataFrame, found: list[int]) -> DataFrame:
    """doc, line, SET (a 96-bit name of the set and its size), OWN, BITS (parities of all words, and of one half of them) and the prefix, rarest words first."""
    table, by_mark = constant([r << HASH_BITS for r in ranks]), constant(found)
    slot = lambda h: (h.bitwiseAND(long(SLOTS - 1)) + 1).cast("int")
    key = lambda h: F.coalesce(F.element_at(table, slot(h)), long(0)).bitwiseOR(F.shiftrightunsigned(h, 64 - HASH_BITS))
    rows = lines.select("doc", "line", F.sort_array(hashes(F.col("text"))).alias("h"))
    number = lambda m: F.element_at(by_mark, slot(m))
    meant = lambda m: F.shiftright(number(m), SLOT_BITS) == F.shiftright(m, SLOT_BITS).bitwiseAND(long(0xFFFFFFFF))
    numbers = F.transform(marks("h"), lambda m: F.when(meant(m), number(m).bitwiseAND(long(SLOTS - 1))))
    own = F.when(F.size("h") >= 9, F.array_min(F.filter(numbers, lambda p: p > 0))).cast("int") if any(found) else F.lit(None).cast("int")
    rows = rows.select("doc", "line", "h", F.sort_array(F.transform("h", key)).alias("keys"), F.size("h").alias("n"), own.alias("pivot"))
    some = F.col("n") >= 4
    prefix = F.when(some, F.transform(F.slice("keys", F.lit(1), longest_prefix(F.col("n"))), lambda k: F.shiftright(k, 6).bitwiseAND(long(0x7FFFFFFF)).cast("int")))
    bits = F.when(some, parity("keys", lambda k: k.bitwiseAND(long(63)))).otherwise(long(0))
    more = F.when(F.col("n") > LONG, parity("keys", lambda k: k.bitwiseAND(long(63)), lambda k: k.bitwiseAND(long(64)) == 0)).otherwise(long(0))
    rows = rows.select("doc", "line", F.xxhash64("keys").alias("s1"), F.hash("keys").alias("s2"), "n", bits.alias("bits"), more.alias("more"), prefix.alias("prefix"), F.when(F.col("pivot").isNotNull(), F.col("h")).alias("h"), "pivot")
    rows = rows.join(F.broadcast(pivots.select("pivot", "words")), "pivot", "left").withColumn("t", off_pivot("h", "words"))
    near = F.coalesce(F.col("t") <= F.col("n"), F.lit(False))  # beyond it, nothing is settled but with the pivot's own copies
    return rows.select("doc", "line", *SET, *BITS, "prefix", F.when(near, F.col("pivot")).otherwise(0).alias("pivot"), F.when(near, F.col("t")).otherwise(0).alias("t"))


def place(doc: Column, line: Column) -> Column:
    """The order of lines as one number, which an aggregation can keep in place."""
    return doc.cast("decimal(20,0)") * F.lit(10_000_000_000).cast("decimal(11,0)") + line.cast("decimal(10,0)")


def placed(place: str) -> tuple[Column, Column]:
    """The document and line of such a number."""
    ten = F.lit(10_000_000_000).cast("decimal(11,0)")
    line = F.pmod(place, ten).cast("long")
    return ((F.col(place) - line) / ten).cast("long"), line


def candidates(sets: DataFrame) -> DataFrame:
    """(a, b, m): two sets that pass the filters and that no pivot settles, a the shorter, and the sum of their sizes."""
    rows = sets.where("n >= 4").select("set", "n", *BITS, *OWN, F.posexplode("prefix").alias("pos", "word"))
    x, y = rows.alias("x"), rows.alias("y")
    shorter = F.expr("x.n < y.n or (x.n = y.n and x.set < y.set)")
    length = F.expr("5 * x.n >= 4 * y.n")
    position = F.expr("9 * least(x.n - x.pos, y.n - y.pos) >= 4 * (x.n + y.n)")
    difference = F.expr(f"9 * if(x.n > {LONG} and y.n > {LONG}, bit_count(x.more ^ y.more) + bit_count(x.bits ^ y.bits ^ x.more ^ y.more), bit_count(x.bits ^ y.bits)) <= x.n + y.n")
    unsettled = F.expr("x.pivot = 0 or x.pivot != y.pivot or x.t + y.t > 0")
    met = x.join(y, (F.col("x.word") == F.col("y.word")) & shorter & unsettled & length & position & difference)
    return met.select(F.col("x.set").alias("a"), F.col("y.set").alias("b"), (F.col("x.n") + F.col("y.n")).alias("m")).distinct()


def matches(lines: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose words overlap enough."""
    wanted = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    doc, line = placed("first")
    wanted = sets.join(wanted, "set", "left_semi").select("set", doc.alias("doc"), line.cast("int").alias("line"))
    few = wanted.count() <= SENT
    text = lines.join(F.broadcast(wanted) if few else wanted, ["doc", "line"]).dropDuplicates(["set"]).withColumn("w", hashes(F.col("text")))
    lanes = [parity("w", lambda h: F.shiftrightunsigned(h, 22).bitwiseAND(long(63)), lambda h, k=k: F.shiftrightunsigned(h, 28).bitwiseAND(long(3)) == k).alias(f"p{k}") for k in range(4)]
    text = staged(text.select("set", "w", *lanes), "words")
    x, y = text.drop("w").alias("x"), text.drop("w").alias("y")
    differ = F.expr(" + ".join(f"bit_count(x.p{k} ^ y.p{k})" for k in range(4)))
    close = pairs.join(x, F.col("a") == F.col("x.set")).join(y, F.col("b") == F.col("y.set")).where(9 * differ <= F.col("m"))
    close = close.select("a", "b", "m")
    x, y = text.select("set", "w").alias("x"), text.select("set", "w").alias("y")
    both = close.join(x, F.col("a") == F.col("x.set")).join(y, F.col("b") == F.col("y.set"))
    return both.where(9 * F.size(F.array_intersect("x.w", "y.w")) >= 4 * F.col("m")).select("a", "b")


def settled(sets: DataFrame) -> DataFrame:
    """set, n_links, earliest of the links that pivots settle: sets A, B of one pivot with t(A) + t(B) <= 0."""
    some = sets.where("pivot > 0").select("set", *OWN, "first")
    steps = some.groupBy(*OWN).agg(F.count("*").alias("sets"), F.min("first").alias("first"))
    ends = steps.select("pivot", (-F.col("t")).alias("t"), F.lit(1).alias("end"), long(0).alias("sets"), F.lit(None).cast(sets.schema["first"].dataType).alias("first"))
    upto = Window.partitionBy("pivot").orderBy("t", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = steps.select(*OWN, F.lit(0).alias("end"), "sets", "first").union(ends)
    sums = sums.select("pivot", (-F.col("t")).alias("t"), "end", F.sum("sets").over(upto).alias("n_links"), F.min("first").over(upto).alias("earliest"))
    with_own = some.join(sums.where("end = 1").drop("end"), OWN)
    return with_own.select("set", (F.col("n_links") - F.when(F.col("t") <= 0, 1).otherwise(0)).alias("n_links"), "earliest").where("n_links > 0")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each line: id_col, line, n_words, class_doc and class_line (the first line of the same words),
    class_size, n_links (other classes that match), kept."""
    lines = lines_of(docs, id_col, text_col)
    sample = sampled(docs, id_col, text_col)
    pivots = pivots_of(sample)
    named = staged(keyed(lines, slot_ranks(sample), pivots, mark_table(pivots)), "named")
    sets = named.groupBy(*SET, *OWN, *BITS, "prefix").agg(F.min(place(F.col("doc"), F.col("line"))).alias("first"), F.count("*").alias("class_size"))
    sets = staged(sets.withColumn("set", F.monotonically_increasing_id()), "sets")
    pairs = staged(candidates(sets), "pairs")
    links = staged(matches(lines, sets, pairs), "links")
    order = sets.select(F.col("set").alias("b"), "first")
    each = links.union(links.select("b", "a")).toDF("a", "b").join(order, "b").select(F.col("a").alias("set"), long(1).alias("n_links"), F.col("first").alias("earliest"))
    each = each.union(settled(sets)).groupBy("set").agg(F.sum("n_links").alias("n_links"), F.min("earliest").alias("earliest"))
    known = sets.drop("prefix", *BITS, *OWN).join(each, "set", "left")
    doc, line = placed("first")
    known = known.select(*SET, "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce(F.col("earliest") < F.col("first"), F.lit(False)).alias("beaten"), doc.alias("class_doc"), line.alias("class_line"))
    found = named.drop("prefix", *BITS, *OWN).join(known, SET)
    stays = (F.col("n") == 0) | (~F.col("beaten") & (F.col("class_doc") == F.col("doc")) & (F.col("class_line") == F.col("line")))
    return found.select(F.col("doc").alias(id_col), "line", F.col("n").alias("n_words"), "class_doc", "class_line", "class_size", "n_links", stays.alias("kept"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that go removed from their texts."""
    own_id, own_gone = private(docs, "id", "gone")
    gone = line_dedup(docs, id_col, text_col).where(~F.col("kept")).groupBy(F.col(id_col).alias(own_id)).agg(F.collect_set("line").alias(own_gone))
    own = docs.join(gone, F.col(id_col).cast("long") == F.col(own_id), "left")
    rest = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~F.array_contains(F.col(own_gone), i))
    text = F.when(F.col(own_gone).isNull(), F.col(text_col)).otherwise(F.array_join(rest, "\n"))
    return own.select(*[text.alias(c) if c == text_col else F.col(quoted(c)) for c in docs.columns])


SQL = r"""
WITH l0 AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents
), l AS (
  SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(t), '[\s\p{Z}\v]+'), lambda w: w <> ''))) AS w FROM l0
), s AS (
  SELECT w, len(w) AS n, min((doc_id, line)) AS f, count(*) AS class_size, row_number() OVER (ORDER BY min((doc_id, line))) AS id FROM l GROUP BY w
), t AS (
  SELECT id, n, unnest(w) AS word FROM s WHERE n >= 4
), df AS (
  SELECT word, count(*) AS c FROM t GROUP BY word
), p AS (
  SELECT id, n, word FROM (SELECT t.id, t.n, t.word, row_number() OVER (PARTITION BY t.id ORDER BY c, t.word) AS k FROM t JOIN df ON t.word = df.word)
  WHERE k <= n - ceil(4 * n / 5) + 1
), c AS (
  SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y ON x.word = y.word AND x.id < y.id AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
), m AS (
  SELECT c.a, c.b FROM c JOIN s x ON c.a = x.id JOIN s y ON c.b = y.id WHERE 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)
), e AS (
  SELECT a, count(*) AS n_links, min(b) AS b FROM (SELECT a, b FROM m UNION ALL SELECT b, a FROM m) GROUP BY a
)
SELECT l.doc_id, l.line::INTEGER AS line, s.n::INTEGER AS n_words, (s.f)[1]::BIGINT AS class_doc, (s.f)[2]::BIGINT AS class_line, s.class_size,
       coalesce(e.n_links, 0)::BIGINT AS n_links,
       s.n = 0 OR (coalesce(e.b, s.id) >= s.id AND s.f = (l.doc_id, l.line)) AS kept
FROM l JOIN s ON l.w = s.w LEFT JOIN e ON s.id = e.a
"""
