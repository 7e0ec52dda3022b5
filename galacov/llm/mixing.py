"""Mixing sources to target weights by exact budgets of words. DataFrame functions only.

A source's rank is its place in code point order, null last; its weight is WEIGHTS[rank mod 3]. Sources share
`share` times all words by weight; a target stops at `most_epochs` times its source's words, and what that leaves over is
shared again by weight among the others until no target is above its stop. That fixed point is min(stop, weight x level)
with one level for all, which sorted stops and running sums give at once.

A source is taken in the order of a hash of the id: whole epochs first, then the documents up to the rest of its budget;
the document across the cut gives its first words only, so that a source's words meet its budget (its target, rounded
to a whole number) exactly. The order is a range sort: each source's hash range is dealt into pieces of about PIECE rows,
sums of pieces and of groups of pieces give each piece its offset, and only rows of one piece are sorted together. A
source that holds a third of all rows is a third of all pieces.

Cases: null text has no words and is never taken. Null sources are one source. Rows without an id hash by their text; rows
that repeat an id follow each other, smaller first. An empty table, or one without words, gives zeros. Only id, text and
source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import private, quoted, staged, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE, MOST_EPOCHS = 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a piece, and pieces of a group of pieces.
PIECE, GROUP = 2048, 1024
SEED = "mix-1"


def targets(sizes: DataFrame, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size): a row for each source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    own = ranked.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most_epochs).alias("stop"))
    up = Window.orderBy((F.col("stop") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    own = own.select(
        "source", "source_size", "w", "stop",
        (F.sum("source_size").over(all_rows) * F.lit(share)).alias("budget"),
        F.coalesce(F.sum("stop").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("w").over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("w_rest"),
        F.row_number().over(up).alias("at"))
    # The first source, from the least stop for its weight, that its share does not fill: it and all above share the rest.
    level = (F.col("budget") - F.col("below")) / F.col("w_rest")
    own = own.withColumn("open", F.col("w") * level < F.col("stop")).withColumn(
        "cut", F.min(F.when(F.col("open"), F.struct("at", "budget", "below", "w_rest"))).over(all_rows))
    rest = F.col("w") * (F.col("cut.budget") - F.col("cut.below")) / F.col("cut.w_rest")
    return own.select("source", "source_size", F.when(F.col("cut").isNull() | (F.col("at") < F.col("cut.at")), F.col("stop").cast("double")).otherwise(rest).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        share: float = SHARE, most_epochs: int = MOST_EPOCHS, seed: str = SEED, piece: int = PIECE) -> DataFrame:
    """One row for each row of docs: id_col, size, source_size, target, taken (words, repeats counted)."""
    found = mixed_rows(docs, None, id_col, text_col, source_col, share, most_epochs, seed, piece)
    return found.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame, row_col: str | None, id_col: str, text_col: str, source_col: str, share: float = SHARE, most_epochs: int = MOST_EPOCHS,
               seed: str = SEED, piece: int = PIECE) -> DataFrame:
    """row (of row_col, if there is one), id, size, source_size, target, taken."""
    text = text_or_empty(text_col)
    name = F.when(F.col(id_col).isNull(), F.md5(text)).otherwise(F.col(id_col).cast("string"))
    key = F.conv(F.substring(F.md5(F.concat(name, F.lit(f"|{seed}"))), 1, 15), 16, 10).cast("long")
    row = F.col(row_col) if row_col else F.lit(0).cast("long")
    rows = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), key.alias("key"))
    rows = staged(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = targets(sources.select("source", "source_size"), share, most_epochs)
    plan = plan.join(sources.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = staged(plan.select("source", "source_size", "target", F.expr(f"(n + {piece} - 1) div {piece}").alias("pieces")), "plan")
    known = plan.withColumnRenamed("source", "s")
    dealt = rows.join(F.broadcast(known) if sources_fit(known) else known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # The leading 30 of the key's 60 bits place it in its source's range; larger keys never get smaller pieces.
    dealt = dealt.withColumn("piece", F.expr("shiftright(shiftright(key, 30) * pieces, 30)"))
    sums = staged(dealt.groupBy("source", "piece").agg(F.sum("size").alias("words")), "pieces")
    sums = sums.withColumn("grp", F.expr(f"piece div {GROUP}"))
    groups = sums.groupBy("source", "grp").agg(F.sum("words").alias("words"))
    before = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(F.col("source").alias("s"), F.col("grp").alias("g"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("group_from"))
    within = Window.partitionBy("source", "grp").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("in_group", F.coalesce(F.sum("words").over(within), F.lit(0)))
    starts = starts.join(groups, F.col("source").eqNullSafe(F.col("s")) & (F.col("grp") == F.col("g")))
    starts = starts.select(F.col("source").alias("s"), F.col("piece").alias("p"), (F.col("group_from") + F.col("in_group")).alias("piece_from"))
    placed = dealt.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("piece") == F.col("p")))
    inside = Window.partitionBy("source", "piece").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("from", F.col("piece_from") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    budget = F.least(F.round("target").cast("long"), F.col("source_size") * most_epochs)
    placed = placed.withColumn("budget", budget).withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(F.lit(0)))
    last = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("from")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), last))
    return placed.select("row", "id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def sources_fit(plan: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources has at most `most` rows, and so may be broadcast."""
    return plan.count() <= most


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself, with the columns of docs: a document stands once for each time that it is taken whole, and once
    more with its first words where the cut falls inside it. Where ids repeat, rows are written with numbers first, so that
    each is taken as itself."""
    row, own_id, size, taken, part = private(docs, "row", "id", "size", "taken", "part")
    plain = docs.columns
    if docs.groupBy(id_col).count().where("count > 1").limit(1).count():
        docs = staged(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
        found, here = mixed_rows(docs, row, id_col, text_col, source_col, **how).select(F.col("row").alias(own_id), "size", "taken"), row
    else:
        found, here = mixed_rows(docs, None, id_col, text_col, source_col, **how).select(F.col("id").alias(own_id), "size", "taken"), id_col
    found = found.where("taken > 0").toDF(own_id, size, taken)
    own = docs.join(found, F.col(quoted(here)).eqNullSafe(F.col(own_id)))
    own = own.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"({taken} - 1) div {size}"))))
    words = F.expr(f"least({size}, {taken} - {part} * {size})")
    # Of the document across the cut: as many words, each with the white space before it.
    cut = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), words.cast("int")), "")
    text = F.when(words < F.col(size), cut).otherwise(F.col(text_col))
    return own.select(*[text.alias(c) if c == text_col else F.col(quoted(c)) for c in plain])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || '|mix-1'), 1, 15))::BIGINT AS k
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT source, source_size, 2 * source_size AS stop,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM s
), u AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(stop) OVER (ORDER BY stop::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS below,
         (sum(w) OVER (ORDER BY stop::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_rest,
         row_number() OVER (ORDER BY stop::DOUBLE / w, source NULLS LAST) AS a
  FROM r
), c AS (
  SELECT a AS cut_at, budget, below, w_rest FROM u WHERE w * ((budget - below) / w_rest) < stop ORDER BY a LIMIT 1
), t AS (
  SELECT u.source, u.source_size, u.stop,
         CASE WHEN c.cut_at IS NULL OR u.a < c.cut_at THEN u.stop::DOUBLE ELSE u.w * (c.budget - c.below) / c.w_rest END AS target
  FROM u LEFT JOIN c ON true
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, least(round(t.target)::BIGINT, t.stop) AS b,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS f
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0::BIGINT
            ELSE (b // source_size) * size + greatest(0, least(size, b - (b // source_size) * source_size - f)) END::BIGINT AS taken
FROM p
"""
