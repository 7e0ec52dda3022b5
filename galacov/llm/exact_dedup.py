"""Exact dedup over an extendible-hash index on shared files. DataFrame functions only.

Texts are equal when identical after each run of ASCII white space became one space. The index maps a 64-bit key of the
normalised text to a bucket, a range of keys with the same leading bits. The directory starts with a cell for each
`capacity` keys; a bucket with more keys is split by one more bit, again and again until none is overfull or its keys are
all the same, and only the keys of overfull buckets are read again. A cell lists the buckets below it, so a bucket that
splits deeply costs its own entries, not a doubling for all others.

Insertion: copies are combined first, byte by byte, in the map tasks and again where they meet, so a text with any number
of copies is one entry (key, SHA-256, smallest id, size). Entries are dealt to owner tasks by ranges of keys; an owner
chains the entries that share a key and writes its buckets' files in the order of keys. Look-up: a row goes by its key
through the directory to its bucket and along the key's chain to the entry with its SHA-256. Every row's own text was
compared as bytes when it was inserted; two entries of a chain with one SHA-256 would be ambiguous, and raise.

Cases: a null text counts as empty, and all empty texts are one group. Of rows with the same id and text one stays.
Groups whose ids are all null keep one null-id row. Ids may be of any type that has an order. An empty table gives no
rows. Further columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import private, quoted, staged, text_or_empty

#: ASCII white space: space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = r"[\x20\x09-\x0D]+"
#: Keys in a bucket before it splits.
CAPACITY = 4096
#: Most rows (cells of the directory, rows that go) that are sent to all tasks; with more, they are shuffled.
SENT = 200_000


def normalised(text_col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text_col), WHITE, " ")


def key_of(text: Column, key_bits: int = 64) -> Column:
    """Leading key_bits of a 64-bit hash; fewer than 64 only to force collisions in tests."""
    h = F.xxhash64(text)
    return h if key_bits >= 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - key_bits), 64 - key_bits)


def prefix(depth: int) -> Column:
    return F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")


def in_order(key: Column) -> Column:
    """The key's bits as a number whose signed order is that of the bits."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def few(df: DataFrame) -> DataFrame:
    """df (staged) for a join: sent to all tasks if its rows are few."""
    return F.broadcast(df) if df.count() <= SENT else df


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame, int]:
    """Cells (cell, buckets), buckets (bucket, local_depth, n), and the depth of the cells. A bucket's name is its first
    key in order. keys: a column key, all different."""
    total = keys.count()
    depth = base = max(0, (total // capacity).bit_length() - 1)
    leaves = None
    while True:
        own = keys.groupBy(prefix(depth).alias("prefix")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        own = staged(own.withColumn("full", (F.col("n") > capacity) & (F.col("lo") != F.col("hi"))), "buckets")
        start = F.shiftleft("prefix", 64 - depth) if depth else F.lit(0).cast("long")
        done = own.where("not full").select(in_order(start).alias("bucket"), F.lit(depth).alias("local_depth"), "n")
        leaves = done if leaves is None else leaves.unionByName(done)
        full = own.where("full").select("prefix")
        if not full.limit(1).count():
            break
        keys = staged(keys.withColumn("prefix", prefix(depth)).join(few(full), "prefix", "left_semi").select("key"), "overfull")
        depth += 1
    leaves = staged(leaves, "buckets")
    cell = F.shiftrightunsigned(in_order(F.col("bucket")), 64 - base) if base else F.lit(0).cast("long")
    cells = leaves.groupBy(cell.alias("cell")).agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    return staged(cells, "directory"), leaves, base


def located(rows: DataFrame, cells: DataFrame, base: int) -> DataFrame:
    """rows (with key) with the bucket that the directory names."""
    found = rows.withColumn("cell", prefix(base)).join(few(cells), "cell")
    bucket = F.array_max(F.filter("buckets", lambda b: b <= in_order(F.col("key"))))
    return found.withColumn("bucket", bucket).drop("cell", "buckets")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                key_bits: int = 64) -> tuple[DataFrame, DataFrame, int]:
    """The index as written to shared files (bucket, key, chain: 0, 1, ... for different texts of one key, text_sha256,
    keep_id, group_size), and the directory's cells and depth."""
    text = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    same = text.groupBy(key_of(F.col("t"), key_bits).alias("key"), "t").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = staged(same.select("key", F.sha2("t", 256).alias("text_sha256"), "keep_id", "group_size"), "entries")
    cells, _, base = directory(entries.select("key").distinct(), capacity)
    owned = located(entries, cells, base).repartitionByRange("bucket", "key")
    along = Window.partitionBy("bucket", "key").orderBy("text_sha256")
    twin = F.lag("text_sha256").over(along) == F.col("text_sha256")
    clear = F.when(twin, F.raise_error(F.lit("two texts share a key and a SHA-256"))).otherwise(F.lit(0))
    chained = owned.withColumn("chain", F.row_number().over(along) - 1 + clear.cast("int"))
    index = chained.select("bucket", "key", "chain", "text_sha256", "keep_id", "group_size")
    return staged(index.sortWithinPartitions("bucket", "key", "chain"), "index"), cells, base


def look_up(rows: DataFrame, index: DataFrame, cells: DataFrame, base: int) -> DataFrame:
    """rows (with key and text_sha256) with the entry that the index holds for them."""
    return located(rows, cells, base).join(index, ["bucket", "key", "text_sha256"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                key_bits: int = 64) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256, key, bucket, chain."""
    index, cells, base = build_index(docs, id_col, text_col, capacity, key_bits)
    text = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("t"))
    rows = text.select("id", key_of(F.col("t"), key_bits).alias("key"), F.sha2("t", 256).alias("text_sha256"))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    # Rows that repeat an id with the same text: only one may stay. The group is the repetitions of one row.
    again = rows.groupBy("id", "key", "text_sha256").agg(F.count("*").alias("times"), F.min("row").alias("only")).where("times > 1")
    again = again.select(F.col("id").alias("i"), F.col("key").alias("k"), F.col("text_sha256").alias("s"), "only")
    found = look_up(rows, index, cells, base)
    found = found.join(again, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")) & (F.col("text_sha256") == F.col("s")), "left")
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & F.coalesce(F.col("only") == F.col("row"), F.lit(True))
    return found.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), stays.alias("kept"),
        "text_sha256", "key", "bucket", "chain")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    names, plain = private(docs, "id", "key", "sha"), [quoted(c) for c in docs.columns]
    found = exact_dedup(docs, id_col, text_col, capacity).groupBy(id_col, "key", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    found = staged(found.where("not kept or times > 1").toDF(*names, "kept", "times"), "found")
    own = docs.withColumn(names[2], F.sha2(normalised(text_col), 256)).withColumn(names[1], key_of(normalised(text_col))).withColumn(names[0], F.col(id_col))

    def same(other):
        return own[names[0]].eqNullSafe(other[names[0]]) & (own[names[1]] == other[names[1]]) & (own[names[2]] == other[names[2]])

    odd = few(found)  # rows that go, and rows of which one stays
    rest = own.join(odd, same(odd), "left_anti").select(*plain)
    again = found.where("kept").drop("kept", "times")
    if not again.limit(1).count():
        return rest
    return rest.unionByName(own.join(again, same(again), "left_semi").dropDuplicates(names).select(*plain))
