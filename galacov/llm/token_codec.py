"""Token ids as binary blocks under one canonical, length-limited Huffman code.

Texts are encoded once. Ids are counted over the whole corpus; the package-merge algorithm gives the optimal code lengths
of at most MAX_BITS bits, and the canonical code follows from the lengths alone. Ids are then written in ascending order
of the document id as a Parquet table of blocks, each decodable by itself: `payload` (the bit string), `lengths` (ids of
each document), `ids` (the documents) and `checkpoints` (the bit offset of every STRIDE-th id). Decoding walks all
checkpoints of many blocks side by side: one look into a table of 2^max_bits entries gives each lane its next id.

Encoding goes by words between ASCII white space, which the tokenizer's own rules drop and never join over: each
distinct word is encoded by the library once and kept, up to a bound of words in a process. This holds for tokenizers of that
kind (NFC, lower case, pieces at white space, byte letters); `by_words=False` hands whole texts to the library, for any
other. A test compares both.

A document's `start` is the number of ids before it: ranges of ids are shards, shards' totals give their offsets, and a
block's offset follows inside its shard, so no task sees more than one shard.

Ids are whole numbers. More than 2^MAX_BITS different tokens have no code of that length, which raises.

Cases: a null text counts as empty and has the end id only. Null ids come first; rows that repeat an id are ordered by
their first bytes, then by a hash of all. An empty table gives no rows (and no code). Only id and text are read.
"""

from __future__ import annotations

import importlib
import os
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_dir, staged, text_or_empty, trimmed
from .word_ids import WordIds, chunks_of, gathered

MAX_BITS, STRIDE = 18, 128
#: Ids of a block, about.
BLOCK = 1 << 18
END_ID = 2


# ---- code ------------------------------------------------------------------------------------------------------------
def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most max_bits bits for the symbols with counts over 0 (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols need more than {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)  # which of the level's sorted items are single symbols
        merged = merged[rank]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    need = 2 * n - 2
    depth = np.zeros(n, np.int64)
    for single in reversed(levels):
        taken = single[:need]
        k = int(taken.sum())
        depth[:k] += 1  # the k lightest symbols
        need = 2 * (need - k)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    code, last = 0, 0
    by = np.lexsort((np.arange(len(lengths)), lengths))
    by = by[lengths[by] > 0]
    own = lengths[by].astype(int)
    for length in np.unique(own):
        group = by[own == length]
        code <<= int(length) - last
        codes[group] = code + np.arange(len(group))
        code, last = code + len(group), int(length)
    return codes


def decode_table(lengths: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and length for each value of the next max_bits bits."""
    symbols, sizes = np.zeros(1 << max_bits, np.uint32), np.zeros(1 << max_bits, np.uint8)
    by = np.lexsort((np.arange(len(lengths)), lengths))
    by = by[lengths[by] > 0]
    spans = (1 << (max_bits - lengths[by].astype(np.int64)))
    filled = int(spans.sum())
    symbols[:filled] = np.repeat(by, spans)
    sizes[:filled] = np.repeat(lengths[by], spans)
    return symbols, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """The bit string of ids, most significant bit first, and the bit offsets of every stride-th id."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(end) else 0
    words = np.zeros(total // 32 + 2, np.float64)
    ids = ids.astype(np.int64)
    wide = codes[ids].astype(np.uint64) << (np.uint64(64) - size.astype(np.uint64) - (start % 32).astype(np.uint64))
    # Bits of different ids never overlap, so sums of 32-bit halves are exact.
    words += np.bincount(start // 32, (wide >> np.uint64(32)).astype(np.float64), len(words))
    words += np.bincount(start // 32 + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), len(words))
    return words.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], start[::stride]


def unpack(payloads: list[bytes], checkpoints: list[np.ndarray], totals: list[int], table, max_bits: int, stride: int = STRIDE) -> list[np.ndarray]:
    """The ids of each block, all blocks' checkpoints side by side."""
    symbols, sizes = table
    bases = np.concatenate([[0], np.cumsum([len(p) + 8 for p in payloads])])[:-1].astype(np.int64)
    data = np.frombuffer(b"".join(p + bytes(8) for p in payloads) + bytes(8), np.uint8).astype(np.uint32)
    view = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    position = np.concatenate([c + 8 * b for c, b in zip(checkpoints, bases, strict=True)]) if payloads else np.zeros(0, np.int64)
    left = np.concatenate([np.minimum(stride, t - stride * np.arange(len(c))) for c, t in zip(checkpoints, totals, strict=True)]) if payloads else position
    out = np.zeros((len(position), stride), np.uint32)
    lanes = np.arange(len(position))
    for step in range(stride):
        if len(lanes) and left[lanes].min() <= step:
            lanes = lanes[left[lanes] > step]
        if not len(lanes):
            break
        p = position[lanes]
        look = (view[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - max_bits)
        out[lanes, step] = symbols[look]
        position[lanes] = p + sizes[look]
    found, at = [], 0
    for c, t in zip(checkpoints, totals, strict=True):
        found.append(out[at : at + len(c)].ravel()[:t])
        at += len(c)
    return found


# ---- texts to ids ----------------------------------------------------------------------------------------------------
#: ASCII signs that stand apart from the letters before them. The apostrophe does not: it may begin a contraction.
SIGNS = '.,;:!?*&%$#@-_()[]{}"/\\|+=~^<>`'
#: Words that go to the model in one call.
JOINED = 256


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible in Latin-1, else
    the next of those from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTES = byte_letters()


class Words:
    """Ids of words by a tokenizer's file. A run of letters is one piece to the tokenizer's rules, and so is a run of
    other visible ASCII signs after it. Words of that form go to the model as lower-case byte letters, many in one call,
    with their tails by a table; any other goes through the whole tokenizer."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(data.decode())
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.tails: dict[str, list[int]] = {"": []}

    def core(self, word: str) -> str | None:
        """Lower-case byte letters of a word that is letters only, else None."""
        if word.isascii():
            return word.lower() if word.isalpha() else None
        if "\u03a3" in word or not unicodedata.is_normalized("NFC", word):  # capital sigma's small form depends on its place
            return None
        low = word.lower()
        return low.encode().decode("latin-1").translate(_BYTES) if low.isalpha() and word.isalpha() else None

    def learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and batches of words are small
        cores, plain, tails, others = [], [], [], []
        for i, w in enumerate(new):
            head = w.rstrip(SIGNS)
            c = self.core(head)
            if c is None:
                others.append(i)
                continue
            cores.append(c)
            plain.append(i)
            tails.append(w[len(head):])
        for t in set(tails).difference(self.tails):
            self.tails[t] = self.whole.encode(t, add_special_tokens=False).ids
        pool, starts, lengths = [], np.zeros((len(new), 2), np.int64), np.zeros((len(new), 2), np.int64)
        parts = [cores[k : k + JOINED] for k in range(0, len(cores), JOINED)]
        sizes = []
        for part, e in zip(parts, self.model.encode_batch([" ".join(p) for p in parts], add_special_tokens=False), strict=True):
            pool.append(np.array(e.ids, np.int64))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        runs = [self.tails[t] for t in tails] + [e.ids for e in self.whole.encode_batch_fast([new[i] for i in others], add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, runs), np.int64, len(runs)))
        pool.append(np.fromiter((i for r in runs for i in r), np.int64))
        size = np.concatenate(sizes)
        start, n = np.cumsum(size) - size, len(plain)
        for rows, side, k in ((plain, 0, 0), (plain, 1, n), (others, 0, 2 * n)):
            starts[rows, side], lengths[rows, side] = start[k : k + len(rows)], size[k : k + len(rows)]
        return np.concatenate(pool)[gathered(starts.ravel(), lengths.ravel())], lengths.sum(axis=1)


def binary_of(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """flat[offsets[i]:offsets[i+1]] as bytes, each a row."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])


def encode_texts(table: WordIds, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, with the table's end after each, and the offsets of texts in them."""
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy().astype(np.int64)
    return table.texts(split.flatten(), offsets - offsets[0])


#: Tables of this process, by the tokenizer's file, end and type.
_loaded: dict = {}


def loaded(data: bytes, end_id: int, kind: str) -> WordIds:
    key = (data, end_id, kind)
    if key not in _loaded:
        _loaded[key] = WordIds(Words(data).learn, [end_id], kind)
    return _loaded[key]


def id_type(tokenizer_path: str, end_id: int = END_ID) -> str:
    """Two bytes hold the ids of all but the largest vocabularies."""
    from tokenizers import Tokenizer

    return "<u2" if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, by_words: bool = True) -> DataFrame:
    """id, raw (ids with the end id, of id_type)."""
    kind = id_type(tokenizer_path, end_id)
    here = __name__
    with open(tokenizer_path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file

    def run(batches):
        table = importlib.import_module(here).loaded(sent.value, end_id, kind)  # the module of this process, which outlives the task
        whole = table.learn.__self__.whole
        for b in batches:
            for lo, hi in chunks_of(b.column(1)):
                texts = b.column(1).slice(lo, hi - lo)
                if by_words:
                    flat, offsets = encode_texts(table, texts)
                else:
                    ids = [np.array([*e.ids, end_id], kind) for e in whole.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
                    flat, offsets = np.concatenate(ids), np.cumsum([0, *map(len, ids)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), binary_of(flat, offsets)], names=["id", "raw"])
        trimmed()

    read = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return read.mapInArrow(run, "id long, raw binary")


def count_ids(encoded: DataFrame, kind: str) -> np.ndarray:
    """Occurrences of each id; one entry for each id of the vocabulary."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for b in batches:
            raw, ends = b.column(0), np.frombuffer(b.column(0).buffers()[1], np.int32)
            if not len(raw):
                continue
            got = np.bincount(np.frombuffer(raw.buffers()[2], np.uint8)[ends[raw.offset] : ends[raw.offset + len(raw)]].view(kind))
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["token", "n"])

    got = encoded.select("raw").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    tokens, n = got.column("token").to_numpy(), got.column("n").to_numpy()
    counts = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, np.int64)
    counts[tokens] = n
    return counts


# ---- blocks ----------------------------------------------------------------------------------------------------------
BLOCK_SCHEMA = "shard int, block int, ids array<long>, lengths array<int>, checkpoints array<long>, payload binary"


def write_blocks(encoded: DataFrame, path: str, lengths: np.ndarray, shards: int, kind: str) -> None:
    """Blocks in ascending id order: shard by shard, block by block."""
    sent = encoded.sparkSession.sparkContext.broadcast((lengths, canonical_codes(lengths)))

    def run(batches):
        from pyspark import TaskContext

        lengths, codes = sent.value
        shard, block = TaskContext.get().partitionId(), 0
        ids: list = []
        raws: list[bytes] = []
        held = 0

        def made():
            own = [np.frombuffer(r, kind) for r in raws]
            payload, marks = pack(np.concatenate(own), codes, lengths)
            return pa.RecordBatch.from_arrays([
                pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(x) for x in own]], pa.list_(pa.int32())), pa.array([marks], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["shard", "block", "ids", "lengths", "checkpoints", "payload"])

        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                raws.append(raw)
                held += len(raw) // np.dtype(kind).itemsize
                if held >= BLOCK:
                    yield made()
                    block, ids, raws, held = block + 1, [], [], 0
        if ids:
            yield made()

    # Rows of one id, or of none, are dealt by their bytes, and equal ones by where they were read: no key is too large a shard.
    order = [F.col("id").asc_nulls_first(), F.substring("raw", 1, 32), F.xxhash64("raw"), F.col("m")]
    ordered = encoded.withColumn("m", F.monotonically_increasing_id()).repartitionByRange(shards, *order)
    ordered.sortWithinPartitions(*order).select("id", "raw").mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "none").parquet(path)


def write_code(spark, path: str, lengths: np.ndarray) -> None:
    """The code is its lengths: one row for each id that occurs."""
    some = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"token": pa.array(some, pa.int64()), "bits": pa.array(lengths[some].astype(np.int32))})).coalesce(1).write.parquet(path)


def read_code(spark, path: str) -> np.ndarray:
    got = spark.read.parquet(path).toArrow()
    tokens = got.column("token").to_numpy()
    lengths = np.zeros(int(tokens.max()) + 1 if len(tokens) else 1, np.uint8)
    lengths[tokens] = got.column("bits").to_numpy()
    return lengths


def write(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
          by_words: bool = True, shards: int | None = None) -> None:
    """Writes path/code and path/blocks."""
    spark = docs.sparkSession
    encoded = staged(encode(docs, tokenizer_path, id_col, text_col, end_id, by_words), "encoded")
    kind = id_type(tokenizer_path, end_id)
    lengths = code_lengths(count_ids(encoded, kind))
    write_code(spark, f"{path}/code", lengths)
    write_blocks(encoded, f"{path}/blocks", lengths, shards or int(spark.conf.get("spark.sql.shuffle.partitions")), kind)


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Per document: id, shard, block, place, n_tokens, ids_crc32, and tokens with with_ids."""
    lengths = read_code(spark, f"{path}/code")
    bits = max(1, int(lengths.max()))
    sent = spark.sparkContext.broadcast(lengths)

    def run(batches):
        table = decode_table(sent.value, bits)
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                ids, sizes = row.column(2)[0].values, row.column(3)[0].values.to_numpy()
                marks = row.column(4)[0].values.to_numpy()
                tokens = unpack([row.column(5)[0].as_py()], [marks], [int(sizes.sum())], table, bits)[0].astype("<u4")
                ends = np.cumsum(sizes)
                raw = memoryview(tokens.tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends, sizes, strict=True)]
                n = len(sizes)
                cols = [ids, pa.array(np.full(n, row.column(0)[0].as_py()), pa.int32()), pa.array(np.full(n, row.column(1)[0].as_py()), pa.int32()),
                        pa.array(ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "shard", "block", "place", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(tokens.astype(np.int32))))
                    names.append("tokens")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "id long, shard int, block int, place long, n_tokens long, ids_crc32 long" + (", tokens array<int>" if with_ids else "")
    return spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").mapInArrow(run, schema)


def starts(spark, path: str) -> DataFrame:
    """shard, block, block_from: ids before each block."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").select("shard", "block", F.expr("aggregate(lengths, 0L, (a, x) -> a + x)").alias("n"))
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before("shard")), F.lit(0)).alias("shard_from"))
    inside = blocks.select("shard", "block", F.coalesce(F.sum("n").over(before("shard", "block")), F.lit(0)).alias("in_shard"))
    return inside.join(shards, "shard").select("shard", "block", (F.col("shard_from") + F.col("in_shard")).alias("block_from"))


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, **how) -> DataFrame:
    """Writes the corpus and reads it back: id_col, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "tokens")
    write(docs, path, tokenizer_path, id_col, text_col, **how)
    found = read(spark, path).join(starts(spark, path), ["shard", "block"])
    return found.select(F.col("id").alias(id_col), (F.col("block_from") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")
