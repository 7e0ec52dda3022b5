"""SentencePiece encoding and decoding on the tokenizers library, rebuilt from the model's own protobuf.

The file is parsed field by field: pieces with their scores and types, the trainer's model type and byte fallback, the
normaliser's rules. Out of these come a normaliser (the precompiled character map if the model has one, removal of extra
white space, the dummy prefix, spaces to the metaspace marker), a model (Unigram with the scores, or BPE whose merges
are the splits of each piece into two pieces, ordered by score) and a decoder. BPE models are split before each run of
markers, which changes no merge as long as no piece has a marker after another character; otherwise the whole text is
one word. For such models without further rules each different word goes through the library
once in a process, in batches that the library's threads share; other models, and texts with spaces beside others or at
their ends, get whole texts. User-defined pieces cut the
normalised text, longest first, and what lies between them is encoded by itself, as they take no part in merges.

Parity with the sentencepiece library is checked on every whole text, copies in one batch once, and is part of the
result.

Cases: a null text counts as empty and has no ids. Decoding gives back the text as the model's normaliser sees it; for
models without rules that is the text itself, so `round_trip` compares the bytes that the ids stand for with the text's.
Models that mark the ends of words instead of their starts are refused. An empty table gives no rows. Only id and text
are read.
"""

from __future__ import annotations

import importlib
import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_or_empty, trimmed
from .word_ids import WordIds, chunks_of, gathered

MARK = "▁"
#: Bytes of texts that are encoded at once, words that a task keeps at once and words that go to the model in one call.
CHUNK, KEPT, JOINED = 1 << 22, 300_000, 256
#: Ids that are spelled out at once.
IDS = 1 << 18
#: Characters that a tokenizer may take for a word's end.
ODD = re.compile(r"[\s\u2581]")
#: Types of a piece in the protobuf, and types of a model.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class Proto:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def fields(data: bytes):
    """(number, value) of each field of a protobuf message; value: int, 4 or 8 bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 0x7F) << shift
            shift += 7
            if b < 0x80:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind)
        if n is None:
            if kind != 2:
                raise ValueError(f"wire type {kind}")
            n = varint()
        yield tag >> 3, data[at : at + n]
        at += n


def parse(data: bytes) -> Proto:
    out = Proto()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    out.model_type = v
                elif n == 24 and v:
                    raise ValueError("this model marks the ends of words")
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    out.escape_whitespaces = bool(v)
    return out


def merges_of(proto: Proto) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, the piece with the better score first; of one piece's splits the order
    is that of its parts' ids."""
    ids = {p: i for i, (p, _, kind) in enumerate(proto.pieces) if kind in (NORMAL, USER_DEFINED, UNUSED)}
    found = []
    for i, (piece, score, kind) in enumerate(proto.pieces):
        if kind != NORMAL:
            continue
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in ids and b in ids:
                found.append((-score, i, ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build(data: bytes):
    """A tokenizers.Tokenizer with the ids of the model in data."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = parse(data)
    unk = next((i for i, p in enumerate(proto.pieces) if p[2] == UNKNOWN), 0)
    if proto.model_type == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in proto.pieces], unk, proto.byte_fallback)
    elif proto.model_type == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(proto.pieces)}
        model = models.BPE(vocab, merges_of(proto), unk_token=proto.pieces[unk][0], fuse_unk=True, byte_fallback=proto.byte_fallback)
    else:
        raise ValueError(f"model type {proto.model_type}")
    steps = [normalizers.Precompiled(proto.charsmap)] if proto.charsmap else []
    if proto.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if proto.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if proto.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(model)
    out.normalizer = normalizers.Sequence(steps)
    if proto.model_type == BPE and not any(MARK in p.lstrip(MARK) for p, _, kind in proto.pieces if kind == NORMAL):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    tail = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if proto.dummy_prefix:
        tail.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(tail)
    return out




class Pieces:
    """Ids of texts by the model in data."""

    def __init__(self, data: bytes, threads: int):
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        proto = parse(data)
        self.tokenizer, self.theirs = build(data), sentencepiece.SentencePieceProcessor(model_proto=data)
        self.own = sorted((p for p, _, kind in proto.pieces if kind == USER_DEFINED), key=len, reverse=True)
        self.inner = Tokenizer(self.tokenizer.model)
        if self.tokenizer.pre_tokenizer:
            self.inner.pre_tokenizer = self.tokenizer.pre_tokenizer
        plain = proto.dummy_prefix and proto.escape_whitespaces and not (proto.remove_extra_whitespaces or proto.charsmap or self.own)
        self.by_words = plain and self.tokenizer.pre_tokenizer is not None
        self.words = WordIds(self.learn, [], "<i4", KEPT)
        self.joined = Tokenizer(self.tokenizer.model)
        self.joined.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.readable = proto.dummy_prefix and proto.escape_whitespaces and not proto.charsmap
        spelled = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in proto.pieces]
        self.lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.starts, self.spelled = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(spelled), np.uint8)

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words without other white space or markers go to the model many in one call, each with the marker before it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        odd = [i for i, w in enumerate(words) if not w or ODD.search(w)]
        left = sorted(set(range(len(words))).difference(odd)) if odd else range(len(words))
        parts = [left[k : k + JOINED] for k in range(0, len(left), JOINED)]
        pool, sizes = [], []
        for part, e in zip(parts, self.joined.encode_batch([" ".join([MARK + words[i] for i in p]) for p in parts], add_special_tokens=False), strict=True):
            pool.append(np.array(e.ids, np.int32))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        rest = self.whole([words[i] for i in odd])
        sizes.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        pool.append(np.fromiter((i for x in rest for i in x), np.int32))
        size, order = np.concatenate(sizes), np.argsort(np.concatenate([np.asarray(left, np.int64), np.asarray(odd, np.int64)]))
        starts = np.cumsum(size) - size
        return np.concatenate(pool)[gathered(starts[order], size[order])], size[order]

    def whole(self, texts: list[str]) -> list[list[int]]:
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        if not self.own:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = re.compile("(" + "|".join(map(re.escape, self.own)) + ")")
        normal = self.tokenizer.normalizer.normalize_str
        parts = [cut.split(normal(t)) for t in texts]
        inner = iter(self.inner.encode_batch_fast([x for p in parts for x in p[::2]], add_special_tokens=False))
        return [[i for k, x in enumerate(p) for i in ([self.tokenizer.token_to_id(x)] if k % 2 else next(inner).ids)] for p in parts]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of texts in them."""
        if not self.by_words:
            found = self.whole(texts.to_pylist())
            return np.fromiter((i for x in found for i in x), np.int32), np.cumsum([0, *map(len, found)])
        split = pc.split_pattern(texts, " ")
        offsets, words = split.offsets.to_numpy().astype(np.int64), split.flatten()
        offsets -= offsets[0]
        flat, ends = self.words.texts(words, offsets)
        # Spaces beside others, or at a text's ends, belong to longer runs of markers: such texts go whole.
        empty = np.flatnonzero(pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False))
        odd = np.unique(np.searchsorted(offsets, empty, side="right") - 1)
        if not len(odd):
            return flat, ends
        rows = [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
        for i, ids in zip(odd.tolist(), self.whole(texts.take(pa.array(odd)).to_pylist()), strict=True):
            rows[i] = np.array(ids, np.int32)
        return np.concatenate(rows), np.cumsum([0, *map(len, rows)])

    def round_trips(self, texts: pa.Array, flat: np.ndarray, offsets: np.ndarray) -> list[bool]:
        if not self.readable:
            back = self.tokenizer.decode_batch([flat[x:y].tolist() for x, y in zip(offsets[:-1], offsets[1:], strict=True)], skip_special_tokens=False)
            return [x == y for x, y in zip(texts.to_pylist(), back, strict=True)]
        read = b"".join(self.spelled[gathered(self.starts[some], self.lengths[some])].tobytes() for some in np.array_split(flat, 1 + len(flat) // IDS))
        ends = np.concatenate([[0], np.cumsum(self.lengths[flat])])[offsets]
        return [t.encode() == read[x + 1 : y] if y > x else not t for t, x, y in zip(texts.to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


#: Models of this process, by their files.
_loaded: dict = {}


def loaded(data: bytes, threads: int) -> Pieces:
    if data not in _loaded:
        _loaded[data] = Pieces(data, threads)
    return _loaded[data]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2) -> DataFrame:
    """id_col, ids (array), round_trip (the ids decode to the text) and parity (the sentencepiece library's ids are the
    same)."""
    with open(model_path, "rb") as f:
        data = f.read()
    sent, here = docs.sparkSession.sparkContext.broadcast(data), __name__  # the model's file

    def run(batches):
        own = importlib.import_module(here).loaded(sent.value, threads)  # the module of this process, which outlives the task
        for b in batches:
            same: dict[str, bool] = {}
            for lo, hi in chunks_of(b.column(1), CHUNK):
                column = b.column(1).slice(lo, hi - lo)
                flat, offsets = own.ids(column)
                part = column.to_pylist()
                new = {t: i for i, t in enumerate(part) if t not in same}
                for (t, i), want in zip(new.items(), own.theirs.encode(list(new), num_threads=1), strict=True):
                    same[t] = want == flat[offsets[i] : offsets[i + 1]].tolist()
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), ids, pa.array(own.round_trips(column, flat, offsets)), pa.array([same[t] for t in part], pa.bool_())], names=["id", "ids", "round_trip", "parity"])
        own.words.clear()
        trimmed()

    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = read.dtypes[0][1]
    return read.mapInArrow(run, f"id {kind}, ids array<int>, round_trip boolean, parity boolean").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids", threads: int = 2) -> DataFrame:
    """id_col and text."""
    with open(model_path, "rb") as f:
        sent, here = encoded.sparkSession.sparkContext.broadcast(f.read()), __name__

    def run(batches):
        own = importlib.import_module(here).loaded(sent.value, threads).tokenizer
        for b in batches:
            ids = [x or [] for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.decode_batch(ids, skip_special_tokens=False), pa.string())], names=["id", "text"])

    read = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return read.mapInArrow(run, f"id {read.dtypes[0][1]}, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """id_col, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip, parity."""
    def run(batches):
        for b in batches:
            ids = b.column(1)
            offsets = ids.offsets.to_numpy().astype(np.int64)
            raw = memoryview(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes())
            offsets -= offsets[0]
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(crc, pa.int64()), b.column(2), b.column(3)], names=["id", "n_ids", "ids_crc32", "round_trip", "parity"])

    found = encode(docs, model_path, id_col, text_col, **how)
    return found.mapInArrow(run, f"id {found.dtypes[0][1]}, n_ids long, ids_crc32 long, round_trip boolean, parity boolean").withColumnRenamed("id", id_col)
