"""Each operator on small cases against brute force, with nulls, empties, repeats and clashing columns."""

import base64
import collections
import gzip
import glob
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from galacov.llm import common, exact_dedup, jpeg, licenses, line_dedup, mixing, near_dedup, queries, sentencepiece_codec, token_codec, toxicity, warc
from tests.conftest import same_rows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "a", "word " * 3000, "The MIT License. the mit license", "É é \x85 日本語。テスト, x", "don't 12.5 C., a.b", "​﻿ nbsp\xa0x", "😀👩‍👩‍👧 flags"]


def docs(spark, texts, sources=None, ids=None, **extra):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, "en", (sources or ["s"] * len(texts))[k], len(t or "")) for k, (i, t) in enumerate(zip(ids, texts))]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("kept", "score", "key", "bucket", "node", "words", "id", "t"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return docs(spark, ["x"]).where("doc_id < 0")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, duck, name):
    same_rows(queries.QUERIES[name](spark, sf), duck.execute(queries.SQL[name]).df())


@pytest.mark.parametrize("f", [
    exact_dedup.exact_dedup, near_dedup.near_dedup, line_dedup.line_dedup, mixing.mix, mixing.mixed, licenses.scan, jpeg.media_columns, line_dedup.without_repeats, exact_dedup.keep_first,
    near_dedup.keep_one, lambda d: token_codec.round_trip(d, public_tokenizers.path("word_bpe_49k.json")), lambda d: sentencepiece_codec.digests(d, public_tokenizers.path("piece_bpe_32k.model"))])
def test_empty_tables_give_no_rows(spark, f):
    assert f(empty(spark)).count() == 0


# ---- 1 -----------------------------------------------------------------------------------------------------------------
def test_code_is_optimal_and_limited():
    rng = np.random.default_rng(0)
    counts = rng.zipf(1.4, 300).clip(1, 10**6)
    counts[::7] = 0
    lengths = token_codec.code_lengths(counts, 10)
    used = counts > 0
    assert lengths.max() <= 10 and (lengths[~used] == 0).all() and np.isclose((2.0 ** -lengths[used].astype(float)).sum(), 1)
    free = token_codec.code_lengths(counts, 30)
    import heapq

    heap = [(int(c), i) for i, c in enumerate(counts[used])]
    heapq.heapify(heap)
    total, n = 0, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        n += 1
        heapq.heappush(heap, (a[0] + b[0], n))
    assert (counts * free).sum() == total
    codes = token_codec.canonical_codes(lengths)
    words = sorted(format(codes[i], f"0{lengths[i]}b") for i in np.flatnonzero(used))
    assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
    ids = rng.choice(np.flatnonzero(used), 1000)
    payload, marks = token_codec.pack(ids, codes, lengths, 64)
    assert payload == int("".join(format(codes[i], f"0{lengths[i]}b") for i in ids).ljust(len(payload) * 8, "0"), 2).to_bytes(len(payload), "big")
    assert np.array_equal(token_codec.unpack([payload], [marks], [1000], token_codec.decode_table(lengths, 10), 10, 64)[0], ids)


def test_words_are_encoded_as_whole_texts_are(sf):
    """Odd texts, every code point inside and at the ends of words, and all documents; with a table that starts anew often."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    data = open(public_tokenizers.path("word_bpe_49k.json"), "rb").read()
    words = token_codec.Words(data)
    texts = [t or "" for t in ODD] + ["H̱ İstanbul ΣΑΣ ß K Å ﬁ Ǆ ŉ", "a\x85b\x1cc\x0bd", "...,,, ., a.. b,. .c", "<|endoftext|> a<|startoftext|>b", " \t\n", " a ", "x"]
    points = [chr(c) for c in range(1, 0x2FFFF) if not 0xD800 <= c < 0xE000]
    texts += [" ".join(f"a{c}b {c} {c}. B{c}" for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    texts += [t or "" for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()]
    want = [[*e.ids, 2] for e in words.whole.encode_batch_fast(texts, add_special_tokens=False)]
    for most in (1_000_000, 5_000):
        table = token_codec.WordIds(words.learn, [2], "<u2", most)
        for lo in range(0, len(texts), 64):
            flat, offsets = token_codec.encode_texts(table, pa.array(texts[lo : lo + 64]))
            assert [flat[x:y].tolist() for x, y in zip(offsets, offsets[1:])] == want[lo : lo + 64]


def test_token_round_trip(spark):
    from tokenizers import Tokenizer

    ids = [5, 3, 9, 1, 0, 7, 2, 8, 11, 10, 6]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_codec.round_trip(docs(spark, ODD, ids=ids), public_tokenizers.path("word_bpe_49k.json"), shards=3).collect()}
    start = 0
    for i, text in sorted(zip(ids, ODD)):
        own = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert got[i] == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)


# ---- 2 -----------------------------------------------------------------------------------------------------------------
def test_sentencepiece_parity_and_round_trip(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ODD + ["two  spaces", " first", "last ", "   ", "a b", "\u2581x \u2581", "tab\tnew\nline \n x"]
    got = sentencepiece_codec.encode(docs(spark, texts), path).collect()
    assert len(got) == len(texts) and all(r["parity"] for r in got)
    assert [texts[r["doc_id"]] for r in got if not r["round_trip"]] == ["\u2581x \u2581"]  # the marker itself reads as a space
    back = sentencepiece_codec.decode(spark.createDataFrame([(r["doc_id"], r["ids"]) for r in got], "doc_id long, ids array<int>"), path)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: (t or "").replace("\u2581", " ") for i, t in enumerate(texts)}


def test_sentencepiece_digests(spark, sf):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    theirs = sentencepiece.SentencePieceProcessor(model_file=path)
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(docs(spark, ODD, ids=[-1 - i for i in range(len(ODD))]).select("doc_id", "text"))
    want = {}
    for r in d.collect():
        ids = np.array(theirs.encode(r["text"] or ""), "<u4")
        want[r["doc_id"]] = (len(ids), zlib.crc32(ids.tobytes()), True, True)
    assert {r["doc_id"]: tuple(r)[1:] for r in sentencepiece_codec.digests(d, path).collect()} == want


def message_of(pieces, model_type, trainer=b"", normaliser=b"\x18\x01\x20\x00\x28\x01"):
    """A model's protobuf from its pieces (text, score, type)."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def field(n, b):
        return bytes([n << 3 | 2]) + varint(len(b)) + b

    rows = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", x) + b"\x18" + bytes([kind])) for p, x, kind in pieces)
    return rows + field(2, b"\x18" + bytes([model_type]) + trainer) + field(3, normaliser)


def test_large_unigram_model_with_bytes(sf):
    """The pieces of the given file as a unigram model, rare pieces less likely, with byte fallback."""
    import sentencepiece
    import pyarrow as pa
    import pyarrow.parquet as pq

    proto = sentencepiece_codec.parse(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    rng = random.Random(1)
    pieces = [(p, -5 - i / 4096 - rng.random() if kind == sentencepiece_codec.NORMAL else 0.0, kind) for i, (p, _, kind) in enumerate(proto.pieces)]
    data = message_of(pieces, sentencepiece_codec.UNIGRAM, b"\x98\x02\x01")
    own, theirs = sentencepiece_codec.Pieces(data, 1), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [t or "" for t in ODD[:5] + ODD[6:]] + [(t or "")[:4000] for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"]).column("text").to_pylist()[:150]]
    flat, ends = own.ids(pa.array(texts))
    differ = 0
    for t, x, y in zip(texts, ends, ends[1:]):
        a, b = flat[x:y].tolist(), theirs.encode(t)
        if a != b:  # the libraries add in different precision, so ways of the same score may differ
            differ += 1
            assert abs(sum(pieces[i][1] for i in a) - sum(pieces[i][1] for i in b)) < 1e-4 * len(a), t
    assert differ <= len(texts) // 10
    assert all(own.round_trips(pa.array(texts), flat, ends))


def test_user_defined_pieces_and_refused_models():
    import sentencepiece
    import pyarrow as pa

    letters = [(c, -10.0 - i, 1) for i, c in enumerate("\u2581abcd")]
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("ab", -1.0, 1), ("cd", -2.0, 1), ("\u2581a", -3.0, 1), ("bc", 0.0, 4), ("abcda", 0.0, 4), *letters]
    data = message_of(pieces, sentencepiece_codec.BPE)
    own, theirs = sentencepiece_codec.Pieces(data, 1), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["abcd abc", "abcda ab", "abcdabc cd", "dcba", "", "abx"]
    flat, ends = own.ids(pa.array(texts))
    assert [flat[x:y].tolist() for x, y in zip(ends, ends[1:])] == [theirs.encode(t) for t in texts]
    with pytest.raises(ValueError):
        sentencepiece_codec.parse(message_of(pieces, 2, b"\xc0\x01\x01"))


def test_unigram_models_are_rebuilt():
    def message(*parts):
        return b"".join(parts)

    def bytes_field(n, b):
        return bytes([n << 3 | 2, len(b)]) + b

    import struct

    pieces = [("<unk>", 0.0, 2), ("▁ab", -1.0, 1), ("▁a", -2.0, 1), ("b", -2.5, 1), ("c", -3.0, 1), ("▁", -4.0, 1)]
    model = b"".join(bytes_field(1, message(bytes_field(1, p.encode()), b"\x15" + struct.pack("<f", s), b"\x18" + bytes([k]))) for p, s, k in pieces)
    model += bytes_field(2, b"\x18\x01") + bytes_field(3, b"\x18\x01\x20\x01\x28\x01")
    t = sentencepiece_codec.build(model)
    assert [t.id_to_token(i) for i in t.encode("ab  abc").ids] == ["▁ab", "▁ab", "c"]


# ---- 3 -----------------------------------------------------------------------------------------------------------------
def test_line_dedup_by_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 14))] for _ in range(30)]
    texts = [None, "", "a b c d\n\nA  b\tc d", "a b c d e", "a b c d e"]
    for _ in range(40):
        lines = []
        for _ in range(3):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(vocabulary)
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    rows = [(i, n, frozenset(x.lower().split())) for i, t in enumerate(texts) for n, x in enumerate((t or "").split("\n"))]
    first, size = {}, collections.Counter()
    for i, n, s in rows:
        first.setdefault(s, (i, n))
        size[s] += 1
    sets = list(first)
    match = {s: [o for o in sets if o != s and 9 * len(s & o) >= 4 * (len(s) + len(o))] for s in sets}
    want = {(i, n): (len(s), *first[s], size[s], len(match[s]), not s or (first[s] == (i, n) and not any(first[o] < first[s] for o in match[s]))) for i, n, s in rows}
    got = {(r["doc_id"], r["line"]): tuple(r)[2:] for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert got == want
    kept = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs(spark, texts)).collect()}
    assert kept[4] == "" and kept[0] is None and kept[2].split("\n")[0] == "a b c d"


@pytest.mark.parametrize("pivots", [True, False])
def test_lines_of_large_groups_are_linked_without_a_row_for_each_pair(spark, monkeypatch, pivots):
    """Variants of two long lines, which differ in few words or in too many, and of one line of 9 words: the links that are
    counted are brute force's, with pivots and without any; with them the join gets a small part of the pairs."""
    rng, seen = random.Random(7), {}
    lines = []
    for at in range(2):
        base = [f"b{at}x{i}" for i in range(60)]
        for k in range(160):
            line = list(base)
            for i in rng.sample(range(60), rng.choice([0, 1, 1, 2, 2, 3, 4, 5])):
                line[i] = f"c{rng.randrange(400)}"
            lines.append(" ".join(line + [f"tail{k}"] * (k % 3 == 0)))
    lines += ["d1 d2 d3 d4 d5 d6 d7 d8 e" + str(k) for k in range(40)] + ["d1 d2 d3 d4 d5 d6 d7 d8"] + [f"f{k} g h i" for k in range(5)]
    rng.shuffle(lines)
    texts = ["\n".join(lines[k : k + 9]) for k in range(0, len(lines), 9)] + [lines[0]]
    rows = [(i, n, frozenset(x.split())) for i, t in enumerate(texts) for n, x in enumerate(t.split("\n"))]
    first, size = {}, collections.Counter()
    for i, n, s in rows:
        first.setdefault(s, (i, n))
        size[s] += 1
    match = {s: [o for o in first if o != s and 9 * len(s & o) >= 4 * (len(s) + len(o))] for s in first}
    want = {(i, n): (len(s), *first[s], size[s], len(match[s]), first[s] == (i, n) and not any(first[o] < first[s] for o in match[s])) for i, n, s in rows}
    old = line_dedup.candidates
    monkeypatch.setattr(line_dedup, "candidates", lambda sets: seen.setdefault("pairs", old(sets)))
    monkeypatch.setattr(line_dedup, "SAMPLE", 1 if pivots else 1 << 60, raising=False)
    got = {(r["doc_id"], r["line"]): tuple(r)[2:] for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert got == want
    links = sum(map(len, match.values())) // 2
    assert links > 10_000 and (not pivots or seen["pairs"].count() < links / 3)


def test_long_lines_that_share_much_are_seldom_candidates(spark, monkeypatch):
    """160 words, of which any two lines share 124: no links, and the parity bits tell so."""
    texts, seen = [" ".join([f"s{i}" for i in range(124)] + [f"o{k}x{i}" for i in range(36)]) for k in range(30)], {}
    texts.append(texts[0] + " more words")
    old = line_dedup.candidates
    monkeypatch.setattr(line_dedup, "candidates", lambda sets: seen.setdefault("pairs", old(sets)))
    monkeypatch.setattr(line_dedup, "SAMPLE", 1 << 60)
    got = {r["doc_id"]: (r["n_links"], r["kept"]) for r in line_dedup.line_dedup(docs(spark, texts)).collect()}
    assert got == {k: (int(k in (0, 30)), k != 30) for k in range(31)}
    assert 1 <= seen["pairs"].count() < 110


# ---- 4 -----------------------------------------------------------------------------------------------------------------
def brute_classes(texts, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = collections.Counter(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))) if w else collections.Counter()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b:
                u, v = sets[a], sets[b]
                common = set(u) & set(v)
                j = sum(1 / sum(max(u[q] / u[d], v[q] / v[d]) for q in set(u) | set(v)) for d in common) if common else float(not u and not v)
                if j >= threshold - 1e-12:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


@pytest.mark.parametrize("how", [{}, {"band_open": 0}, {"band_open": 0, "block": 4}, {"band_open": 0, "block_words": 300}])
def test_near_dedup_by_brute_force(spark, how):
    rng = random.Random(5)
    common = [f"c{i}" for i in range(40)]
    texts = [None, "", "one two", "One  two", "three"]
    base = [[f"b{k}_{i}" for i in range(60)] for k in range(4)]
    for _ in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join(common + [f"y{k}_{i}" for i in range(12)]) for k in range(25)]  # one passage, different texts
    texts += [" ".join(common[: 20 + k]) for k in range(20)]  # a chain of links
    texts += ["rep eat ed li ne " * 30 + f"z{k}" for k in range(3)]
    want = brute_classes(dict(enumerate(texts)))
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(docs(spark, texts), **how).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == want
    size = collections.Counter(want.values())
    assert all(r["class_size"] == size[r["class_id"]] and r["kept"] == (i == r["class_id"]) for i, r in got.items())


def test_signature_parts_estimate_the_similarity():
    rng = np.random.default_rng(3)
    one, two = rng.integers(0, 2**62, 300), None
    two = np.concatenate([one[:260], rng.integers(0, 2**62, 40)])
    words = np.concatenate([one, two])
    h, t = near_dedup.shingles(words, np.array([0, 300, 600]), 1)
    h, t, w = near_dedup.weighted(h, t)
    sig = near_dedup.signatures(h, t, w, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - near_dedup.similarity(one, two, 1)) < 0.03


def test_null_and_repeated_ids(spark):
    got = near_dedup.near_dedup(docs(spark, ["a b", "a b", "c", "c"], ids=[None, 1, 2, 2])).collect()
    assert sorted((r["doc_id"] or -1, r["kept"]) for r in got) == [(-1, True), (1, True), (2, True)]


def test_ids_with_several_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    d = docs(spark, [one, two, two, one + " z", one], ids=[5, 5, 3, 9, 5])
    got = sorted((r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in near_dedup.near_dedup(d).collect())
    assert got == [(3, 3, 2, True), (5, 3, 2, False), (5, 5, 2, True), (9, 5, 2, False)]
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.keep_one(d).collect()) == [(3, two), (5, one)]
    named = d.withColumn("doc_id", F.concat(F.lit("n"), "doc_id"))
    assert sorted(r["doc_id"] for r in near_dedup.keep_one(named).collect()) == ["n3", "n5"]


def test_texts_around_the_threshold(spark):
    """A group whose outliers lie just below the threshold from its centre; some link to members, most to nothing."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]

    def edited(w, n):
        w = list(w)
        for at in rng.sample(range(5, len(w) - 5), n):
            w[at] = f"x{rng.randrange(10**9)}"
        return w

    far = [edited(base, 5) for _ in range(40)]
    texts = [" ".join(w) for w in [base, *(edited(base, rng.randint(1, 3)) for _ in range(60)), *far, *(edited(w, 1) for w in far[:10])]]
    want = brute_classes(dict(enumerate(texts)))
    assert 1 < len(set(want.values())) < 60
    for how in ({}, {"block": 16, "band_open": 1}):
        assert {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(docs(spark, texts), **how).collect()} == want


# ---- 5 -----------------------------------------------------------------------------------------------------------------
def test_mixing_rows_that_repeat_an_id(spark):
    """Each row is taken as itself: words of each source meet its budget, whatever ids its rows have."""
    texts = [" ".join(f"w{k}_{i}" for i in range(5 + k % 7)) for k in range(40)]
    d = docs(spark, texts, sources=["a", "b"] * 20, ids=[1, 1, None, None] * 10)
    rows = mixing.mixed(d).collect()
    size = {s: sum(len(t.split()) for t, x in zip(texts, ["a", "b"] * 20) if x == s) for s in "ab"}
    words = collections.Counter()
    for r in rows:
        words[r["source"]] += len(r["text"].split())
    total = 1.5 * (size["a"] + size["b"])
    target = {"a": min(2 * size["a"], total * 5 / 7)}
    target["b"] = min(2 * size["b"], total - target["a"])
    assert all(abs(words[s] - target[s]) <= 1 for s in "ab"), (words, target)


def test_mixing_meets_budgets(spark):
    rng = random.Random(1)
    texts = [None, "", "  "] + [" ".join("w" for _ in range(rng.randint(1, 40))) for _ in range(197)]
    sources = [rng.choice(["a", "a", "a", "b", "c", "d", None]) for _ in texts]
    d = docs(spark, texts, sources)
    got = mixing.mix(d, piece=8).collect()
    again = mixing.mix(d.repartition(7), piece=8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) == len(texts)
    size = collections.Counter()
    for t, s in zip(texts, sources):
        size[s] += len((t or "").split())
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # share again until none is above its stop
        left = 1.5 * sum(size.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > 2 * size[s]]
        if not above:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            target[s] = 2.0 * size[s]
            open_.discard(s)
    taken = collections.Counter()
    for r in got:
        s = sources[r["doc_id"]]
        assert np.isclose(r["target"], target[s]) and r["source_size"] == size[s] and r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    words = collections.Counter()
    for r in mixing.mixed(d, piece=8).collect():
        words[r["source"]] += len(r["text"].split())
    assert words == +taken


# ---- 6 -----------------------------------------------------------------------------------------------------------------
def test_license_rules(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "MIT License MIT license", "GNU General Public License version 3 or any later version", None, "mit x license", "SPDX-License-Identifier: BSD-3-Clause", "all rights reserved"]
    got = {r["doc_id"]: r for r in licenses.scan(docs(spark, texts)).collect()}
    assert (got[0]["labels"], got[0]["base_labels"], got[0]["first_word"], got[0]["n_words"]) == ("apache,apache-2.0", "apache", 3, 8)
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["labels"]) == (2, 0, 2, "mit")
    assert got[2]["labels"] == "gpl,gpl-3.0,gpl-3.0-or-later" and got[3]["labels"] == "" and got[3]["first_word"] is None and got[4]["n_base"] == 0
    assert got[5]["labels"] == "bsd-3-clause" and got[6]["labels"] == "proprietary" and 0 < got[6]["score"] <= 1
    assert len(licenses.rules()) > 300


def shortest(signature):
    """A text of a signature's first alternatives, without the words that may be missing and with one for a star."""
    return " ".join(w.replace("*", "noncommercial").split("|")[0] for w in signature.split() if not w.endswith("?"))


def test_every_license_name_is_found(spark):
    names = [(label.removesuffix("-short"), n) for label, _, names, _ in licenses.FAMILIES for n in names]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(docs(spark, [f"under {shortest(n)}." for _, n in names])).collect()}
    assert [(label, n) for i, (label, n) in enumerate(names) if label not in got[i]] == []
    more = [("gpl-2.0", "Licensed under GPLv2"), ("gpl-3.0", "GNU GPLv3"), ("mit", "the Expat License"), ("cc0-1.0", "Creative Commons Zero")]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(docs(spark, [t for _, t in more])).collect()}
    assert all(label in got[i] for i, (label, _) in enumerate(more))


def test_license_rules_match_their_cases(spark):
    clauses = [(label, shortest(c).replace("[0-9][0-9]", "98")) for label, _, _, c in licenses.CLAUSES]
    more = [("warranty-disclaimer", "without any warranties"), ("copyright", "Copyright (c) 1998 X"), ("copyright", "copyright 2021"),
            ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose"), ("gpl-2.0", "GPL v2"), ("gpl-3.0", "General Public License v3"),
            ("apache-2.0", "Apache License v2.0"), ("lgpl-2.1", "GNU Lesser General Public License v2.1"), ("mpl-2.0", "Mozilla Public License v2.0"),
            ("gpl-2.0-or-later", "GNU General Public License v2 or any later version")]
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(docs(spark, [t for _, t in clauses + more])).collect()}
    assert [(label, t) for i, (label, t) in enumerate(clauses + more) if label not in got[i]] == []
    spans = {d["l"]: -d["neg_end"] - d["s"] for d in licenses.scan(docs(spark, ["Elastic License v2"])).first()["detections"]}
    assert spans == {"elastic-2.0": 3}


def test_sentences_are_found(spark):
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.scan(docs(spark, [f"x {shortest(t)} y" for _, _, t in licenses.SENTENCES])).collect()}
    inner = {x[2]: got[i] for i, x in enumerate(licenses.SENTENCES) if x[0] not in got[i]}
    # A phrase may lie inside one of a higher priority; that one's label stands for it.
    assert all(any(p < 3 for _, p, _ in licenses.SENTENCES) and labels != [""] for labels in inner.values()) and len(inner) < 12, inner
    assert len(licenses.SENTENCES) + len(licenses.CLAUSES) + sum(len(f[2]) for f in licenses.FAMILIES) > 300


def test_licenses_by_hand(spark):
    """Texts and the labels that a reader would give, not made from the rules."""
    cases = [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", {"mit"}),
        ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", {"apache", "apache-2.0"}),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", {"gpl", "gpl-3.0"}),
        ("Redistribution and use in source and binary forms, with or without modification, are permitted", {"bsd"}),
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", {"cc", "cc-by-4.0"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"mpl", "mpl-2.0"}),
        ("Copyright 2020 The Authors. All rights reserved.", {"copyright", "proprietary"}),
        ("SPDX-License-Identifier: LGPL-2.1", {"lgpl-2.1"}),
        ("the licence to drive a bus", set()), ("he was a licensed pilot", set()), ("the cc line of the mail", set()), ("an open source of water", set()), ("mit einem Freund", set()),
        ("general practice, public license plates", set()), ("the apache people", set()), ("rights of way are reserved", set()), ("a domain of public interest", set()),
    ]
    got = {r["doc_id"]: {x for x in r["labels"].split(",") if x} for r in licenses.scan(docs(spark, [t for t, _ in cases])).collect()}
    assert [(t, want, got[i]) for i, (t, want) in enumerate(cases) if not (want <= got[i] if want else not got[i])] == []


def test_a_text_of_very_many_matches(spark):
    import time

    d = docs(spark, ["mit license " * 40_000, "all rights reserved, apache license 2.0. " * 10_000])
    began = time.time()
    got = {r["doc_id"]: (r["n_words"], r["n_base"], r["last_word"], len(r["detections"])) for r in licenses.scan(d).collect()}
    assert got[0] == (80_000, 40_000, 79_998, 40_000) and got[1][:2] == (70_000, 10_000) and got[1][3] >= 20_000
    assert time.time() - began < 60


def test_inner_detections_are_suppressed(spark):
    got = licenses.scan(docs(spark, ["released under the terms of the mozilla public license version 2.0"])).first()
    assert [d["l"] for d in got["detections"]] == ["mpl-2.0"] and got["detections"][0]["p"] == 1


# ---- 7 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("capacity, key_bits", [(4096, 64), (1, 64), (1, 2)])
def test_exact_dedup(spark, capacity, key_bits):
    texts = ["a b", "a\t b", "c", None, "", "\n", " ", "c ", "d", "e", "f", "g", "a b"]
    norm = [" ".join([""] * 0 + [__import__("re").sub(r"[ \t-\r]+", " ", t or "")]) for t in texts]
    first, size = {}, collections.Counter(norm)
    for i, t in enumerate(norm):
        first.setdefault(t, i)
    want = {(i, first[t], size[t], first[t] == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in enumerate(norm)}
    found = exact_dedup.exact_dedup(docs(spark, texts), capacity=capacity, key_bits=key_bits)
    assert {tuple(r) for r in found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()} == want


def test_exact_dedup_of_repeated_rows(spark):
    d = docs(spark, ["x", "x", "y", "x"], ids=[4, 4, 4, 9])
    assert [r["kept"] for r in exact_dedup.exact_dedup(d).collect()].count(True) == 2
    assert sorted(r["text"] for r in exact_dedup.keep_first(d).collect()) == ["x", "y"]


def test_directory_splits_overfull_buckets(spark):
    texts = [f"t{i}" for i in range(200)]
    index, cells, base = exact_dedup.build_index(docs(spark, texts), capacity=4)
    rows = index.collect()
    load = collections.Counter(r["bucket"] for r in rows)
    assert max(load.values()) <= 4 and len(rows) == 200
    # A bucket is a range of keys: sorted by bucket, the keys are sorted too, and the directory lists each bucket once.
    ordered = sorted(rows, key=lambda r: (r["bucket"], r["key"] % 2**64))
    assert [r["key"] % 2**64 for r in ordered] == sorted(r["key"] % 2**64 for r in rows)
    listed = [b for r in cells.collect() for b in r["buckets"]]
    assert len(listed) == len(set(listed)) and set(load) <= set(listed) and max(len(r["buckets"]) for r in cells.collect()) > 1
    chained, _, _ = exact_dedup.build_index(docs(spark, [f"t{i}" for i in range(40)]), capacity=1, key_bits=3)
    assert chained.agg(F.max("chain")).first()[0] > 0 and chained.count() == 40


def test_rows_are_found_through_the_index(spark):
    """What the index holds is what the rows get: with other entries, or with a directory that names other buckets, the
    result is another."""
    d = docs(spark, ["a", "a", "b", "c c", "c  c"])
    index, cells, base = exact_dedup.build_index(d, capacity=1)
    text = d.select(F.col("doc_id").alias("id"), exact_dedup.normalised().alias("t"))
    rows = text.select("id", exact_dedup.key_of(F.col("t")).alias("key"), F.sha2("t", 256).alias("text_sha256"))
    assert {(r["id"], r["keep_id"]) for r in exact_dedup.look_up(rows, index, cells, base).collect()} == {(0, 0), (1, 0), (2, 2), (3, 3), (4, 3)}
    other = index.withColumn("keep_id", F.col("keep_id") + 10)
    assert {r["keep_id"] for r in exact_dedup.look_up(rows, other, cells, base).collect()} == {10, 12, 13}
    moved = cells.withColumn("buckets", F.transform("buckets", lambda b: b - 1))
    assert exact_dedup.look_up(rows, index, moved, base).count() == 0


def test_clashing_names(spark, sf):
    """Columns that operators might use themselves, and names with dots, pass through."""
    names = ["__id", "__key", "__sha", "__s", "__n", "__part", "__size", "__taken", "__gone", "__row", "__k1", "__times", "__toxic", "a.b", "ke`pt"]
    d = docs(spark, ["x y z", "x y z", "u v"])
    for n in names:
        d = d.withColumn(n, F.lit(n))
    import corpus_pipeline as cp

    toxic = lambda x: cp.drop_toxic(spark, x, sf)
    for f in (exact_dedup.keep_first, near_dedup.keep_one, line_dedup.without_repeats, mixing.mixed, toxic):
        out = f(d)
        assert out.columns == d.columns, f
        rows = out.collect()
        assert rows and all(r[n] == n for r in rows for n in names), f


# ---- 8 -----------------------------------------------------------------------------------------------------------------
def test_toxicity_learns_words_and_pairs(spark):
    rng = random.Random(0)
    plain = [f"p{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    texts, labels = [], []
    for k in range(600):
        w = [rng.choice(plain) for _ in range(30)]
        kind = k % 4
        w += {0: [], 1: ["vermin"], 2: ["neighbours"], 3: ["vermin", "neighbours"]}[kind]
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append(int(kind == 3))
    d = docs(spark, texts + [None, ""])
    lab = spark.createDataFrame([(i, y) for i, y in enumerate(labels) if i % 5] + [(3, None), (1, 7)], "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(d, model).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    assert all(0 <= v <= 1 for v in got.values()) and len(got) == 602
    assert min(got[i] for i in held if labels[i]) > 2 * max(got[i] for i in held if not labels[i])  # neither word alone tells
    assert got[600] == got[601] < 0.5
    none = toxicity.train(d, lab.where("toxic = 0"))
    assert toxicity.score(d, none).agg(F.max("score")).first()[0] < 0.3


def test_toxicity_learns_many_pairs():
    """Ten insults by ten group words, each of both common in clean rows as well: only a pair tells."""
    rng = np.random.default_rng(1)
    slots = rng.permutation(toxicity.SLOTS)
    rows, labels = [], []
    for _ in range(10_000):
        insult, group = rng.random() < 0.45, rng.random() < 0.12
        own = [*rng.integers(100, 3100, 30), *rng.integers(0, 10, int(insult)), *rng.integers(20, 30, int(group))]
        rows.append(np.unique(slots[(np.array(own)[:, None] * 4 + np.arange(4)).ravel()]))
        labels.append(float(insult and group))
    y = np.array(labels)
    model = toxicity.fit(rows[:8000], y[:8000])
    seen = np.bincount(np.concatenate(rows[:8000]), minlength=toxicity.SLOTS) >= toxicity.MIN_ROWS
    assert (model.linear[seen] != 0).all() and (model.factors[seen] != 0).any(axis=1).all()
    held = rows[8000:]
    found = toxicity.sigmoid(model.logits(np.concatenate(held), np.cumsum([0] + [len(r) for r in held]))) >= toxicity.THRESHOLD
    assert found[y[8000:] == 1].mean() > 0.9 and found[y[8000:] == 0].mean() < 0.01


def test_scores_by_brute_force(spark):
    """The query's scores are those of the sum over all pairs of a text's terms."""
    rng = np.random.default_rng(5)
    model = toxicity.Model(-1.5, rng.normal(0, 0.3, toxicity.SLOTS).astype(np.float32), rng.normal(0, 0.2, (toxicity.SLOTS, toxicity.FACTORS)).astype(np.float32))
    d = docs(spark, ODD[:5] + ["One two, three", "two three TWO", "x" * 50 + " y", "word " * 100_000])
    terms = {r["doc_id"]: r["t"] for r in d.select("doc_id", toxicity.terms_of(F.coalesce("text", F.lit(""))).alias("t")).collect()}
    for r in toxicity.score(d, model).collect():
        own = terms[r["doc_id"]]
        z = model.bias + sum(float(model.linear[i]) for i in own)
        z += sum(float(model.factors[i].astype(float) @ model.factors[j].astype(float)) for k, i in enumerate(own) for j in own[:k])
        assert np.isclose(r["score"], 1 / (1 + np.exp(-z)), atol=1e-5), r
    assert toxicity.score(d.where("doc_id < 0"), model).count() == 0
    nothing = toxicity.train(d.where("doc_id < 0"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(d, nothing).agg(F.max("score")).first()[0] < 0.3


def test_weights_of_either_sign():
    """A word that tells clean texts counts against toxicity."""
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(2000):
        toxic = k % 3 == 0
        rows.append(np.unique(np.concatenate([rng.integers(100, 900, 20), [1] if toxic or rng.random() < 0.3 else [], [2] if not toxic and rng.random() < 0.8 else []]).astype(np.int64)))
        labels.append(float(toxic))
    model = toxicity.fit(rows, np.array(labels))
    assert model.linear[1] > 0 > model.linear[2]
    both, one = model.logits(np.array([1, 2, 1]), np.array([0, 2, 3]))
    assert both < one


def test_toxicity_on_held_out_rows(spark, sf):
    found = queries.op8_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = (found.predicted == 1) & (found.toxic == 1)
    assert hit.sum() / max(1, (found.toxic == 1).sum()) > 0.9 and hit.sum() / max(1, (found.predicted == 1).sum()) > 0.9


# ---- 9 -----------------------------------------------------------------------------------------------------------------
def test_jpeg_round_trip(spark):
    payloads = [bytes(64), bytes(range(256)) * 3, bytes([0, 255] * 640), np.random.default_rng(0).bytes(64 * 9000)]
    found = jpeg.thumbnails(jpeg.store(payloads))
    assert [b"".join(t.tobytes() for t in x) for x in found] == payloads
    texts = ODD + ["a", "x" * 64]
    got = {r["doc_id"]: r for r in jpeg.media_columns(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[0]["feature"] == got[1]["feature"] and got[4]["media_sha256"] == got[len(ODD)]["media_sha256"]
    two = jpeg.columns_of(jpeg.stored(docs(spark, texts))).collect()
    assert {tuple(r) for r in two} == {tuple(r) for r in got.values()}


def test_feature_by_brute_force():
    """Dimensions, bits of neighbouring means and the checksum, area by area; images smaller than the grid too."""
    rng = np.random.default_rng(4)
    for high, wide in ((1, 64), (3, 64), (8, 9), (40, 64), (17, 23)):
        parts = [rng.integers(0, 256, (high, wide), np.uint8), rng.integers(0, 256, (2, 5), np.uint8)]
        bits = ""
        for r in range(8):
            means = []
            for c in range(9):
                top, left = min(r * high // 8, high - 1), min(c * wide // 9, wide - 1)
                bottom, right = max((r + 1) * high // 8, top + 1), max((c + 1) * wide // 9, left + 1)
                cells = [int(parts[0][y, x]) for y in range(top, bottom) for x in range(left, right)]
                means.append(sum(cells) / len(cells))
            bits += "".join("1" if a > b else "0" for a, b in zip(means, means[1:]))
        crc = zlib.crc32(parts[1].tobytes(), zlib.crc32(parts[0].tobytes()))
        assert jpeg.feature(parts) == f"{8 * wide}x{8 * high},40x16;{int(bits, 2):016x};{crc:08x}"


def test_media_are_written_and_recovered_from_there(spark, sf, monkeypatch):
    written = []
    monkeypatch.setattr(queries, "staged", lambda df, name: written.append(common.staged(df, name)) or written[-1], raising=False)
    got = {r["doc_id"]: r["media_sha256"] for r in queries.op9_jpeg_media(spark, sf).collect()}
    assert len(written) == 1 and {r["doc_id"]: hashlib.sha256(r["media"]).hexdigest() for r in written[0].collect()} == got


def test_jpeg_of_colour_with_ac_coefficients():
    """Two components, the first sampled twice each way, with AC codes to skip and no restart markers."""
    dc = ((0, 3), (0, 4, 8))
    ac = ((0, 3), (0x00, 0x12, 0xF0))
    bits = ""
    codes = {0: "00", 1: "01", 2: "10"}
    values = []
    for _ in range(2):  # two units of 4 + 1 blocks
        for _ in range(5):
            values.append(4)
            bits += codes[1] + "1000"  # a difference of 8
            bits += codes[2] + codes[1] + "11" + codes[0]  # a run of 16, a run of 1 with two bits, the end
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    seg = jpeg.segment
    table = lambda kind, t: seg(0xC4, bytes([kind, *t[0], *[0] * (16 - len(t[0])), *t[1]]))
    raw = (b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0] + [1] * 64)) + seg(0xC0, bytes([8, 0, 16, 0, 32, 2, 1, 0x22, 0, 2, 0x11, 0])) + table(0, dc) + table(0x10, ac)
           + seg(0xDA, bytes([2, 1, 0, 2, 0, 0, 63, 0])) + data + b"\xff\xd9")
    thumb = jpeg.thumbnails([raw])[0][0]
    assert thumb.tolist() == [[129, 130, 133, 134], [131, 132, 135, 136]]
    with pytest.raises(ValueError):
        jpeg.thumbnails([raw[:-4]])


# ---- 10 ----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("split", [warc.SPLIT, 300])
def test_warc_round_trip(spark, split):
    bodies = ["a", "b", "a", None, "", "é" * 5000, "\x1f\x8b\x08 WARC/1.1\r\n\r\n", "a", "b" * 2000]
    ids = [7, 2, 3, 4, 5, 6, 1, 9, 9]
    pages = spark.createDataFrame([(i, None if i == 2 else f"http://x/{i}\r\n", b) for i, b in zip(ids, bodies)], "page_id long, url string, html string").withColumn("refers_to", F.lit("clash"))
    path = common.fresh_dir(spark, "w")
    warc.write(pages, path)
    got = sorted(map(tuple, warc.read(spark, path, split).collect()), key=str)
    first = {}
    for i, b in sorted(zip(ids, bodies)):
        first.setdefault(b or "", i)
    digest = lambda b: base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode()
    want = sorted(((i, len((b or "").encode()), digest(b), "response" if first[b or ""] == i else "revisit", None if first[b or ""] == i else first[b or ""]) for i, b in zip(ids, bodies)), key=str)
    assert got == want
    for f in glob.glob(path.removeprefix("file://") + "/part*"):
        gzip.decompress(open(f, "rb").read())


def test_warc_skips_damage(tmp_path):
    rows = [warc.member(warc.record(i, "u", b"x" * 100, None, "0")) for i in range(3)]
    f = tmp_path / "a"
    f.write_bytes(rows[0] + b"\x1f\x8b\x08garbage" + rows[1] + rows[2][:-30])
    with open(f, "rb") as h:
        assert [r[0] for r in warc.records_in(h, f.stat().st_size, 0, f.stat().st_size)] == ["0", "1"]
    data = warc.member(b"y" * 10)
    assert data[-1] == 0


def test_warc_of_others(spark, tmp_path):
    """Foreign, incomplete and damaged headers end no job."""
    heads = [
        "WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:12-ab>\r\nContent-Length: 6\r\n", "WARC-Type: revisit\r\nWARC-Record-ID: <urn:page:4>\r\nContent-Length: 0\r\n",
        "WARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Length: many\r\n", "WARC-Type: response\r\nWARC-Record-ID: <urn:page:6>\r\n", "WARC-Type: warcinfo\r\nContent-Length: 6\r\n",
        "no colon \udcff\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 6\r\n", "WARC-Type: response\r\nWARC-Record-ID: <urn:page:8>\r\nContent-Length: 99\r\n", "", "WARC-Type: response\r\nContent-Length: 6\r\n"]
    f = tmp_path / "a.warc.gz"
    f.write_bytes(b"".join(gzip.compress(b"WARC/1.1\r\n" + h.encode("utf-8", "surrogateescape") + b"\r\n" + b"h\r\n\r\nx") for h in heads))
    got = sorted(map(tuple, warc.read(spark, str(tmp_path), id_type="string").collect()), key=str)
    x = warc.digest(b"x")
    assert got == sorted([("urn:uuid:12-ab", 1, x, "response", None), ("4", None, None, "revisit", None), ("7", 1, x, "response", None), (None, 1, x, "response", None)], key=str)
    assert sorted(str(r["page_id"]) for r in warc.read(spark, str(tmp_path)).collect()) == ["4", "7", "None", "None"]


def test_warc_ids_and_empty_tables(spark):
    pages = spark.createDataFrame([("a b/<ü>", "u", "one"), ("c", None, "one"), ("c", "v", "one"), (None, "w", "one")], "page_id string, url string, html string")
    got = sorted(map(str, warc.round_trip(pages).select("page_id", "record_type", "refers_to").collect()))
    assert got == sorted(map(str, pages.select("page_id").limit(0).collect())) + sorted(map(str, spark.createDataFrame(
        [("a b/<ü>", "response", None), ("c", "revisit", "a b/<ü>"), ("c", "revisit", "a b/<ü>"), (None, "response", None)], "page_id string, record_type string, refers_to string").collect()))
    assert warc.round_trip(pages.where("page_id = 'none'")).count() == 0


# ---- pipeline ----------------------------------------------------------------------------------------------------------
def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline as cp

    read = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [read]
    for name, stage in cp.STAGES:
        kept.append(common.staged(stage(spark, kept[-1], sf), name))
        if name != cp.STAGES[-1][0]:
            assert kept[-1].columns == read.columns
    toxic, exact, near, mixed, last = kept[1:]
    norm = [" ".join([__import__("re").sub(r"[ \t-\r]+", " ", r["text"] or "")]) for r in toxic.collect()]
    assert exact.count() == len(set(norm))
    classes = brute_classes({r["doc_id"]: r["text"] for r in exact.collect()})
    assert {r["doc_id"] for r in near.collect()} == set(classes.values())
    want = mixing.mix(near).agg(F.sum("taken")).first()[0]
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == want
    assert last.count() == mixed.count() and last.where("not round_trip").count() == 0 and last.where("parity = false").count() == 0
    assert sorted(r["doc_id"] for r in cp.run(spark, sf).collect()) == sorted(r["doc_id"] for r in last.collect())
