"""Toxicity scores from a factorization machine over hashed terms.

Terms are the lower-cased words of a text and their leading 4, 5 and 6 letters, hashed into a fixed number of slots; a
term counts once. A text's value is w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, so a pair of terms (an insult
beside a word that names a group) can weigh more than its two parts. It is trained here, with AdaGrad on mini-batches in
numpy, from a sample of at most `max_rows` labelled rows picked by hash, whose terms are read up to `max_terms` in all;
scoring reads every whole text. Every slot seen
in MIN_ROWS training rows has a weight and factors. x_i is not 1 but grows with the evidence that the slot depends on the
label, from FLOOR up: a slot of weak evidence learns slowly, which is the regularisation, and none is left out.

Cases: a null or empty text has no terms and gets the score of the bias alone. Labels other than 0 and 1 and null
labels are not learned from; rows whose label appears more than once count once, as toxic if any says so. With no
labelled row, or one class only, the model is a constant. An empty table gives no rows. Only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_or_empty

#: Slots that terms are hashed into, and factors of each.
SLOTS, FACTORS = 1 << 18, 4
#: Bound of the training sample, in rows; and of the terms kept from it.
MAX_TRAIN_ROWS, MAX_TRAIN_TERMS = 8_000, 12_000_000
#: Training rows a slot must be in to have a weight; the chi-square at which its x is a half; the least x.
MIN_ROWS, HALF_CHI_SQUARE, FLOOR = 4, 15.0, 0.02
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def logits(self, terms: np.ndarray, offsets: np.ndarray, most: int = 1 << 17) -> np.ndarray:
        """Of rows whose terms are terms[offsets[i]:offsets[i+1]], about `most` terms at a time; terms without a weight
        don't count."""
        used = (self.linear != 0) | (self.factors != 0).any(axis=1)
        out = np.full(len(offsets) - 1, self.bias)
        at = 0
        while at < len(out):
            to = min(max(int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1, at + 1), len(out))
            own = terms[offsets[at] : offsets[to]]
            kept = used[own]
            ends = np.concatenate([[0], np.cumsum(kept)])[offsets[at : to + 1] - offsets[at]]
            out[at:to] += self._above_bias(own[kept], ends)
            at = to
        return out

    def _above_bias(self, terms: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        counts = np.diff(offsets)
        out = np.zeros(len(counts))
        has = counts > 0
        if has.any():
            starts = offsets[:-1][has]
            out[has] += np.add.reduceat(self.linear[terms], starts, dtype=np.float64)
            v = self.factors[terms].astype(np.float64)
            both = np.add.reduceat(v, starts, axis=0) ** 2 - np.add.reduceat(v * v, starts, axis=0)
            out[has] += 0.5 * both.sum(axis=1)
        return out


def terms_of(text: Column, slots: int = SLOTS) -> Column:
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+"))
    words = F.filter(words, lambda w: w != "")
    hashed = F.flatten(F.transform(words, lambda w: F.array(
        F.pmod(F.hash(w), F.lit(slots)), F.pmod(F.hash(F.substring(w, 1, 4), F.lit(4)), F.lit(slots)),
        F.pmod(F.hash(F.substring(w, 1, 5), F.lit(5)), F.lit(slots)),
        F.pmod(F.hash(F.substring(w, 1, 6), F.lit(6)), F.lit(slots)))))
    return F.array_distinct(hashed)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def apart(rows: list[np.ndarray], labels: np.ndarray, ids: list[int]) -> list[int]:
    """One of each set of copies and most near copies, told by the label and three min-hashes: a text copied a thousand
    times would else teach that its plain words are clean."""
    seen: dict[tuple, int] = {}
    for r, y, i in zip(rows, labels, ids, strict=True):
        mixed = (r.astype(np.uint64) + 1) * np.uint64(0x9E3779B97F4A7C15)
        mins = [int(((mixed ^ (mixed >> np.uint64(31 + k))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)).min()) if len(r) else 0 for k in range(3)]
        seen.setdefault((int(y), *mins), i)
    return list(seen.values())


def evidence(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks the slots to learn; x of each slot, and how much more common it is among toxic rows."""
    def seen(wanted: float) -> np.ndarray:
        own = [r for r, y in zip(rows, labels, strict=True) if y == wanted]
        return np.bincount(np.concatenate(own), minlength=SLOTS).astype(float)

    n, pos = len(labels), labels.sum()
    a, b = seen(1.0), seen(0.0)
    c, d = pos - a, n - pos - b
    chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * pos * (n - pos), 1e-9)
    lift = (a + 0.5) / (pos + 1) / ((b + 0.5) / (n - pos + 1))
    return a + b >= MIN_ROWS, np.maximum(chi**2 / (chi**2 + HALF_CHI_SQUARE**2), FLOOR), lift


def fit(rows: list[np.ndarray], labels: np.ndarray, steps: int = 3000, batch: int = 32, rate: float = 0.1,
        decay: float = 2e-5, seed: int = 11) -> Model:
    """AdaGrad on the logistic loss, mini-batches in a seeded order, from half the terms' log ratios: a rare term that only
    stands beside common ones would else learn nothing. The model's weights and factors have x multiplied in."""
    rng = np.random.default_rng(seed)
    linear = np.zeros(SLOTS)
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log((share * len(labels) + 0.5) / ((1 - share) * len(labels) + 0.5))) if len(labels) else -6.0
    if not len(labels) or share in (0.0, 1.0):
        return Model(bias, linear.astype(np.float32), np.zeros((SLOTS, FACTORS), np.float32))
    common, x, lift = evidence(rows, labels)
    place = np.cumsum(common) - 1
    rows = [place[r[common[r]]] for r in rows]
    n, x = int(common.sum()), x[common]
    w, v = 0.5 * np.log(lift[common]), rng.normal(0, 0.1, (n, FACTORS))
    gw, gv, gb = np.full(n, 1e-6), np.full((n, FACTORS), 1e-6), 1e-6
    for _ in range(-(-steps * batch // len(rows))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            ids = [i for i in order[at : at + batch] if len(rows[i])]
            if not ids:
                continue
            flat = np.concatenate([rows[i] for i in ids])
            counts = np.array([len(rows[i]) for i in ids])
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
            xf = x[flat]
            vf = v[flat] * xf[:, None]
            total = np.add.reduceat(vf, starts, axis=0)
            squares = np.add.reduceat(vf * vf, starts, axis=0)
            z = bias + np.add.reduceat(w[flat] * xf, starts) + 0.5 * (total**2 - squares).sum(axis=1)
            err = (sigmoid(z) - labels[ids]) / len(ids)
            used, inverse = np.unique(flat, return_inverse=True)
            each = np.repeat(err, counts) * xf
            dw = np.bincount(inverse, each, len(used)) + decay * w[used]
            pull = each[:, None] * (np.repeat(total, counts, axis=0) - vf)
            dv = np.stack([np.bincount(inverse, pull[:, k], len(used)) for k in range(FACTORS)], axis=1) + decay * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            gb += err.sum() ** 2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
            bias -= rate * err.sum() / np.sqrt(gb)
    factors = np.zeros((SLOTS, FACTORS))
    linear[common], factors[common] = w * x, v * x[:, None]
    return Model(bias, linear.astype(np.float32), factors.astype(np.float32))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_TRAIN_ROWS, max_terms: int = MAX_TRAIN_TERMS) -> Model:
    """From the rows of docs that labels marks; the sample is the same at every run and partitioning."""
    own = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    own = own.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    pick = own.orderBy(F.md5(F.col("id").cast("string")), "id").limit(max_rows)
    text = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    found = text.join(F.broadcast(pick), "id").select("id", "y", terms_of(F.col("t")).alias("x"))  # max_rows ids at most
    got = found.toArrow().combine_chunks()
    x, y = got.column("x").combine_chunks(), got.column("y").to_numpy()
    ids = got.column("id").to_numpy()
    rows = [np.asarray(r.values, dtype=np.int64) for r in x] if len(y) else []
    first = np.array([r.sum() for r in rows]) if rows else np.zeros(0)
    order = np.lexsort((first, ids)) if len(ids) else []
    kept, total = [], 0
    for i in order:
        total += len(rows[i])
        if total > max_terms:
            break
        kept.append(i)
    kept = apart([rows[i] for i in kept], y[kept], kept)
    return fit([rows[i] for i in kept], y[kept].astype(float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
          out: str = "score") -> DataFrame:
    """id_col, the columns in carry and out (the score, 0 to 1), for each row of docs. Only terms go to Python."""
    sent = docs.sparkSession.sparkContext.broadcast((model.bias, model.linear, model.factors))  # SLOTS x (FACTORS + 1) floats, whatever the input

    @F.arrow_udf("double")
    def scored(x: pa.Array) -> pa.Array:
        own = Model(*sent.value)
        offsets = x.offsets.to_numpy()
        return pa.array(sigmoid(own.logits(x.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0])), pa.float64())

    return docs.select(*[F.col(quoted(c)) for c in (id_col, *carry)], scored(terms_of(text_or_empty(text_col))).alias(out))
