"""Toxicity by multiple-instance learning: a document is toxic if any sentence is.

A sentence's score is a logistic function of its hashed words and word
beginnings, which stand for the forms of a stem; the document's is the noisy-or of its sentences, 1 - prod(1 - p). Only documents carry labels,
so the gradient of the noisy-or spreads a document's label over its sentences
in proportion to how much each explains it. The sentence scores then say where.

null and empty texts have no sentence and score 0. Documents without a label,
or with labels that differ, are scored but not learnt from; without both labels
among the rows to learn from, every score is the share of label 1 there (0 for
none). Repeated rows are scored each; rows that share an id and are labelled are
each learnt from. Ties: of equally bad sentences the first is reported, and equal
scores are treated alike. Very long texts take memory in proportion to one text.
Only the columns named are read, so others may clash in name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as t
from .common import give_back, map_arrow

#: Hashed features: each word and its first so many bytes.
DIMS = 1 << 20
BEGINNINGS = (4, 5, 6)
#: A feature of fewer of the documents learnt from has no weight.
RARE = 4
#: Nor has one whose documents' labels are within so many standard deviations of the usual share.
APART = 2.5
#: Labelled documents of each label that the model is fitted on, at most.
SAMPLE = 1500
STEPS, RATE, SHRINK, BIAS = 200, 0.3, 3e-4, -9.0
#: Steadies the pace of features with small gradients.
SLOW = 3e-4

_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


def sentences(buf: np.ndarray, offs: np.ndarray):
    """Sentence starts, ends and document bounds; per sentence bounds of its features, and those."""
    start, end, bounds = t.runs(~_STOP[buf], offs)
    low = t.LOWER[buf]
    ws, we, _ = t.runs(_LETTER[buf] & ~_STOP[buf], offs)
    pre = t.prefix(t.BYTE[low])
    ids = np.zeros((len(ws), 1 + len(BEGINNINGS)), np.int32)
    if len(ws):
        for k, n in enumerate((0, *BEGINNINGS)):
            at = np.minimum(ws + n, we) if n else we
            ids[:, k] = (t.mix(t.slices(pre, ws, at) + t.U(n)) >> t.U(64 - 20)).astype(np.int32)
    return start, end, bounds, np.append(np.searchsorted(ws, start), len(ws)) * ids.shape[1], ids.ravel()


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, buf: np.ndarray, offs: np.ndarray):
        """Document scores; of each document's worst sentence the score, start and end in bytes (-1 for none)."""
        start, end, bounds, wb, ids = sentences(buf, offs)
        z = self.bias + t.grouped_sum(self.weights[ids], wb)
        none = np.logaddexp(0, z)  # -log(1 - p)
        doc = -np.expm1(-t.grouped_sum(none, bounds))
        n = len(bounds) - 1
        worst = np.full(n, -1, np.int64)
        order = np.lexsort((-start, z, t.owner(bounds)))
        has = bounds[1:] > bounds[:-1]
        worst[has] = order[bounds[1:][has] - 1]
        p = np.where(has, 1 / (1 + np.exp(-np.maximum(z[worst], -60))), 0.0) if len(z) else np.zeros(n)
        at = lambda x: np.where(has, x[worst] - offs[:-1], -1) if len(z) else worst
        return np.clip(doc, 0, 1), p, at(start), at(end)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """bags: (features, sentence lengths in features) of each document."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        p = np.clip(share, 1e-9, 1 - 1e-9)
        return Model(np.zeros(DIMS, np.float32), float(np.log(p / (1 - p))))
    n, ones = np.zeros(DIMS), np.zeros(DIMS)
    for (ids, _), label in zip(bags, labels, strict=True):
        seen = np.unique(ids)
        n[seen] += 1
        ones[seen] += label
    good = (n >= RARE) & (np.abs(ones - n * share) >= APART * np.sqrt(np.maximum(n, 1) * share * (1 - share)))
    ids, sent_of, first = [], [], 0
    for i, lengths in bags:
        at = np.flatnonzero(good[i])
        ids.append(i[at])
        sent_of.append((first + np.searchsorted(np.cumsum(lengths), at, "right")).astype(np.int32))
        first += len(lengths)
    ids, sent_of = np.concatenate(ids), np.concatenate(sent_of)
    wb = np.searchsorted(sent_of, np.arange(first + 1))
    db = np.concatenate([[0], np.cumsum([len(b[1]) for b in bags])])
    doc_of = t.owner(db)
    names, ids = np.unique(ids, return_inverse=True)
    size = len(names)
    y = labels.astype(float)
    # both labels weigh the same in the first half, then as they are found, which calibrates the scores
    even = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    w, b = np.zeros(size), BIAS
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, STEPS + 1):
        z = b + t.grouped_sum(w[ids], wb)
        p = 1 / (1 + np.exp(-np.maximum(z, -60)))
        q = np.exp(-t.grouped_sum(np.logaddexp(0, z), db))
        pull = np.where(y == 1, -q / np.maximum(1 - q, 1e-6), 1.0) * (even if step < STEPS // 2 else 1.0)
        g = p * pull[doc_of] / len(y)
        gw = np.bincount(ids, weights=g[sent_of], minlength=size)
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        pace = RATE / (np.sqrt(v / c2) + SLOW)
        w -= pace * m / c1
        w = np.sign(w) * np.maximum(np.abs(w) - SHRINK * pace, 0)  # few features keep a weight
        b -= RATE / 3 * (mb / c1) / (np.sqrt(vb / c2) + SLOW)
    out = np.zeros(DIMS, np.float32)
    out[names] = w
    return Model(out, float(b))


def train(docs: DataFrame, labels: DataFrame, fold, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled documents for which `fold` (a column over the labels' id) holds.

    At most SAMPLE documents of each label, those with the smallest hashes of their ids.
    """
    known = labels.select(id_col, F.col(label_col).cast("int").alias("_y")).where(fold & F.col("_y").isin(0, 1))
    known = known.groupBy(id_col).agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z")
    h = F.xxhash64(id_col)
    picked = [known.where(f"_y = {y}").orderBy(h, id_col).limit(SAMPLE) for y in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]).select(F.col(id_col).alias("_id"), "_y"))  # 2 * SAMPLE rows at most
    rows = docs.select(id_col, text_col).join(picked, F.col(id_col) == F.col("_id")).select("_y", F.xxhash64(id_col, text_col).alias("_h"), text_col)

    def bag(batches):
        for b in batches:
            for i, j, buf, offs in t.chunks(b.column(2)):
                _, _, bounds, wb, ids = sentences(buf, offs)
                of = wb[bounds]
                n = [np.diff(wb[x : y + 1]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([ids[x:y] for x, y in zip(of[:-1], of[1:], strict=True)], pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int64()))], ["_y", "_h", "ids", "n"])

    got = map_arrow(rows, bag, "_y int, _h long, ids array<int>, n array<long>").toArrow()
    order = np.lexsort((got["_h"].to_numpy(), got["_y"].to_numpy())).tolist()  # rows come in any order; equal keys are equal rows
    ids, n, y = list(map(_np, got["ids"])), list(map(_np, got["n"])), got["_y"].to_numpy()
    model = fit([(ids[k], n[k]) for k in order], y[order].astype(int))
    del got, ids, n
    give_back()
    return model


def _np(x) -> np.ndarray:
    return x.values.to_numpy(zero_copy_only=False)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """id, score, predicted (1 if score >= limit) and of the worst sentence its score and place in bytes."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS floats

    def run(batches):
        for b in batches:
            for i, j, buf, offs in t.chunks(b.column(1)):
                doc, p, start, end = shared.value.score(buf, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(doc), pa.array((doc >= limit).astype(np.int32)), pa.array(p), pa.array(start), pa.array(end)], [id_col, "score", "predicted", "worst_score", "worst_start", "worst_end"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, score double, predicted int, worst_score double, worst_start long, worst_end long")


def reject(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.7) -> DataFrame:
    """The rows of docs, all columns as they are, that score under the limit."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS floats
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            keep = [shared.value.score(buf, offs)[0] < limit for _, _, buf, offs in t.chunks(b.column(at))]
            yield b.filter(pa.array(np.concatenate(keep))) if keep else b

    return map_arrow(docs, run, docs.schema)
