"""Quality rules and a calibrated classifier over hashed word and character n-grams.

A document's features are the shares of its words and word pairs, and of its
character trigrams, that fall in each hashed slot; a logistic regression over
them is fitted on labelled rows, its margin is mapped to a probability on
labelled rows held apart (Platt scaling), and a fixed threshold decides. Fixed
limits on length and on repeated windows come before it.

null and empty texts have no words and fail the length limit. Rows without a
label, or with labels that differ, are judged but not learnt from; without both
labels the classifier keeps all. Repeated rows are judged each. Ties: a probability at
the threshold is kept. Very long texts take memory in proportion to one text.
An empty table gives an empty result. Only the columns named are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as t
from .common import map_arrow

BITS = 16
#: Labelled rows of each label that the classifier is fitted on, at most.
SAMPLE = 1500
STEPS, RATE, DECAY = 150, 0.5, 1e-6
#: Least calibrated probability of label 1 of what is kept.
THRESHOLD = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def features(buf: np.ndarray, offs: np.ndarray, h: np.ndarray, bounds: np.ndarray):
    """Word and pair slots, character slots, and the documents' bounds in each. h, bounds: of the words."""
    top = t.U(64 - BITS)
    last = np.zeros(len(h), bool)
    last[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = True
    pair = np.where(last, h, t.mix(h + np.append(h[1:], t.U(0)) * t.U(31))) if len(h) else h
    ids = np.stack([h >> top, pair >> top], 1).ravel().astype(np.int64)
    b = buf.astype(np.uint32)
    tri = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS) if len(b) > 2 else b[:0]
    ends = np.maximum(offs[1:] - 2, offs[:-1])  # trigrams do not cross documents
    return ids, 2 * bounds, tri.astype(np.int64), np.minimum(offs[:-1], len(tri)), np.minimum(ends, len(tri))


@dataclass
class Model:
    words: np.ndarray
    chars: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, buf, offs, h, bounds) -> np.ndarray:
        ids, wb, tri, a, z = features(buf, offs, h, bounds)
        c = np.concatenate([[0], np.cumsum(self.chars[tri], dtype=float)])
        margin = self.bias + t.grouped_sum(self.words[ids].astype(float), wb) / np.maximum(np.diff(wb), 1) + (c[z] - c[a]) / np.maximum(z - a, 1)
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -60, 60)))


def _adam(x: np.ndarray, g: np.ndarray, m: np.ndarray, v: np.ndarray, step: int, rate: float) -> None:
    m += 0.1 * (g - m)
    v += 0.01 * (g * g - v)
    x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Model:
    """rows: (slots, shares) of each; slots from 1 << BITS on are those of characters."""
    size = 2 << BITS
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size // 2, np.float32), np.zeros(size // 2, np.float32), 60.0, 1.0, 0.0)
    apart = np.arange(len(y)) % 4 == 0  # a quarter for the calibration
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        apart[:] = False
    ids = np.concatenate([r[0] for r in rows]).astype(np.int64)
    val = np.concatenate([r[1] for r in rows]).astype(float)
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    names, ids = np.unique(ids, return_inverse=True)
    w, b = np.zeros(len(names)), np.zeros(1)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(1), np.zeros(1)
    use = ~apart
    weight = np.where(y == 1, 0.5 / y[use].mean(), 0.5 / (1 - y[use].mean())) * use / use.sum()
    for step in range(1, STEPS + 1):
        z = b + np.bincount(of, weights=w[ids] * val, minlength=len(y))
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight
        _adam(w, np.bincount(ids, weights=val * g[of], minlength=len(w)) + DECAY * w, mw, vw, step, RATE)
        _adam(b, g.sum(keepdims=True), mb, vb, step, RATE / 10)
    z = b + np.bincount(of, weights=w[ids] * val, minlength=len(y))
    c = np.array([1.0, 0.0])
    m, v = np.zeros(2), np.zeros(2)
    held = apart if apart.any() else use
    for step in range(1, 301):
        g = 1 / (1 + np.exp(-np.clip(c[0] * z[held] + c[1], -60, 60))) - y[held]
        _adam(c, np.array([(g * z[held]).mean(), g.mean()]) + 1e-3 * (c - [1, 0]), m, v, step, 0.05)
    full = np.zeros(size, np.float32)
    full[names] = w
    return Model(full[: size // 2], full[size // 2 :], float(b[0]), float(c[0]), float(c[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most SAMPLE labelled rows of each label, those with the smallest hashes of their ids."""
    known = labels.select(id_col, F.col(label_col).cast("int").alias("_y")).where(F.col("_y").isin(0, 1))
    known = known.groupBy(id_col).agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z")
    picked = [known.where(f"_y = {y}").orderBy(F.xxhash64(id_col), id_col).limit(SAMPLE) for y in (0, 1)]
    picked = F.broadcast(picked[0].union(picked[1]).select(F.col(id_col).alias("_id"), "_y"))  # 2 * SAMPLE rows at most
    rows = docs.select(id_col, text_col).join(picked, F.col(id_col) == F.col("_id")).select("_y", text_col, F.xxhash64(id_col).alias("_h"))

    def slots(batches):
        for b in batches:
            for i, j, buf, offs in t.chunks(b.column(1)):
                s, e, bounds = t.words(buf, offs)
                ids, wb, tri, ta, tz = features(buf, offs, t.word_hashes(buf, s, e), bounds)
                names, shares = [], []
                for k in range(j - i):
                    got = [np.unique(x, return_counts=True) for x in (ids[wb[k] : wb[k + 1]], tri[ta[k] : tz[k]] + (1 << BITS))]
                    names.append(np.concatenate([g[0] for g in got]))
                    shares.append(np.concatenate([g[1] / max(g[1].sum(), 1) for g in got]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([x.astype(np.int32) for x in names], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for x in shares], pa.list_(pa.float32()))], ["_y", "_h", "ids", "val"])

    got = map_arrow(rows, slots, "_y int, _h long, ids array<int>, val array<float>").toArrow()
    np_ = lambda x: x.values.to_numpy(zero_copy_only=False)
    key = sorted(zip(got["_h"].to_pylist(), got["_y"].to_pylist(), range(len(got)), strict=True))
    rows_ = list(zip(map(np_, got["ids"]), map(np_, got["val"]), strict=True))
    return fit([rows_[k] for _, _, k in key], np.array([y for _, y, _ in key], int))


def counts(buf: np.ndarray, offs: np.ndarray):
    """Word hashes and bounds; n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each document."""
    s, e, bounds = t.words(buf, offs)
    h = t.word_hashes(buf, s, e)
    at = lambda flag: t.grouped_sum(flag, offs)
    chars = at(~t.SEPARATOR[buf] & (buf & 0xC0 != 0x80))
    ls, le, lb = t.runs(buf != 0x0A, offs)
    seps = np.concatenate([[0], np.cumsum(~t.SEPARATOR[buf])])
    worded = np.flatnonzero(seps[le] > seps[ls])
    of = t.owner(lb)[worded]
    key = t.mix(t.word_hashes(buf, ls[worded], le[worded]) + of.astype(t.U) * t.BYTE[1])
    lines = np.bincount(of, minlength=len(offs) - 1)
    _, first = np.unique(key, return_index=True)
    dup = lines - np.bincount(of[first], minlength=len(offs) - 1)
    ws = t.window_starts(bounds, WINDOW)
    wkey = t.mix(t.in_a_row(h, WINDOW)[0][ws] + t.owner(bounds)[ws].astype(t.U) * t.BYTE[2]) if len(ws) else h[:0]
    order = np.argsort(wkey)
    k = wkey[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    again = ws[order[same[:-1] | same[1:]]]
    rep = t.grouped_sum(t.covered(np.stack([again, again + WINDOW], 1), len(h)), bounds)
    return h, bounds, np.diff(bounds), chars, at(_SYMBOL[buf]), dup, rep


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Counts, base_failed, kept and the calibrated probability of each row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 << BITS floats
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for b in batches:
            for i, j, buf, offs in t.chunks(b.column(1)):
                h, bounds, *n = counts(buf, offs)
                failed = (n[0] < MIN_WORDS) | (100 * n[4] > MAX_REPEAT_PERCENT * n[0])
                p = shared.value.probability(buf, offs, h, bounds)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in n), pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)], [id_col, *names, "base_failed", "kept", "quality"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, {', '.join(x + ' long' for x in names)}, base_failed boolean, kept boolean, quality double")
