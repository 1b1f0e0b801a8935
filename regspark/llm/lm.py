r"""Language-model scores from log-bilinear models trained by noise contrast.

Symbols are the HOT most frequent words, one class for each of CLASSES hashed
word endings (all other words), and the end of a text. For each of the POSITIONS
places before a token there are vectors of context symbols and of symbols; the
score of a symbol is their product plus a bias. Pairs are counted at each
position over all training texts; with the counts, noise-contrastive estimation
against the unigram distribution is optimised in full expectation, so no pair
and no noise is sampled. One batched matrix product gives all logits of a
position, which are normalised over all symbols for every context; positions are
mixed by fixed weights.

The second step tells a class's words apart: words of the vocabulary (all of at
least FREQUENT of the tokens) and one symbol for the rest have vectors too,
trained the same way against the class of the token before, and are normalised
within their class. A word of the rest has the rest's probability times its own
add-one share of it. So the scores are probabilities of words, unseen ones
included, and all of them sum to one.

Word counts live in a table. Counts of the LEXICON most frequent words are
broadcast; the other words of a text meet theirs in a join. What the driver
gets is bounded: POSITIONS * SYMBOLS ** 2 pairs, LEXICON words and, for the
vocabulary, CLASSES + 1 contexts of each word.

Texts have words `[^\x20\x09-\x0D]+`, A-Z lower-cased, then one end. null is
empty: an end alone. Rows that share an id (or have none) are scored as texts
whose sums are added up. Ties in frequency go by the words' hashes. Very long
texts take memory in proportion to one text. An empty table gives an empty
result; with no training text all words are unseen. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as t
from .common import map_arrow, materialise

HOT, CLASSES, WIDTH = 768, 255, 32
#: Weights of the tokens before, the nearest first.
POSITIONS = (0.8, 0.12, 0.08)
LEXICON = 65_536
#: Share of the tokens from which on a word has its own vector.
FREQUENT = 5e-6
NOISE, STEPS, RATE = 10.0, 80, 0.05
#: Words whose vectors are trained at a time.
BLOCK = 1 << 14
#: Entries that a task gathers before it sends them.
GATHERED = 1 << 20

SYMBOLS = HOT + CLASSES + 1
_END = np.int64(0x1E0D)


def tokens(buf: np.ndarray, offs: np.ndarray):
    """Hash and class of each token, ends included, and the documents' bounds."""
    low = t.LOWER[buf]
    s, e, bounds = t.words(buf, offs)
    h = t.word_hashes(low, s, e).view(np.int64)
    last = low[e - 1].astype(np.int64) if len(e) else np.zeros(0, np.int64)
    two = np.where(e - s > 1, low[np.maximum(e - 2, 0)], 0).astype(np.int64) if len(e) else last
    c = (two * 256 + last) * 40503 % 65521 % CLASSES
    docs = len(bounds) - 1
    at = np.arange(len(h)) + t.owner(bounds)
    hashes, classes = np.full(len(h) + docs, _END), np.full(len(h) + docs, CLASSES)
    hashes[at], classes[at] = h, c
    return hashes, classes, bounds + np.arange(docs + 1)


def symbols(hashes: np.ndarray, classes: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """hot: sorted hashes of the hot words."""
    if not len(hot):
        return HOT + classes
    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1)
    return np.where(hot[at] == hashes, at, HOT + classes)


def before(ids: np.ndarray, bounds: np.ndarray, place: int, end: int) -> np.ndarray:
    """The symbol so many places before each; `end` before the first."""
    out = np.full_like(ids, end)
    out[place:] = ids[: len(ids) - place] if place else ids
    at = np.arange(len(ids)) - np.repeat(bounds[:-1], np.diff(bounds))
    out[at < place] = end
    return out


def find(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x among sorted different values; -1 for none."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def word_counts(docs: DataFrame) -> DataFrame:
    """docs: text. w (hash), class and c of each different token."""

    def sums(parts):
        w, k, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, at, back = np.unique(w, return_index=True, return_inverse=True)
        return u, k[at], np.bincount(back, weights=c).astype(np.int64)

    def run(batches):
        held, n = [], 0
        for b in batches:
            for _, _, buf, offs in t.chunks(b.column(0)):
                h, k, _ = tokens(buf, offs)
                held.append(sums([(h, k, np.ones(len(h)))]))
                n += len(held[-1][0])
                if n > GATHERED:
                    held = [sums(held)]
                    n = len(held[0][0])
                    if n > GATHERED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["w", "class", "c"])
                        held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums(held)], ["w", "class", "c"])

    return map_arrow(docs, run, "w long, class long, c long").groupBy("w").agg(F.max("class").alias("class"), F.sum("c").alias("c"))


def pair_counts(docs: DataFrame, hot: np.ndarray, vocab: np.ndarray) -> DataFrame:
    """docs: text. Counts n of pairs: (position, context, symbol) in one number, then (class before, word), words being vocab and then the classes' rests."""
    square, places, words = SYMBOLS * SYMBOLS, len(POSITIONS), len(vocab) + CLASSES

    def sums(parts):
        key, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, back = np.unique(key, return_inverse=True)
        return u, np.bincount(back, weights=n).astype(np.int64)

    def run(batches):
        n = np.zeros(places * square, np.int64)
        held, size = [], 0
        for b in batches:
            for _, _, buf, offs in t.chunks(b.column(0)):
                h, k, bounds = tokens(buf, offs)
                ids = symbols(h, k, hot)
                for d in range(places):
                    n[d * square : (d + 1) * square] += np.bincount(before(ids, bounds, d + 1, SYMBOLS - 1) * SYMBOLS + ids, minlength=square)
                classed = np.flatnonzero((ids >= HOT) & (ids < SYMBOLS - 1))
                w = find(vocab, h[classed])
                w = np.where(w < 0, len(vocab) + k[classed], w)
                held.append(sums([(before(k, bounds, 1, CLASSES)[classed] * words + w, np.ones(len(w)))]))
                size += len(held[-1][0])
                if size > GATHERED:
                    held = [sums(held)]
                    size = len(held[0][0])
                    if size > GATHERED // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0][0] + places * square), pa.array(held[0][1])], ["pair", "n"])
                        held, size = [], 0
        if held:
            key, c = sums(held)
            yield pa.RecordBatch.from_arrays([pa.array(key + places * square), pa.array(c)], ["pair", "n"])
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["pair", "n"])

    return map_arrow(docs, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def train_nce(n: np.ndarray) -> np.ndarray:
    """n: pair counts, contexts by symbols. Logits (natural) of symbols after contexts."""
    total = max(float(n.sum()), 1.0)
    own = n.sum(0, dtype=np.float64)
    q = ((own + 1) / (own.sum() + len(own))).astype(np.float32)
    seen = (NOISE * n.sum(1, dtype=np.float64) / total).astype(np.float32)
    rng = np.random.default_rng(7)
    u = rng.normal(0, 0.1, (n.shape[0], WIDTH)).astype(np.float32)
    v, b = rng.normal(0, 0.1, (n.shape[1], WIDTH)).astype(np.float32), np.log(q)
    x = [u, v, b]
    m, s2 = [np.zeros_like(a) for a in x], [np.zeros_like(a) for a in x]
    shift = np.log(NOISE * q)
    scale = np.float32(n.shape[0])  # keeps gradients near 1
    for step in range(1, STEPS + 1):
        d = [np.zeros_like(a) for a in x]
        for a in range(0, len(v), BLOCK):  # of the words at a time
            z = slice(a, a + BLOCK)
            g = u @ v[z].T
            g += b[z] - shift[z]
            np.clip(g, -40, 40, out=g)
            np.exp(-g, out=g)
            g += 1
            np.reciprocal(g, out=g)  # how likely a pair is no noise
            positive = n[:, z] * np.float32(1 / total)
            g *= positive + seen[:, None] * q[z]
            g -= positive
            d[0] += g @ v[z]
            d[1][z] = g.T @ u
            d[2][z] = g.sum(0)
        for k in range(3):
            grad = d[k] * scale
            if k < 2:
                grad += np.float32(1e-4) * x[k]
            m[k] += np.float32(0.1) * (grad - m[k])
            s2[k] += np.float32(0.01) * (grad * grad - s2[k])
            x[k] -= np.float32(RATE) * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(s2[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    out = u @ v.T
    out += b
    return out


def normalised(logits: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Natural logs of probabilities over each row, or over each group of columns of it."""
    group = np.zeros(logits.shape[1], np.int64) if group is None else group
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(group[order]) > 0))
    x = logits[:, order]
    most = np.maximum.reduceat(x, first, axis=1)
    which = np.cumsum(np.append(False, np.diff(group[order]) > 0))
    x -= most[:, which]
    x -= np.log(np.add.reduceat(np.exp(x), first, axis=1))[:, which]
    out = np.empty_like(x)
    out[:, order] = x
    return out


@dataclass
class Model:
    tables: np.ndarray  # probabilities of symbols after contexts, for each position
    inside: np.ndarray  # log10 probabilities of vocabulary and rests in their classes, after classes
    hot: np.ndarray
    vocab: np.ndarray
    lexicon: np.ndarray
    counts: np.ndarray
    rest_total: np.ndarray  # log10 of the tokens and words, and one, of each class's rest
    total: float  # log10 of tokens, words and one

    def logs(self, h: np.ndarray, k: np.ndarray, bounds: np.ndarray):
        """Per token: log10 probability but for the add-one count of words of the rest, and whether it is one."""
        ids = symbols(h, k, self.hot)
        p = np.zeros(len(ids), np.float64)
        for d, weight in enumerate(POSITIONS):
            p += weight * self.tables[d][before(ids, bounds, d + 1, SYMBOLS - 1), ids]
        s = np.log10(p)
        classed = np.flatnonzero((ids >= HOT) & (ids < SYMBOLS - 1))
        w = find(self.vocab, h[classed])
        rest = np.zeros(len(ids), bool)
        rest[classed[w < 0]] = True
        s[classed] += self.inside[before(k, bounds, 1, CLASSES)[classed], np.where(w < 0, len(self.vocab) + k[classed], w)]
        s[rest] -= self.rest_total[k[rest]]
        return s, rest


def fit(learn: DataFrame, counted: DataFrame, n_all: int, v_all: int) -> Model:
    """learn: text; counted: word_counts of it."""
    frequent = counted.orderBy(F.desc("c"), "w").limit(LEXICON).toPandas()
    by_class = {r[0]: (r[1], r[2]) for r in counted.groupBy("class").agg(F.sum("c"), F.count("*")).collect()}  # CLASSES + 1 rows
    words = frequent[frequent.w != _END]
    hot = words.head(HOT)
    vocab = words[HOT:]
    vocab = vocab[vocab.c >= max(2, FREQUENT * n_all)].sort_values("w")
    rest = np.array([by_class.get(k, (0, 0)) for k in range(CLASSES)], float)
    for known in (hot, vocab):
        np.subtract.at(rest, known["class"].to_numpy().astype(int), np.stack([known.c.to_numpy(), np.ones(len(known))], 1))
    lexicon = frequent.sort_values("w")
    hot_hashes, names = np.sort(hot.w.to_numpy().astype(np.int64)), vocab.w.to_numpy().astype(np.int64)

    square, wide = SYMBOLS * SYMBOLS, len(names) + CLASSES
    symbol_pairs = np.zeros(len(POSITIONS) * square, np.float32)
    word_pairs = np.zeros((CLASSES + 1) * wide, np.float32)
    pairs = materialise(pair_counts(learn, hot_hashes, names))
    for part in _batches(pairs):
        at, n = part.column(0).to_numpy(), part.column(1).to_numpy()
        low = at < len(symbol_pairs)
        symbol_pairs[at[low]] = n[low]
        word_pairs[at[~low] - len(symbol_pairs)] = n[~low]
    tables = np.stack([np.exp(normalised(train_nce(symbol_pairs[d * square : (d + 1) * square].reshape(SYMBOLS, SYMBOLS)))) for d in range(len(POSITIONS))])
    group = np.concatenate([vocab["class"].to_numpy().astype(int), np.arange(CLASSES)])
    inside = normalised(train_nce(word_pairs.reshape(CLASSES + 1, wide)), group) / np.float32(np.log(10))
    total = lambda x: np.log10(x.sum(1) + 1)
    return Model(tables, inside, hot_hashes, names, lexicon.w.to_numpy().astype(np.int64), lexicon.c.to_numpy().astype(np.int64), total(rest), float(np.log10(n_all + v_all + 1)))


def _batches(df: DataFrame):
    """The table's rows on the driver, some at a time."""
    for part in df.toArrow().to_batches(1 << 16):
        yield part


def score(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, n_known, train_tokens, base_score and score; train: which rows are learnt from."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(True)).alias("train"))
    learn = docs.where("train").select("text")
    counted = materialise(word_counts(learn))
    n_all, v_all = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    shared = docs.sparkSession.sparkContext.broadcast(fit(learn, counted, n_all, v_all))
    names = ["doc", "w", "times", "n_tokens", "n_known", "base", "score"]

    def run(batches):
        m = shared.value
        for b in batches:
            ids_ = b.column(0)
            for i, j, buf, offs in t.chunks(b.column(1)):
                h, k, bounds = tokens(buf, offs)
                place = find(m.lexicon, h)
                inside = place >= 0
                c = np.where(inside, m.counts[place], 0) if len(m.lexicon) else np.zeros(len(h), np.int64)
                log_c = np.log10(c + 1.0)
                s, rest = m.logs(h, k, bounds)
                s[rest] += log_c[rest]
                per = lambda x: t.grouped_sum(x, bounds)
                tokens_ = np.diff(bounds)
                # one row with what is known here; its hash only spreads it and its count is 0
                doc = np.arange(i, j)
                spread = t.mix(np.arange(i, j, dtype=t.U) + t.U(h[0] & 0xFFFF)).view(np.int64)
                zero = np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([ids_.slice(i, j - i), pa.array(spread), pa.array(zero.astype(np.int64)), pa.array(tokens_), pa.array(per(c > 0).astype(np.int64)), pa.array(per(log_c) - tokens_ * m.total), pa.array(per(s))], names)
                out = np.flatnonzero(~inside)
                if not len(out):
                    continue
                of = t.owner(bounds)[out]
                _, first, n = np.unique(t.mix(h[out].view(t.U) + of.astype(t.U) * t.BYTE[5]), return_index=True, return_counts=True)
                doc, z = ids_.take(pa.array(i + of[first])), np.zeros(len(first))
                yield pa.RecordBatch.from_arrays([doc, pa.array(h[out][first]), pa.array(n), *(pa.array(z.astype(np.int64)) for _ in "nk"), pa.array(z), pa.array(z)], names)

    rows = map_arrow(docs.select("doc", "text"), run, "doc long, w long, times long, n_tokens long, n_known long, base double, score double")
    rest = rows.join(counted.select("w", "c"), "w", "left")
    more = F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))
    known = F.col("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))
    out = rest.groupBy("doc").agg(F.sum("n_tokens").alias("n_tokens"), F.sum(known).alias("n_known"), F.sum(F.col("base") + more).alias("base_score"), F.sum(F.col("score") + more).alias("score"))
    return out.select(F.col("doc").alias(id_col), "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")
