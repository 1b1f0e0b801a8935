"""Near-duplicates by b-bit MinHash: exact links among banded candidates.

A document's set has the distinct runs of `SHINGLE` words (A-Z lower-cased);
with fewer words, the whole sequence as one. Texts without words have an empty
set and link with nothing.

1. Rows with equal sets form a class, a node of the graph.
2. Each class gets BANDS * ROWS minima and one hash for each band of ROWS; those
   that share a band's hash are a bucket, and candidates for each other.
3. Every member of a bucket is compared with the bucket's smallest one, its hub:
   packed low bits of the minima, counted equal and corrected for chance, screen
   out what is SLACK standard deviations below the limit, full sets confirm the
   rest. Links so far are joined into components, so most copies are settled by
   one comparison for each different hub.
4. Pairs without the hub are only open in buckets whose members are of several
   components; buckets with the same members are taken once. Each is searched
   whole, comparing only what is not joined yet. A bucket of over ROOM is cut
   into cells by set size (sets whose sizes differ by more than the limit can't
   link) and by hash; each two cells that can have links are a task of their
   own, so no task holds more than two cells, whatever the bucket's size.
5. Components of confirmed links, carried back to all rows of a class.

Rows without an id are left out. Rows that share an id are one row each in the
result, and links of either text count. Ties: a component's smallest id names
it. Very long texts take memory in proportion to one text. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as t
from .common import map_arrow, materialise
from .graph import components
from .superkmer import packed_rows, signed, unpacked, with_row

SHINGLE = 5
BANDS, ROWS = 32, 6
#: Low bits of each minimum that are kept.
LOW = 4
SLACK = 6.0
#: Shingles of a cell, and what a document counts besides its own.
ROOM, EACH = 1 << 20, 300
#: Bytes of text that are signed together; there are BANDS * ROWS products of each shingle at a time.
SIGNED = 1 << 18
#: Sets of hubs that a task keeps, in shingles.
KEPT = 1 << 20

_N = BANDS * ROWS
_MULTIPLIERS = t.mix(np.arange(1, _N // 2 + 1, dtype=t.U) * t.U(0xD1342543DE82EF95)) | t.U(1)


def shingles(buf: np.ndarray, offs: np.ndarray, k: int = SHINGLE):
    """A hash for each shingle, repeated ones too, and the documents' bounds among them."""
    s, e, bounds = t.words(buf, offs)
    h = t.word_hashes(t.LOWER[buf], s, e)
    c = np.diff(bounds)
    short = bounds[:-1][(c > 0) & (c < k)]
    start = np.sort(np.concatenate([t.window_starts(bounds, k), short]))
    end = np.minimum(start + k, bounds[np.searchsorted(bounds, start, "right")])
    return t.run_hashes(h, start, end), np.searchsorted(start, bounds)


def sets(h: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def signatures(h: np.ndarray, bounds: np.ndarray):
    """n_shingles, a 128-bit digest of the set, band hashes and packed low bits of each document."""
    full = np.flatnonzero(np.diff(bounds))
    n, d = np.zeros(len(bounds) - 1, np.int64), np.zeros((2, len(bounds) - 1), t.U)
    bands, packed = np.zeros((len(full), BANDS), t.U), np.zeros((len(full), _N // 2), np.uint8)
    if not len(full):
        return n, d, full, bands, packed
    at = bounds[full]
    minima = np.empty((_N, len(full)), np.uint32)
    for i, a in enumerate(_MULTIPLIERS):  # both halves of a product serve
        x = h * a
        minima[2 * i] = np.minimum.reduceat((x >> t.U(32)).astype(np.uint32), at)
        minima[2 * i + 1] = np.minimum.reduceat(x.astype(np.uint32), at)
    of = t.owner(bounds)
    first = np.sort(np.unique(t.mix(h + of.astype(t.U) * t.BYTE[3]), return_index=True)[1])
    n[:] = np.bincount(of[first], minlength=len(n))
    cut = np.searchsorted(first, at)
    for k in (0, 1):
        d[k, full] = t.mix(np.add.reduceat(t.mix(h[first] + t.BYTE[k + 4]), cut))
    m = minima.astype(t.U).reshape(BANDS, ROWS, len(full))
    for r in range(ROWS):
        bands += m[:, r].T * t.BYTE[10 + r]
    bands = t.mix(bands + np.arange(BANDS, dtype=t.U) * t.BYTE[20])
    low = (minima.T & ((1 << LOW) - 1)).astype(np.uint8)
    packed = low[:, ::2] << 4 | low[:, 1::2]
    return n, d, full, bands, packed


def estimate(packed: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Estimated similarity of each row of 64-bit words to one, corrected for chance agreement."""
    x = packed ^ one
    x = x | x >> t.U(1)
    x = (x | x >> t.U(2)) & t.U(0x1111111111111111)
    same = 1 - np.bitwise_count(x).sum(1) / _N
    return (same - 2.0**-LOW) / (1 - 2.0**-LOW)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def search(packed: np.ndarray, full: list[np.ndarray], labels: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join what can be joined; labels: already joined. Only pairs of different sides are compared, unless there is one side."""
    size = np.array([len(x) for x in full])
    least = least_estimate(percent)
    label, links = labels.copy(), []
    one = bool((side == side[0]).all())
    for u in range(len(full)):
        if not one and side[u]:
            continue
        rest = (label != label[u]) & (100 * np.minimum(size, size[u]) >= percent * np.maximum(size, size[u]))
        if one:
            rest[:u] = False
        else:
            rest &= side != side[u]
        at = np.flatnonzero(rest)
        if not len(at):
            continue
        at = at[estimate(packed[at], packed[u]) >= least]
        for v in at.tolist():
            if label[v] != label[u] and alike(full[u], full[v], percent):
                links.append((u, v))
                label[label == label[v]] = label[u]
    return links


def least_estimate(percent: int) -> float:
    p = percent / 100
    return p - SLACK * math.sqrt(p * (1 - p) / _N) / (1 - 2.0**-LOW)


def _sets_of(col: pa.Array) -> list[np.ndarray]:
    full: list[np.ndarray] = []
    for _, texts in unpacked(col):
        for _, _, buf, offs in t.chunks(texts):
            full += sets(*shingles(buf, offs))
    return full


def _words(col: pa.Array) -> np.ndarray:
    """Packed low bits as rows of 64-bit words."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), -1).view(t.U)


def _sign(batches):
    for b in batches:
        for i, j, buf, offs in t.chunks(b.column(2), SIGNED):
            n, dig, full, bands, packed = signatures(*shingles(buf, offs))
            has = np.zeros(j - i, np.int64)
            has[full] = 1
            ends = np.concatenate([[0], np.cumsum(has)])
            lists = pa.ListArray.from_arrays(pa.array((ends * BANDS).astype(np.int32)), signed(bands.ravel()))
            low = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((ends * (_N // 2)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(packed))])
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n), *(signed(x) for x in dig), lists, low], ["doc", "row", "n", "d1", "d2", "bands", "packed"])


def _screen(percent: int):
    least = least_estimate(percent)

    def run(batches):
        for b in batches:
            if b.num_rows:
                one, two = (_words(b.column(c)) for c in (2, 3))
                yield b.select([0, 1]).filter(pa.array(estimate(one, two) >= least))

    return run


def _confirm(percent: int):
    def run(batches):
        kept, size = {}, 0
        for b in batches:
            ids = b.column(1).to_pylist()
            good = []
            for first, texts in unpacked(b.column(2)):
                for i, _, buf, offs in t.chunks(texts):
                    for k, own in enumerate(sets(*shingles(buf, offs))):
                        at = first + i + k
                        if ids[at] not in kept:
                            if size > KEPT:
                                kept, size = {}, 0
                            kept[ids[at]] = _sets_of(b.column(3).slice(at, 1))[0]
                            size += len(kept[ids[at]])
                        good.append(alike(own, kept[ids[at]], percent))
            if good:
                yield b.select([0, 1]).filter(pa.array(good))

    return run


def _searcher(percent: int):
    key_names = ["band", "task"]

    def flush(rows: pa.Table):
        rows = rows.combine_chunks()
        full = _sets_of(rows["z"].combine_chunks())
        label, side, node = (rows[c].to_numpy() for c in ("label", "side", "node"))
        got = np.array(search(_words(rows["packed"].combine_chunks()), full, label, side, percent), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(node[got[:, 0]]), pa.array(node[got[:, 1]])], ["a", "b"])

    def run(batches):
        held = None
        for b in batches:  # sorted by band and task
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if not rows.num_rows:
                continue
            keys = np.stack([rows[c].to_numpy() for c in key_names])
            cuts = np.concatenate([[0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1])
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                yield flush(rows.slice(x, y - x))
            held = rows.slice(int(cuts[-1]))
        if held is not None and held.num_rows:
            yield flush(held)

    return run


def _hub_links(band: DataFrame, sig: DataFrame, texts, percent: int):
    """hubs (band, hub, size) of buckets with several members, and links of members with their hubs."""
    hubs = materialise(band.groupBy("band").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1"))
    ties = band.join(hubs, "band").select(F.col("node").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct()
    s = lambda x: sig.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("packed").alias(f"p{x}"))
    near = ties.join(s("a"), "a").join(s("b"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    near = materialise(map_arrow(near.select("a", "b", "pa", "pb"), _screen(percent), "a long, b long"))
    z = lambda x: texts.select(F.col("node").alias(x), F.col("z").alias(f"z{x}"))
    pairs = near.join(z("a"), "a").join(z("b"), "b").select("a", "b", "za", "zb")
    return hubs, materialise(map_arrow(pairs, _confirm(percent), "a long, b long"))


def _open_buckets(band: DataFrame, hubs: DataFrame, sig: DataFrame, label: DataFrame) -> DataFrame:
    """band, node, n, label and room (the bucket's) of members besides the hub, where they are of several components."""
    rows = band.join(hubs.where("size > 2"), "band").where("node <> hub").select("band", "node").join(sig.select("node", "n"), "node")
    rows = rows.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    digest = F.sum(F.pmod(F.xxhash64("node"), F.lit(1 << 40)))
    kinds = rows.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"), digest.alias("digest"), F.sum(F.col("n") + EACH).alias("room")).where("lo <> hi")
    once = kinds.groupBy("digest", "members").agg(F.min("band").alias("band"), F.max("room").alias("room")).select("band", "room")
    return rows.join(once, "band")


def _cells(rows: DataFrame, percent: int) -> DataFrame:
    """One row for each task a member of a large bucket has a part in: task (a hash) and side."""
    rows = rows.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int"))
    cell = materialise(rows.groupBy("band", "c").agg(F.ceil(F.sum(F.col("n") + EACH) / ROOM).cast("int").alias("parts")))
    near = rows.select("band", "c").distinct().withColumn("c2", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)))
    near = near.join(cell.select("band", F.col("c").alias("c2"), F.col("parts").alias("parts2")), ["band", "c2"])
    own = rows.join(cell, ["band", "c"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sent = own.join(near, ["band", "c"]).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts2") - 1)))
    mine, other = F.struct("c", "i"), F.struct(F.col("c2").alias("c"), F.col("j").alias("i"))
    sent = sent.withColumns({"lo": F.least(mine, other), "hi": F.greatest(mine, other)})
    return sent.select("band", F.xxhash64("lo", "hi").alias("task"), "node", "label", F.when(mine == F.col("lo"), 0).otherwise(1).alias("side"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id and kept of each row with an id; links have at least `percent` of the union in common."""
    d = with_row(docs, id_col, text_col)
    rows = materialise(map_arrow(d, _sign, "doc long, row long, n long, d1 long, d2 long, bands array<long>, packed binary"))
    # a node is the 64-bit digest of a class; classes are by 128 bits
    nodes = rows.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("doc", "row")).alias("w"))
    nodes = materialise(nodes.select(F.col("d1").alias("node"), "d2", F.col("w.doc").alias("doc"), F.col("w.row").alias("row")))
    sig = rows.join(nodes, ["doc", "row"]).where("d1 = node").dropDuplicates(["node"]).select("node", "n", "bands", "packed")
    sig = materialise(sig)
    band = sig.select("node", F.explode("bands").alias("band"))
    tied = band.groupBy("band").agg(F.count("*").alias("size")).where("size > 1").select("band")
    band = materialise(band.join(tied, "band", "left_semi"))
    some = nodes.join(band.select("node").distinct(), "node").select("doc", "row", "node")
    texts = materialise(packed_rows(d, "text", ["doc", "row"]).join(some, ["doc", "row"]).dropDuplicates(["node"]).select("node", "z"))

    hubs, links = _hub_links(band, sig, texts, percent)
    comp = components(links)
    left = materialise(_open_buckets(band, hubs, sig, comp.select("node", F.col("component").alias("label"))))
    if not left.isEmpty():
        few = left.where(F.col("room") <= ROOM).select("band", F.lit(0).cast("long").alias("task"), "node", "label", F.lit(0).alias("side"))
        parts = few.unionByName(_cells(left.where(F.col("room") > ROOM), percent))
        parts = parts.join(sig.select("node", "packed"), "node").join(texts, "node").select("band", "task", "node", "label", "side", "packed", "z")
        dealt = parts.repartition("band", "task").sortWithinPartitions("band", "task", "node")
        more = materialise(map_arrow(dealt, _searcher(percent), "a long, b long"))
        if not more.isEmpty():
            comp = components(links.unionByName(more))

    least = nodes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc")
    name = least.groupBy("component").agg(F.min("doc").alias("name"))
    named = least.groupBy("node", "component").agg(F.min("doc").alias("doc")).join(name, "component").select(F.col("node").alias("d1"), "name")
    named = materialise(named)  # so what follows, which has the caller's rows, is planned without the joins before
    out = rows.select("doc", "n", F.when(F.col("n") > 0, F.col("d1")).alias("d1")).join(named, "d1", "left")
    out = out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("name", "doc").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
