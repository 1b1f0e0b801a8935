"""Benchmark decontamination with DataFrame functions only.

Words are the runs of letters and digits of a lower-cased text; a shingle is
five of them, weighted by how often it occurs in its window.

1. Windows of the item's size start at every word. Those that share enough
   shingles with an item, in whatever order, are proposed: a running sum over
   the places of the item's shingles has what each window shares, each shingle
   at most as often as the item has it, which is the numerator of the weighted
   Jaccard; this loses nothing.
2. Each window gets a 64-bit SimHash of its weighted shingles. With RADIUS + 1
   blocks of bits, two fingerprints within RADIUS agree in a whole block (the
   pigeonhole principle), so an equi-join on item size, block and its bits
   finds all of them. RADIUS is for shingles of equal weight; where a window or
   its item repeats some, few heavy ones decide the bits, so these are
   candidates without it.
3. Candidates are verified by their exact weighted Jaccard.

A text or item that is null or has under five words has no shingle and meets
nothing. A document shorter than an item is one window. Rows without an id are
left out; rows that share an id count as one document with all their windows.
Ties: of equally similar windows the first is reported. Very long texts take
rows in proportion to their words, not memory. Empty tables give an empty
result. Columns other than ids and texts are not read.

Of 64 bits, 9.7 differ on average at the limit, so a radius that loses nothing
needs many small blocks, which select little by themselves; what is selective is
step 1. The distance within RADIUS is then checked on whole fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of pairs at SIMILARITY differ in 9.7 of 64 bits, give or take 2.9; this is four times that above.
RADIUS = 21
#: Shingles of all items that are broadcast; more are shuffled.
BROADCAST = 1_000_000


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of the shingles of an array of words, in order."""
    last = F.size(w) - SHINGLE
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, F.lit(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))


def simhash(sh: Column) -> Column:
    """Bit k is set where most shingle hashes, repeats counted, have it. Two 32-bit counters share a long."""
    half = F.size(sh)
    shift = lambda x, k: F.call_function("shiftrightunsigned", x, k)
    sums = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.aggregate(sh, F.lit(0).cast("long"), lambda acc, h: acc + shift(h, k).bitwiseAND(F.lit((1 << 32) + 1))))
    bit = lambda x, k, j: F.when(2 * shift(x, F.lit(32 * j)).bitwiseAND(F.lit((1 << 32) - 1)) > half, F.call_function("shiftleft", F.lit(1).cast("long"), k + 32 * j)).otherwise(F.lit(0).cast("long"))
    bits = F.transform(sums, lambda x, k: bit(x, k, 0).bitwiseOR(bit(x, k, 1)))
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def blocks(fp: Column) -> Column:
    """The RADIUS + 1 blocks of a fingerprint, as (number, bits)."""
    n = RADIUS + 1
    ends = [64 * i // n for i in range(n + 1)]
    return F.array(*(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (z - a)) - 1).cast("long")).alias("bits")) for i, (a, z) in enumerate(zip(ends, ends[1:]))))


def plain(sh: Column) -> Column:
    """No shingle is repeated."""
    return F.size(F.array_distinct(sh)) == F.size(sh)


def shared_weight(a: Column, b: Column) -> Column:
    """Sum over values of the lesser of their counts in a and b: one pass over both, sorted together."""
    sided = F.array_sort(F.concat(F.transform(a, lambda x: F.struct(x.alias("x"), F.lit(1).alias("p"), F.lit(0).alias("q"))), F.transform(b, lambda x: F.struct(x.alias("x"), F.lit(0).alias("p"), F.lit(1).alias("q")))))
    state = lambda x, p, q, both: F.struct(x.alias("x"), p.alias("p"), q.alias("q"), both.alias("both"))
    closed = lambda s: s.both + F.least(s.p, s.q)

    def step(s, v):
        same = s.x.eqNullSafe(v.x)
        return state(v.x, F.when(same, s.p).otherwise(F.lit(0)) + v.p, F.when(same, s.q).otherwise(F.lit(0)) + v.q, F.when(same, s.both).otherwise(closed(s)))

    return F.aggregate(sided, state(F.lit(None).cast("long"), F.lit(0), F.lit(0), F.lit(0)), step, closed)


def weighted_jaccard(a: Column, b: Column) -> Column:
    both = F.when(plain(a) & plain(b), F.size(F.array_intersect(a, b))).otherwise(shared_weight(a, b))
    return both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1))


def windows_in_reach(met: DataFrame, similarity: float) -> DataFrame:
    """doc, row, item, irow, length and start of the windows that share enough shingles, repeats counted, to be `similarity` alike.

    met: doc, row, its n words, item, irow, length, shingle sh with its `times` in the item and its place p in the document.
    A place counts in the windows that hold it and in which it is among the first `times` of its shingle. These
    starts are one interval, so a running sum over their ends has what every window shares, at any stride.
    """
    pair = ["doc", "row", "n", "item", "irow", "length"]
    width = F.least("n", "length") - (SHINGLE - 1)
    enough = similarity * (width + F.col("length") - (SHINGLE - 1)) / (1 + similarity) - 1e-9
    same = met.groupBy(*pair, "sh", "times").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    near = same.groupBy(*pair).agg(F.collect_list(F.struct("times", "ps")).alias("each"), F.sum(F.least(F.size("ps"), "times")).alias("most"))
    near = near.where(F.col("most") >= enough).select(*pair, F.inline("each"))  # no window shares more than its document
    first = lambda p, i: F.greatest(F.lit(0), p - width + 1, F.get("ps", i - F.col("times")) + 1)
    ends = F.transform("ps", lambda p, i: F.struct(first(p, i).alias("a"), (F.least(p, F.greatest(F.lit(0), F.col("n") - F.col("length"))) + 1).alias("z")))
    ends = near.select(*pair, F.inline(ends)).where("a < z").select(*pair, F.inline(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct(F.col("z").alias("at"), F.lit(-1).alias("d")))))
    w = Window.partitionBy(*pair).orderBy("at")
    runs = ends.groupBy(*pair, "at").agg(F.sum("d").alias("d")).select(*pair, "at", F.sum("d").over(w).alias("shared"), F.lead("at").over(w).alias("end"))
    return runs.where((F.col("shared") > 0) & (F.col("shared") >= enough)).select("doc", "row", "item", "irow", "length", F.explode(F.sequence("at", F.col("end") - 1)).alias("start"))


def find(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", doc_text: str = "text", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and item that meet: ids, similarity, start (word) and n_words of the best window."""
    d = docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("text")).where(F.col("doc").isNotNull())
    d = d.select("doc", F.xxhash64("text").alias("row"), words(F.col("text")).alias("w"))
    it = items.select(F.col(item_id).alias("item"), words(F.col(item_text)).alias("iw")).where(F.col("item").isNotNull() & (F.size("iw") >= SHINGLE))
    it = it.select("item", F.size("iw").alias("length"), shingles(F.col("iw")).alias("ish")).distinct()
    it = materialise(it.withColumns({"irow": F.xxhash64("ish"), "iplain": plain(F.col("ish")), "fp": simhash(F.col("ish"))}))
    size = it.agg(F.sum(F.size("ish"))).first()[0] or 0
    known = it.select("item", "irow", "length", F.explode("ish").alias("sh"))
    known = known.groupBy("item", "irow", "length", "sh").agg(F.count("*").cast("int").alias("times"))
    known = F.broadcast(known) if size <= BROADCAST else known

    at = d.where(F.size("w") >= SHINGLE).select("doc", "row", "w", F.explode(F.sequence(F.lit(0), F.size("w") - SHINGLE)).alias("p"))
    at = at.select("doc", "row", F.size("w").alias("n"), "p", F.xxhash64(F.array(*(F.col("w")[F.col("p") + k] for k in range(SHINGLE)))).alias("sh"))
    asked = materialise(windows_in_reach(at.join(known, "sh"), similarity))

    spans = asked.select("doc", "row", "length", "start").distinct().groupBy("doc", "row").agg(F.collect_list(F.struct("length", "start")).alias("asked"))
    some = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(doc_text).alias("row"), F.col(doc_text).alias("text")).join(spans, ["doc", "row"])
    some = some.select("doc", "row", words(F.col("text")).alias("w"), "asked").select("doc", "row", "w", F.explode("asked").alias("q"))
    window = some.select("doc", "row", F.col("q.length").alias("length"), F.col("q.start").alias("start"), shingles(F.slice("w", F.col("q.start") + 1, F.col("q.length"))).alias("sh"))
    window = materialise(window.where(F.size("sh") > 0).withColumns({"plain": plain(F.col("sh")), "fp": simhash(F.col("sh"))}))

    place, which = ["doc", "row", "length", "start"], ["item", "irow"]
    one = window.select(*place, "fp", F.explode(blocks(F.col("fp"))).alias("b")).select(*place, "fp", "b.block", "b.bits")
    two = it.select(*which, "length", F.col("fp").alias("ifp"), F.explode(blocks(F.col("fp"))).alias("b")).select(*which, "length", "ifp", "b.block", "b.bits")
    two = F.broadcast(two) if size <= BROADCAST else two
    known_item = lambda *c: F.broadcast(it.select(*which, *c)) if size <= BROADCAST else it.select(*which, *c)
    near = one.join(two, ["length", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= RADIUS).select(*place, *which)
    heavy = asked.join(window.select(*place, "plain"), place).join(known_item("iplain"), which).where(~(F.col("plain") & F.col("iplain"))).select(*place, *which)
    pairs = near.unionByName(heavy).distinct().join(window.drop("fp", "plain"), place).join(known_item("ish"), which)
    pairs = pairs.select("doc", "item", "start", "length", weighted_jaccard(F.col("sh"), F.col("ish")).alias("similarity")).where(F.col("similarity") >= similarity)
    best = pairs.groupBy("doc", "item").agg(F.max(F.struct("similarity", -F.col("start"), "length")).alias("b"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), F.col("b.similarity").alias("similarity"), (-F.col("b.col2")).alias("start"), F.col("b.length").alias("n_words"))
