"""Repeated windows of words or bytes by super-k-mers.

Of each k symbols in a row, the minimiser is the m symbols in a row with the
least hash. Windows next to each other mostly have the same minimiser; such a
run is a super-k-mer, one string of its windows. Equal windows have equal
minimisers, so what repeats is found within one minimiser's strings:

1. Each super-k-mer sends its minimiser, a digest of its content and its place.
   Sums per (minimiser, content), combined before the shuffle, leave the
   minimisers seen more than once; most text ends here.
2. A content met again is repeated as a whole. Where a minimiser has different
   contents, one packed string of each travels to the minimiser's bucket.
3. There the windows of the bucket's strings are sorted and counted exactly.
4. Repeated windows go back, by content, to the documents that hold them.

A hot minimiser costs one row per map task in step 1 and one string per
different content in step 2. Where there are over HOT of these, its strings are
cut into super-k-mers of a longer minimiser, which are summed up and dealt the
same way, and so on by `Symbols.levels`. The last level's minimiser is the
window itself, whose bucket has one content: its sums are the verdict. So no
task gets all strings of a hot minimiser.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as t
from .common import map_arrow, materialise

#: Strings of one minimiser beyond which they are cut once more.
HOT = 250
#: Bytes of strings that are sorted together.
SORTED = 1 << 20
#: Rows that are sent on together.
SENT = 1 << 15


@dataclass(frozen=True)
class Symbols:
    """How texts become symbols: words, or bytes; levels: lengths of minimisers, each for what the one before leaves hot."""

    kind: str  # "word" or "byte"
    k: int
    levels: tuple[int, ...]

    @property
    def chunk(self) -> int:
        """Bytes of text at a time, so that arrays of eight bytes for each symbol stay in a core's cache."""
        return t.CHUNK if self.kind == "word" else t.CHUNK >> 3

    def cut(self, buf, offs):
        """Start and end bytes of the symbols (none for bytes) and the documents' bounds among them."""
        return (None, None, offs) if self.kind == "byte" else t.words(buf, offs)

    def hashes(self, buf, s, e, m: int, seed: int = 0):
        """Hashes of every k symbols in a row, and of every m."""
        if self.kind == "byte":
            if len(buf) < self.k:
                return np.zeros(0, t.U), np.zeros(0, t.U)
            x, size = t.mix(t.lanes(buf)[: len(buf) - 7] + t.U(seed) * t.BYTE[7]), 8
        else:
            if len(s) < self.k:
                return np.zeros(0, t.U), np.zeros(0, t.U)
            x, size = t.word_hashes(buf, s, e, seed), 1
        wins, grams = t.in_a_row(x, self.k, size, m)
        return wins, grams if grams is not None else t.in_a_row(x, m, size)[0]


def super_kmers(k: int, m: int, wins: np.ndarray, grams: np.ndarray, bounds: np.ndarray):
    """doc, start (symbol within the chunk), n windows, minimiser hash and content digest of each super-k-mer."""
    ok = t.window_starts(bounds, k)
    if not len(ok):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(t.U), z.astype(t.U)
    # the place in the low bits picks the leftmost of equal minimisers, so equal windows never share a super-k-mer
    bits = t.U(max(24, len(grams).bit_length()))
    least = t.sliding_min((grams >> bits << bits) | np.arange(len(grams), dtype=t.U), k - m + 1)[ok]
    place = least & ((t.U(1) << bits) - t.U(1))
    new = np.ones(len(ok), bool)
    new[1:] = (place[1:] != place[:-1]) | (ok[1:] != ok[:-1] + 1)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(ok)))
    start = ok[first]
    doc = np.searchsorted(bounds, start, "right") - 1
    # the first and the last window hold all symbols, as there are at most k windows
    body = t.mix(t.mix(wins[start] + n.astype(t.U)) * t.BYTE[9] + wins[start + n - 1])
    return doc, start, n, grams[place[first].astype(np.int64)], body


def packed_rows(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, and z, the text compressed for a shuffle (null for null)."""

    def run(batches):
        import zstandard

        c = zstandard.ZstdCompressor(level=3)
        for b in batches:
            z = [None if x is None else c.compress(x) for x in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(z, pa.binary())], [*keep, "z"])

    rows = docs.select(*keep, F.col(text_col).cast("binary").alias("z"))
    return map_arrow(rows, run, rows.schema)


def unpacked(col: pa.Array, limit: int = 1 << 22):
    """(first row, texts) for runs of packed texts; null is empty."""
    import zstandard

    z, i, held, size = zstandard.ZstdDecompressor(), 0, [], 0
    for k, x in enumerate(col):
        held.append(b"" if not x.is_valid else z.decompress(x.as_buffer()))
        size += len(held[-1])
        if size > limit:
            yield i, pa.array(held, pa.large_binary())
            i, held, size = k + 1, [], 0
    if held:
        yield i, pa.array(held, pa.large_binary())


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of binaries and their bounds, without a copy."""
    col = col.cast(pa.large_binary())
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def binaries(raw: bytes, start: np.ndarray, end: np.ndarray) -> pa.Array:
    return pa.array([raw[x:y] for x, y in zip(start.tolist(), end.tolist(), strict=True)], pa.binary())


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _places(docs: DataFrame, sym: Symbols) -> DataFrame:
    m = sym.levels[0]

    def parts(batches):
        for b in batches:
            ids, rows = (b.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, _, buf, offs in t.chunks(b.column(2), sym.chunk):
                s, e, bounds = sym.cut(buf, offs)
                doc, start, n, mini, body = super_kmers(sym.k, m, *sym.hashes(buf, s, e, m), bounds)
                yield ids[i + doc], rows[i + doc], start - bounds[doc], n.astype(np.int32), mini.view(np.int64), body.view(np.int64)

    def run(batches):
        held = []
        for x in parts(batches):
            held.append(x)
            if sum(len(h[0]) for h in held) >= SENT:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["doc", "row", "at", "n", "mini", "body"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], ["doc", "row", "at", "n", "mini", "body"])

    return map_arrow(docs.select("doc", "row", "text"), run, "doc long, row long, at long, n int, mini long, body long")


def _strings(wanted: DataFrame, sym: Symbols) -> DataFrame:
    """wanted: doc, z and asked, an array of (at, n, mini, body, many, hot). One packed string of symbols for each."""
    names = ["mini", "body", "many", "hot", "n", "doc", "packed"]

    def run(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for first, texts in unpacked(b.column(1)):
                for i, j, buf, offs in t.chunks(texts, sym.chunk):
                    i, j = first + i, first + j
                    s, e, bounds = sym.cut(buf, offs)
                    asked = b.column(2).slice(i, j - i)
                    all_of = asked.flatten()
                    f = {x: all_of.field(k).to_numpy(zero_copy_only=False) for k, x in enumerate(("at", "n", "mini", "body", "many", "hot"))}
                    of = np.repeat(np.arange(j - i), asked.value_lengths().to_numpy())
                    a = bounds[of] + f["at"]
                    z = a + f["n"] + sym.k - 1
                    a, z = (a, z) if s is None else (s[a], e[z - 1])
                    yield pa.RecordBatch.from_arrays([*(pa.array(f[x]) for x in names[:5]), pa.array(ids[i + of]), binaries(buf.tobytes(), a, z)], names)

    return map_arrow(wanted.select("doc", "z", "asked"), run, "mini long, body long, many boolean, hot boolean, n int, doc long, packed binary")


def _spans(of: np.ndarray, off: np.ndarray):
    """Runs of offsets per string: the strings, and where each run starts and ends."""
    order = np.lexsort((off, of))
    of, off = of[order], off[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (off[1:] != off[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(of))[: len(first)] - 1  # none for none
    return of[first], off[first], off[last] + 1


def _sorted_words(sym: Symbols, buf: np.ndarray, offs: np.ndarray, n: np.ndarray):
    """Windows in the order of their 128-bit keys: their strings, offsets, and where another one begins."""
    s, e, bounds = sym.cut(buf, offs)
    of = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    one, two = (sym.hashes(buf, s, e, sym.levels[0], seed)[0][bounds[of] + off] for seed in (0, 1))
    order = np.lexsort((two, one))
    o, w = one[order], two[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (w[1:] != w[:-1])
    return of[order], off[order], new


def _sorted_bytes(sym: Symbols, buf: np.ndarray, offs: np.ndarray, n: np.ndarray):
    """Windows in the order of the suffixes that start with them; another one begins where the common prefix is short."""
    from .induced import suffixes

    of, off, new = [], [], []
    short = False  # a common prefix under k was met since the last window
    for at, common in suffixes(buf, offs):
        string = np.searchsorted(offs, at, "right") - 1
        inside = at + sym.k <= offs[string + 1]
        # the least common prefix since the window before; suffixes between equal windows are windows too
        breaks = np.cumsum(common < sym.k)
        b = breaks[inside]
        of.append(string[inside])
        off.append((at - offs[string])[inside])
        new.append(np.diff(b, prepend=0) > 0)
        if short and len(b):
            new[-1][0] = True
        short = (short and not len(b)) or (breaks[-1] > b[-1] if len(b) else bool(breaks[-1]))
    return tuple(np.concatenate(x) for x in (of, off, new))


def _judge_sorted(sym: Symbols, rule: str):
    """Sorts the windows of whole minimisers and finds the repeated ones."""
    names = ["mini", "body", "a", "z"]
    windows = _sorted_bytes if sym.kind == "byte" else _sorted_words

    def flush(rows: pa.Table):
        rows = rows.combine_chunks()
        of, off, new = windows(sym, *flat(rows["packed"].combine_chunks()), rows["n"].to_numpy())
        if not len(of):
            return
        new[0] = True
        group = np.cumsum(new) - 1
        if rule == "earlier":  # a smaller document has the window
            d = rows["doc"].to_numpy()[of]
            hit = np.minimum.reduceat(d, np.flatnonzero(new))[group] < d
        else:  # it starts more than once
            hit = (np.bincount(group)[group] > 1) | rows["many"].to_numpy(zero_copy_only=False)[of]
        s, a, z = _spans(of[hit], off[hit])
        yield pa.RecordBatch.from_arrays([pa.array(rows["mini"].to_numpy()[s]), pa.array(rows["body"].to_numpy()[s]), pa.array(a.astype(np.int32)), pa.array(z.astype(np.int32))], names)

    def run(batches):
        held, size = [], 0
        for b in batches:  # sorted by mini
            held.append(pa.Table.from_batches([b]))
            size += b.nbytes
            if size < SORTED:
                continue
            rows = pa.concat_tables(held)
            mini = rows["mini"].to_numpy()
            cut = int(np.searchsorted(mini, mini[-1]))  # the last minimiser may go on
            if cut:
                yield from flush(rows.slice(0, cut))
            held = [rows.slice(cut)]
            size = held[0].nbytes
        if held and (rows := pa.concat_tables(held)).num_rows:
            yield from flush(rows)

    return run


def _pieces(sym: Symbols, level: int):
    """Cuts strings into super-k-mers of the level's minimiser: key and part are theirs, base is where they start."""
    names = ["mini", "body", "doc", "many", "base", "n", "key", "part", "packed"]
    m = sym.levels[level]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            buf, offs = flat(b.column("packed"))
            s, e, bounds = sym.cut(buf, offs)
            of, start, n, key, part = super_kmers(sym.k, m, *sym.hashes(buf, s, e, m), bounds)
            z = start + n + sym.k - 1
            if m == sym.k:  # a window is its own bucket; its second hash tells it apart
                part = sym.hashes(buf, s, e, m, 1)[0][start]
                packed = pa.nulls(len(of), pa.binary())
            else:
                packed = binaries(buf.tobytes(), *((start, z) if s is None else (s[start], e[z - 1])))
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in names[:4]), pa.array((start - bounds[of]).astype(np.int32)), pa.array(n.astype(np.int32)), signed(key), signed(part), packed], names)

    return run


def _judge_hot(strings: DataFrame, sym: Symbols, rule: str, level: int = 1) -> DataFrame:
    """Verdicts (mini, body, a, z) over strings of hot minimisers, by way of their pieces."""
    pieces = materialise(map_arrow(strings.select("mini", "body", "doc", "many", "n", "packed"), _pieces(sym, level), "mini long, body long, doc long, many boolean, base int, n int, key long, part long, packed binary"))
    one = pieces.groupBy("key", "part").agg(F.min("doc").alias("least"), F.count("*").alias("times"), F.bool_or("many").alias("any"), F.max("n").alias("n"), F.max("packed").alias("packed"))
    one = materialise(one)
    # tables of their own, else a join keeps a common key's rows in one task; what is alone in its bucket ends here
    keys = materialise(one.groupBy("key").agg(F.count("*").alias("contents"), F.sum("times").alias("total")).where("total > 1").select("key", "contents"))
    one = one.join(keys, "key")
    many = F.col("any") | (F.col("times") > 1)
    whole = F.col("doc") > F.col("least") if rule == "earlier" else many
    known = materialise(pieces.drop("packed").join(one.select("key", "part", "least", "times", "any", "contents"), ["key", "part"]).withColumn("whole", whole).where("whole or contents > 1"))
    all_of = known.where("whole").select("mini", "body", F.col("base").alias("a"), (F.col("base") + F.col("n")).alias("z"))
    if sym.levels[level] == sym.k:
        return all_of
    asked = one.where("contents > 1").select(F.col("key").alias("mini"), F.col("part").alias("body"), many.alias("many"), (F.col("contents") > HOT).alias("hot"), "n", F.col("least").alias("doc"), "packed")
    found = _judge(asked, sym, rule, level).select(F.col("mini").alias("key"), F.col("body").alias("part"), "a", "z")
    some = known.where("not whole").join(found, ["key", "part"]).select("mini", "body", (F.col("base") + F.col("a")).alias("a"), (F.col("base") + F.col("z")).alias("z"))
    return all_of.unionByName(some)


def _judge(strings: DataFrame, sym: Symbols, rule: str, level: int = 0) -> DataFrame:
    """strings: mini, body, doc, many, hot, n and packed. Verdicts (mini, body, a, z)."""
    cold, hot = strings.where("not hot"), strings.where("hot")
    dealt = cold.select("mini", "body", "doc", "many", "n", "packed").repartition("mini").sortWithinPartitions("mini")
    found = map_arrow(dealt, _judge_sorted(sym, rule), "mini long, body long, a int, z int")
    if not hot.isEmpty():
        found = found.unionByName(_judge_hot(hot, sym, rule, level + 1))
    return found


def with_row(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """doc (the id as a long), row (tells texts of one id apart), text and the columns `keep`, of rows with an id."""
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text"), *keep).where("doc is not null")


def repeated(docs: DataFrame, sym: Symbols, rule: str) -> DataFrame:
    """docs as from with_row(). Rows (doc, row, a, z): symbols a to z of the text lie in repeated windows; spans of a text may overlap.

    rule "earlier": the window starts in a document with a smaller id too.
    rule "anywhere": the window starts at any other place too.
    """
    docs = docs.select("doc", "row", "text")
    places = _places(docs, sym)
    same = places.where("mini is not null and body is not null").groupBy("mini", "body").agg(F.min("doc").alias("least"), F.count("*").alias("times"))
    # `first` and the filter make both uses of `same` need the same plan, so its shuffle is made once
    by_mini = same.groupBy("mini").agg(F.count("*").alias("contents"), F.sum("times").alias("total"), F.min("least").alias("first"))
    again = same.join(by_mini.where("total > 1 and first is not null"), "mini").drop("total", "first")
    whole = F.col("doc") > F.col("least") if rule == "earlier" else F.col("times") > 1
    # names are kept only where a bucket's verdict is needed
    named = (F.col("contents") > 1) & (~whole | (F.col("doc") == F.col("least")))
    every = places.join(again, ["mini", "body"]).select("doc", "row", "at", "n", whole.alias("whole"), named.alias("named"), *(F.when(named, F.col(x)).alias(x) for x in ("mini", "body", "times", "contents", "least")))
    every = materialise(every)

    # one string of each content of minimisers with several
    one = every.where("named and doc = least").groupBy("mini", "body", "doc").agg(F.min(F.struct("row", "at")).alias("w"), F.max("n").alias("n"), F.max("times").alias("times"), F.max("contents").alias("contents"))
    ask = one.groupBy("doc", F.col("w.row").alias("row")).agg(F.collect_list(F.struct(F.col("w.at").alias("at"), "n", "mini", "body", (F.col("times") > 1).alias("many"), (F.col("contents") > HOT).alias("hot"))).alias("asked"))
    texts = packed_rows(docs, "text", ["doc", "row"])
    strings = materialise(_strings(texts.join(ask, ["doc", "row"]), sym))
    inside = materialise(_judge(strings, sym, rule))

    # back to the places
    more = every.where("named and not whole").join(inside, ["mini", "body"]).select("doc", "row", (F.col("at") + F.col("a")).alias("a"), (F.col("at") + F.col("z")).alias("z"))
    got = every.where("whole").select("doc", "row", F.col("at").alias("a"), (F.col("at") + F.col("n")).alias("z")).unionByName(more)
    return got.select("doc", "row", "a", (F.col("z") + sym.k - 1).alias("z"))


def with_spans(docs: DataFrame, spans: DataFrame, keep: list[str]) -> DataFrame:
    """The columns doc and `keep`, z (the packed text) and spans, an array of (a, z) or null, for every row of docs."""
    per_row = spans.groupBy("doc", "row").agg(F.collect_list(F.struct("a", "z")).alias("spans"))
    return packed_rows(docs, "text", ["doc", "row", *keep]).join(per_row, ["doc", "row"], "left").select("doc", *keep, "z", "spans")


def each_with_spans(batches):
    """(columns before the text, packed texts, buf, offs, bounds of spans, spans) for runs of rows of with_spans()."""
    for b in batches:
        for first, texts in unpacked(b.column(b.num_columns - 2)):
            for i, j, buf, offs in t.chunks(texts):
                i, j = first + i, first + j
                col = b.column(b.num_columns - 1).slice(i, j - i)
                pairs = col.flatten()
                spans = np.stack([pairs.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)], 1)
                yield [c.slice(i, j - i) for c in b.columns[:-2]], b.column(b.num_columns - 2).slice(i, j - i), buf, offs, np.concatenate([[0], np.cumsum(col.value_lengths().fill_null(0).to_numpy())]), spans
