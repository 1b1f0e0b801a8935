"""Packing: optimal length buckets, then batches under a token budget.

A row's length is its number of tokens, at least 1. The global histogram of the
lengths within the budget (so it has no more entries than that) goes to the
driver, where dynamic programming picks the `buckets` upper bounds with the
least padding. In a bucket, rows are padded to its bound, and a batch takes as
many as the budget allows. A row longer than the budget is a batch by itself,
without padding. Rows of a bucket are numbered in shares, whose sizes are summed
up to where each share begins, so no task holds a bucket and only the last
batch of a bucket has room left.

null and empty texts have no token and take one place of padding. Every row of
the input is in exactly one batch, repeated rows and null ids too. Ties: rows of
equal length go by id, then by where they were read. Very long texts take memory
in proportion to one text. An empty table gives an empty result. The input's
columns are kept out, but for the id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as t
from .common import map_arrow, materialise
from .token_counts import counter_of

BUCKETS, BUDGET = 16, 8192
#: Rows of a bucket that one task numbers.
SHARE = 100_000


def lengths(docs: DataFrame, model_file: str, id_col: str, text_col: str) -> DataFrame:
    """id, n_tokens and salt, the row's number in its task, which spreads rows that have equal ids or none."""

    def run(batches):
        counter, salt = counter_of(model_file), 0
        for b in batches:
            for i, j, buf, offs in t.chunks(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(counter.count(buf, offs)), pa.array(np.arange(salt, salt + j - i))], [id_col, "n_tokens", "salt"])
                salt += j - i

    rows = docs.select(id_col, text_col)
    return map_arrow(rows, run, T.StructType([rows.schema[0], *T.StructType.fromDDL("n_tokens long, salt long").fields]))


def _layer(cost: np.ndarray, x: np.ndarray, rows: np.ndarray):
    """Least cost of the first j lengths with one bucket more, and where that bucket begins.

    Best beginnings only move up with j (the costs are Monge), so midpoints split the search; all midpoints of a depth are done at once.
    """
    n = len(x)
    new, cut = cost.copy(), np.full(n, -1)
    lo, hi, first, last = np.array([1]), np.array([n - 1]), np.array([0]), np.array([n - 2])
    while len(lo):
        mid = (lo + hi) // 2
        to = np.minimum(last, mid - 1)
        size = to - first + 1
        begin = np.cumsum(size) - size
        k = np.arange(int(size.sum())) - np.repeat(begin - first, size)
        j = np.repeat(mid, size)
        total = cost[k] + x[j] * (rows[j + 1] - rows[k + 1])
        least = np.minimum.reduceat(total, begin)
        at = np.flatnonzero(total == np.repeat(least, size))
        best = k[at[np.searchsorted(at, begin)]]
        better = least < new[mid]
        new[mid[better]], cut[mid[better]] = least[better], best[better]
        lo, hi, first, last = (np.concatenate(c) for c in ((lo, mid + 1), (mid - 1, hi), (first, best), (best, last)))
        some = lo <= hi
        lo, hi, first, last = lo[some], hi[some], first[some], last[some]
    return new, cut


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds with the least padding in total: exact dynamic programming over sorted distinct lengths."""
    x, c = np.array(lengths, float), np.array(counts, float)
    n = len(x)
    if n <= buckets:
        return list(lengths)
    rows = np.concatenate([[0.0], np.cumsum(c)])  # padding of i..j in one bucket: x[j] * rows - used
    cost, back = x * rows[1:], []
    for _ in range(buckets - 1):
        cost, cut = _layer(cost, x, rows)
        back.append(cut)
    out, j = [], n - 1
    for cut in reversed(back):
        out.append(lengths[j])
        if cut[j] < 0:
            break
        j = int(cut[j])
    else:
        out.append(lengths[j])
    return sorted(set(out))


def pack(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """id, n_tokens, bucket (its upper bound), batch_id, place in the batch, padding and over_budget of each row."""
    rows = materialise(lengths(docs, model_file, id_col, text_col)).withColumn("length", F.greatest("n_tokens", F.lit(1).cast("long")))
    over = F.col("length") > budget
    histogram = sorted((r["length"], r["count"]) for r in rows.groupBy(F.when(~over, F.col("length")).alias("length")).count().collect() if r["length"])  # budget rows at most
    bounds = best_bounds(*map(list, zip(*histogram, strict=True)), buckets) if histogram else [1]
    top = F.when(over, F.lit(0)).otherwise(F.coalesce(*(F.when(F.col("length") <= b, F.lit(b)) for b in bounds), F.lit(0))).cast("long")
    room = F.when(over, F.lit(1).cast("long")).otherwise(F.floor(F.lit(budget) / F.col("top")))
    rows = rows.withColumns({"over": over, "top": top}).withColumn("room", room)
    sizes = {r["top"]: r["count"] for r in rows.groupBy("top").count().collect()}  # one for each bucket
    shares = F.coalesce(*(F.when(F.col("top") == b, F.lit(-(-c // SHARE))) for b, c in sizes.items()), F.lit(1))
    rows = rows.withColumn("share", F.pmod(F.xxhash64(id_col, "salt"), shares))
    size = rows.groupBy("top", "share").agg(F.count("*").alias("size"))
    begin = F.sum("size").over(Window.partitionBy("top").orderBy("share")) - F.col("size")
    rows = rows.join(size.select("top", "share", begin.alias("begin")), ["top", "share"])
    at = F.row_number().over(Window.partitionBy("top", "share").orderBy(F.desc("length"), F.col(id_col), "salt")) - 1 + F.col("begin")
    rows = rows.withColumn("at", at).withColumn("batch", F.floor(F.col("at") / F.col("room")).cast("long"))
    batch = F.concat_ws("-", F.when(F.col("over"), "over").otherwise(F.col("top").cast("string")), "batch")
    bucket = F.when(F.col("over"), F.col("length")).otherwise(F.col("top"))
    return rows.select(F.col(id_col), "n_tokens", bucket.alias("bucket"), batch.alias("batch_id"), F.pmod("at", "room").cast("int").alias("place"), (bucket - F.col("n_tokens")).alias("padding"), F.col("over").alias("over_budget"))
