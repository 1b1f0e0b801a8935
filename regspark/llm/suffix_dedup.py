"""Suffix-sorted deduplication: bytes in strings that start at two places or more.

Texts are UTF-8 bytes. A byte goes if it lies in a string of `length` bytes, in
one document, that starts anywhere else in the table too. Shards are the
buckets of the strings' minimisers (superkmer.py), which hold what can repeat,
each different string once with whether it came several times. In each shard
the suffixes are sorted by external induction (induced.py), which carries their
common prefixes along; neighbours that share `length` bytes or more are
repeats. A string whose minimiser has no other content is alone in its shard
and needs no sort: whether it came several times is its verdict.

null and empty texts have no bytes; rows without an id are left out. Rows that
share an id are places of their own, so each other's equal strings repeat. Very
long texts take memory in proportion to one text. An empty table gives an empty
result. A cut may leave part of a character; the kept bytes are binary. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import superkmer as sk
from . import textkit as t
from .common import map_arrow

LENGTH = 200
#: Lengths of minimisers in bytes; the next one serves what the one before leaves hot.
LEVELS = (64, 128, 176, 192, LENGTH)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept (binary) and removed (runs of byte places)."""
    sym = sk.Symbols("byte", length, levels)
    rows = sk.with_row(docs, id_col, text_col)
    rows = sk.with_spans(rows, sk.repeated(rows, sym, "anywhere"), [])
    names = ["doc", "n_bytes", "n_removed", "n_spans", "kept", "removed"]

    def run(batches):
        for cols, packed, buf, offs, at, spans in sk.each_with_spans(batches):
            of = t.owner(at)
            out = t.covered(np.minimum(spans + offs[of][:, None], offs[of + 1][:, None]), len(buf))
            a, z, rb = t.runs(out, offs)
            kept = [buf[x:y][~out[x:y]].tobytes() for x, y in zip(offs[:-1], offs[1:], strict=True)]
            runs = [[{"a": int(x - offs[k]), "z": int(y - offs[k])} for x, y in zip(a[rb[k] : rb[k + 1]], z[rb[k] : rb[k + 1]], strict=True)] for k in range(len(packed))]
            kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(offs)), pa.array(t.grouped_sum(out, offs).astype(np.int64)), pa.array(np.diff(rb)), pa.array(kept, pa.binary()), pa.array(runs, kind)], names)

    return map_arrow(rows, run, "doc long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<a: bigint, z: bigint>>")
