"""Substring deduplication: passages of words that an earlier document has too.

A window is `window` words in a row of one document. A word goes if it lies in
a window whose words also start in a document with a smaller id; windows are
judged on the input. See superkmer.py for how they are found. Words are the
runs of bytes other than 0x20 and 0x09 to 0x0D, compared as they are.

null and empty texts have no words; rows without an id are left out. Rows that
share an id are one document to the rule, and each loses words by its own text.
Ties: of equal windows only the smallest id's stay. Very long texts take memory
in proportion to one text. An empty table gives an empty result. Other columns
are not read, or carried along as they are where `carry` names them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import superkmer as sk
from . import textkit as t
from .common import map_arrow

WINDOW = 50
#: Lengths of minimisers in words; the next one serves what the one before leaves hot.
LEVELS = (16, 32, 44, WINDOW)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, levels: tuple[int, ...] = LEVELS, as_it_is: bool = False, carry: list[str] | None = None) -> DataFrame:
    """doc, n_words, n_removed, kept (the words that stay, joined by one space) and removed (runs of word indexes).

    as_it_is: texts that lose nothing stay as they are in `kept`.
    carry: columns of docs that come along, in the struct `carried`.
    """
    sym = sk.Symbols("word", window, levels)
    more = [F.struct(*carry).alias("carried")] if carry else []
    rows = sk.with_row(docs, id_col, text_col, *more)
    rows = sk.with_spans(rows, sk.repeated(rows, sym, "earlier"), ["carried"] if carry else [])
    names = ["doc", *(["carried"] if carry else []), "n_words", "n_removed", "kept", "removed"]

    def run(batches):
        for cols, packed, buf, offs, at, spans in sk.each_with_spans(batches):
            s, e, bounds = t.words(buf, offs)
            of = t.owner(at)
            spans = np.minimum(spans + bounds[of][:, None], bounds[of + 1][:, None])
            out = t.covered(spans, len(s))
            raw = buf.tobytes()
            kept, runs = [], []
            a, z, rb = t.runs(out, bounds)
            null = packed.is_null().to_pylist()
            for k in range(len(packed)):
                if rb[k] == rb[k + 1] and as_it_is:
                    kept.append(None if null[k] else raw[offs[k] : offs[k + 1]])
                else:
                    w = bounds[k] + np.flatnonzero(~out[bounds[k] : bounds[k + 1]])
                    kept.append(b" ".join([raw[x:y] for x, y in zip(s[w].tolist(), e[w].tolist(), strict=True)]))
                runs.append([{"a": int(x - bounds[k]), "z": int(y - bounds[k])} for x, y in zip(a[rb[k] : rb[k + 1]], z[rb[k] : rb[k + 1]], strict=True)])
            kind = pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.diff(bounds)), pa.array(t.grouped_sum(out, bounds).astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(runs, kind)], names)

    made = T.StructType.fromDDL("n_words long, n_removed long, kept string, removed array<struct<a: bigint, z: bigint>>")
    return map_arrow(rows, run, T.StructType([*rows.drop("z", "spans").schema.fields, *made.fields]))
