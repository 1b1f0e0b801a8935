"""Token counts without tokenising: most pre-tokens are one whole token.

The vocabulary of a sentencepiece BPE model with white space as a prefix has no
piece with a word mark after another character, and none with a line feed. So
no merge crosses such a place, and the stretches between them ("pre-tokens")
are merged each on its own. Before any text, each worker proves which
vocabulary strings come out as one token when they stand alone; pre-tokens
equal to one of them count 1 without a merge. Only the rest are merged, each
distinct one once, with a bounded memory of earlier results.

null and empty texts have 0 tokens; repeated rows are counted each, and ids may
be anything. Very long texts take memory in proportion to one text; a pre-token
is merged whole, however long. An empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkit as t
from .common import map_arrow

#: Distinct pre-tokens whose counts a worker keeps; beyond it, it starts anew.
MEMORY = 200_000
MARK = "▁"


class Counter:
    """Counts the tokens of whole documents under one sentencepiece model."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()) if not (self.sp.is_byte(i) or self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i))]
        if any("\n" in p or MARK in p.lstrip(MARK) for p in pieces) or self.sp.encode("a  b", out_type=str) != [MARK + "a", MARK, MARK + "b"]:
            raise ValueError("this model merges across words; its counts can't be cut at them")
        texts = [p.replace(MARK, " ") for p in pieces]
        single = [s.encode() for s, n in zip(texts, self.merge(texts), strict=True) if n == 1]
        offs = np.concatenate([[0], np.cumsum([len(s) for s in single])])
        self.single = np.sort(t.word_hashes(np.frombuffer(b"".join(single), np.uint8), offs[:-1], offs[1:]))
        self.known: dict[int, int] = {}

    def merge(self, pretokens: list[str]) -> list[int]:
        """Tokens of each pre-token. A leading blank is the mark that the model itself puts first; a line feed keeps it off."""
        marked = [s[0] == " " for s in pretokens]
        got = self.sp.encode([s[1:] if m else "\n" + s for s, m in zip(pretokens, marked, strict=True)], num_threads=1)
        # a lone mark is what the model drops from an empty text
        return [(len(g) or 1) if m else len(g) - 2 for g, m in zip(got, marked, strict=True)]

    def count(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each document of a chunk."""
        if MARK.encode() in (raw := buf.tobytes()):
            docs = [raw[a:b].replace(MARK.encode(), b" ") for a, b in zip(offs[:-1], offs[1:], strict=True)]
            buf, offs = np.frombuffer(b"".join(docs), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        full = np.diff(offs) > 0
        buf = np.insert(buf, offs[:-1][full], 0x20)  # the mark before a text
        offs = offs + np.concatenate([[0], np.cumsum(full)])
        n = len(buf)
        if not n:
            return np.zeros(len(full), np.int64)
        blank, feed, cut = buf == 0x20, buf == 0x0A, np.zeros(n, bool)
        cut[1:] = (blank[1:] & ~blank[:-1]) | feed[1:] | feed[:-1]
        cut[offs[:-1][full]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        h = t.word_hashes(buf, start, end)
        distinct, at, back = np.unique(h, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.single, distinct), len(self.single) - 1)
        counts = (self.single[place] == distinct).astype(np.int64)
        counts[feed[start[at]]] = 1  # a line feed is one byte token and a pre-token by itself
        rest = np.flatnonzero(counts == 0)
        keys = distinct[rest].tolist()
        counts[rest] = [self.known.get(k, 0) for k in keys]
        new = rest[counts[rest] == 0]
        if len(new):
            raw = buf.tobytes()
            got = self.merge([raw[a:b].decode("utf-8") for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)])
            counts[new] = got
            if len(self.known) + len(got) > MEMORY:
                self.known.clear()
            self.known.update(zip(distinct[new].tolist(), got, strict=True))
        return t.grouped_sum(counts[back], np.searchsorted(start, offs))


_counters: dict[str, Counter] = {}


def counter_of(model_file: str) -> Counter:
    """This worker's counter, made once."""
    if model_file not in _counters:
        _counters[model_file] = Counter(model_file)
    return _counters[model_file]


def count_tokens(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row; ids may repeat or be null.

    model_file is a path on every worker, as the tokenizers are installed there.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = counter_of(model_file)
        for b in batches:
            for i, j, buf, offs in t.chunks(b.column(1)):
                n = counter.count(buf, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
