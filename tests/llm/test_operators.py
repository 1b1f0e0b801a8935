import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspark.llm import decontaminate, graph, induced, lm, minhash, packing, quality, queries, substring_dedup, suffix_dedup, textkit, token_counts, toxicity, url_filter
from tests.llm import brute

SCHEMA = "doc_id long, text string, doc string, mini long, w string"


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, very long, repeated and tied rows, with columns whose names clash."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)] + ["É", "日本", "the", "The", "a|b", "#x"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, base = say(70), say(120).split(" ")
    near = [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in (3, 60, 119)]
    texts = [None, "", " \n\t ", "one", "one", "a b c d", "A b c d", say(60), passage, say(30) + " " + passage + "\n" + say(30), passage + " " + say(5), " ".join(base), *near, say(20_000), "ab " * 300, "\n".join(["same line here"] * 40), "x" * 5000, "é" * 300, "é" * 300 + "!", say(49), say(50), "\x00 nul \x1f", "▁under ▁score", "<unk> </s>"]
    rows = [(i * 3, x, "d", 1, "w") for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark, odd):
    return odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality"))


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_substring(odd):
    want = brute.substring(pairs(odd))
    got = {r.doc: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(odd).collect()}
    assert got == want and any(x[1] for x in want.values())
    same = {r.doc: r.kept for r in substring_dedup.remove_repeats(odd, as_it_is=True).collect()}
    assert all(same[i] == x for i, x in pairs(odd) if not want[i][1])


def test_suffix(odd, monkeypatch):
    want = brute.byte_repeats(pairs(odd))
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffix_dedup.remove_repeats(odd).collect()}
    assert got == want and any(x[1] for x in want.values())
    monkeypatch.setattr("regspark.llm.superkmer.HOT", 1)  # all windows by their own hashes
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffix_dedup.remove_repeats(odd).collect()}
    assert got == want


def test_hot_core_is_split(spark, monkeypatch):
    """One passage between other words in every document: no task gets over HOT strings of a key."""
    from regspark.llm import superkmer

    rng = random.Random(6)
    say = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = say(80)
    rows = [(i, f"{say(30)} {passage} {say(30)}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    judge, most = superkmer._judge_sorted, 10

    def watched(sym, rule):
        inner = judge(sym, rule)

        def run(batches):
            seen = {}

            def each():
                for b in batches:
                    for m in b.column("mini").to_pylist():
                        seen[m] = seen.get(m, 0) + 1
                        if seen[m] > most:
                            raise ValueError("all strings of a key in one task")
                    yield b

            yield from inner(each())

        return run

    monkeypatch.setattr(superkmer, "HOT", most)
    monkeypatch.setattr(superkmer, "_judge_sorted", watched)
    got = {r.doc: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.substring(rows) and sum(x[1] > 0 for x in got.values()) == 39
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute.byte_repeats(rows)


@pytest.mark.parametrize("held", [None, 5])
def test_suffix_array(held, monkeypatch):
    """Order and common prefixes; with recursion to the end, and with queues that hold five tuples in memory."""
    rng = np.random.default_rng(1)
    if held:
        monkeypatch.setattr(induced, "HELD", held)
        monkeypatch.setattr(induced, "BLOCK", 3)
        monkeypatch.setattr(induced, "MAPPED", 64)
    spills = 0
    for trial in range(150):
        monkeypatch.setattr(induced, "SMALL", 0 if trial % 2 else 1 << 20)
        k = int(rng.integers(2, 9))
        x = rng.integers(1, k, rng.integers(1, 60))
        x = np.append(np.tile(x, 3) if trial % 3 == 0 else x, 0)
        disk = induced.Disk()
        at, common = (np.concatenate(c).tolist() for c in zip(*induced._descending(x, k + 1, disk), strict=True))
        spills += disk.spills
        want = sorted(range(len(x)), key=lambda i: x[i:].tolist(), reverse=True)
        shared = lambda a, b: next(i for i in range(len(x)) if x[a + i] != x[b + i])  # noqa: E731, B023
        assert at == want and common == [0, *(shared(a, b) for a, b in itertools.pairwise(want))]
    assert bool(spills) == bool(held)


def test_suffixes_beyond_memory(monkeypatch):
    """A shard with many times the tuples that are held in memory."""
    monkeypatch.setattr(induced, "HELD", 4096)
    monkeypatch.setattr(induced, "BLOCK", 1024)
    monkeypatch.setattr(induced, "SMALL", 2000)
    monkeypatch.setattr(induced, "MAPPED", 1 << 16)
    rng = random.Random(4)
    base = bytes(rng.choice(b"abcd ") for _ in range(3000))
    strings = [base[a : a + rng.randrange(50, 367)] for a in (rng.randrange(2500) for _ in range(500))]
    buf, offs = np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in strings])])
    disk = induced.Disk()
    at, common = (np.concatenate(c).tolist() for c in zip(*induced.suffixes(buf, offs, disk), strict=True))
    assert disk.spills > 20 and sorted(at) == list(range(len(buf))) and len(buf) > 20 * induced.HELD
    of = np.searchsorted(offs, at, "right") - 1
    rest = [strings[s][a - offs[s] :] for s, a in zip(of, at, strict=True)]
    for x, y, c in zip(rest, rest[1:], common[1:], strict=False):
        n = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
        assert x >= y and (c == n or n == min(len(x), len(y)) <= c)


def test_repeats_come_from_the_sort(spark, monkeypatch):
    """Without the common prefixes that the sort brings, nothing that is repeated in part is found."""
    from regspark.llm import superkmer

    rng = random.Random(8)
    say = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage = say(80)
    rows = [(i, f"{say(30)} {passage} {say(30)}") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.byte_repeats(rows)
    told = lambda: {r.doc: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert told() == want
    honest = superkmer._sorted_bytes
    monkeypatch.setattr(superkmer, "_sorted_bytes", lambda *x: (lambda of, off, new: (of, off, np.ones_like(new)))(*honest(*x)))
    assert told() != want


THUE = "a"
while len(THUE) < 1024:
    THUE += THUE.translate(str.maketrans("ab", "ba"))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_apart(spark):
    """Words and texts that any sum of powers modulo 2^64 takes for each other."""
    rng = random.Random(12)
    say = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    left, right = say(30), say(30)
    rows = [(1, f"{left} {THUE} {right}"), (2, f"{left} {MORSE} {right}"), (3, " ".join(THUE)), (4, " ".join(MORSE)), (5, THUE), (6, MORSE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(docs).collect()}
    assert got == brute.substring(rows)
    got = {r.doc: (r.n_bytes, r.n_removed, r.n_spans, brute.sha(bytes(r.kept))) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute.byte_repeats(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute.near(rows, 85)
    want = brute.lm_base(rows)
    for r in lm.score(docs, queries.crc_mod("doc_id", 7) != 2).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3], abs=1e-6)


@pytest.mark.parametrize("room", [minhash.ROOM, 700])
def test_near(odd, room, monkeypatch):
    monkeypatch.setattr(minhash, "ROOM", room)
    want = brute.near(pairs(odd), 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd, percent=85).collect()}
    assert got == want and len({x[1] for x in want.values()}) < len(want)


@pytest.mark.parametrize("room", [minhash.ROOM, 1500])
def test_near_families(spark, room, monkeypatch):
    """Chains of copies and families that share much but do not link, so buckets stay open after their hubs."""
    monkeypatch.setattr(minhash, "ROOM", room)
    rng = random.Random(21)
    common = [f"c{i}" for i in range(150)]
    rows = []
    for f in range(12):
        words = [*common, *(f"f{f}_{i}" for i in range(30))]
        for _ in range(6):
            words = list(words)
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
            rows.append((len(rows) * 2, " ".join(words)))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), percent=85).collect()}
    assert got == brute.near(rows, 85)


def test_near_shared_ids(spark):
    """Two texts with one id: links of either count."""
    rng = random.Random(22)
    a, b = (" ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(7, a), (7, b), (7, b), (9, a + " more"), (3, b + " more"), (11, "alone here")]
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=85).collect())
    assert got == [(3, 3), (7, 3), (7, 3), (7, 7), (9, 7), (11, 11)]


@pytest.mark.parametrize("sides", [1, 2])
def test_search_matches_all_pairs(sides):
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.integers(0, 2**60, 200).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(200) < rng.choice([0.02, 0.08, 0.2]), rng.integers(0, 2**60, 200).astype(np.uint64), base)) for _ in range(25)]
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        packed = minhash.signatures(np.concatenate(sets), bounds)[4].copy().view(np.uint64)
        side = np.arange(25) % sides
        links = minhash.search(packed, sets, np.arange(25), side, 85)
        top = list(range(25))
        find = lambda i: i if top[i] == i else find(top[i])  # noqa: E731, B023
        for a, b in links:
            assert sides == 1 or side[a] != side[b]
            top[find(a)] = find(b)
        for a, b in itertools.combinations(range(25), 2):
            if minhash.alike(sets[a], sets[b], 85) and (sides == 1 or side[a] != side[b]):
                assert find(a) == find(b)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    top = {}
    find = lambda i: i if top.setdefault(i, i) == i else find(top[i])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}


@pytest.mark.parametrize("small", [0, 1 << 18])
def test_components_by_size(spark, small, monkeypatch):
    """Shuffled stars and one task agree, on hubs, chains, repeated edges and nodes out of order too."""
    monkeypatch.setattr(graph, "SMALL", small)
    rng = random.Random(2)
    edges = [(9, 9), (None, 3)] + [(-(1 << 62), 1 << 62)] * 2 + [(1000, i) for i in range(900, 990)] + [(i, 2000 + (i * 7) % 101) for i in range(2000, 2101)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(160)]
    top = {}
    find = lambda i: i if top.setdefault(i, i) == i else find(top[i])
    full = [(a, b) for a, b in edges if a is not None and a != b]
    for a, b in full:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    rows = graph.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert len(rows) == len({r.node for r in rows}) and {r.node: r.component for r in rows} == {i: find(i) for e in full for i in e}
    none = graph.components(spark.createDataFrame([(1, 1)], "a long, b long"))
    assert none.columns == ["node", "component"] and none.collect() == []


def test_few_links_take_few_stages(spark):
    """The driver accounts for each task of a stage: rounds of shuffled stars are not for a few links."""
    sc = spark.sparkContext
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 500, 2)], "a long, b long")
    try:
        sc.setJobGroup("few links", "")
        assert graph.components(edges).count() == 500
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("few links")) <= 6


def test_tokens(odd):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(odd, path).collect()}
    want = {i: (len((x or "").encode()), len(sp.encode(x or ""))) for i, x in pairs(odd)}
    assert got == {i: (*w, w[1] > 4096) for i, w in want.items()}


def test_tokens_fuzz():
    import pyarrow as pa
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file())
    counter = token_counts.Counter(model_file())
    rng = random.Random(17)
    bits = [" ", "  ", "\n", "\t", "\r", "▁", "<s>", "</s>", "<unk>", "<0x41>", "\u0301", "\u3000", "\xa0", "\x00", "é", "日本", "😀", "the", "ing", "A", "b", "'", "\u200b", "ﬁ", "½"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(3000)]
    got = [n for _, _, buf, offs in textkit.chunks(pa.array(texts)) for n in counter.count(buf, offs).tolist()]
    assert got == [len(x) for x in sp.encode(texts)]


def test_lm(odd):
    out = lm.score(odd, queries.crc_mod("doc_id", 7) != 2)
    want = brute.lm_base(pairs(odd))
    for r in out.collect():
        w = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert r.base_score == pytest.approx(w[3], abs=1e-6) and np.isfinite(r.score) and r.score < 0


def test_lm_is_normalised():
    n = np.zeros((60, 60), np.float32)
    n[:40, :40] = np.random.default_rng(0).integers(0, 50, (40, 40))
    logits = lm.train_nce(n)
    table = lm.normalised(logits.copy())
    assert np.allclose(np.exp(table).sum(1), 1, atol=1e-4)
    q = np.log((n.sum(0) + 1) / (n.sum() + len(n)))
    assert (n * table).sum() > (n * q).sum()  # better than the unigram that made the noise
    group = np.arange(60) % 7
    inside = np.exp(lm.normalised(logits, group))
    assert all(np.allclose(inside[:, group == g].sum(1), 1, atol=1e-4) for g in range(7))


def test_lm_word_by_word(spark, monkeypatch):
    """A text's score from the model's tables, one word at a time; and all of a context's words sum to one."""
    import math

    monkeypatch.setattr(lm, "LEXICON", 1400)
    rng = random.Random(41)
    rows = [(i, " ".join(f"w{int(1800 * rng.random() ** 1.5)}" for _ in range(rng.randrange(0, 400)))) for i in range(80)] + [(900, None), (901, "Never seen words, w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    train = queries.crc_mod("doc_id", 7) != 2
    texts = dict(rows)
    learn = docs.where(train).select("text")
    counted = lm.word_counts(learn).cache()
    n_all, v_all = counted.agg(F.sum("c"), F.count("*")).first()
    m = lm.fit(learn, counted, n_all, v_all)
    assert len(m.vocab) > 100
    c = {r.w: (r["class"], r.c) for r in counted.collect()}
    hot, vocab = m.hot.tolist(), m.vocab.tolist()

    def word(x):
        raw = x.encode()
        h, k, _ = lm.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return int(h[0]), int(k[0])

    def logp(ctx, w):  # ctx: (hash, class) of the three before, None for none
        sym = lambda x: lm.SYMBOLS - 1 if x is None or x[1] == lm.CLASSES else hot.index(x[0]) if x[0] in hot else lm.HOT + x[1]
        p = math.log10(sum(weight * float(m.tables[d][sym(ctx[d]), sym(w)]) for d, weight in enumerate(lm.POSITIONS)))
        if sym(w) < lm.HOT or w[1] == lm.CLASSES:
            return p
        before = lm.CLASSES if ctx[0] is None else ctx[0][1]
        if w[0] in vocab:
            return p + float(m.inside[before, vocab.index(w[0])])
        rest = [x for h, x in c.items() if x[0] == w[1] and h not in hot and h not in vocab]
        return p + float(m.inside[before, len(vocab) + w[1]]) + math.log10((c.get(w[0], (0, 0))[1] + 1) / (sum(x[1] for x in rest) + len(rest) + 1))

    end = (int(lm._END), lm.CLASSES)
    got = {r.doc_id: r.score for r in lm.score(docs, train).collect()}
    for i in list(texts)[-25:]:
        w = [*(word(x) for x in brute.WORD.findall((texts[i] or "").translate(brute.LOWER))), end]
        at = lambda k: w[k] if k >= 0 else None  # noqa: E731, B023
        assert got[i] == pytest.approx(sum(logp([at(k - 1), at(k - 2), at(k - 3)], w[k]) for k in range(len(w))), abs=1e-3)
    every = [(h, x[0]) for h, x in c.items() if h != end[0]] + [end]
    unseen = set(range(lm.CLASSES))
    total = sum(10 ** logp([every[0], None, None], w) for w in every)
    left = sum(10 ** logp([every[0], None, None], (1, k)) for k in unseen)  # one unseen word for each class
    assert total + left == pytest.approx(1, abs=1e-3)


def test_lm_beats_the_base(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    held = queries.crc_mod("doc_id", 7) == 2
    r = lm.score(docs, ~held).where(held).agg(F.sum("base_score").alias("b"), F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    assert r.s / r.n > r.b / r.n + 0.1


def test_quality_counts(odd, labels):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(odd, quality.train(odd, labels)).collect()}
    assert got == {i: brute.quality(x) for i, x in pairs(odd)}


def test_quality_verdict(odd, labels):
    """The probability from the model's weights, feature by feature."""
    import math
    from collections import Counter

    m = quality.train(odd, labels)
    got = {r.doc_id: r for r in quality.judge(odd, m).collect()}
    top = 64 - quality.BITS
    for i, x in pairs(odd):
        raw = (x or "").encode()
        buf = np.frombuffer(raw, np.uint8)
        s, e, _ = textkit.words(buf, np.array([0, len(buf)]))
        h = [int(v) for v in textkit.word_hashes(buf, s, e)]
        mixed = lambda v: int(textkit.mix(np.array([v % (1 << 64)], np.uint64))[0])
        word = Counter(v >> top for v in h) + Counter((mixed(a + b * 31) if k + 1 < len(h) else a) >> top for k, (a, b) in enumerate(zip(h, [*h[1:], 0], strict=False)))
        char = Counter(((((raw[k] << 16) | (raw[k + 1] << 8) | raw[k + 2]) * 0x9E3779B1) % (1 << 32)) >> (32 - quality.BITS) for k in range(len(raw) - 2))
        share = lambda c, w: sum(float(w[k]) * n for k, n in c.items()) / max(sum(c.values()), 1)
        p = 1 / (1 + math.exp(-max(-60, min(60, m.scale * (m.bias + share(word, m.words) + share(char, m.chars)) + m.shift))))
        n, _, _, _, rep = brute.quality(x)
        failed = n < 20 or 100 * rep > 30 * n
        assert got[i].quality == pytest.approx(p, abs=1e-6) and got[i].base_failed == failed and got[i].kept == (not failed and got[i].quality >= 0.5)


def test_toxicity_score(odd, labels):
    """The noisy-or from the model's weights, sentence by sentence."""
    import math
    import re

    m = toxicity.train(odd, labels, F.lit(True))
    got = {r.doc_id: r for r in toxicity.score(odd, m).collect()}

    def slots(word):
        for n in (0, *toxicity.BEGINNINGS):
            part = np.frombuffer(word[:n] if n else word, np.uint8)
            v = textkit.slices(textkit.prefix(textkit.BYTE[part]), np.array([0]), np.array([len(part)])) + np.uint64(n)
            yield int(textkit.mix(v)[0]) >> 44

    for i, x in pairs(odd):
        raw = (x or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
        p = [1 / (1 + math.exp(-max(-60, m.bias + sum(float(m.weights[k]) for w in re.findall(rb"[a-z\x80-\xff]+", sent) for k in slots(w))))) for sent in re.split(rb"[.!?\n]", raw) if sent]
        want = 1 - math.prod(1 - q for q in p)
        assert got[i].score == pytest.approx(want, abs=1e-5)
        assert got[i].worst_score == pytest.approx(max(p, default=0.0), abs=1e-5)


def test_quality_learns(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, known = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    out = quality.judge(docs, quality.train(docs, known.where(half))).drop("quality").join(known.where(~half), "doc_id").where("not base_failed")
    r = out.agg(F.avg(F.when(F.col("quality") == 1, F.col("kept").cast("int"))).alias("good"), F.avg(F.when(F.col("quality") == 0, F.col("kept").cast("int"))).alias("bad")).first()
    assert r.good >= 0.95 and r.bad <= 0.2


def test_toxicity_learns():
    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)) + ". "
    texts, y = [], []
    for i in range(300):
        s = [say(8) for _ in range(6)]
        if i % 3 == 0:
            s[i % 6] = "you zzbad" + rng.choice(["est", "ly", "er"]) + " thing. "
        texts.append("".join(s))
        y.append(int(i % 3 == 0))
    import pyarrow as pa

    bags, spans = [], []
    for _, _, buf, offs in textkit.chunks(pa.array(texts)):
        _, _, b, wb, ids = toxicity.sentences(buf, offs)
        of = wb[b]
        bags += [(ids[of[k] : of[k + 1]], np.diff(wb[b[k] : b[k + 1] + 1])) for k in range(len(texts))]
        model = toxicity.fit(bags[:200], np.array(y[:200]))
        score, _, at, to = model.score(buf, offs)
        spans = [texts[k][at[k] : to[k]] for k in range(len(texts))]
    assert all((score[k] >= 0.7) == y[k] for k in range(200, 300))
    assert all("zzbad" in spans[k] for k in range(200, 300) if y[k])


def test_toxicity_odd(odd, labels):
    model = toxicity.train(odd, labels, F.lit(True))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.reject(odd, model, limit=2.0).count() == odd.count()


def test_urls(spark):
    rng = random.Random(4)
    hosts = ["example.com", "A.Example.com", "example.net", "x.example.net", "org", "notexample.org", "net"]
    urls = [None, "", "no host", "http://", "://", "http://h", "HTTP://EXAMPLE.com/en/7?x#y", "http://example.com?/en/", "a://b://c/en/"]
    urls += [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.randrange(100)}{rng.choice(['', '?q', '#f', '.html'])}" for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge(pages, queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute.url(u, queries.URL_RULES)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block")
        assert verdict is None or r.verdict == verdict


def verdicts(spark, urls, rules):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.url: r.verdict for r in pages.join(url_filter.judge(pages, rules), "page_id").collect()}


def test_url_templates(spark):
    rules = [("block", "h/bad/1"), ("allow", "h/good/1")]
    got = verdicts(spark, [f"http://h/{x}/{k}{i}" for x in ("bad", "good") for k in (1, 2) for i in range(20)], rules)
    assert got["http://h/bad/25"] == "block" and got["http://h/good/25"] == "allow"


def test_url_depth_and_names(spark):
    """Branches below the fourth level, many children, and literal segments that look like wildcards."""
    rules = [("block", "h/a/b/c/d/bad/1"), ("allow", "h/a/b/c/d/good/1"), ("block", "g/*/1"), ("allow", "g/x/1")]
    urls = [f"http://h/a/b/c/d/{x}/1{i}" for x in ("bad", "good") for i in range(20)] + ["http://h/a/b/c/d/bad/sa", "http://h/a/b/c/d/good/sa"]
    urls += [f"http://g/*/1{i}" for i in range(20)] + [f"http://g/x/1{i}" for i in range(20)] + [f"http://g/word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}/q" for i in range(100)] + ["http://g/*/q", "http://g/7/q"]
    got = verdicts(spark, urls, rules)
    assert got["http://h/a/b/c/d/bad/sa"] == "block" and got["http://h/a/b/c/d/good/sa"] == "allow"
    assert got["http://g/*/q"] == "block" and got["http://g/7/q"] == "allow" and got["http://g/wordak/q"] == "allow"


def test_url_merges(spark):
    """Branches with like shares are judged together, with all below them; others are not."""
    rules = [("block", "h/a/1"), ("block", "h/b/1"), ("allow", "h/c/1")]
    urls = [f"http://h/{x}/1{i}" for x in "abc" for i in range(30)]
    pages = spark.createDataFrame(list(enumerate([*urls, "http://h/a/zz", "http://h/b/zz", "http://h/c/zz"])), "page_id long, url string")
    t = {r.url: r.template for r in pages.join(url_filter.judge(pages, rules), "page_id").collect()}
    assert t["http://h/a/zz"] == t["http://h/b/zz"] != t["http://h/c/zz"]


def test_packing_bounds():
    rng = random.Random(0)
    for _ in range(60):
        n = rng.randint(1, 8)
        lengths, counts, k = sorted(rng.sample(range(1, 50), n)), [rng.randint(1, 9) for _ in range(n)], rng.randint(1, 4)
        cost = lambda bs: sum(c * (min(b for b in bs if b >= x) - x) for x, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
        best = min(cost(s) for j in range(1, k + 1) for s in itertools.combinations(lengths, min(j, n)) if s[-1] == lengths[-1])
        got = packing.best_bounds(lengths, counts, k)
        assert len(got) <= k and cost(got) == best


def model_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def check_packing(rows, n_tokens, buckets, budget):
    """rows: of pack(). Lengths, least padding, full batches, and nobody twice in a place."""
    assert sorted(r.n_tokens for r in rows) == sorted(n_tokens)
    inside = [max(1, n) for n in n_tokens if n <= budget]
    distinct = sorted(set(inside))
    cost = lambda bs: sum(min(b for b in bs if b >= n) - n for n in inside)
    batches = {}
    for r in rows:
        assert r.over_budget == (r.n_tokens > budget) and r.bucket >= r.n_tokens and r.padding == r.bucket - r.n_tokens
        batches.setdefault(r.batch_id, []).append(r)
    bounds = sorted({r.bucket for r in rows if not r.over_budget})
    assert len(bounds) <= buckets
    if distinct and math_comb(len(distinct) - 1, buckets - 1) <= 3000:
        best = min(cost([*s, distinct[-1]]) for s in itertools.combinations(distinct[:-1], min(buckets, len(distinct)) - 1))
        assert cost(bounds) == best
    room = {}
    for b in batches.values():
        assert len({r.bucket for r in b}) == 1 and sorted(r.place for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0].bucket <= budget
        if not b[0].over_budget:
            room.setdefault(b[0].bucket, []).append(budget // b[0].bucket - len(b))
    assert all(sorted(r)[:-1] == [0] * (len(r) - 1) for r in room.values())  # one batch of a bucket has room left


def math_comb(n, k):
    import math

    return math.comb(n, min(n, k))


@pytest.mark.parametrize("share", [packing.SHARE, 3])
def test_packing(odd, share, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(packing, "SHARE", share)
    sp = sentencepiece.SentencePieceProcessor(model_file=model_file())
    n = [len(sp.encode(x or "")) for _, x in pairs(odd)]
    rows = packing.pack(odd, model_file(), buckets=3, budget=700).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in pairs(odd))
    check_packing(rows, n, 3, 700)


def test_packing_long_lengths(spark):
    """Over a thousand tokens the bounds are exact too; null ids and equal lengths share no hot place."""
    docs = spark.createDataFrame([(None, "a " * 1030)] * 3 + [(None, "b " * 20)] * 40, "doc_id long, text string").repartition(2)
    rows = packing.pack(docs, model_file(), buckets=2).collect()
    assert all(r.padding == 0 for r in rows) and len({(r.batch_id, r.place) for r in rows}) == 43


def test_leaks(spark, odd):
    rng = random.Random(9)
    say = lambda n: [f"q{rng.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(15, 60)))) for i in range(25)] + [(90, None), (91, ""), (92, "too short"), (93, "r r r r r r r r r r r r")]
    docs = pairs(odd)
    for i, (_, x) in enumerate(items):
        w = (x or "").split()
        if len(w) > 14:
            w[len(w) // 2] = "changed" if i % 3 == 0 else w[len(w) // 2]
            docs.append((10_000 + i, " ".join(say(30)) + ", " + " ".join(w).upper() + "! " + " ".join(say(20))))
    docs.append((20_000, "r r r r r r r r r r r r"))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.leaks(docs, items) and len(got) > 15


def test_leaks_reordered(spark):
    rng = random.Random(10)
    say = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    items, docs = [], []
    for i, (n, moved) in enumerate([(100, 30), (100, 12), (60, 15), (60, 9), (59, 40)]):
        w = say(n)
        items.append((i, " ".join(w)))
        docs.append((i, " ".join([*say(80), *w[-moved:], *w[:-moved], *say(80)])))
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.n_words) for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == brute.leaks(docs, items) and len(got) == 5
    assert got[0, 0] == (round(92 / 100, 9), 80, 100)


def test_leaks_repeated(spark):
    rng = random.Random(11)
    say = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    refrain, run = say(7) * 6 + say(18), ["r"] * 64 + say(40)
    spoilt = say(100)
    items = [(i, " ".join(w)) for i, w in enumerate([refrain, run, spoilt])]
    inside = lambda w: " ".join([*say(80), *w, *say(80)])
    docs = [(0, inside(refrain[:54])), (1, " ".join(refrain[:52])), (2, inside(run[:93])), (3, inside([*spoilt[:90], *["r"] * 20]))]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute.leaks(docs, items) and {(0, 0), (1, 0), (2, 1)} <= got


def test_simhash(spark):
    h = [3, -1, 7, 7, 1 << 62]
    df = spark.createDataFrame([(h,)], "sh array<long>").select(decontaminate.simhash(F.col("sh")).alias("x"))
    want = sum(1 << k for k in range(64) if 2 * sum((v >> k) & 1 for v in h) > len(h))
    assert df.first().x == (want - (1 << 64) if want >> 63 else want)


def test_empty_tables(spark, labels):
    docs = spark.createDataFrame([], SCHEMA)
    none = labels.where("false")
    assert substring_dedup.remove_repeats(docs).count() == 0
    assert suffix_dedup.remove_repeats(docs).count() == 0
    assert minhash.near_duplicates(docs).count() == 0
    assert lm.score(docs, F.lit(True)).count() == 0
    assert quality.judge(docs, quality.train(docs, none)).count() == 0
    assert toxicity.score(docs, toxicity.train(docs, none, F.lit(True))).count() == 0
    assert packing.pack(docs, model_file()).count() == 0
    assert token_counts.count_tokens(docs, model_file()).count() == 0
    assert url_filter.judge(docs.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")), []).count() == 0
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find(docs, items).count() == 0
    assert decontaminate.find(spark.createDataFrame([(1, "a b c d e f", "", 1, "")], SCHEMA), items.where("false")).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (None, None), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert substring_dedup.remove_repeats(docs).count() == 3
    assert suffix_dedup.remove_repeats(docs).count() == 3
    assert [r.component_id for r in minhash.near_duplicates(docs).orderBy("doc_id").collect()] == [1, 1, 2]
    assert packing.pack(docs, model_file()).count() == 5
    assert sorted(r.n_tokens for r in token_counts.count_tokens(docs, model_file()).collect()) == [0, 0, 6, 6, 6]
    known = spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 0)], "doc_id long, toxic int, quality int")
    assert toxicity.score(docs, toxicity.train(docs, known, F.lit(True))).count() == 5
    assert quality.judge(docs, quality.train(docs, known)).count() == 5
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a/b").alias("url"), F.lit("x").alias("host"), F.lit("x").alias("path"), F.lit("x").alias("segs"), F.lit("x").alias("hit"))
    assert url_filter.judge(pages, []).count() == 5
    assert lm.score(docs, F.lit(True)).count() == 3
    items = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()] == [(1, 1)]
