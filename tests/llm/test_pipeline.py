import corpus_pipeline
from regspark.llm import toxicity
from regspark.llm.common import table
from tests.llm import brute
from pyspark.sql import functions as F


def test_pipeline(spark, sf):
    """Each stage on its own input against a plain version; the toxicity scores are the model's."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = {}
    stage = docs
    for name, f in corpus_pipeline.STAGES:
        before = stage.select("doc_id", "text").collect()
        stage = f(spark, stage, sf)
        if name != "packing":
            assert stage.columns == docs.columns
        rows = stage.collect()
        out[name] = (before, rows)
        stage = spark.createDataFrame(rows, stage.schema)
    before, after = out["toxicity"]
    model = toxicity.train(docs, table(spark, sf, "labels", "doc_id", "toxic"), F.lit(True))
    assert {r.doc_id for r in after} == {r.doc_id for r in toxicity.score(docs, model).where("score < 0.7").collect()}
    before, after = out["near_dedup"]
    assert {r.doc_id for r in after} == {i for i, (_, c) in brute.near([(r.doc_id, r.text) for r in before], 80).items() if i == c}
    before, after = out["substring_dedup"]
    want = brute.substring([(r.doc_id, r.text) for r in before])
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id: r.text for r in after} == {i: kept if n else texts[i] for i, (_, n, kept) in want.items()}
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = out["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    gone = {d for d, _ in brute.leaks([(r.doc_id, r.text) for r in before], items)}
    assert {r.doc_id for r in after} == {r.doc_id for r in before} - gone
    before, after = out["packing"]
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r in before)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == {r.doc_id for r in after}


def test_odd_rows(spark, sf):
    """Null and repeated ids, null and empty texts, ties, a clashing column: rows in are rows out unless a stage's rule says otherwise."""
    import random

    rng = random.Random(31)
    say = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    passage, whole = say(60), say(100)
    texts = [(1, passage + " " + say(200)), (2, say(200) + " " + passage), (2, say(30)), (2, say(30)), (3, None), (4, ""), (None, whole), (None, None), (5, whole), (6, whole), (7, say(80)), (7, None)]
    rows = [(i, x, "en", f"s{k}", None if x is None else len(x), k, "kept") for k, (i, x) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row long, carried string")
    left = docs
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, left, sf)
        if name == "packing":
            assert out.count() == left.count()
            break
        assert out.columns == docs.columns
        got = out.collect()
        gone = {r.source for r in left.collect()} - {r.source for r in got}
        assert len({r.source for r in got}) == len(got)
        assert gone == ({"s9"} if name == "near_dedup" else set())
        if name == "substring_dedup":
            cut = next(r for r in got if r.source == "s1")
            assert passage not in cut.text and cut.n_chars == len(cut.text)
            assert all(r.text == texts[int(r.source[1:])][1] for r in got if r.source != "s1")
        left = spark.createDataFrame(got, out.schema)
    empty = docs.limit(0)
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, sf).count() == 0
