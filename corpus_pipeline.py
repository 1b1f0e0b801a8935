"""A training corpus from raw documents, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns what the next one gets as
docs. Rows without a doc_id pass the stages that tell documents apart by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.llm import decontaminate, minhash, packing, substring_dedup, toxicity
from regspark.llm.common import materialise, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from all labelled ones."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"), F.lit(True))
    return toxicity.reject(docs, model, limit=0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 0.8 of their five-word shingles, the smallest doc_id stays."""
    gone = minhash.near_duplicates(docs, percent=80).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in 50-word windows that an earlier document has go; other rows stay as they are, null texts too."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = substring_dedup.remove_repeats(docs, as_it_is=True, carry=[*others, "n_chars"])
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("kept")).otherwise(F.col("carried.n_chars")).cast(docs.schema["n_chars"].dataType)
    cut = out.select(*(F.col(f"carried.`{c}`") for c in others), F.col("kept").alias("text"), n_chars.alias("n_chars")).select(docs.columns)
    return cut.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window 0.8 similar to a benchmark item go."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Batches of tokens; every row that is left is in one of them."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: Several stages have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
