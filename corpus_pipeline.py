"""The corpus pipeline: five stages over documents, each reading what the one before it wrote.

Each stage works on rows as they come: null and empty texts are documents like others (equal to each
other), rows may repeat, tables may be empty, and further columns come out as they went in, also those
whose names an operator uses for its results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.common import shielded
from fathomline.llm.content_dedup import exact_dedup
from fathomline.llm.mixing import mix_sources
from fathomline.llm.near_dup import near_duplicates
from fathomline.llm.packing import pack_documents
from fathomline.llm.queries import tokenizer_path
from fathomline.llm.toxicity import score_toxicity
from fathomline.runtime import materialise, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the grammar predicts toxic go.  Null and empty texts stay, as do rows without identifier
    by their text; repeated rows fare alike; labels may be empty or clash (toxic wins)."""
    kept, back = shielded(docs, ("toxic_score", "toxic_predicted"))
    scored = score_toxicity(kept, table(spark, sf_dir, "labels"), keep_columns=True)
    return back(scored.filter(F.col("toxic_predicted") == 0))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; null counts as empty, a row without identifier
    stays only if no equal one has one, and of rows that repeat an identifier and its text one stays."""
    kept, back = shielded(docs, ("keep_id", "group_size", "kept", "text_sha256"))
    return back(exact_dedup(kept).filter("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share five-word shingles at 0.8 or more, and so on along their links, the
    smallest doc_id stays.  Documents without words or without identifier stay; rows that share an
    identifier stay or go together."""
    dropped = near_duplicates(docs, width=5).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled so that sources, languages and kinds of text have their target shares.

    Targets are the tokens' shares to the power 0.9; no document is taken twice.  Nulls are groups of
    their own, documents of cells without a word all stay, and rows that share an identifier draw one number.
    """
    kept, back = shielded(docs, ("topic", "n_tokens", "weight", "probability", "selected", "copies"))
    return back(mix_sources(kept, exponent=0.9, share=0.9, repeat=False).filter("selected"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence of 4096 tokens; a null or empty text is one token."""
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: Training a grammar, raking and packing are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{name}")
    return docs
