"""The corpus pipeline: raw documents to packed training sequences.

Stages, each over all that its predecessor kept:

1. toxicity: documents that score 0.5 or more go;
2. near_duplicates: of each group (shingles of five words, similarity 0.8) the document
   with the smallest id stays; rows without an id stay;
3. decontamination: documents that share a window of ten words with a benchmark item,
   or a whole shorter item, go;
4. pii: personal data is replaced by its kind;
5. packing: documents become places in sequences of 4096 tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again for the next; all but the last return the columns of their
input. Rows that share an id are one document: they stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.decontaminate import hits
from docweave.llm.near_dup import near_duplicates
from docweave.llm.packing import pack_documents
from docweave.llm.pii import redact
from docweave.llm.shared import fresh, materialize
from docweave.llm.tokens import tokenizer_path
from docweave.llm.toxicity import fit, score_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic; ``labels`` outside the held-out fold teach what is.

    Null and empty texts are no hit and stay; rows that repeat a text go or stay
    together; where labels of one kind are missing, all stay.
    """
    lexicon = fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh("toxicity", docs.columns)
    return score_documents(docs, lexicon, name).filter(F.col(name) < 0.5).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    Null, empty and wordless texts are like nothing and stay, as do rows without an
    id; rows that repeat an id are one document and stay or go together.
    """
    dropped = fresh("dropped", docs.columns)
    gone = near_duplicates(docs.select("doc_id", "text"), k=5).filter(~F.col("kept")).select(F.col("doc_id").alias(dropped)).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col(dropped), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null, empty and wordless texts have none and stay; rows that repeat id and text
    stay or go together; rows without an id are judged by their text.
    """
    met = hits(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    own_id, own_tag = fresh("hit_id", docs.columns), fresh("hit_tag", docs.columns)
    found = met.select(F.col("doc.doc_id").alias(own_id), F.col("doc.tag").alias(own_tag)).distinct()
    tag = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(found, (tag == F.col(own_tag)) & docs["doc_id"].cast("long").eqNullSafe(F.col(own_id)), "left_anti")


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind.

    Null and empty texts stay as they are, every row stays, and rows that repeat id
    and text get equal texts.
    """
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences.

    Null and empty texts are the end id alone; repeated rows are packed as often as
    they come; no documents give no pieces.
    """
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: SQL can express neither the trained scores nor the signatures; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
