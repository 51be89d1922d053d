"""A corpus pipeline over ``documents``: language ID, near-duplicates, repeated passages, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, language, mixing, near_dup, substring_dedup
from sparkloom.llm._store import store
from sparkloom.llm.queries import vocabulary

#: A document stays if its language has at least this posterior.
LEAST_SCORE = 0.5


def _aside(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with columns of ``names`` out of the way of an operator that makes such columns itself."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in names if c in docs.columns})


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, those put aside with their own values."""
    return found.select(*[F.col(f"_own_{c}").alias(c) if f"_own_{c}" in found.columns else F.col(c) for c in docs.columns])


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter and a likely language stay; a null lang becomes the predicted one.

    Null, empty and letterless texts have no language and go. A null doc_id is in the training fold or not like the empty id. Repeated rows stay or go together.
    A table without any lang gives no rows, as does an empty one. Other columns stay as they are, whatever their names.
    """
    model = language.train(docs.filter(language.fold(F.col("doc_id"), 5) != 0).select("text", "lang"))
    tagged = language.tag(_aside(docs, "lang_pred", "score"), model)
    known = tagged.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return _back(known.withColumn("lang", F.coalesce("lang", "lang_pred")), docs)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similarity 0.8 on five-word shingles, the document with the smallest id stays; repeated rows are one document.

    A document is a distinct pair of doc_id and text, so texts that share an id, or have none, are compared like any others. Null, empty and blank texts are near to nothing and stay,
    one row of each id. An empty table gives none. Other columns stay as they are, whatever their names.
    """
    return near_dup.without_duplicates(docs, k=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines and sentences that an earlier document has are cut; documents that hold nothing else go.

    Documents are ordered by doc_id, those without one first. Null and empty texts hold no passage and stay. n_chars is that of the cut text, null for null texts. Repeated rows are one document
    and lose the same. An empty table gives none. Other columns stay as they are, whatever their names.
    """
    cut = substring_dedup.dedup(_aside(docs, "removed", "n_removed_chars"))
    left = cut.filter((F.size("removed") == 0) | F.coalesce(F.col("text").rlike(r"\S"), F.lit(False)))
    return _back(left.withColumn("n_chars", F.char_length("text").cast("long")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Null sources are one source. Null and empty texts have no words: they are taken like the others of their source, but count nothing. Repeated rows count each. An empty
    table gives none. Other columns stay as they are, whatever their names.
    """
    copies = mixing.mix(_aside(docs, "size", "source_size", "target", "copies", "taken")).filter("copies > 0")
    return _back(copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))), docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them: doc_id, n_tokens, ids_sha256, decoded_sha256 of every row.

    Null and empty texts have no tokens. Repeated rows get equal results, an empty table none; other columns go.
    """
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("language_id", keep_known_language),
    ("near_dup", keep_one_of_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mix", mix_sources),
    ("bpe", tokenize),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
