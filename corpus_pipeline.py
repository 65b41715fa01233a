"""The training-data pipeline: language ID, near-duplicates, personal data, mixing, packing.

STAGES names the stages in order. Each takes the documents its predecessor kept; ``run`` writes a stage's rows as
Parquet in the shared folder and hands them to the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import bagminhash, langid, mixing, packing, pii
from corpuslens.llm.common import boxed, read, table

#: Below so many letters a phrase, on average, a text is in none of the learned languages; texts of fewer letters than
#: ENOUGH give too few phrases to tell and stay.
LEAST_PHRASE, ENOUGH = 1.5, 20


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5. Learns from the labelled documents and drops texts without letters or in no learned language.

    Null and empty texts have no letters and go. Texts of a few letters stay, whatever their phrases. If nothing could
    be learned (no row with a usable label, or an empty table), every text with a letter stays. Repeated rows are
    judged alike and all columns stay as they are.
    """
    model = langid.train(docs)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    packed, unboxed = boxed(docs, ["doc_id", "text", "lang"])
    found = langid.identify(packed, model)
    most = float(max(model.weight)) / LEAST_PHRASE
    told = F.col("text").rlike(rf"(?:\p{{L}}[^\p{{L}}]*+){{{ENOUGH}}}")
    return unboxed(found.where((F.col("lang_pred") != langid.UND) & ((F.col("bits") <= most) | ~told)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. One document of each class of near-duplicates stays, the one with the smallest doc_id.

    Of repeated rows one stays; null texts and texts without words are no copies of one another and stay, and a null
    doc_id counts as the largest. An empty table stays empty; other columns are handed on as they are.
    """
    return bagminhash.kept_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. Personal data and the terms that disclose it are masked; no document goes.

    Null texts stay null and n_chars follows the text; repeated rows are masked alike, other columns stay.
    """
    return pii.sanitised(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. The documents as the mix takes them: parts, wholes or twice.

    Texts without words (null ones too) are not in the mix; a null source is a source of its own. Repeated rows are
    mixed each; other columns are handed on as they are. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packing_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. One row per piece with its bin, its place in it and its text.

    A text without words is one piece of size 0; repeated rows are packed each; an empty table has no pieces.
    """
    return packing.packed_texts(docs)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixture),
    ("packing", packing_bins),
]

#: The stages learn, sign and draw; SQL cannot express them. tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs)
    return docs
