"""From documents to packed training sequences, in five stages that each call one operator of ``topicloom.llm``.

Every stage reads all rows that the stage before it kept. All but the last return the columns of documents: rows that a
stage rejects, or folds into another, are gone. The last returns the packed pieces.

Defined cases, for every stage: nulls may stand in any column; of repeated rows each is judged alike, and the dedup stages
keep one; texts of any length are read whole; a null or empty text has no language and goes with the first stage (given to
a later one: it is scored, is equal to other empty texts, is near to none, and is one end id when packed); an empty table
gives an empty one; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import common
from topicloom.llm.exact_dedup import exact_distinct
from topicloom.llm.language import UNDECIDED, identify
from topicloom.llm.language import train as train_language
from topicloom.llm.minhash import near_distinct
from topicloom.llm.packing import pack
from topicloom.llm.quality import assess
from topicloom.llm.quality import train as train_quality
from topicloom.llm.tokens import vocabulary
from topicloom.sources.tables import mark, sweep

#: A text whose best language has less than this times the chance of one drawn blindly has none; a text of a lower quality
#: score goes.
LEAST_LANGUAGE, LEAST_QUALITY = 1.1, 0.3

#: Ids of a packed sequence.
CAPACITY = 2048


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts with letters in one of the languages that the table's own ``lang`` column teaches."""
    model = train_language(docs.select("text", "lang"), F.lit(True))
    found = identify(docs, model, into="_language")
    into = found.columns[-1]
    return found.filter((F.col(f"{into}.lang_pred") != UNDECIDED) & (F.col(f"{into}.score") * max(1, len(model.classes)) >= min(LEAST_LANGUAGE, len(model.classes)))).drop(into)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts that the classifier, taught by ``labels``, scores at LEAST_QUALITY or more."""
    model = train_quality(docs.select("doc_id", "text"), common.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    found = assess(docs, model, into="_quality")
    into = found.columns[-1]
    return found.filter(F.col(into) >= LEAST_QUALITY).drop(into)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal normalised texts."""
    return exact_distinct(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near-duplicate texts."""
    return near_distinct(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' ids as pieces, packed into sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"), CAPACITY)


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The stages hold trained models, tokenizers and a packing plan: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a written table before the next reads it.

    What a stage and the one before it wrote on the way is removed once its result is there.
    """
    docs = common.table(spark, sf_dir, "documents")
    began = mark()
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
        sweep(began, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
