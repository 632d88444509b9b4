"""A corpus pipeline in five stages; each takes what the one before kept and returns it with the columns of documents,
the last a row for each piece of a training sequence."""

from __future__ import annotations

import functools
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddymesh.llm.common import gathered, removed, stored
from eddymesh.llm.line_dedup import line_dedup
from eddymesh.llm.mixing import mixed
from eddymesh.llm.near_dedup import deduplicated
from eddymesh.llm.packing import pack
from eddymesh.llm.quality import fitted, quality_scores
from eddymesh.llm.queries import table, tokenizer

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stage's rows are read from, by thread and input.
_LEFT: dict[tuple[int, str], list[tuple[SparkSession, str]]] = {}


def stage(f: Stage) -> Stage:
    """A stage whose input has been written, so that the tables of the stage before can go; unless its input still reads
    them."""

    @functools.wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = threading.get_ident(), sf_dir
        before = _LEFT.pop(key, [])
        files = docs.inputFiles() if before else []
        removed([t for t in before if not any(t[1] in file for file in files)])
        with gathered() as tables:
            out = f(spark, docs, sf_dir)
        _LEFT[key] = tables + [t for t in before if any(t[1] in file for file in files)]
        return out

    return run


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.7 go. Texts of fewer than three bytes (null, empty) have the
    share of label 1 as their score, and stay or go together; repeated rows and equal texts do so too."""
    scored = quality_scores(docs, fitted(docs, table(spark, sf_dir, "labels")))
    return scored.where("quality_score >= 0.7").select("of.*")


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines of 50 words or more go; n_chars follows the text. No row goes: null texts stay null
    and a text may end up empty. The first of equal texts by (doc_id, place) keeps its lines."""
    return line_dedup(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8): the first by (doc_id, place),
    null last. Texts without words are in no group, and all stay."""
    return deduplicated(docs)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights; a document comes as often as the training takes it, none to two times. Texts
    without words (null, empty) are never taken. Repeated rows are taken each for itself."""
    return mixed(docs)


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens: a row for each piece of each row. A text without tokens would be its end id alone."""
    return pack(docs, tokenizer("word_bpe_49k.json"), kept=60_000, chunk=2 << 20)


STAGES = [("quality", quality), ("line_dedup", lines), ("near_dedup", near_dedup), ("mix", mix), ("pack", packed)]
#: The classifier, sketches and tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another; a stage's rows are written, and go when the next one's are. Empty tables give an
    empty result, whatever the stage."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, f in STAGES:
        docs = stored(f(spark, docs, sf_dir), f"pipeline-{name}")
        removed(before)
        before = [(spark, docs.stored_at)]
    removed(_LEFT.pop((threading.get_ident(), sf_dir), []))
    return docs
