"""The corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, mixing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns what it keeps of docs.  All but the last
return the columns of documents.  run() writes each stage's result to the shared folder and reads it
back as the next one's documents.

Nulls, ties and odd rows: a null or empty text is never toxic, near a copy or contaminated, and the mix never takes it; rows are judged one by one where
ids are null or repeat, but near-dedup keeps or drops all rows of an id together; extra columns go through every stage, whatever they
are called; empty tables give empty results.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from webloom.llm import common, decontaminate, minhash, mixing, substring, toxicity
from webloom.llm.common import materialise, read

#: Tables that stages made for themselves.
_made: list[str] = []


def stage(function):
    """A stage first removes the tables that earlier stages made for themselves, but for those that its documents still read: once a
    stage's result is written, they are of no use, and the disk is needed."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame | None, sf_dir: str) -> DataFrame:
        _made[:] = common.release(spark, _made, docs)
        before = len(common.made)
        out = function(spark, docs, sf_dir)
        _made.extend(common.made[before:])
        return out

    return run


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under the threshold; the model is fitted on documents and labels."""
    source = docs if docs is not None else read(spark, sf_dir, "documents")
    model = toxicity.train(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return toxicity.accepted(source, model)


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8), the smallest doc_id."""
    return minhash.keep_one(docs)


@stage
def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the words of 50-word windows that a document with a smaller doc_id has."""
    return substring.cleaned(docs)


@stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no 10-word window with a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, numbered by mix_copy."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: SQL can't express the trained classifier, so the pipeline is tested against brute force instead (tests/llm/test_pipeline.py).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = materialise(function(spark, docs, sf_dir), name)
        _made.append(common.made[-1])
    return STAGES[-1][1](spark, docs, sf_dir)
