"""From raw documents to packed training sequences: each stage is one operator of keylink.llm.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last keep the columns of
documents. ``run`` writes each stage's result to the shared scratch folder and reads it back. What
a stage leaves there itself goes when a later stage begins and nobody holds the stage's result.
"""

from __future__ import annotations

import functools
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylink.llm.mixing import mix
from keylink.llm.near_dedup import near_duplicates
from keylink.llm.packing import pack
from keylink.llm.pii import find_personal
from keylink.llm.quality import quality
from keylink.llm.queries import tokenizer_path
from keylink.sources.workspace import Workspace

# Word shingles that near duplicates share at least; op1_chosen_path has a contract of its own.
NEAR_PERCENT = 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(frame: DataFrame, text: str = "text") -> DataFrame:
    new = {"text": F.col(text), "n_chars": F.length(text).cast("long")} if text != "text" else {}
    return frame.select(*[new.get(c, F.col(c)).alias(c) for c in COLUMNS])


# Results of stages that may still be read, and the scratch tables they read.
_HELD: list[tuple[weakref.ref, Workspace]] = []


def _stage(function):
    @functools.wraps(function)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for held in [x for x in _HELD if x[0]() is None and x[1].spark is spark]:
            folder = held[1].root.rsplit("/", 1)[-1]
            if not any(folder in file for file in docs.inputFiles()):
                _HELD.remove(held)
                held[1].clear()
        space = Workspace(spark)
        result = function(docs, space)
        _HELD.append((weakref.ref(result), space))
        return result

    return begin


@_stage
def quality_rules(docs: DataFrame, space: Workspace) -> DataFrame:
    """Rejected documents go; lines that too many documents of a host share go from the others."""
    return _documents(quality(docs, space=space).filter("kept"), "clean_text")


@_stage
def near_dedup(docs: DataFrame, space: Workspace) -> DataFrame:
    """One document of each group of near duplicates (80 % of their five-word shingles) stays."""
    near = near_duplicates(docs, one_row=True, space=space, percent=NEAR_PERCENT)
    return _documents(near.filter("kept"))


@_stage
def personal_data(docs: DataFrame, space: Workspace) -> DataFrame:
    """Personal data give way to the names of their kinds."""
    return _documents(find_personal(docs, space=space), "redacted")


@_stage
def mixing(docs: DataFrame, space: Workspace) -> DataFrame:
    """Sources in their target weights, shuffled."""
    return _documents(mix(docs))


@_stage
def packing(docs: DataFrame, space: Workspace) -> DataFrame:
    """Pieces of token ids with their places in sequences."""
    return pack(docs, tokenizer_path(), space=space).select(
        "doc_id", "lang", "source", "start", "length", "ids", "ids_crc32", "doc_tokens",
        "sequence_id", "offset",
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

# Token ids, shingle hashes and boosted trees have no SQL form; tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = Workspace(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, space.save(stage(spark, docs, sf_dir), name)
        space.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
