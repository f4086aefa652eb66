"""A corpus pipeline of the training-data operators: each stage works on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and keeps the columns of documents, but for the last, which returns the encoded documents.
Defined cases, for every stage: null texts and empty ones are judged like any text (no insult, the quality of no characters, no near copy, no benchmark passage, no ids); rows with null doc_id are judged by their text and
never copies of others; repeated rows share their fate, and of those of one doc_id one stays after ``near_copies``; further columns pass through, whatever their names; empty tables stay empty, and without labels or
benchmark nothing is rejected.

``run`` writes each stage's rows to the shared folder and rereads them, so a lost executor costs one stage at most; rows that the next stage has replaced are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import bpe, positive_unlabelled, prefix_tree_join, string_kernel, winnowing
from sparkloom.llm.common import cut, free_name, read_table, remove

#: near copies in the pipeline: word shingles and the similarity in percent
SHINGLE, PERCENT = 5, 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine rejects go."""
    machine = string_kernel.fit(docs, read_table(spark, sf_dir, "labels"))
    name = free_name(docs, "__score")
    return string_kernel.with_score(docs, machine, name).where(F.col(name) < string_kernel.THRESHOLD).drop(name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled model rejects go."""
    model = positive_unlabelled.fit(docs, read_table(spark, sf_dir, "labels"))
    name = free_name(docs, "__score")
    return positive_unlabelled.with_score(docs, model, name).where(F.col(name) >= positive_unlabelled.THRESHOLD).drop(name)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id."""
    return prefix_tree_join.one_of_each_group(docs, PERCENT, SHINGLE)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go."""
    return winnowing.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), widths (their numbers of bytes) and the digest of the text decoded from them."""
    return bpe.encode(docs, bpe.ranks_file())


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_copies", near_copies), ("decontamination", decontamination), ("encoding", encoding)]

#: the classifiers have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs, path = cut(docs, f"stage-{name}")
            remove(spark, *before)
            before = [path]
    return docs
