"""A training corpus from the table of documents, in five stages.

Each stage works on all that the one before kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import decontaminate, mixing, near_copies, rules, sstable
from tallyloom.llm.common import read, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go.

    Null, empty and blank texts have no words and go. Repeated rows are judged alike; null identifiers are judged but
    not learned from; whole texts count, however long. Without labels only the base rules decide. An empty table stays
    empty. Statistics have names that no column of the table has."""
    return rules.kept_rows(docs, read(spark, sf_dir, "labels"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8 or more; SimHash fingerprints within 2
    bits are met first, then MinHash bands, and whole shingle sets decide) stays: that with the smallest identifier, null identifiers last, ties by a hash of the text and then of all columns.

    Null and blank texts are copies of each other, repeated rows too. An empty table stays empty; whole texts count;
    helper columns have names that no column of the table has."""
    return near_copies.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a near copy of a benchmark item go.

    Null and empty texts hold none and stay, null identifiers too; repeated rows go or stay together. Null and blank
    items count as none. An empty table stays empty; no column is added or needed but the text."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in order of training position.

    Null, empty and blank texts have no words and are never taken. Null sources are one source, the last. Rows equal in
    identifier, source and text are taken as often as all of them, with the columns of one (by a total order). An empty
    table stays empty; helper columns have names that no column of the table has."""
    return mixing.curriculum(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, number of ids and checksum of each row, read back from the shards, which are in the mix's order: a shard's
    keys are the rows' places in the table that was read, and its values hold the identifiers.

    Null and empty texts give the end id alone, null identifiers stay null, equal rows are all kept, long texts are whole,
    and an empty table gives no row; other columns are ignored."""
    import public_tokenizers

    shards = sstable.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), place=sstable.read_order(docs))
    return sstable.read_shards(shards)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mix_sources", mix_sources),
    ("token_shards", token_shards),
]

#: The learned rules, the near copies' links and the token ids have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents` below `sf_dir`; what each but the last keeps is written to the shared folder
    and read again, so that a lost executor costs a stage at most. Odd rows are as each stage says."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
