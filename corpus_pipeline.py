"""From raw documents to token ids: quality rules, near duplicates, duplicate passages, a source mix, and BPE.

Each stage takes (spark, docs, sf_dir), docs being what the stage before left, and returns a DataFrame; all but the last
return the columns of documents. Between stages rows are written as Parquet in the shared checkpoint folder, so that a
lost executor costs at most the stage at work; what a stage has read goes when the next one stands. An empty table gives
an empty table at every stage, and columns beside those of documents, whatever their names, are carried along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from reqlens.llm import bpe, jaccard, mixing, quality, substring
from reqlens.llm.common import ensure_checkpoint_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio of `labels`' trusted documents to all of docs.

    Null and empty texts have no words and go; repeated rows are judged alike, each for itself; nulls in other columns
    change nothing (a document with a null id can't be trusted, and is judged like others).
    """
    return quality.quality_rules(docs, table(spark, sf_dir, "labels"), keep_rows=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the least id: shingles of five words, similarity of 0.8 or more.

    Of rows equal in id and text one stays; rows with a null id and rows without words all stay.
    """
    return jaccard.one_of_each(docs, gram=5, similar=(80, 100))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that a document with a smaller id holds; n_chars follows the text.

    Texts that lose nothing stay to the letter, null too; rows with a null id lose nothing and take nothing; repeated
    rows lose the same.
    """
    return substring.without_duplicate_spans(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mix takes it: not at all, once or twice.

    Null sources are one source, the last; texts without words have size 0 and go with the hashes; rows equal in id,
    source and text are taken alike.
    """
    return mixing.mixed_rows(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row of the mix: doc_id, n_tokens, ids. Null and empty texts have none; no row is merged or dropped."""
    import public_tokenizers

    return bpe.bpe_encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard", near_duplicate_stage),
    ("substring_dedup", substring_stage),
    ("source_mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: The quality rules' hashed ratio and the tokenizer can't be put into SQL that ends in reasonable time.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. The result reads the last stage's folder, the only one that stays."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        now = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(now)
        if before:
            _delete(spark, before)
        docs, before = spark.read.parquet(now), now
    return docs
