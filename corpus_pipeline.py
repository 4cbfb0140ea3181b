"""From documents to token files: the corpus pipeline over five operators of ``touchline.llm``.

Each stage takes the rows that the one before kept and returns whole documents with all their
columns; the last returns what it has read back from the token files. Columns that ``documents`` has besides
its own pass through all stages but the last, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from touchline.llm import common, decontamination, mixing, simhash, token_files, toxicity

ORACLE_SQL = None  # scores, fingerprints and files are beyond SQL; tests hold the stages against brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold. Null and empty texts have the score of a text without
    scored words, and stay. A row's fate is its text's, whatever its doc_id and however often it repeats."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates. Null and empty texts are one group, as are
    all texts of one fingerprint; of rows that tie in the smallest doc_id one stays."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark passages; those without words stay. Null and empty
    benchmark texts are in no document. Each row is judged by its own text, whatever rows repeat its id."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target shares of source, language and topic. Null sources and languages count
    as an empty name; texts without tokens stay; rows that repeat an id in a cell share their fate."""
    return mixing.sampled(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files written. Null and empty texts
    have the end id only; rows that repeat an id, or have none, are written each."""
    return token_files.read_documents(token_files.write_token_files(docs, token_files.tokenizer_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing_to_targets", mix),
    ("token_files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over the written rows of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
