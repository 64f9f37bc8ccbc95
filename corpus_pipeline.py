"""From raw documents to tokens in five stages; each works on all that the one before kept.

quality rules: documents with too few words, too much repetition or too many symbols go.
near duplicates: one document of each SimHash component stays, the one with the least doc_id.
decontamination: documents with a verbatim passage of a benchmark item go.
personal data: spans and the terms that reveal them are generalised in the text.
tokens: each text's byte-level BPE ids, as counts and digests, with the digest of what they decode to.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import byte_bpe, decontamination, pii, quality, simhash
from folioscope.llm.common import saved


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return byte_bpe.digests(byte_bpe.encoded(docs, file.read(), public_tokenizers.PATTERN))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("byte-level BPE", byte_level_bpe),
]

#: SQL has neither suffix arrays, XXH64 nor BPE merges; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each earlier stage is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
