"""The corpus pipeline: documents that stay and read well in a known language, one of each near-duplicate group, without repeated passages and
benchmark leaks, as token ids. Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs.

Stages keep all columns, also ones named like their own results, and rows with a null in any column but text; an empty table stays empty."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontaminate, jaccard, langid, repeats
from skein.llm.common import table, unused
from skein.shared import settle


def _apart(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names called something else, and how to call them back."""
    found = [c for c in names if c in docs.columns]
    clash = dict(zip(found, unused(docs, *[f"skein_own_{c}" for c in found]), strict=True))
    return docs.withColumnsRenamed(clash), {v: k for k, v in clash.items()}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those far from every learned language, go. Null and empty texts go."""
    own, back = _apart(docs, ("held_out", "lang_pred", "score", "bits", "accepted"))
    return langid.identify(own).where("accepted").select(*own.columns).withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at a similarity of 0.8 connect, the one with the smallest doc_id stays. Texts without words link
    with nothing. Rows that repeat that doc_id stay as well; rows with a null doc_id are left alone."""
    return jaccard.keep_one_of_each_group(docs, width=5, num=4, den=5, label="stage1")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes under a 100-byte string that stands earlier go; n_chars follows; a document of which nothing but space is left goes. Rows that repeat both
    doc_id and text are one document and change alike; rows with a null doc_id are left alone; a null text is an empty one."""
    own, back = _apart(docs, ("n_bytes", "kept", "n_removed", "n_spans"))
    done = repeats.remove_repeats(own, label="stage7", as_text=True).where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    if "n_chars" in own.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text")))
    return done.select(*own.columns).withColumnsRenamed(back)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which a benchmark passage leaks go. Null and empty texts have no leaks; repeated rows go or stay together."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of texts, and their number; a null text has none. Columns of the names token_ids and n_tokens are replaced."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.drop("text").withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("byte-level BPE", token_ids),
]

#: Character models, connected components and edit distances over whole tables are beyond one SQL statement; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = settle(docs, f"stage{i}")
    return docs
