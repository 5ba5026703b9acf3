"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs; all but the last return the columns of docs. run() applies them to the table documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statlens.llm import decontaminate, language, mixing, ngram_join, packing
from statlens.llm.common import cut, table

#: A document whose main language has a smaller share of its words is rejected.
LEAST_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (no letters) or with none that prevails. Learns from all documents that name theirs;
    where none does, nothing can be told and only documents without letters go."""
    model = language.Model.fit(cut(language.count(docs, F.lit(True)), "trigrams"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    found = language.identify(rows, model)
    known = (F.col("language.lang_pred") != "und") & (F.col("language.score") >= LEAST_SHARE)
    if not model.languages:
        known = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return found.filter(known).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies."""
    return ngram_join.one_of_each(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, as it is or edited."""
    return decontaminate.clean(docs, decontaminate.prepared(docs, table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: documents repeated by epochs, the last one of a source cut at its budget."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    out = mixing.repeated(mixing.mix(rows))
    fresh = {"text": F.col("text"), "n_chars": F.when(F.col("text").isNotNull(), F.length("text").cast("long"))}
    return out.select(*[fresh.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids with their segments."""
    return packing.pack(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]

#: The stages learn and align; no SQL says that. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
