"""The corpus pipeline: documents pass five stages; each works on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame,
which is written as Parquet and reread as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roundtide.llm import decontaminate, linededup, mixing, neardup, toxicity
from roundtide.llm.common import stage_table

#: Wanted token shares of what labels call good and plain documents.
TARGETS = {"good": 0.7, "plain": 0.3}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not listed; null ids stay."""
    gone = ids.select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name += "_"
    return name


def toxic_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go; labels come from the labels table."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def repeated_lines_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 or more characters in five or more documents stay in the newest of them only."""
    changed = linededup.dedup_lines(docs, min_length=40, min_docs=5)
    return changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_duplicates_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, the smallest id stays."""
    return _without(docs, neardup.near_duplicates(docs, width=5, percent=80).where("not kept"))


def benchmark_documents_go(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return _without(docs, decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark")).select("doc_id").distinct())


def mixed_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its rate and copies for the target mix; those of rate 0 are not part of it.

    Adds the columns domain, rate and copies, with underscores where documents have such a column.
    """
    labels = _table(spark, sf_dir, "labels").where(F.coalesce("toxic", F.lit(0)) != 1)
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    rates = mixing.mix(docs, labels.select("doc_id", domain.alias("domain")), TARGETS)
    added = {c: _free(c, docs.columns) for c in ("domain", "rate", "copies")}
    key = _free("rated_id", docs.columns)
    rates = rates.where("rate > 0").select(F.col("doc_id").alias(key), *[F.col(c).alias(n) for c, n in added.items()])
    return docs.join(rates, docs["doc_id"].cast("long").eqNullSafe(rates[key])).drop(key)


STAGES = [
    ("toxicity", toxic_documents_go),
    ("line dedup", repeated_lines_go),
    ("near duplicates", near_duplicates_go),
    ("benchmark decontamination", benchmark_documents_go),
    ("mixing", mixed_to_targets),
]

#: Training and similarity search have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage_table(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
