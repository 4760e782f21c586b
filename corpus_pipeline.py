"""The corpus pipeline: five stages over ``documents``, each applying one operator to all that its predecessor kept.

Every stage function takes ``(spark, docs, sf_dir)``; ``run`` writes a stage's
result as Parquet to the cluster's shared folder and rereads it for the next.
Rows are joined back by id and text, so rows without an id, or that share one,
are judged as themselves.

Defined cases, for every stage: null, empty and blank texts have no words; an
empty table gives an empty one; columns other than the operator's own pass
through (the last stage gives its own).  What that means is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulseframe.llm import _store, decontam, jaccard, packing, quality, substring


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: those without words too; rows of one id and text share their verdict's kind, and stay if one of them is kept."""
    own = docs.select("doc_id", "text", "lang", "source", F.xxhash64("text").alias("text_hash"))
    kept = quality.judge(own).filter("kept").select(F.col("doc_id").alias("id"), "text_hash").distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("text_hash")), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row of least id stays (no id ranks last; of one id the least text hash); rows without words are groups of their own, of which equal ones (same id and text) stay once."""
    found = jaccard.join(docs.select("doc_id", "text")).withColumn("no_id", F.col("doc_id").isNull())
    group = F.when(F.col("root").isNull(), F.struct("no_id", "doc_id", "text_hash"))
    first = found.groupBy("root", group.alias("own")).agg(F.min(F.struct("no_id", "doc_id", "text_hash")).alias("x"))
    key = ["__no_id", "__id", "__hash"]
    first = first.select(*(F.coalesce(F.col(f"x.{c}"), F.lit(0) if c == "doc_id" else F.col(f"x.{c}")).alias(k) for c, k in zip(("no_id", "doc_id", "text_hash"), key, strict=True)))
    keyed = docs.withColumns({"__no_id": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0)), "__hash": F.xxhash64("text")})
    # rows of one key lie together after the join, and only places are counted: texts don't go through an aggregate
    place = F.row_number().over(Window.partitionBy(*key).orderBy(key[0]))
    return keyed.join(first, key, "left_semi").withColumn("__place", place).filter("__place = 1").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; a document of which nothing is left goes with them. A text that loses nothing stays as it was, white space and all."""
    out = substring.remove_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    out = out.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    out = out.withColumns({"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))})
    return out.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; without benchmark items all stay."""
    out = decontam.find_leaks(docs, _store.table(spark, sf_dir, "benchmark"))
    return out.filter(F.size("leaks") == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: pieces with their token ids; an empty text is its end id."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("packing", pack_sequences),
]

#: The stages iterate, hash and tokenise; SQL can't say that, and the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _store.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with _store.scratch(spark) as keep:  # a stage's own tables go with it
            out = keep(_store.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if k:
            _store.discard(docs)
        docs = out
    return docs
