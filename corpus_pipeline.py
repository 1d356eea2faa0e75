"""The training-data pipeline over ``documents``: each stage's result is written as Parquet and read by the next one.

In every stage nulls may be in any column, ids may repeat, columns beyond those of ``documents`` are dropped whatever their
names, and an empty table gives an empty table. What else a stage does with such rows is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliolake.llm import bpe_codec, decontaminate, pii, simhash, toxicity
from foliolake.llm.common import drop, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones, doesn't call toxic. A null or empty text is
    judged as one that is short and has no words; rows are judged one by one, so copies stay copies. With no labelled row
    everything is kept."""
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.TARGETS)
    return toxicity.score(docs.select(COLUMNS), chain).where(F.col("p_toxic") < toxicity.THRESHOLD).select(COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one document, that with the smallest id; of several rows with this id, or with none
    where no row of the group has an id, the one with the smallest hash. Texts without words, null ones included, are one
    group. Rows of one id with unrelated texts are in different groups, and each group keeps one."""
    # 128 bits of a whole row: rows that share them are copies, and ids may repeat or be null.
    row = [x for c in COLUMNS for x in (F.col(c).isNull(), F.col(c))]
    docs = docs.select(*COLUMNS, F.xxhash64(*row).alias("_row"), F.xxhash64(F.lit(1), *row).alias("_row2"))
    found = simhash.near_duplicates(docs, keep=("_row", "_row2"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "_row2")).alias("first"))
    kept = docs.join(first.select("first._row", "first._row2").hint("merge"), ["_row", "_row2"], "left_semi")
    return kept.dropDuplicates(["_row", "_row2"]).select(COLUMNS)  # the join has dealt the rows by these


def not_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a contaminating share of benchmark words. A text without words is kept; every row is judged by its
    own text."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(COLUMNS[1:]))
    return found.where(~F.col("contaminated")).select(COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced by its kind, and n_chars counted again. A null text stays null, with its
    n_chars."""
    found = pii.find(docs.select(COLUMNS)).withColumn("text", pii.redacted(F.col("text"), F.col("pii")))
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids and their number; its text is what the ids decode to. A null text has no ids, and its decoded
    text is empty."""
    ids = bpe_codec.encode(docs.select(COLUMNS))
    out = bpe_codec.decode(ids).withColumn("text", F.col("decoded").cast("string"))
    return out.select(*COLUMNS, "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES = [
    ("toxicity", not_toxic),
    ("simhash", one_of_each),
    ("decontamination", not_contaminated),
    ("personal_data", without_personal_data),
    ("bpe", tokens),
]

#: The toxicity models are trained: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if last is not None:
            drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
