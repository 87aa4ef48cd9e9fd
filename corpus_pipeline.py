"""The training-text pipeline: five operators, one after another, over all documents.

Every stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes it as Parquet to the shared folder and reads
it again for the next one. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallylens.llm import darts, lines, mixing, pieces, subwords
from tallylens.llm.tables import load
from tallylens.sources.files import staged

#: A document that the classifier finds this unlikely to be of label 1 goes.
REJECT = 0.3


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns under names that no operator gives to its own."""
    return docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"__column_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")])


def _back(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again."""
    return rows.select(*[F.col(c if c in ("doc_id", "text") else f"__column_{i}").alias(c) for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; null texts are scored as empty ones."""
    scorer = subwords.train(docs, load(spark, sf_dir, "labels", "doc_id", "quality"))
    return _back(subwords.score(_apart(docs), scorer).where(F.col("score") >= REJECT), docs)


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; n_chars follows the text. Emptied documents go, texts
    that were empty or null before stay."""
    left = lines.drop_lines(_apart(docs)).where("n_dropped = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    chars = f"__column_{docs.columns.index('n_chars')}"
    changed = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col(chars))
    return _back(left.withColumn(chars, changed), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest doc_id."""
    return darts.deduplicated(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: once per whole epoch, and once more if its budget ends inside or behind
    them in the last one. Documents that the mix does not reach go; documents without words stay once."""
    # repeated ids are told apart by their sizes, as the mix does
    taken = mixing.mix(docs).groupBy("doc_id", F.col("size").alias("__size")).agg(F.max("taken").alias("__taken"))
    times = F.when(F.col("__size") > 0, F.ceil(F.col("__taken") / F.col("__size"))).otherwise(1).cast("int")
    joined = docs.alias("d").join(taken.alias("t"), F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & (
        mixing.n_words(F.col("d.text")) == F.col("t.__size")))
    return joined.where(times > 0).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), times))).select(
        *[F.col(f"d.`{c}`") for c in docs.columns])


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the two checks of every row that is left."""
    return pieces.encode(docs.select("doc_id", "source", "text")).drop("text")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines_once),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", tokenised),
]

#: A trained classifier and a tokenizer cannot be written as SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage_{at}")
    return docs
