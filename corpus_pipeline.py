"""Cleaning of a document table in five stages: STAGES lists them, run() applies them to the documents of a folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cardwatch.llm.decontaminate import find_items
from cardwatch.llm.lines import drop_repeated_lines, row_key
from cardwatch.llm.near_duplicates import near_duplicate_rows
from cardwatch.llm.pieces import decode, encode
from cardwatch.llm.queries import table, tokenizer_file
from cardwatch.llm.toxicity import add_severity, fit_severity
from cardwatch.sources.session import materialize


# All but the last stage return the columns of the documents, whatever their names: the input is carried in a struct.


def packed(docs: DataFrame) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the severity model does not reject; it is fitted on the labels of documents that are there.

    Whole texts count; null and empty ones have no features. Repeated rows and rows with a null id are judged by their
    texts like all others. Without labels of both kinds nothing is rejected."""
    model = fit_severity(docs, table(spark, folder, "labels"))
    return add_severity(packed(docs), model).where(~F.col("toxic")).select("row.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, without lines that a document with a smaller id holds; ``n_chars`` follows the text.

    Rows that share an id are one document; a null text becomes an empty one; rows with a null id keep their lines."""
    kept = drop_repeated_lines(packed(docs))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return kept.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of near duplicates, that with the smallest id, and of rows alike in id that with the smallest
    key of id and text. Rows that link with none stay, as do those with an empty text; rows alike in id and text are one
    document, of which any row stays. A null id comes after all others; rows with a null id that are alike in text stay
    or go together. Texts of any length count whole."""
    text = F.coalesce("text", F.lit(""))
    rows = materialize(near_duplicate_rows(docs).where("component IS NOT NULL"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b")
    ends = rows.groupBy("component").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
    gone = materialize(rows.join(ends, "component").where(order != F.col("first")).select("a", "b").distinct())
    key = row_key(F.col("doc_id").cast("long"), text)
    keyed = packed(docs).withColumn("alike", key)
    left = keyed.join(gone, (keyed["alike.a"] == gone["a"]) & (keyed["alike.b"] == gone["b"]), "left_anti")
    once = F.row_number().over(W.partitionBy("alike").orderBy(F.length(text)))
    return left.withColumn("once", once).where("once = 1 OR doc_id IS NULL").select("row.*")


def without_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, judged by the whole text that the earlier stages left.

    Null and empty texts hold none; repeated rows and null ids are judged by their texts; items alike count as one."""
    found = find_items(packed(docs), table(spark, folder, "benchmark"))
    return found.where(F.size("hits") == 0).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Piece ids of every document, with their number and whether decoding gives the text back. A null or empty text has
    none; repeated rows and null ids stay; texts of any length are encoded whole."""
    model = tokenizer_file("piece_bpe_32k.model")
    coded = decode(encode(docs.select("doc_id", "text"), model), model, into="decoded")
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]

#: SQL has no counterpart for the fitted model, the links, the edit distances or the pieces.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages over the documents; what each returns is a stored table that the next one reads."""
    docs = table(spark, folder, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, folder))
    return docs
