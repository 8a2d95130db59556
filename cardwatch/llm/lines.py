"""Line deduplication with DataFrame functions only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.skew import join_by_key
from cardwatch.sources.session import materialize

#: White space stripped from both ends of a line: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(col):
    """A-Z lowered and nothing else; plain lower() does the same where all characters are ASCII, and is faster."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def row_key(id_col, text_col):
    """128 bits that identify a row by content: rows alike in id and text share it and get equal results."""
    return F.struct(
        F.xxhash64(id_col, text_col).alias("a"), F.xxhash64(F.lit(1), text_col, F.lit(2), id_col).alias("b")
    )


def drop_repeated_lines(docs: DataFrame, min_length: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines that other documents hold too, except in the document with the smallest id.

    A text is split at newlines; the key of a line is the line stripped of ASCII white space and with A-Z lowered.
    Keys of at least ``min_length`` code points that occur in two or more documents keep their lines only in the
    smallest id; all other lines stay in their order, joined by newlines.

    Returns the input's columns with ``text_col`` replaced, and ``n_lines`` and ``n_dropped``, which replace columns
    of those names. A null or empty text is one empty line and becomes an empty text. Rows with a null id are not
    documents: they keep all lines and do not count for others. Rows that share an id are one document, and each
    keeps its own row. An empty table gives an empty table.

    Two shuffles of small rows (one per line: hashes and position, never text) find the lines to drop: counting per
    hash is combined before the shuffle, so a line that a third of all documents share arrives as one row per task.
    Lines of such hot hashes then meet their count by a broadcast of bounded size, the others by a shuffle
    (``join_by_key``). The third shuffle brings each document its positions.
    """
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped", text_col)])
    kept = base.columns
    whole = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        whole.alias("body"),
        row_key(F.col(f"`{id_col}`"), whole).alias("key"),
    )
    lines = (
        named.where("id IS NOT NULL")
        .select("id", "key", F.posexplode(F.split(ascii_lower(F.col("body")), "\n", -1)).alias("pos", "line"))
        .select("id", "key", "pos", F.btrim("line", F.lit(SPACES)).alias("line"))
        .where(F.length("line") >= min_length)
        .select("id", "key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    )
    lines = materialize(lines)
    # Two documents hold a line where its smallest and largest document differ.
    ends = F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("size")
    shared = materialize(lines.groupBy("h1", "h2").agg(*ends).where("first < last").drop("last"))
    held = join_by_key(lines, shared, ["h1", "h2"], "size", lines.count())
    drops = held.where("id > first").groupBy("key").agg(F.collect_set("pos").alias("drops"))
    parts = F.split("body", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.coalesce("drops", F.array().cast("array<int>")))
    out = (
        named.join(drops, "key", "left")
        .withColumn("parts", parts)
        .withColumn("stay", stay)
        .select(
            "row",
            F.array_join(F.transform("stay", lambda i: F.get("parts", i)), "\n").alias("body"),
            F.size("parts").cast("long").alias("n_lines"),
            (F.size("parts") - F.size("stay")).cast("long").alias("n_dropped"),
        )
    )
    order = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(
        *[F.col("body").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in order], "n_lines", "n_dropped"
    )
