"""Small tables with the awkward rows that every operator has to take."""

LONG = "word and more words. " * 4000

AWKWARD = [
    (1, "The first line of it\nA shared line, long enough\nshort", "x", 1, "c1"),
    (2, "  a SHARED line, long enough \nÀ shared line, long enough\nshort", "x", 2, "c2"),
    (3, None, None, None, None),
    (4, "", "x", 0, "c4"),
    (None, "A shared line, long enough", "x", 5, "c5"),
    (5, "A shared line, long enough\n\n\nA shared line, long enough\n", "y", 5, "c6"),
    (5, "A shared line, long enough\n\n\nA shared line, long enough\n", "y", 5, "c6"),
    (6, LONG, "y", 7, "c7"),
    (7, LONG + "\nlast line of this text", "y", 8, "c8"),
    (8, "\x1c\x85 é  <|endoftext|> 'S Ünïcödé ÄB́ İ \U0001f600", "z", 9, "c9"),
    (9, "\n", "z", 10, "c10"),
]
SCHEMA = "doc_id long, text string, n_lines string, pos int, id string"


def awkward(spark):
    """Extra columns have the names that operators might use inside."""
    return spark.createDataFrame(AWKWARD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
