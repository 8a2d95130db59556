"""The stages one by one on a small table, and the whole run."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cardwatch.llm.decontaminate import plain
from cardwatch.llm.queries import table
from cardwatch.sources.session import materialize

SMALL = "/root/testdata/sf0.01"


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def rows(spark, texts):
    given = [(i, t, "en", "src0", len(t) if t is not None else None) for i, t in texts]
    return spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long")


TAKEN = ["once", "alike", "hits", "toxic", "expected_severity", "n_lines", "row", "component", "a", "body", "key"]
BENCH = "Which of these seven rivers runs through the old town and then on to the northern sea?"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Own labels for ids from 100 on, and a benchmark of one item."""
    path = str(tmp_path_factory.mktemp("own"))
    labels = [(i, 0, int(i % 3 == 0)) for i in range(100, 160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def labelled():
    """Toxic texts share words, the others have words of their own."""
    bad = "idiot scum moron worthless stupid clown".split()
    return [(i, " ".join(bad[(i + j) % 6] if i % 3 == 0 else f"w{i}x{j}" for j in range(4)) + f" n{i}") for i in range(100, 160)]


def given(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [
        (1, " ".join(words)),
        (2, " ".join(words[:100] + ["x"] + words[101:])),
        (3, "a line that many share\nown words of three"),
        (4, "a line that many share\nown words of four"),
        (5, "before it\n" + BENCH.upper() + "\nafter it"),
        (6, None),
        (7, ""),
        (8, "idiot scum moron, you stupid worthless clown and loser"),
        (9, " ".join(words)),
        (9, " ".join(words)),
        (10, "word after word " * 30_000 + "\n" + BENCH),
        (None, "without an id"),
        *labelled(),
    ]
    df = rows(spark, texts)
    return df.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id")).alias(c) for c in TAKEN])


@pytest.mark.parametrize(
    "name, gone",
    [("toxicity", {8} | set(range(102, 160, 3))), ("near_duplicates", {2, 9}), ("decontamination", {5, 10}), ("line_dedup", set())],
)
def test_stages_keep_columns_and_clean_documents(spark, folder, name, gone):
    docs = given(spark)
    got = stage(name)(spark, docs, folder)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    found = got.collect()
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in found} == gone
    assert all(r[c] == (None if r.doc_id is None else f"{c} of {r.doc_id}") for r in found for c in TAKEN)
    texts = {r.doc_id: r.text for r in found}
    if name == "line_dedup":
        assert texts[3].startswith("a line") and texts[4] == "own words of four" and texts[6] == ""
        assert all(r.n_chars == len(r.text) for r in found)
    else:
        assert all(texts[d] == t for d, t in ((r.doc_id, r.text) for r in docs.collect()) if d in texts)


def test_last_stage(spark, folder):
    docs = given(spark)
    coded = stage("sentencepiece")(spark, docs, folder)
    assert coded.columns == ["doc_id", "n_pieces", "ids", "round_trip"]
    assert coded.where("round_trip").count() == docs.count()


def test_repeated_rows_become_one(spark):
    docs = rows(spark, [(1, "some words that stand here"), (1, "some words that stand here"), (None, "x"), (None, "x")])
    assert stage("near_duplicates")(spark, docs, SMALL).count() == 3


def test_near_duplicates_go_by_row(spark):
    first, other = [f"w{i}" for i in range(100)], [f"v{i}" for i in range(100)]
    clean = "a text of its own that nobody copied"
    docs = [
        (1, " ".join(first)),
        (5, " ".join([*first, "x"])),
        (5, clean),
        (7, " ".join(other)),
        (7, " ".join([*other, "y"])),
        (None, " ".join([*first, "z"])),
        (None, clean),
    ]
    got = [(r.doc_id, r.text) for r in stage("near_duplicates")(spark, rows(spark, docs), SMALL).collect()]
    assert {(1, docs[0][1]), (5, clean)} < set(got) and len(got) == 3
    assert {d for d, _ in got} == {1, 5, 7}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    assert stage(name)(spark, rows(spark, []), SMALL).count() == 0


def test_run(spark):
    """Every stage on what the one before kept: planted documents go by the text that the stage is given."""
    docs = start = materialize(table(spark, SMALL, "documents"))
    items = [plain(r.text) for r in table(spark, SMALL, "benchmark").collect()]
    toxic = {r.doc_id for r in table(spark, SMALL, "labels").where("toxic = 1").collect()}
    for name, function in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()} if name == "decontamination" else {}
        docs = materialize(function(spark, docs, SMALL))
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert len(toxic & left) < 0.2 * len(toxic)
        if name == "decontamination":
            held = {d for d, t in before.items() if any(x in plain(t) for x in items)}
            assert held and not held & left
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in got} == left and 0.6 * start.count() < len(left) < start.count()
    assert all(r.round_trip and r.n_pieces == len(r.ids) for r in got)
