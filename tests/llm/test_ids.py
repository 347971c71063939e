"""Null and repeated ids: each row is a document of its own."""

from collections import Counter

from corpus_pipeline import decontaminate, mixing, near_dedup
from quillspark.llm.setsketch import near_duplicates

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(tag, n=60):
    return " ".join(f"{tag}{i}" for i in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], COLUMNS).repartition(3)


def test_near_duplicates_keeps_a_row_of_each_group(spark):
    near = prose("a", 59) + " other"
    rows = [(None, prose("a"))] * 3 + [(None, near), (None, prose("b")), (4, prose("c")), (None, prose("c")), (7, prose("d")), (7, prose("e")), (8, prose("e", 59) + " end"), (7, prose("d"))]
    got = near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    # groups: a and its near copy, b, c, d, e and its near copy
    assert sum(x.kept for x in got) == 5
    assert Counter((x.doc_id, x.component_id) for x in got) == {(None, None): 5, (4, 4): 1, (None, 4): 1, (7, 7): 3, (8, 7): 1}


def test_near_dedup_keeps_texts_of_their_own(spark):
    rows = [(None, prose("a"))] * 4 + [(4, prose("c")), (None, prose("c")), (7, prose("d")), (7, prose("e")), (3, prose("e")), (7, prose("d")), (9, prose("f"))]
    got = near_dedup(spark, table(spark, rows), "").collect()
    assert Counter((x.doc_id, x.text) for x in got) == Counter([(None, prose("a")), (4, prose("c")), (7, prose("d")), (3, prose("e")), (9, prose("f"))])


def test_decontaminate_takes_rows_not_ids(spark, tmp_path):
    spark.createDataFrame([(1, prose("x", 30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, prose("x", 30)), (None, prose("a")), (7, prose("x", 30)), (7, prose("b"))]
    got = decontaminate(spark, table(spark, rows), str(tmp_path)).collect()
    assert {(x.doc_id, x.text) for x in got} == {(None, prose("a")), (7, prose("b"))}


def test_mixing_takes_each_row_as_often_as_its_own_passes(spark):
    rows = [(None, prose("a"))] * 5 + [(7, prose("b"))] * 3 + [(7, prose("c")), (8, prose("d"))]
    got = mixing(spark, table(spark, rows), "").collect()
    # one source: each row is passed once
    assert Counter((x.doc_id, x.text) for x in got) == Counter(rows)
