import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import jsonl


def put(path, rows, blank=False):
    path.write_text("\n".join(json.dumps(r) for r in rows) + ("\n\n" if blank else "\n"), encoding="utf-8")
    return str(path)


def test_lines_and_strict_rows(spark, tmp_path):
    p = put(tmp_path / "a.jsonl", [{"id": "x"}, {"id": "y"}], blank=True)
    assert [(r.line_no, json.loads(r.value)["id"]) for r in jsonl.read_lines(spark, p).orderBy("line_no").collect()] == [(1, "x"), (2, "y")]
    assert jsonl.read_jsonl(spark, p, schema="id string").count() == 2
    (tmp_path / "bad.jsonl").write_text('{"id": "x"}\n{"id": \n')
    with pytest.raises(Exception, match="(?i)malformed"):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schema="id string").collect()
    found = jsonl.read_existing(spark, [f"{tmp_path}/a*.jsonl", f"{tmp_path}/none*.jsonl"], "id string")
    assert found.count() == 2 and found.columns == ["id", "file"]
    assert jsonl.read_existing(spark, [f"{tmp_path}/none*"], "id string").count() == 0


def test_cases_of_both_shapes(spark, tmp_path):
    chat = [
        {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u1"}, {"role": "assistant", "content": "no"}, {"role": "user", "content": "u2"}, {"role": "assistant", "content": '{"a": 1}'}], "source_id": "s1", "tags": ["t"]},
        {"messages": [{"role": "user", "content": "only"}, {"role": "assistant", "content": "not json"}]},
    ]
    got = jsonl.cases(jsonl.read_jsonl(spark, put(tmp_path / "c.jsonl", chat), schema=jsonl.CHAT)).orderBy("text").collect()
    assert [(r.text, r.contract) for r in got] == [("only", None), ("u1", '{"a": 1}')]
    assert got[1].id == got[1].family == "s1" and len(got[0].id) == 16 and got[0].tags == []
    gold = jsonl.cases(jsonl.read_jsonl(spark, put(tmp_path / "g.jsonl", [{"id": "i", "text": "t", "contract": {"b": 2}, "family": "f"}]), schema=jsonl.CASE)).first()
    assert (gold.id, gold.text, json.loads(gold.contract), gold.family) == ("i", "t", {"b": 2}, "f")
    chats = spark.createDataFrame([("q", "{}")], "t string, c string").select(jsonl.as_chat(F.col("t"), F.col("c")).alias("messages"))
    assert jsonl.cases(chats).first().contract == "{}"


def test_sinks_and_fingerprints(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long")
    out = str(tmp_path / "out")
    jsonl.write_new(df, out)
    with pytest.raises(Exception, match="(?i)exists"):
        jsonl.write_new(df, out)
    sink = str(tmp_path / "sink")
    assert jsonl.append_missing(df.limit(1), sink, "id") == 1
    assert jsonl.append_missing(df, sink, "id") == 2
    assert jsonl.append_missing(df, sink, "id") == 2
    assert jsonl.write_report(df.orderBy("id"), str(tmp_path / "r")).splitlines()[2] == "| a | 1 |"
    assert jsonl.table_fingerprint(df) == jsonl.table_fingerprint(df.orderBy(F.desc("id")).repartition(3)) != jsonl.table_fingerprint(df.limit(1))
    last = jsonl.keyed(df.union(spark.createDataFrame([("a", 9)], df.schema)), "id", "n")
    assert {(r.id, r.n) for r in last.collect()} == {("a", 9), ("b", 2)}
    f = tmp_path / "f.txt"
    f.write_bytes(b"x\r\ny\n")
    h = jsonl.fingerprint(f)
    f.write_bytes(b"x\ny\n")
    jsonl.frozen({str(f): h})
    f.write_bytes(b"z")
    with pytest.raises(ValueError, match="changed"):
        jsonl.frozen({str(f): h})


def test_jobs_are_read_once(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.job").write_text(json.dumps({"name": f"n{i}"}))
    (tmp_path / "x.txt").write_text("{}")
    q = jsonl.job_stream(spark, str(tmp_path), "name string").writeStream.format("memory").queryName("jobs").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.name for r in spark.table("jobs").collect()) == ["n0", "n1", "n2"]
