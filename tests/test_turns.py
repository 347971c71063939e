"""Turn scores against plain Python, folds of long conversations, and the stream with expiry."""

import json
import random
import resource

import pytest
from pyspark.sql import functions as F

from quillspark.operators.fold import fold
from quillspark.operators.turns import ACTIONABLE, COUNTS, FLAGS, NOT_READY, READY, turn_scores, turn_totals
from quillspark.streaming.dialogue import Draft, follow, replay, replay_steps, upgraded

TURN = "id long, gold struct<mode:string,operation:string,action:string,target:string,slots:map<string,string>,next:string>, predicted struct<mode:string,operation:string,action:string,target:string,updates:array<struct<slot:string,value:string>>,reference:struct<kind:string,ordinal:int>>, status string, next string"


def plain(x):
    return None if x is None else x.strip().lower()


def scored(gold, got, status, after):
    """Twelve metrics of one turn, step by step."""
    mode, operation, action, target, slots, wanted = gold
    wants = mode in ACTIONABLE
    out = dict.fromkeys(FLAGS, False) | dict.fromkeys(COUNTS, 0) | {"slot_expected": len(slots), "false_nonaction": wants, "json_valid": got is not None, "state_status": None}
    if got is None:
        return out
    does = got[1] != "NO_GOAL"
    said = {}
    for slot, value in got[4] or []:
        said[slot.split(".", 1)[-1]] = value
    hits = sum(1 for k, v in slots.items() if plain(said.get(k)) == plain(v))
    extra = sum(1 for k in said if k not in slots)
    if got[5] is not None:
        if "result_ordinal" in slots:
            hits += (None if got[5][1] is None else str(got[5][1])) == slots["result_ordinal"]
            extra = max(0, extra - 1)
        if "result_rank" in slots:
            hits += got[5][0] == "cheapest"
            extra = max(0, extra - 1)
    return out | {
        "mode_correct": got[0] == mode, "operation_correct": got[1] == operation, "actionable_correct": wants == does, "action_correct": plain(got[2]) == plain(action), "target_correct": plain(got[3]) == plain(target),
        "slot_recall": hits, "slot_hallucinations": extra, "next_correct": after == wanted, "material_false_ready_candidate": after in READY and wanted in NOT_READY, "false_action": not wants and does, "false_nonaction": wants and not does, "state_status": status,
    }


def turns(n=400, seed=1):
    r = random.Random(seed)
    names, values = ["a", "b", "result_ordinal", "result_rank", "c.d"], ["x", " X ", "2", "y", None, ""]
    out = []
    for i in range(n):
        slots = {k: r.choice(["x", "2", "y", None]) for k in r.sample(names, r.randint(0, 3))}
        gold = (r.choice([*ACTIONABLE, "CHAT", "META"]), r.choice(["NO_GOAL", "OPEN_DRAFT"]), r.choice(["find", None]), r.choice(["train", None]), slots, r.choice([*NOT_READY, *READY]))
        updates = [(f"{r.choice(['fact', 'temporal'])}.{r.choice(names)}", r.choice(values)) for _ in range(r.randint(0, 4))]
        got = (r.choice([*ACTIONABLE, "CHAT"]), r.choice(["NO_GOAL", "OPEN_DRAFT"]), r.choice(["Find ", "book", None]), r.choice(["TRAIN", None]), r.choice([updates, None]), r.choice([None, ("ordinal", 2), ("cheapest", None)]))
        out.append((i, gold, None if r.random() < 0.1 else got, r.choice(["open", "STATE_REJECTED"]), r.choice([*NOT_READY, *READY])))
    return out


def test_turn_scores_are_those_of_plain_python(spark):
    rows = turns()
    got = {r.id: r.asDict() for r in turn_scores(spark.createDataFrame(rows, TURN), ["id"]).collect()}
    for i, gold, predicted, status, after in rows:
        assert got[i] == {"id": i, **scored(gold, predicted, status, after)}, (gold, predicted)


def test_turn_totals_add_up_by_group(spark):
    rows = turns(200, 2)
    scores = turn_scores(spark.createDataFrame(rows, TURN), ["id"]).withColumn("half", F.col("id") % 2)
    got = {r.half: r.asDict() for r in turn_totals(scores, ["half"]).collect()}
    for half in (0, 1):
        mine = [scored(*r[1:]) for r in rows if r[0] % 2 == half]
        for c in FLAGS + COUNTS:
            assert got[half][c] == sum(m[c] for m in mine)
        assert got[half]["turns"] == len(mine) and got[half]["json_valid"] == sum(m["json_valid"] for m in mine)
        assert got[half]["schema_valid"] == sum(m["json_valid"] and m["state_status"] != "STATE_REJECTED" for m in mine)
    assert turn_totals(scores.limit(0), []).first().turns == 0


def test_fold_holds_one_state(spark):
    """A conversation of 300,000 turns is read batch by batch: a worker doesn't grow with it."""
    rows = spark.range(300_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(-1).cast("string").alias("key"), "id", F.lit("x" * 200).alias("text"))

    def step(state, row):
        state[0] += len(row["text"])
        return row["key"], row["id"], state[0], resource.getrusage(resource.RUSAGE_SELF).ru_maxrss

    out = fold(rows, "key", ["id"], lambda: [0], step, "key string, id long, total long, mb long")
    hot = out.where("key = '-1'").agg(F.count("*").alias("n"), F.max("total").alias("total"), (F.max("mb") - F.min("mb")).alias("grown")).first()
    assert (hot.n, hot.total) == (297_000, 297_000 * 200)
    assert hot.grown < 60_000  # kB
    assert out.where("key <> '-1' and total <> 200").count() == 0


def test_replay_steps(spark):
    ops = [("open", {"to": "B"}), ("update", {"from": "A"}), ("confirm", {}), ("none", {}), ("update", {"to": "C"}), ("reject", {}), ("cancel", {}), ("update", {"to": "D"}), ("open", {"from": "A", "to": "B"})]
    rows = [("c", i, op, "find", json.dumps(s)) for i, (op, s) in enumerate(ops)]
    got = [(r.status, r.next) for r in replay_steps(spark.createDataFrame(rows, "conversation string, turn long, operation string, action string, slots string"), ["from", "to"]).orderBy("turn").collect()]
    assert got == [("open", "ASK_USER"), ("open", "REQUEST_CONFIRMATION"), ("ready", "CHECK_CONFIRMATION_BINDING"), ("ready", "NO_ACTION"), ("open", "REQUEST_CONFIRMATION"), ("open", "REQUEST_CONFIRMATION"), ("cancelled", "NO_ACTION"), ("cancelled", "STATE_REJECTED"), ("open", "REQUEST_CONFIRMATION")]


def test_state_of_an_older_version_is_taken_over():
    old = json.dumps({"version": 0, "status": "ready", "action": "find", "slots": {"a": "1"}, "revision": 3, "last_turn": 7, "confirmed": True})
    draft = upgraded(old)
    assert (draft.status, draft.slots, draft.revision, draft.last_turn, draft.confirmed, draft.version) == ("open", {"a": "1"}, 3, 7, False, 1)
    assert upgraded(Draft(status="open").dump()) == Draft(status="open")
    with pytest.raises(ValueError, match="version 9"):
        upgraded(json.dumps({"version": 9}))


DDL = "conversation string, turn long, operation string, action string, slots string, at timestamp"


def run(spark, tmp_path, batches, **options):
    source = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = follow(spark.readStream.schema(DDL).option("maxFilesPerTrigger", 1).parquet(source), **options)
    for rows in batches:
        spark.createDataFrame(rows, DDL).coalesce(1).write.mode("append").parquet(source)
        query = stream.writeStream.foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out")))
        q = query.option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    return [tuple(r)[:7] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch", "conversation", "turn").collect()]


def at(hour, day=1):
    from datetime import datetime

    return datetime(2024, 1, day, hour)


def test_stream_notes_late_turns_and_lets_idle_conversations_end(spark, tmp_path):
    batches = [
        [("x", 0, "open", "find", '{"a": "1"}', at(8)), ("x", 2, "update", None, '{"b": "2"}', at(9)), ("y", 0, "open", "find", None, at(8))],
        [("x", 1, "cancel", None, None, at(9)), ("y", 1, "confirm", None, None, at(10))],
        [("z", 0, "open", "find", None, at(8, 4))],
        [("z", 1, "none", None, None, at(9, 4))],
        [("x", 3, "update", None, '{"c": "3"}', at(10, 4))],
    ]
    got = run(spark, tmp_path, batches, idle="1 day", late="2 hours")
    x, y = ([r[1:] for r in got if r[0] == c] for c in "xy")
    assert [(r[0], r[1], r[5]) for r in x] == [(0, "open", ""), (2, "open", ""), (1, "open", "late_turn"), (2, "expired", "expired"), (3, "empty", "no_draft")]
    assert json.loads(x[3][3]) == {"a": "1", "b": "2"}
    assert [(r[1], r[4], r[5]) for r in y] == [("open", False, ""), ("ready", True, ""), ("expired", True, "expired")]
    assert not [r for r in got if r[0] == "z" and r[2] == "expired"]
    batch = {tuple(r) for r in replay(spark.createDataFrame([r for b in batches[:1] for r in b], DDL)).collect()}
    assert batch == {r for r in got if r[6] == "" and r[1] in (0, 2) and r[0] in "xy"}
