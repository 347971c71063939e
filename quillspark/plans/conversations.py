"""Conversations: replayed state, scores of turns, result references and quota draws, with their SQL.

Each message stands for a turn. Its gold decision comes from its role, place and length, the predicted one from
other remainders of the length, so that predictions are right, wrong, invalid and incomplete by turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators.references import looked_up, registered
from quillspark.operators.turns import COUNTS, FLAGS, PROJECTED, SLOTS, projection_scores, projection_totals, turn_scores, turn_totals
from quillspark.plans.base import query
from quillspark.streaming.dialogue import replay_steps

DECISIONS = """d AS (SELECT conv_id, turn, role, length(text) AS n, CASE WHEN role = 'system' THEN 'CHAT' WHEN turn <= 1 AND role = 'user' THEN 'ACTIONABLE_GOAL' WHEN length(text) % 13 = 0 THEN 'CANCELLATION' WHEN length(text) % 19 = 0 THEN 'REJECTION' WHEN role = 'assistant' THEN 'CONFIRMATION' ELSE 'CONTINUATION' END AS mode FROM conversations),
g AS (SELECT *, CASE mode WHEN 'CHAT' THEN 'NO_GOAL' WHEN 'ACTIONABLE_GOAL' THEN 'OPEN_DRAFT' WHEN 'CANCELLATION' THEN 'CANCEL_DRAFT' WHEN 'REJECTION' THEN 'REJECT_DRAFT' WHEN 'CONFIRMATION' THEN 'CONFIRM_DRAFT' ELSE 'UPDATE_DRAFT' END AS operation FROM d),
p AS (SELECT *, n % 17 <> 0 AS valid, CASE WHEN n % 7 = 0 THEN 'QUESTION' ELSE mode END AS p_mode, CASE WHEN n % 7 = 0 THEN 'NO_GOAL' ELSE operation END AS p_operation FROM g)"""
STEPS = f"""{DECISIONS}, o AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE WHEN NOT valid OR p_operation = 'NO_GOAL' THEN 'none' ELSE lower(split_part(p_operation, '_', 1)) END AS op, 's' || (n % 3) AS slot, 'v' || (n % 4) AS value FROM p),
r AS (SELECT conv_id, 0::BIGINT AS k, 'empty' AS status, MAP {{}}::MAP(VARCHAR, VARCHAR) AS slots, NULL::MAP(VARCHAR, VARCHAR) AS agreed, '' AS note, '' AS op FROM o GROUP BY 1
 UNION ALL SELECT r.conv_id, o.k,
 CASE WHEN o.op = 'none' THEN r.status WHEN o.op = 'open' THEN 'open' WHEN r.status NOT IN ('open', 'ready') THEN r.status WHEN o.op = 'update' THEN CASE WHEN coalesce(r.slots[o.slot], '') = o.value THEN r.status ELSE 'open' END WHEN o.op = 'cancel' THEN 'cancelled' WHEN o.op = 'confirm' THEN 'ready' ELSE 'open' END,
 CASE WHEN o.op = 'open' THEN MAP {{o.slot: o.value}} WHEN o.op = 'update' AND r.status IN ('open', 'ready') THEN map_from_entries(list_sort(list_concat(list_filter(map_entries(r.slots), lambda e: e.key <> o.slot), [{{'key': o.slot, 'value': o.value}}]))) ELSE r.slots END,
 CASE WHEN o.op IN ('open', 'cancel', 'reject') AND (o.op = 'open' OR r.status IN ('open', 'ready')) THEN NULL WHEN o.op = 'confirm' AND r.status IN ('open', 'ready') THEN r.slots ELSE r.agreed END,
 CASE WHEN o.op NOT IN ('none', 'open') AND r.status NOT IN ('open', 'ready') THEN 'no_draft' ELSE '' END, o.op FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1),
s AS (SELECT o.conv_id, o.turn, r.status, CASE WHEN r.note <> '' THEN 'STATE_REJECTED' WHEN r.op = 'none' OR r.status IN ('empty', 'cancelled') THEN 'NO_ACTION' WHEN r.op = 'confirm' THEN 'CHECK_CONFIRMATION_BINDING' WHEN r.slots['s0'] IS NULL THEN 'ASK_USER' WHEN r.agreed IS NOT NULL AND r.agreed = r.slots THEN 'READY_TO_FINALIZE' ELSE 'REQUEST_CONFIRMATION' END AS next FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k)"""
SCORES = f"""{STEPS}, x AS (SELECT p.*, s.status, s.next, 's' || (n % 3) AS slot, 'v' || (n % 4) AS value, n % 8 = 0 AS by_ordinal, n % 10 = 0 AS by_rank, n % 3 = 0 AS refers, CASE WHEN n % 6 = 0 THEN 'w' ELSE 'V' || (n % 4) END AS p_value FROM p JOIN s USING (conv_id, turn)),
y AS (SELECT *, valid AND p_operation <> 'NO_GOAL' AS does, mode <> 'CHAT' AS wants, CASE WHEN n % 23 = 0 THEN 'ASK_USER' WHEN mode = 'CHAT' THEN 'NO_ACTION' WHEN mode = 'CONFIRMATION' THEN 'CHECK_CONFIRMATION_BINDING' ELSE 'READY_TO_FINALIZE' END AS wanted FROM x)
SELECT conv_id, turn, valid AND p_mode = mode AS mode_correct, valid AND p_operation = operation AS operation_correct, valid AND wants = does AS actionable_correct, valid AND n % 11 <> 0 AS action_correct, valid AND n % 9 <> 0 AS target_correct, valid AND next = wanted AS next_correct,
valid AND next = 'READY_TO_FINALIZE' AND wanted <> 'READY_TO_FINALIZE' AS material_false_ready_candidate, NOT wants AND does AS false_action, wants AND NOT does AS false_nonaction,
CASE WHEN valid THEN (n % 6 <> 0)::INT + (by_ordinal AND refers AND n % 5 <> 0)::INT + (by_rank AND refers AND n % 5 = 0)::INT ELSE 0 END AS slot_recall, 1 + by_ordinal::INT + by_rank::INT AS slot_expected,
CASE WHEN valid THEN greatest(0, (n % 4 < 2)::INT + (n % 4 = 0)::INT - (by_ordinal AND refers)::INT - (by_rank AND refers)::INT) ELSE 0 END AS slot_hallucinations, valid AS json_valid, CASE WHEN valid THEN status END AS state_status FROM y"""


def decisions(conversations: DataFrame) -> DataFrame:
    """Gold and predicted decisions of each message."""
    n = F.length("text")
    mode = F.when(F.col("role") == "system", "CHAT").when((F.col("turn") <= 1) & (F.col("role") == "user"), "ACTIONABLE_GOAL").when(n % 13 == 0, "CANCELLATION").when(n % 19 == 0, "REJECTION").when(F.col("role") == "assistant", "CONFIRMATION").otherwise("CONTINUATION")
    operation = F.when(F.col("mode") == "CHAT", "NO_GOAL").when(F.col("mode") == "ACTIONABLE_GOAL", "OPEN_DRAFT").when(F.col("mode") == "CANCELLATION", "CANCEL_DRAFT").when(F.col("mode") == "REJECTION", "REJECT_DRAFT").when(F.col("mode") == "CONFIRMATION", "CONFIRM_DRAFT").otherwise("UPDATE_DRAFT")
    n, text = F.col("n"), lambda head, x: F.concat(F.lit(head), x.cast("string"))
    slot, by_ordinal, by_rank = text("s", n % 3), n % 8 == 0, n % 10 == 0
    wanted = F.when(n % 23 == 0, "ASK_USER").when(F.col("mode") == "CHAT", "NO_ACTION").when(F.col("mode") == "CONFIRMATION", "CHECK_CONFIRMATION_BINDING").otherwise("READY_TO_FINALIZE")
    pair = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    entries = F.array_compact(F.array(pair(slot, text("v", n % 4)), F.when(by_ordinal, pair(F.lit("result_ordinal"), F.lit("2"))), F.when(by_rank, pair(F.lit("result_rank"), F.lit("cheapest")))))
    gold = F.struct("mode", "operation", F.lit("find").alias("action"), text("item", n % 10).alias("target"), F.map_from_entries(entries).alias("slots"), wanted.alias("next"))
    update = lambda k, v: F.struct(k.alias("slot"), v.alias("value"))
    updates = F.array_compact(F.array(update(F.concat(F.lit("fact."), slot), F.lit("stale")), update(F.concat(F.lit("fact."), slot), F.when(n % 6 == 0, "w").otherwise(text(" V", n % 4))), F.when(n % 4 < 2, update(F.lit("temporal.extra"), F.lit("x"))), F.when(n % 4 == 0, update(F.lit("external.more"), F.lit("x")))))
    reference = F.when(n % 3 == 0, F.struct(F.when(n % 5 == 0, "cheapest").otherwise("ordinal").alias("kind"), F.when(n % 5 == 0, 1).otherwise(2).alias("ordinal")))
    predicted = F.struct(F.when(n % 7 == 0, "QUESTION").otherwise(F.col("mode")).alias("mode"), F.when(n % 7 == 0, "NO_GOAL").otherwise(F.col("operation")).alias("operation"), F.when(n % 11 == 0, "book").otherwise(" FIND ").alias("action"), F.when(n % 9 == 0, "other").otherwise(text("ITEM", n % 10)).alias("target"), updates.alias("updates"), reference.alias("reference"))
    base = conversations.select("conv_id", "turn", "role", F.length("text").alias("n"), mode.alias("mode")).withColumn("operation", operation)
    return base.select("conv_id", "turn", gold.alias("gold"), F.when(n % 17 != 0, predicted).alias("predicted"), F.create_map(slot, text("v", n % 4)).alias("said"))


def stepped(d: DataFrame) -> DataFrame:
    """(conv_id, turn, status, next) by replay of the predicted decisions."""
    operation = F.coalesce(F.lower(F.substring_index("predicted.operation", "_", 1)), F.lit("no"))
    turns = d.select(F.col("conv_id").cast("string").alias("conversation"), "turn", F.when(operation == "no", "none").otherwise(operation).alias("operation"), F.lit("find").alias("action"), F.to_json("said").alias("slots"))
    return replay_steps(turns, ["s0"]).select(F.col("conversation").cast("long").alias("conv_id"), "turn", "status", "next")


@query("dialogue_steps", f"WITH RECURSIVE {STEPS} SELECT conv_id, turn, status, next FROM s")
def _(t):
    return stepped(decisions(t("conversations")))


def _scored(t) -> DataFrame:
    d = decisions(t("conversations"))
    return turn_scores(d.select("conv_id", "turn", "gold", "predicted").join(stepped(d), ["conv_id", "turn"]), ["conv_id", "turn"])


@query("turn_scores", f"WITH RECURSIVE {SCORES}")
def _(t):
    return _scored(t)


@query("turn_score_totals", f"WITH RECURSIVE t AS (WITH RECURSIVE {SCORES}) SELECT turn = 0 AS opening, count(*) AS turns, count(*) FILTER (WHERE json_valid) AS json_valid, count(*) FILTER (WHERE json_valid AND state_status <> 'STATE_REJECTED') AS schema_valid, {', '.join(f'sum({c}::INT)::BIGINT AS {c}' for c in FLAGS + COUNTS)} FROM t GROUP BY 1")
def _(t):
    return turn_totals(_scored(t).withColumn("opening", F.col("turn") == 0), ["opening"])


SHOWN = """v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, event_id, event_type, value FROM events),
i AS (SELECT user_id, turn, i + 1 AS ordinal, 'r' || ((event_id * 7 + i) % 60) AS ref, floor(value + i % 2) AS price, (event_id + i) % 7 <> 0 AS fit FROM v, (SELECT unnest(range(0, 4)) AS i) WHERE event_type = 'view' AND i <= event_id % 4),
w AS (SELECT *, CASE WHEN NOT fit THEN 'untrusted_or_unidentified' WHEN (turn, ordinal) > min(CASE WHEN fit THEN (turn, ordinal) END) OVER (PARTITION BY user_id, ref) THEN 'duplicate_identity' END AS why FROM i)"""


def _turns(t):
    """Events as turns of their user's conversation."""
    from quillspark.operators.tables import ranked_within

    return ranked_within(t("events").select("user_id", "ts", "event_id", "event_type", "value"), "user_id", ["ts", "event_id"], "turn")


def _shown(turns: DataFrame) -> DataFrame:
    item = lambda i: F.struct(F.concat(F.lit("r"), (F.col("event_id") * 7 + i) % 60).alias("ref"), F.floor(F.col("value") + i % 2).cast("double").alias("price"), ((F.col("event_id") + i) % 7 != 0).alias("trusted"))
    lists = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")), item)
    return registered(turns.where("event_type = 'view'").select(F.col("user_id").alias("conversation"), "turn", lists.alias("results")))


@query("result_registration", f"WITH {SHOWN} SELECT user_id, turn, ordinal, ref, price, why FROM w")
def _(t):
    return _shown(_turns(t)).select(F.col("conversation").alias("user_id"), "turn", F.col("ordinal").cast("long").alias("ordinal"), "ref", "price", "why")


@query("result_lookup", f"""WITH {SHOWN}, s AS (SELECT user_id, turn, count(*) AS n FROM w GROUP BY 1, 2), q AS (SELECT user_id, turn, event_type, 1 + event_id % 4 AS ordinal FROM v WHERE event_type IN ('click', 'purchase')),
l AS (SELECT q.*, (SELECT max(turn) FROM s WHERE s.user_id = q.user_id AND s.turn < q.turn) AS shown FROM q),
m AS (SELECT l.user_id, l.turn, l.event_type, l.ordinal, l.shown, min(CASE WHEN w.ordinal = l.ordinal THEN ref END) AS at_place, min(price) AS least FROM l LEFT JOIN w ON w.user_id = l.user_id AND w.turn = l.shown AND w.why IS NULL GROUP BY ALL),
c AS (SELECT m.*, (SELECT CASE WHEN count(*) = 1 THEN min(ref) END FROM w WHERE w.user_id = m.user_id AND w.turn = m.shown AND w.why IS NULL AND w.price = m.least) AS cheapest FROM m)
SELECT user_id, turn, CASE event_type WHEN 'click' THEN at_place ELSE cheapest END AS ref, CASE WHEN shown IS NULL THEN 'no_results' WHEN CASE event_type WHEN 'click' THEN at_place ELSE cheapest END IS NULL THEN 'not_uniquely_resolved' END AS why FROM c""")
def _(t):
    turns = _turns(t)
    asked = turns.where("event_type in ('click', 'purchase')").select(F.col("user_id").alias("conversation"), "turn", F.when(F.col("event_type") == "click", "ordinal").otherwise("cheapest").alias("kind"), (1 + F.col("event_id") % 4).cast("int").alias("ordinal"))
    return looked_up(asked, _shown(turns)).withColumnRenamed("conversation", "user_id")


@query("projection_totals", f"""WITH x AS (SELECT l_orderkey AS o, l_returnflag AS f, l_quantity::INT % 7 AS v, l_linenumber AS ln FROM lineitem), s AS (SELECT o, list(DISTINCT (f, v)) FILTER (WHERE ln % 2 = 1) AS a, list(DISTINCT (f, v)) FILTER (WHERE ln % 2 = 0) AS b, count(*) FILTER (WHERE ln % 2 = 1) AS goals, count(*) FILTER (WHERE ln % 2 = 0) AS more FROM x GROUP BY 1),
c AS (SELECT o_orderpriority AS panel, o % 9 <> 0 AS wants, o % 8 <> 0 AND o % 13 <> 0 AS does, CASE WHEN o % 9 = 0 THEN 0 ELSE goals END AS goals, more, o % 5 <> 0 AS same_action, o % 6 <> 0 AS same_target, o % 13 <> 0 AND o % 4 = 0 AS ready, o % 13 <> 0 AND o % 4 = 1 AS ask, o % 13 <> 0 AND o % 4 = 2 AS discover, o % 13 <> 0 AND o % 4 = 3 AS blocked, CASE WHEN o % 9 <> 0 THEN a ELSE [] END AS a, CASE WHEN o % 8 <> 0 AND o % 13 <> 0 THEN b ELSE [] END AS b FROM s JOIN orders ON o_orderkey = o)
SELECT panel, count(*) AS cases, {', '.join(f'sum(({e})::INT)::BIGINT AS {c}' for c, e in zip(PROJECTED, ['wants = does', 'does AND NOT wants', 'wants AND NOT does', 'goals > 0 AND does AND same_action', 'goals > 0 AND does AND same_target', 'CASE WHEN does THEN 1 + more ELSE 0 END = goals', 'ready', 'ask', 'discover', 'blocked'], strict=True))},
sum(CASE WHEN goals > 0 THEN len(list_intersect(a, coalesce(b, []))) ELSE 0 END)::BIGINT AS slot_tp, sum(CASE WHEN goals > 0 THEN len(a) ELSE 0 END)::BIGINT AS slot_gold, sum(len(coalesce(b, [])))::BIGINT AS slot_pred FROM c GROUP BY 1""")
def _(t):
    """Orders as cases: odd lines are what the contract wants, even ones what the decision says."""
    o, fact = F.col("l_orderkey"), F.struct(F.col("l_returnflag").alias("field"), (F.col("l_quantity").cast("int") % 7).alias("value"))
    odd = F.col("l_linenumber") % 2 == 1
    s = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(odd, fact)).alias("a"), F.collect_set(F.when(~odd, fact)).alias("b"), F.count_if(odd).alias("goals"), F.count_if(~odd).alias("more"))
    wants, valid = o % 9 != 0, o % 13 != 0
    gold = F.struct(wants.alias("task"), F.lit("find").alias("action"), F.lit("item").alias("target"), F.when(wants, F.col("goals")).otherwise(0).alias("goals"), F.col("a").alias("slots"))
    got = F.struct((o % 8 != 0).alias("task"), F.when(o % 5 != 0, "find").alias("action"), F.when(o % 6 != 0, "item").alias("target"), F.col("more"), F.col("b").alias("slots"))
    plan = F.struct(*((o % 4 == k).alias(c) for k, c in enumerate(("ready", "ask", "discover", "blocked"))))
    cases = s.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("panel")), "l_orderkey").select("panel", gold.alias("gold"), F.when(valid, got).alias("got"), F.when(valid, plan).alias("plan"))
    return projection_totals(projection_scores(cases, ["panel"]), ["panel"])


@query("mode_confusion", f"WITH {DECISIONS} SELECT mode AS gold_mode, CASE WHEN valid THEN p_mode END AS predicted_mode, count(*) AS n, count(*) FILTER (WHERE valid AND operation = p_operation) AS same_operation FROM p GROUP BY 1, 2")
def _(t):
    """Gold modes against predicted ones; a null predicted mode is an invalid decision."""
    d = decisions(t("conversations"))
    return d.groupBy(F.col("gold.mode").alias("gold_mode"), F.col("predicted.mode").alias("predicted_mode")).agg(F.count("*").alias("n"), F.count_if(F.col("gold.operation") == F.col("predicted.operation")).alias("same_operation"))


@query("conversation_audit", f"""WITH {DECISIONS}, s AS (SELECT conv_id, count(*) AS turns, count(DISTINCT mode) AS modes, count(*) FILTER (WHERE mode = 'ACTIONABLE_GOAL') AS opened, bool_or(mode = 'CONFIRMATION') AS confirmed, bool_or(mode IN ('CANCELLATION', 'REJECTION')) AS ended, count(*) FILTER (WHERE NOT valid) AS invalid FROM p GROUP BY 1)
SELECT turns, count(*) AS conversations, sum(modes)::BIGINT AS modes, sum(opened)::BIGINT AS opened, count(*) FILTER (WHERE opened > 1) AS reopened, count(*) FILTER (WHERE confirmed) AS confirmed, count(*) FILTER (WHERE ended) AS ended, count(*) FILTER (WHERE confirmed AND ended) AS confirmed_and_ended, sum(invalid)::BIGINT AS invalid_turns FROM s GROUP BY 1""")
def _(t):
    """Conversations by their number of turns: how many open, reopen, confirm and end drafts."""
    d = decisions(t("conversations")).select("conv_id", F.col("gold.mode").alias("mode"), F.col("predicted").isNull().alias("invalid"))
    is_ = lambda *m: F.col("mode").isin(*m)
    s = d.groupBy("conv_id").agg(F.count("*").alias("turns"), F.countDistinct("mode").alias("modes"), F.count_if(is_("ACTIONABLE_GOAL")).alias("opened"), F.bool_or(is_("CONFIRMATION")).alias("confirmed"), F.bool_or(is_("CANCELLATION", "REJECTION")).alias("ended"), F.count_if("invalid").alias("invalid"))
    return s.groupBy("turns").agg(F.count("*").alias("conversations"), F.sum("modes").alias("modes"), F.sum("opened").alias("opened"), F.count_if(F.col("opened") > 1).alias("reopened"), F.count_if("confirmed").alias("confirmed"), F.count_if("ended").alias("ended"), F.count_if(F.col("confirmed") & F.col("ended")).alias("confirmed_and_ended"), F.sum("invalid").alias("invalid_turns"))
