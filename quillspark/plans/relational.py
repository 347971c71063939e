"""Matching, scoring, window, sampling and relational queries over the star-schema and event tables."""

from __future__ import annotations

from pyspark.sql import Column, Window, functions as F

from quillspark.operators import planner, requests, scoring, validate
from quillspark.operators.asof import running_min
from quillspark.operators.draws import first_of_groups, round_robin
from quillspark.operators.matching import multiset_counts, rank_join, ratio, two_pass
from quillspark.operators.splits import hash_order
from quillspark.operators.tables import ranked, ranked_within
from quillspark.plans.base import query

# lineitem in two halves, as expected and predicted facts of an order
SIDES = "e AS (SELECT l_orderkey AS c, l_returnflag AS p, CAST(l_quantity AS INT) % 7 AS v, l_linenumber AS pos FROM lineitem WHERE l_linenumber % 2 = 1), g AS (SELECT l_orderkey AS c, l_returnflag AS p, CAST(l_quantity AS INT) % 7 AS v, l_linenumber AS pos FROM lineitem WHERE l_linenumber % 2 = 0)"


def _fact(field: Column, op: Column, value: Column) -> Column:
    """A hard fact with a number, as parsed contracts hold it."""
    none = F.lit(None).cast("string")
    return F.struct(field.alias("field"), op.alias("op"), value.cast("string").alias("value"), F.lit("n").alias("value_kind"), none.alias("value_to"), none.alias("value_to_kind"), none.alias("unit"), none.alias("currency"), F.lit("hard").alias("strength"))


def _sides(t):
    x = t("lineitem").select(F.col("l_orderkey").alias("c"), F.col("l_returnflag").alias("p"), (F.col("l_quantity").cast("int") % 7).alias("v"), F.col("l_linenumber").alias("pos"))
    return x.where("pos % 2 = 1"), x.where("pos % 2 = 0")


@query("multiset_prf", f"WITH {SIDES}, ec AS (SELECT c, p, v, count(*) AS e FROM e GROUP BY ALL), gc AS (SELECT c, p, v, count(*) AS g FROM g GROUP BY ALL), b AS (SELECT c, coalesce(e, 0) AS e, coalesce(g, 0) AS g FROM ec FULL JOIN gc USING (c, p, v)), s AS (SELECT c AS l_orderkey, sum(least(e, g))::BIGINT AS tp, sum(g - least(e, g))::BIGINT AS fp, sum(e - least(e, g))::BIGINT AS fn FROM b GROUP BY 1) SELECT *, CASE WHEN tp + fp = 0 THEN 1.0::DOUBLE ELSE tp::DOUBLE / (tp + fp)::DOUBLE END AS prec, CASE WHEN tp + fn = 0 THEN NULL ELSE tp::DOUBLE / (tp + fn)::DOUBLE END AS recall FROM s")
def _(t):
    e, g = _sides(t)
    s = multiset_counts(e, g, ["c"], ["p", "v"]).withColumnRenamed("c", "l_orderkey")
    return s.withColumn("prec", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), None))


@query("rank_join_match", f"WITH {SIDES}, er AS (SELECT *, row_number() OVER (PARTITION BY c, p, v ORDER BY pos) AS k FROM e), gr AS (SELECT *, row_number() OVER (PARTITION BY c, p, v ORDER BY pos) AS k FROM g) SELECT c, p, v, er.pos AS expected_at, gr.pos AS got_at FROM er FULL JOIN gr USING (c, p, v, k)")
def _(t):
    return rank_join(*_sides(t), ["c", "p", "v"], "pos").drop("rank")


@query("two_pass_match", f"""WITH {SIDES}, er AS (SELECT *, row_number() OVER (PARTITION BY c, p, v ORDER BY pos) AS k FROM e), gr AS (SELECT *, row_number() OVER (PARTITION BY c, p, v ORDER BY pos) AS k FROM g), f AS (SELECT c, p, er.pos AS a, gr.pos AS b FROM er FULL JOIN gr USING (c, p, v, k)),
le AS (SELECT c, p, a, row_number() OVER (PARTITION BY c, p ORDER BY a) AS k FROM f WHERE b IS NULL), lg AS (SELECT c, p, b, row_number() OVER (PARTITION BY c, p ORDER BY b) AS k FROM f WHERE a IS NULL)
SELECT c, p, a AS expected_at, b AS got_at, 'tp' AS kind FROM f WHERE a IS NOT NULL AND b IS NOT NULL UNION ALL SELECT c, p, a, b, CASE WHEN a IS NULL THEN 'fp' WHEN b IS NULL THEN 'fn' ELSE 'value_error' END FROM le FULL JOIN lg USING (c, p, k)""")
def _(t):
    return two_pass(*_sides(t), ["c", "p", "v"], ["c", "p"], "pos")


@query("set_scores", f"WITH {SIDES}, x AS (SELECT c, list_distinct(list(v)) AS s FROM e GROUP BY 1), y AS (SELECT c, list_distinct(list(v)) AS s FROM g GROUP BY 1) SELECT c, len(list_intersect(x.s, y.s)) AS tp, len(x.s) AS n_expected, len(y.s) AS n_got FROM x JOIN y USING (c)")
def _(t):
    e, g = _sides(t)
    x = e.groupBy("c").agg(F.collect_set("v").alias("x")).join(g.groupBy("c").agg(F.collect_set("v").alias("y")), "c")
    return x.select("c", F.size(F.array_intersect("x", "y")).cast("long").alias("tp"), F.size("x").cast("long").alias("n_expected"), F.size("y").cast("long").alias("n_got"))


@query("positional_alignment", f"WITH {SIDES}, x AS (SELECT c, p, v, row_number() OVER (PARTITION BY c ORDER BY p, v, pos) AS k FROM e), y AS (SELECT c, p, v, row_number() OVER (PARTITION BY c ORDER BY p, v, pos) AS k FROM g) SELECT c, count(*) AS slots, count(*) FILTER (WHERE x.p = y.p AND x.v = y.v) AS equal FROM x FULL JOIN y USING (c, k) GROUP BY 1")
def _(t):
    e, g = _sides(t)
    w = Window.partitionBy("c").orderBy("p", "v", "pos")
    x, y = (s.select("c", F.row_number().over(w).alias("k"), F.struct("p", "v").alias(n)) for s, n in ((e, "x"), (g, "y")))
    return x.join(y, ["c", "k"], "full").groupBy("c").agg(F.count("*").alias("slots"), F.count_if(F.col("x") == F.col("y")).alias("equal"))


@query("completeness_join", "SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS unlabelled, count(*) FILTER (WHERE d.doc_id IS NULL) AS unknown, count(*) FILTER (WHERE d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS matched FROM documents d FULL JOIN labels l USING (doc_id)")
def _(t):
    d = t("documents").select("doc_id", F.lit(1).alias("d")).join(t("labels").select("doc_id", F.lit(1).alias("l")), "doc_id", "full")
    return d.agg(F.count_if(F.col("l").isNull()).alias("unlabelled"), F.count_if(F.col("d").isNull()).alias("unknown"), F.count_if(F.col("d").isNotNull() & F.col("l").isNotNull()).alias("matched"))


@query("failure_taxonomy", "SELECT event_type AS error, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'low', count(*) FROM events WHERE value < 10 HAVING count(*) > 0")
def _(t):
    return scoring.taxonomy(t("events").select(F.array_compact(F.array("event_type", F.when(F.col("value") < 10, "low"))).alias("errors")), "errors")


@query("reason_counts", "SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN value < 10 THEN 'low' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN user_id % 7 = 0 THEN 'held' END], lambda x: x IS NOT NULL)) AS reason FROM events) GROUP BY 1")
def _(t):
    r = F.array_compact(F.array(F.when(F.col("value") < 10, "low"), F.when(F.col("event_type") == "error", "error"), F.when(F.col("user_id") % 7 == 0, "held")))
    return t("events").select(F.explode(r).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("running_best", "SELECT event_id, user_id, min(value) OVER w AS best, value = min(value) OVER w AS is_best FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def _(t):
    x = running_min(t("events").select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", "best")
    return x.select("event_id", "user_id", "best", (F.col("value") == F.col("best")).alias("is_best"))


@query("rise_detector", "SELECT event_id FROM (SELECT event_id, value, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE value > a AND a > b")
def _(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = t("events").select("event_id", "value", F.lag("value", 1).over(w).alias("a"), F.lag("value", 2).over(w).alias("b"))
    return x.where("value > a AND a > b").select("event_id")


@query("throughput_rollup", "WITH last AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1, 2) SELECT event_type, count(*) AS users, round(avg(v), 4) AS mean_last, max(v) AS max_last FROM last GROUP BY 1")
def _(t):
    last = t("events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    return last.groupBy("event_type").agg(F.count("*").alias("users"), F.round(F.avg("v"), 4).alias("mean_last"), F.max("v").alias("max_last"))


@query("grouped_totals", "SELECT event_type, user_id % 4 AS panel, count(*) AS n, grouping_id(event_type, user_id % 4) AS level FROM events GROUP BY GROUPING SETS ((event_type, user_id % 4), (event_type), ())")
def _(t):
    e = t("events").withColumn("panel", F.col("user_id") % 4)
    return e.groupingSets([["event_type", "panel"], ["event_type"], []], "event_type", "panel").agg(F.count("*").alias("n"), F.grouping_id("event_type", "panel").alias("level"))


@query("histogram", "SELECT l_linenumber AS facts, count(*) AS n FROM (SELECT l_orderkey, max(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1) GROUP BY 1 ORDER BY 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("facts")).groupBy("facts").agg(F.count("*").alias("n")).orderBy("facts")


@query("regression_vs_previous", "WITH r AS (SELECT o_orderpriority AS tag, year(o_orderdate) * 12 + month(o_orderdate) AS report, count(*) FILTER (WHERE o_orderstatus = 'F') * 1000 // count(*) AS rate FROM orders GROUP BY 1, 2), l AS (SELECT *, lag(rate) OVER (PARTITION BY tag ORDER BY report) AS before, lead(report) OVER (PARTITION BY tag ORDER BY report) AS next FROM r) SELECT tag, before, rate FROM l WHERE next IS NULL AND rate - before < -10")
def _(t):
    r = t("orders").groupBy(F.col("o_orderpriority").alias("tag"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("report")).agg(F.floor(F.count_if(F.col("o_orderstatus") == "F") * 1000 / F.count("*")).alias("rate"))
    return scoring.regressions(r, "tag", "report", "rate", 10)


@query("best_report", "WITH r AS (SELECT o_orderpriority AS tag, count(*) FILTER (WHERE o_orderstatus = 'F') AS good, count(*) FILTER (WHERE o_orderstatus = 'P') AS bad FROM orders GROUP BY 1) SELECT tag, good, bad FROM r ORDER BY good DESC, bad, tag LIMIT 1")
def _(t):
    s = F.col("o_orderstatus")
    r = t("orders").groupBy(F.col("o_orderpriority").alias("tag")).agg(F.count_if(s == "F").alias("good"), F.count_if(s == "P").alias("bad"))
    return scoring.best(r, ["good"], ["bad"], "tag")


HASHED = "md5(CAST({} AS VARCHAR))"


@query("quota_sample", f"SELECT o_orderkey, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {HASHED.format('o_orderkey')}, o_orderkey) AS k FROM orders) WHERE k <= 20")
def _(t):
    x = t("orders").select("o_orderkey", "o_orderpriority", hash_order(F.col("o_orderkey")).alias("place"))
    return first_of_groups(x, ["o_orderpriority"], ["place", "o_orderkey"], 20).drop("place")


@query("round_robin_draw", f"SELECT o_orderkey, k, o_orderpriority FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {HASHED.format('o_orderkey')}, o_orderkey) AS k FROM orders) ORDER BY k, o_orderpriority LIMIT 33")
def _(t):
    return round_robin(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 33).withColumnRenamed("turn", "k")


@query("seeded_shuffle", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256(CAST(p_partkey AS VARCHAR) || ':7')) AS place FROM part")
def _(t):
    key = F.sha2(F.concat(F.col("p_partkey").cast("string"), F.lit(":7")), 256)
    return ranked_within(t("part").select("p_partkey", "p_brand", key.alias("key")), "p_brand", ["key"], "place").select("p_partkey", "place")


@query("family_split", "WITH f AS (SELECT p_brand, row_number() OVER (ORDER BY md5(p_brand), p_brand) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)) SELECT p_partkey, CASE WHEN k * 10 <= n * 2 THEN 'valid' ELSE 'train' END AS split FROM part JOIN f USING (p_brand)")
def _(t):
    f = t("part").select("p_brand").distinct()
    n = f.agg(F.count("*").alias("n"))
    f = ranked(f, [F.md5(F.col("p_brand").cast("binary")), "p_brand"], "k").join(F.broadcast(n))
    return t("part").join(f, "p_brand").select("p_partkey", F.when(F.col("k") * 10 <= F.col("n") * 2, "valid").otherwise("train").alias("split"))


@query("longest_first", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS k FROM documents) SELECT doc_id, source FROM r WHERE k = 1")
def _(t):
    return t("documents").groupBy("source").agg(F.max_by("doc_id", F.struct(F.length("text"), -F.col("doc_id"))).alias("doc_id")).select("doc_id", "source")


@query("first_by_line", "SELECT o_custkey, min(o_orderkey) AS kept, count(*) - 1 AS for_review FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("kept"), (F.count("*") - 1).alias("for_review"))


@query("attempt_ladder", "SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_suppkey)) FILTER (WHERE l_returnflag <> 'R' AND l_linenumber <= 3) AS outcome, min(l_linenumber) FILTER (WHERE l_returnflag <> 'R' AND l_linenumber <= 3) AS attempt FROM lineitem GROUP BY 1")
def _(t):
    ok = (F.col("l_returnflag") != "R") & (F.col("l_linenumber") <= 3)
    return t("lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", F.when(ok, F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("outcome"), F.min(F.when(ok, F.col("l_linenumber"))).alias("attempt"))


@query("confusion_matrix", "SELECT quality = 1 AS expected, length(text) >= 1000 AS got, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def _(t):
    x = t("labels").join(t("documents"), "doc_id").select((F.col("quality") == 1).alias("expected"), (F.length("text") >= 1000).alias("got"))
    return x.groupBy("expected", "got").agg(F.count("*").alias("n"))


@query("per_tag_rates", "WITH x AS (SELECT unnest([lang, source, CASE WHEN length(text) > 1000 THEN 'long' ELSE 'short' END]) AS tag, quality, toxic FROM labels JOIN documents USING (doc_id)) SELECT tag, count(*) AS n, sum(quality)::BIGINT AS good, round(sum(quality)::DOUBLE / count(*), 6) AS rate, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS accepted_toxic FROM x GROUP BY 1")
def _(t):
    x = t("labels").join(t("documents"), "doc_id").withColumn("tags", F.array("lang", "source", F.when(F.length("text") > 1000, "long").otherwise("short")))
    return scoring.by_tag(x, "tags", F.sum("quality").alias("good"), F.round(F.sum("quality") / F.count("*"), 6).alias("rate"), F.count_if((F.col("toxic") == 1) & (F.col("quality") == 1)).alias("accepted_toxic"))


@query("accepted_precision", "SELECT lang, count(*) FILTER (WHERE n_chars > 500) AS accepted, CASE WHEN count(*) FILTER (WHERE n_chars > 500) = 0 THEN 0 ELSE round(1 - count(*) FILTER (WHERE n_chars > 500 AND quality = 0)::DOUBLE / count(*) FILTER (WHERE n_chars > 500), 6) END AS prec FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def _(t):
    x = t("labels").join(t("documents"), "doc_id")
    ok, wrong = F.count_if(F.col("n_chars") > 500), F.count_if((F.col("n_chars") > 500) & (F.col("quality") == 0))
    return x.groupBy("lang").agg(ok.alias("accepted"), F.when(ok == 0, F.lit(0.0)).otherwise(F.round(1 - wrong / F.nullif(ok, F.lit(0)), 6)).alias("prec"))


@query("release_gates", "WITH m AS (SELECT count(*) FILTER (WHERE quality = 0) AS bad, count(*) FILTER (WHERE toxic = 1) AS toxic, count(*) AS n FROM labels) SELECT gate, CASE WHEN value IS NULL THEN 'absent' WHEN value = want THEN 'pass' ELSE 'fail' END AS verdict FROM (SELECT unnest(['bad', 'toxic', 'n', 'other']) AS gate, unnest([bad, toxic, n, NULL]) AS value, unnest([0, 0, 399, 1]) AS want FROM m)")
def _(t):
    m = t("labels").agg(F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count("*").alias("n"))
    return scoring.gates(m, {"bad": 0, "toxic": 0, "n": 399, "other": 1})


@query("acceptance", "SELECT source, bool_and(length(text) > 20) AS all_long, bool_or(contains(text, chr(10))) AS any_lines, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy("source").agg(F.bool_and(F.length("text") > 20).alias("all_long"), F.bool_or(F.col("text").contains("\n")).alias("any_lines"), F.count("*").alias("n"))


@query("paired_changes", "WITH a AS (SELECT user_id, event_type, arg_min(value, (ts, event_id)) >= 50 AS ok FROM events GROUP BY 1, 2), b AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) >= 50 AS ok FROM events GROUP BY 1, 2) SELECT user_id, event_type, CASE WHEN b.ok THEN 'gain' ELSE 'loss' END AS change FROM a JOIN b USING (user_id, event_type) WHERE a.ok IS DISTINCT FROM b.ok")
def _(t):
    at = F.struct("ts", "event_id")
    run = lambda first: t("events").groupBy("user_id", "event_type").agg((first("value", at) >= 50).alias("ok"))
    return scoring.paired(run(F.min_by), run(F.max_by), ["user_id", "event_type"], "ok")


#: The capabilities that parts are resolved against.
CAPABILITIES = [(name, action, types, names, [], [], [], [], False) for name, action, types, names in (("econ", "find", ["ECONOMY"], []), ("promo", "find", ["PROMO"], []), ("std", "find", ["STANDARD"], []), ("std_two", "find", ["STANDARD"], []), ("widget", "find", ["none"], ["red widget"]), ("buy_promo", "buy", ["PROMO"], []), ("rent_any", "rent", ["*"], []))]


@query("capability_resolve", "SELECT p_partkey, CASE WHEN a = 'rent' OR (a = 'find' AND (w OR p_type IN ('ECONOMY', 'PROMO'))) OR (a = 'buy' AND p_type = 'PROMO') THEN 'RESOLVED' WHEN a = 'find' AND p_type = 'STANDARD' THEN 'AMBIGUOUS_CAPABILITY' ELSE 'NO_CAPABILITY' END AS resolution, CASE WHEN a = 'rent' THEN 'rent_any' WHEN a = 'find' AND w THEN 'widget' WHEN a = 'find' AND p_type = 'ECONOMY' THEN 'econ' WHEN a = 'find' AND p_type = 'PROMO' THEN 'promo' WHEN a = 'buy' AND p_type = 'PROMO' THEN 'buy_promo' END AS capability FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'find' WHEN 1 THEN 'buy' ELSE 'rent' END AS a, p_name = 'red widget' AS w FROM part)")
def _(t):
    action = F.when(F.col("p_size") % 3 == 0, "find").when(F.col("p_size") % 3 == 1, "buy").otherwise("rent")
    goals = t("part").select(F.col("p_partkey").alias("case"), F.lit(0).alias("at"), action.alias("action"), F.struct(F.initcap("p_name").alias("name"), F.col("p_type").alias("type")).alias("target"))
    return planner.resolved(goals, planner.registry(goals.sparkSession, CAPABILITIES)).select(F.col("case").alias("p_partkey"), "resolution", "capability")


@query("interval_conflict", "WITH b AS (SELECT l_orderkey, l_returnflag AS f, max({'v': l_quantity, 's': l_linenumber % 4 = 0}) FILTER (WHERE l_linenumber % 4 < 2) AS lo, min({'v': l_quantity, 'o': l_linenumber % 4 = 3}) FILTER (WHERE l_linenumber % 4 >= 2) AS hi FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, list_sort(list(f)) AS fields FROM b WHERE lo.v > hi.v OR (lo.v = hi.v AND (lo.s OR NOT hi.o)) GROUP BY 1")
def _(t):
    """Orders whose line items, as hard bounds on their flag's quantity, leave no value."""
    ops = F.element_at(F.array(*map(F.lit, ["gt", "gte", "lt", "lte"])), (F.col("l_linenumber") % 4 + 1).cast("int"))
    x = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(_fact(F.col("l_returnflag"), ops, F.col("l_quantity"))).alias("facts"))
    return x.select("l_orderkey", F.array_sort(validate.interval_conflicts(F.col("facts"))).alias("fields")).where("size(fields) > 0")


@query("hard_equality_conflict", "WITH s AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'model' ELSE 'origin' END AS slot FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) > 1) SELECT l_orderkey, list_sort(list(slot)) AS slots FROM s GROUP BY 1")
def _(t):
    field = F.when(F.col("l_returnflag") == "A", "model").when(F.col("l_returnflag") == "R", "origin").otherwise("color")
    x = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(_fact(field, F.lit("eq"), F.col("l_suppkey"))).alias("facts"))
    return x.select("l_orderkey", F.array_sort(validate.unequal_slots(F.col("facts"), "field")).alias("slots")).where("size(slots) > 0")


@query("pairwise_contradiction", "WITH l AS (SELECT l_orderkey AS o, l_linenumber AS ln, l_linenumber % 3 AS k, max(CAST(l_quantity AS INT)) AS v, min(l_suppkey) % 2 AS s FROM lineitem GROUP BY 1, 2) SELECT a.o, count(*) AS n FROM l a JOIN l b ON a.o = b.o AND a.ln < b.ln AND a.s = b.s WHERE (a.k = 0 AND b.k = 1 AND a.v <= b.v) OR (a.k = 1 AND b.k = 0 AND b.v <= a.v) OR (a.k = 2 AND b.k = 0 AND a.v > b.v) OR (a.k = 2 AND b.k = 1 AND a.v < b.v) OR (a.k = 2 AND b.k = 2 AND a.v <> b.v) GROUP BY 1")
def _(t):
    """How many pairs of an order's line items contradict each other as predicates: lt, gt or eq of a quantity."""
    x = t("lineitem").groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("ln")).agg(F.max(F.col("l_quantity").cast("int")).alias("value"), (F.min("l_suppkey") % 2).cast("string").alias("property"))
    op = F.element_at(F.array(*map(F.lit, ["lt", "gt", "eq"])), (F.col("ln") % 3 + 1).cast("int"))
    per = x.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("ln", F.struct("property", op.alias("operator"), "value").alias("p")))).alias("f"))
    return per.select("o", requests.contradictions(F.to_json(F.transform("f", lambda f: f["p"]))).alias("n")).where("n > 0")


@query("o_d_self_join", "WITH e AS (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events), m AS (SELECT a.event_id AS origin, b.event_id AS destination, row_number() OVER (PARTITION BY a.event_id ORDER BY b.pos) AS k FROM e a JOIN e b ON a.user_id = b.user_id AND b.pos > a.pos AND b.ts >= a.ts WHERE a.event_type = 'click' AND b.event_type = 'purchase') SELECT origin, destination FROM m WHERE k = 1")
def _(t):
    # the first later purchase, by one ordered pass over each user instead of a pairwise join
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1, Window.unboundedFollowing)
    later = F.first(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w)
    return t("events").select(F.col("event_id").alias("origin"), "event_type", later.alias("destination")).where("event_type = 'click' AND destination is not null").select("origin", "destination")


@query("service_window", "SELECT CAST(o_orderdate AS DATE) + d AS service_day, count(*) AS n FROM orders, (SELECT unnest([0, 1]) AS d) GROUP BY 1")
def _(t):
    day = F.explode(F.array(F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 1)))
    return t("orders").select(day.alias("service_day")).groupBy("service_day").agg(F.count("*").alias("n"))


@query("result_reference", "WITH r AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice) AS BIGINT) AS price, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS ordinal FROM lineitem), c AS (SELECT l_orderkey, min(price) AS price FROM r GROUP BY 1), u AS (SELECT l_orderkey, count(*) AS n, min(l_linenumber) AS line FROM r JOIN c USING (l_orderkey, price) GROUP BY 1) SELECT l_orderkey, CASE WHEN n = 1 THEN line END AS cheapest, n > 1 AS held FROM u")
def _(t):
    x = t("lineitem").select("l_orderkey", "l_linenumber", F.round("l_extendedprice").cast("long").alias("price"))
    u = x.groupBy("l_orderkey", "price").agg(F.count("*").alias("n"), F.min("l_linenumber").alias("line")).groupBy("l_orderkey").agg(F.min(F.struct("price", "n", "line")).alias("m"))
    return u.select("l_orderkey", F.when(F.col("m.n") == 1, F.col("m.line")).alias("cheapest"), (F.col("m.n") > 1).alias("held"))


@query("tensor_mean", "SELECT label, pos, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2")
def _(t):
    x = t("embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    return x.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("dotted_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("fact_flattening", "SELECT conv_id, turn, bucket, value FROM (SELECT conv_id, turn, unnest(['role', 'first', 'last']) AS bucket, unnest([role, string_split(text, ' ')[1], string_split(text, ' ')[-1]]) AS value FROM conversations)")
def _(t):
    words = F.split("text", " ")
    facts = F.array(F.struct(F.lit("role").alias("bucket"), F.col("role").alias("value")), F.struct(F.lit("first").alias("bucket"), words[0].alias("value")), F.struct(F.lit("last").alias("bucket"), F.element_at(words, -1).alias("value")))
    return t("conversations").select("conv_id", "turn", F.explode(facts).alias("f")).select("conv_id", "turn", "f.*")


@query("equivalence_rewrite", "WITH g(a, b) AS (VALUES ('click', 'view'), ('signup', 'purchase')), m AS (SELECT a AS x, least(a, b) AS y FROM g UNION ALL SELECT b, least(a, b) FROM g) SELECT event_id, coalesce(y, event_type) AS kind FROM events LEFT JOIN m ON x = event_type")
def _(t):
    groups = t("events").sparkSession.createDataFrame([(["click", "view"],), (["signup", "purchase"],)], "names array<string>")
    m = groups.select(F.explode("names").alias("event_type"), F.array_min("names").alias("y"))
    return t("events").join(F.broadcast(m), "event_type", "left").select("event_id", F.coalesce("y", "event_type").alias("kind"))


@query("registry_replace", "SELECT * FROM (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, upper(n_name) || '+' FROM nation WHERE n_nationkey % 5 = 0)")
def _(t):
    base = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    added = base.where("id % 5 = 0").select("id", F.concat(F.upper("name"), F.lit("+")).alias("name"))
    return base.join(added, "id", "left_anti").unionByName(added)


@query("field_mismatch", "WITH x AS (SELECT l_orderkey, list_distinct(list(l_returnflag)) AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, list_sort(list_concat(list_filter(f, lambda v: NOT list_contains(['A', 'N'], v)), list_filter(['A', 'N'], lambda v: NOT list_contains(f, v)))) AS mismatch FROM x")
def _(t):
    want = F.array(F.lit("A"), F.lit("N"))
    x = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return x.select("l_orderkey", F.array_sort(F.concat(F.array_except("f", want), F.array_except(want, F.col("f")))).alias("mismatch"))


@query("schedule", "SELECT i AS step, round(CASE WHEN i <= 10 THEN i / 10.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (i - 10) / 90.0)) END, 9) AS rate FROM range(1, 101) r(i)")
def _(t):
    s = t("region").sparkSession.range(1, 101).withColumnRenamed("id", "step")
    i = F.col("step")
    return s.select("step", F.round(F.when(i <= 10, i / 10.0).otherwise(0.1 + 0.9 * 0.5 * (1 + F.cos(F.pi() * (i - 10) / 90.0))), 9).alias("rate"))


@query("relative_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + 2 AS in_two_days, CAST(CAST(o_orderdate AS DATE) + CAST((o_orderkey % 7 - (isodow(o_orderdate) - 1) + 7) % 7 AS INT) AS DATE) AS weekday FROM orders")
def _(t):
    from quillspark.functions.text import next_weekday

    d = F.to_date("o_orderdate")
    return t("orders").select("o_orderkey", F.date_add(d, 2).alias("in_two_days"), next_weekday(d, (F.col("o_orderkey") % 7).cast("int")).alias("weekday"))


@query("weighted_choice", "SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY -ln((('0x' || substr(md5(CAST(p_partkey AS VARCHAR)), 1, 8))::BIGINT + 1) / 4294967297.0) / p_size, p_partkey) AS k FROM part) WHERE k <= 3")
def _(t):
    # smallest exponential keys of rate p_size: a weighted draw without replacement
    u = (F.conv(F.substring(F.md5(F.col("p_partkey").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") + 1) / F.lit(4294967297.0)
    x = t("part").select("p_brand", "p_partkey", (-F.log(u) / F.col("p_size")).alias("age"))
    return first_of_groups(x, ["p_brand"], ["age", "p_partkey"], 3).drop("age")


@query("completion_mask", "SELECT p_partkey, list_concat(list_transform(range(p_size % 4), lambda i: -100::BIGINT), range(p_size % 4, 6)) AS labels FROM part")
def _(t):
    n = (F.col("p_size") % 4).cast("int")
    ids = F.sequence(F.lit(0), F.lit(5)).cast("array<bigint>")
    return t("part").select("p_partkey", F.concat(F.array_repeat(F.lit(-100).cast("long"), n), F.slice(ids, n + 1, F.lit(6) - n)).alias("labels"))


@query("order_then_limit", "SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC) AS place FROM (SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey DESC, l_linenumber DESC LIMIT 25)")
def _(t):
    keys = [F.desc("l_extendedprice"), F.desc("l_orderkey"), F.desc("l_linenumber")]
    top = t("lineitem").orderBy(*keys).limit(25)
    return top.select("l_orderkey", "l_linenumber", F.row_number().over(Window.orderBy(*keys)).cast("long").alias("place"))


@query("grouped_split", """WITH p AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), f AS (SELECT source, sum(n)::BIGINT AS n, arg_min(lang, (-n, lang)) AS home FROM p GROUP BY 1),
s AS (SELECT source, CASE WHEN (sum(n) OVER (PARTITION BY home ORDER BY md5(source), source ROWS UNBOUNDED PRECEDING) - n) * 100 < sum(n) OVER (PARTITION BY home) * 20 THEN 'valid' ELSE 'train' END AS split FROM f) SELECT doc_id, source, split FROM documents JOIN s USING (source)""")
def _(t):
    from quillspark.operators.splits import grouped_split

    return grouped_split(t("documents").select("doc_id", "source", "lang"), "source", "lang", 20).select("doc_id", "source", "split")


@query("coverage_panel", "WITH x AS (SELECT doc_id, unnest([lang, CASE WHEN length(text) > 1000 THEN 'long' ELSE 'short' END]) AS tag FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM x) SELECT tag, doc_id FROM r WHERE k <= 10")
def _(t):
    from quillspark.operators.splits import panel

    tags = F.array("lang", F.when(F.length("text") > 1000, "long").otherwise("short"))
    return panel(t("documents").select("doc_id", tags.alias("tags")), "doc_id", "tags", 10)


@query("status_pivot", "SELECT user_id % 5 AS panel, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy((F.col("user_id") % 5).alias("panel")).pivot("event_type", ["click", "error", "purchase"]).agg(F.count("event_id")).na.fill(0, ["click", "error", "purchase"])


@query("guard_comparison", "WITH g AS (SELECT 'length' AS guard, length(text) < 3000 AS accepted, quality FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'marks', NOT contains(text, '!!'), quality FROM documents JOIN labels USING (doc_id)) SELECT guard, count(*) FILTER (WHERE accepted AND quality = 0) AS wrong_accepted, count(*) FILTER (WHERE NOT accepted AND quality = 1) AS wrong_held, count(*) FILTER (WHERE accepted) AS accepted FROM g GROUP BY 1")
def _(t):
    x = t("documents").join(t("labels"), "doc_id").select("quality", (F.length("text") < 3000).alias("length"), (~F.col("text").contains("!!")).alias("marks"))
    g = x.select("quality", F.expr("stack(2, 'length', length, 'marks', marks) AS (guard, accepted)"))
    return g.groupBy("guard").agg(F.count_if(F.col("accepted") & (F.col("quality") == 0)).alias("wrong_accepted"), F.count_if(~F.col("accepted") & (F.col("quality") == 1)).alias("wrong_held"), F.count_if("accepted").alias("accepted"))


@query("review_join", "SELECT d.doc_id, l.quality, b.item_id IS NOT NULL AS flagged FROM documents d JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id")
def _(t):
    flags = t("benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("flagged"))
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id").join(flags, "doc_id", "left").na.fill(False, ["flagged"])


@query("prefix_totals", "SELECT string_split(o_orderpriority, '-')[1] AS panel, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(F.substring_index("o_orderpriority", "-", 1).alias("panel")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("result_ranks", "SELECT o_custkey, o_orderkey, printf('R%04d', row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS ref FROM orders")
def _(t):
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t("orders").select("o_custkey", "o_orderkey", F.format_string("R%04d", k).alias("ref"))


@query("gap_overlay", "SELECT d.doc_id, coalesce(l.quality, d.doc_id % 2) AS got FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("long"), F.col("doc_id") % 2).alias("got"))


@query("list_values", "SELECT p_partkey, list_sort(string_split(p_type, ' ')) AS parts, array_to_string(list_sort(string_split(p_type, ' ')), '|') AS joined FROM part")
def _(t):
    parts = F.array_sort(F.split("p_type", " "))
    return t("part").select("p_partkey", parts.alias("parts"), F.array_join(parts, "|").alias("joined"))


@query("slot_difference", "WITH u AS (SELECT user_id, list_distinct(list(event_type)) AS have FROM events GROUP BY 1), m AS (SELECT user_id, list_sort(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(have, x))) AS missing FROM u) SELECT user_id, missing, missing[1] AS next_slot FROM m")
def _(t):
    want = F.array(*map(F.lit, ["click", "error", "purchase", "signup", "view"]))
    m = t("events").groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    return m.select("user_id", F.array_sort(F.array_except(want, F.col("have"))).alias("missing")).withColumn("next_slot", F.get("missing", F.lit(0)))
