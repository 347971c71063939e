"""Text, overlap, near-duplicate, split and audit queries over the corpus tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from quillspark.functions.text import digest, jaccard, normalize_text, short_id, token_set
from quillspark.operators.components import components
from quillspark.operators.similarity import best_across, near_anti_join, nearest, pairs_between, similar_pairs
from quillspark.plans.base import KEY, NORM, TOKENS, normalized, query, token_sets

SPLIT = "CASE WHEN doc_id % 10 = 8 THEN 'valid' WHEN doc_id % 10 = 9 THEN 'test' ELSE 'train' END"


@query("normalize_text", f"SELECT doc_id, {KEY} AS key FROM documents")
def _(t):
    return normalized(t("documents")).withColumnRenamed("id", "doc_id")


@query("token_set_size", f"WITH {TOKENS} SELECT norm.id AS doc_id, count(DISTINCT sets.token) AS n_tokens FROM norm LEFT JOIN sets USING (id) GROUP BY 1")
def _(t):
    return token_sets(t("documents")).select(F.col("id").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"))


@query("content_digest", "SELECT doc_id, sha256(text) AS digest, substr(sha256(text), 1, 16) AS short_id FROM documents")
def _(t):
    return t("documents").select("doc_id", digest(F.col("text")).alias("digest"), short_id(text=F.col("text")).alias("short_id"))


@query("dataset_stats", f"WITH n AS (SELECT source, length(text) AS len, {KEY} AS key FROM documents) SELECT count(*) AS n_rows, count(DISTINCT key) AS distinct_prompts, count(*) - count(DISTINCT key) AS duplicate_rows, count(DISTINCT source) AS families, min(len) AS shortest, max(len) AS longest, sum(len)::BIGINT AS total_chars FROM n")
def _(t):
    n = t("documents").select("source", F.length("text").cast("long").alias("len"), normalize_text(F.col("text")).alias("key"))
    return n.agg(F.count("*").alias("n_rows"), F.countDistinct("key").alias("distinct_prompts"), (F.count("*") - F.countDistinct("key")).alias("duplicate_rows"), F.countDistinct("source").alias("families"), F.min("len").alias("shortest"), F.max("len").alias("longest"), F.sum("len").alias("total_chars"))


@query("rare_classes", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1) SELECT source, n FROM c WHERE n * 20 < (SELECT sum(n) FROM c)")
def _(t):
    c = t("documents").groupBy("source").agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(total)).where("n * 20 < total").select("source", "n")


@query("exact_overlap", f"WITH {NORM} SELECT bnorm.id AS item_id, norm.id AS doc_id FROM bnorm JOIN norm USING (key)")
def _(t):
    # texts meet by their digest, so none is shuffled
    keyed = lambda x, name: normalized(x, name).select(F.col("id").alias(name), F.sha2("key", 256).alias("key"))
    return keyed(t("benchmark"), "item_id").join(keyed(t("documents"), "doc_id"), "key").select("item_id", "doc_id")


@query("decontaminate_exact", f"WITH {NORM} SELECT id AS doc_id FROM norm WHERE key <> '' AND key NOT IN (SELECT key FROM bnorm)")
def _(t):
    b = normalized(t("benchmark"), "item_id").select("key").distinct()
    return normalized(t("documents")).where("key <> ''").join(b, "key", "left_anti").select(F.col("id").alias("doc_id"))


@query("split_intersections", f"WITH s AS (SELECT DISTINCT {SPLIT} AS split, {KEY} AS key FROM documents) SELECT a.split AS left_split, b.split AS right_split, count(*) AS shared FROM s a JOIN s b ON a.key = b.key AND a.split < b.split GROUP BY 1, 2")
def _(t):
    s = t("documents").select(F.expr(SPLIT).alias("split"), normalize_text(F.col("text")).alias("key")).distinct()
    # one row for each key with the splits that hold it, instead of a self-join
    per = s.groupBy("key").agg(F.array_sort(F.collect_set("split")).alias("x")).where(F.size("x") > 1)
    pair = F.explode(F.flatten(F.transform("x", lambda a: F.transform(F.filter("x", lambda b: b > a), lambda b: F.struct(a.alias("l"), b.alias("r"))))))
    return per.select(pair.alias("p")).groupBy(F.col("p.l").alias("left_split"), F.col("p.r").alias("right_split")).agg(F.count("*").alias("shared"))


@query("first_wins_dedup", f"WITH n AS (SELECT doc_id, {KEY} AS key, {SPLIT} AS split FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END, doc_id) AS rn FROM n) SELECT doc_id, split FROM r WHERE rn = 1")
def _(t):
    n = t("documents").select("doc_id", normalize_text(F.col("text")).alias("key"), F.expr(SPLIT).alias("split"))
    rank = F.expr("CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END")
    # a least struct instead of a window: partial aggregation takes hot keys apart
    return n.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "doc_id", "split")).alias("x")).select("x.doc_id", "x.split")


@query("conflicting_prompts", f"WITH n AS (SELECT {KEY} AS key, quality FROM documents JOIN labels USING (doc_id)) SELECT key, count(*) AS n_rows, count(DISTINCT quality) AS n_labels FROM n GROUP BY 1 HAVING count(DISTINCT quality) > 1")
def _(t):
    n = t("documents").join(t("labels"), "doc_id").select(normalize_text(F.col("text")).alias("key"), "quality")
    return n.groupBy("key").agg(F.count("*").alias("n_rows"), F.countDistinct("quality").alias("n_labels")).where("n_labels > 1")


@query("clean_validation", f"""WITH n AS (SELECT doc_id, {KEY} AS key, {SPLIT} AS split, quality FROM documents LEFT JOIN labels USING (doc_id)), v AS (SELECT * FROM n WHERE split = 'valid'),
bad AS (SELECT key FROM v GROUP BY key HAVING count(DISTINCT coalesce(quality, -1)) > 1), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS rn FROM v)
SELECT doc_id, CASE WHEN key IN (SELECT key FROM n WHERE split = 'train') THEN 'overlap' WHEN key IN (SELECT key FROM bad) THEN 'conflict' WHEN rn > 1 THEN 'duplicate' ELSE 'kept' END AS verdict FROM r""")
def _(t):
    n = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", normalize_text(F.col("text")).alias("key"), F.expr(SPLIT).alias("split"), F.coalesce("quality", F.lit(-1)).alias("quality"))
    v = n.where("split = 'valid'")
    seen = n.where("split = 'train'").select("key").distinct().withColumn("seen", F.lit(True))
    facts = v.groupBy("key").agg(F.min("doc_id").alias("first"), (F.countDistinct("quality") > 1).alias("conflict"))
    verdict = F.when(F.col("seen"), "overlap").when(F.col("conflict"), "conflict").when(F.col("doc_id") != F.col("first"), "duplicate").otherwise("kept")
    return v.join(facts, "key").join(seen, "key", "left").select("doc_id", verdict.alias("verdict"))


@query("near_dup_pairs", f"WITH {TOKENS}, p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM sets a JOIN sets b ON a.token = b.token AND a.id < b.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY 1, 2, 3, 4) SELECT a, b, shared, na + nb - shared AS total FROM p WHERE shared * 100 >= (na + nb - shared) * 85")
def _(t):
    return similar_pairs(token_sets(t("documents")), 85).select("a", "b", F.col("shared").cast("long").alias("shared"), F.col("total").cast("long").alias("total"))


NEAREST_SQL = f"WITH {TOKENS}, p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM sets a JOIN bsets b ON a.token = b.token GROUP BY 1, 2, 3, 4), r AS (SELECT a AS doc_id, b AS item_id, shared, na + nb - shared AS total, row_number() OVER (PARTITION BY a ORDER BY shared::DOUBLE / (na + nb - shared)::DOUBLE DESC, b) AS rn FROM p) SELECT doc_id, item_id, shared, total FROM r WHERE rn = 1"


@query("nearest_prior", NEAREST_SQL)
def _(t):
    found = nearest(token_sets(t("documents")), token_sets(t("benchmark"), "item_id"))
    return found.select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), F.col("shared").cast("long").alias("shared"), F.col("total").cast("long").alias("total"))


@query("within_panel_max", f"WITH {TOKENS}, p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM bsets a JOIN bsets b ON a.token = b.token AND a.id <> b.id GROUP BY 1, 2, 3, 4), r AS (SELECT a AS item_id, b AS other_id, shared, na + nb - shared AS total, row_number() OVER (PARTITION BY a ORDER BY shared::DOUBLE / (na + nb - shared)::DOUBLE DESC, b) AS rn FROM p) SELECT item_id, other_id, shared, total FROM r WHERE rn = 1")
def _(t):
    panel = token_sets(t("benchmark"), "item_id")
    return nearest(panel, panel, others=True).select(F.col("a").alias("item_id"), F.col("b").alias("other_id"), "shared", "total")


def _splits(t):
    s = token_sets(t("documents")).withColumn("split", F.expr(SPLIT.replace("doc_id", "id")))
    return {x: s.where(F.col("split") == x).drop("split") for x in ("train", "valid", "test")}


CROSS = f"{TOKENS}, p AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS shared FROM sets a JOIN sets b ON a.token = b.token AND a.id <> b.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY 1, 2, 3, 4), s AS (SELECT a, b FROM p WHERE shared * 100 >= (na + nb - shared) * 85), split AS (SELECT doc_id, {SPLIT} AS split FROM documents)"


@query("near_anti_join", f"WITH {CROSS} SELECT doc_id FROM split WHERE split = 'valid' AND doc_id NOT IN (SELECT s.a FROM s JOIN split x ON x.doc_id = s.b WHERE x.split = 'train')")
def _(t):
    s = _splits(t)
    return near_anti_join(s["valid"], s["train"], 85).select(F.col("id").alias("doc_id"))


@query("contamination_matrix", f"WITH {CROSS} SELECT x.split AS left_split, y.split AS right_split, count(*) AS pairs, count(DISTINCT s.a) AS left_rows FROM s JOIN split x ON x.doc_id = s.a JOIN split y ON y.doc_id = s.b WHERE x.split < y.split GROUP BY 1, 2")
def _(t):
    sets = token_sets(t("documents")).withColumn("split", F.expr(SPLIT.replace("doc_id", "id")))
    found = pairs_between(sets, "split", 85).where("left < right")
    return found.select(F.col("left").alias("left_split"), F.col("right").alias("right_split"), "pairs", "left_rows")


@query("best_across_splits", f"WITH {CROSS}, q AS (SELECT p.a, p.b, p.shared, na + nb - p.shared AS total FROM p JOIN split x ON x.doc_id = p.a JOIN split y ON y.doc_id = p.b WHERE x.split = 'test' AND y.split = 'train' AND p.shared * 100 >= (na + nb - p.shared) * 85), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared::DOUBLE / total::DOUBLE DESC, b) AS rn FROM q) SELECT a AS doc_id, b AS other_id, shared, total FROM r WHERE rn = 1")
def _(t):
    s = _splits(t)
    return best_across(s["test"], s["train"], 85).select(F.col("a").alias("doc_id"), F.col("b").alias("other_id"), F.col("shared").cast("long").alias("shared"), F.col("total").cast("long").alias("total"))


@query("rarest_tokens", f"WITH {TOKENS}, df AS (SELECT token, count(*) AS df FROM sets GROUP BY 1), r AS (SELECT id, token, df, row_number() OVER (PARTITION BY id ORDER BY df, token) AS k FROM sets JOIN df USING (token)) SELECT id AS doc_id, k, token, df FROM r WHERE k <= 3")
def _(t):
    flat = token_sets(t("documents")).select("id", F.explode("tokens").alias("token"))
    df = flat.groupBy("token").agg(F.count("*").alias("df"))
    ranked = flat.join(df, "token").withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("df", "token")).cast("long"))
    return ranked.where("k <= 3").select(F.col("id").alias("doc_id"), "k", "token", "df")


@query("token_jaccard", f"WITH {TOKENS}, p AS (SELECT id AS doc_id, min(n) AS n FROM sets GROUP BY 1), q AS (SELECT a.id AS doc_id, count(b.token) AS shared FROM sets a LEFT JOIN sets b ON b.id = a.id + 1 AND b.token = a.token GROUP BY 1) SELECT p.doc_id, round(shared::DOUBLE / (p.n + r.n - shared)::DOUBLE, 6) AS jaccard FROM p JOIN q USING (doc_id) JOIN p r ON r.doc_id = p.doc_id + 1")
def _(t):
    s = token_sets(t("documents")).where(F.size("tokens") > 0)
    after = s.select((F.col("id") - 1).alias("id"), F.col("tokens").alias("other"))
    return s.join(after, "id").select(F.col("id").alias("doc_id"), F.round(jaccard(F.col("tokens"), F.col("other")), 6).alias("jaccard"))


@query("components_by_prompt", f"""WITH RECURSIVE n AS (SELECT DISTINCT source, {KEY} AS key FROM documents), e AS (SELECT DISTINCT a.source AS a, b.source AS b FROM n a JOIN n b USING (key)),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b) SELECT a AS source, min(b) AS component FROM reach GROUP BY 1""")
def _(t):
    from quillspark.operators.tables import keep

    docs = t("documents")
    n = docs.select("source", normalize_text(F.col("text")).alias("key")).distinct()
    first = n.groupBy("key").agg(F.min("source").alias("a"))
    found = components(n.join(first, "key").select("a", F.col("source").alias("b")), keep)
    return docs.select("source").distinct().join(found.withColumnRenamed("node", "source"), "source", "left").select("source", F.coalesce("component", "source").alias("component"))


@query("split_audit", f"""WITH n AS (SELECT {KEY} AS key, {SPLIT} AS split, source, quality FROM documents LEFT JOIN labels USING (doc_id)), k AS (SELECT key, count(*) AS n, count(DISTINCT quality) AS q, count(DISTINCT split) AS s FROM n GROUP BY 1), f AS (SELECT source, count(DISTINCT split) AS s FROM n GROUP BY 1)
SELECT (SELECT sum(n - 1)::BIGINT FROM k) AS duplicates, (SELECT count(*) FROM k WHERE q > 1) AS conflicts, (SELECT count(*) FROM k WHERE s > 1) AS shared_prompts, (SELECT count(*) FROM f WHERE s > 1) AS shared_families""")
def _(t):
    n = t("documents").join(t("labels"), "doc_id", "left").select(normalize_text(F.col("text")).alias("key"), F.expr(SPLIT).alias("split"), "source", "quality")
    k = n.groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("quality").alias("q"), F.countDistinct("split").alias("s"))
    f = n.groupBy("source").agg(F.countDistinct("split").alias("s"))
    a = k.agg(F.sum(F.col("n") - 1).alias("duplicates"), F.count_if(F.col("q") > 1).alias("conflicts"), F.count_if(F.col("s") > 1).alias("shared_prompts"))
    return a.join(F.broadcast(f.agg(F.count_if(F.col("s") > 1).alias("shared_families"))))


@query("union_with_provenance", "SELECT doc_id AS id, 'document' AS origin, length(text) AS len FROM documents UNION ALL SELECT item_id, 'benchmark', length(text) FROM benchmark")
def _(t):
    d = t("documents").select(F.col("doc_id").alias("id"), F.lit("document").alias("origin"), F.length("text").cast("long").alias("len"))
    return d.unionByName(t("benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("origin"), F.length("text").cast("long").alias("len")))


@query("missing_in_validation", f"SELECT DISTINCT source FROM documents WHERE {SPLIT} = 'train' EXCEPT SELECT source FROM documents WHERE {SPLIT} = 'valid' AND lang = 'de'")
def _(t):
    d = t("documents").withColumn("split", F.expr(SPLIT))
    return d.where("split = 'train'").select("source").subtract(d.where("split = 'valid' AND lang = 'de'").select("source"))


@query("shared_families", f"SELECT source FROM documents WHERE {SPLIT} = 'train' INTERSECT SELECT source FROM documents WHERE {SPLIT} = 'test'")
def _(t):
    d = t("documents").withColumn("split", F.expr(SPLIT))
    return d.where("split = 'train'").select("source").intersect(d.where("split = 'test'").select("source"))


@query("panel_uniqueness", f"WITH {NORM} SELECT count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT key) AS texts, count(*) = count(DISTINCT id) AND count(*) = count(DISTINCT key) AS is_unique FROM bnorm")
def _(t):
    return normalized(t("benchmark"), "item_id").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.countDistinct("key").alias("texts")).withColumn("is_unique", (F.col("n") == F.col("ids")) & (F.col("n") == F.col("texts")))


@query("feature_tally", r"SELECT f AS feature, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(text, '[0-9]') THEN 'digits' END, CASE WHEN contains(text, '!') THEN 'shouts' END, CASE WHEN contains(text, chr(10)) THEN 'lines' END, CASE WHEN length(text) > 2000 THEN 'long' END, CASE WHEN regexp_matches(text, '[|*#$%&]') THEN 'symbols' END], lambda x: x IS NOT NULL)) AS f FROM documents) GROUP BY 1")
def _(t):
    x = F.col("text")
    found = F.array_compact(F.array(F.when(x.rlike("[0-9]"), "digits"), F.when(x.contains("!"), "shouts"), F.when(x.contains("\n"), "lines"), F.when(F.length(x) > 2000, "long"), F.when(x.rlike("[|*#$%&]"), "symbols")))
    return t("documents").select(F.explode(found).alias("feature")).groupBy("feature").agg(F.count("*").alias("n"))


@query("coverage_verdict", f"""WITH c AS (SELECT source, count(*) FILTER (WHERE {SPLIT} = 'train') AS n_train, count(*) FILTER (WHERE {SPLIT} <> 'train') AS n_other FROM documents GROUP BY 1), s AS (SELECT *, sum(n_train) OVER ()::BIGINT AS t, sum(n_other) OVER ()::BIGINT AS o FROM c)
SELECT source, n_train, n_other, CASE WHEN n_other > 0 AND n_train = 0 THEN 'hole' WHEN n_train * o * 12 < n_other * t * 10 THEN 'thin' WHEN n_train * 20 < t THEN 'rare' ELSE 'covered' END AS verdict FROM s""")
def _(t):
    d = t("documents").withColumn("is_train", F.expr(SPLIT) == "train")
    c = d.groupBy("source").agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_other"))
    s = c.join(F.broadcast(c.agg(F.sum("n_train").alias("t"), F.sum("n_other").alias("o"))))
    return s.select("source", "n_train", "n_other", F.expr("CASE WHEN n_other > 0 AND n_train = 0 THEN 'hole' WHEN n_train * o * 12 < n_other * t * 10 THEN 'thin' WHEN n_train * 20 < t THEN 'rare' ELSE 'covered' END").alias("verdict"))


def order_statistics(df, value: str, by: list[str]):
    """Exact order statistics by group, from counts of values: no group is gathered in one place."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by).orderBy(value)
    return counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))



@query("token_length_stats", f"""WITH n AS (SELECT lang, len(string_split({KEY}, ' ')) AS len FROM documents), s AS (SELECT lang, list_sort(list(len)) AS s, count(*) AS n FROM n GROUP BY 1)
SELECT lang, n, s[1] AS shortest, s[n // 2 + 1] AS median, s[CAST(floor(n * 0.9) AS BIGINT) + 1] AS p90, s[CAST(floor((n - 1) * 0.99) AS BIGINT) + 1] AS p99, s[n] AS longest FROM s""")
def _(t):
    n = t("documents").select("lang", F.size(F.split(normalize_text(F.col("text")), " ")).cast("long").alias("len"))
    s = order_statistics(n, "len", ["lang"])
    pick = lambda i: F.min(F.when(F.col("upto") > i, F.col("len")))
    return s.groupBy("lang", "n").agg(F.min("len").alias("shortest"), pick(F.floor(F.col("n") / 2)).alias("median"), pick(F.floor(F.col("n") * 0.9)).alias("p90"), pick(F.floor((F.col("n") - 1) * 0.99)).alias("p99"), F.max("len").alias("longest"))


@query("share_within_limits", "WITH n AS (SELECT role, length(text) AS len FROM conversations) SELECT role, count(*) AS n, count(*) FILTER (WHERE len <= 100) AS within_100, count(*) FILTER (WHERE len <= 400) AS within_400, round(count(*) FILTER (WHERE len <= 400)::DOUBLE / count(*), 6) AS share_400 FROM n GROUP BY 1")
def _(t):
    n = t("conversations").select("role", F.length("text").alias("len"))
    return n.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.col("len") <= 100).alias("within_100"), F.count_if(F.col("len") <= 400).alias("within_400"), F.round(F.count_if(F.col("len") <= 400) / F.count("*"), 6).alias("share_400"))


@query("chat_to_case", "WITH u AS (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations WHERE role = 'user' GROUP BY 1), a AS (SELECT conv_id, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT conv_id, prompt, answer FROM u FULL JOIN a USING (conv_id)")
def _(t):
    c = t("conversations")
    return c.where("role in ('user', 'assistant')").groupBy("conv_id").agg(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("prompt"), F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("answer"))


@query("turn_totals", "SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, count(*) FILTER (WHERE role = 'assistant') AS assistant_turns, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def _(t):
    return t("conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"), F.sum(F.length("text")).alias("chars"))


@query("turn_window", "SELECT conv_id, turn, role, row_number() OVER w AS ordinal, lag(role) OVER w AS previous_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return t("conversations").select("conv_id", "turn", "role", F.row_number().over(w).cast("long").alias("ordinal"), F.lag("role").over(w).alias("previous_role"))
