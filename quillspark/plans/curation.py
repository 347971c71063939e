"""Curation queries: quota draws, panels, cleaning with quarantine, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import normalize_text
from quillspark.operators.cleaning import clean_rows
from quillspark.operators.draws import dev_panel, quota_draw
from quillspark.operators.scoring import release_rates
from quillspark.operators.splits import grouped_split
from quillspark.operators.tables import folder
from quillspark.plans.base import KEY, query
from quillspark.plans.corpus import SPLIT, order_statistics
from quillspark.streaming.sink import resumable, written

QUOTAS = {"en": 15, "de": 12, "fr": 10, "es": 8}
_QUOTA_SQL = f"WITH q(lang, target) AS (VALUES {', '.join(f'({k!r}, {n}::BIGINT)' for k, n in QUOTAS.items())}), n AS (SELECT doc_id, lang, {KEY} AS key, md5(doc_id::VARCHAR) AS o FROM documents), f AS (SELECT lang, key, arg_min(doc_id, (o, doc_id)) AS doc_id, count(*) AS n FROM n GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS k FROM f)"


def _quota(t):
    docs = t("documents").select("doc_id", "lang", normalize_text(F.col("text")).alias("prompt"))
    return quota_draw(docs, "lang", "prompt", "doc_id", QUOTAS)


@query("quota_prompts", f"{_QUOTA_SQL} SELECT doc_id, lang FROM r JOIN q USING (lang) WHERE k <= target")
def _(t):
    return _quota(t)[0].select("doc_id", "lang")


@query("quota_counts", f"{_QUOTA_SQL} SELECT lang, target, least(target, count(*)) AS actual, sum(n)::BIGINT AS available FROM r JOIN q USING (lang) GROUP BY 1, 2")
def _(t):
    return _quota(t)[1]


@query("dev_panel", """WITH d AS (SELECT DISTINCT text, CASE WHEN length(text) % 3 = 0 THEN '0' ELSE '1' END || md5(text) AS o FROM documents WHERE text IS NOT NULL),
t AS (SELECT text, o, tag, i FROM d, (VALUES (0, 'digits'), (1, 'lines'), (2, 'long'), (3, 'marks')) v(i, tag) WHERE CASE tag WHEN 'digits' THEN regexp_matches(text, '[0-9]') WHEN 'lines' THEN contains(text, chr(10)) WHEN 'long' THEN length(text) > 2000 ELSE regexp_matches(text, '[,;]') END),
r AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY o) AS k FROM t), c AS (SELECT text, min(i * 100 + k) AS p FROM r WHERE k <= 10 GROUP BY 1), a AS (SELECT text, p FROM c UNION ALL SELECT text, 1000 + row_number() OVER (ORDER BY o) FROM d WHERE text NOT IN (SELECT text FROM c))
SELECT text_md5, place FROM (SELECT md5(text) AS text_md5, row_number() OVER (ORDER BY p) AS place FROM a) WHERE place <= 60""")
def _(t):
    x = F.col("text")
    tags = F.array_compact(F.array(F.when(x.rlike("[0-9]"), "digits"), F.when(x.contains("\n"), "lines"), F.when(F.length(x) > 2000, "long"), F.when(x.rlike("[,;]"), "marks")))
    rows = t("documents").where("text is not null").select("text", tags.alias("tags"))
    panel = dev_panel(rows, "text", "tags", ["digits", "lines", "long", "marks"], 60, preferred=F.length("text") % 3 == 0)
    return panel.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "place")


_CLEAN_SQL = f"""WITH RECURSIVE n AS (SELECT doc_id, {KEY} AS key, coalesce(quality, -1) AS label, source || '/' || (doc_id % 7) AS family FROM documents LEFT JOIN labels USING (doc_id)),
f AS (SELECT key, min(label) AS low, max(label) AS high, min(doc_id) AS first, count(*) AS n FROM n GROUP BY 1),
e AS (SELECT DISTINCT a.family AS a, b.family AS b FROM n a JOIN n b USING (key) WHERE a.family <> b.family), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a AS family, min(least(a, b)) AS root FROM r GROUP BY 1)"""


def _cleaned(t):
    rows = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", normalize_text(F.col("text")).alias("key"), F.coalesce("quality", F.lit(-1)).alias("label"), F.concat_ws("/", "source", (F.col("doc_id") % 7).cast("string")).alias("family"))
    return clean_rows(rows, key="key", label="label", family="family", order="doc_id")


@query("clean_rows", f"{_CLEAN_SQL} SELECT n.doc_id, 'family-' || substr(sha256(coalesce(c.root, n.family)), 1, 24) AS root FROM n JOIN f ON f.key = n.key LEFT JOIN c ON c.family = n.family WHERE low = high AND doc_id = first")
def _(t):
    return _cleaned(t).kept.select("doc_id", "root")


@query("quarantined_rows", f"{_CLEAN_SQL} SELECT n.doc_id, 'family-' || substr(sha256(coalesce(c.root, n.family)), 1, 24) AS root FROM n JOIN f ON f.key = n.key LEFT JOIN c ON c.family = n.family WHERE low <> high")
def _(t):
    return _cleaned(t).quarantined.select("doc_id", "root")


@query("clean_counters", f"{_CLEAN_SQL} SELECT (SELECT count(*) FROM n) AS input_rows, sum(CASE WHEN low = high THEN n - 1 ELSE 0 END)::BIGINT AS duplicate_rows_removed, count(*) FILTER (WHERE low <> high) AS conflicting_prompts, coalesce(sum(n) FILTER (WHERE low <> high), 0)::BIGINT AS conflicting_rows_quarantined, count(*) FILTER (WHERE low = high) AS unique_rows FROM f")
def _(t):
    counters = _cleaned(t).counters
    names = ["input_rows", "duplicate_rows_removed", "conflicting_prompts", "conflicting_rows_quarantined", "unique_rows"]
    return t("labels").sparkSession.createDataFrame([tuple(counters.get(c, 0) for c in names)], ", ".join(f"{c} long" for c in names))


@query("grouped_split_by_three", """WITH d AS (SELECT doc_id, source || '/' || (doc_id % 40) AS family, lang, length(text) > 1000 AS long, contains(text, chr(10)) AS lines FROM documents), p AS (SELECT family, {'lang': lang, 'long': long, 'lines': lines} AS s, count(*) AS n FROM d GROUP BY 1, 2), f AS (SELECT family, sum(n)::BIGINT AS n, arg_min(s, (-n, s)) AS home FROM p GROUP BY 1),
x AS (SELECT family, CASE WHEN (sum(n) OVER (PARTITION BY home ORDER BY md5(family), family ROWS UNBOUNDED PRECEDING) - n) * 100 < sum(n) OVER (PARTITION BY home) * 20 THEN 'valid' ELSE 'train' END AS split FROM f) SELECT doc_id, split FROM d JOIN x USING (family)""")
def _(t):
    """Families of a source go whole to one split, strata are language, length and lines together."""
    d = t("documents").select("doc_id", F.concat_ws("/", "source", (F.col("doc_id") % 40).cast("string")).alias("family"), "lang", (F.length("text") > 1000).alias("long"), F.contains("text", F.lit("\n")).alias("lines"))
    return grouped_split(d, "family", ["lang", "long", "lines"], 20).select("doc_id", "split")


@query("token_length_audit", f"""WITH n AS (SELECT lang, len(string_split({KEY}, ' ')) AS len FROM documents) SELECT lang, count(*) AS n, sum(len)::BIGINT AS tokens, avg(len) AS mean, median(len)::DOUBLE AS median, max(len) AS longest, count(*) FILTER (WHERE len <= 256) AS within_256, count(*) FILTER (WHERE len <= 1024) AS within_1024, count(*) FILTER (WHERE len > 1024)::DOUBLE / count(*) AS share_over FROM n GROUP BY 1""")
def _(t):
    """Lengths by language with their mean, true median and what fits two limits; from counts of lengths, so no language is gathered."""
    n = t("documents").select("lang", F.size(F.split(normalize_text(F.col("text")), " ")).cast("long").alias("len"))
    s = order_statistics(n, "len", ["lang"])
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("len")))
    low, high = at(F.floor((F.col("n") - 1) / 2)), at(F.floor(F.col("n") / 2))
    fits = lambda most: F.sum(F.when(F.col("len") <= most, F.col("c")).otherwise(0))
    tokens = F.sum(F.col("len") * F.col("c"))
    return s.groupBy("lang", "n").agg(tokens.alias("tokens"), (tokens / F.col("n")).alias("mean"), ((low + high) / 2).alias("median"), F.max("len").alias("longest"), fits(256).alias("within_256"), fits(1024).alias("within_1024"), ((F.col("n") - fits(1024)) / F.col("n")).alias("share_over"))


@query("overlap_by_label", f"""WITH n AS (SELECT doc_id, {KEY} AS key, {SPLIT} AS split, coalesce(quality, -1) AS label FROM documents LEFT JOIN labels USING (doc_id)), a AS (SELECT key, min(label) AS low, max(label) AS high, count(*) AS n FROM n WHERE split = 'train' GROUP BY 1)
SELECT v.doc_id, a.n AS train_rows, low = high AND low = v.label AS same_contract FROM n v JOIN a USING (key) WHERE v.split = 'valid'""")
def _(t):
    """Validation rows whose text is in training, and whether all its rows there have their label."""
    n = t("documents").join(t("labels"), "doc_id", "left").select("doc_id", normalize_text(F.col("text")).alias("key"), F.expr(SPLIT).alias("split"), F.coalesce("quality", F.lit(-1)).alias("label"))
    a = n.where("split = 'train'").groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("train_rows"))
    v = n.where("split = 'valid'").join(a, "key")
    return v.select("doc_id", "train_rows", ((F.col("low") == F.col("high")) & (F.col("low") == F.col("label"))).alias("same_contract"))


@query("release_rates", "WITH c AS (SELECT o_totalprice < 200000 AS accepted, o_orderstatus = 'F' AS exact, o_orderpriority LIKE '1%' AS mandatory, o_orderkey % 9 = 0 AS gate FROM orders) SELECT count(*) AS cases, count(*) FILTER (WHERE exact) AS exact, count(*) FILTER (WHERE exact AND accepted)::DOUBLE / count(*) FILTER (WHERE accepted) AS accepted_precision, count(*) FILTER (WHERE mandatory) AS mandatory_cases, count(*) FILTER (WHERE exact AND mandatory)::DOUBLE / count(*) FILTER (WHERE mandatory) AS mandatory_rate, count(*) FILTER (WHERE gate) AS gate_cases, count(*) FILTER (WHERE exact AND gate)::DOUBLE / count(*) FILTER (WHERE gate) AS gate_rate FROM c")
def _(t):
    c = t("orders").select((F.col("o_totalprice") < 200000).alias("accepted"), (F.col("o_orderstatus") == "F").alias("exact"), F.col("o_orderpriority").startswith("1").alias("mandatory"), (F.col("o_orderkey") % 9 == 0).alias("gate"))
    return release_rates(c, ["mandatory", "gate"])


@query("metric_stream", """WITH w AS (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS began, count(*) AS n, sum(value) AS total, max(value) AS most FROM events GROUP BY 1, 2), m AS (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR AS mark FROM events) SELECT event_type, began AS window_start, n, round(total, 4) AS total, most FROM w, m WHERE began + INTERVAL 6 HOUR <= mark""")
def _(t):
    """Events as a stream: windows of six hours, closed an hour behind the latest event, through the resumable sink."""
    events = t("events")
    spark, file = events.sparkSession, events.inputFiles()[0]
    parent, name = file.rsplit("/", 1)
    glob = "*" if parent.endswith(".parquet") else name  # a table is a folder of files, or a file
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", glob).parquet(parent)
    windows = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("most"))
    rows = windows.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n", F.round("total", 4).alias("total"), "most")
    path = folder(spark, "metrics")
    resumable(rows, f"{path}/rows", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    found = written(spark, f"{path}/rows")
    return found if found is not None else spark.createDataFrame([], rows.schema)
