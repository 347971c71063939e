"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.llm.align import aligned
from quillspark.llm.crossparse import languages
from quillspark.llm.crosspoly import nearest
from quillspark.llm.curriculum import mix
from quillspark.llm.decontaminate import contamination
from quillspark.llm.divergence import divergence
from quillspark.llm.katz import katz_scores
from quillspark.llm.packing import shard
from quillspark.llm.piecebpe import PieceModel, token_counts
from quillspark.llm.rotacode import near_vectors
from quillspark.llm.rules import quality_scores
from quillspark.llm.setsketch import near_duplicates
from quillspark.llm.warc import round_trip
from quillspark.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, remainder: int):
    """crc32 of the id as text falls on the held-out remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(_table(spark, sf_dir, "documents"), ~held_out(7, 2), order=3)


def op2_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), ~held_out(4, 2))


def op5_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"), ~held_out(3, 1))


def op7_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(_table(spark, sf_dir, "documents"), PieceModel.load(str(public_tokenizers.path("piece_bpe_32k.model"))))


def op8_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"))


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the position of their first pass; positions holds those of all passes."""
    mixed = mix(_table(spark, sf_dir, "documents")).withColumn("position", F.get("positions", F.lit(0)))
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op11_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_suffix_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a = Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(encoding="utf-8")
    b = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return aligned(_table(spark, sf_dir, "documents"), a, b)


def op13_support_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_katz_backoff": op1_katz_backoff,
    "op2_setsketch": op2_setsketch,
    "op3_rotation_codes": op3_rotation_codes,
    "op4_rule_ensemble": op4_rule_ensemble,
    "op5_cgk_decontamination": op5_cgk_decontamination,
    "op6_cross_parsing": op6_cross_parsing,
    "op7_piece_counts": op7_piece_counts,
    "op8_vector_packing": op8_vector_packing,
    "op9_warc_salvage": op9_warc_salvage,
    "op10_curriculum": op10_curriculum,
    "op11_cross_polytope": op11_cross_polytope,
    "op12_suffix_transducer": op12_suffix_transducer,
    "op13_support_divergence": op13_support_divergence,
}
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_REACH = "e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), c AS (SELECT a, min(least(a, b)) AS c FROM r GROUP BY 1)"

ORACLES: dict[str, str] = {
    "op2_setsketch": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id""",
    "op3_rotation_codes": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.98), {_REACH}, k AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(k.n, 0) AS n_links, coalesce(c.c, vec_id) AS component_id, coalesce(c.c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op9_warc_salvage": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, strlen(h) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS w FROM p),
q AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(x, (i * 5 + 1)::INT, 5))::BIGINT) AS y FROM d)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(y, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 15) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 10) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> 5) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v & 31)::INT + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = w THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> w THEN w END AS refers_to FROM q""",
    "op13_support_divergence": r"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, term, count(*) AS n FROM (SELECT r, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM t GROUP BY 1, 2 HAVING count(*) >= 30), v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM k GROUP BY 1),
c AS (SELECT t.lang, source, term, sum(t.n)::BIGINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS total FROM c GROUP BY 1, 2) USING (lang, source)),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total + 5 * v.v) AS p, 1 + (1000000000 * (k.n + 5)::HUGEINT) // (v.total + 5 * v.v) AS q
 FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM o) WHERE part = 'pair' OR rank <= 50""",
}
