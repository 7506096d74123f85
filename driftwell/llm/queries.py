"""The registered queries of this subpackage. Each applies one operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import lm_scoring
from driftwell.llm.decontamination import benchmark_hits, n_hit
from driftwell.llm.fingerprints import edited_neighbours
from driftwell.llm.language_id import identify, learn
from driftwell.llm.line_dedup import dedup_lines
from driftwell.llm.mixing import mix
from driftwell.llm.near_duplicates import near_duplicates
from driftwell.llm.repeats import repeated_spans
from driftwell.llm.shared import table
from driftwell.llm.sharding import shards
from driftwell.llm.toxicity import toxicity


#: A-Z lower-cased, then words as lists.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_WORDS = "coalesce(regexp_extract_all(" + _LOWER.format("text") + r", '[^\x20\x09-\x0D]+'), [])"

OP3_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS p FROM b WHERE n >= 50)),
f AS (SELECT s, min(doc_id) AS m FROM g GROUP BY s),
hit AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 AS new FROM g JOIN f USING (s) WHERE m < doc_id),
islands AS (SELECT doc_id, p, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit),
runs AS (SELECT doc_id, min(p) AS lo, max(p) + 50 AS hi FROM islands GROUP BY doc_id, k),
gaps AS (
    SELECT doc_id, coalesce(lag(hi) OVER w, 0) AS lo, lo AS hi FROM runs WINDOW w AS (PARTITION BY doc_id ORDER BY lo)
    UNION ALL SELECT b.doc_id, coalesce(max(runs.hi), 0), any_value(b.n) FROM b LEFT JOIN runs USING (doc_id) GROUP BY b.doc_id
),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS h FROM gaps JOIN b USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, sum(hi - lo) AS n, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(removed.n, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(removed.spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM b JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n AS nx ON nx.doc_id = x JOIN n AS ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id, doc_id AS reach FROM d UNION SELECT r.doc_id, ways.y FROM r JOIN ways ON r.reach = ways.x)
SELECT r.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach) AS component_id, r.doc_id = min(reach) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""

OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_ALNUM.format("text")}, []) AS w FROM documents),
b AS (SELECT DISTINCT item_id, coalesce({_ALNUM.format("text")}, []) AS w FROM benchmark),
bw AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
    SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS g
    FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, sizes WHERE len(w) >= size)
),
hit AS (SELECT doc_id, item_id, i, size FROM dw JOIN bw USING (size, g)),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS k FROM hit) GROUP BY doc_id),
items AS (
    SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id COLLATE "C") AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("class_key")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_scoring.score(docs, *lm_scoring.learn(docs))
    mean = F.when(F.col("n_words") > 0, F.col("pseudo_log_likelihood") / F.col("n_words"))
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_words", "pseudo_log_likelihood", mean.alias("mean_log_likelihood"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def id_part(parts: int) -> Column:
    """The remainder of crc32 of the id as text that deals rows into parts; a null id reads as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(id_part(3) != 1)
    out = toxicity(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", (id_part(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = learn(docs.where(id_part(5) != 0))
    out = identify(docs.select("doc_id", "text"), trees)
    return out.select(F.col("row.doc_id").alias("doc_id"), "lang_pred", "score").withColumn("held_out", id_part(5) == 0)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_neighbours(table(spark, sf_dir, "documents"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = benchmark_hits(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return hits.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        digest.alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mixing, op2_lm_scoring, op3_repeated_passages, op4_near_duplicates, op5_sharding, op6_toxicity, op7_line_dedup, op8_language_id, op9_fingerprints, op10_benchmark_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op3_repeated_passages": OP3_SQL, "op4_near_duplicates": OP4_SQL, "op10_benchmark_decontamination": OP10_SQL}
