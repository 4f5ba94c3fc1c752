"""One thin query per operator: it applies the operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import format_chats, read_back, unescape
from .decontaminate import contamination
from .jaccard import near_duplicates
from .language_id import identify
from .packing import pack
from .periodic import periodic_runs
from .repeats import without_repeats
from .resampling import resample
from .tables import table
from .token_counts import token_counts
from .token_files import token_files
from .topk import top_k
from .url_filter import judge_urls
from .warc import archived


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are the labels table's, read as those of the pages of the same id: bad is toxic or of low quality."""
    labels = table(spark, sf_dir, "labels")
    bad = (F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)
    return judge_urls(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop("ids")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, seq long, role string, text string")
    log = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text").unionByName(own)
    turns = read_back(F.col("formatted"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return (
        format_chats(log)
        .withColumn("turns", turns)
        .withColumn("learnt", learnt)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(told, 256).alias("turns_sha256"),
            F.length("learnt").cast("long").alias("loss_chars"),
            F.sha2("learnt", 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fifth of the documents, by a hash of doc_id, takes no part in training; lang, source and doc_id are no inputs."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return identify(docs, docs.filter(fold != 0)).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents")).drop("ids")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archived(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, by a hash of doc_id, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("words"), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")
    changed = F.array_join(F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    worded = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"))
    placed = worded.withColumn("a", F.when(n > 0, a)).withColumn("p", F.when(n > 0, p))
    return placed.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periodic_tails(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # runs come by start, then period, so the first of those with the greatest exponent wins
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_packing, op3_chat_format, op4_top_k, op5_decontamination, op6_language_id, op7_repeats, op8_token_counts, op9_token_files, op10_near_duplicates, op11_resampling, op12_warc, op13_periodic_runs)}
ORACLE_SQL: dict[str, str] = {
    "op4_top_k": """
WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.n <> c.n AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 10
""",
    "op11_resampling": """
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) AS r(i)
), texts AS (
  SELECT 's' AS side, row_number() OVER () AS n, doc_id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), NULL, text FROM benchmark
), worded AS (
  SELECT side, n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), feats AS (
  SELECT side, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM worded
), counted AS (
  SELECT side, n, f, count(*) AS k FROM feats GROUP BY ALL
), named AS (
  SELECT f, list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT DISTINCT f FROM counted)
), bucketed AS (
  SELECT f, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 10000 AS bucket FROM named, crc_table
), held AS (
  SELECT side, n, bucket, sum(k)::BIGINT AS k FROM counted JOIN bucketed USING (f) GROUP BY ALL
), sums AS (
  SELECT bucket, coalesce(sum(k) FILTER (side = 's'), 0)::DOUBLE AS s, coalesce(sum(k) FILTER (side = 't'), 0)::DOUBLE AS t FROM held GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000))))::BIGINT AS gain FROM sums
), means AS (
  SELECT n, sum(k)::BIGINT AS n_features, floor(sum(k * gain)::DOUBLE / sum(k)::DOUBLE)::BIGINT AS weight FROM held JOIN gains USING (bucket) WHERE side = 's' GROUP BY n
), scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN means USING (n) WHERE side = 's'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS total FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * total // 100 THEN r END AS rank FROM ranked
""",
    "op12_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CASE WHEN strlen(coalesce(html, '')) >= 1000 THEN max(page_id) OVER (PARTITION BY coalesce(html, '')) ELSE page_id END AS original FROM pages
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
FROM p
""",
    "op3_chat_format": """
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) AS v(conv_id, turn, role, text)
), e AS (
  SELECT *,
    replace(replace(replace(replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]') AS erole,
    replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]') AS etext
  FROM log
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(erole) + length(etext) + 32)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
}
