"""One query for each operation, over whole tables; SQL twins where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from liveops.llm import (
    audit, decontam, langid, licences, linedup, neardup, packing, ppm, preference, resample, vafile, warc,
    winnow,
)
from liveops.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query()
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"))


@_query(
    """
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS size FROM pages
), origin AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS origin FROM page)
SELECT page_id, size AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN size >= 1000 AND page_id <> origin THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 1000 AND page_id <> origin THEN origin END AS refers_to
FROM origin
"""
)
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(_table(spark, folder, "pages"), path)
    return warc.read(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@_query()
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def _rendered(turns: str) -> str:
    return f"""array_to_string(list_transform({turns}, lambda t: '{preference.START}' || coalesce(t.role, '')
    || chr(10) || replace(coalesce(t.text, ''), '<|im_', '<| im_') || '{preference.STOP}' || chr(10)), '')"""


def _signed(turns: str) -> str:
    return f"""array_to_string(list_transform({turns}, lambda t:
    '-' || (length(coalesce(t.role, '')) + {len(preference.START) + 1})
    || CASE WHEN t.role = '{preference.TRAINED}' THEN '+' ELSE '-' END
    || (length(replace(coalesce(t.text, ''), '<|im_', '<| im_')) + {len(preference.STOP) + 1})), '')"""


@_query(
    f"""
WITH talk AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS turns
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL) GROUP BY 1
), opened AS (
  SELECT *, count(*) OVER w AS n, first_value(conv_id) OVER (w ORDER BY len(turns) DESC, conv_id) AS chosen_id
  FROM talk WINDOW w AS (PARTITION BY turns[1])
), pair AS (
  SELECT 'opening' AS kind, chosen_id, o.conv_id AS rejected_id, t.turns AS chosen, o.turns AS rejected
  FROM opened o JOIN talk t ON t.conv_id = chosen_id WHERE o.conv_id <> chosen_id
  UNION ALL
  SELECT 'reply', a.conv_id, b.conv_id, a.turns, list_append(a.turns[:len(a.turns) - 1],
    struct_pack(role := a.turns[-1].role, text := b.turns[-1].text))
  FROM talk a JOIN talk b ON b.conv_id = a.conv_id + 1
), split AS (
  SELECT *, CAST(list_position(list_transform(range(1, greatest(len(chosen), len(rejected)) + 1),
    lambda i: chosen[i] IS NOT DISTINCT FROM rejected[i]), false) - 1 AS INTEGER) AS prefix_turns FROM pair
)
SELECT kind, chosen_id, rejected_id, prefix_turns, {_rendered("chosen[:prefix_turns]")} AS prompt,
  {_rendered("chosen[prefix_turns + 1:]")} AS chosen_text, {_rendered("rejected[prefix_turns + 1:]")} AS rejected_text,
  {_signed("chosen[prefix_turns + 1:]")} AS chosen_mask, {_signed("rejected[prefix_turns + 1:]")} AS rejected_mask
FROM split WHERE prefix_turns IS NOT NULL
"""
)
def op4_preference(spark: SparkSession, folder: str) -> DataFrame:
    talks = preference.conversations(_table(spark, folder, "conversations"))
    pairs = preference.same_opening(talks).withColumn("kind", F.lit("opening")).unionByName(
        preference.swapped_reply(talks).withColumn("kind", F.lit("reply"))
    )
    return preference.format_pairs(pairs).select(
        "kind", "chosen_id", "rejected_id", "prefix_turns", "prompt", "chosen_text", "rejected_text",
        preference.mask(F.col("chosen_segments")).alias("chosen_mask"),
        preference.mask(F.col("rejected_segments")).alias("rejected_mask"),
    )


@_query()
def op5_licences(spark: SparkSession, folder: str) -> DataFrame:
    found = licences.scan(_table(spark, folder, "documents"))

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    share = F.transform("spans", lambda s: s["covered"] / s["template_words"])
    phrase = F.when(F.size("phrase_starts") > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("phrase_starts").cast("long").alias("n_base"),
        F.array_min("phrase_starts").alias("first_word"), F.array_max("phrase_starts").alias("last_word"),
        joined(F.col("phrase_labels")).alias("base_labels"),
        joined(F.concat("phrase_labels", "spans.label")).alias("labels"),
        F.greatest(phrase, F.array_max(share)).alias("score"),
    )


@_query(
    """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), score AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM score
) WHERE rank <= 5
"""
)
def op6_topk(spark: SparkSession, folder: str) -> DataFrame:
    return vafile.top_k(_table(spark, folder, "embeddings"))


@_query()
def op7_templates(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query()
def op8_ppm(spark: SparkSession, folder: str) -> DataFrame:
    held = langid.held_out(folds=10)
    return ppm.score(_table(spark, folder, "documents"), held).select(
        "doc_id", langid.held_out(folds=10).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


@_query(
    f"""
WITH line AS (
  SELECT * FROM (
    SELECT doc_id, u.i - 1 AS line, u.line AS words_of,
      len(list_filter(regexp_extract_all(u.line, '{linedup.SQL_WORD}'), lambda w: w <> '')) AS words
    FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)
  ) WHERE words > 0
), seq AS (
  SELECT *, row_number() OVER w AS seq, sum(words) OVER w AS upto FROM line
  WINDOW w AS (PARTITION BY doc_id ORDER BY line)
), part AS (
  SELECT a.doc_id, a.seq AS head, min(b.seq) AS tail FROM seq a JOIN seq b
    ON a.doc_id = b.doc_id AND b.upto - a.upto + a.words >= {linedup.MIN_WORDS} AND b.seq >= a.seq
  GROUP BY 1, 2
  UNION
  SELECT a.doc_id, max(b.seq), a.seq FROM seq a JOIN seq b
    ON a.doc_id = b.doc_id AND a.upto - b.upto + b.words >= {linedup.MIN_WORDS} AND b.seq <= a.seq
  GROUP BY 1, 3
), run AS (
  SELECT p.doc_id, head, tail, string_agg(words_of, chr(10) ORDER BY seq) AS run
  FROM part p JOIN seq s ON s.doc_id = p.doc_id AND s.seq BETWEEN head AND tail GROUP BY 1, 2, 3
), first AS (SELECT run, min((doc_id, head)) AS origin FROM run GROUP BY 1),
gone AS (
  SELECT DISTINCT s.doc_id, s.line FROM run r JOIN first f USING (run)
  JOIN seq s ON s.doc_id = r.doc_id AND s.seq BETWEEN head AND tail WHERE (r.doc_id, head) > origin
), kept AS (
  SELECT d.doc_id, string_agg(CASE WHEN g.line IS NULL THEN u.line END, chr(10) ORDER BY u.i) AS text,
    count(*) AS n_lines, count(g.line) AS n_deleted
  FROM documents d, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, i)
  LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.line = u.i - 1 GROUP BY 1
)
SELECT d.doc_id, CASE WHEN n_deleted > 0 THEN coalesce(k.text, '') ELSE d.text END AS text,
  CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_deleted, 0) AS INTEGER) AS n_deleted
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
)
def op9_lines(spark: SparkSession, folder: str) -> DataFrame:
    return linedup.line_dedup(_table(spark, folder, "documents")).select(
        "doc_id", "text", "n_lines", "n_deleted"
    )


@_query()
def op10_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"))


@_query()
def op11_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    found = winnow.edited(_table(spark, folder, "documents"))
    return found.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited_text", 256).alias("edited_sha256"),
        winnow.shown(F.col("found")).alias("fingerprint"),
        winnow.shown(F.col("edited_found")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def _features(table: str) -> str:
    return f"""
SELECT doc_id, len(words) AS n_words,
  unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS feature
FROM (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words
  FROM {table}
)"""


@_query(
    f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, list_value(0, 0, 0, 0, 0, 0, 0, 0)), lambda c, unused:
      CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) AS r(i))
), ours AS ({_features("documents")}), theirs AS ({_features("(SELECT 0 AS doc_id, text FROM benchmark)")}
), bucket AS (
  SELECT feature, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
    range(1, strlen(feature) + 1), lambda i: (instr('123456789ABCDEF', hex(feature)[2 * i - 1]) * 16
      + instr('123456789ABCDEF', hex(feature)[2 * i])))),
    lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]))) % {resample.BUCKETS} AS bucket
  FROM (SELECT feature FROM ours UNION SELECT feature FROM theirs), crc
), s AS (SELECT bucket, count(*) AS n FROM ours JOIN bucket USING (feature) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM theirs JOIN bucket USING (feature) GROUP BY 1),
gain AS (
  SELECT s.bucket, CAST(floor(1000 * ln(
    CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM ours) + {resample.BUCKETS} AS DOUBLE)
    / (CAST(s.n + 1 AS DOUBLE) * CAST((SELECT count(*) FROM theirs) + {resample.BUCKETS} AS DOUBLE))
  )) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)
), weighed AS (
  SELECT doc_id, max(n_words) AS n_words, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total
  FROM ours JOIN bucket USING (feature) JOIN gain USING (bucket) GROUP BY 1
), hashed AS (
  SELECT doc_id, list_reduce(list_prepend(0, list_transform(range(1, 9), lambda i:
    instr('123456789abcdef', sha256('{resample.SEED}:' || doc_id)[i]))), lambda h, x: h * 16 + x) AS h
  FROM documents
), scored AS (
  SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE (total - (total % n + n) % n) // n END AS weight,
    CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS noise
  FROM hashed LEFT JOIN weighed USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= {resample.MIN_WORDS} ORDER BY weight + noise DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_words >= {resample.MIN_WORDS}) AS able
  FROM scored
)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight,
  CAST(weight + noise AS BIGINT) AS score,
  CASE WHEN n_words >= {resample.MIN_WORDS} AND place <= {resample.SHARE} * able // 100 THEN place END AS rank
FROM ranked
"""
)
def op12_resample(spark: SparkSession, folder: str) -> DataFrame:
    return resample.resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query(
    """
WITH word AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least
  FROM documents
), fail AS (
  SELECT doc_id, part, [
    CAST(len(words) < 100 AS BIGINT), CAST(100 * len(list_distinct(words)) < 80 * len(words) AS BIGINT),
    CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) AS BIGINT),
    CAST(regexp_matches(text, '[#$%&*|]') AS BIGINT), CAST(coalesce(doc_id > least, false) AS BIGINT)
  ] AS bad FROM word
), label AS (
  SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS BIGINT)) AS good,
    max(CAST(coalesce(toxic = 1, false) AS BIGINT)) AS toxic
  FROM labels GROUP BY 1
), kind AS (
  SELECT part, bad, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, count(*) AS n
  FROM fail LEFT JOIN label USING (doc_id) GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), step AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS filter,
    list_transform(range(1, s + 1), lambda i: ascii(filter_order[i]) - 64) AS upto
  FROM orders, range(1, 6) AS r(s)
), outcome AS (
  SELECT part, filter_order, step, filter, n, good, toxic,
    bad[upto[-1]] AS fails, list_sum(list_transform(upto, lambda i: bad[i])) AS so_far, list_sum(bad) AS of_all
  FROM kind, step
), counted AS (
  SELECT part, filter_order, step, filter,
    sum(CASE WHEN so_far = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN fails = 1 AND so_far = 1 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN fails = 1 AND so_far > 1 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = 1 AND of_all = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN fails = 1 AND so_far = 1 THEN n * good ELSE 0 END) AS good_lost,
    sum(CASE WHEN fails = 1 AND so_far = 1 THEN n * toxic ELSE 0 END) AS toxic_lost
  FROM outcome GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM counted
"""
)
def op13_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
