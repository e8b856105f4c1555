"""One registered query per operator, with production parameters over its whole table, and the SQL that states
the result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralex.llm import (
    chunk_bpe, curriculum, deleted_interpolation, host_rules, language_id, merge_path, random_indexing, separator_scan, signature_join, snapshots, spelling, toxic_spans,
    weighted_sampling,
)
from terralex.llm.common import documents
from terralex.session import ship_package


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_weighted_sampling(spark: SparkSession, folder: str) -> DataFrame:
    return weighted_sampling.fingerprint_documents(documents(spark, folder))


def op2_snapshot_collapse(spark: SparkSession, folder: str) -> DataFrame:
    ship_package(spark)
    return snapshots.collapse(spark.read.parquet(f"{folder}/conversations.parquet"))


def op3_chunk_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_bpe.encode_documents(documents(spark, folder), chunk_bpe.ChunkSettings(_vocabulary("word_bpe_49k.json")))


def op4_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    return host_rules.score_documents(documents(spark, folder))


def op5_separator_scan(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = separator_scan.Ranks(_vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    path, written = separator_scan.write_token_files(documents(spark, folder), ranks)
    found = separator_scan.count_tokens(spark, path)
    return found.join(written, ["file", "ordinal"], "left").select("doc_id", "file", "ordinal", "start", "n_tokens", "closed")


def op6_signature_join(spark: SparkSession, folder: str) -> DataFrame:
    return signature_join.memberships(documents(spark, folder)).select("doc_id", "n_shingles", "component_id", "kept")


def op7_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    mixed = curriculum.mix(documents(spark, folder))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = mixed.repartitionByRange(width, F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")
    return ordered.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.col("copies").cast("long").alias("copies"), F.round("position", 6).alias("position"))


def op8_deleted_interpolation(spark: SparkSession, folder: str) -> DataFrame:
    return deleted_interpolation.score_documents(documents(spark, folder))


def op9_toxic_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = toxic_spans.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return toxic_spans.predict(docs, model)


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return language_id.predict(docs, language_id.fit(docs))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.group_variants(documents(spark, folder))


def op12_random_indexing(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return random_indexing.predict(docs, random_indexing.fit(docs, spark.read.parquet(f"{folder}/labels.parquet")))


def op13_merge_path(spark: SparkSession, folder: str) -> DataFrame:
    return merge_path.cross_align(documents(spark, folder), merge_path.AlignSettings(_vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_weighted_sampling, op2_snapshot_collapse, op3_chunk_bpe, op4_host_rules, op5_separator_scan, op6_signature_join, op7_curriculum,
        op8_deleted_interpolation, op9_toxic_spans, op10_language_id, op11_spelling_variants, op12_random_indexing, op13_merge_path)
}

ORACLES: dict[str, str] = {
    "op2_snapshot_collapse": r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER w AS n, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) AS line,
         concat_ws(chr(31), coalesce(role, chr(29)), coalesce(text, chr(29))) AS item
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
prefixes AS (
  SELECT conv_id, n, md5(string_agg(item, chr(30)) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING)) AS h,
         n = max(n) OVER (PARTITION BY conv_id) AS whole FROM turns),
kept AS (
  SELECT min(conv_id) AS conv_id, n FROM prefixes p WHERE whole AND NOT EXISTS (SELECT 1 FROM prefixes q WHERE NOT q.whole AND q.n = p.n AND q.h = p.h)
  GROUP BY n, h)
SELECT k.conv_id, k.n AS n_turns, string_agg(t.line, '' ORDER BY t.n) AS rendered
FROM kept k JOIN turns t ON t.conv_id = k.conv_id GROUP BY k.conv_id, k.n""",
    "op4_host_rules": r"""
WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
words AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM docs),
windows AS (
  SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows WHERE g IS NOT NULL) WHERE n > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (VALUES (0), (1), (2)) AS t(k) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.source, len(d.words)::BIGINT AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(d.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN lines l USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM judged GROUP BY source),
prior AS (SELECT avg(f / n) AS m, var_samp(f / n) AS v FROM hosts),
weight AS (SELECT m, CASE WHEN v IS NULL OR v = 0 THEN 2.0 ELSE greatest(m * (1 - m) / v - 1, 2.0) END AS k FROM prior),
rates AS (SELECT source, (f + m * k) / (n + k) AS host_rate FROM hosts, weight)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, NOT base_failed AND host_rate <= 0.5 AS kept
FROM judged j JOIN rates r ON r.source IS NOT DISTINCT FROM j.source""",
    "op6_signature_join": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs p JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (SELECT a AS doc_id, a AS seen FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen),
least AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(least(component_id, d.doc_id), d.doc_id) AS component_id,
       d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)""",
    "op7_curriculum": r"""
WITH sized AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS o, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
dealt AS (
  SELECT source, source_size, rank, [5.0, 2.0, 1.0][rank % 3 + 1]::DOUBLE AS weight, [1.5, 0.5, 1.0][rank % 3 + 1]::DOUBLE AS a, [0.5, 1.5, 1.0][rank % 3 + 1]::DOUBLE AS b,
         (3 * source_size)::DOUBLE AS cap FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level
  FROM dealt WINDOW f AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, a, b, CASE WHEN cap / weight <= level THEN cap ELSE weight * first_level END AS target
  FROM (SELECT *, arg_min(level, cap / weight) FILTER (WHERE cap / weight > level) OVER () AS first_level FROM levels)),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.a, t.b, floor(t.target)::BIGINT AS goal,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sized s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS full_runs,
         greatest(least(size, goal - CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * source_size - ahead), 0) AS part FROM placed),
areas AS (SELECT *, (full_runs * size + part)::BIGINT AS taken, least(ahead / target, 1.0) * (a + b) / 2 AS area FROM cut)
SELECT doc_id, size, source_size, round(target, 6) AS target, taken,
       (CASE WHEN size = 0 THEN 0 ELSE full_runs + CASE WHEN 2 * part >= size AND part > 0 THEN 1 ELSE 0 END END)::BIGINT AS copies,
       round(CASE WHEN taken > 0 THEN least(2 * area / (a + sqrt(a * a + 2 * (b - a) * area)), 1.0) END, 6) AS position
FROM areas""",
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents) GROUP BY ALL HAVING length(run) >= 5),
hexed AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda k: (position(substr(x, 2 * k + 1, 1) IN '0123456789ABCDEF') - 1) * 16 + position(substr(x, 2 * k + 2, 1) IN '0123456789ABCDEF') - 1)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, crc),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, w.word, w.n FROM cut x JOIN words w ON w.word = x.a || x.b
  UNION SELECT w.word, x.word, x.n FROM cut x JOIN words w ON w.word = x.a || x.b),
ranked AS (SELECT word, near, near_n, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
formed AS (
  SELECT w.word, CASE WHEN near_n >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.word = w.word AND k = 1),
chains AS (SELECT word, form AS at FROM formed WHERE form IS NOT NULL UNION ALL SELECT c.word, f.form FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at FROM chains c JOIN formed f ON f.word = c.at WHERE f.form IS NULL)
SELECT f.word, form, coalesce(e.at, f.word) AS root, n, n_near, form_n FROM formed f LEFT JOIN ends e USING (word)""",
}
