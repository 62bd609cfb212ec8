"""The contract's queries: thin digests over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaspark.llm import ann, bpe, conversations, html_extract, jaccard, katz, langid, line_dedup, mixing, quality, simhash, spelling, suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, keep_text=False)


def op2_katz_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_ids=False)
    return out.select("doc_id", F.col("token_count").alias("n_tokens"), "ids_sha256", "decoded_sha256")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_shared_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("line_count").alias("n_lines"), F.col("line_dropped").alias("n_dropped"),
        F.sha2(F.col("line_kept"), 256).alias("kept_sha256"),
    )


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.col("main_chars").alias("n_chars"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.drop("text")


def op9_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    samples = langid.sample_languages(docs.where(~held_out))
    out = langid.identify(docs.select("doc_id", "text"), samples)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    # The contract's misspellings: one run in 199 loses a code point; a null id is the empty text.
    run = docs.select("doc_id", F.explode(spelling.runs(F.col("text"))).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    hashed = run.select("run", h.alias("h"))
    gone = F.col("h") % F.length("run")
    cut = F.concat(F.substring("run", F.lit(1), gone.cast("int")), F.substring("run", (gone + 2).cast("int"), F.length("run")))
    words = hashed.select(F.when(F.col("h") % 199 == 0, cut).otherwise(F.col("run")).alias("word"))
    return spelling.variants(spelling.count_words(words))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # The contract's damage, by a hash of conversation and turn; nulls are one space.
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    damaged = rows.where(k != 0).select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1))).alias("copy"))
    return conversations.report_for(rows, conversations.repair(damaged).report)


def op13_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_katz_score": op2_katz_score,
    "op3_bpe_round_trip": op3_bpe_round_trip,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_mix_sources": op5_mix_sources,
    "op6_line_dedup": op6_line_dedup,
    "op7_main_text": op7_main_text,
    "op8_quality_rules": op8_quality_rules,
    "op9_hash_prefix_forest": op9_hash_prefix_forest,
    "op10_language_id": op10_language_id,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_simhash_groups": op13_simhash_groups,
}

ORACLE_SQL: dict[str, str] = {
    "op4_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
entries AS (SELECT doc_id, unnest(s) AS k FROM sets),
shared AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS o FROM entries a JOIN entries b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT i, j FROM shared JOIN sizes x ON x.doc_id = i JOIN sizes y ON y.doc_id = j WHERE 100 * o >= 80 * (x.n + y.n - o)),
edges AS (SELECT i, j FROM links UNION SELECT j, i FROM links),
reached AS (
  SELECT doc_id AS node, doc_id AS least FROM documents
  UNION SELECT e.j, r.least FROM reached r JOIN edges e ON r.node = e.i WHERE r.least < e.j)
SELECT s.doc_id, s.n AS n_shingles, min(r.least) AS component_id FROM sizes s JOIN reached r ON r.node = s.doc_id GROUP BY 1, 2
""",
    "op6_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents)),
common AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN common c USING (key)
GROUP BY doc_id
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE runs AS (
  SELECT d, run, count(*) AS c
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run
        FROM documents)
  GROUP BY 1, 2),
bytes AS (SELECT run, c, hex(encode(d || ':' || run)) AS x FROM runs),
-- crc32 bit by bit, the lowest bit of each byte first.
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(
           list_transform(range(4 * length(x)), lambda j: ((strpos('0123456789ABCDEF', x[2 * (j // 8) + (CASE WHEN j % 8 < 4 THEN 2 ELSE 1 END)]) - 1) >> (j % 4)::INT) & 1),
           lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295::BIGINT)) AS h
  FROM bytes),
words AS (
  SELECT word, sum(c)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
less AS (SELECT word, i, word[1:i - 1] || word[i + 1:] AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
-- A word is another without one code point, or both are the same without the one at the same place.
near AS (
  SELECT l.word AS a, w.word AS b FROM less l JOIN words w ON l.k = w.word
  UNION SELECT w.word, l.word FROM less l JOIN words w ON l.k = w.word
  UNION SELECT x.word, y.word FROM less x JOIN less y ON x.k = y.k AND x.i = y.i AND x.word <> y.word),
ranked AS (
  SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r
  FROM near JOIN words ON words.word = near.b),
told AS (
  SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.n >= 5 * w.n THEN r.b END AS form, CASE WHEN r.n >= 5 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON r.a = w.word AND r.r = 1),
steps AS (
  SELECT word, word AS root, form AS next FROM told
  UNION ALL SELECT s.word, t.word, t.form FROM steps s JOIN told t ON s.next = t.word)
SELECT t.word, t.form, s.root, t.n, t.n_near, t.form_n FROM told t JOIN steps s ON s.word = t.word AND s.next IS NULL
""",
    "op12_conversation_repair": r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))) AS x
  FROM conversations),
-- crc32 bit by bit, the lowest bit of each byte first.
hashed AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(
           list_transform(range(4 * length(x)), lambda j: ((strpos('0123456789ABCDEF', x[2 * (j // 8) + (CASE WHEN j % 8 < 4 THEN 2 ELSE 1 END)]) - 1) >> (j % 4)::INT) & 1),
           lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295::BIGINT)) % 20 AS h
  FROM source),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM hashed WHERE h <> 0),
ordered AS (
  SELECT conv_id, turn, role, text, left(role, 1) AS initial, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS r,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
  FROM damaged),
faults AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY r) || initial AS met
  FROM ordered),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE met NOT IN ('su', 'ua', 'au')) AS illegal, max(r) AS last
  FROM faults GROUP BY conv_id),
-- States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; up to two insertions, then an edit of the row.
inserted(g, s, labels, cost, added) AS (
  VALUES (0, 0, '', 0, ''), (0, 2, 'I', 5, chr(10) || 'user:'), (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
         (1, 1, '', 0, ''), (1, 2, 'I', 5, chr(10) || 'user:'), (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'),
         (2, 2, '', 0, ''), (2, 3, 'I', 5, chr(10) || 'assistant:'),
         (3, 3, '', 0, ''), (3, 2, 'I', 5, chr(10) || 'user:')),
edits(s, edit, initial, g, cost, role) AS (
  VALUES (0, 'D', '', 0, 2, ''), (1, 'D', '', 1, 2, ''), (2, 'D', '', 2, 2, ''), (3, 'D', '', 3, 2, ''),
         (0, 'K', 's', 1, 0, ''), (0, 'K', 'u', 2, 0, ''), (1, 'K', 'u', 2, 0, ''), (2, 'K', 'a', 3, 0, ''), (3, 'K', 'u', 2, 0, ''),
         (0, 'R', '', 2, 1, 'user'), (1, 'R', '', 2, 1, 'user'), (2, 'R', '', 3, 1, 'assistant'), (3, 'R', '', 2, 1, 'user')),
moves AS (
  SELECT i.g AS before, e.g AS after, i.labels || e.edit AS labels, i.cost + e.cost AS cost, i.added, e.edit, e.initial, e.role
  FROM inserted i JOIN edits e ON e.s = i.s),
best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS r, 0 AS g, 0::BIGINT AS cost, '' AS labels, '' AS kept FROM faults
  UNION ALL
  SELECT b.conv_id, f.r, m.after, b.cost + m.cost + CASE WHEN f.fault = 't' AND m.edit <> 'D' THEN 5 ELSE 0 END, b.labels || m.labels,
         b.kept || m.added || CASE m.edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || f.role || ':' || f.text ELSE chr(10) || m.role || ':' || f.text END
  FROM best b JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.r = b.r + 1
  JOIN moves m ON m.before = b.g AND (m.edit = 'D' OR f.fault NOT IN ('b', 'd') AND (m.edit = 'R' OR m.initial = f.initial))
  QUALIFY row_number() OVER (PARTITION BY b.conv_id, m.after
    ORDER BY b.cost + m.cost + CASE WHEN f.fault = 't' AND m.edit <> 'D' THEN 5 ELSE 0 END, b.labels || m.labels) = 1),
tails(g, labels, cost, added) AS (VALUES (0, '', 0, ''), (1, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 'I', 5, chr(10) || 'assistant:'), (3, '', 0, '')),
ended AS (
  SELECT b.conv_id, b.cost + t.cost AS cost, b.labels || t.labels AS audit, sha256((b.kept || t.added)[2:]) AS repaired_sha256
  FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.last = b.r JOIN tails t ON t.g = b.g
  QUALIFY row_number() OVER (PARTITION BY b.conv_id ORDER BY b.cost + t.cost, b.labels || t.labels) = 1)
SELECT i.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(e.cost, 0) AS cost, coalesce(e.audit, '') AS audit, coalesce(e.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id
""",
}
