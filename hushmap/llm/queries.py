"""Registered queries of this package and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushmap.llm import (
    chat_template,
    length_buckets,
    line_runs,
    merkle_manifest,
    mixing,
    near_embeddings,
    ngram_jaccard,
    packed_ids,
    periodic_runs,
    quality_crf,
    quality_rules,
    token_files,
    toxicity,
)
from hushmap.llm.shared import count_words, stored, words
from hushmap.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Words of a text in the checking SQL.
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_crf")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = quality_crf.score_quality(documents, _table(spark, sf_dir, "labels"))
    return made.select("doc_id", "held_out", "score", "predicted")


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id
JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = vec_id
"""


@query("op2_near_embeddings", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings.near_embeddings(_table(spark, sf_dir, "embeddings"))


@query("op3_packed_ids")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per packed row of 4,096 identifiers; the matrix itself lies in the stored rows."""
    packed = stored(packed_ids.pack_ids(_table(spark, sf_dir, "documents")))
    return packed.select(
        "row_id", "n_tokens", "doc_ids", "doc_offsets", "cu_seqlens", "resets",
        F.sha2("ids", 256).alias("ids_sha256"),
    )


@query("op4_token_counts", f"SELECT doc_id, len({WORDS}) AS n_tokens FROM documents")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return token_files.token_counts(documents, scratch_path(spark, "token-files"))


OP5_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a
)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id
"""


@query("op5_ngram_jaccard", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_documents(_table(spark, sf_dir, "documents"))


OP6_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS w FROM documents
), spots AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), again AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM spots
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM again, range(0, 8) t(k) WHERE n > 1 GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
           - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))))
           AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         length(text) - length(replace(text, '!', '')) AS n_shouts,
         length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_capitals,
         length(text) AS n_chars,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter
  FROM d LEFT JOIN covered USING (doc_id)
), based AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.3 * n_words OR n_shouts > 0.5 * n_words
            OR n_capitals > 0.5 * n_chars OR word_chars > 25 * n_words
            OR n_stutter > 0.3 * n_words) AS kept
FROM based
"""


@query("op6_quality_rules", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(
        _table(spark, sf_dir, "documents").select("doc_id", "text")
    )
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = toxicity.score_toxicity(documents, _table(spark, sf_dir, "labels"))
    return made.select("doc_id", "held_out", "score", "predicted")


@query("op8_length_buckets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return length_buckets.pack_by_length(documents, count_words(F.col("text")))


OP9_SQL = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s
), f AS (
  SELECT *, 3.0::DOUBLE * source_size / weight AS fill FROM w
), c AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
      - 3.0::DOUBLE * (sum(source_size) OVER (ORDER BY fill, place) - source_size)::DOUBLE)
    / (sum(weight) OVER ()::DOUBLE
      - (sum(weight) OVER (ORDER BY fill, place) - weight)::DOUBLE) AS level FROM f
), l AS (SELECT arg_min(level, at_order) AS level FROM (
    SELECT level, row_number() OVER (ORDER BY fill, place) AS at_order, fill FROM c) WHERE level <= fill
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, coalesce(l.level, 0) * weight) AS target
  FROM c, l
), r AS (
  SELECT doc_id, size, source_size, target, d.source,
         CASE WHEN source_size > 0 THEN
           least(floor(target / source_size * 16777216)::BIGINT, 3 * 16777216) ELSE 0 END AS units,
         ('0x' || substr(md5('7:' || coalesce(d.source, '')), 1, 6))::BIGINT AS shift,
         row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) - 1 AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       size * (((k + 1) * units + shift) // 16777216 - (k * units + shift) // 16777216) AS taken
FROM r
"""


@query("op9_mixing", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


CHAT_TEXT = "</s>[INST] ok [/INST]"
OP10_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{CHAT_TEXT}'), (-1, 1, 'assistant', '{CHAT_TEXT}')
), e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(replace(text, '\', '\\'),
        '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>|<<END>>')) AS body,
    length(role) + length(regexp_replace(role, '[^\\]', '', 'g'))
    + len(regexp_extract_all(replace(role, '\', '\\'),
        '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<<ROLE>>|<</ROLE>>|<<END>>')) AS named
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(body + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 WHEN 'system' THEN 15
    ELSE 24 + named END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op10_chat_format", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text"
    )
    extra = spark.createDataFrame(
        [(-1, 0, "user", CHAT_TEXT), (-1, 1, "assistant", CHAT_TEXT)], conversations.schema
    )
    # Formatted once, then read back from what was written.
    formatted = stored(chat_template.format_conversations(conversations.unionByName(extra)))
    return chat_template.digests(formatted)


BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP11_SQL = f"""
WITH l AS (
  SELECT doc_id, i, s[i] AS line, translate(trim(s[i], {BLANKS}),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))
), f AS (
  SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines,
  count(*) FILTER (holder IS NOT NULL AND doc_id <> holder) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i)
    FILTER (holder IS NULL OR doc_id = holder), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""


@query("op11_line_dedup", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_runs.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


#: crc32 of a decimal number in the checking SQL, byte by byte and bit by bit.
CRC32 = """xor(4294967295, list_reduce(
  list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT),
  lambda c, b: list_reduce(range(8), lambda x, z: xor(x >> 1, (x & 1) * 3988292384), xor(c, b)),
  4294967295::BIGINT))"""
OP12_SQL = f"""
WITH c AS (SELECT doc_id, {WORDS} AS w0, {CRC32} AS h FROM documents),
g AS (SELECT *, h // 10 AS g, len(w0) AS n FROM c),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
b AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
d AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n),
    lambda i: w0[1 + (CASE WHEN i < a THEN i ELSE a + (i - a) % p END)::BIGINT]) ELSE w0 END AS w
  FROM b
), grams AS (
  SELECT doc_id, i, array_to_string(w[i+1:i+6], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(0, n - 5)) AS i FROM d WHERE n >= 12)
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS p FROM grams x JOIN grams y
    ON x.doc_id = y.doc_id AND x.gram = y.gram AND x.i < y.i
), spans AS (
  SELECT doc_id, p, min(i) AS s, max(i) - min(i) + 6 + p AS len
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, p, island
), long AS (SELECT * FROM spans WHERE len >= 12 AND len >= 2 * p),
runs AS (
  SELECT * FROM long r WHERE NOT EXISTS (SELECT 1 FROM long q WHERE q.doc_id = r.doc_id
    AND q.p < r.p AND q.s <= r.s AND q.s + q.len >= r.s + r.len)
), per AS (
  SELECT doc_id, count(*) AS n_runs, arg_min({{'s': s, 'len': len, 'p': p}}, (-len, s, p)) AS best,
    string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS listed
  FROM runs GROUP BY doc_id
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM runs
), kept AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.i) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM d) e
  LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.i = e.i WHERE gone.i IS NULL GROUP BY e.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.p AS period,
  1000 * best.len // best.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by the crc32 of the id, the words from some
    place on are made to repeat with some period."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = F.when(h % 10 == 0, words(F.col("text")))
    i = F.col("_n") - 1  # the last word's number
    numbered = (
        documents.select("doc_id", "text", F.floor(h / 10).cast("long").alias("_g"), chosen.alias("_w"))
        .withColumn("_n", F.size("_w").cast("long"))
        .withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
        .withColumn("_p", 1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)).cast("long"))
    )
    a, p = F.col("_a"), F.col("_p")
    repeated = F.transform(
        F.sequence(F.lit(0).cast("long"), i),
        lambda k: F.get("_w", F.when(k < a, k).otherwise(a + (k - a) % p).cast("int")),
    )
    return numbered.select(
        "doc_id", F.when(F.col("_n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text")
    )


@query("op12_periodic_runs", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = with_planted_runs(_table(spark, sf_dir, "documents"))
    found = periodic_runs.periodic_runs(planted)
    best = F.array_min(
        F.transform(
            "runs",
            lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")),
        )
    )
    listed = F.transform(
        "runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    )
    return (
        found.withColumn("_best", best)
        .select(
            "doc_id",
            F.size("runs").cast("long").alias("n_runs"),
            F.col("_best.s").alias("start"),
            (-F.col("_best.l")).alias("length"),
            F.col("_best.p").alias("period"),
            F.floor(1000 * -F.col("_best.l") / F.col("_best.p")).cast("long").alias("exponent_milli"),
            F.sha2(F.array_join(F.transform(listed, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias(
                "runs_sha256"
            ),
            F.sha2("collapsed", 256).alias("collapsed_sha256"),
        )
    )


LEAF = """sha256(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
  || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
  || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')
  || coalesce(strlen(text) || ':' || text, '-'))"""
#: One level after the other: every three nodes become one until one is left.
MERKLE_LEVELS = """
  SELECT {group}, lvl + 1 AS lvl, i // 3 AS i, max((n + 2) // 3) AS n,
    sha256(string_agg(hash, '' ORDER BY i)) AS hash
  FROM {nodes} WHERE n > 1 GROUP BY {group}, lvl, i // 3
"""
MERKLE_SIDES = """
  SELECT x.{group}, x.lvl, x.i,
    coalesce(string_agg(y.hash, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS lefts,
    coalesce(string_agg(y.hash, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS rights
  FROM {nodes} x LEFT JOIN {nodes} y
    ON x.{group} = y.{group} AND x.lvl = y.lvl AND x.i // 3 = y.i // 3 AND x.i <> y.i
  WHERE x.n > 1 GROUP BY x.{group}, x.lvl, x.i
"""
OP13_SQL = f"""
WITH RECURSIVE h AS (
  SELECT *, {LEAF} AS leaf, {CRC32} % 2 = 0 AS odd,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM documents
), t AS (
  SELECT doc_id, g, leaf,
    CASE WHEN odd THEN {LEAF.replace("strlen(text)", "strlen(replace(text, chr(10), ''))").replace("':' || text,", "':' || replace(text, chr(10), ''),")}
      ELSE leaf END AS used,
    row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    count(*) OVER (PARTITION BY g) AS n FROM h
), nodes AS (
  SELECT g, 0 AS lvl, i, n, leaf AS hash FROM t
  UNION ALL {MERKLE_LEVELS.format(group="g", nodes="nodes")}
), sides AS ({MERKLE_SIDES.format(group="g", nodes="nodes")}),
tops AS (
  SELECT 0 AS z, 0 AS lvl, g AS i, count(*) OVER () AS n, hash FROM nodes WHERE n = 1
  UNION ALL {MERKLE_LEVELS.format(group="z", nodes="tops")}
), top_sides AS ({MERKLE_SIDES.format(group="z", nodes="tops")}),
pow AS (SELECT lvl, (3 ** lvl)::BIGINT AS width FROM range(0, 38) x(lvl)),
path AS (
  SELECT t.doc_id, t.g, t.i, s.lvl, s.lefts, s.rights FROM t JOIN pow ON true
    JOIN sides s ON s.g = t.g AND s.lvl = pow.lvl AND s.i = t.i // pow.width
  UNION ALL
  SELECT t.doc_id, t.g, t.i, 100 + s.lvl, s.lefts, s.rights FROM t JOIN pow ON true
    JOIN top_sides s ON s.lvl = pow.lvl AND s.i = t.g // pow.width
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY lvl) AS k FROM path
), fold AS (
  SELECT g, i, 0 AS k, used AS hash FROM t
  UNION ALL
  SELECT f.g, f.i, f.k + 1, sha256(r.lefts || f.hash || r.rights)
  FROM fold f JOIN ranked r ON r.g = f.g AND r.i = f.i AND r.k = f.k + 1
), proofs AS (
  SELECT g, i, string_agg(lefts || rights, '' ORDER BY lvl) AS proof FROM path GROUP BY g, i
), folded AS (SELECT g, i, arg_max(hash, k) AS hash FROM fold GROUP BY g, i)
SELECT t.doc_id, t.leaf, s.hash AS subroot, r.hash AS root, sha256(coalesce(p.proof, '')) AS proof_sha256,
  f.hash AS folded_root, f.hash = r.hash AS verified
FROM t JOIN nodes s ON s.g = t.g AND s.n = 1 JOIN tops r ON r.n = 1
JOIN folded f ON f.g = t.g AND f.i = t.i LEFT JOIN proofs p ON p.g = t.g AND p.i = t.i
"""


@query("op13_merkle_manifest", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = merkle_manifest.row_digest(
        *[F.replace(F.col(c), F.lit("\n")) if c == "text" else F.col(c) for c in columns]
    )
    # Null where nothing is tampered with, so that the digest is worked out for half the rows.
    odd = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, tampered)
    made = merkle_manifest.manifest(documents, columns, "source", "doc_id", {"tampered": odd})
    folded = merkle_manifest.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return (
        made.withColumn("folded_root", folded)
        .select(
            "doc_id", "leaf", "subroot", "root",
            merkle_manifest.proof(F.col("path")).alias("proof_sha256"),
            "folded_root",
            (F.col("folded_root") == F.col("root")).alias("verified"),
        )
    )
