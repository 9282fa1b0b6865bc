"""Registered queries of the training-data operators, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threatloom.llm import ann, chat, groupjoin, licenses, media, mixing, neardup, packing, phrases, pii, quality, tokencount, whitening
from threatloom.llm.common import table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    done = chat.formatted(talks.unionByName(tricky))
    back = done.select("conv_id", F.length("formatted").cast("bigint").alias("formatted_chars"),
                       chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    lines = F.concat_ws("", F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))))
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), length=1024)
    return pieces.select(
        "doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors.where("vec_id % 20 = 0"), vectors, k=20)


def op5_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality.features_of(table(spark, sf_dir, "documents"))
    return quality.score(features, quality.train(features, table(spark, sf_dir, "labels")))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = F.transform(F.array_sort(F.map_entries("pii_found")), lambda e: F.concat_ws(":", e.key, e.value.cast("string")))
    return docs.select("doc_id", "text", F.aggregate(F.map_values("pii_found"), F.lit(0), lambda a, x: a + x).alias("n_found"), F.concat_ws(",", named).alias("kinds"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree by source, language and shelf; two in forty are licence files of a language or a source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("source", F.lit("none")).alias("source"), F.coalesce("lang", F.lit("xx")).alias("lang"))
    number = F.col("doc_id").cast("string")
    path = (
        F.when(F.col("doc_id") % 40 == 7, F.concat_ws("/", "source", "lang", F.concat(F.lit("LICENSE-"), number)))
        .when(F.col("doc_id") % 40 == 17, F.concat_ws("/", "source", F.concat(F.lit("COPYING-"), number)))
        .otherwise(F.concat_ws("/", "source", "lang", F.concat(F.lit("shelf"), (F.col("doc_id") % 10).cast("string")), F.concat(number, F.lit(".txt")))))
    return licenses.scan(docs.select("doc_id", "text", path.alias("path"))).withColumnRenamed("key", "doc_id")


def op8_media_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), media.stored(F.col("text")).alias("media"))
    read = held.select("doc_id", "n_bytes", "media", media.features(F.col("media")).alias("f"))
    codes = F.transform("f.pairs", lambda p: F.hex(p))
    return read.select(
        "doc_id", "n_bytes", F.octet_length("f.payload").cast("bigint").alias("payload_bytes"), F.sha2("f.payload", 256).alias("payload_sha256"),
        F.col("f.tail_crc32").alias("tail_crc32"), F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("f.pairs").cast("string"), F.sha2(F.concat_ws(",", codes), 256)).alias("feature"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.section_tokens(table(spark, sf_dir, "documents"), fields=("source", "lang", "text"))
    return tokencount.exploded(counts)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = whitening.whitened(table(spark, sf_dir, "embeddings"), components=32)
    # The exact sum may pass 64 bits in tables of billions of rows; it is null there, and whole in the operator's own result.
    return done.withColumn("deviation", F.expr("try_cast(deviation AS bigint)")).select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "copies")


def op12_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupjoin.set_links(table(spark, sf_dir, "documents"), words=3, percent=90)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), longest=4, least=30, top=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_packing": op3_packing,
    "op4_cross_polytope": op4_cross_polytope,
    "op5_quality_discriminant": op5_quality_discriminant,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_license_scan": op7_license_scan,
    "op8_media_fingerprints": op8_media_fingerprints,
    "op9_mixing": op9_mixing,
    "op10_section_tokens": op10_section_tokens,
    "op11_whitening": op11_whitening,
    "op12_group_join": op12_group_join,
    "op13_collocations": op13_collocations,
}

_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

SQL: dict[str, str] = {
    "op1_minhash_dedup": f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWERED)} AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(sh) AS h, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
                          ELSE list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3]) END) AS sh FROM w WHERE ws IS NOT NULL)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.h = y.h AND x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b
  WHERE 100 * common >= 80 * (ca.n + cb.n - common)),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op9_mixing": f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len({_WORDS.format('text')}), 0) AS size,
    md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
k AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s),
r AS (
  SELECT *, source_size * 3.0::DOUBLE / weight AS ratio, sum(source_size) OVER ()::DOUBLE AS total FROM k),
f AS (
  SELECT *, coalesce(sum(source_size * 3) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
    (sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS free FROM r),
v AS (SELECT max((total - capped) / free) FILTER (WHERE (total - capped) / free <= ratio) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0 ELSE least(source_size * 3.0::DOUBLE, coalesce(level, 'inf'::DOUBLE) * weight) END AS target FROM k, v),
w AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS whole FROM t),
g AS (SELECT source, draw, sum(size)::BIGINT AS own FROM d GROUP BY source, draw),
c AS (SELECT *, sum(own) OVER (PARTITION BY source ORDER BY draw) - own AS before FROM g),
x AS (
  SELECT c.source, max(draw) AS cutoff FROM c JOIN w ON w.source IS NOT DISTINCT FROM c.source
  WHERE own > 0 AND before + own / 2.0::DOUBLE <= target - whole * source_size AND before < target - whole * source_size GROUP BY c.source)
SELECT d.doc_id, d.size, w.source_size, w.target,
  ((w.whole + CASE WHEN d.draw <= x.cutoff THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN w ON w.source IS NOT DISTINCT FROM d.source LEFT JOIN x ON x.source IS NOT DISTINCT FROM d.source""",
    "op2_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (
  SELECT *, lag(role) OVER w AS role_before,
    regexp_replace(role, '<(\\*)\|(turn|says|and|end)\|>', '<\\\1|\2|>', 'g') AS role_escaped,
    regexp_replace(text, '<(\\*)\|(turn|says|and|end)\|>', '<\\\1|\2|>', 'g') AS text_escaped
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(length(text_escaped) + CASE WHEN role_before = role THEN 7 ELSE 8 + 8 + 7 + length(role_escaped) END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op12_group_join": f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {_WORDS.format(_LOWERED)} AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(sh) AS h, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [ws]
                          ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]) END) AS sh FROM w WHERE ws IS NOT NULL)),
c AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.h = y.h AND x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b
  WHERE 100 * common >= 90 * (ca.n + cb.n - common)),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, m.component_id
FROM w JOIN m USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op13_collocations": rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, {_LOWERED} AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS MATERIALIZED (SELECT lang, ws FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p) WHERE len(ws) > 0),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
f AS MATERIALIZED (
  SELECT lang, size, phrase, count(*) AS f FROM (
    SELECT lang, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS size) WHERE len(ws) >= size)
  GROUP BY lang, size, phrase HAVING count(*) >= 30),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
k AS (SELECT *, unnest(range(1, size)) AS k FROM c),
x AS (
  SELECT k.lang, k.phrase, k.a, k.k, h.f AS l, e.f AS r, (2000000::HUGEINT * k.a // (h.f + e.f))::BIGINT AS score FROM k
  JOIN f h ON h.lang = k.lang AND h.phrase = array_to_string(k.ws[1:k.k], ' ')
  JOIN f e ON e.lang = k.lang AND e.phrase = array_to_string(k.ws[k.k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(ws[s:s + z - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, size - z + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS z FROM c)))
  GROUP BY lang, phrase),
o AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN t USING (lang) WHERE rank <= 2000""",
}
