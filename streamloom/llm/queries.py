"""The registered queries of the operators, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm import ann, language, mixing, minhash, pieces, pii, simhash, tokens, toolcalls, warc
from streamloom.session import ready, table

#: The files of the public tokenizers that the queries use.
PIECES, BYTE_BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by the default weights takes of each document, with its source's size and target."""
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    taken = (F.col("copies") * F.col("size")).cast("long").alias("taken")
    return mixing.copies(sized).select("doc_id", "size", "source_size", "target", taken, "source", "copies")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    found = language.identify(docs.withColumn("held_out", held_out), ~F.col("held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each document's whole text."""
    return pieces.encode(table(spark, sf_dir, "documents"), PIECES)


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components over four-word shingles at a similarity of 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each document and of its edited text, and near ones of every twentieth id."""
    return simhash.edited_fingerprints(table(spark, sf_dir, "documents"))


def op6_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn calls a tool whose result is the turn after it, if that is a user's.

    A call depends on the one two turns before. Arguments hold the words of the turn, and its
    system prompt's presence as a flag in the turns that come third or later.
    """
    ready(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    name = lambda turn: F.concat(F.lit("call-"), turn.cast("string"))
    arguments = F.concat(
        F.lit('{"words": '), mixing.word_count(F.col("text")).cast("string"), F.lit(', "text": '), F.coalesce(toolcalls.json_text(F.col("text")), F.lit("null")), F.lit("}")
    )
    calls = rows.where("role = 'assistant'").select(
        "conv_id", "turn", name(F.col("turn")).alias("call_id"), F.when(F.col("turn") % 2 == 1, "reply").otherwise("open").alias("name"), arguments.alias("arguments"),
        F.when(F.col("turn") >= 2, F.array(name(F.col("turn") - 2))).alias("depends_on"),
    )
    results = rows.where("role = 'user'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame(
        [(n, f, k, r) for n in ("reply", "open") for f, k, r in (("words", "integer", True), ("text", "string", True), ("lang", "string", False))],
        "name string, field string, kind string, required boolean",
    )
    return toolcalls.link(calls, results, schemas)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document: counts and digest of the fixed patterns, and all spans."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.encode("base_spans", "utf-8"), 256).alias("base_sha256"), "spans", "n_spans")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record, written to archives and read back."""
    written = warc.write_records(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_records(written).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of each document."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"), BYTE_BPE, limit=512)


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


QUERIES = {f.__name__: f for f in (op1_mixing, op2_language, op3_sentencepiece, op4_minhash, op5_simhash, op6_toolcalls, op7_pii, op8_warc, op9_tokens, op10_neighbours)}

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

_VOTES = ", ".join(f"sum(((h >> {j}) & 1)::BIGINT) * 2 > count(h) AS b{j}" for j in range(64))
_PRINT = " + ".join(f"CASE WHEN b{j} THEN {1 << j}::HUGEINT ELSE 0::HUGEINT END" for j in range(64))

ORACLE = {
    "op5_simhash": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id) AS k, count(*) OVER () AS n FROM documents),
e AS (SELECT a.k, a.n, a.doc_id, a.text, left(a.text, length(a.text) - length(a.text) // 4) || left(b.text, length(a.text) // 4) AS edited FROM d a JOIN d b ON b.k = a.k % a.n + 1),
x AS (SELECT k, 0 AS kind, text FROM e UNION ALL SELECT k, 1, edited FROM e),
w AS (SELECT k, kind, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM x),
t AS (SELECT k, kind, unnest(CASE WHEN len(ws) = 0 THEN [NULL] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS term FROM w),
h AS (SELECT k, kind, ('0x' || substr(md5(term), 1, 16))::UBIGINT AS h FROM t),
v AS (SELECT k, kind, {_VOTES} FROM h GROUP BY k, kind),
f AS (SELECT k, kind, ({_PRINT})::UBIGINT AS fp FROM v),
p AS (SELECT e.*, f.fp, g.fp AS efp, z.fp AS nfp FROM e JOIN f ON f.k = e.k AND f.kind = 0 JOIN f g ON g.k = e.k AND g.kind = 1 JOIN f z ON z.k = e.k % e.n + 1 AND z.kind = 0)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, lpad(lower(hex(fp)), 16, '0') AS fingerprint, lpad(lower(hex(efp)), 16, '0') AS edited_fingerprint,
  1 - bit_count(xor(fp, efp)) / 64.0::DOUBLE AS near_edited, 1 - bit_count(xor(fp, nfp)) / 64.0::DOUBLE AS near_next,
  CASE WHEN doc_id % 20 = 0 THEN (SELECT count(*) FROM p q WHERE bit_count(xor(p.fp, q.fp)) <= 3) END AS n_near FROM p
""",
    "op4_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS x FROM w)),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.c >= 80 * (na.k + nb.k - p.c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n.k
""",
    "op6_toolcalls": r"""
WITH c AS (SELECT conv_id, turn, 'call-' || turn AS call_id, CASE WHEN turn % 2 = 1 THEN 'reply' ELSE 'open' END AS name, text,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE role = 'assistant'),
t AS (SELECT DISTINCT conv_id, turn, call_id FROM c WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
i AS (SELECT *, turn - 2 * row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS island FROM t),
l AS (SELECT conv_id, call_id, row_number() OVER (PARTITION BY conv_id, turn % 2, island ORDER BY turn) - 1 AS level FROM i),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY name, words, text) AS occ FROM c),
r AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn AS result_turn, text AS content FROM conversations WHERE role = 'user'),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, call_id ORDER BY result_turn, content) AS occ FROM r),
b AS (SELECT coalesce(k.conv_id, q.conv_id) AS conv_id, coalesce(k.call_id, q.call_id) AS call_id, k.turn, q.result_turn, l.level, k.name, k.text, k.words, q.content,
    CASE WHEN coalesce(k.conv_id, q.conv_id) IS NULL OR coalesce(k.call_id, q.call_id) IS NULL THEN 'no_id' WHEN k.call_id IS NULL THEN 'no_call'
      WHEN k.text IS NULL THEN 'wrong_kind' WHEN q.call_id IS NULL THEN 'no_result' ELSE 'ok' END AS status
  FROM k FULL JOIN q ON k.conv_id = q.conv_id AND k.call_id = q.call_id AND k.occ = q.occ LEFT JOIN l ON l.conv_id = k.conv_id AND l.call_id = k.call_id)
SELECT conv_id, call_id, turn, result_turn, level, status, '{' || concat_ws(',',
  CASE WHEN name IS NOT NULL THEN '"arguments":{"text":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"words":' || words || '}' END,
  '"content":' || to_json(content)::VARCHAR, '"id":' || to_json(call_id)::VARCHAR, '"name":' || to_json(name)::VARCHAR, '"status":"' || status || '"') || '}' AS record
FROM b
""",
    "op8_warc": f"""
WITH d AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT *, list_aggregate(list_transform(range(0, 32), lambda j: substr('{_BASE32}',
  (((('0x' || substr(x, (1 + 10 * (j // 8))::INT, 10))::BIGINT >> (35 - 5 * (j % 8))::INT) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest FROM d)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id = min(page_id) OVER (PARTITION BY x) THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER (PARTITION BY x) THEN min(page_id) OVER (PARTITION BY x) END AS refers_to
FROM b
""",
}
