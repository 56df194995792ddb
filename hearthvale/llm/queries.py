"""Registered queries of this subpackage, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthvale.llm import decontaminate, licenses, line_dedup, merkle, ngram_lm, packing, passages, quality, simhash, token_store, topk, toxicity, whitening
from hearthvale.llm.common import scratch, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4096 tokens."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), "word", 2, 4096)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share fuzzy passages: the class of each, its number of
    links and the stretches shared."""
    return passages.passage_classes(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents")).drop("matches")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back through the index."""
    docs, path = table(spark, sf_dir, "documents"), scratch(spark, "tokens")
    token_store.write_store(docs, path, _tokenizer("byte_bpe_50k.json"), "byte", 2)
    rows = token_store.read_keys(spark, path, docs)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents, with their share of matched words."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, bench, ["doc_id"], F.col("text"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def _fold(column: str, folds: int):
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from the labels outside the held-out fifth."""
    return toxicity.fit(docs, labels, _fold("doc_id", 5) != 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with its nearest examples."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.with_scores(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), evidence="evidence")
    return scored.select("doc_id", F.coalesce(_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer products of every 50th embedding."""
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of every page without its host's boilerplate lines."""
    pages = table(spark, sf_dir, "pages")
    host, text = line_dedup.host_of(F.col("url")), line_dedup.html_lines(F.col("html"))
    out = line_dedup.drop_boilerplate(pages, host, text, out="text", host_out="host", dropped_out="n_dropped",
                                      lines_out="n_lines")
    return out.select("page_id", "host", "n_lines", "n_dropped", "text")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), _fold("doc_id", 3) != 1)
    return quality.with_scores(docs, model).select(
        "doc_id", F.coalesce(_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents")
    model = ngram_lm.fit(docs, _fold("doc_id", 10) != 0)
    held_out = F.coalesce(_fold("doc_id", 10) == 0, F.lit(False))
    return ngram_lm.scores(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out}).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle manifest of all documents by language; every 7th hash is checked
    with a tampered row."""
    docs = table(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = merkle.leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields])
    proofs = merkle.manifest(docs, fields, "lang", "doc_id", {"tampered": F.when(_fold("doc_id", 7) == 0, changed)})
    folded = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return (proofs.withColumn("folded_root", folded)
            .select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 leading whitened components of every embedding."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_passages": op2_passages,
    "op3_licenses": op3_licenses,
    "op4_token_store": op4_token_store,
    "op5_decontamination": op5_decontamination,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_topk": op8_topk,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality": op10_quality,
    "op11_language_model": op11_language_model,
    "op12_merkle": op12_merkle,
    "op13_whitening": op13_whitening,
}

_OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
WHERE rank <= 5"""

_OP9_SQL = f"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '{line_dedup._HOST}', 1)) AS host,
         string_split(regexp_replace(regexp_replace(regexp_replace(html, '{line_dedup._CODE}', '', 'g'),
                      '{line_dedup._BLOCK}', chr(10), 'g'), '{line_dedup._TAG}', '', 'g'), chr(10)) AS lines
  FROM pages),
u AS (SELECT page_id, host, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM p),
c AS (SELECT host, trim(line, ' ') AS line, count(DISTINCT page_id) AS n FROM u WHERE trim(line, ' ') <> '' GROUP BY ALL),
b AS (
  SELECT c.host, c.line FROM c JOIN (SELECT host, count(*) AS pages FROM p GROUP BY host) t ON t.host = c.host
  WHERE n >= {line_dedup.MIN_PAGES} AND n > pages * {line_dedup.RATIO})
SELECT page_id, any_value(u.host) AS host, CAST(count(*) AS INTEGER) AS n_lines,
       CAST(count(b.line) AS INTEGER) AS n_dropped,
       coalesce(string_agg(u.line, chr(10) ORDER BY i) FILTER (WHERE b.line IS NULL), '') AS text
FROM u LEFT JOIN b ON b.host = u.host AND b.line = trim(u.line, ' ')
GROUP BY page_id"""

_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''),
  lambda c: ascii(c)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]),
  lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)))"""


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
                                   for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_OP12_SQL = f"""
WITH RECURSIVE
leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {_leaf_sql("n_chars")} AS leaf,
         CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf_sql("(n_chars + 1)")} ELSE {_leaf_sql("n_chars")} END AS now
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx,
                  count(*) OVER (PARTITION BY g) AS n FROM leaves),
inner_nodes AS (
  SELECT 0 AS level, g, n, idx, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, g, (n + 1) // 2, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM inner_nodes WHERE n > 1
  GROUP BY level, g, n, idx // 2),
tops AS (SELECT g, level AS depth, h, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM inner_nodes WHERE n = 1),
outer_nodes AS (
  SELECT 0 AS level, n, idx, h FROM tops
  UNION ALL
  SELECT level + 1, (n + 1) // 2, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM outer_nodes WHERE n > 1
  GROUP BY level, n, idx // 2),
steps AS (
  SELECT p.rid, m.level AS lvl, (p.idx // pow(2, m.level)::BIGINT) % 2 = 1 AS before, coalesce(s.h, '') AS sib
  FROM placed p JOIN (SELECT DISTINCT g, level FROM inner_nodes WHERE n > 1) m ON m.g = p.g
  LEFT JOIN inner_nodes s ON s.g = p.g AND s.level = m.level AND s.idx = xor(p.idx // pow(2, m.level)::BIGINT, 1)
  UNION ALL
  SELECT p.rid, t.depth + m.level, (t.idx // pow(2, m.level)::BIGINT) % 2 = 1, coalesce(s.h, '')
  FROM placed p JOIN tops t ON t.g = p.g JOIN (SELECT DISTINCT level FROM outer_nodes WHERE n > 1) m ON true
  LEFT JOIN outer_nodes s ON s.level = m.level AND s.idx = xor(t.idx // pow(2, m.level)::BIGINT, 1)),
fold AS (
  SELECT rid, 0 AS lvl, now FROM placed
  UNION ALL
  SELECT f.rid, f.lvl + 1, sha256(CASE WHEN s.before THEN s.sib || f.now ELSE f.now || s.sib END)
  FROM fold f JOIN steps s ON s.rid = f.rid AND s.lvl = f.lvl),
proofs AS (SELECT rid, sha256(string_agg(sib, '' ORDER BY lvl)) AS proof_sha256 FROM steps GROUP BY rid)
SELECT p.doc_id, p.leaf, t.h AS subroot, r.h AS root, coalesce(q.proof_sha256, sha256('')) AS proof_sha256,
       f.now AS folded_root, f.now = r.h AS verified
FROM placed p JOIN tops t ON t.g = p.g JOIN outer_nodes r ON r.n = 1
LEFT JOIN proofs q ON q.rid = p.rid JOIN (SELECT rid, arg_max(now, lvl) AS now FROM fold GROUP BY rid) f ON f.rid = p.rid"""

ORACLE_SQL: dict[str, str] = {"op12_merkle": _OP12_SQL, "op8_topk": _OP8_SQL, "op9_line_dedup": _OP9_SQL}
