"""Registered queries of the text operators, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationcast.llm import bpe, chat, chunks, language, negatives, packing, pages, quality, scoring, simhash, spelling, toxicity, urls
from stationcast.llm.common import ship, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary())


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "pages").select(F.struct("page_id", "url").alias("page"), "html")
    return pages.extract(raw, "page").select("page.page_id", "page.url", "text", "n_chars")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


@query
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary(), outputs)


@query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.with_edits(table(spark, sf_dir, "documents"))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash(table(spark, sf_dir, "documents"))


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), toxicity.in_training())
    scored = toxicity.toxicity(docs, model)
    return scored.select("doc_id", F.coalesce(~toxicity.in_training(), F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, language.in_training()))
    return found.select("doc_id", F.coalesce(~language.in_training(), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


ORACLE["op1_chat_snapshots"] = """
WITH turns AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), ordered AS (
    SELECT *, row_number() OVER w AS position,
        string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '') OVER w AS said,
        count(*) OVER (PARTITION BY conv_id) AS n_turns
    FROM turns
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
), whole AS (
    SELECT min(conv_id) AS conv_id, n_turns, said, count(*) AS n_copies FROM ordered WHERE position = n_turns GROUP BY n_turns, said
), inner_prefix AS (
    SELECT DISTINCT position, said FROM ordered WHERE position < n_turns
), kept AS (
    SELECT * FROM whole w WHERE NOT EXISTS (SELECT 1 FROM inner_prefix p WHERE p.position = w.n_turns AND p.said = w.said)
)
SELECT k.conv_id, CAST((o.position - 1) // 1000 AS BIGINT) AS part, k.n_turns, k.n_copies,
    string_agg('<|im_start|>' || o.role || chr(10) || o.text || '<|im_end|>' || chr(10), '' ORDER BY o.position) AS text
FROM kept k JOIN ordered o USING (conv_id)
GROUP BY k.conv_id, (o.position - 1) // 1000, k.n_turns, k.n_copies
"""


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.score_documents(table(spark, sf_dir, "documents"), scoring.in_training())
    held_out = F.coalesce(~scoring.in_training(), F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Rows whose id is divisible by 7 have the next label in the given task.
RELABELLED = "case when vec_id % 7 = 0 then (label + 1) % 10 else label end"


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.expr(RELABELLED), F.col("vec_id") % 100 == 0)


ORACLE["op11_hard_negatives"] = """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same,
        CAST(list_dot_product(a.q, o.q) AS BIGINT) AS score
    FROM vectors a JOIN vectors o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 5
"""

#: The rules of the contract: host, path, verdict.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query
def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in URL_RULES])
    rules = spark.range(1).select(F.inline(listed))
    return urls.judge(table(spark, sf_dir, "pages"), rules)


ORACLE["op12_url_rules"] = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}
), rest AS (
    SELECT row_number() OVER () AS line, page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
    SELECT line, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM (SELECT line, page_id, coalesce(rest, '') AS rest FROM rest)
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM split LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY line ORDER BY length(rule_host || rule_path) DESC) = 1
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


#: The 64 letters from À to ÿ as one byte each that no word holds, since the edit distance of SQL counts bytes.
_LATIN = "".join(map(chr, range(0xC0, 0x100)))
_BYTES = "".join(chr(b) for b in range(0x23, 0x7F) if not chr(b).islower() and chr(b) != "'")[: len(_LATIN)]

ORACLE["op13_spelling_variants"] = f"""
WITH RECURSIVE bits AS (
    SELECT CAST(range AS UBIGINT) AS byte, CAST(range AS UBIGINT) AS value, 0 AS step FROM range(256)
    UNION ALL
    SELECT byte, CASE WHEN value & 1 = 1 THEN xor(value >> 1, CAST(3988292384 AS UBIGINT)) ELSE value >> 1 END, step + 1 FROM bits WHERE step < 8
), crc_table AS (
    SELECT list(value ORDER BY byte) AS t FROM bits WHERE step = 8
), runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), lower_runs AS (
    SELECT doc, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
    FROM runs WHERE length(run) >= 6 GROUP BY ALL
), summed AS (
    SELECT run, n, xor(list_reduce(
        list_transform(range(1, CAST(octet_length(encode(doc || ':' || run)) AS BIGINT) + 1),
            lambda i: CAST(('0x' || substr(hex(encode(doc || ':' || run)), 2 * i - 1, 2)) AS UBIGINT)),
        lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INTEGER) + 1]), CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT)) AS crc
    FROM lower_runs, crc_table
), words AS (
    SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT CASE WHEN crc % 199 = 0 THEN substr(run, 1, CAST(crc % length(run) AS BIGINT)) || substr(run, CAST(crc % length(run) AS BIGINT) + 2) ELSE run END AS word, n
        FROM summed)
    WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), plain AS (
    SELECT word, n, length(word) AS size, translate(word, '{_LATIN}', '{_BYTES}') AS bytes FROM words
), near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM plain a JOIN plain b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND levenshtein(a.bytes, b.bytes) = 1
), best AS (
    SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS form_n, min(other) FILTER (other_n = most) AS form
    FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS most FROM near) GROUP BY word
), formed AS (
    SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * words.n THEN form END AS form, CASE WHEN form_n >= 5 * words.n THEN form_n END AS form_n
    FROM words LEFT JOIN best ON words.word = best.word
), chain AS (
    SELECT word, word AS at FROM formed
    UNION ALL
    SELECT chain.word, formed.form FROM chain JOIN formed ON chain.at = formed.word WHERE formed.form IS NOT NULL
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN chain c ON f.word = c.word JOIN formed e ON c.at = e.word WHERE e.form IS NULL
"""
