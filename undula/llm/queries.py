"""One query for each operator over its whole table, for the registry at the repository's top."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, fingerprint, language, lexical, licences, lines, mixing, ngram_join, resampling, structure, tokens, toxicity
from .common import is_held_out, table

#: Where the public vocabulary files lie; a parameter of the token query.
TOKENIZERS = os.environ.get("UNDULA_TOKENIZERS", "/opt/tokenizers")
#: Shares of the expected tokens by domain.
TARGETS = {"high": 0.9, "low": 0.08, "toxic": 0.02}


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (host: their source) and pages (host, markup and address of their own), each by its id."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language.train(docs)
    found = ["found.language", "found.probability", "found.text_language"]
    own = language.identify(docs.select("doc_id", "text", "source"), model, host=F.col("source"), keep=["doc_id"])
    told = pages.select("page_id", F.col("url").alias("_url"), F.col("html").alias("_html"))
    web = language.identify(told.withColumn("_body", language.visible_text(F.col("_html"))), model, text="_body", host=language.host_of(F.col("_url")), declared=language.markup_language(F.col("_html")), suffix=language.address_language(F.col("_url"), model.languages), keep=["page_id"])
    return own.select("doc_id", F.lit(None).cast("bigint").alias("page_id"), *found).unionByName(web.select(F.lit(None).cast("bigint").alias("doc_id"), "page_id", *found))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = mixing.train(docs, labels.select("doc_id", mixing.domain(F.col("quality"), F.col("toxic")).alias("domain")))
    return mixing.mix(docs, model, TARGETS, keep=["doc_id"])


def op7_tokens(spark: SparkSession, sf_dir: str, tokenizers: str | None = None) -> DataFrame:
    encoder = tokens.Encoder.read(f"{tokenizers or TOKENIZERS}/byte_bpe_50k.tiktoken")
    counted = tokens.with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), encoder)
    return counted.select("doc_id", "tokens.n_tokens", "tokens.n_crossing", F.size("tokens.section_tokens").alias("n_sections"), "tokens.section_tokens", "tokens.section_start")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf_dir, "labels").where("quality = 1 and coalesce(toxic, 0) = 0"), keep=["doc_id"])


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", licences.family(F.col("licences")).alias("family"), F.size("licences").alias("n_paragraphs"), "licences")


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op12_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    told, rows = structure.repair(structure.damaged(turns))
    found = turns.select("conv_id").distinct()
    for more in (told, structure.hashed(rows)):
        found = found.join(more.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.with_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1, into="found")
    return found.select("doc_id", "found.n_lines", "found.n_dropped", F.sha2(F.col("found.kept").cast("binary"), 256).alias("kept_sha256"))


def queries() -> dict:
    own = (op1_toxicity, op2_fingerprint, op3_language, op4_decontamination, op5_chat, op6_mixing, op7_tokens, op8_ngram_jaccard, op9_resampling, op10_licences, op11_search, op12_structure, op13_lines)
    return {f.__name__: f for f in own}


_ESCAPED = r"replace(replace(replace({}, '\', '\\'), '<', '\<'), '>', '\>')"
_TRAP = r"'\### Assistant: </turn> ok'"
_ORDER = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_ENDS = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: A 32-bit CRC, whose table-free rule takes a bit at a time.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(key, ''), lambda ch: ord(ch)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda u, k: xor(u >> 1, 3988292384 * (u & 1)))), 4294967295)"
_SAME = "IS NOT DISTINCT FROM"


def _plus(key: str, cost: str, edits: str) -> str:
    """A cost of nine digits and its edits, with more of both: text order is the order of cost, then of edits."""
    return f"(printf('%09d', CAST(left({key}, 9) AS BIGINT) + {cost}) || substr({key}, 10) || '{edits}')"


def _inserted(source: str) -> str:
    """States (e start, s system, u user, a assistant) with what inserted rows lead to."""
    user = f"least(u, {_plus('e', '5', 'I')}, {_plus('s', '5', 'I')}, {_plus('a', '5', 'I')})"
    return f"SELECT conv_id, k, e, s, u, least(a, {_plus('u', '5', 'I')}) AS a FROM (SELECT conv_id, k, e, s, {user} AS u, a FROM ({source}))"


_P = "CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
_EDITED = f"""SELECT f.conv_id, f.k, {_plus('e', '2', 'D')} AS e, least({_plus('s', '2', 'D')}, CASE WHEN stays AND i = 's' THEN {_plus('e', _P, 'K')} END) AS s,
least({_plus('u', '2', 'D')}, CASE WHEN NOT stays THEN NULL WHEN i = 'u' THEN {_plus('least(e, s, a)', _P, 'K')} ELSE {_plus('least(e, s, a)', f'1 + {_P}', 'R')} END) AS u,
least({_plus('a', '2', 'D')}, CASE WHEN NOT stays THEN NULL WHEN i = 'a' THEN {_plus('u', _P, 'K')} ELSE {_plus('u', f'1 + {_P}', 'R')} END) AS a FROM dp JOIN f ON f.conv_id {_SAME} dp.conv_id AND f.k = dp.k + 1"""

#: The other queries have no SQL: they train models, or need a digest, an encoding or a comparison that DuckDB lacks.
ORACLE_SQL: dict[str, str] = {
    "op5_chat": f"""WITH t AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS x FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', {_TRAP} UNION ALL SELECT -7, 1, 'assistant', {_TRAP}))
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' {_ORDER})) AS turns_sha256, CAST(sum(CASE WHEN r = 'assistant' THEN length(x) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(x, '' {_ORDER}) FILTER (r = 'assistant'), '')) AS loss_sha256,
CAST(sum(length('<turn ' || {_ESCAPED.format('r')} || '>' || chr(10) || {_ESCAPED.format('x')} || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id""",
    "op8_ngram_jaccard": f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents), s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s), p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b USING (g) WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))), l AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id) SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) USING (doc_id)""",
    "op11_search": f"""WITH q AS (SELECT row_number() OVER () AS q, item_id, {_TERMS} AS t FROM benchmark), qt AS (SELECT q, t, count(*) AS times FROM (SELECT q, unnest(t) AS t FROM q) GROUP BY q, t),
d AS (SELECT doc_id, {_TERMS} AS t FROM documents), c AS (SELECT count(*) AS big_n, CAST(sum(len(t)) AS BIGINT) AS big_l FROM d WHERE len(t) > 0),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t),
s AS (SELECT q, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score FROM p JOIN w USING (t) JOIN qt USING (t), c GROUP BY q, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r JOIN q USING (q) WHERE rank <= 10""",
    "op12_structure": f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS code FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)),
r AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM (SELECT *, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE code <> 0)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS k, rtrim(text, {_ENDS}) AS t, left(role, 1) AS i FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM r)),
f AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS stays FROM (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(i) OVER (PARTITION BY conv_id ORDER BY k) || i AS pair FROM o)),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS last FROM f GROUP BY conv_id),
dp AS ({_inserted("SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, '000000000' AS e, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM f")} UNION ALL {_inserted(_EDITED)}),
z AS (SELECT g.*, least(e, a) AS best FROM g JOIN dp ON dp.conv_id {_SAME} g.conv_id AND dp.k = g.last), l AS (SELECT conv_id, best[j + 9] AS l, j FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS j FROM z)),
p AS (SELECT *, count(*) FILTER (l <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS k, count(*) FILTER (l <> 'D') OVER (PARTITION BY conv_id ORDER BY j) AS m FROM l),
q AS (SELECT p.conv_id, j, l, m, f.role, CASE WHEN l = 'I' THEN '' ELSE f.text END AS text, coalesce(max(CASE WHEN m = 1 AND l = 'K' AND f.i = 's' THEN 1 END) OVER (PARTITION BY p.conv_id), 0) AS led FROM p LEFT JOIN f ON f.conv_id {_SAME} p.conv_id AND f.k = p.k),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (m - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS h FROM q WHERE l <> 'D' GROUP BY conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(CAST(left(best, 9) AS BIGINT), 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN z ON z.conv_id {_SAME} c.conv_id LEFT JOIN h ON h.conv_id {_SAME} c.conv_id""",
    "op13_lines": f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), k AS (SELECT doc_id, l, list_transform(l, lambda x: translate(trim(x, {_ENDS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS k FROM d),
f AS (SELECT x FROM (SELECT unnest(list_distinct(k)) AS x FROM k) WHERE length(x) >= 1 GROUP BY x HAVING count(*) >= 10), g AS (SELECT list(x) AS f FROM f),
r AS (SELECT doc_id, len(l) AS n, list_filter(l, lambda x, i: NOT coalesce(list_contains(f, k[i]), false)) AS kept FROM k, g)
SELECT doc_id, CAST(n AS BIGINT) AS n_lines, CAST(n - len(kept) AS BIGINT) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM r""",
}
