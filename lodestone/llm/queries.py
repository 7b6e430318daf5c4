"""The queries of the subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, classifier, codebooks, decontam, hpylm, html, licenses, minhash, quality, secrets, sentencepiece_table, urls, whitening
from lodestone.llm.common import LOWER, UPPER, table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = "'</s>[INST] ok [/INST]' AS text"
    fixed = spark.range(1).selectExpr(f"inline(array(struct(-7L AS conv_id, 0L AS turn, 'user' AS role, {same}), struct(-7L AS conv_id, 1L AS turn, 'assistant' AS role, {same})))")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return chat.digests(chat.prefix_target_examples(rows))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), width=3, percent=85)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_table.digests(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.report(table(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("rejected")).alias("kept"))


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compress(table(spark, sf_dir, "embeddings"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_minhash": op2_minhash,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_secret_scans": op4_secret_scans,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scans": op9_license_scans,
    "op10_url_filters": op10_url_filters,
    "op11_code_compression": op11_code_compression,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_quality_classifier": op13_quality_classifier,
}

_SQL1 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
         length(regexp_replace(text, '(</?|\[/?)(\\*)(s>|INST\])', '\1\\\2\3', 'g'))
           + CASE WHEN role = 'assistant' THEN 4 ELSE 7 + length(url_encode(role)) + 1 + 8 END AS chars
  FROM rows),
ends AS (
  SELECT *, 3 + sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS stop, max(i) OVER (PARTITION BY conv_id) AS last FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(stop) FILTER (role = 'assistant' OR i = last)::BIGINT AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR i = last) AS n_examples
FROM ends GROUP BY conv_id"""

_SQL2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
class AS (SELECT min(doc_id) AS c, list_sort(s) AS s FROM sets GROUP BY list_sort(s) HAVING len(list_sort(s)) > 0),
items AS (SELECT c, len(s) AS n, unnest(s) AS x FROM class),
pairs AS (SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.x = b.x AND a.c < b.c AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
          GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
sym AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
comp AS (SELECT a, least(a, min(b)) AS k FROM reach GROUP BY a)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(comp.k, class.c, doc_id) AS component_id, doc_id = coalesce(comp.k, class.c, doc_id) AS kept
FROM sets LEFT JOIN class ON list_sort(sets.s) = class.s LEFT JOIN comp ON comp.a = class.c"""

_SQL8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
h AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM win),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM h),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY doc_id),
s AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(list_aggregate(list_concat([''], w), 'string_agg', ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(l) AS n_lines,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]+', '', 'g')) AS n_lower
      FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR n_upper > n_lower
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b"""


def _sql9() -> str:
    owners = " ".join(f"WHEN regexp_matches(plain, '{p}') THEN '{licenses.SENTENCES[k]}'" for p, k in licenses.OWNED)
    known = ", ".join(f"('{s}', '{k}')" for k, s in licenses.SENTENCES.items())
    sequence, found, rest = [], [], "seq"
    for n, (name, ids) in enumerate(licenses.RULES):
        key = "".join(f",{x}," for x in ids)
        sequence.append(f"r{n} AS (SELECT *, replace({rest}, '{key}', '|') AS s{n} FROM {f'r{n - 1}' if n else 'seqs'})")
        found.append(f"CASE WHEN s{n} <> {rest} THEN '{name}' END")
        rest = f"s{n}"
    order = ", ".join(f"'{x}'" for x in dict.fromkeys(name for name, _ in licenses.RULES))
    return rf"""
WITH known(sentence, sentence_id) AS (VALUES {known}),
cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?:;])[ \t\r\n]+|\n[ \t\r]*\n', '\1' || chr(1), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL),
part AS (SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM cut),
line AS (SELECT doc_id, pos, -1 AS line, part AS piece, part FROM part
         UNION ALL SELECT doc_id, pos, unnest(range(len(string_split(part, chr(10))))) AS line, unnest(string_split(part, chr(10))) AS piece, part FROM part WHERE contains(part, chr(10))),
normed AS (SELECT doc_id, pos, line, trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')) AS plain, part FROM line),
told AS (SELECT *, CASE {owners} ELSE plain END AS sentence FROM normed),
hits AS (SELECT doc_id, pos, line, sentence_id FROM told JOIN known USING (sentence) WHERE line = -1 OR plain <> trim(regexp_replace(lower(part), '[^a-z0-9]+', ' ', 'g'))),
seqs AS (SELECT doc_id, count(*) AS n_sentences, string_agg(sentence_id, ',' ORDER BY pos, line, sentence_id) AS sentence_ids,
                string_agg(',' || sentence_id || ',', '' ORDER BY pos, line, sentence_id) AS seq FROM hits GROUP BY doc_id),
{", ".join(sequence)}
SELECT doc_id, n_sentences, sentence_ids,
       array_to_string(list_filter([{order}], lambda x: list_contains([{", ".join(found)}], x)), ',') AS licences
FROM r{len(licenses.RULES) - 1}"""


def _sql10() -> str:
    fits = " ".join(f"WHEN regexp_matches(host || path, '{r.pattern}') THEN '{r.name}'" for r in sorted(urls.SITE_RULES, key=lambda r: -len(r.name)))
    acts = " ".join(f"WHEN '{r.name}' THEN '{r.action}'" for r in urls.SITE_RULES)
    blocked = " OR ".join(f"regexp_matches(low, '{r.pattern}')" for r in urls.PATTERN_RULES)
    return rf"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {fits} END AS rule FROM p)
SELECT page_id, host, path, rule, coalesce(CASE rule {acts} END, CASE WHEN {blocked} THEN 'block' ELSE 'allow' END) AS verdict FROM r"""


def _sql11(parts: int = 4, size: int = 256, rounds: int = 4) -> str:
    nearest = """a{r} AS MATERIALIZED (
  SELECT vec_id, p, x, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'k': k}}) AS best
  FROM part JOIN b{r} USING (p) GROUP BY vec_id, p, x)"""
    mean = """m{r} AS (SELECT p, best.k AS k, i, floor(sum(x[i]) / count(*)) AS v FROM (SELECT p, best, x, unnest(range(1, len(x) + 1)) AS i FROM a{r}) GROUP BY ALL),
b{n} AS MATERIALIZED (SELECT p, k, coalesce(v, c) AS c FROM b{r} LEFT JOIN (SELECT p, k, list(v ORDER BY i) AS v FROM m{r} GROUP BY p, k) USING (p, k))"""
    steps = ",\n".join(x for r in range(rounds) for x in (nearest.format(r=r), mean.format(r=r, n=r + 1)))
    return rf"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda e: floor(1024.0 * e::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
part AS (SELECT vec_id, p, x[(p * len(x)) // {parts} + 1 : ((p + 1) * len(x)) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS p)),
seed AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM v ORDER BY vec_id LIMIT {size}),
b0 AS MATERIALIZED (SELECT p, k, x AS c FROM part JOIN seed USING (vec_id)),
{steps},
{nearest.format(r=rounds)},
coded AS (SELECT vec_id, string_agg(lower(printf('%02x', best.k::INTEGER)), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id),
books AS (SELECT sha256(string_agg(list_aggregate(list_transform(c, lambda e: e::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds}),
byl AS (SELECT label, sum(error)::BIGINT AS label_error FROM v JOIN coded USING (vec_id) GROUP BY label)
SELECT v.vec_id, v.label, code, error, label_error, codebooks_sha256
FROM v JOIN coded USING (vec_id) JOIN byl ON v.label IS NOT DISTINCT FROM byl.label, books"""


ORACLES = {
    "op1_chat_formatting": _SQL1,
    "op2_minhash": _SQL2,
    "op8_quality_rules": _SQL8,
    "op9_license_scans": _sql9(),
    "op10_url_filters": _sql10(),
    "op11_code_compression": _sql11(),
}
