"""The operators' queries over whole tables, and SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import licenses, oracles, quality_rules
from pagelake.llm.common import job_dir
from pagelake.llm.importance import resample
from pagelake.llm.mixing import mix
from pagelake.llm.near_dedup import near_duplicate_groups
from pagelake.llm.packing import pack_documents
from pagelake.llm.pii import pii_counts
from pagelake.llm.sharding import shard_documents
from pagelake.llm.spelling import spelling_groups
from pagelake.llm.substring_dedup import dedup_substrings
from pagelake.llm.token_counts import token_counts
from pagelake.llm.token_files import read_token_files, write_token_files
from pagelake.llm.topk_search import top_k


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of every document when 20-word repeats are cut."""
    cut = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"), 20)
    kept = F.array_join(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), ""), " ")
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix at 150 % of all words takes from each document."""
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    path = f"{job_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path, tokenizer=vocabulary("word_bpe_49k.json"))
    return read_token_files(spark, path)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences, rules and licences of every document, as comma-separated lists."""
    found = licenses.scan_licenses(documents(spark, sf_dir))
    lists = [F.array_join(c, ",").alias(c) for c in ("sentence_ids", "rules", "licenses")]
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), *lists)


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best neighbours of every 50th vector among all vectors."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicate_groups(documents(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(documents(spark, sf_dir), tokenizer=vocabulary("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality_rules.quality_verdicts(documents(spark, sf_dir), labels)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_pack_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return pack_documents(documents(spark, sf_dir), tokenizer=vocabulary("word_bpe_49k.json"))


def op10_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards, with the shard that 9 would give."""
    return shard_documents(documents(spark, sf_dir), 8)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every frequent word of the documents."""
    return spelling_groups(documents(spark, sf_dir))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii_counts(documents(spark, sf_dir))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn by their likeness to the benchmark's texts."""
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_mix_sources, op3_token_files, op4_license_scan, op5_topk_search, op6_minhash_dedup, op7_token_counts, op8_quality_rules, op9_pack_windows, op10_jump_shards, op11_spelling_variants, op12_personal_data, op13_importance_resample)}


def _license_sql() -> str:
    """The scan in DuckDB SQL, from the same tables of sentences, names and rules, without triggers."""
    q = licenses
    pairs = lambda d: ", ".join(f"('{k}', '{v}')" for k, v in d.items())
    rules = ", ".join(f"({i}, '{n}', '{lic}', '{p}')" for i, (n, lic, p) in enumerate(q.ordered_rules(), 1))
    return rf"""
WITH RECURSIVE known(sentence, id) AS (VALUES {pairs(q.known_sentences())}),
names(name, id) AS (VALUES {pairs(q.known_names())}),
spdx(word, id) AS (VALUES {pairs(q.spdx_ids())}),
rules(k, rule, license, pattern) AS (VALUES {rules}),
parts AS (
  SELECT doc_id, i, p FROM (
    SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS i
    FROM (SELECT doc_id, string_split_regex(regexp_replace(lower(text), '{q.SHORT}', '\1\2 ', 'g'), '{q.END}') AS x FROM documents))),
lines AS (
  SELECT doc_id, i, unnest(x) AS p, generate_subscripts(x, 1) AS j
  FROM (SELECT doc_id, i, CASE WHEN contains(p, chr(10)) THEN list_concat([p], string_split(p, chr(10))) ELSE [p] END AS x FROM parts)),
clean AS (SELECT doc_id, i, j, regexp_replace(trim(regexp_replace(p, '[^a-z0-9]+', ' ', 'g')), '{q.HOLDER}', '{q._HOLDER}') AS p FROM lines),
found AS (
  SELECT doc_id, i, j, coalesce(k.id, 'ref-' || n.id) AS id
  FROM clean LEFT JOIN known k ON p = k.sentence LEFT JOIN names n ON regexp_extract(p, '{q.REFERENCE}', 1) = n.name
  WHERE length(p) > 9 AND coalesce(k.id, n.id) IS NOT NULL),
once AS (SELECT * FROM (SELECT *, lag(id) OVER (PARTITION BY doc_id ORDER BY i, j) AS before FROM found) WHERE before IS DISTINCT FROM id),
per AS (SELECT doc_id, count(*) AS n_sentences, string_agg(id, ',' ORDER BY i, j) AS sentence_ids, string_agg(' ' || id || ' ', '' ORDER BY i, j) AS line FROM once GROUP BY doc_id),
run(doc_id, k, line, rule, license) AS (
  SELECT doc_id, 0, line, NULL::VARCHAR, NULL::VARCHAR FROM per
  UNION ALL
  SELECT run.doc_id, rules.k, regexp_replace(run.line, pattern, ' | ', 'g'),
         CASE WHEN regexp_matches(run.line, pattern) THEN rules.rule END, CASE WHEN regexp_matches(run.line, pattern) THEN rules.license END
  FROM run JOIN rules ON rules.k = run.k + 1),
left_over AS (
  SELECT doc_id, unnest(x) AS id, generate_subscripts(x, 1) AS n
  FROM (SELECT doc_id, list_filter(string_split_regex(line, ' +'), lambda x: starts_with(x, 'ref-')) AS x FROM run WHERE k = (SELECT max(k) FROM rules))),
words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS n
  FROM (SELECT doc_id, flatten(list_transform(regexp_extract_all(lower(text), '{q.SPDX}', 1), lambda x: string_split_regex(x, '{q.SPDX_CUT}'))) AS w FROM documents)),
hits AS (
  SELECT doc_id, 0 AS kind, k AS n, rule, license FROM run WHERE rule IS NOT NULL
  UNION ALL SELECT doc_id, 1, min(n), 'reference-' || id[5:], id[5:] FROM left_over GROUP BY doc_id, id
  UNION ALL SELECT doc_id, 2, min(n), 'spdx-' || id, id FROM words JOIN spdx USING (word) GROUP BY doc_id, id),
all_hits AS (SELECT doc_id, string_agg(rule, ',' ORDER BY kind, n) AS rules, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM hits GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(rules, '') AS rules, coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id LEFT JOIN all_hits h ON d.doc_id = h.doc_id
"""


def _quality_sql() -> str:
    """The rules in DuckDB SQL; the binomial tail from its logarithmic terms."""
    q = quality_rules
    cuts, alpha = ", ".join(f"({c})" for c in q.CUTOFFS), q.ALPHA / len(q.RULES)
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN floor(1000 * {a} / {b}) ELSE 0 END"
    rules = {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"), "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars")}
    scored = " UNION ALL ".join(f"SELECT doc_id, lang, base_failed, '{r}' AS rule, {x} AS score FROM stats" for r, x in rules.items())
    return rf"""
WITH texts AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)),
places AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM places, range(5) r(j) GROUP BY doc_id),
stats AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM (
    SELECT t.doc_id, t.lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
           (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
           coalesce(r.n, 0)::BIGINT AS n_repeat_words,
           (length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')))::BIGINT AS n_capitals
    FROM texts t LEFT JOIN repeats r ON t.doc_id = r.doc_id)),
scored AS ({scored}),
marks AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT lang, rule, c AS cutoff, count_if(good)::DOUBLE AS n, count_if(good AND score >= c)::BIGINT AS k, count_if(NOT good AND score >= c) AS bad
  FROM scored JOIN marks USING (doc_id), (VALUES {cuts}) v(c) WHERE NOT base_failed GROUP BY lang, rule, c),
tests AS (
  SELECT *, bad - {q.COST} * k AS gain, (SELECT count(*) FROM (SELECT DISTINCT lang, rule FROM counts)) AS family,
         CASE WHEN k <= n * {alpha} THEN list_sum(list_transform(range(0, k + 1), lambda i:
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}::DOUBLE) + (n - i) * ln(1 - {alpha}::DOUBLE)))) ELSE 1 END AS tail
  FROM counts),
cut AS (
  SELECT lang, rule, arg_max(cutoff, gain * 1000000 + cutoff) AS cutoff FROM tests
  WHERE n > 0 AND gain > 0 AND tail <= {q.DELTA} / family GROUP BY lang, rule),
rejected AS (
  SELECT DISTINCT doc_id FROM scored s JOIN cut c ON s.lang IS NOT DISTINCT FROM c.lang AND s.rule = c.rule WHERE score >= cutoff)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r.doc_id IS NULL AS kept
FROM stats s LEFT JOIN rejected r ON s.doc_id = r.doc_id
"""


ORACLE_SQL = {
    "op1_substring_dedup": oracles.SUBSTRINGS,
    "op6_minhash_dedup": oracles.NEAR,
    "op10_jump_shards": oracles.JUMPS,
    "op2_mix_sources": r"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', 'mix-1', coalesce(doc_id::VARCHAR, ''))) AS h
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
ranked AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight, 2 * source_size AS most FROM per),
filled AS (
  SELECT *, most / weight AS ratio,
         coalesce(sum(most) OVER w, 0)::DOUBLE AS clamped, coalesce(sum(weight) OVER w, 0)::DOUBLE AS passed,
         row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS k
  FROM ranked
  WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM per)::DOUBLE * 1.5::DOUBLE - clamped) / ((SELECT sum(weight) FROM ranked)::DOUBLE - passed) AS level FROM filled),
found AS (SELECT arg_min(level, k) AS level FROM levels WHERE weight * level <= most),
targets AS (
  SELECT source, source_size, CASE WHEN f.level IS NULL THEN most::DOUBLE ELSE least(most::DOUBLE, weight * f.level) END AS target
  FROM filled, found f),
parts AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, floor(t.target)::BIGINT AS want,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.h, r.doc_id NULLS FIRST, r.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
whole AS (SELECT *, CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END AS whole FROM parts)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, want - whole * source_size - before)))::BIGINT AS taken
FROM whole
""",
    "op5_topk_search": """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.r <> c.r),
r AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op4_license_scan": _license_sql(),
    "op8_quality_rules": _quality_sql(),
    "op11_spelling_variants": oracles.SPELLING,
    "op12_personal_data": oracles.PERSONAL,
    "op13_importance_resample": oracles.RESAMPLE,
}
