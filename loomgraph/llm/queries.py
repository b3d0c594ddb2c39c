"""One query per operator over its whole table, and the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import (
    collocations, exact_dedup, html_extraction, lm_scoring, near_dup, packing, quality_ranking, quality_rules, secret_scan, sentencepiece_codec, token_files, toxicity, vector_codes,
)
from loomgraph.llm.common import read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op4_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = quality_ranking.describe(read_table(spark, sf_dir, "documents"))
    return quality_ranking.score_described(described, quality_ranking.train_described(described, read_table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link_components(read_table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_corpus(read_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(read_table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(read_table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_packing, op3_toxicity, op4_quality_ranking, op5_quality_rules,
        op6_jaccard_join, op7_lm_scoring, op8_sentencepiece, op9_html_extraction, op10_exact_dedup,
        op11_vector_codes, op12_token_files, op13_collocations,
    )
}

def located_sql(name: str, pattern: str) -> str:
    """A CTE (r, doc_id, start, stop, match) of a pattern's matches in ``d`` (r, doc_id, t)."""
    return f"""{name}_m AS (SELECT r, doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d WHERE regexp_matches(t, '{pattern}')),
{name}_i AS (SELECT r, doc_id, unnest(ms) AS match, unnest(ps[1:len(ms)]) AS piece, generate_subscripts(ms, 1) AS i FROM {name}_m),
{name} AS (SELECT r, doc_id, match, (sum(length(piece) + length(match)) OVER (PARTITION BY r ORDER BY i) - length(match))::BIGINT AS start, (sum(length(piece) + length(match)) OVER (PARTITION BY r ORDER BY i))::BIGINT AS stop FROM {name}_i)"""


_ASSIGN = secret_scan.ASSIGN.replace("'", "''")
_ALLOWED = " OR ".join(f"regexp_matches({c}, '{p}')" for c, ps in (("value", secret_scan.ALLOW_VALUES), ("match", secret_scan.ALLOW_WHOLE)) for p in ps)
_WINDOWS = "list_max(list_transform(range(1, length({0}) - 18), lambda k: list_aggregate(string_split(substr({0}, k, 20), ''), 'entropy')))"
SECRETS_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{located_sql("a", _ASSIGN)}, {located_sql("k", secret_scan.ACCESS)}, {located_sql("x", secret_scan.HEX)}, {located_sql("c", secret_scan.CANDIDATE)},
base AS (SELECT r, start, stop, 0 AS kind FROM a WHERE length(regexp_extract(match, '{_ASSIGN}', 1)) >= 8 UNION ALL SELECT r, start, stop, 1 FROM k UNION ALL SELECT r, start, stop, 2 FROM x),
v AS (SELECT *, regexp_extract(match, '{secret_scan.VALUE}', 1) AS value FROM c WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.r = c.r AND base.start < c.stop AND c.start < base.stop)),
w AS (SELECT *, regexp_matches(value, '^[0-9]{{20,}}$') AS digits, regexp_matches(value, '^[A-Za-z]{{20,}}$') AND length(regexp_replace(value, '[^A-Z]', '', 'g')) >= 4 AND length(regexp_replace(value, '[^a-z]', '', 'g')) >= 4 AS letters,
  regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]') AS mixed FROM v WHERE NOT ({_ALLOWED})),
entropy AS (SELECT r, start, stop, 3 AS kind FROM w WHERE CASE WHEN digits THEN {_WINDOWS.format("value")} >= {secret_scan.LEAST_BITS["digits"]} WHEN letters THEN {_WINDOWS.format("value")} >= {secret_scan.LEAST_BITS["letters"]}
  WHEN NOT mixed THEN false WHEN regexp_full_match(match, '[0-9a-f]+|[0-9A-F]+') THEN {_WINDOWS.format("match")} >= {secret_scan.LEAST_BITS["hex"]} ELSE {_WINDOWS.format("match")} >= {secret_scan.LEAST_BITS["mixed"]} END),
names AS (SELECT * FROM (VALUES (0, 'assign'), (1, 'access'), (2, 'hex'), (3, 'entropy')) n(kind, name)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM entropy),
g AS (SELECT r, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS spans FROM spans JOIN names USING (kind) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""

def assigned_sql(k: int) -> str:
    """CTEs of round k: b (each part's nearest entry of book k-1 and its distance) and book k."""
    return f"""
d{k} AS MATERIALIZED (SELECT id, part, entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS error FROM x JOIN c{k - 1} c USING (part, place) GROUP BY id, part, entry),
b{k} AS MATERIALIZED (SELECT id, part, min_by(entry, (error, entry)) AS entry, min(error) AS error FROM d{k} GROUP BY id, part),
s{k} AS (SELECT part, place, entry, sum(v)::BIGINT AS s, count(*)::BIGINT AS n FROM b{k} JOIN x USING (id, part) GROUP BY part, place, entry),
c{k} AS MATERIALIZED (SELECT part, place, entry, coalesce((s - ((s % n) + n) % n) // n, v) AS v FROM c{k - 1} LEFT JOIN s{k} USING (part, place, entry)),"""


CODES_SQL = f"""
WITH e AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS id, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
u AS (SELECT id, unnest(embedding) AS y, unnest(generate_series(0, len(embedding) - 1)) AS i, len(embedding) // 4 AS w FROM e),
x AS MATERIALIZED (SELECT id, i // w AS part, i % w AS place, floor(1024 * y::DOUBLE)::BIGINT AS v FROM u),
c0 AS MATERIALIZED (SELECT part, place, id - 1 AS entry, v FROM x WHERE id <= 256),{"".join(map(assigned_sql, range(1, 6)))}
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c4),
f AS (SELECT id, string_agg(printf('%02x', entry::INTEGER), '' ORDER BY part) AS code, sum(error)::BIGINT AS error FROM b5 GROUP BY id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN f USING (id), books"""

PHRASES_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM d),
said AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM p GROUP BY lang),
g AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM p WHERE len(ws) > 0),
f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS a FROM
  (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM g, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE i + m - 1 <= len(ws)) GROUP BY ALL HAVING count(*) >= 30),
w AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
c AS (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM w),
s AS (SELECT c.lang, c.phrase, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, a, ws, m, unnest(generate_series(1, m)) AS i FROM w),
longer AS (SELECT lang, array_to_string(ws[i:i + j - 1], ' ') AS phrase, max(a) AS a FROM inside, (SELECT unnest([2, 3]) AS j) WHERE j < m AND i + j - 1 <= m GROUP BY ALL),
left_over AS (SELECT best.* FROM best LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100::HUGEINT * longer.a < 80::HUGEINT * best.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score FROM left_over JOIN said USING (lang)
QUALIFY rank <= 2000"""

ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": CODES_SQL,
    "op13_collocations": PHRASES_SQL,
    "op1_secret_scan": SECRETS_SQL,
    "op5_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, unnest(generate_series(1, len(ws) - 4)) AS i, ws FROM w WHERE len(ws) > 4),
k AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS win FROM g),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM k),
p AS (SELECT DISTINCT r, unnest(generate_series(i, i + 4)) AS pos FROM c WHERE n > 1),
rep AS (SELECT r, count(*) AS n FROM p GROUP BY r),
m AS (SELECT w.doc_id, w.t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls) AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS capitals
      FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 100 * n_symbols > 30 * n_words
            OR 10 * n_dup_lines > 4 * n_lines OR 2 * capitals > word_chars) AS kept
FROM b""",
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
             ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(reach.y) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = d.doc_id GROUP BY d.doc_id""",
    "op10_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
}
