"""Registered queries of the subpackage: name -> (spark, sf_dir) -> DataFrame.

A forest, a tokenizer, a permutation by Spark's hash, a boosted model and near copies are beyond SQL; tests hold those
queries against brute force or held-out labels. What SQL can tell of op2, op4, op5, op7 and op8 (their fixed columns)
is registered as queries of their own, over the same whole tables and through the same operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tarnlight.llm.additive import op13
from tarnlight.llm.decontamination import op10
from tarnlight.llm.fuzzy_lines import op3
from tarnlight.llm.jaccard import op9
from tarnlight.llm.license_scan import BASE, op5
from tarnlight.llm.mixing import op4
from tarnlight.llm.pii import op8
from tarnlight.llm.quality import op2
from tarnlight.llm.spelling import op12
from tarnlight.llm.token_counts import op6
from tarnlight.llm.token_output import op1
from tarnlight.llm.url_filter import RULES, op7
from tarnlight.llm.vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, op11

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality_counts(spark, sf_dir: str) -> DataFrame:
    return op2(spark, sf_dir).drop("score", "kept")


QUALITY_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM t),
dups AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS r FROM lines WHERE regexp_matches(line, '{_WORD}')) WHERE r > 1 GROUP BY 1),
each AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM t),
five AS (SELECT doc_id, i, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d, lead(w, 4) OVER o AS e FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
wins AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c, d, e) AS n FROM five WHERE e IS NOT NULL),
reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM wins WHERE n > 1) GROUP BY 1),
c AS (SELECT doc_id, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM t LEFT JOIN dups d USING (doc_id) LEFT JOIN reps r USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c"""


def mix_targets(spark, sf_dir: str) -> DataFrame:
    return op4(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


MIX_SQL = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1]::DOUBLE AS weight, (2 * source_size)::DOUBLE AS most FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5 - coalesce(sum(most) OVER (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(most, (SELECT max(level) FROM l) * weight) AS target FROM l)
SELECT doc_id, size, source_size, round(target, 6) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""


def license_places(spark, sf_dir: str) -> DataFrame:
    return op5(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def _phrase_sql(phrase: str, label: str) -> str:
    words = phrase.split()
    fits = " AND ".join(f"{'abc'[k]} = '{x}'" for k, x in enumerate(words))
    return f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM starts WHERE {fits}"


LICENSE_SQL = rf"""WITH t AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
starts AS (SELECT doc_id, i, x AS a, lead(x, 1) OVER o AS b, lead(x, 2) OVER o AS c FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
hits AS ({" UNION ALL ".join(_phrase_sql(*b) for b in BASE)})
SELECT doc_id, len(any_value(w)) AS n_words, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM t LEFT JOIN hits USING (doc_id) GROUP BY doc_id"""


def url_rules(spark, sf_dir: str) -> DataFrame:
    rows = op7(spark, sf_dir)
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("rule_verdict"))


def _rule_case(value) -> str:
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{value(v, h, p)}'" for v, h, p in longest) + " END"


URL_SQL = rf"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r)
SELECT page_id, host, path, {_rule_case(lambda v, h, p: h + p)} AS rule, {_rule_case(lambda v, h, p: v)} AS rule_verdict FROM p"""


def personal_counts(spark, sf_dir: str) -> DataFrame:
    return op8(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


_DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda k: CASE WHEN k % 2 = 1 THEN CAST({_DIGITS}[-k] AS INT)
 ELSE 2 * CAST({_DIGITS}[-k] AS INT) - CASE WHEN CAST({_DIGITS}[-k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
PERSONAL_SQL = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT doc_id, 'email' AS kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS x FROM t
 UNION ALL SELECT doc_id, 'ip', unnest(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)')) FROM t
 UNION ALL SELECT doc_id, 'card', unnest(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+')) FROM t
 UNION ALL SELECT doc_id, 'phone', unnest(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]')) FROM t),
k AS (SELECT doc_id, kind FROM e WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT))) <= 255
 WHEN 'phone' THEN length({_DIGITS}) BETWEEN 9 AND 15 ELSE length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN} END)
SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone FROM t LEFT JOIN k USING (doc_id) GROUP BY 1"""

def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """Every distance, without pruning; a round is three tables."""
    near = "SELECT vec_id, p, arg_min(e, d * {n} + e) AS e, min(d) AS d FROM (SELECT vec_id, p, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM v JOIN {b} USING (p)) GROUP BY 1, 2"
    steps = []
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(b=f'b{k}', n=entries)})")
        if k < rounds:
            steps.append(f"m{k} AS (SELECT p, e, i, floor(sum(y) / count(*)) AS y FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM v JOIN a{k} USING (vec_id, p)) GROUP BY 1, 2, 3)")
            steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b{k}.c) AS c FROM b{k} LEFT JOIN (SELECT p, e, list(y ORDER BY i) AS c FROM m{k} GROUP BY 1, 2) n USING (p, e))")
    return f"""WITH kept AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
w AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS f, len(embedding) // {parts} AS n, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM kept),
v AS MATERIALIZED (SELECT vec_id, r, p, f[p * n + 1:(p + 1) * n] AS x FROM w, (SELECT unnest(range({parts})) AS p)),
b0 AS MATERIALIZED (SELECT p, r AS e, x AS c FROM v WHERE r < {entries}),
{", ".join(steps)},
codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1),
book AS (SELECT sha256(string_agg(CAST(CAST(y AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(c) AS y, generate_subscripts(c, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes JOIN w USING (vec_id), book"""


#: crc32 as the sum (xor) of what each byte adds at its distance from the end; near words by equal rests after a deletion.
VARIANTS_SQL = r"""WITH RECURSIVE runs AS MATERIALIZED (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS s, w, count(*) AS times FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) WHERE length(w) >= 5 GROUP BY ALL),
bits(b, c, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS MATERIALIZED (SELECT b, c FROM bits WHERE k = 8),
far(p, b, c) AS (SELECT 0, b, c FROM crc UNION ALL SELECT f.p + 1, f.b, xor(f.c >> 8, t.c) FROM far f JOIN crc t ON t.b = f.c & 255 WHERE f.p < (SELECT 2 * max(length(s)) FROM runs)),
ends(p, c) AS (SELECT 0, 4294967295 UNION ALL SELECT e.p + 1, xor(e.c >> 8, t.c) FROM ends e JOIN crc t ON t.b = e.c & 255 WHERE e.p < (SELECT 2 * max(length(s)) FROM runs)),
spelled AS (SELECT s, flatten(list_transform(string_split(s, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)) AS bytes FROM (SELECT DISTINCT s FROM runs)),
each AS (SELECT s, len(bytes) AS n, unnest(bytes) AS b, len(bytes) - generate_subscripts(bytes, 1) AS p FROM spelled),
sums AS (SELECT s, n, bit_xor(c) AS c FROM each JOIN far USING (p, b) GROUP BY ALL),
hashed AS (SELECT s, xor(xor(sums.c, ends.c), 4294967295) AS h FROM sums JOIN ends ON ends.p = n),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, times FROM runs JOIN hashed USING (s)),
words AS MATERIALIZED (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3),
less AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS other FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT d.word, w.word FROM less d JOIN words w ON w.word = d.rest UNION SELECT w.word, d.word FROM less d JOIN words w ON w.word = d.rest),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, (-w.n, other)) AS form, max(w.n) AS form_n FROM near JOIN words w ON w.word = other GROUP BY 1),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain(word, root, k) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT c.word, f.form, c.k + 1 FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN last USING (word)"""

QUERIES = {
    "op1_token_output_elias_fano": op1,
    "op2_quality_isolation_forest": op2,
    "op3_fuzzy_line_dedup": op3,
    "op4_mixing_to_target_weights": op4,
    "op5_license_scan_rare_tokens": op5,
    "op6_token_counts_longest_match": op6,
    "op7_url_filter_boosted_trees": op7,
    "op8_pii_weak_supervision": op8,
    "op9_ngram_jaccard_join": op9,
    "op10_benchmark_decontamination": op10,
    "op11_vector_codes_annular_pruning": op11,
    "op12_spelling_variants_automata": op12,
    "op13_quality_additive_model": op13,
    "quality_counts": quality_counts,
    "mix_targets": mix_targets,
    "license_places": license_places,
    "url_rules": url_rules,
    "personal_counts": personal_counts,
}

#: DuckDB SQL for those that SQL can express.
ORACLE = {
    "op11_vector_codes_annular_pruning": codes_sql(),
    "op12_spelling_variants_automata": VARIANTS_SQL,
    "quality_counts": QUALITY_SQL,
    "mix_targets": MIX_SQL,
    "license_places": LICENSE_SQL,
    "url_rules": URL_SQL,
    "personal_counts": PERSONAL_SQL,
}
