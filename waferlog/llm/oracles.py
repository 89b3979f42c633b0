"""SQL counterparts of the corpus queries, for any engine with DuckDB's functions."""

from __future__ import annotations

from . import quality

#: CRC-32 (reflected polynomial 0xEDB88320) of a list of bytes, by a table that the polynomial gives.
CRC_TABLE = """
crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab
)"""

CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, b: xor(c // 256, tab[(xor(c, b) % 256) + 1])), 4294967295)"""


def hash60(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


SHARDING = f"""
WITH {CRC_TABLE},
base AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, {CRC.format("coalesce(text, '')")} AS text_crc32,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS s,
    {hash60("'mix-1:' || coalesce(doc_id::VARCHAR, '')")} AS h
  FROM documents, crc_table
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY h, size, text_crc32) AS r, count(*) OVER (PARTITION BY s) AS n FROM base
),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (r - {hash60("'mix-1:stratum:' || s")}::DOUBLE / 1152921504606846976.0) / n, s, r) - 1 AS p,
    count(*) OVER () AS total
  FROM ranked
),
cut AS (SELECT *, (p * 40 // total)::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard,
  (p - (shard::BIGINT * total + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""


#: White space of a line; trimmed lines that are empty are blank. Blank lines go with the line before them.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
numbered AS (
  SELECT doc_id, no, line, trim(line, {BLANKS}) AS bare,
    sum(CASE WHEN trim(line, {BLANKS}) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no) AS k
  FROM split
),
filled AS (SELECT doc_id, k, bare FROM numbered WHERE bare <> ''),
windows AS (
  SELECT doc_id, k, bare || chr(10) || lead(bare, 1) OVER w || chr(10) || lead(bare, 2) OVER w AS win FROM filled WINDOW w AS (PARTITION BY doc_id ORDER BY k)
),
later AS (
  SELECT doc_id, k FROM (
    SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS seen FROM windows WHERE win IS NOT NULL
  ) WHERE seen > 1
),
covered AS (SELECT DISTINCT doc_id, k + d AS k FROM later, (VALUES (0), (1), (2)) AS t(d)),
kept AS (
  SELECT n.doc_id, string_agg(n.line, chr(10) ORDER BY n.no) FILTER (WHERE c.k IS NULL) AS text, count(c.k) FILTER (WHERE n.bare <> '') AS n_removed,
    count(*) FILTER (WHERE n.bare <> '') AS n_lines
  FROM numbered n LEFT JOIN covered c ON n.doc_id = c.doc_id AND n.k = c.k GROUP BY n.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(k.n_lines, 0)::INTEGER AS n_lines,
  coalesce(k.n_removed, 0)::INTEGER AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


EMBEDDINGS = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
near AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.93
),
reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT r.id, n.b FROM reach r JOIN near n ON r.other = n.a
),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM near GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON e.vec_id = l.id LEFT JOIN degree d ON d.a = e.vec_id
"""


def _rule_cells() -> str:
    return ", ".join(
        f"('{r.name}', {i}, {c}::BIGINT)" for r in quality.RULES for i, c in enumerate(r.cutoffs))


def _rule_values(source: str) -> str:
    return " UNION ALL ".join(f"SELECT *, '{r.name}' AS rule, ({r.scale} * {r.measure}) // nullif({r.base}, 0) AS value FROM {source}" for r in quality.RULES)


def quality_rules() -> str:
    share = quality.MOST_REJECTED / len(quality.RULES)
    return f"""
WITH words AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
),
lines AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM words
),
spots AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM words WHERE len(w) > 4),
wins AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i + 4]) > 1 AS often FROM spots),
cover AS (SELECT DISTINCT doc_id, i + d AS i FROM wins, range(5) AS t(d) WHERE often),
repeats AS (SELECT doc_id, count(*) AS n FROM cover GROUP BY doc_id),
measured AS (
  SELECT w.doc_id, 's' || w.lang AS s, len(w.w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(w.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l.l)::BIGINT AS n_lines
  FROM words w JOIN lines l ON w.doc_id = l.doc_id LEFT JOIN repeats r ON w.doc_id = r.doc_id
),
based AS (SELECT *, coalesce(s, 'n') AS stratum, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measured),
told AS (SELECT DISTINCT doc_id, quality = 1 AS good FROM labels WHERE quality IN (0, 1)),
holdout AS (SELECT b.*, t.good FROM based b JOIN told t ON b.doc_id = t.doc_id WHERE NOT b.base_failed),
cells(rule, strictness, cutoff) AS (VALUES {_rule_cells()}),
tested AS (
  SELECT h.stratum, c.rule, c.strictness, c.cutoff, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE NOT good) AS n_bad,
    count(*) FILTER (WHERE good AND value > cutoff) AS k_good, count(*) FILTER (WHERE NOT good AND value > cutoff) AS k_bad
  FROM ({_rule_values("holdout")}) h JOIN cells c ON h.rule = c.rule GROUP BY ALL
),
strata AS (SELECT greatest(1, count(DISTINCT stratum)) AS n FROM tested WHERE n_good > 0),
tails AS (
  SELECT t.*, (SELECT sum(exp(lgamma(n_good + 1) - lgamma(j + 1) - lgamma(n_good - j + 1) + j * ln({share!r}) + (n_good - j) * ln(1 - {share!r})))
    FROM range(k_good + 1) AS r(j)) AS p_value
  FROM tested t
),
sequence AS (SELECT *, max(p_value) OVER (PARTITION BY stratum, rule ORDER BY strictness) AS worst FROM tails),
certified AS (
  SELECT *, k_bad * n_good - {quality.GOOD_COST} * k_good * n_bad AS gain FROM sequence, strata WHERE worst <= {quality.FAILURE!r} / (strata.n * {len(quality.RULES)})
),
chosen AS (
  SELECT stratum, rule, cutoff FROM certified WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, strictness) = 1
),
hits AS (
  SELECT v.doc_id, v.rule FROM ({_rule_values("based")}) v JOIN chosen c ON v.stratum = c.stratum AND v.rule = c.rule WHERE v.value > c.cutoff
),
reasons AS (SELECT doc_id, string_agg(rule, ',' ORDER BY list_position({[r.name for r in quality.RULES]!r}, rule)) AS reasons FROM hits GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, NOT base_failed AND r.reasons IS NULL AS kept,
  coalesce(r.reasons, '') AS reasons
FROM based b LEFT JOIN reasons r ON b.doc_id = r.doc_id
"""


COLLOCATIONS = """
WITH lowered AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM lowered),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM words
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM words
),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE k = 3
  ) GROUP BY ALL
),
cuts AS (
  SELECT c.lang, c.phrase, c.a, 1 AS cut, w[1] AS lead, array_to_string(w[2:], ' ') AS rest FROM candidates c
  UNION ALL SELECT lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM candidates WHERE k = 3
),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON c.lang = x.lang AND c.lead = x.phrase JOIN f y ON c.lang = y.lang AND c.rest = y.phrase
),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN longer g ON w.lang = g.lang AND w.phrase = g.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * w.a
)
SELECT r.lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked r JOIN totals t ON r.lang = t.lang WHERE rank <= 2000
"""


def sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_rules(), "op4_embedding_near_dedup": EMBEDDINGS, "op3_sharding": SHARDING, "op10_line_dedup": LINE_DEDUP, "op13_phrase_collocations": COLLOCATIONS}
