"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from qualigraph.llm import quality, sharding

_WORD = "[^\\x20\\x09-\\x0D]+"


def op3_sharding() -> str:
    """Placement by the same hash; the table is a literal, tests hold it against a slow construction."""
    owner = ",".join(map(str, sharding.lookup_table()))
    return f"""
WITH placed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce('k:' || doc_id::VARCHAR, 'null')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot
  FROM documents)
SELECT doc_id, slot, ([{owner}])[slot + 1]::BIGINT AS shard FROM placed"""


def _rejects() -> str:
    value = {
        "mean_word_length": "word_chars / n_words",
        "symbol_ratio": "n_noise / n_words",
        "stop_word_ratio": "n_stop / n_words",
        "repeat_word_ratio": "n_repeat_words / n_words",
        "duplicate_line_ratio": "n_dup_lines / nullif(n_lines, 0)",
    }
    parts = []
    for r in quality.RULES:
        bounds = [f"{value[r.measure]} < {r.low}"] * (r.low is not None) + [f"{value[r.measure]} > {r.high}"] * (r.high is not None)
        parts.append(f"coalesce(n_words >= {r.min_words} AND ({' OR '.join(bounds)}), false)")
    return "\n    OR ".join(parts)


def op10_quality() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS words FROM d),
grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM twice) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    len(regexp_extract_all(text, '[#*$%&|<>!]'))::BIGINT AS n_noise,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(regexp_extract_all(lower(regexp_replace(text, '[^\\p{{L}}\\x20\\x09-\\x0D]+', '', 'g')), '{_WORD}'),
      lambda x: x IN ({stop}))) AS n_stop
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
v AS (
  SELECT *, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
    ({_rejects()}) AS rejected
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND NOT rejected) AS kept FROM v"""


def oracles() -> dict[str, str]:
    return {"op3_sharding": op3_sharding(), "op10_quality": op10_quality()}
