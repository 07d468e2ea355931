"""The public tokenizer and the mixing of sources in SQL, for comparison only."""

from __future__ import annotations

from setlens.llm import encode

_BLANK = r"\x{0009}-\x{000D}\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_MARK = "chr(1114111)"  # no character; parts white space before its last code point, as RE2 cannot look ahead
_PIECES = rf"''s|''t|''re|''ve|''m|''ll|''d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_BLANK}\p{{L}}\p{{N}}\x{{10FFFF}}]+|[{_BLANK}]+"


def tokens_cte(path: str | None = None) -> str:
    """WITH RECURSIVE ... enc(row, doc_id, source, ids): merges of the lowest rank first, over the different pieces of all texts."""
    path = path or encode.default_vocabulary()[0]
    return rf"""
WITH RECURSIVE vocabulary AS MATERIALIZED (SELECT hex(from_base64(b)) AS token, r FROM read_csv('{path}', delim=' ', header=false, quote='', columns={{'b': 'VARCHAR', 'r': 'BIGINT'}})),
cut AS MATERIALIZED (SELECT doc_id, lower(trim(source)) AS source, row_number() OVER () AS row,
  regexp_extract_all(regexp_replace(coalesce(text, ''), '([{_BLANK}]+)([{_BLANK}])([^{_BLANK}])', '\1' || {_MARK} || '\2\3', 'g'), '{_PIECES}') AS pieces FROM documents),
piece AS MATERIALIZED (SELECT DISTINCT unnest(pieces) AS p FROM cut),
known AS (SELECT p, hex(encode(p)) AS h, r FROM piece LEFT JOIN vocabulary ON token = hex(encode(p))),
steps AS (
  SELECT p, list_transform(range(1, length(h) + 1, 2), lambda i: h[i:i + 1]) AS t, 0 AS k FROM known WHERE r IS NULL
  UNION ALL
  SELECT p, list_concat(list_append(t[1:b - 1], t[b] || t[b + 1]), t[b + 2:]), k + 1 FROM (
    SELECT p, any_value(t) AS t, any_value(k) AS k, arg_min(i, r * 1000000 + i) AS b FROM (SELECT p, t, k, unnest(range(1, len(t))) AS i FROM steps) s
    JOIN vocabulary ON token = s.t[i] || s.t[i + 1] GROUP BY p)),
merged AS (SELECT p, arg_max(t, k) AS t FROM steps GROUP BY p UNION ALL SELECT p, [h] FROM known WHERE r IS NOT NULL),
coded AS MATERIALIZED (SELECT p, list(r::INTEGER ORDER BY i) AS ids FROM (SELECT p, unnest(t) AS token, unnest(range(len(t))) AS i FROM merged) JOIN vocabulary USING (token) GROUP BY p),
joined AS (SELECT row, flatten(list(ids ORDER BY i)) AS ids FROM (SELECT row, unnest(pieces) AS p, unnest(range(len(pieces))) AS i FROM cut) JOIN coded USING (p) GROUP BY row),
enc AS MATERIALIZED (SELECT row, doc_id, source, coalesce(ids, []::INTEGER[]) AS ids FROM cut LEFT JOIN joined USING (row))
"""


# shares with limits: sources whose limit lies below their part of what is left are held there, those with the tightest limit first
MIX = """
, doc AS MATERIALIZED (SELECT doc_id, source, len(ids)::BIGINT AS tokens FROM enc),
there AS (SELECT source, sum(tokens)::BIGINT AS available FROM doc GROUP BY source),
target AS (SELECT mix_id, lower(trim(source)) AS source, sum(greatest(0, coalesce(target_weight, 0))) AS weight, max(coalesce(max_repeats, 0)) AS most FROM mix_targets WHERE source IS NOT NULL GROUP BY ALL),
whole_mix AS (SELECT t.mix_id, max(coalesce(total_fraction, 0)) AS fraction FROM mix_targets t WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT t.*, coalesce(available, 0) AS available, most * coalesce(available, 0) AS cap, fraction * sum(coalesce(available, 0)) OVER (PARTITION BY mix_id) AS total,
  sum(weight) OVER (PARTITION BY mix_id) AS weights FROM target t LEFT JOIN there USING (source) JOIN whole_mix USING (mix_id)),
o AS (SELECT *, total - coalesce(sum(cap) OVER (PARTITION BY mix_id ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
  sum(weight) OVER (PARTITION BY mix_id ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_ FROM t WHERE available > 0 AND weight > 0),
free AS (SELECT mix_id, arg_min(left_ / open_, cap / weight) AS level FROM o WHERE left_ * weight / open_ < cap GROUP BY mix_id),
want AS (SELECT t.*, CASE WHEN available > 0 AND weight > 0 THEN least(cap, coalesce(greatest(level, 0) * weight, cap)) ELSE 0 END AS want FROM t LEFT JOIN free USING (mix_id)),
share AS (SELECT *, CASE WHEN available > 0 THEN floor(want / available)::INT ELSE 0 END AS whole FROM want),
plan AS MATERIALIZED (SELECT *, want - whole * available AS rest FROM share),
w AS (SELECT source, tokens, sum(tokens) AS t, sum(tokens * tokens) AS wt FROM doc WHERE tokens > 0 GROUP BY ALL),
up AS (SELECT source, tokens, coalesce(sum(t) OVER (PARTITION BY source ORDER BY tokens DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
  sum(wt) OVER (PARTITION BY source ORDER BY tokens) AS wt FROM w),
odds AS (SELECT mix_id, source, max(tokens) AS largest, arg_max((rest - taken) / wt, tokens) AS factor, arg_max(rest - taken, tokens) AS open_ FROM plan JOIN up USING (source)
  WHERE rest > 0 AND (rest - taken) / wt * tokens < 1 GROUP BY ALL),
each_ AS (SELECT p.mix_id, p.source, d.doc_id, d.tokens, p.whole, p.rest > 0 AND d.tokens > coalesce(largest, 0) AS certain, p.rest > 0 AND d.tokens <= coalesce(largest, 0) AS drawn, factor * d.tokens AS pr, open_,
  (('0x' || substr(sha256('mix:' || p.mix_id || ':' || d.doc_id), 1, 15))::BIGINT + 0.5::DOUBLE) / 1152921504606846976 AS u FROM plan p JOIN doc d USING (source) LEFT JOIN odds o ON o.mix_id = p.mix_id AND o.source = p.source WHERE d.tokens > 0),
ranked AS (SELECT *, sum(tokens) OVER (PARTITION BY mix_id, source, drawn ORDER BY u * (1 - pr) / (u * (1 - pr) + pr * (1 - u)), doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM each_),
mix AS MATERIALIZED (SELECT mix_id, source, doc_id, tokens, whole + (certain OR (drawn AND upto - tokens / 2.0::DOUBLE <= open_))::INT AS copies FROM ranked),
mixed AS (SELECT * FROM mix WHERE copies > 0)
"""
