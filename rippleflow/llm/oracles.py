"""SQL of the other engine for the text operators that SQL can express."""

from __future__ import annotations

from .quality import LEAST_LIMIT, LEAST_WORDS, MAX_LANGUAGES, MOST_LIMIT, SPREAD, WORDS
from .suffix_dedup import LENGTH

_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
n AS (SELECT r, len(ws) AS n_words FROM w),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], chr(1)) AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5) x),
twice AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT win.r, win.i + k.k AS p FROM win JOIN twice ON win.r = twice.r AND win.g = twice.g CROSS JOIN (SELECT unnest(range(0, 5)) AS k) k) y GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d) z WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT r, length(t) AS c0, length(regexp_replace(t, '\p{Ll}+', '', 'g')) AS c1, length(regexp_replace(t, '[\p{Ll}\p{Lu}]+', '', 'g')) AS c2, length(regexp_replace(t, '[\p{L}\p{M}]+', '', 'g')) AS c3,
    length(regexp_replace(t, '[\p{L}\p{M}\p{N}]+', '', 'g')) AS c4, length(regexp_replace(t, '[\p{L}\p{M}\p{N}\s\x0B]+', '', 'g')) AS c5, length(regexp_replace(t, '[\p{L}\p{M}\p{N}\s\x0B\p{P}]+', '', 'g')) AS c6 FROM d),
ch AS (SELECT r, 0 AS k, c0 - c1 AS n FROM c UNION ALL SELECT r, 1, c1 - c2 FROM c UNION ALL SELECT r, 2, c2 - c3 FROM c UNION ALL SELECT r, 3, c3 - c4 FROM c UNION ALL SELECT r, 4, c4 - c5 FROM c UNION ALL SELECT r, 5, c5 - c6 FROM c UNION ALL SELECT r, 6, c6 FROM c),
spoken AS (SELECT d.lang, lower(q.x) AS v, count(*) AS n FROM (SELECT r, unnest(ws) AS x FROM w) q JOIN d ON q.r = d.r WHERE d.lang IS NOT NULL GROUP BY d.lang, lower(q.x)),
langs AS (SELECT lang, sum(n) AS total FROM spoken GROUP BY lang HAVING sum(n) >= {least} ORDER BY total DESC, lang LIMIT {most}),
wref AS (SELECT s.lang, s.v, s.n / l.total::DOUBLE AS q FROM (SELECT lang, v, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, v) AS k FROM spoken WHERE regexp_matches(v, '\p{L}')) s JOIN langs l ON s.lang = l.lang WHERE s.k <= {words}),
known AS (SELECT r, lower(x) AS v, count(*) AS n FROM (SELECT r, unnest(ws) AS x FROM w) q SEMI JOIN wref ON lower(x) = wref.v GROUP BY r, lower(x)),
own AS (SELECT r, k, n / greatest(sum(n) OVER (PARTITION BY r), 1)::DOUBLE AS p FROM ch),
ref AS (SELECT lang, k, s / greatest(sum(s) OVER (PARTITION BY lang), 1)::DOUBLE AS q FROM (SELECT d.lang, x.k, sum(x.n) AS s FROM ch x JOIN d ON x.r = d.r WHERE d.lang IN (SELECT lang FROM langs) GROUP BY d.lang, x.k) y),
js AS (SELECT r, min(e) AS e FROM (SELECT o.r, f.lang, sqrt(greatest(sum((CASE WHEN o.p > 0 THEN o.p * log2(o.p / ((o.p + f.q) / 2)) ELSE 0 END + CASE WHEN f.q > 0 THEN f.q * log2(f.q / ((o.p + f.q) / 2)) ELSE 0 END) / 2), 0)) AS e
    FROM own o JOIN ref f ON o.k = f.k GROUP BY o.r, f.lang) z GROUP BY r),
wbins AS (SELECT lang, v, q FROM wref UNION ALL SELECT lang, NULL, 1 - sum(q) FROM wref GROUP BY lang),
none AS (SELECT lang, sqrt(greatest(sum((CASE WHEN v IS NULL THEN log2(1 / ((1 + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((CASE WHEN v IS NULL THEN 1 ELSE 0 END + q) / 2)) ELSE 0 END) / 2), 0)) AS e FROM wbins GROUP BY lang),
hits AS (SELECT k.r, f.lang, f.v, k.n FROM known k JOIN wref f ON k.v = f.v),
held AS (SELECT r, lang, sum(n) AS n FROM hits GROUP BY r, lang),
wown AS (SELECT n.r, f.lang, f.q, (CASE WHEN f.v IS NULL THEN n.n_words - coalesce(x.n, 0) ELSE coalesce(h.n, 0) END) / greatest(n.n_words, 1)::DOUBLE AS p
    FROM n CROSS JOIN wbins f LEFT JOIN hits h ON h.r = n.r AND h.lang = f.lang AND h.v = f.v LEFT JOIN held x ON x.r = n.r AND x.lang = f.lang),
wjs AS (SELECT r, min(e) AS e FROM (SELECT o.r, o.lang, sqrt(greatest(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 0)) / any_value(z.e) AS e FROM wown o JOIN none z ON o.lang = z.lang GROUP BY o.r, o.lang) y GROUP BY r),
base AS (SELECT d.doc_id, n.n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(d.t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
    length(d.t) AS n_chars, jc.e AS char_js, CASE WHEN d.lang IS NULL OR d.lang IN (SELECT lang FROM langs) THEN jw.e END AS word_js FROM d JOIN n ON d.r = n.r LEFT JOIN lines l ON d.r = l.r LEFT JOIN rep p ON d.r = p.r LEFT JOIN js jc ON jc.r = d.r LEFT JOIN wjs jw ON jw.r = d.r),
usual AS (SELECT count(*) / sum(1 / (word_js * sqrt(n_words))) AS s FROM base WHERE n_words >= 50 AND 100 * n_repeat_words <= 20 * n_words AND word_js > 0 AND word_js <= {limit})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(n_chars >= 200 AND char_js > 0.2, FALSE) AND NOT coalesce(n_words >= 50 AND word_js > coalesce(least({limit}, greatest({floor}, {spread} * usual.s / sqrt(greatest(n_words, 1)))), {limit}), FALSE) AS kept, round(char_js, 6) AS char_js, round(word_js, 6) AS word_js FROM base CROSS JOIN usual
"""

_REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT r, doc_id, h, length(h) // 2 AS n FROM d),
win AS (SELECT r, i, md5(substr(h, 2 * i + 1, 2 * {length})) AS g FROM (SELECT r, h, unnest(range(0, n - {length} + 1)) AS i FROM n WHERE n >= {length}) x),
often AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
starts AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM win SEMI JOIN often ON win.g = often.g),
runs AS (SELECT r, min(i) AS s, max(i) + {length} AS e FROM (SELECT r, i, sum(CASE WHEN step IS NULL OR step > {length} THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM starts) y GROUP BY r, k),
parts AS (SELECT r, s, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS a, s AS b FROM runs UNION ALL SELECT r, max(e), max(e), NULL FROM runs GROUP BY r),
cut AS (SELECT p.r, string_agg(CASE WHEN p.b IS NULL THEN substr(n.h, 2 * p.a + 1) ELSE substr(n.h, 2 * p.a + 1, 2 * (p.b - p.a)) END, '' ORDER BY p.s, p.a) AS h FROM parts p JOIN n ON p.r = n.r GROUP BY p.r),
total AS (SELECT r, CAST(sum(e - s) AS BIGINT) AS removed, count(*) AS spans FROM runs GROUP BY r)
SELECT n.doc_id, n.n AS n_bytes, coalesce(t.removed, 0) AS n_removed, coalesce(t.spans, 0) AS n_spans, sha256(unhex(coalesce(c.h, n.h))) AS kept_sha256 FROM n LEFT JOIN total t ON n.r = t.r LEFT JOIN cut c ON n.r = c.r
"""

#: All pairs of item and line one by one; crc32 by its table of bytes.
_BANDS = """
WITH RECURSIVE t(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM t WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS c FROM t WHERE k = 8),
l AS (SELECT row_number() OVER () AS r, sale_id, line_no, item_id, quantity::BIGINT AS q, floor(100 * amount + 0.5)::BIGINT AS a FROM sale_lines
    WHERE sale_id IS NOT NULL AND item_id IS NOT NULL AND quantity IS NOT NULL AND amount IS NOT NULL),
x AS (SELECT r, sale_id, line_no, item_id, (2 * a + q - ((2 * a + q) % (2 * q) + 2 * q) % (2 * q)) // (2 * q) AS u, concat(sale_id, ',', line_no, ',', item_id) AS s FROM l),
lines AS (SELECT sale_id, line_no, item_id, u, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(s, ''), lambda b: ascii(b)::BIGINT)), lambda h, b: xor(h // 256, tab.c[xor(h % 256, b) + 1])), 4294967295) AS crc FROM x, tab),
i AS (SELECT row_number() OVER () AS r, item_id, floor(100 * price + 0.5)::BIGINT AS p FROM items),
pairs AS (SELECT i.r, abs(u - p) AS gap, u, sale_id, line_no, lines.item_id AS line_item_id, crc FROM i JOIN lines ON lines.item_id <> i.item_id AND (abs(u - p) <= 100 OR 1000 * abs(u - p) <= greatest(u, p))),
total AS (SELECT r, count(*) AS n_pairs, sum(gap)::BIGINT AS gap_sum, sum(crc)::BIGINT AS lines_crc FROM pairs GROUP BY r),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY gap, u, sale_id, line_no, line_item_id) AS k FROM pairs) y WHERE k <= 2)
SELECT i.item_id, coalesce(k, 0)::INTEGER AS rank, gap, u, sale_id, line_no::BIGINT AS line_no, line_item_id, coalesce(n_pairs, 0) AS n_pairs, coalesce(gap_sum, 0) AS gap_sum, coalesce(lines_crc, 0) AS lines_crc
FROM i LEFT JOIN total ON i.r = total.r LEFT JOIN first ON i.r = first.r
"""


def oracle_sql() -> dict[str, str]:
    limits = {"{words}": WORDS, "{least}": LEAST_WORDS, "{most}": MAX_LANGUAGES, "{limit}": MOST_LIMIT, "{floor}": LEAST_LIMIT, "{spread}": SPREAD}
    quality = _QUALITY
    for name, value in limits.items():
        quality = quality.replace(name, str(value))
    return {"op2_repeated_substrings": _REPEATS.replace("{length}", str(LENGTH)), "op10_quality_rules": quality, "op12_price_bands": _BANDS}
