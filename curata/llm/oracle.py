"""SQL that states the training-data queries that SQL can state, by ways of its own.

``p1_found`` counts the item's words that stand in shared runs of eight words, without their order; ``p1_matches`` joins
runs of eight words and glues neighbours on a diagonal; ``p2`` canonicalises each record whole; ``p4`` marks repeated
runs by windows. Patterns there have no look-around, so overlapping cases are replaced twice.
"""

from __future__ import annotations

_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"
_HELD = f"""WITH iw AS (SELECT id, {_WORDS.format('problem')} AS w FROM amc WHERE problem IS NOT NULL), ow AS (SELECT pool_idx, {_WORDS.format('output')} AS w FROM audit_pool WHERE output IS NOT NULL),
    ig AS (SELECT id, len(w) AS n, unnest(range(len(w) - 7)) AS spot, unnest(list_transform(range(len(w) - 7), lambda i: array_to_string(list_slice(w, i + 1, i + 8), ' '))) AS gram FROM iw WHERE len(w) >= 8),
    og AS (SELECT DISTINCT pool_idx, unnest(list_transform(range(len(w) - 7), lambda i: array_to_string(list_slice(w, i + 1, i + 8), ' '))) AS gram FROM ow WHERE len(w) >= 8),
    hit AS (SELECT DISTINCT pool_idx, id, n, spot + unnest(range(8)) AS word FROM og JOIN ig USING (gram)), held AS (SELECT pool_idx, id FROM hit GROUP BY pool_idx, id HAVING count(*) * 2 >= max(n))"""
_PLAIN = "lower(translate(@@, '０１２３４５６７８９＋＝＊．−‐‑', '0123456789+=*.---'))"
for _pattern, _to in (
    ("ß", "ss"), ("[\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}\\x{00AD}]", ""), ("\\*\\*+|_", " "), *[("(\\p{N})\\.(\\p{N})", "\\1\x01\\2")] * 2, *[("(\\p{N}),(\\p{N})", "\\1\x02\\2")] * 2,
    *[("(\\p{L}{2})[-/](\\p{L}{2})", "\\1 \\2")] * 2, ("[^\\p{L}\\p{M}\\p{N}+*=/^<>%\x01\x02-]+", " "), ("([^\\p{N} ]) +", "\\1"), (" +([^\\p{N} ])", "\\1"), ("^ +| +$", ""),
):
    _PLAIN = f"regexp_replace({_PLAIN}, '{_pattern}', '{_to}', 'g')"
_CELLS = ", ".join(_PLAIN.replace("@@", f"coalesce(record::JSON->>'$.{f}', '')") + f" AS c{k}" for k, f in enumerate(("instruction", "input", "system", "extra_info.category", "extra_info.source")))
_SAME = f"WITH c AS (SELECT pool_idx, {_CELLS} FROM pool_raw), g AS (SELECT min(pool_idx) AS keep_pool_idx, count(*) AS n_copies, c0, c1, c2, c3, c4 FROM c GROUP BY ALL)"
_CJK = "\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}"
_REPEATS = f"""t AS (SELECT pool_idx, trim(regexp_replace(lower(source), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '_') AS host, regexp_extract_all(regexp_replace(lower(output), '(^|\\n|[.!?:;。！？])([ \\t]*)(?:[#(\\[]?\\d+(?:[.):\\]]|\\s*[-–—:、])|#\\d+)', '\\1\\2 ', 'g'), '[{_CJK}]|[\\p{{L}}\\p{{N}}]+') AS w FROM audit_pool),
    p AS (SELECT pool_idx, unnest(range(len(w))) AS spot, w, len(w) AS n FROM t), q AS (SELECT pool_idx, spot, n, regexp_full_match(w[spot + 1], '[{_CJK}]') AS cjk, array_to_string(list_slice(w, spot + 1, spot + 6), ' ') AS g6, array_to_string(list_slice(w, spot + 1, spot + 10), ' ') AS g10 FROM p),
    k AS (SELECT *, sum(CASE WHEN cjk THEN 1 ELSE 0 END) OVER (PARTITION BY pool_idx ORDER BY spot ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS c6, sum(CASE WHEN cjk THEN 1 ELSE 0 END) OVER (PARTITION BY pool_idx ORDER BY spot ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS c10 FROM q),
    f AS (SELECT pool_idx, spot, 6 AS width, g6 AS g FROM k WHERE spot + 6 <= n AND c6 = 0 UNION ALL SELECT pool_idx, spot, 10, g10 FROM k WHERE spot + 10 <= n AND c10 > 0),
    again AS (SELECT pool_idx, spot, width FROM (SELECT *, row_number() OVER (PARTITION BY pool_idx, width, g ORDER BY spot) AS rn FROM f) WHERE rn > 1),
    marked AS (SELECT pool_idx, count(DISTINCT word) AS repeated FROM (SELECT pool_idx, unnest(range(spot, spot + width)) AS word FROM again) GROUP BY pool_idx),
    s AS (SELECT t.pool_idx, coalesce(t.host, '') AS host, len(coalesce(t.w, [])) AS n_words, coalesce(repeated, 0) AS repeated FROM t LEFT JOIN marked USING (pool_idx)), r AS (SELECT *, repeated > 0 AND repeated * 3 >= n_words AS fails FROM s)"""
_HOSTS = f"""{_REPEATS}, h AS (SELECT host, count(*) AS n, CAST(sum(CASE WHEN fails THEN 1 ELSE 0 END) AS BIGINT) AS n_failed FROM r GROUP BY host), pr AS (SELECT sum(n_failed) / sum(n) AS m, sum(n * (n_failed / n) * (n_failed / n)) / sum(n) AS s FROM h),
    b AS (SELECT m, greatest(m * (1 - m) / greatest(s - m * m, 1e-9) - 1, 1.0) AS strength FROM pr), u AS (SELECT host, n, n_failed, n_failed / n AS rate, (n_failed + strength * m) / (n + strength) AS shrunk_rate, m FROM h, b)"""
ORACLE: dict[str, str] = {
    "p1_found": _HELD + " SELECT pool_idx, id AS item_id FROM held",
    "p1_clean": _HELD + " SELECT pool_idx, source FROM audit_pool WHERE pool_idx NOT IN (SELECT pool_idx FROM held)",
    "p2_found": _SAME + " SELECT keep_pool_idx, pool_idx AS copy_pool_idx FROM c JOIN g USING (c0, c1, c2, c3, c4) WHERE pool_idx <> keep_pool_idx",
    "p2_groups": _SAME + " SELECT keep_pool_idx, n_copies FROM g",
    "p4_found": f"WITH {_REPEATS} SELECT pool_idx FROM r WHERE fails",
    "p4_hosts": f"WITH {_HOSTS} SELECT host, n, n_failed, round(rate, 9) AS rate, round(shrunk_rate, 9) AS shrunk_rate, shrunk_rate >= 2 * m AS bad_host, round(CAST(1 AS DOUBLE) / 3 - 0.015 * greatest(least(trunc(log2((shrunk_rate / (1 - shrunk_rate)) / (m / (1 - m)))), 3), -3), 9) AS threshold FROM u",
}
_ANY = "regexp_extract_all(lower({}), '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]|[\\p{{L}}\\p{{N}}]+')"
_GRAMS = "unnest(range(len(w) - 7)) AS {}, unnest(list_transform(range(len(w) - 7), lambda i: array_to_string(list_slice(w, i + 1, i + 8), ' '))) AS gram"
ORACLE["p1_matches"] = f"""WITH iw AS (SELECT id, {_ANY.format('problem')} AS w FROM amc WHERE problem IS NOT NULL), ow AS (SELECT pool_idx, {_ANY.format('output')} AS w FROM audit_pool WHERE output IS NOT NULL),
    ig AS (SELECT id, len(w) AS item_words, {_GRAMS.format('j')} FROM iw WHERE len(w) >= 8), og AS (SELECT pool_idx, {_GRAMS.format('p')} FROM ow WHERE len(w) >= 8),
    h AS (SELECT pool_idx, id, item_words, p, j, p - row_number() OVER (PARTITION BY pool_idx, id, p - j ORDER BY p) AS island FROM og JOIN ig USING (gram))
    SELECT pool_idx, id AS item_id, min(p) AS at_word, min(j) AS item_word, count(*) + 7 AS n_words, CAST(max(item_words) AS BIGINT) AS item_words FROM h GROUP BY pool_idx, id, p - j, island"""
