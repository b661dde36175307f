"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import re

from penprint.llm import host_quality, licenses, suffix_dedup, url_filter

_BLANK = r"[\x20\x09-\x0D]"

QUALITY = rf"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '{_BLANK}+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_BLANK}', '', 'g') <> '') AS l FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, len(w)::bigint AS n_words, length(regexp_replace(t, '{_BLANK}', '', 'g'))::bigint AS word_chars,
    len(regexp_extract_all(t, '{host_quality.SYMBOLS}'))::bigint AS n_symbols, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines,
    coalesce(n, 0)::bigint AS n_repeat_words FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id),
f AS (SELECT *, n_words < {host_quality.LEAST_WORDS} OR 100 * n_repeat_words > {host_quality.REPEAT_SHARE} * n_words AS base_failed, 5 * n_dup_lines > n_lines OR 10 * n_symbols > n_words AS soft FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR soft) AS failed FROM f GROUP BY source),
p AS (SELECT sum(failed) / sum(n) AS mean, coalesce(var_samp(failed / n), 0) AS spread, avg(1 / n) AS inverse FROM h),
q AS (SELECT mean, CASE WHEN inverse < 1 AND spread - mean * (1 - mean) * inverse > 0
    THEN greatest(0, least(1 / inverse, mean * (1 - mean) * (1 - inverse) / (spread - mean * (1 - mean) * inverse) - 1)) ELSE 1 / inverse END AS weight FROM p),
r AS (SELECT source, (failed + mean * weight) / (n + weight) AS rate FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (rate > mean + {host_quality.LIMIT} * CASE WHEN weight > 0 THEN sqrt(mean * (1 - mean) / (weight + 1)) ELSE 0 END AND soft) AS kept, round(rate, 6) AS host_rate
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source, q"""


def _licenses() -> str:
    grams = []
    for template, (label, text) in enumerate(licenses.TEMPLATES):
        words = [w for w in re.split("[^0-9a-z]+", text.lower()) if w]
        n = len(words) - licenses.K + 1
        grams += [f"({template}, '{label}', {i}, '{' '.join(words[i : i + licenses.K])}', {n})" for i in range(n)]
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licenses.PHRASES.items())
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex({lower}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
phrases(phrase, label, k) AS (VALUES {phrases}), templates(template, label, tpos, gram, grams) AS (VALUES {", ".join(grams)}),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
base AS (SELECT doc_id, i - 1 AS start, label FROM spots JOIN phrases ON array_to_string(w[i:i+k-1], ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base GROUP BY doc_id),
votes AS (SELECT doc_id, template, label, i - 1 - tpos AS diagonal, list(DISTINCT tpos) AS hit, any_value(grams) AS grams FROM spots JOIN templates ON array_to_string(w[i:i+{licenses.K - 1}], ' ') = gram GROUP BY 1, 2, 3, 4),
found AS (SELECT doc_id, label, len(list_distinct(flatten(list(hit) OVER (PARTITION BY doc_id, template ORDER BY diagonal RANGE BETWEEN CURRENT ROW AND {licenses.SLACK} FOLLOWING)))) / grams AS share FROM votes),
v AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM found WHERE share >= {licenses.LEAST_SHARE} GROUP BY doc_id)
SELECT w.doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word::bigint AS first_word, last_word::bigint AS last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(v.labels, [])))), ','), '') AS labels,
    greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END)::double AS score
FROM w LEFT JOIN b ON w.doc_id = b.doc_id LEFT JOIN v ON w.doc_id = v.doc_id"""


def _urls() -> str:
    host = lambda u: f"translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    out = rf"""WITH RECURSIVE rules(verdict, rhost, rpath) AS (VALUES {rules}),
p AS (SELECT page_id, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN {host("url")} ELSE '' END AS host,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r AS (SELECT p.*, (SELECT arg_max(struct_pack(rule := rhost || rpath, verdict := verdict), length(rhost || rpath)) FROM rules WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS r FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (WHERE r.verdict = 'allow') AS allowed, count(*) FILTER (WHERE r.verdict = 'block') AS blocked FROM r WHERE host <> '' GROUP BY host),
links AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href\s*=\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS u FROM p),
e AS (SELECT src, dst, count(*) AS links FROM (SELECT src, {host("u")} AS dst FROM (SELECT src, CASE WHEN starts_with(u, '//') THEN 'http:' || u ELSE u END AS u FROM links)) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)"""
    for name, count, src, dst in (("trust", "allowed", "src", "dst"), ("distrust", "blocked", "dst", "src")):
        out += f", {name}_e AS (SELECT {src} AS s, {dst} AS d, links / sum(links) OVER (PARTITION BY {src}) AS share FROM e), {name}0 AS (SELECT host, {count} / n AS score FROM h WHERE {count} > 0)"
        for i in range(url_filter.ROUNDS):
            out += f", {name}{i + 1} AS (SELECT host, sum(score) AS score FROM (SELECT * FROM {name}0 UNION ALL SELECT d, {url_filter.DAMPING} * share * score FROM {name}_e JOIN {name}{i} ON s = host) GROUP BY host)"
    last = url_filter.ROUNDS
    return f"""{out} SELECT page_id, r.host, path, r.rule AS rule, coalesce(r.verdict, CASE WHEN coalesce(b.score, 0) - coalesce(a.score, 0) > {url_filter.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
    round(coalesce(a.score, 0), 9)::double AS trust, round(coalesce(b.score, 0), 9)::double AS distrust FROM r LEFT JOIN trust{last} a ON r.host = a.host LEFT JOIN distrust{last} b ON r.host = b.host"""


def _warc(least: int = 0) -> str:
    letters = " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(s, {10 * g + 1}, 10))::bigint >> {shift}) & 31)::int + 1, 1)" for g in range(4) for shift in range(35, -1, -5)
    )
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages), s AS (SELECT page_id, strlen(t)::bigint AS payload_bytes, sha1(t) AS s FROM p),
    d AS (SELECT page_id, payload_bytes, {letters} AS payload_digest FROM s),
    o AS (SELECT *, CASE WHEN payload_bytes >= {least} THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < original THEN original END AS refers_to FROM o"""


def _suffix_dedup(length: int = suffix_dedup.LENGTH) -> str:
    """Every window of bytes, as hexadecimal, by its MD5."""
    character = "[0-7].|(?:C[2-9A-F]|D.)[89AB].|(?:E0[AB].|E[1-9A-CEF][89AB].|ED[89].)[89AB].|(?:F0[9AB].|F[1-3][89AB].|F48.)[89AB].[89AB].|.."
    end = "CASE WHEN j = 1 THEN 0 ELSE ends[j - 1] END"
    return f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, unnest(range(length(h) // 2 - {length - 1})) AS i, h FROM d WHERE length(h) >= {2 * length}),
t AS (SELECT r, i FROM (SELECT r, i, md5_number(substr(h, 2 * i + 1, {2 * length})) AS m FROM w) QUALIFY count(*) OVER (PARTITION BY m) > 1),
g AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= {length} THEN 0 ELSE 1 END AS fresh FROM t),
spans AS (SELECT r, min(i) AS a, max(i) + {length} AS b FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS span FROM g) GROUP BY r, span),
per AS (SELECT r, sum(b - a) AS gone, count(*) AS n, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY r),
kept AS (SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0) AS gone, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(1, n + 2),
    lambda j: substr(h, 2 * ({end}) + 1, 2 * ((CASE WHEN j > n THEN length(h) // 2 ELSE starts[j] END) - ({end})))), '') END AS k FROM d LEFT JOIN per ON d.r = per.r)
SELECT doc_id, n_bytes::bigint AS n_bytes, gone::bigint AS n_removed, n::bigint AS n_spans, sha256(unhex(k)) AS kept_sha256, (length(k) // 2)::bigint AS n_kept,
    decode(unhex(array_to_string(list_filter(regexp_extract_all(k, '{character}'), lambda c: c <> 'EFBFBD' AND (length(c) > 2 OR c < '80')), ''))) AS text FROM kept"""


ORACLES = {"op2_host_quality": QUALITY, "op3_licenses": _licenses(), "op4_url_filter": _urls(), "op7_suffix_dedup": _suffix_dedup(), "op10_warc": _warc()}
