"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

LOWER_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
PLAIN_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _words(pattern: str, lower: bool) -> str:
    text = "coalesce(text, '')"
    return pattern.format(LOWER_AZ.format(text) if lower else text)


DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words(PLAIN_WORDS, True)} AS w FROM documents),
b AS (SELECT item_id, {_words(PLAIN_WORDS, True)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
       FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM d CROSS JOIN ns, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
       FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words(SPACED_WORDS, True)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
      FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM x JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * k >= 75 * (ca.n + cb.n - k)),
reach AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, coalesce(least(low.b, d.doc_id), d.doc_id) AS component_id,
       coalesce(low.b, d.doc_id) >= d.doc_id AS kept
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN low ON d.doc_id = low.a
"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_words(SPACED_WORDS, False)} AS w FROM documents),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
f AS (SELECT g, min(doc_id) AS low FROM v GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM v JOIN f ON v.g = f.g AND f.low < v.doc_id, LATERAL (SELECT unnest(range(i, i + 13)) AS p)),
r AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, string_agg(d.w[i], ' ' ORDER BY i) AS kept FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i)
      WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = d.doc_id AND gone.p = i) GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id LEFT JOIN k ON d.doc_id = k.doc_id
"""

ORACLES = {
    "op5_benchmark_decontamination": DECONTAMINATION,
    "op6_minhash_near_dedup": NEAR_DUPLICATES,
    "op7_substring_dedup": SUBSTRINGS,
}

CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(5 + length(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '[', '\b'), ']', '\e')) + 2 + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b')) + 4) AS chars
      FROM c GROUP BY conv_id)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(n AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM g
"""

_TWO = "('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br')"
_HOST = f"coalesce({LOWER_AZ.format(chr(39).join(['regexp_extract(url, ', '(?s)^.*?://([^/?#]*)', ', 1)']))}, '')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _level(name: str, key: str, up: str, up_key: str) -> str:
    """The CTEs of one level of the reputation model: sums, strength and posterior."""
    above = f"JOIN {up}_p u ON u.k = c.{up_key}" if up else ""
    m, group = ("u.rate", f"c.{key}, u.rate") if up else ("0.5", f"c.{key}")
    return f"""{name}_s AS (SELECT c.{key} AS k, CAST({m} AS DOUBLE) AS m, CAST(sum(c.bad) AS DOUBLE) AS a, CAST(sum(c.n) AS DOUBLE) AS n FROM c {above} GROUP BY {group}),
{name}_v AS (SELECT round(coalesce(1 / least(greatest((sum((a - n * m) * (a - n * m) / n) - sum(m * (1 - m))) / nullif(sum((n - 1) * m * (1 - m)), 0), 1 / 1001.0::DOUBLE), 1 / 3.0::DOUBLE) - 1, 1000), 6) AS s FROM {name}_s),
{name}_p AS (SELECT k, round((m * s + a) / (s + n), 9) AS rate, s + n AS weight FROM {name}_s, {name}_v)"""


URLS = f"""
WITH p0 AS (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages),
p AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name FROM p0),
o AS (SELECT doc_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels GROUP BY doc_id),
l AS (SELECT name, sum(bad) AS bad, count(bad) AS n FROM p JOIN o ON page_id = doc_id WHERE host <> '' GROUP BY name HAVING count(bad) > 0),
q AS (SELECT *, array_to_string(string_split(name, '.')[-2:], '.') AS two, array_to_string(string_split(name, '.')[-3:], '.') AS three, string_split(name, '.')[-1] AS one,
             regexp_matches(name, '^[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+$') AS address FROM p),
names AS (SELECT DISTINCT name, CASE WHEN address THEN name WHEN two IN {_TWO} THEN three ELSE two END AS domain,
                 CASE WHEN address THEN '(address)' WHEN two IN {_TWO} THEN two ELSE one END AS suffix FROM q),
c AS (SELECT l.*, domain, suffix, 1 AS corpus FROM l JOIN names ON l.name = names.name),
{_level("g", "corpus", "", "")},
{_level("x", "suffix", "g", "corpus")},
{_level("d", "domain", "x", "suffix")},
{_level("h", "name", "d", "domain")},
best AS (SELECT names.name, coalesce(h_p.rate, d_p.rate, x_p.rate, g_p.rate, 0.5) AS rate, coalesce(h_p.weight, d_p.weight, x_p.weight, g_p.weight, 2) AS weight
         FROM names LEFT JOIN h_p ON h_p.k = names.name LEFT JOIN d_p ON d_p.k = names.domain LEFT JOIN x_p ON x_p.k = names.suffix LEFT JOIN g_p ON g_p.k = 1),
bar AS (SELECT round(2 * m / (1 - m + 2 * m), 6) AS bar FROM (SELECT coalesce(max(rate), 0.5) AS m FROM g_p)),
bound AS (SELECT name, round(rate - 1.645 * sqrt(rate * (1 - rate) / (weight + 1)), 6) AS low FROM best),
r(rule, says) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
fit AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(says, length(rule)) AS says FROM p, r
        WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))
        GROUP BY page_id)
SELECT p.page_id, p.host, p.path, fit.rule, coalesce(says, CASE WHEN low > bar THEN 'block' ELSE 'allow' END) AS verdict
FROM p CROSS JOIN bar LEFT JOIN fit ON p.page_id = fit.page_id LEFT JOIN bound ON p.name = bound.name
"""

ORACLES |= {"op4_chat_formatting": CHAT, "op9_url_reputation": URLS}


def _fences() -> tuple[str, str]:
    """The fence columns of ``f`` and the condition under which ``r`` lies inside them."""
    columns, inside = [], []
    for r, top, of, incident, sides in (("wl", "word_chars", "n_words", 1, "low high"), ("sr", "n_symbols", "n_words", 4, "high"), ("dr", "n_dup_lines", "n_lines", 1, "high"), ("rr", "n_repeat_words", "n_words", 8, "high")):
        for side in sides.split():
            sign, cmp = ("+", "<= 0.75") if side == "high" else ("-", ">= -0.75")
            columns.append(f"{r}_mid {sign} (6 * least(abs({r}_{side} - {r}_mid), 2 * greatest(abs(w_{r}_{side} - w_{r}_mid), {r}_mid)) + {incident}.0::DOUBLE / nullif({of}_mid, 0)) AS {r}_{side}_f")
            root = "sqrt(greatest({}, 0) / " + f"{incident}.0::DOUBLE + 0.375)"
            inside.append(f"coalesce({root.format(f'{top}::DOUBLE')} - {root.format(f'{of} * {r}_{side}_f')} {cmp}, true)")
    return ", ".join(columns), " AND ".join(inside)


_MEASURES = ("wl", "sr", "dr", "rr", "n_words", "n_lines")
_NAMES = [f"{m}_{q}" for m in _MEASURES for q in ("low", "mid", "high")]
_FENCE, _INSIDE = _fences()


def _quantiles(name: str, by: str) -> str:
    """CTEs of the quantiles of one level: merged buckets, ranks and one row a group."""
    wide = ", ".join(f"max(CASE WHEN measure = '{m}' THEN {q} END) AS {m}_{q}" for m in _MEASURES for q in ("low", "mid", "high"))
    at = ", ".join(f"min(CASE WHEN upto >= {q} * n THEN v END) AS {c}" for c, q in (("low", "(1 - 0.7::DOUBLE)"), ("mid", "0.5::DOUBLE"), ("high", "0.7::DOUBLE")))
    return f"""{name}_m AS (SELECT {by}, measure, bucket, sum(k) AS k FROM sketch GROUP BY ALL),
{name}_r AS (SELECT *, sum(k) OVER (PARTITION BY {by}, measure ORDER BY bucket) AS upto, sum(k) OVER (PARTITION BY {by}, measure) AS n, CASE WHEN bucket = -1000000 THEN 0 ELSE pow(1.002::DOUBLE, bucket + 0.5::DOUBLE) END AS v FROM {name}_m),
{name}_q AS (SELECT {by}, measure, max(n) AS n, {at} FROM {name}_r GROUP BY ALL),
{name} AS (SELECT {by}, max(CASE WHEN measure = 'n_words' THEN n END) AS n, {wide} FROM {name}_q GROUP BY {by})"""


QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, {_words(SPACED_WORDS, False)} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 6)) AS i)),
gr AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM gr, LATERAL (SELECT unnest(range(i, i + 8)) AS p) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY doc_id),
r AS (SELECT d.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(ln.dup, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(ln.n, 0) AS n_lines FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM r),
v AS (SELECT lang, source, unnest([{{'m': 'wl', 'v': word_chars / nullif(n_words, 0)}}, {{'m': 'sr', 'v': n_symbols / nullif(n_words, 0)}}, {{'m': 'dr', 'v': n_dup_lines / nullif(n_lines, 0)}},
        {{'m': 'rr', 'v': n_repeat_words / nullif(n_words, 0)}}, {{'m': 'n_words', 'v': n_words::DOUBLE}}, {{'m': 'n_lines', 'v': n_lines::DOUBLE}}]) AS x FROM b WHERE NOT base_failed),
sketch AS (SELECT lang, source, x.m AS measure, CASE WHEN x.v = 0 THEN -1000000 ELSE CAST(floor(ln(x.v) / ln(1.002::DOUBLE)) AS INTEGER) END AS bucket, count(*) AS k, 1 AS corpus FROM v WHERE x.v IS NOT NULL GROUP BY ALL),
{_quantiles("gq", "lang, source")},
{_quantiles("lq", "lang")},
{_quantiles("cq", "corpus")},
w AS (SELECT gq.lang, gq.source, gq.n, {", ".join(f"CASE WHEN lq.n >= 100 THEN lq.{c} ELSE cq.{c} END AS w_{c}" for c in _NAMES)}, {", ".join(f"gq.{c} AS o_{c}" for c in _NAMES)} FROM gq JOIN lq ON gq.lang = lq.lang CROSS JOIN cq),
p AS (SELECT *, {", ".join(f"CASE WHEN n >= 100 THEN o_{c} ELSE w_{c} END AS {c}" for c in _NAMES)} FROM w),
f AS (SELECT lang, source, {_FENCE} FROM p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_INSIDE} AS kept
FROM b LEFT JOIN f ON f.lang = b.lang AND f.source = b.source
"""

ORACLES |= {"op1_quality_rules": QUALITY}


def _crc_steps() -> str:
    """The 256 remainders of CRC-32 by its polynomial, as a list for SQL."""
    values = list(range(256))
    for _ in range(8):
        values = [v >> 1 ^ (0xEDB88320 if v & 1 else 0) for v in values]
    return f"[{', '.join(f'{v}::BIGINT' for v in values)}]"


# Runs have code points up to U+00FF, so a letter is one byte or two in UTF-8.
_BYTES = "flatten(list_transform(string_split(key, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + unicode(c) // 64)::BIGINT, (128 + unicode(c) % 64)::BIGINT] END))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda h, b: xor(h >> 8, steps[(xor(h, b) & 255) + 1])), 4294967295::BIGINT)"

VARIANTS = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
lowered AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || {LOWER_AZ.format("run")} AS key, {LOWER_AZ.format("run")} AS run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (SELECT run, k, {_CRC} AS h FROM lowered CROSS JOIN (SELECT {_crc_steps()} AS steps)),
altered AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM altered WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS MATERIALIZED (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM v, LATERAL (SELECT unnest(range(0, length(word))) AS i)),
inserted AS (SELECT cut.word AS longer, v.word AS shorter FROM cut JOIN v ON cut.rest = v.word),
pairs AS (SELECT longer AS word, shorter AS near FROM inserted UNION SELECT shorter, longer FROM inserted
          UNION SELECT a.word, b.word FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
ranked AS (SELECT pairs.word, near, v.n, row_number() OVER (PARTITION BY pairs.word ORDER BY v.n DESC, near) AS r, count(*) OVER (PARTITION BY pairs.word) AS n_near FROM pairs JOIN v ON v.word = near),
formed AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN ranked.n >= 5 * v.n THEN near END AS form, CASE WHEN ranked.n >= 5 * v.n THEN ranked.n END AS form_n
           FROM v LEFT JOIN ranked ON ranked.word = v.word AND r = 1),
chain AS (SELECT word, word AS root FROM formed UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NOT NULL),
ends AS (SELECT chain.word, root FROM chain JOIN formed ON formed.word = chain.root WHERE formed.form IS NULL)
SELECT formed.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM formed JOIN ends ON ends.word = formed.word
"""

ORACLES |= {"op12_spelling_variants": VARIANTS}
