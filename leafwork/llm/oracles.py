"""SQL for those queries that SQL can express."""

from __future__ import annotations

import re

from .common import LOWER, UPPER
from .lexical_search import TERM
from .line_dedup import BLOCKS, ENTITIES
from .secret_scan import BASE, RULES

LOW = "translate({}, '" + UPPER + "', '" + LOWER + "')"
WORD = r"[^\x20\x09-\x0D]+"

QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(t, '{WORD}') AS l FROM d) x),
five AS (SELECT doc_id, pos, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) END AS f FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT doc_id, pos, CASE WHEN f IS NOT NULL AND count(f) OVER (PARTITION BY doc_id, f) > 1 THEN 1 ELSE 0 END AS r FROM five),
covered AS (SELECT doc_id, max(r) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS c FROM twice),
counts AS (SELECT doc_id, count(*) AS n_words, CAST(sum(c) AS BIGINT) AS n_repeat_words FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
words AS (SELECT doc_id, host, t, line, trim({LOW.format("regexp_replace(line, '[\\x20\\x09-\\x0D]+', ' ', 'g')")}) AS norm FROM lines),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM words WHERE norm <> '' GROUP BY doc_id),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
over_ AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS found FROM words WHERE norm <> '' GROUP BY host, norm) f JOIN hosts USING (host) WHERE found >= 10 AND found > docs * 0.02),
gone AS (SELECT doc_id, CAST(sum(len(string_split(norm, ' '))) AS BIGINT) AS n FROM words JOIN over_ USING (host, norm) GROUP BY doc_id),
b AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_removed_words
 FROM d LEFT JOIN counts ON counts.doc_id = d.doc_id LEFT JOIN dups ON dups.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < 10 OR n_words - n_removed_words < 0.3 * n_words)) AS kept FROM f"""


def _line_dedup() -> str:
    text = r"regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '(?i)</?(?:{'|'.join(BLOCKS)})(?:[\s/][^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    for name, char in ENTITIES:
        text = f"replace({text}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    text = rf"regexp_replace(regexp_replace({text}, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ?\n[\n ]*', chr(10), 'g')"
    return rf"""WITH p AS (SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host, list_filter(string_split(trim({text}), chr(10)), lambda x: x <> '') AS ls FROM pages),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host), f AS (SELECT host, line, count(*) AS found FROM (SELECT host, unnest(list_distinct(ls)) AS line FROM p) x GROUP BY host, line),
o AS (SELECT host, list(line) AS drops FROM f JOIN h USING (host) WHERE found >= 3 AND found > pages * 0.3 GROUP BY host),
k AS (SELECT p.page_id, p.host, ls, CASE WHEN drops IS NULL THEN ls ELSE list_filter(ls, lambda x: NOT list_contains(drops, x)) END AS kept FROM p LEFT JOIN o ON o.host = p.host)
SELECT page_id, host, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k"""


EXACT = f"""WITH d AS (SELECT doc_id, {LOW.format("coalesce(text, '')")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d"""


def _field(name: str) -> str:
    return f"CASE WHEN {name} IS NULL THEN '-' ELSE concat(octet_length(encode(CAST({name} AS VARCHAR))), ':', CAST({name} AS VARCHAR)) END"


def _levels(name: str, leaves: str) -> str:
    """A recursive table of the levels above ``leaves`` (tree, i, n, h), and one of what stands before and after each node in its run."""
    return f"""{name} AS (SELECT tree, 0 AS level, i, n, h FROM {leaves} UNION ALL SELECT tree, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM {name} WHERE n > 1 GROUP BY tree, level, n, i // 8),
{name}_steps AS (SELECT a.tree, a.level, a.i, concat(coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), ''), '|', coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '')) AS step
 FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.i // 8 = b.i // 8 WHERE a.n > 1 GROUP BY a.tree, a.level, a.i)"""


MERKLE = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, concat({_field("doc_id")}, {_field("source")}, {_field("lang")}, {_field("n_chars")}) AS head, text, CAST(doc_id AS VARCHAR) AS s FROM documents),
k AS (SELECT doc_id, tree, sha256(concat(head, {_field("text")})) AS h, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(text)), ':', {LOW.format("text")}) END)) AS low,
 xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(s) + 1), lambda j: ascii(s[j]))), lambda c, b: xor(c >> 8, crc.t[1 + (xor(c, b) & 255)]))) % 3 = 0 AS tampered FROM d, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM k),
{_levels("low", "leaves")},
tops AS (SELECT '' AS tree, tree AS of_, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n, h FROM low WHERE n = 1),
{_levels("high", "tops")},
path AS (SELECT l.tree, l.i, list(s.step ORDER BY s.level) AS steps FROM leaves l JOIN low_steps s ON s.tree = l.tree AND s.i = l.i // CAST(pow(8, s.level) AS BIGINT) GROUP BY l.tree, l.i),
above AS (SELECT t.of_ AS tree, any_value(t.h) AS subroot, list(s.step ORDER BY s.level) FILTER (s.step IS NOT NULL) AS steps FROM tops t LEFT JOIN high_steps s ON s.i = t.i // CAST(pow(8, s.level) AS BIGINT) GROUP BY t.of_),
f AS (SELECT doc_id, l.h AS leaf, subroot, (SELECT h FROM high WHERE n = 1) AS root, coalesce(CASE WHEN tampered THEN low END, l.h) AS start, list_concat(coalesce(path.steps, []), coalesce(above.steps, [])) AS steps
 FROM leaves l JOIN above ON above.tree = l.tree LEFT JOIN path ON path.tree = l.tree AND path.i = l.i),
g AS (SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '|', '')) AS proof_sha256, list_reduce(list_concat([start], steps), lambda x, s: sha256(concat(split_part(s, '|', 1), x, split_part(s, '|', 2)))) AS folded_root FROM f)
SELECT *, folded_root = root AS verified FROM g"""


def _secrets() -> str:
    """Texts are cut at the matches of each kind; letters that match in either case are spelled out, as the SQL engine folds more than A-Z."""
    parts = []
    for place, r in enumerate(RULES):
        pattern = re.sub(r"\(\?i:((?:[^()]|\([^()]*\))*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", r.pattern).replace("'", "''")
        parts.append(f"SELECT r, {place} AS place, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_split_to_array(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', {r.group}) AS judged FROM d")
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    span = "concat(kind, ':', a, ':', a + size)"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(parts)}),
x AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
s AS (SELECT r, place, kind, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(m[1:i-1], lambda g: length(g))), 0) AS BIGINT) AS a, length(m[i]) AS size FROM x WHERE length(judged[i]) >= least),
c AS (SELECT r, {counts}, string_agg({span}, ',' ORDER BY a, place) FILTER (kind IN ({base})) AS b, string_agg({span}, ',' ORDER BY a, place) AS spans FROM s GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN c ON c.r = d.r"""


SEARCH = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '{TERM}') AS l FROM documents),
a AS (SELECT count(*) AS docs, CAST(sum(len(l)) AS BIGINT) AS total FROM d WHERE len(l) > 0),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(l) AS n, unnest(l) AS term FROM d) x GROUP BY r, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term) x, a),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({LOW.format("coalesce(text, '')")}, '{TERM}')) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // total)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term), a GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": QUALITY, "op3_line_dedup": _line_dedup(), "op6_exact_dedup": EXACT, "op11_merkle_manifest": MERKLE, "op12_secret_scan": _secrets(), "op13_lexical_search": SEARCH}
