"""DuckDB SQL of the operators' contracts, written from the contracts alone."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')"


OP1 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(SPACED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT e.b AS doc_id, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::bigint AS n_shingles, component_id, doc_id = component_id AS kept FROM w JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)"""

OP2 = f"""WITH bw AS (SELECT item_id, {_words(ALNUM)} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[k:k + 12], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM bw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {_words(ALNUM)} AS w FROM documents),
g AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, (SELECT DISTINCT n FROM win))),
m AS (SELECT doc_id, k, n, item_id FROM g JOIN win USING (s, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS c, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item_id::varchar AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(h, 0)::bigint AS n_hit, coalesce(c, 0)::bigint AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

OP5 = """WITH v AS (SELECT vec_id, embedding::double[] AS e, sqrt(list_reduce([x * x for x in embedding::double[]], lambda a, b: a + b)) AS n FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_reduce([q.e[i] * c.e[i] for i in range(1, len(q.e) + 1)], lambda a, b: a + b) / (q.n * c.n) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::int AS rank FROM s) WHERE rank <= 5"""

OP6 = r"""WITH RECURSIVE ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
fl AS (SELECT * FROM ln WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')), dl AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM fl)),
ch AS (SELECT id, line, unnest(range(1, greatest(length(line) - 6, 1) + 1)) AS i FROM dl),
s AS (SELECT DISTINCT id, CASE WHEN length(line) < 7 THEN line ELSE substr(line, i, 7) END AS sh FROM ch),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 75 * (x.n + y.n - c)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS c FROM dl UNION SELECT e.b AS id, r.c FROM r JOIN e ON e.a = r.id), m AS (SELECT id, min(c) AS comp FROM r GROUP BY id),
o AS (SELECT doc_id, no, row_number() OVER (PARTITION BY comp ORDER BY doc_id, no) AS nth FROM fl JOIN dl USING (line) JOIN m USING (id)),
k AS (SELECT doc_id, count(nth) AS n_lines, count(*) FILTER (nth = 1) AS n_kept, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (nth IS NULL OR nth = 1), '') AS text FROM ln LEFT JOIN o USING (doc_id, no) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::bigint AS n_lines, coalesce(n_kept, 0)::bigint AS n_kept, k.text FROM documents LEFT JOIN k USING (doc_id)"""


def _op11() -> str:
    """The repair as a fold over a conversation's letters. A state's best is its cost in seven digits and then its letters, ``~`` if it cannot be
    reached, so the least string is the best; ``+`` stands for an insertion that may be made."""
    plus = lambda e, cost, letter: f"CASE WHEN {e} = '~' THEN '~' ELSE lpad((substr({e}, 1, 7)::int + {cost})::varchar, 7, '0') || substr({e}, 8) || '{letter}' END"
    a = [f"a[{i}]" for i in range(1, 5)]
    stays = "(upper(x[1]) = x[1])::int"
    when = lambda condition, e: f"CASE WHEN {condition} THEN {e} ELSE '~' END"
    insert = f"[{a[0]}, {a[1]}, least({a[2]}, {', '.join(plus(a[i], 2, 'I') for i in (0, 1, 3))}), least({a[3]}, {plus(a[2], 2, 'I')})]"
    reroled = lambda i: when("x[1] <> 'x'", plus(a[i], f"2 + {stays}", "R"))
    kept = lambda i, role: when(f"lower(x[1]) = '{role}'", plus(a[i], stays, "K"))
    gone = [plus(e, 3, "D") for e in a]
    turn = f"[{gone[0]}, least({gone[1]}, {kept(0, 's')}), least({gone[2]}, {', '.join(f(i) for i in (0, 1, 3) for f in (reroled, lambda i: kept(i, 'u')))}), least({gone[3]}, {reroled(2)}, {kept(2, 'a')})]"
    crc = "list_reduce([4294967295] || flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(k, '')]), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    return f"""WITH given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor({crc}, 4294967295) % 20 AS kind FROM given),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) - 1 AS position, regexp_replace(text, '[ \t\n\x0B\f\r]+$', '') AS ending FROM damaged),
faulty AS (SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY position) || role[1] AS pair, CASE WHEN ending = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY position) > 1 THEN 'duplicate' WHEN ending[-1] NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
lettered AS (SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 'x' WHEN fault = 'truncated' THEN upper(initial) ELSE initial END AS letter FROM (SELECT *, CASE WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'o' END AS initial FROM faulty)),
folded AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
list_reduce([['0000000', '~', '~', '~']] || flatten([[['+'], ['+'], [l]] for l in list(letter ORDER BY position)]) || [['+'], ['+']], lambda a, x: CASE WHEN x[1] = '+' THEN {insert} ELSE {turn} END) AS ends FROM lettered GROUP BY conv_id),
answers AS (SELECT *, substr(least(ends[1], ends[4]), 1, 7)::bigint AS cost, substr(least(ends[1], ends[4]), 8) AS audit FROM folded),
edits AS (SELECT conv_id, place, audit[place] AS edit, length(replace(audit[:place], 'I', '')) - 1 AS position, length(replace(audit[:place], 'D', '')) AS nth, length(audit) - length(ltrim(audit, 'D')) AS skipped, audit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS place FROM answers)),
told AS (SELECT e.*, l.role AS was, l.text, max(e.place = e.skipped + 1 AND edit = 'K' AND l.initial = 's') OVER (PARTITION BY e.conv_id) AS system FROM edits e LEFT JOIN lettered l ON l.conv_id IS NOT DISTINCT FROM e.conv_id AND l.position = e.position AND e.edit <> 'I'),
lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN was WHEN (nth - system::int) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY place) AS body FROM told WHERE edit <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal, coalesce(cost, 0)::bigint AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN answers a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""


OP11 = _op11()
