"""DuckDB SQL twins of the queries that SQL can express (``documents`` is a registered view)."""

from __future__ import annotations

from regionpulse.llm.backoff_lm import BackoffModel
from regionpulse.llm.host_rules import HOST_LIMITS
from regionpulse.llm.interleave import SEED
from regionpulse.llm.license_scan import TEMPLATES
from regionpulse.llm.mixing import BLOCK_ROUNDS, Mixture
from regionpulse.llm.pii_sanitize import Disclosure

_D = "d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents)"
_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: crc32: the table of the reflected polynomial, and the running value over bytes
_CRC_TABLE = """crc_step AS (SELECT range AS n, range::UBIGINT AS c, 0 AS k FROM range(256)
  UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM crc_step WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS tbl FROM crc_step WHERE k = 8)"""


def _crc(text: str) -> str:
    start = "4294967295::UBIGINT"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::UBIGINT)"
    return f"xor(list_reduce(list_prepend({start}, {data}), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255)::BIGINT + 1])), {start})::BIGINT"


def _key(*parts: str) -> str:
    text = " || '|' || ".join(parts)
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def _rates() -> str:
    fails = {"few_words": "n_words < 20", "repeats": "100 * n_repeat_words > 30 * n_words", "symbols": "10 * n_symbols > word_chars", "dup_lines": "10 * n_dup_lines > n_words"}
    per = ", ".join(f"sum(({c})::INT)::DOUBLE AS f_{r}" for r, c in fails.items())
    prior = ", ".join(f"avg(f_{r} / n) AS m_{r}, var_pop(f_{r} / n) AS v_{r}" for r in fails)
    rate = {r: f"CASE WHEN v_{r} <= 1e-12 THEN m_{r} ELSE (f_{r} + greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 0) * m_{r}) / (n + greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 0)) END" for r in fails}
    bad = " OR ".join(f"({rate[r]}) > {HOST_LIMITS[r]}" for r in fails)
    return f"""hosts AS (SELECT source, count(*) AS n, {per} FROM m GROUP BY source),
prior AS (SELECT {prior} FROM hosts),
verdict AS (SELECT source, {bad} AS host_failed FROM hosts, prior)"""


OP2 = rf"""
WITH {_D},
w AS (SELECT *, {_WORDS} AS ws FROM d),
win AS (SELECT rid, i, list_slice(ws, i, i + 7) AS x FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
dup AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS c FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT l) AS c FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.c, 0)::BIGINT AS n_dup_lines,
             coalesce(covered.c, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)),
{_rates()}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, NOT base_failed AND NOT host_failed AS kept
FROM (SELECT m.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, v.host_failed
      FROM m JOIN verdict v ON m.source IS NOT DISTINCT FROM v.source)
"""

OP4 = f"""
WITH RECURSIVE {_CRC_TABLE},
{_D},
c AS (SELECT doc_id, coalesce('s' || source, 'n') AS sk, octet_length(encode(t)) + 1 AS size, {_crc('t')} AS text_crc32 FROM d, crc_table),
k AS (SELECT *, {_key(f"'{SEED}'", "coalesce(doc_id::VARCHAR, '')", "text_crc32::VARCHAR")} AS key FROM c),
f AS (SELECT *, (2 * row_number() OVER (PARTITION BY sk ORDER BY key, doc_id, text_crc32, size) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY sk)) AS f FROM k),
p AS (SELECT *, row_number() OVER (ORDER BY f, sk, key, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS total FROM f),
s AS (SELECT *, (place * 8) // total AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, shard::INT AS shard, (place - (shard * total + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard FROM s
"""

_TEMPLATES = ", ".join(f"({k}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for k, (name, text) in enumerate(TEMPLATES))
_GRAMS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"

OP5 = rf"""
WITH {_D},
tpl AS (SELECT k, name, {_GRAMS} AS g FROM (SELECT k, name, regexp_extract_all(lower(x), '[a-z0-9]+') AS w FROM (VALUES {_TEMPLATES}) v(k, name, x))),
n AS (SELECT rid, regexp_replace(lower(t), '[^a-z0-9\n]+', ' ', 'g') AS c FROM d),
u AS (SELECT rid, pos, unnest(ls) AS x FROM (SELECT rid, ls, unnest(range(1)) AS pos FROM (SELECT rid, string_split(c, chr(10)) AS ls FROM n))
      UNION ALL SELECT rid, 1, replace(c, chr(10), ' ') FROM n WHERE contains(c, chr(10))),
b AS (SELECT row_number() OVER () AS uid, rid, {_GRAMS} AS g FROM (SELECT rid, regexp_extract_all(x, '[a-z0-9]+') AS w FROM u)),
hit AS (SELECT uid, rid, k, name, 2.0 * len(list_intersect(b.g, tpl.g)) / (len(b.g) + len(tpl.g)) AS dice FROM b, tpl WHERE len(b.g) > 0),
best AS (SELECT * FROM hit WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY uid ORDER BY dice DESC, k) = 1),
per AS (SELECT rid, array_to_string(list_sort(list_distinct(list(name))), ',') AS licenses, count(*) AS n_matches,
               first(name ORDER BY dice DESC, k) AS best_license, max(dice) AS best_dice FROM best GROUP BY rid)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n_matches, 0)::BIGINT AS n_matches, best_license, round(coalesce(best_dice, 0.0)::DOUBLE, 6) AS best_dice
FROM d LEFT JOIN per USING (rid)
"""

_RULE = Disclosure()
#: the contract's patterns as they stand
_PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _located(rows: str, text: str, pattern: str) -> str:
    """Rows of ``rows`` with the start, end and value of each match in ``text``."""
    return f"""(SELECT * EXCLUDE (gap), sum(length(gap) + length(v)) OVER o - length(v) AS st, sum(length(gap) + length(v)) OVER o AS en
  FROM (SELECT *, unnest(regexp_extract_all({text}, '{pattern}')) AS v, unnest(string_split_regex({text}, '{pattern}')) AS gap,
               unnest(range(len(string_split_regex({text}, '{pattern}')))) AS i FROM {rows}) q
  WINDOW o AS (PARTITION BY uid ORDER BY i ROWS UNBOUNDED PRECEDING) QUALIFY v IS NOT NULL)"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {_DIGITS}[-i]::INT WHEN {_DIGITS}[-i]::INT > 4 THEN 2 * {_DIGITS}[-i]::INT - 9 ELSE 2 * {_DIGITS}[-i]::INT END)) % 10 = 0"
_VALID = {"email": "TRUE", "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR ('0' || left(ltrim(x, '0'), 3))::INT > 255)) = 0",
          "card": f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN} ELSE FALSE END", "phone": f"length({_DIGITS}) BETWEEN 9 AND 15"}
_ENTITY = {"email": "lower(v)", "ip": "v", "card": _DIGITS, "phone": _DIGITS}
_SPANS = "\n  UNION ALL ".join(
    f"SELECT rid, doc_id, t, {no} AS kind_no, '{kind}' AS kind, st, en, '{kind}:' || {_ENTITY[kind]} AS entity FROM {_located('(SELECT *, rid AS uid FROM d)', 't', pattern)} WHERE {_VALID[kind]}"
    for no, (kind, pattern) in enumerate(_PII))

OP6 = rf"""
WITH {_D},
sp AS ({_SPANS}),
around AS (SELECT row_number() OVER () AS uid, rid, doc_id, entity, st AS s0, en AS e0,
  substring(t, greatest(st - {_RULE.reach}, 0)::BIGINT + 1, least(st, {_RULE.reach})::BIGINT) AS b0, substring(t, en::BIGINT + 1, {_RULE.reach} + 1) AS a0 FROM sp),
ctx AS (SELECT uid, rid, doc_id, entity, s0, e0,
  string_split(CASE WHEN s0 > {_RULE.reach} THEN regexp_replace(b0, '^[^ 	-
]+', '') ELSE b0 END, chr(10))[-1] AS b,
  string_split(CASE WHEN length(a0) > {_RULE.reach} THEN regexp_replace(a0, '[^ 	-
]+$', '') ELSE a0 END, chr(10))[1] AS a FROM around),
near0 AS (SELECT rid, doc_id, entity, a, b, lower(v) AS term, s0 - length(b) + st AS st, s0 - length(b) + en AS en FROM {_located('ctx', 'b', r'[\p{L}\p{N}]{3,}')}
  UNION ALL SELECT rid, doc_id, entity, a, b, lower(v), e0 + st, e0 + en FROM {_located('ctx', 'a', r'[\p{L}\p{N}]{3,}')}),
near AS (SELECT * FROM near0 x WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.rid = x.rid AND sp.st < x.en AND x.st < sp.en)),
wanted AS (SELECT entity, term FROM near GROUP BY ALL HAVING count(DISTINCT b || chr(10) || a) >= {_RULE.support}),
n_te AS (SELECT entity, term, count(DISTINCT doc_id) AS n_te FROM near JOIN wanted USING (entity, term) GROUP BY ALL),
n_e AS (SELECT entity, count(DISTINCT doc_id) AS n_e FROM near GROUP BY ALL),
n_t AS (SELECT term, count(*) AS n_t FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(t), '[\p{{L}}\p{{N}}]{{3,}}'))) AS term FROM d)
        WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM d),
told AS (SELECT entity, term FROM n_te JOIN n_e USING (entity) JOIN n_t USING (term), n
         WHERE n > n_e AND ln(n * n_te / (greatest(n_t, n_te) * n_e)) / ln(n / n_e) >= {_RULE.disclosure}),
extra AS (SELECT DISTINCT rid, {len(_PII)} AS kind_no, 'term' AS kind, st, en FROM near JOIN told USING (entity, term)),
every AS (SELECT rid, kind_no, kind, st, en FROM sp UNION ALL SELECT * FROM extra),
per AS (SELECT rid, {', '.join(f"sum((kind_no = {no})::INT) AS n_{kind}" for no, (kind, _) in enumerate(_PII))},
  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, kind_no) FILTER (kind <> 'term') AS base,
  string_agg(kind || ':' || st || ':' || en, ',' ORDER BY st, kind_no, en) AS spans FROM every GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind, _ in _PII)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)
"""

_MODEL = BackoffModel()

OP7 = f"""
WITH RECURSIVE {_CRC_TABLE},
{_D},
h AS (SELECT rid, doc_id, t, {_crc("coalesce(doc_id::VARCHAR, '')")} % 10 = 0 AS held_out FROM d, crc_table),
tok AS (SELECT rid, doc_id, held_out, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w
        FROM (SELECT rid, doc_id, held_out, list_append(list_transform(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), lambda x: 'w' || x), '') AS w FROM h)),
pre AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY rid ORDER BY i), 's') AS h FROM tok),
one AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
two AS (SELECT h, w, count(*) AS c FROM pre WHERE NOT held_out GROUP BY h, w),
n AS (SELECT coalesce(sum(c), 0)::DOUBLE AS n, count(*)::DOUBLE AS v FROM one),
ctx AS (SELECT w AS h, c FROM one UNION ALL SELECT 's', c FROM one WHERE w = ''),
x AS (SELECT p.*, coalesce(o.c, 0) AS c1, coalesce(b.c, 0) AS c2, coalesce(k.c, 0) AS ch, n.n AS total,
             (coalesce(o.c, 0) + {_MODEL.add}) / (n.n + {_MODEL.add} * (n.v + 1)) AS p1
      FROM pre p CROSS JOIN n LEFT JOIN one o ON p.w = o.w LEFT JOIN two b ON p.h = b.h AND p.w = b.w LEFT JOIN ctx k ON p.h = k.h)
SELECT any_value(doc_id) AS doc_id, any_value(held_out) AS held_out, count(*)::BIGINT AS n_tokens, sum((c1 > 0)::INT)::BIGINT AS n_known,
       any_value(total)::BIGINT AS train_tokens, sum(log10(p1)) AS base_score, sum(log10((c2 + {_MODEL.mu} * p1) / (ch + {_MODEL.mu}))) AS score
FROM x GROUP BY rid
"""

_MIX = Mixture()


def _uniform(*parts: str) -> str:
    return f"({_key(chr(39) + 'uniform' + chr(39), *parts)} / {float(1 << 60)!r})"


OP8 = rf"""
WITH RECURSIVE {_CRC_TABLE},
{_D},
r AS (SELECT rid, doc_id, source, coalesce('s' || source, 'n') AS sk, len({_WORDS})::BIGINT AS size,
             {_key(f"'{_MIX.seed}'", "coalesce(doc_id::VARCHAR, '')", _crc('t') + '::VARCHAR')} AS key FROM d, crc_table),
s0 AS (SELECT source, sk, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM r GROUP BY source, sk),
s1 AS (SELECT *, ([{', '.join(f'{float(w)}::DOUBLE' for w in _MIX.weights)}])[i % {len(_MIX.weights)} + 1] AS weight FROM s0),
s2 AS (SELECT *, {_MIX.most_repeats} * ss / weight AS ratio FROM s1),
s3 AS (SELECT *, (sum(ss) OVER () - (sum({_MIX.most_repeats} * ss) OVER o - {_MIX.most_repeats} * ss))::DOUBLE
                 / sum(weight) OVER (ORDER BY ratio, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
       FROM s2 WINDOW o AS (ORDER BY ratio, i ROWS UNBOUNDED PRECEDING)),
s4 AS (SELECT *, least({_MIX.most_repeats} * ss, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), max(ratio) OVER ()) * weight)::DOUBLE AS target,
              CAST(ceil(ss / {float(_MIX.block_words)}) AS BIGINT) AS nb FROM s3),
s5 AS (SELECT *, round(sum(CASE WHEN ss > 0 THEN target * nb / ss ELSE 0.0 END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS e FROM s4),
s6 AS (SELECT *, CAST(floor(e) AS BIGINT) + CASE WHEN {_uniform(f"'{_MIX.seed}'", "CAST(floor(e) AS BIGINT)::VARCHAR")} < e - floor(e) THEN 1 ELSE 0 END AS e1 FROM s5),
s7 AS (SELECT *, coalesce(lag(e1) OVER (ORDER BY i), 0) AS b1 FROM s6),
src AS (SELECT *, least(e1 - b1, {_MIX.most_repeats} * nb) AS n_slots FROM s7),
j AS (SELECT sk, nb, unnest(range(n_slots)) AS j FROM src WHERE n_slots > 0),
j1 AS (SELECT sk, nb, j - (j // nb) * nb AS x, sk || '|' || (j // nb)::VARCHAR AS salt FROM j),
ks AS (SELECT salt, nb, list_transform(range(1, {BLOCK_ROUNDS} + 1), lambda k: {_key(f"'{_MIX.seed}'", "salt", "k::VARCHAR")} % nb) AS ks FROM (SELECT DISTINCT salt, nb FROM j1)),
swap AS (SELECT sk, salt, nb, ks, x, 1 AS k FROM j1 JOIN ks USING (salt, nb)
  UNION ALL SELECT sk, salt, nb, ks, CASE WHEN substr(md5(salt || '|' || ks[k]::VARCHAR || '|' || greatest(x, y)::VARCHAR), 1, 1) < '8' THEN y ELSE x END, k + 1
  FROM (SELECT *, ((ks[k] - x) % nb + nb) % nb AS y FROM swap WHERE k <= {BLOCK_ROUNDS})),
used AS (SELECT sk, x AS block, count(*) AS times FROM swap WHERE k = {BLOCK_ROUNDS} + 1 GROUP BY ALL),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY sk ORDER BY key, doc_id, size, rid ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS st FROM r),
pieces AS (SELECT rid, sk, st, size, unnest(range(st // {_MIX.block_words}, (st + size - 1) // {_MIX.block_words} + 1)) AS block FROM placed WHERE size > 0),
got AS (SELECT rid, sum((least(st + size, (block + 1) * {_MIX.block_words}) - greatest(st, block * {_MIX.block_words})) * times)::BIGINT AS taken FROM pieces JOIN used USING (sk, block) GROUP BY rid)
SELECT doc_id, r.size, src.ss AS source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM r JOIN src USING (sk) LEFT JOIN got USING (rid)
"""

OP9 = rf"""
WITH RECURSIVE {_D},
w AS (SELECT rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM d),
s AS (SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
n AS (SELECT rid, doc_id, len(g)::BIGINT AS n FROM s),
e AS (SELECT rid, doc_id, unnest(g) AS g FROM s),
common AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL),
link AS (SELECT nx.doc_id AS x, ny.doc_id AS y FROM common JOIN n nx ON nx.rid = x JOIN n ny ON ny.rid = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
least_id AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept FROM n LEFT JOIN least_id ON doc_id = x
"""

_TERMS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = rf"""
WITH {_D},
tok AS (SELECT rid, unnest({_TERMS.format(_LOWER)}) AS w FROM d),
tf AS (SELECT rid, w, count(*) AS tf FROM tok GROUP BY ALL),
n AS (SELECT rid, sum(tf)::BIGINT AS n FROM tf GROUP BY rid),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
weight AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, total GROUP BY w, docs),
item AS (SELECT row_number() OVER () AS iid, item_id, coalesce(text, '') AS t FROM benchmark),
asked AS (SELECT iid, w, count(*) AS times FROM (SELECT iid, unnest({_TERMS.format(_LOWER)}) AS w FROM item) GROUP BY ALL),
scored AS (SELECT iid, rid, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // terms))))::BIGINT AS score
           FROM asked JOIN tf USING (w) JOIN weight USING (w) JOIN n USING (rid), total GROUP BY ALL HAVING score > 0),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scored JOIN d USING (rid) JOIN item USING (iid))
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

OP13 = rf"""
WITH RECURSIVE {_CRC_TABLE},
{_D},
run AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM d) GROUP BY ALL),
hashed AS (SELECT run, k, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM run, crc_table WHERE length(run) >= 6),
v AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN substring(run, 1, (h % length(run))::BIGINT) || substring(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM hashed)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
hole AS (SELECT word, n, i, substring(word, 1, i) AS head, substring(word, i + 2) AS tail FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
pair AS (SELECT a.word AS word, a.n AS n, b.word AS other, b.n AS other_n FROM hole a JOIN hole b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
  UNION ALL SELECT x.word, x.n, v.word, v.n FROM (SELECT DISTINCT word, n, head || tail AS less FROM hole) x JOIN v ON v.word = x.less
  UNION ALL SELECT v.word, v.n, x.word, x.n FROM (SELECT DISTINCT word, n, head || tail AS less FROM hole) x JOIN v ON v.word = x.less),
near AS (SELECT word, n, count(*) AS n_near, max(other_n) AS most, arg_min(other, struct_pack(a := -other_n, b := encode(other))) AS other FROM pair GROUP BY word, n),
form AS (SELECT word, other AS form, most AS form_n FROM near WHERE most >= 5 * n),
chain AS (SELECT word, form AS root, 1 AS step FROM form UNION ALL SELECT chain.word, form.form, step + 1 FROM chain JOIN form ON chain.root = form.word),
root AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT v.word, form.form, coalesce(root.root, v.word) AS root, v.n, coalesce(near.n_near, 0)::BIGINT AS n_near, form.form_n::BIGINT AS form_n
FROM v LEFT JOIN near ON v.word = near.word LEFT JOIN form ON v.word = form.word LEFT JOIN root ON v.word = root.word
"""

SQL: dict[str, str] = {
    "op2_host_quality": OP2, "op4_stratified_interleave": OP4, "op5_license_scan": OP5,
    "op6_pii_sanitize": OP6, "op7_backoff_scores": OP7,
    "op8_mix_sources": OP8, "op9_tensor_minhash": OP9,
    "op12_ball_tree_search": OP12, "op13_frequency_trie": OP13,
}
