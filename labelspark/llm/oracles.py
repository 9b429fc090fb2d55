"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from labelspark.llm.templates import MIN_SHARE, NAME, NUM, PUNCT, UNIT, UNITS

#: Fixed value: the reflected polynomial of CRC-32.
CRC = "3988292384"


def crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, one bit at a time."""
    bits = (f"list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length({text}) + 1), "
            f"lambda k: [256 + ascii(substr({text}, CAST(k AS BIGINT), 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), "
            f"lambda a, b: CASE WHEN b >= 0 THEN xor(a, b - 256) WHEN a % 2 = 1 THEN xor(a // 2, {CRC}) ELSE a // 2 END)")
    return f"xor({bits}, 4294967295::BIGINT)"


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+')"

NEARDUP = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
same AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM same JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM edge UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.other = e.a),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, l.other), d.doc_id) AS component_id,
       coalesce(least(d.doc_id, l.other), d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least l USING (doc_id)"""

SUFFIX = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, greatest(length(h) // 2 - 399, 0))) AS i, h FROM d),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 800)) AS m FROM p),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM k) WHERE c > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM r),
q AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
span AS (SELECT doc_id, run, min(i) AS lo, max(i) + 400 AS hi FROM q GROUP BY doc_id, run),
cut AS (SELECT doc_id, sum(hi - lo) AS removed, count(*) AS spans, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE array_to_string(list_transform(range(1, spans + 2), lambda j:
           substr(h, 2 * (CASE WHEN j = 1 THEN 0 ELSE his[j - 1] END) + 1,
                  2 * ((CASE WHEN j > spans THEN length(h) // 2 ELSE los[j] END) - (CASE WHEN j = 1 THEN 0 ELSE his[j - 1] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)"""

LM = f"""WITH d AS (SELECT doc_id, {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 10 = 0 AS held, {WORDS} AS w FROM documents),
t AS (SELECT doc_id, held, unnest(list_concat(w, [chr(10)])) AS x, unnest(list_concat([chr(9)], w)) AS h FROM d),
one AS (SELECT x, count(*) AS c FROM t WHERE NOT held GROUP BY x),
two AS (SELECT h, x, count(*) AS c FROM t WHERE NOT held GROUP BY h, x),
his AS (SELECT h, count(*) AS c FROM t WHERE NOT held GROUP BY h),
tot AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM one),
u AS (SELECT t.doc_id, t.held, coalesce(one.c, 0) AS c, coalesce(two.c, 0) AS c2, coalesce(his.c, 0) AS ch, n,
             (coalesce(one.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)) AS p
      FROM t CROSS JOIN tot LEFT JOIN one ON t.x = one.x LEFT JOIN two ON t.h = two.h AND t.x = two.x LEFT JOIN his ON t.h = his.h)
SELECT doc_id, held AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, n AS train_tokens,
       round(sum(log10(p)), 6) AS base_score, round(sum(log10((c2 + 50.0::DOUBLE * p) / (ch + 50.0::DOUBLE))), 6) AS score
FROM u GROUP BY doc_id, held, n"""



def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SLOTS = ", ".join(map(_text, (NUM, UNIT, NAME)))
_LEADS = [f"lead({{0}}, {k}) OVER (PARTITION BY kind, id ORDER BY i)" for k in range(1, 5)]
_FIVE = {c: ", ".join([c, *(x.format(c) for x in _LEADS)]) for c in ("c", "raw")}
LEAKS = f"""WITH t AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
l AS (SELECT kind, id, list_filter(string_split_regex(replace(coalesce(text, ''), chr(10), ' ' || chr(10)), '[ \t\x0B\f\r]+'),
                                   lambda w: w <> '' AND w <> chr(10)) AS ws FROM t WHERE id IS NOT NULL),
w AS (SELECT kind, id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM l),
e AS (SELECT *, CASE WHEN trim(w, {_text(PUNCT)}) = '' THEN w ELSE trim(w, {_text(PUNCT)}) END AS core,
             lag(w) OVER (PARTITION BY kind, id ORDER BY i) AS before FROM w),
c AS (SELECT kind, id, i, lower(core) AS raw,
             CASE WHEN regexp_full_match(core, '[0-9]+([.,:/-][0-9]+)*') THEN '{NUM}'
                  WHEN lower(core) IN ({", ".join(map(_text, UNITS))}) THEN '{UNIT}'
                  WHEN length(core) > 1 AND core[1] <> lower(core[1]) AND core[1] || substr(lower(core), 2) = core
                       AND i > 1 AND NOT starts_with(w, chr(10)) AND right(before, 1) NOT IN ('.', '!', '?', ':') THEN '{NAME}'
                  ELSE lower(core) END AS c FROM e),
v AS (SELECT kind, id, i, concat_ws(chr(31), {_FIVE["c"]}) AS key, [{_FIVE["c"]}] AS cs, [{_FIVE["raw"]}] AS rs,
             count(*) OVER (PARTITION BY kind, id) AS n FROM c),
win AS (SELECT * FROM v WHERE i <= greatest(n - 4, 1)),
met AS (SELECT d.id AS d, b.id AS b, d.i - b.i AS s, d.key, b.cs, b.rs AS x, d.rs AS y
        FROM win d JOIN win b ON d.key = b.key AND d.kind = 0 AND b.kind = 1),
pairs AS (SELECT DISTINCT d, b, s, x[k] AS x, y[k] AS y FROM met, range(1, 6) r(k) WHERE cs[k] IN ({_SLOTS})),
bad AS (SELECT d, b, s FROM pairs GROUP BY d, b, s HAVING count(*) > count(DISTINCT x)),
good AS (SELECT d, b, count(DISTINCT key) AS m FROM met ANTI JOIN bad USING (d, b, s) GROUP BY d, b),
tot AS (SELECT id AS b, count(DISTINCT key) AS n FROM win WHERE kind = 1 GROUP BY id)
SELECT d AS doc_id, b AS item_id, n AS n_windows, m AS n_matched, m / n AS share FROM good JOIN tot USING (b) WHERE m / n >= {MIN_SHARE}::DOUBLE"""

def _crc_table() -> list[int]:
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (int(CRC) if c & 1 else 0)
        out.append(c)
    return out


def crc32_bytes(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, one byte at a time."""
    h = f"hex(encode({text}))"
    each = f"list_transform(range(1, length({h}) // 2 + 1), lambda k: CAST('0x' || substr({h}, CAST(2 * k - 1 AS BIGINT), 2) AS BIGINT))"
    steps = f"list_reduce(list_concat([4294967295::BIGINT], {each}), lambda c, b: xor(c // 256, {_crc_table()}[xor(c, b) % 256 + 1]))"
    return f"xor({steps}, 4294967295::BIGINT)"


VARIANTS = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS c FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, c, {crc32_bytes("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM g),
k AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h),
w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM k WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
d AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
      UNION SELECT d.word, w.word FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word FROM d JOIN w ON d.rest = w.word),
m AS (SELECT p.a AS word, p.b AS near, w.n AS near_n, count(*) OVER (PARTITION BY p.a) AS n_near,
             row_number() OVER (PARTITION BY p.a ORDER BY w.n DESC, p.b) AS r FROM p JOIN w ON w.word = p.b),
f AS (SELECT w.word, w.n, coalesce(m.n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
             CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n FROM w LEFT JOIN m ON m.word = w.word AND m.r = 1),
path AS (SELECT word, word AS root, form FROM f UNION ALL SELECT path.word, f.word, f.form FROM path JOIN f ON path.form = f.word)
SELECT f.word, f.form, path.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN path ON path.word = f.word AND path.form IS NULL"""

TOPK = """WITH e AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
f AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(greatest(least(floor(least(64 * CAST(x AS DOUBLE), 33554432)), 33554432), -33554432) AS BIGINT)) AS v FROM e),
v AS (SELECT vec_id, min(v) AS v FROM f GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

_TERMS = f"regexp_extract_all({LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
RANKED = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
n AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
tot AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
u AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * max(big_n) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM u CROSS JOIN tot GROUP BY t),
s AS (SELECT q.item_id, n.r, n.doc_id, CAST(sum(w.w * ((1000000000 * u.tf) // (1000 * u.tf + 20 * (100 - 50 + ((50 * n.n * big_n) // big_l))))) AS BIGINT) AS score
      FROM q JOIN u ON q.t = u.t JOIN w ON w.t = u.t JOIN n ON n.r = u.r CROSS JOIN tot GROUP BY q.item_id, n.r, n.doc_id),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 50"""

ORACLE = {"op1_template_decontamination": LEAKS, "op2_superminhash_neardup": NEARDUP, "op4_suffix_dedup": SUFFIX, "op9_backoff_lm": LM,
          "op11_partenum_variants": VARIANTS, "op12_maxscore_topk": TOPK, "op13_accumulator_ranking": RANKED}
