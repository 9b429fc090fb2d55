"""DuckDB spellings of our Spark expressions, for the oracle SQL."""

from __future__ import annotations

from ..functions.text import PY_WHITESPACE_CLASS


def strip(e: str) -> str:
    ws = PY_WHITESPACE_CLASS
    return f"regexp_replace({e}, '^{ws}+|{ws}+$', '', 'g')"


def ensure(e: str) -> str:
    return strip(f"replace(coalesce({e}, ''), '_', ' ')")


def md5_key(*parts: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def uniform(*parts: str) -> str:
    return f"(CAST(('0x' || substr({md5_key(*parts)}, 1, 13)) AS BIGINT) / 4503599627370496.0)"


def hash_int(n: str, *parts: str) -> str:
    return f"CAST(floor({uniform(*parts)} * ({n})) AS BIGINT)"


def num_key(*parts: str) -> str:
    return f"CAST(('0x' || substr({md5_key(*parts)}, 1, 15)) AS BIGINT)"


def onehot(vocab: str, target: str) -> str:
    return f"list_transform({vocab}, lambda v: CASE WHEN v = {target} THEN 1 ELSE 0 END)"


def sampled_negatives(seed: str) -> str:
    """CTEs picks -> negs -> lab -> ex of independent draws without replacement
    of up to four entries of voc(v, vi) with vn(n) for base(id, t, s)."""
    draws, taken = [], []
    for m in range(4):
        t = hash_int(f"n - k + {m + 1}", "id", seed, f"'s{m}'")
        hit = f"{t} IN ({', '.join(taken)})" if taken else "FALSE"
        draws.append(f"d{m} AS (SELECT *, CASE WHEN k > {m} THEN CASE WHEN {hit} THEN n - k + {m} ELSE {t} END END AS x{m} "
                     f"FROM {'k0' if m == 0 else f'd{m - 1}'})")
        taken.append(f"coalesce(x{m}, -1)")
    return f"""k0 AS (SELECT b.id, vn.n, least(1 + {hash_int('4', 'b.id', seed, "'n'")}, vn.n) AS k FROM base b, vn),
{", ".join(draws)},
picks AS (SELECT id, unnest([x0, x1, x2, x3]) AS vi, unnest([0, 1, 2, 3]) AS m FROM d3),
negs AS (SELECT p.id, list(voc.v ORDER BY p.m) AS negs FROM picks p JOIN voc ON p.vi = voc.vi
         GROUP BY p.id),
lab AS (SELECT b.id, b.t, b.s, list_concat([b.s], coalesce(n.negs, CAST([] AS VARCHAR[]))) AS labels
        FROM base b LEFT JOIN negs n ON b.id = n.id),
ex AS (SELECT id, t, s, unnest(labels) AS l, unnest(range(0, len(labels))) AS i FROM lab)"""
