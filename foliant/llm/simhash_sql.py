"""The near-duplicate query as SQL: XXH64 in 128-bit arithmetic, fingerprints bit by bit, all pairs, components by reach.

XXH64 is written from its public specification. It is meant for small tables.
"""

from __future__ import annotations

# The primes of XXH64, and the seed of the shingles.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
SEED = 42
M = 1 << 64


def _n(x) -> str:
    return f"{x % M}::UBIGINT" if isinstance(x, int) else x


def _add(*xs) -> str:
    return f"(({' + '.join(f'({_n(x)})::UHUGEINT' for x in xs)}) % {M}::UHUGEINT)::UBIGINT"


def _mul(a, b) -> str:
    return f"((({_n(a)})::UHUGEINT * ({_n(b)})::UHUGEINT) % {M}::UHUGEINT)::UBIGINT"


def _rotl(x, r: int) -> str:
    return f"({_mul(x, 1 << r)} | (({_n(x)}) >> {64 - r}))"


def _round(acc, k) -> str:
    return _mul(_rotl(_add(acc, _mul(k, P2)), 31), P1)


def _read(at: str, n: int) -> str:
    """The little-endian number in n bytes of the hexadecimal text x."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * i + 1}, 2)" for i in reversed(range(n))) + ")::UBIGINT"


def _hashed() -> str:
    """Common table expressions that end in ``hashed`` (shingle, h) of ``kinds`` (shingle)."""
    start = ", ".join(f"{_n(v)} AS v{i}" for i, v in enumerate((SEED + P1 + P2, SEED + P2, SEED, SEED - P1), 1))
    step = ", ".join(f"{_round(f'v{i}', _read(f'pos + {8 * (i - 1)}', 8))} AS v{i}" for i in range(1, 5))
    merged = _add(*[_rotl(f"v{i}", r) for i, r in ((1, 1), (2, 7), (3, 12), (4, 18))])
    parts = [
        "raw AS (SELECT shingle, lower(hex(encode(shingle))) AS x, strlen(shingle)::BIGINT AS n FROM kinds)",
        f"stripes AS (SELECT shingle, x, n, 0::BIGINT AS pos, {start} FROM raw WHERE n >= 32 UNION ALL SELECT shingle, x, n, pos + 32, {step} FROM stripes WHERE pos + 32 <= n)",
        f"m0 AS MATERIALIZED (SELECT *, {merged} AS h FROM stripes WHERE pos + 32 > n)",
    ]
    for i in range(1, 5):
        mixed = _add(_mul(f"xor(h, {_round(0, f'v{i}')})", P1), P4)
        parts.append(f"m{i} AS MATERIALIZED (SELECT * EXCLUDE h, {mixed} AS h FROM m{i - 1})")
    parts.append(f"t0 AS MATERIALIZED (SELECT shingle, x, n, pos, {_add('h', 'n::UBIGINT')} AS h FROM m4 UNION ALL SELECT shingle, x, n, 0, {_add(SEED + P5, 'n::UBIGINT')} FROM raw WHERE n < 32)")
    k = 0
    for size, count in ((8, 3), (4, 1), (1, 3)):
        for _ in range(count):
            word = _read("pos", size)
            new = {
                8: _add(_mul(_rotl(f"xor(h, {_round(0, word)})", 27), P1), P4),
                4: _add(_mul(_rotl(f"xor(h, {_mul(word, P1)})", 23), P2), P3),
                1: _mul(_rotl(f"xor(h, {_mul(word, P5)})", 11), P1),
            }[size]
            parts.append(f"t{k + 1} AS MATERIALIZED (SELECT shingle, x, n, CASE WHEN pos + {size} <= n THEN pos + {size} ELSE pos END AS pos, CASE WHEN pos + {size} <= n THEN {new} ELSE h END AS h FROM t{k})")
            k += 1
    for i, (shift, prime) in enumerate(((33, P2), (29, P3))):
        parts.append(f"z{i} AS MATERIALIZED (SELECT shingle, {_mul(f'xor(h, h >> {shift})', prime)} AS h FROM {f't{k}' if i == 0 else 'z0'})")
    parts.append("hashed AS MATERIALIZED (SELECT shingle, xor(h, h >> 32) AS h FROM z1)")
    return ",\n".join(parts)


def oracle() -> str:
    bits = ", ".join(f"sum((h >> {b}) & 1::UBIGINT) AS c{b}" for b in range(64))
    print_ = " + ".join(f"CASE WHEN 2 * c{b} > n THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
kinds AS MATERIALIZED (SELECT DISTINCT shingle FROM s),
{_hashed()},
bits AS MATERIALIZED (SELECT r, count(*) AS n, {bits} FROM s JOIN hashed USING (shingle) GROUP BY r),
prints AS (SELECT r, ({print_})::UBIGINT AS fp FROM bits),
docs AS MATERIALIZED (SELECT w.doc_id, coalesce(prints.fp, 0::UBIGINT) AS fp FROM w LEFT JOIN prints USING (r)),
nodes AS MATERIALIZED (SELECT fp, min(doc_id) AS low FROM docs GROUP BY fp),
links AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM nodes a JOIN nodes b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)::HUGEINT) <= 3),
reach AS (SELECT fp AS a, fp AS b FROM nodes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
lows AS (SELECT reach.a AS fp, min(nodes.low) AS component_id FROM reach JOIN nodes ON nodes.fp = reach.b GROUP BY reach.a)
SELECT docs.doc_id, lpad(lower(to_hex(docs.fp)), 16, '0') AS fingerprint, lows.component_id FROM docs JOIN lows USING (fp)
"""
