"""XXH64 in SQL for DuckDB, which has no function for it: for the queries' oracles only.

Numbers are UBIGINT; products and sums go through UHUGEINT and are cut to 64 bits.
"""

from __future__ import annotations

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261
TWO64 = 1 << 64


def mul(a: str, b: int) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * {b}::UHUGEINT) % {TWO64}::UHUGEINT AS UBIGINT)"


def add(a: str, b: int | str) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) + {b}::UHUGEINT) % {TWO64}::UHUGEINT AS UBIGINT)"


def rot(x: str, r: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {1 << r}::UHUGEINT) % {TWO64}::UHUGEINT + ({x} >> {64 - r}) AS UBIGINT)"


def lane_round(x: str) -> str:
    """What a lane adds to a hash."""
    return mul(rot(mul(x, P2), 31), P1)


def long_step(h: str, x: str) -> str:
    """The hash after a lane of 8 bytes."""
    return add(mul(rot(f"xor({h}, {lane_round(x)})", 27), P1), P4)


def finish(source: str, name: str, h: str = "h") -> str:
    """CTEs that scramble column ``h`` of a relation; the last is ``name``."""
    a, b = f"xor({h}, {h} >> 33)", f"xor({h}, {h} >> 29)"
    return f"""{name}_f1 AS (SELECT * EXCLUDE ({h}), {mul(a, P2)} AS {h} FROM {source}),
        {name}_f2 AS (SELECT * EXCLUDE ({h}), {mul(b, P3)} AS {h} FROM {name}_f1),
        {name} AS (SELECT * EXCLUDE ({h}), xor({h}, {h} >> 32) AS {h} FROM {name}_f2)"""


def of_text(source: str, column: str, name: str, seed: int = 42) -> str:
    """CTEs that give relation ``name``: ``source`` with h, the XXH64 of a text column's UTF-8 bytes."""
    lane = "CAST('0x' || " + " || ".join(f"substr(hx, CAST(16 * i + {2 * k + 1} AS BIGINT), 2)" for k in range(7, -1, -1)) + " AS UBIGINT)"
    start = [(seed + P1 + P2) % TWO64, (seed + P2) % TWO64, seed, (seed - P1) % TWO64]
    stripe = lambda j: f"list_reduce(list_prepend({start[j]}::UBIGINT, lanes[{j + 1}:4 * stripes:4]), lambda v, x: {mul(rot(add('v', mul('x', P2)), 31), P1)})"
    merge = lambda v: add(mul(f"xor(h, {lane_round(v)})", P1), P4)
    word = "CAST('0x' || " + " || ".join(f"substr(hx, CAST(16 * (n // 8) + {2 * k + 1} AS BIGINT), 2)" for k in range(3, -1, -1)) + " AS UBIGINT)"
    turned = rot("v0", 1)
    for j, r in ((1, 7), (2, 12), (3, 18)):
        turned = add(turned, f"({rot(f'v{j}', r)})")
    steps = [
        f"SELECT *, hex({column}) AS hx, strlen({column}) AS n, strlen({column}) // 32 AS stripes FROM {source}",
        f"SELECT *, list_transform(range(n // 8), lambda i: {lane}) AS lanes FROM {{}}",
        f"SELECT *, {', '.join(f'{stripe(j)} AS v{j}' for j in range(4))} FROM {{}}",
        f"SELECT *, CASE WHEN stripes > 0 THEN {turned} ELSE {(seed + P5) % TWO64}::UBIGINT END AS h FROM {{}}",
        *[f"SELECT * EXCLUDE (h), CASE WHEN stripes > 0 THEN {merge(f'v{j}')} ELSE h END AS h FROM {{}}" for j in range(4)],
        f"SELECT * EXCLUDE (h), {add('h', 'n')} AS h FROM {{}}",
        f"SELECT * EXCLUDE (h), list_reduce(list_prepend(h, lanes[4 * stripes + 1:]), lambda v, x: {long_step('v', 'x')}) AS h FROM {{}}",
        f"SELECT * EXCLUDE (h), CASE WHEN n % 8 >= 4 THEN {add(mul(rot(f'xor(h, {mul(word, P1)})', 23), P2), P3)} ELSE h END AS h FROM {{}}",
        f"SELECT * EXCLUDE (h), list_reduce(list_prepend(h, list_transform(range(n - n % 4, n), lambda i: CAST('0x' || substr(hx, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT))), lambda v, x: {mul(rot(f'xor(v, {mul("x", P5)})', 11), P1)}) AS h FROM {{}}",
    ]
    ctes, last = [], ""
    for k, step in enumerate(steps):
        ctes.append(f"{name}_{k} AS ({step.replace('{}', last)})")
        last = f"{name}_{k}"
    return ",\n        ".join([*ctes, finish(last, f"{name}_all"), f"{name} AS (SELECT * EXCLUDE (hx, n, stripes, lanes, v0, v1, v2, v3) FROM {name}_all)"])
