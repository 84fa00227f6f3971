"""Repeatable draws by integer arithmetic, the same in numpy and SQL.

``mix`` maps a number to one below ``PRIME`` by two multiplications and an exclusive-or; nothing
in it passes 63 bits. From it come a bijection of the positions 0..n-1, found by arithmetic
for any row, and Poisson weights for all replicates of a row at once.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME, FIRST, SECOND, SHIFT = 2_147_483_647, 48_271, 69_621, 13

# Cumulative Poisson(1) probabilities; a draw is the number passed.
POISSON_CDF = (
    0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
    0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
    0.999998874797402, 0.9999998885745217,
)
POISSON_BOUNDS = tuple(int(p * PRIME) for p in POISSON_CDF)


# ---------------------------------------------------------------- mixing
def mix(x):
    """Of a number or an integer array that is not negative."""
    t = x % PRIME * FIRST % PRIME
    return (t ^ t >> SHIFT) * SECOND % PRIME


def mix_sql(x: str) -> str:
    t = f"((({x}) % {PRIME}) * {FIRST} % {PRIME})"
    return f"(xor({t}, {t} >> {SHIFT}) * {SECOND} % {PRIME})"


def keys(seed: int, count: int) -> list[int]:
    """Numbers that set one draw of a seed apart from another."""
    return [int(mix(mix(seed % PRIME) + i)) for i in range(count)]


# ---------------------------------------------------------------- bijection
def sides(n: int) -> tuple[int, int]:
    """Sides of the smallest near-square grid that holds n positions."""
    a = max(1, int(np.ceil(np.sqrt(n))))
    return a, max(1, -(-n // a))


def turned(position: np.ndarray, n: int, key: Sequence[int]) -> np.ndarray:
    """Four rounds of a Feistel network over the grid."""
    a, b = sides(n)
    left, right = position % a, position // a
    for k in (0, 2):
        left = (left + mix(right + key[k])) % a
        right = (right + mix(left + key[k + 1])) % b
    return right * a + left


def moved(position: np.ndarray, n: int, key: Sequence[int]) -> np.ndarray:
    """Where the bijection of 0..n-1 under four keys takes positions.

    The grid holds fewer than the square root of n positions beyond the last row; one that lands
    there is turned again until it is inside.
    """
    out = turned(position, n, key)
    while (beyond := out >= n).any():
        out[beyond] = turned(out[beyond], n, key)
    return out


def turned_sql(position: str, n: str, key: Sequence[str]) -> str:
    a = f"CAST(ceil(sqrt({n})) AS BIGINT)"
    b = f"(({n} + {a} - 1) // {a})"
    left, right = f"(({position}) % {a})", f"(({position}) // {a})"
    for k in (0, 2):
        left = f"(({left} + {mix_sql(f'{right} + {key[k]}')}) % {a})"
        right = f"(({right} + {mix_sql(f'{left} + {key[k + 1]}')}) % {b})"
    return f"({right} * {a} + {left})"


# ---------------------------------------------------------------- Poisson weights
def halves(row_id: Column) -> list[Column]:
    """Two numbers of 28 bits from the digest of a row id."""
    digest = F.md5(row_id.cast("string"))
    return [F.conv(F.substring(digest, at, 7), 16, 10).cast("long") for at in (1, 8)]


def halves_sql(row_id: str) -> list[str]:
    return [f"CAST('0x' || substr(md5(CAST({row_id} AS VARCHAR)), {at}, 7) AS BIGINT)" for at in (1, 8)]


def poisson(first: np.ndarray, second: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Poisson(1) weights, rows by replicates, as small integers."""
    u = mix(mix(first[:, None] + key[None]) + second[:, None])
    out = (u >= POISSON_BOUNDS[0]).astype(np.int8)
    for bound in POISSON_BOUNDS[1:4]:
        out += u >= bound
    far = np.nonzero(out == 4)
    out[far] += np.searchsorted(POISSON_BOUNDS[4:], u[far], side="right").astype(np.int8)
    return out


def poisson_sql(first: str, second: str, key: str) -> str:
    u = mix_sql(f"{mix_sql(f'{first} + {key}')} + {second}")
    return " + ".join(f"CASE WHEN {u} >= {b} THEN 1 ELSE 0 END" for b in POISSON_BOUNDS)
