"""Random numbers that depend on a row's key only.

``rand(seed)`` depends on the partition a row sits in, so a retried task or a
different cluster size changes the result. Here every draw is taken from the
MD5 of a string built from the row's own key: same row, same draw, always. One
digest holds two independent 52-bit uniforms (``lane`` 0 and 1).
"""

from __future__ import annotations

import math
from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_52 = 4503599627370496.0
_HEX_PER_LANE = 13


def tagged(key: Column, *parts: Column | str | int) -> Column:
    """``key:part:part…`` as a string."""
    out = [key.cast("string")]
    for p in parts:
        out += [F.lit(":"), p.cast("string") if isinstance(p, Column) else F.lit(str(p))]
    return F.concat(*out)


def uniform(text: Column, lane: int = 0) -> Column:
    """Uniform in [0, 1) from the MD5 of ``text``."""
    return uniform_of(F.md5(text.cast("binary")), lane)


def uniform_of(digest: Column, lane: int = 0) -> Column:
    """:func:`uniform` from a digest that is already there."""
    digits = F.substring(digest, 1 + _HEX_PER_LANE * lane, _HEX_PER_LANE)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(_TWO_52)


def polar_of(digest: Column) -> tuple[Column, Column]:
    """Radius and angle of the digest's two uniforms (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform_of(digest, 0)))
    return radius, F.lit(2.0 * math.pi) * uniform_of(digest, 1)


def normal(text: Column, lane: int = 0) -> Column:
    """Standard normal; the two lanes of one text are independent."""
    radius, angle = polar_of(F.md5(text.cast("binary")))
    return radius * (F.cos(angle) if lane == 0 else F.sin(angle))


def uniform_sql(text: str, lane: int = 0) -> str:
    """:func:`uniform` as SQL text, for expressions with many draws."""
    digits = f"substring(md5({text}), {1 + _HEX_PER_LANE * lane}, {_HEX_PER_LANE})"
    return f"(CAST(conv({digits}, 16, 10) AS BIGINT) / {_TWO_52!r}D)"


def beta_symmetric(column: str, alpha: float, attempts: int = 16) -> Column:
    """Beta(alpha, alpha) by Joehnk's rejection method, keyed by a string column.

    ``attempts`` independent pairs are laid out and the first accepted one is
    taken. For alpha = 0.2 a pair is accepted with probability 0.95, so 16
    pairs all fail about once in 10^21 draws; then 0.5 is returned.
    """
    draws = []
    for i in range(attempts):
        text = f"concat({column}, ':{i}')"
        x = f"pow({uniform_sql(text, 0)}, {1.0 / alpha!r}D)"
        y = f"pow({uniform_sql(text, 1)}, {1.0 / alpha!r}D)"
        draws.append(f"CASE WHEN {x} + {y} <= 1D AND {x} + {y} > 0D THEN {x} / ({x} + {y}) END")
    return F.expr(f"coalesce({', '.join(draws)}, 0.5D)")


def hash_order(key: Column, seed: int | str) -> Column:
    """Hex string that puts rows into a seeded pseudo-random order."""
    return F.md5(tagged(key, seed).cast("binary"))
