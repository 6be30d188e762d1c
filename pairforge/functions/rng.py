"""Reproducible randomness: uniforms read from the md5 of a row's own key.

``rand()`` depends on the partitioning; a digest of (seed, key) does not, so a
retried task or another cluster size gives the same rows. One digest carries four
independent 32-bit draws.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42
_SPAN = 4294967296.0


def key_of(*parts: Column | int | str) -> Column:
    """The parts joined by ``|``."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def digest(*parts: Column | int | str) -> Column:
    return F.md5(key_of(*parts))


def uniform(digest_col: Column, slot: int = 0) -> Column:
    """The ``slot``-th (0..3) uniform in [0, 1) of a digest."""
    word = F.substring(digest_col, 1 + 8 * slot, 8)
    return F.conv(word, 16, 10).cast("double") / F.lit(_SPAN)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a one-element transform)."""
    return F.transform(F.array(value), body)[0]
