"""Seeded randomness as plain column expressions.

Every random choice is a function of a seed and the row's own keys, so a task
that is run again on another executor takes the same decision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str | int) -> Column:
    """md5 hex of the parts joined by ``|``; bare strings and numbers are literals."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))


def hash_long(*parts: Column | str | int) -> Column:
    """60-bit non-negative integer from :func:`digest`."""
    return F.conv(F.substring(digest(*parts), 1, 15), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """Double in (0, 1): 32 bits of :func:`digest`, shifted by a half step."""
    bits = F.conv(F.substring(digest(*parts), 1, 8), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(4294967296.0)


def pick_ordinals(count: Column, wanted: int, *parts: Column | str | int) -> Column:
    """``min(wanted, count)`` distinct ordinals of ``[0, count)``, uniform without replacement.

    Floyd's subset sampling: step ``j`` runs over the last ``wanted`` ordinals, draws
    from ``[0, j]`` and takes ``j`` itself when the draw is already in the set. The work
    depends on ``wanted`` only, never on ``count``.
    """
    everything = F.sequence(F.lit(0).cast("bigint"), count - 1)

    # Draws are hashed once, before the fold that looks at each of them twice.
    draws = F.transform(
        F.sequence(count - wanted, count - 1),
        lambda j: F.struct(j.alias("j"), (hash_long(*parts, j) % (j + 1)).alias("t")),
    )
    drawn = F.aggregate(
        draws, F.array().cast("array<bigint>"),
        lambda acc, d: F.concat(acc, F.array(F.when(F.array_contains(acc, d["t"]), d["j"]).otherwise(d["t"]))),
    )
    return F.when(count <= wanted, everything).otherwise(drawn)
