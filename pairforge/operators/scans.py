"""Running aggregates that survive a hot key.

A window partitioned by run alone puts a run with a third of all rows into one task.
Here each run is cut into chunks, any column that is monotone in the order (an hour, a
block of line numbers): windows run inside (run, chunk), the few chunk totals are
scanned per run, and each row adds what its earlier chunks carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# kind -> (aggregate, how carry and local value combine)
_KINDS = {
    "sum": (F.sum, lambda carry, local: F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))),
    "max": (F.max, lambda carry, local: F.greatest(carry, local)),
    "min": (F.min, lambda carry, local: F.least(carry, local)),
    "last": (
        lambda c: F.last(c, ignorenulls=True),
        lambda carry, local: F.coalesce(local, carry),
    ),
    "total": (F.sum, lambda carry, local: carry),
}


def running(
    df: DataFrame,
    keys: list[str],
    chunk: str,
    order: list[str],
    outputs: dict[str, tuple[str, Column, bool]],
) -> DataFrame:
    """Add running aggregates per ``keys`` in the order ``chunk, *order``.

    ``outputs`` maps a name to (kind, value, inclusive): kind is ``sum``, ``max``,
    ``min``, ``last`` (last non-null) or ``total`` (the sum over all rows of the keys);
    inclusive says whether the row itself counts.
    """
    values = {name: f"_v_{name}" for name in outputs}
    df = df.withColumns({values[n]: v for n, (_, v, _) in outputs.items()})
    local_all = W.partitionBy(*keys, chunk).orderBy(*order)
    local, finals = {}, []
    for name, (kind, _, inclusive) in outputs.items():
        agg, _ = _KINDS[kind]
        frame = local_all.rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
        if kind != "total":
            local[f"_l_{name}"] = agg(F.col(values[name])).over(frame)
        if kind == "last":
            # the last non-null of a chunk, by its order; a map-side combinable aggregate
            at = F.when(F.col(values[name]).isNotNull(), F.struct(*order))
            finals.append(F.max_by(F.col(values[name]), at).alias(f"_t_{name}"))
        else:
            finals.append(agg(F.col(values[name])).alias(f"_t_{name}"))
    every = W.partitionBy(*keys)
    earlier = every.orderBy(chunk).rowsBetween(W.unboundedPreceding, -1)
    carried = {}
    for name, (kind, _, _) in outputs.items():
        agg, _ = _KINDS[kind]
        carried[f"_c_{name}"] = agg(F.col(f"_t_{name}")).over(every if kind == "total" else earlier)
    totals = df.groupBy(*keys, chunk).agg(*finals).withColumns(carried)
    totals = totals.drop(*[f"_t_{n}" for n in outputs])
    joined = df.withColumns(local).join(totals, [*keys, chunk])
    combined = {
        name: _KINDS[kind][1](F.col(f"_c_{name}"), F.col(f"_l_{name}"))
        for name, (kind, _, _) in outputs.items()
    }
    helper = [f"_{k}_{n}" for n in outputs for k in "lcv"]
    return joined.withColumns(combined).drop(*helper)
