"""Ordered scans over one key's rows without giving the key to one task.

A plain ``Window.partitionBy(user)`` sorts everything a user ever did in one
task, so a user with a third of all rows decides the run time. Here a key's
rows are cut into time slices: windows run inside (key, slice), one summary
row per slice is combined across the slices of a key, and the result is added
back by an equi-join on (key, slice). The summaries of a key number at most
its time span divided by the slice width, whatever its row count.

The input feeds two branches (rows and summaries), so it must be
deterministic, and scans should not be stacked: each function below does
everything it needs in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import times

DEFAULT_SLICE_MS = times.HOUR_MS
SLICE = "_slice"


class Slices:
    """Windows and the two-branch plan for one key and one total order.

    ``order`` starts with an epoch in ms. Keys must not be null; a null epoch
    sorts first, in a slice of its own.
    """

    def __init__(self, df: DataFrame, keys: Iterable[str], order: Iterable[str], slice_ms: int):
        self.columns = df.columns
        self.keys, self.order = list(keys), list(order)
        self.at = [*self.keys, SLICE]
        self.base = df.withColumn(
            SLICE, F.coalesce(F.floor(F.col(self.order[0]) / slice_ms), F.lit(-(2**62)))
        )
        self.position = F.struct(*self.order)
        self.inside = Window.partitionBy(*self.at).orderBy(*self.order)
        self.so_far = self.inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.until_previous = self.inside.rowsBetween(Window.unboundedPreceding, -1)
        self.across = Window.partitionBy(*self.keys).orderBy(SLICE)
        self.earlier = self.across.rowsBetween(Window.unboundedPreceding, -1)

    def scan(
        self,
        local: list[Mapping[str, Column]],
        summary: Mapping[str, Column],
        carry: list[Mapping[str, Column]],
        out: Mapping[str, Column],
    ) -> DataFrame:
        """``local``: columns inside a slice, ``summary``: one row per slice,
        ``carry``: columns across slices, ``out``: the result columns.
        Steps of a list may use the ones before. Names start with ``_``."""
        rows = self.base
        for step in local:
            rows = rows.withColumns(dict(step))
        ends = rows.groupBy(*self.at).agg(*[c.alias(n) for n, c in summary.items()])
        for step in carry:
            ends = ends.withColumns(dict(step))
        offsets = ends.withColumnsRenamed({k: f"_k_{k}" for k in self.at})
        # Plain equality keeps the window's partitioning usable for the join.
        same = [F.col(k) == F.col(f"_k_{k}") for k in self.at]
        kept = [F.col(f"`{c}`") for c in self.columns if c not in out]
        return rows.join(offsets, same, "left").select(
            *kept, *[c.alias(n) for n, c in out.items()]
        )


def ordered_scan(
    df: DataFrame,
    keys: Iterable[str],
    order: Iterable[str],
    *,
    previous: Iterable[str] = (),
    sums: Mapping[str, Column] | None = None,
    latest: Mapping[str, Column] | None = None,
    slice_ms: int = DEFAULT_SLICE_MS,
) -> DataFrame:
    """Add columns that depend on the rows before the current one.

    ``previous``  columns copied from the row before, as ``prev_<name>``
    ``sums``      running sums including the current row
    ``latest``    last non-null value up to and including the current row
    """
    s = Slices(df, keys, order, slice_ms)
    previous, sums, latest = list(previous), dict(sums or {}), dict(latest or {})
    local, summary, carry, out = {}, {}, {}, {}
    if previous:
        local["_prev"] = F.lag(F.struct(*previous)).over(s.inside)
        summary["_e_prev"] = F.max_by(F.struct(*previous), s.position)
        carry["_c_prev"] = F.lag("_e_prev").over(s.across)
        for name in previous:
            out[f"prev_{name}"] = F.coalesce("_prev", "_c_prev")[name]
    for name, value in sums.items():
        local[f"_l_{name}"] = F.sum(value).over(s.so_far)
        summary[f"_e_{name}"] = F.sum(value)
        carry[f"_c_{name}"] = F.sum(f"_e_{name}").over(s.earlier)
        out[name] = F.coalesce(f"_l_{name}", F.lit(0)) + F.coalesce(f"_c_{name}", F.lit(0))
    for name, value in latest.items():
        local[f"_l_{name}"] = F.last(value, ignorenulls=True).over(s.so_far)
        summary[f"_e_{name}"] = F.max_by(value, F.when(value.isNotNull(), s.position))
        carry[f"_c_{name}"] = F.last(f"_e_{name}", ignorenulls=True).over(s.earlier)
        out[name] = F.coalesce(f"_l_{name}", f"_c_{name}")
    return s.scan([local], summary, [carry], out)


def segments(
    df: DataFrame,
    keys: Iterable[str],
    order: Iterable[str],
    compare: Iterable[str],
    opens: Callable[[Column, Column], Column],
    *,
    start: str = "segment_start",
    step: str = "segment_step",
    slice_ms: int = DEFAULT_SLICE_MS,
) -> DataFrame:
    """Cut a key's ordered rows into runs.

    ``opens(previous, current)`` decides on two structs of the ``compare``
    columns whether the current row opens a run; a key's first row always
    does. Adds ``start``, the order columns of the run's first row, and
    ``step``, the row's number inside its run.
    """
    s = Slices(df, keys, order, slice_ms)
    seen = F.struct(*compare)
    opened = F.coalesce(opens(F.col("_prev"), seen), F.lit(False))
    local = [
        {"_prev": F.lag(seen).over(s.inside), "_rn": F.row_number().over(s.inside)},
        {
            "_open": F.when(
                F.col("_prev").isNotNull() & opened,
                F.struct(s.position.alias("at"), F.col("_rn").cast("bigint").alias("n")),
            )
        },
        {"_l_open": F.last("_open", ignorenulls=True).over(s.so_far)},
    ]
    summary = {
        "_first": F.min_by(seen, s.position),
        "_first_at": F.min(s.position),
        "_last": F.max_by(seen, s.position),
        "_e_open": F.max("_open"),
        "_n": F.count("*"),
    }
    before = F.lag("_last").over(s.across)
    head_opens = F.col("_before").isNull() | F.coalesce(
        opens(F.col("_before"), F.col("_first")), F.lit(False)
    )
    moved = F.struct(
        F.col("_e_open.at").alias("at"), (F.col("_e_open.n") + F.col("_base")).alias("n")
    )
    head = F.struct(F.col("_first_at").alias("at"), (F.col("_base") + 1).alias("n"))
    carry = [
        {"_before": before, "_base": F.coalesce(F.sum("_n").over(s.earlier), F.lit(0))},
        {"_head": F.when(head_opens, head)},
        {"_end": F.coalesce(F.when(F.col("_e_open").isNotNull(), moved), F.col("_head"))},
        {"_c_open": F.coalesce("_head", F.last("_end", ignorenulls=True).over(s.earlier))},
    ]
    # "n" of a local opening counts inside the slice, the others over the key.
    own = F.struct(
        F.col("_l_open.at").alias("at"), (F.col("_l_open.n") + F.col("_base")).alias("n")
    )
    run = F.coalesce(F.when(F.col("_l_open").isNotNull(), own), F.col("_c_open"))
    out = {start: run["at"], step: F.col("_base") + F.col("_rn") - run["n"] + 1}
    return s.scan(local, summary, carry, out)
