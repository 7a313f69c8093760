"""Operators that depend on row order inside a group.

A plain window sends a whole group to one task. Where a group may be a large part of the
data, ``running`` cuts it into blocks of its order column: each block is a window of its
own, and only one row per (group, block) takes part in the carry between blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from samplelake.operators.joins import join_dim
from samplelake.session import materialise

BLOCK_ROWS = 1 << 20


def _names(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def first_n(df: DataFrame, by: str | Sequence[str], order, n: int | None) -> DataFrame:
    """The first ``n`` rows of each group; a falsy ``n`` keeps all.

    Planned as a group limit that also runs before the shuffle, so at most ``n`` rows per
    group leave each task, whatever the group's size.
    """
    if not n:
        return df
    window = Window.partitionBy(*_names(by)).orderBy(*(order if isinstance(order, (list, tuple)) else [order]))
    return df.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= n).drop("__rank")


def running(
    df: DataFrame,
    by: Sequence[str],
    block: Sequence[str],
    order: Sequence[str],
    *,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    firsts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add running values over each ``by`` group in (``block``, ``order``) order.

    ``sums``: inclusive running sum; ``lasts``: last non-null value so far (forward fill);
    ``firsts``: first non-null value so far. Key columns must not be null.
    """
    sums, lasts, firsts = dict(sums or {}), dict(lasts or {}), dict(firsts or {})
    keys = [*by, *block]
    here = F.struct(*order)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*by).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)

    totals = df.groupBy(*keys).agg(
        *[F.sum(c).alias(f"__{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), here)).alias(f"__{n}") for n, c in lasts.items()],
        *[F.min_by(c, F.when(c.isNotNull(), here)).alias(f"__{n}") for n, c in firsts.items()],
    )
    carried = totals.select(
        *keys,
        *[F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums],
        *[F.last(f"__{n}", ignorenulls=True).over(earlier).alias(f"__{n}") for n in lasts],
        *[F.first(f"__{n}", ignorenulls=True).over(earlier).alias(f"__{n}") for n in firsts],
    )
    local = df.select(
        "*",
        *[F.sum(c).over(inside).alias(f"__in_{n}") for n, c in sums.items()],
        *[F.last(c, ignorenulls=True).over(inside).alias(f"__in_{n}") for n, c in lasts.items()],
        *[F.first(c, ignorenulls=True).over(inside).alias(f"__in_{n}") for n, c in firsts.items()],
    )
    return local.join(carried, keys, "left").select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[(F.col(f"__in_{n}") + F.coalesce(F.col(f"__{n}"), F.lit(0))).alias(n) for n in sums],
        *[F.coalesce(f"__in_{n}", f"__{n}").alias(n) for n in lasts],
        *[F.coalesce(f"__{n}", f"__in_{n}").alias(n) for n in firsts],
    )


def ordinal(df: DataFrame, by: Sequence[str], order: str | Sequence[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 by the columns of ``order``.

    Equal to ``row_number() - 1``, but rows are sorted over ranges whose borders Spark samples from
    the rows themselves, so a group is spread over as many tasks as its rows need, however its
    order is distributed. One row for each end of a range carries counts on. The result is stored.
    """
    by, order = list(by), _names(order)
    part, lead, ends = (_fresh([*df.columns, name], c) for c in ("__part", "__lead", "__ends"))
    added = StructType().add(name, "long").add(part, "integer").add(lead, "boolean").add(ends, "long")
    schema = StructType([*df.schema.fields, *added.fields])

    def marked(batch: pa.RecordBatch, columns: dict) -> pa.RecordBatch:
        own = dict(zip(batch.schema.names, batch.columns, strict=True))
        kinds = {name: pa.int64(), part: pa.int32(), lead: pa.bool_(), ends: pa.int64()}
        return pa.RecordBatch.from_pydict(own | {c: pa.array(columns[c], kind) for c, kind in kinds.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, last, size, number = TaskContext.get().partitionId(), None, 0, -1
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            new = np.zeros(rows, bool)
            for c in by:
                new[1:] |= _differ(batch.column(c))
            new[0] = last is None or any(last.column(c)[0].as_py() != batch.column(c)[0].as_py() for c in by)
            starts = np.flatnonzero(new)
            if last is not None and len(starts) and number == 0:
                # The first group of the range ends here.
                before = size + int(starts[0])
                yield marked(last, {name: [None], part: [here], lead: [True], ends: [before]})
            groups = number + np.cumsum(new)
            first = np.concatenate(([0], starts))[np.cumsum(new)]
            place = np.arange(rows) - first + np.where(np.cumsum(new) == 0, size, 0)
            if number == -1 and len(starts) > 1:
                yield marked(batch.slice(0, 1), {name: [None], part: [here], lead: [True], ends: [int(starts[1])]})
            yield marked(batch, {name: place, part: np.full(rows, here), lead: groups == 0, ends: [None] * rows})
            number, size, last = int(groups[-1]), int(place[-1]) + 1, batch.slice(rows - 1, 1)
        if last is not None:
            yield marked(last, {name: [None], part: [here], lead: [number == 0], ends: [size]})

    ranges = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    stored = materialise(ranges.mapInArrow(run, schema), "numbered")
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # At most two rows of a range.
    counts = stored.filter(F.col(ends).isNotNull()).withColumn("before", F.sum(ends).over(earlier))
    carried = counts.filter(F.col(lead) & F.col("before").isNotNull()).select(part, lead, F.col("before").alias(ends))
    rows = stored.filter(F.col(ends).isNull()).drop(ends)
    own = [F.col(f"`{c}`") for c in df.columns]
    return join_dim(rows, carried, [part, lead]).select(*own, (F.col(name) + F.coalesce(ends, F.lit(0))).alias(name))


def _fresh(taken: Sequence[str], name: str) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def _differ(column: pa.Array) -> np.ndarray:
    """Where a value is another than the one before; nulls are equal."""
    before, after = column.slice(0, len(column) - 1), column.slice(1)
    same = pc.fill_null(pc.equal(before, after), False)
    return ~pc.or_(same, pc.and_(before.is_null(), after.is_null())).to_numpy(zero_copy_only=False)


def make_unique(
    df: DataFrame,
    name: str,
    order: str | Sequence[str],
    *,
    by: Sequence[str] = (),
    sep: str = "-",
) -> DataFrame:
    """Make ``name`` unique within ``by``: the first holder keeps it, the k-th later one gets
    ``name-k``, passing over numbers whose result is already a name. The columns of ``order`` are
    unique within ``by``. Null names stay null.

    With b_1 < b_2 < ... the numbers taken for a name, b_j has b_j - j free numbers below it,
    so the k-th free number is k + #{j : b_j - j < k}: one running count per name, on the few
    names that have taken numbers.
    """
    by = list(by)
    group = [*by, name]
    named = df.filter(F.col(name).isNotNull())
    numbered = ordinal(named, group, order, "__k")

    suffixed = rf"(?s)^(.*)\Q{sep}\E([1-9][0-9]*)$"
    taken = materialise(
        numbered.filter((F.col("__k") == 0) & F.col(name).rlike(suffixed))
        .select(
            *by,
            F.regexp_extract(name, suffixed, 1).alias(name),
            F.regexp_extract(name, suffixed, 2).try_cast("bigint").alias("__taken"),
        )
        .filter(F.col("__taken").isNotNull())
        .join(numbered.filter(F.col("__k") == 1).select(*group), group, "left_semi"),
        "taken",
    )
    number = F.col("__k")
    if taken.take(1):
        bumps = _bumps(numbered, taken, group)
        numbered = numbered.join(bumps, [*group, "__k"], "left")
        number = number + F.coalesce(F.col("__bump"), F.lit(0))
    suffix = F.when(F.col("__k") > 0, F.concat(F.lit(sep), number.cast("string"))).otherwise("")
    fresh = numbered.withColumn(name, F.concat(F.col(name), suffix)).select(*df.columns)
    return fresh.unionByName(df.filter(F.col(name).isNull()))


def _bumps(numbered: DataFrame, taken: DataFrame, group: list[str]) -> DataFrame:
    """``group, __k, __bump``: how far the number of a later holder moves up, for the names
    that have taken numbers."""
    ranked = ordinal(taken, group, "__taken", "__j")
    marks = ranked.select(
        *group,
        F.lit(None).cast("bigint").alias("__k"),
        (2 * (F.col("__taken") - F.col("__j") - 1) + 1).alias("__at"),
        F.lit(1).cast("bigint").alias("__mark"),
    )
    waiting = (
        numbered.filter(F.col("__k") >= 1)
        .join(taken.select(*group).distinct(), group, "left_semi")
        .select(*group, "__k", (2 * F.col("__k")).alias("__at"), F.lit(0).cast("bigint").alias("__mark"))
    )
    both = marks.unionByName(waiting).withColumn("__block", F.floor(F.col("__at") / BLOCK_ROWS))
    counted = running(both, group, ["__block"], ["__at"], sums={"__bump": F.col("__mark")})
    return counted.filter(F.col("__k").isNotNull()).select(*group, "__k", "__bump")
