"""Running "state before this row" per group, balanced for hot groups.

``last(x, ignorenulls).over(rows unbounded..-1)`` and ``sum(x)`` over the
same frame are prefix scans: one task walks a whole group.  For groups of
hot keys the scan runs in parallel pieces instead (a two-level prefix
scan):

1. rows of a hot key are cut into ``pieces`` contiguous ranges of the order
   column, at splitters read off a quantile sketch (pieces of like size);
2. each piece is scanned locally (window over group + piece);
3. one summary row per (group, piece) - its last non-null value and its
   sum - is scanned over the pieces to give each piece its carry-in;
4. the result is the local value, else the carry-in (last), or local + carry
   (sum).

Splitters only decide where pieces end; the result is exact for any.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import _as_number, _partitions, count_below, splitters


def _before(parts, order, extra=()):
    return (Window.partitionBy(*parts, *extra).orderBy(order)
            .rowsBetween(Window.unboundedPreceding, -1))


def _plain(df: DataFrame, parts, order, lasts, sums) -> DataFrame:
    w = _before(parts, order)
    cols = {k: F.last(v, ignorenulls=True).over(w) for k, v in lasts.items()}
    cols.update({k: F.sum(v).over(w) for k, v in sums.items()})
    return df.withColumns(cols) if cols else df


def plain_scan(df: DataFrame, parts: Sequence[str], order: str,
               lasts: Mapping[str, Column] | None = None,
               sums: Mapping[str, Column] | None = None) -> DataFrame:
    """Add, per output name, the last non-null value (``lasts``) or the sum
    (``sums``) of an expression over the earlier rows of the row's group."""
    return _plain(df, list(parts), order, dict(lasts or {}), dict(sums or {}))


def pieced_scan(df: DataFrame, parts: Sequence[str], order: str,
                lasts: Mapping[str, Column] | None = None,
                sums: Mapping[str, Column] | None = None,
                piece_cols: Sequence[str] = (), pieces: int | None = None,
                checkpoint: bool = True) -> DataFrame:
    """Same result as ``plain_scan`` for rows of hot keys, in parallel pieces.

    Pieces are ranges of ``order`` per ``piece_cols`` key (a prefix of the
    group, e.g. the branch).  The input is read three times (bounds, local
    scan, piece summaries), so the result is checkpointed to the cluster's
    checkpoint folder: chained scans then stay linear in plan size.
    """
    lasts, sums = dict(lasts or {}), dict(sums or {})
    parts, piece_cols = list(parts), list(piece_cols)
    pieces = pieces or _partitions(df)
    x = _as_number(F.col(order), df.schema[order].dataType)
    # piece_cols are the hot keys' columns: a bounded list, so its splitters are broadcast
    bounds = F.broadcast(df.groupBy(*piece_cols).agg(splitters(x, pieces).alias("_cuts")))
    piece = count_below(F.col("_cuts"), x, pieces)
    vals = {f"_v_{k}": v for k, v in lasts.items()}
    vals.update({f"_s_{k}": v for k, v in sums.items()})
    warm = (df.join(bounds, piece_cols).withColumn("_piece", F.coalesce(piece, F.lit(-1)))
              .drop("_cuts").withColumns(vals))

    wl = _before(parts, order, ["_piece"])
    local = warm.withColumns({**{f"_l_{k}": F.last(f"_v_{k}", ignorenulls=True).over(wl) for k in lasts},
                              **{f"_m_{k}": F.sum(f"_s_{k}").over(wl) for k in sums}})
    summary = warm.groupBy(*parts, "_piece").agg(
        *[F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), F.col(order))).alias(f"_pl_{k}")
          for k in lasts],
        *[F.sum(f"_s_{k}").alias(f"_ps_{k}") for k in sums])
    wp = _before(parts, "_piece")
    carry = summary.select(*[F.col(p).alias(f"_k_{p}") for p in parts],
                           F.col("_piece").alias("_k_piece"),
                           *[F.last(f"_pl_{k}", ignorenulls=True).over(wp).alias(f"_cl_{k}") for k in lasts],
                           *[F.sum(f"_ps_{k}").over(wp).alias(f"_cs_{k}") for k in sums])
    cond = [local[p].eqNullSafe(carry[f"_k_{p}"]) for p in parts] + [local["_piece"] == carry["_k_piece"]]
    joined = local.join(carry, cond, "left")
    out = {k: F.coalesce(F.col(f"_l_{k}"), F.col(f"_cl_{k}")) for k in lasts}
    for k in sums:
        m, cs = F.col(f"_m_{k}"), F.col(f"_cs_{k}")
        out[k] = F.when(m.isNull() & cs.isNull(), F.lit(None)).otherwise(
            F.coalesce(m, F.lit(0)) + F.coalesce(cs, F.lit(0)))
    result = joined.withColumns(out).select(*df.columns, *out.keys())
    return result.checkpoint(eager=True) if checkpoint else result


def balanced_scan(df: DataFrame, parts: Sequence[str], order: str,
                  lasts: Mapping[str, Column] | None = None,
                  sums: Mapping[str, Column] | None = None,
                  hot_cols: Sequence[str] | None = None) -> DataFrame:
    """One scan step, split once into hot keys (pieced) and the rest (plain)."""
    from .numbering import collect_hot
    hot_cols = list(hot_cols or parts[:1])
    hot = collect_hot(df, hot_cols)
    if hot is None:
        return plain_scan(df, parts, order, lasts, sums)
    cold = plain_scan(df.join(hot, hot_cols, "left_anti"), parts, order, lasts, sums)
    warm = pieced_scan(df.join(hot, hot_cols, "left_semi"), parts, order, lasts, sums,
                       piece_cols=hot_cols, checkpoint=False)
    return cold.unionByName(warm)
