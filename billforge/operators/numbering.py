"""Ordered work without one task for all rows, or for all rows of a key.

Rows are dealt into ranges of their order by splitters that are drawn once and stand in the plan as literals. A row's range follows
from the row alone, so the branch that sums up the ranges and the branch that works within them agree in every run, whatever the shuffle
partitions are and however Spark regroups them. What a row gets is what the ranges before it hold, and what stands before it in its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a range holds, about; ranges at most, which bounds the splitters and the sums; sampled rows a splitter.
RANGE_ROWS, MOST_RANGES, SAMPLES = 50_000, 4096, 64
_TIE, _RANGE, _INSIDE = "_seq_tie", "_seq_range", "_seq_inside"
Order = list[tuple[str, bool]]


def _sort(order: Order) -> list[Column]:
    return [F.asc_nulls_first(c) if up else F.desc_nulls_last(c) for c, up in order]


def _precedes(a, b, order: Order) -> Column:
    """Whether ``a`` comes strictly before ``b``, both with a field for each order column; nulls are least."""
    out = F.lit(False)
    for c, up in reversed(order):
        x, y = (a[c], b[c]) if up else (b[c], a[c])
        less = F.coalesce(x < y, x.isNull() & y.isNotNull())
        out = less | (x.eqNullSafe(y) & out)
    return out


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    return isinstance(kind, T.MapType) or kind.typeName() == "variant"


def _named(rows: DataFrame, order: list) -> tuple[DataFrame, Order]:
    """``rows`` with a column for each order expression, and last one that orders rows that are equal in all of them by what else they hold."""
    spec: Order = []
    cols = [F.col(f"`{f.name}`") for f in rows.schema if not _holds_map(f.dataType)]
    for i, o in enumerate(order):
        if isinstance(o, Column):
            rows = rows.withColumn(f"_seq_o{i}", o)
            spec.append((f"_seq_o{i}", True))
        else:
            spec.append((o, True) if isinstance(o, str) else (o[0], o[1] != "desc"))
    return rows.withColumn(_TIE, F.xxhash64(*cols)), [*spec, (_TIE, True)]


def splitters(keyed: DataFrame, order: Order, range_rows: int) -> list[Row]:
    """Rows' order values that cut them into ranges of about ``range_rows``; none for few rows."""
    n = keyed.count()
    ranges = min(MOST_RANGES, -(-n // max(1, range_rows)))
    if ranges < 2:
        return []
    drawn = keyed.select(*[c for c, _ in order]).sample(min(1.0, SAMPLES * ranges / n), seed=7).sort(*_sort(order)).collect()
    cut = [drawn[len(drawn) * k // ranges] for k in range(1, ranges)] if drawn else []
    return [r for i, r in enumerate(cut) if not i or r != cut[i - 1]]


def range_of(keyed: DataFrame, cuts: list[Row], order: Order) -> Column:
    """How many splitters do not come after the row, by halving."""
    if not cuts:
        return F.lit(0)
    kind = T.StructType([keyed.schema[c] for c, _ in order])
    lit = lambda r: F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in kind])
    every, mine = F.array(*map(lit, cuts)).cast(T.ArrayType(kind)), F.struct(*[F.col(c) for c, _ in order])
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    at = lambda a, s: F.when((a + s <= len(cuts)) & ~_precedes(mine, F.get(every, a + s - 1), order), a + s).otherwise(a)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), at)


def _same(by: list[str], prefix: str) -> Column:
    return reduce(lambda a, x: a & x, (F.col(c).eqNullSafe(F.col(f"{prefix}{i}")) for i, c in enumerate(by)), F.col(_RANGE) == F.col("_seq_of"))


def number_rows(rows: DataFrame, order: list, start: int = 0, by: list[str] | None = None, out: str = "seq", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with ``out``: their places in ``order`` (names, pairs of a name and ``"desc"``, or expressions; nulls least), from ``start`` + 1 on and
    gapless, in each group ``by`` if there are groups. Rows that are equal in ``order`` stand in an order of what else they hold. Only rows
    equal in every column can't be told apart and share a range."""
    by, cols = list(by or []), rows.columns
    keyed, spec = _named(rows, order)
    cuts = splitters(keyed, spec, range_rows)
    keyed = keyed.withColumn(_RANGE, range_of(keyed, cuts, spec))
    inside = F.row_number().over(Window.partitionBy(*by, _RANGE).orderBy(*_sort(spec)))
    kept = [F.col(f"`{c}`") for c in cols if c != out]
    if not cuts:
        return keyed.withColumn(out, (F.lit(start) + inside).cast("long")).select(*kept, out)
    per = keyed.groupBy(*by, _RANGE).agg(F.count("*").alias("_seq_count"))
    before = F.coalesce(F.sum("_seq_count").over(Window.partitionBy(*by).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select(*[F.col(c).alias(f"_seq_by{i}") for i, c in enumerate(by)], F.col(_RANGE).alias("_seq_of"), before.alias("_seq_before"))
    # without groups there are no more counts than ranges
    numbered = keyed.withColumn(_INSIDE, inside).join(per if by else F.broadcast(per), _same(by, "_seq_by"))
    return numbered.withColumn(out, (F.lit(start) + F.col("_seq_before") + F.col(_INSIDE)).cast("long")).select(*kept, out)


def running(rows: DataFrame, key: list[str], order: str, last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with, of the rows of the same key that come strictly before in ``order``, the ``last`` value that is not null and the ``sums``, 0 for none.

    A key's rows may lie in many ranges. Only keys that a splitter names do, so what is carried from one range to the next are at
    most as many rows as there are splitters, twice."""
    last, sums = last or {}, sums or {}
    keyed, spec = _named(rows.withColumns({**{f"_seq_v{i}": c for i, c in enumerate(last.values())}, **{f"_seq_s{i}": c for i, c in enumerate(sums.values())}}), [*key, order])
    cuts = splitters(keyed, spec, range_rows)
    keyed = keyed.withColumn(_RANGE, range_of(keyed, cuts, spec))
    prior = Window.partitionBy(*key, *([_RANGE] if cuts else [])).orderBy(*_sort(spec[len(key) :])).rowsBetween(Window.unboundedPreceding, -1)
    values, totals = [f"_seq_v{i}" for i in range(len(last))], [f"_seq_s{i}" for i in range(len(sums))]
    own = {n: F.last(v, ignorenulls=True).over(prior) for n, v in zip(last, values, strict=True)} | {n: F.coalesce(F.sum(s).over(prior), F.lit(0)) for n, s in zip(sums, totals, strict=True)}
    kept = [F.col(f"`{c}`") for c in rows.columns]
    if not cuts:
        return keyed.withColumns(own).select(*kept, *own)
    kinds = T.StructType([T.StructField(f"_seq_key{i}", keyed.schema[k].dataType) for i, k in enumerate(key)])
    named = rows.sparkSession.createDataFrame(list({tuple(r[k] for k in key) for r in cuts}), kinds)
    at = F.struct(*[F.col(c) for c, _ in spec[len(key) :]])
    on = reduce(lambda a, x: a & x, (F.col(c).eqNullSafe(F.col(f"_seq_key{i}")) for i, c in enumerate(key)))
    per = keyed.join(F.broadcast(named), on, "left_semi").groupBy(*key, _RANGE).agg(*[F.max_by(v, F.when(F.col(v).isNotNull(), at)).alias(v) for v in values], *[F.sum(s).alias(s) for s in totals], F.count("*").alias("_seq_n"))
    earlier = Window.partitionBy(*key).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *[F.col(k).alias(f"_seq_key{i}") for i, k in enumerate(key)], F.col(_RANGE).alias("_seq_of"), *[F.last(v, ignorenulls=True).over(earlier).alias(f"{v}c") for v in values], *[F.sum(s).over(earlier).alias(f"{s}c") for s in totals]
    )
    out = keyed.withColumns({f"_seq_r{i}": c for i, c in enumerate(own.values())}).join(F.broadcast(per), _same(key, "_seq_key"), "left")
    made = [F.coalesce(f"_seq_r{i}", f"{v}c").alias(n) for i, (n, v) in enumerate(zip(last, values, strict=True))]
    made += [(F.col(f"_seq_r{len(last) + i}") + F.coalesce(F.col(f"{s}c"), F.lit(0))).alias(n) for i, (n, s) in enumerate(zip(sums, totals, strict=True))]
    return out.select(*kept, *made)
