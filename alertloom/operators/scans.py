"""Distributed building blocks: ordered scans, ranks, exact percentiles, interval
matching and one-row attachment. Every operator that needs a total order or a
per-key order goes through these, so no task ever holds an unbounded group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from alertloom.session import cut_lineage

#: A group of more rows than this is cut into parts; one task orders about this many rows at most. Where the whole table is so large that
#: more than MAX_HEAVY groups could pass the limit, the limit grows, so that the table of cut points stays below 20 MB.
PART_ROWS, MAX_HEAVY = 1 << 20, 1 << 16
#: Cut points of one level of a cut: a group has up to 63 parts (32 ranges, 31 cut points), a part that is still too large as many of its own, and so on.
CUTS, LEVELS = 31, 9
LAST_PART = 1 << 62


def group_key(columns: Sequence[str]) -> Column:
    """The columns as one value that is never null, whatever is null inside: equal groups join, and none is lost."""
    return F.struct(*columns) if columns else F.lit(0)


def _place(value: Column, cuts: Column) -> Column:
    """How many of the CUTS ascending cut points are below the value, plus how many are not above it: rows that equal a cut
    point are apart from those beside it. A null value is before all."""
    below, upto = (F.size(F.filter(cuts, test)) for test in (lambda c: c < value, lambda c: c <= value))
    return F.when(value.isNull(), 0).otherwise(below + upto)


def in_parts(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame | None:
    """Add `__g`, the group, and `__part`, so that within a group rows of a lower part are before those of a higher one in the ascending order of
    the columns, nulls first, and no part has many more than PART_ROWS rows. None if no group is that large: then each is one part.

    Cut points are quantiles of the group's own values, so outliers and bursts change nothing: a part that is still too large is
    cut again, by the same column, or by the next one where all its values are equal. Rows that are equal in all numeric columns stay
    together. The part is an expression of the row's values and a small table of cut points; rows are neither written nor exchanged for it."""
    rows = df.withColumn("__g", group_key(by)).withColumn("__part", F.lit(0).cast("long"))
    facts = rows.groupBy("__g").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    if (facts[1] or 0) <= PART_ROWS:
        return None
    limit = max(PART_ROWS, facts[0] // MAX_HEAVY)
    numeric = [c for c in order if isinstance(df.schema[c].dataType, NumericType)]
    value = lambda c: F.col(c).cast("double")
    fractions = F.array(*[F.lit((i + 1) / (CUTS + 1)) for i in range(CUTS)])
    for _ in range(LEVELS):
        spans = [F.struct(F.min(value(c)).alias("low"), F.max(value(c)).alias("high"), F.count(c).alias("known")).alias(f"__v{i}") for i, c in enumerate(numeric)]
        heavy = rows.groupBy("__g", "__part").agg(F.count(F.lit(1)).alias("__n"), *spans).filter(F.col("__n") > limit)
        first = F.coalesce(*[F.when((F.col(f"__v{i}.low") < F.col(f"__v{i}.high")) | ((F.col(f"__v{i}.known") > 0) & (F.col(f"__v{i}.known") < F.col("__n"))), i) for i in range(len(numeric))])
        heavy = cut_lineage(heavy.select("__g", "__part", first.alias("__by")).filter("__by is not null"))
        if heavy.isEmpty():
            break
        chosen = F.coalesce(*[F.when(F.col("__by") == i, value(c)) for i, c in enumerate(numeric)])
        points = rows.join(F.broadcast(heavy), ["__g", "__part"]).groupBy("__g", "__part", "__by").agg(F.percentile_approx(chosen, fractions, 10_000).alias("__cuts"))
        cut = rows.join(F.broadcast(cut_lineage(points)), ["__g", "__part"], "left")
        rows = cut.withColumn("__part", F.col("__part") * (2 * CUTS + 2) + F.when(F.col("__by").isNull(), 0).otherwise(_place(chosen, F.col("__cuts")))).drop("__by", "__cuts")
    return rows


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a global aggregate (exactly one row) to every row."""
    key = "__row_key"
    left = df.withColumn(key, F.lit(0))
    right = one_row.withColumn(key, F.lit(0))
    return left.join(F.broadcast(right), key).drop(key)


def prefix_sum(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    descending: bool = False,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Running totals in the order of a numeric column, with no task that orders an unbounded group.

    Groups of at most PART_ROWS rows are ordered as they are. Larger ones are cut by value (`in_parts`); totals per part are a small table, rows are
    ordered only inside their part and get the totals before it by a join. Nulls come first in rising order, last in falling
    order; a null in `by` is a group like any other; ties rise. `sums` maps output name -> input column. `totals` maps further output names -> names
    in `sums`, for the total of the whole group."""
    first = F.col(order).desc() if descending else F.col(order).asc()
    totals = totals or {}
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Falling order is the rising order of the negated value, so that parts rise with the order either way.
    keyed = df.withColumn("__o", -F.col(order).cast("double")) if descending else df.withColumn("__o", F.col(order))
    rows = in_parts(keyed, by, ["__o", *ties])
    if rows is None:
        whole = df.withColumn("__g", group_key(by))
        inside = upto(Window.partitionBy("__g").orderBy(first, *ties))
        summed = whole.select("*", *[F.sum(v).over(inside).alias(f"__l_{k}") for k, v in sums.items()])
        every = Window.partitionBy("__g")
        return summed.select(*df.columns, *[F.col(f"__l_{k}").alias(k) for k in sums], *[F.sum(sums[k]).over(every).alias(t) for t, k in totals.items()])
    if descending:  # nulls, which are before all in a part's number, belong after all
        rows = rows.withColumn("__part", F.when(F.col("__o").isNull(), LAST_PART + F.col("__part")).otherwise(F.col("__part")))
    parts = rows.groupBy("__g", "__part").agg(*[F.sum(v).alias(f"__t_{k}") for k, v in sums.items()])
    before = Window.partitionBy("__g").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("__g")
    starts = parts.select(
        "__g", "__part", *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__s_{k}") for k in sums],
        *[F.sum(f"__t_{k}").over(every).alias(t) for t, k in totals.items()],
    )
    inside = upto(Window.partitionBy("__g", "__part").orderBy(first, *ties))
    local = rows.select("*", *[F.sum(v).over(inside).alias(f"__l_{k}") for k, v in sums.items()])
    joined = local.join(starts, ["__g", "__part"])
    return joined.select(*df.columns, *[(F.col(f"__l_{k}") + F.col(f"__s_{k}")).alias(k) for k in sums], *totals)


def rank_rows(
    df: DataFrame,
    order: str,
    by: Sequence[str] = (),
    ties: Sequence[str] = (),
    descending: bool = False,
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row in the order of a numeric column, per group, and the
    size of the group under the name `total`."""
    ones = df.withColumn("__w", F.lit(1).cast("long"))
    totals = {total: name} if total else None
    return prefix_sum(ones, order, {name: "__w"}, by, ties, descending, totals).drop("__w")


def hash_order(seed: int | str, column: str) -> Column:
    """A repeatable pseudo-random number for a key: 52 bits of md5(seed:key), exact in a double."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(column).cast("string")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")


def exact_percentiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated percentiles over any number of distinct values.

    Spark's `percentile` keeps every distinct value of a group in one buffer; here the
    distinct values are ranked with `prefix_sum` and only the ranks asked for are kept.
    Output: by columns, `prob`, `value`."""
    by = list(by)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__n"))
    run = prefix_sum(counts, value, {"__upto": "__n"}, by, totals={"__total": "__upto"})
    low, high, top = F.col("__upto") - F.col("__n"), F.col("__upto") - 1, F.col("__total") - 1
    wanted = F.array(*[F.lit(float(p)) for p in probs])
    near = lambda p: (F.ceil(p * top) >= low) & (F.floor(p * top) <= high)
    hits = run.filter(F.exists(wanted, near)).select(
        *by, F.col(value).cast("double").alias("__v"), low.alias("__lo"), high.alias("__hi"), top.alias("__top"),
        F.explode(F.filter(wanted, near)).alias("prob"),
    )
    at = F.col("prob") * F.col("__top")
    floor_hit = F.when((F.floor(at) >= F.col("__lo")) & (F.floor(at) <= F.col("__hi")), F.col("__v"))
    ceil_hit = F.when((F.ceil(at) >= F.col("__lo")) & (F.ceil(at) <= F.col("__hi")), F.col("__v"))
    ends = hits.groupBy(*by, "prob", at.alias("__at")).agg(F.max(floor_hit).alias("__a"), F.max(ceil_hit).alias("__b"))
    part = F.col("__at") - F.floor("__at")
    return ends.select(*by, "prob", (F.col("__a") + (F.col("__b") - F.col("__a")) * part).alias("value"))


def rank_in_key(df: DataFrame, key: str, ts: str, ties: Sequence[str]) -> DataFrame:
    """Add `rn` (0-based position in the key by ts, ties) and `prev_ts`. Rows without a key are one group.

    A key of more than PART_ROWS rows, by a burst or as a third of all rows, is cut into parts by time and ties (`in_parts`). What a part needs
    from those before it is one row: their number and their last time."""
    parts = in_parts(df, [key], [ts, *ties])
    if parts is None:
        order = Window.partitionBy("__g").orderBy(ts, *ties)
        return df.withColumn("__g", group_key([key])).select(*df.columns, (F.row_number().over(order) - 1).cast("long").alias("rn"), F.lag(ts).over(order).alias("prev_ts"))
    inside = Window.partitionBy("__g", "__part").orderBy(ts, *ties)
    local = parts.withColumn("__rn", (F.row_number().over(inside) - 1).cast("long")).withColumn("__prev", F.lag(ts).over(inside))
    order = Window.partitionBy("__g").orderBy("__part")
    slices = parts.groupBy("__g", "__part").agg(F.count(F.lit(1)).alias("__m"), F.max(ts).alias("__last"))
    slices = slices.select(
        "__g", "__part", F.sum("__m").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__before"), F.lag("__last").over(order).alias("__prev_last")
    )
    return local.join(slices, ["__g", "__part"]).select(
        *df.columns, (F.col("__rn") + F.coalesce("__before", F.lit(0))).alias("rn"), F.coalesce("__prev", "__prev_last").alias("prev_ts")
    )


def previous_in_key(df: DataFrame, key: str, ts: str, ties: Sequence[str], value: str, name: str) -> DataFrame:
    """Add, as `name`, the value of the row before in the key by ts and ties (null at the first). A large key is cut into parts, as in
    `rank_in_key`; a part needs the last row of the one before."""
    parts = in_parts(df, [key], [ts, *ties])
    if parts is None:
        return df.withColumn("__g", group_key([key])).select(*df.columns, F.lag(value).over(Window.partitionBy("__g").orderBy(ts, *ties)).alias(name))
    inside, order = Window.partitionBy("__g", "__part").orderBy(ts, *ties), Window.partitionBy("__g").orderBy("__part")
    last = parts.groupBy("__g", "__part").agg(F.max(F.struct(ts, *ties, F.col(value).alias("__v"))).alias("__last"))
    last = last.select("__g", "__part", F.lag("__last").over(order)["__v"].alias("__carry"))
    local = parts.withColumns({"__own": F.lag(value).over(inside), "__at": F.row_number().over(inside)})
    return local.join(last, ["__g", "__part"]).select(*df.columns, F.when(F.col("__at") > 1, F.col("__own")).otherwise(F.col("__carry")).alias(name))


def dyadic_cells(lo: Column, hi: Column, width: float, levels: int = 44) -> Column:
    """The cells an interval is made of, as rows (level, cell): a cell of a level is 2**level base cells of `width` seconds, and the interval,
    rounded to base cells, is cut into at most two cells of each level, so that ten years of 60 s cells are fewer than 46 rows."""
    first, after = F.floor(lo / width).cast("long"), F.floor(hi / width).cast("long") + 1
    at = lambda k: (F.ceil(first / F.pow(F.lit(2.0), k)).cast("long"), F.floor(after / F.pow(F.lit(2.0), k)).cast("long"))

    def ends(k: Column) -> Column:
        low, high = at(k)
        cell = lambda odd, c: F.when((low < high) & (F.pmod(odd, F.lit(2)) == 1), F.struct(k.cast("int").alias("level"), c.alias("cell")))
        return F.array(cell(low, low), cell(high, high - 1))

    return F.explode(F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), ends)), lambda x: x.isNotNull()))


def in_levels(base: Column, levels: Sequence[int]) -> Column:
    """The cells that a base cell lies in, one row (level, cell) for each of the levels."""
    if not levels:
        levels = [0]
    return F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(base, k).alias("cell")) for k in sorted(levels)]))


def time_cell(ts: Column, width: float) -> Column:
    return F.floor(ts / width).cast("long")


def carry_forward(df: DataFrame, keys: Sequence[str], ts: str, ties: Sequence[str], value: str, name: str, cell_s: float = 60.0) -> DataFrame:
    """The last non-null `value` at or before each row in its key.

    Rows are ordered only inside a time cell; a per-cell table carries values between
    cells, so the part of a key one task sees is bounded by the time span, not its rows."""
    rows = df.withColumn("__cell", time_cell(F.col(ts), cell_s)).withColumn("__g", group_key(keys))
    known = F.col(value).isNotNull()
    cells = rows.groupBy("__g", "__cell").agg(F.max_by(value, F.when(known, F.struct(ts, *ties))).alias("__v"))
    earlier = Window.partitionBy("__g").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select("__g", "__cell", F.last("__v", ignorenulls=True).over(earlier).alias("__carry"))
    inside = Window.partitionBy("__g", "__cell").orderBy(ts, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("__own", F.last(value, ignorenulls=True).over(inside))
    return local.join(carried, ["__g", "__cell"]).select(*df.columns, F.coalesce("__own", "__carry").alias(name))


def rank_by_sort(df: DataFrame, *order: Column | str, name: str = "rank", total: str = "n_total") -> DataFrame:
    """1-based position in the order of any columns. One range-partitioned sort; the sorted
    rows are written once, so the partition sizes that give the offsets cannot change."""
    placed = cut_lineage(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33).alias("__part")
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy().orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias(total)
    )
    inside = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("__part", F.shiftright("__m", 33)).join(F.broadcast(starts), "__part")
    return joined.select(*df.columns, (inside + F.col("__start") + 1).alias(name), total)
