"""Operations rollups: spend, session and request activity, column profiles, sweep plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom import fixed
from alertloom.functions import columns as C


def price_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.PRICES, "backend string, model string, price_in double, price_out double")


def with_prices(rows: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Rows with the price of their (backend, model), null where none is listed. Only the
    built-in list, whose size is fixed, is broadcast."""
    table = F.broadcast(price_list(rows.sparkSession)) if prices is None else prices
    return rows.join(table, ["backend", "model"], "left")


def with_cost(rows: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    cents = C.cost_cents(F.col("tokens_in"), F.col("tokens_out"), F.col("price_in"), F.col("price_out"))
    return with_prices(rows, prices).withColumn("cost_cents", cents).drop("price_in", "price_out")


def spend_rollup(sessions: DataFrame, now: float, window_s: float = 86400.0) -> DataFrame:
    """Agent sessions of the trailing window: totals, per backend and model, per template,
    and per template, backend and model. `scope` names the level.
    sessions: ts, family, backend, model, prompt_template_id, tokens_in, tokens_out, cost_cents."""
    name = lambda c: F.coalesce(C.blank_to_null(F.col(c)), F.lit("?")).alias(c)
    recent = sessions.filter((F.col("ts") >= now - window_s) & F.col("family").startswith("llm_"))
    keys = ["prompt_template_id", "backend", "model"]
    cells = recent.groupBy(*[name(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tin"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tout"),
        F.coalesce(F.sum("cost_cents"), F.lit(0.0)).alias("cents"), F.count_if(F.col("cost_cents").isNull()).alias("free"),
    )
    col = F.col
    sets = [[], [col("backend"), col("model")], [col("prompt_template_id")], [col(k) for k in keys]]
    out = cells.groupingSets(sets, *keys).agg(
        F.sum("n").alias("n_sessions"), F.sum("tin").alias("tokens_in"), F.sum("tout").alias("tokens_out"), F.sum("cents").alias("cost_cents"),
        F.sum("free").alias("unpriced_sessions"), F.count(F.lit(1)).alias("n_cells"),
    )
    t, b = col("prompt_template_id").isNotNull(), col("backend").isNotNull()
    scope = F.when(t & b, "template_model").when(t, "template").when(b, "model").otherwise("total")
    return out.withColumn("scope", scope).withColumn("unpriced", col("unpriced_sessions") > 0)


def sessions_by_family(sessions: DataFrame, now: float, window_s: float = 300.0) -> DataFrame:
    """Provenance rows of the trailing window per family: count, stealth split, counts per
    target and per class (small maps), last seen."""
    name = lambda c: F.coalesce(C.blank_to_null(F.col(c)), F.lit("?")).alias(c)
    recent = sessions.filter(F.col("ts") >= now - window_s)
    cells = recent.groupBy(name("family"), name("target_app"), name("class")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("stealth").alias("s"), F.max("ts").alias("last")
    )
    summary = cells.groupBy("family").agg(
        F.sum("n").alias("n"), F.sum("s").alias("stealth"), F.sum(F.col("n") - F.col("s")).alias("no_stealth"), F.max("last").alias("last_seen")
    )
    def counts(axis: str, alias: str) -> DataFrame:
        per = cells.groupBy("family", axis).agg(F.sum("n").alias("c"))
        entries = F.array_sort(F.collect_list(F.struct(axis, "c")))
        return per.groupBy("family").agg(F.map_from_entries(entries).alias(alias))

    return summary.join(counts("target_app", "by_target_app"), "family").join(counts("class", "by_class"), "family")


def recent_sessions(sessions: DataFrame, n: int = 200) -> DataFrame:
    """The newest n provenance rows with the cost fields lifted out of `extra`."""
    extra = [f.name for f in sessions.schema["extra"].dataType.fields]
    present = F.filter(F.array(*[F.when(F.col(f"extra.{e}").isNotNull(), F.lit(e)) for e in sorted(extra)]), lambda k: k.isNotNull())
    newest = sessions.orderBy(F.col("ts").desc(), F.col("session_id").desc()).limit(n)
    return newest.select(
        "ts", "session_id", "class", "family", "target_app", "security_level", F.coalesce("stealth", F.lit(False)).alias("stealth"),
        "generator", F.array_join(present, ",").alias("extra_keys"), "extra.tokens_in", "extra.tokens_out", "extra.estimated_cost_cents",
    )


def project_cost(cells: DataFrame, prices: DataFrame | None = None, tokens: tuple[int, int] = fixed.PROJECTED_TOKENS) -> DataFrame:
    """Projected cents per session and per cell. cells: backend, model, sessions."""
    per = C.cost_cents(F.lit(tokens[0]), F.lit(tokens[1]), F.col("price_in"), F.col("price_out"))
    priced = with_prices(cells, prices).withColumn("cents_per_session", per)
    return priced.withColumn("cents_total", F.col("cents_per_session") * F.col("sessions")).drop("price_in", "price_out")


def projection_summary(projected: DataFrame) -> DataFrame:
    """Total cents and the number of cells without a price."""
    return projected.agg(F.coalesce(F.sum("cents_total"), F.lit(0.0)).alias("total_cents"), F.count_if(F.col("cents_total").isNull()).alias("unpriced_cells"))


def unpriced_models(projected: DataFrame) -> DataFrame:
    return projected.filter(F.col("cents_total").isNull()).select("backend", "model").distinct()


def plan_matrix(one_row: DataFrame, axes: Sequence[str], keep: Column | None = None) -> DataFrame:
    """Every combination of the values in the array columns of one configuration row."""
    out = one_row
    for axis in axes:
        out = out.withColumn(axis, F.explode(axis))
    return out if keep is None else out.filter(keep)


def axis_row(df: DataFrame, axes: Mapping[str, Column]) -> DataFrame:
    """One row of sorted distinct axis values. For closed vocabularies only."""
    return df.agg(*[F.array_sort(F.collect_set(c)).alias(a) for a, c in axes.items()])


def sweep_plan(
    spark: SparkSession, families: Mapping[str, Sequence[str]] = fixed.TARGET_FAMILIES, levels: Sequence[str] = ("low", "medium"),
    sessions: int = 2,
) -> DataFrame:
    """target x family x security level x stealth, without the combinations known to yield
    nothing: a stealthy sqlmap on level high, and levels on the API-only target."""
    cells = F.array(*[F.struct(F.lit(t).alias("target_app"), F.lit(f).alias("family")) for t, fs in families.items() for f in fs])
    one = spark.range(1).select(cells.alias("c"), F.array(*[F.lit(x) for x in levels]).alias("security_level"), F.array(F.lit(False), F.lit(True)).alias("stealth"))
    api = F.col("target_app") == "vampi"
    keep = ~((F.col("family") == "sqlmap") & F.col("stealth") & (F.col("security_level") == "high")) & ~(api & (F.col("security_level") != "low"))
    plan = plan_matrix(one, ["c", "security_level", "stealth"]).select("c.*", "security_level", "stealth").filter(keep)
    return plan.withColumn("security_level", F.when(api, "na").otherwise(F.col("security_level"))).withColumn("sessions", F.lit(sessions))


def agent_plan(
    spark: SparkSession, targets: Sequence[str] = fixed.BROWSER_TARGETS, models: Mapping[str, Sequence[str]] = fixed.BACKEND_MODELS,
    stealth: Sequence[bool] = (False, True), sessions: int = 2,
) -> DataFrame:
    """target x backend x model x stealth; pass `stealth=(False,)` for the API targets."""
    unknown = [t for t in targets if t not in fixed.TARGET_FAMILIES]
    if unknown:
        raise ValueError(f"unknown targets: {unknown}")
    pairs = F.array(*[F.struct(F.lit(b).alias("backend"), F.lit(m).alias("model")) for b, ms in models.items() for m in ms])
    one = spark.range(1).select(F.array(*[F.lit(t) for t in targets]).alias("target_app"), pairs.alias("p"), F.array(*[F.lit(s) for s in stealth]).alias("stealth"))
    plan = plan_matrix(one, ["target_app", "p", "stealth"]).select("target_app", "p.*", "stealth", F.lit(sessions).alias("sessions"))
    return plan.withColumn("family", C.family_name(F.col("backend"), F.col("model")))


def plan_census(plan: DataFrame, sessions: DataFrame) -> DataFrame:
    """Planned cells with the number of matching sessions; level 'na' in the plan matches
    any level. Sessions are counted per cell before the join."""
    keys = ["target_app", "family", "stealth"]
    seen = sessions.withColumn("stealth", F.coalesce("stealth", F.lit(False))).groupBy(*keys, F.col("security_level").alias("__level")).agg(F.count(F.lit(1)).alias("__n"))
    same = (F.col("__level") == F.col("security_level")) | (F.col("security_level") == "na")
    joined = plan.join(seen, keys, "left").withColumn("__n", F.when(same, F.col("__n")))
    return joined.groupBy(*plan.columns).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("sessions_observed")).withColumn(
        "any_provenance_seen", F.col("sessions_observed") > 0
    )


def profile(df: DataFrame, exact: bool = True, samples: int = 3) -> DataFrame:
    """Per column: type, distinct values, ratio, missing values, and the smallest few values.

    Exact counts come from distinct (column, value) pairs, combined before the shuffle;
    `exact=False` uses sketches in one pass for very wide or very large tables."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    text = {c: C.quoted(c).cast("string") for c in types}
    if exact:
        pairs = F.array(*[F.struct(F.lit(c).alias("column"), text[c].alias("value")) for c in types])
        distinct = df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
        w = Window.partitionBy("column").orderBy("value")
        top = distinct.filter(F.col("value").isNotNull()).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= samples)
        shown = top.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("r", F.substring("value", 1, 22).alias("v")))).alias("s"))
        counts = distinct.groupBy("column").agg(F.count("value").alias("cardinality"), F.sum("n").alias("rows"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"))
        out = counts.join(shown, "column", "left").withColumn("sample", F.array_join(F.transform("s", lambda x: x["v"]), ", "))
    else:
        cell = lambda c: F.struct(
            F.lit(c).alias("column"), F.approx_count_distinct(text[c]).alias("cardinality"), F.count(F.lit(1)).alias("rows"),
            F.count_if(text[c].isNull()).alias("n_missing"), F.substring(F.min(text[c]), 1, 22).alias("sample"),
        )
        out = df.agg(F.array(*[cell(c) for c in types]).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    ratio = F.round(F.col("cardinality") / F.greatest(F.col("rows"), F.lit(1)), 3)
    return out.select("column", C.literal_map(types)[F.col("column")].alias("dtype"), "cardinality", ratio.alias("card_ratio"), "n_missing", F.coalesce("sample", F.lit("")).alias("sample"))


def column_facts(df: DataFrame) -> DataFrame:
    """Per column: place, exact number of distinct values, rows, range of its numbers, kind, and whether all values are 0/1.
    Everything comes from the distinct (column, value) pairs, which are combined before the shuffle."""
    kinds = {T.StringType: "text", T.IntegralType: "integer", T.FractionalType: "fraction"}
    kind = lambda f: next((k for t, k in kinds.items() if isinstance(f.dataType, t)), "other")
    cells = [
        F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("column"), F.lit(kind(f)).alias("kind"), C.quoted(f.name).cast("string").alias("value"))
        for i, f in enumerate(df.schema.fields)
    ]
    pairs = df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.place", "c.column", "c.kind", "c.value").agg(F.count(F.lit(1)).alias("rows"))
    number = F.when(F.col("kind").isin("integer", "fraction"), F.expr("try_cast(value AS double)"))
    return pairs.groupBy("place", "column", "kind").agg(
        F.count("value").alias("distinct"), F.sum("rows").alias("n"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.coalesce(F.bool_and(F.col("value").isin("0", "1", "true", "false", "0.0", "1.0")), F.lit(False)).alias("is_bits"),
    )


def mapping_scores(df: DataFrame) -> DataFrame:
    """Points of every (field, column) pair: for a hint in the name, and for values that fit the field."""
    share = F.try_divide("distinct", "n")
    two, text = F.col("distinct") == 2, F.col("kind") == "text"
    looks = {
        "large number": F.col("high") > 1e6, "repeats": (share > 0) & (share < 0.5), "few texts": text & F.col("distinct").between(2, 50),
        "many texts": text & (F.col("distinct") > 10), "two values, bits": two & F.col("is_bits"), "two values, no bits": two & ~F.col("is_bits"),
        "not two values": ~two, "small integer": (F.col("kind") == "integer") & (F.col("high") < 50),
        "unit fraction": (F.col("kind") == "fraction") & (F.col("low") >= 0) & (F.col("high") <= 1),
    }
    fields = [F.struct(F.lit(i).alias("turn"), F.lit(f).alias("field"), F.col("column").rlike(f"(?i){hint}").alias("named")) for i, (f, (_, hint)) in enumerate(fixed.MAPPING_HINTS.items())]
    pairs = column_facts(df).withColumn("f", F.explode(F.array(*fields))).select("*", "f.*")
    points = sum((F.when((F.col("field") == f) & looks[look], n).otherwise(0.0) for f, look, n in fixed.MAPPING_VALUE_POINTS), F.lit(0.0))
    return pairs.select("turn", "field", "place", "column", (F.when(F.col("named"), fixed.MAPPING_NAME_POINTS).otherwise(0.0) + points).alias("score"))


def suggest_mapping(df: DataFrame) -> DataFrame:
    """Which source column fits each normalized field: the free column with most points (on ties the first), if it has any; fields take
    their turn in listed order. The pairs are scored by Spark; the choice walks the table of fields times columns once."""
    taken: dict[str, tuple[str, float]] = {}
    for r in mapping_scores(df).filter(F.col("score") > 0).orderBy("turn", F.desc("score"), "place").collect():
        if r["field"] not in taken and r["column"] not in {c for c, _ in taken.values()}:
            taken[r["field"]] = (r["column"], round(r["score"], 2))
    rows = [(field, required, *taken.get(field, (None, 0.0))) for field, (required, _) in fixed.MAPPING_HINTS.items()]
    return df.sparkSession.createDataFrame(rows, "field string, required boolean, source string, score double")
