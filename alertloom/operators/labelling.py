"""Labels for host events from emulation steps: interval matching, process closure,
host-time fallback, tactic coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators.graph import malicious_closure
from alertloom.operators.scans import dyadic_cells, in_levels, time_cell

CELL_S = 60.0


def _step_cells(steps: DataFrame, pad_s: float, cell_s: float) -> tuple[DataFrame, list[int]]:
    """The steps' padded spans as dyadic cells, and the levels in use, of which there are at most 44."""
    lo, hi = F.col("t_start") - pad_s, F.col("t_end") + pad_s
    cells = steps.select("step_id", F.col("host").alias("__host"), lo.alias("__lo"), hi.alias("__hi"), dyadic_cells(lo, hi, cell_s).alias("__at"))
    return cells, [r[0] for r in cells.select("__at.level").distinct().collect()]


def _in_spans(rows: DataFrame, steps: DataFrame, pad_s: float, cell_s: float, how: str) -> DataFrame:
    """Rows (host, ts) joined with the spans they lie in. A span is in few dyadic cells and a row in one of each level in use, so a pair
    is found once, long spans make no more rows than short ones, and a busy host is spread over cells."""
    cells, levels = _step_cells(steps, pad_s, cell_s)
    placed = rows.withColumn("__at", in_levels(time_cell(F.col("ts"), cell_s), levels))
    inside = (placed["host"] == cells["__host"]) & (placed["__at"] == cells["__at"]) & placed["ts"].between(cells["__lo"], cells["__hi"])
    return placed.join(cells, inside, how)


def _named(procs: DataFrame) -> DataFrame:
    return procs.filter(F.coalesce("guid", F.lit("")) != "")


def match_steps(steps: DataFrame, procs: DataFrame, pad_s: float = 5.0, cell_s: float = CELL_S) -> DataFrame:
    """(step_id, guid) for process creations on the step's host within its padded time span."""
    return _in_spans(_named(procs).select("host", "ts", "guid"), steps, pad_s, cell_s, "inner").select("step_id", "guid").distinct()


def matched_guids(steps: DataFrame, procs: DataFrame, pad_s: float = 5.0, cell_s: float = CELL_S) -> DataFrame:
    """Processes created inside any padded step span. A semi join: no pairs are formed."""
    return _in_spans(_named(procs).select("host", "ts", "guid"), steps, pad_s, cell_s, "left_semi").select("guid").distinct()


def unmatched_steps(steps: DataFrame, procs: DataFrame, pad_s: float = 5.0, cell_s: float = CELL_S) -> DataFrame:
    """Steps that catch no process creation; their host and time span label events instead. Each instant of a host counts once."""
    caught = _in_spans(_named(procs).select("host", "ts").distinct(), steps, pad_s, cell_s, "inner").select("step_id").distinct()
    return steps.join(caught, "step_id", "left_anti")


def _merged(spans: DataFrame) -> DataFrame:
    """The spans (host, t_start, t_end) of each host, overlapping ones made one; those that end before they start hold nothing."""
    order = Window.partitionBy("host").orderBy("t_start", "t_end")
    reached = F.max("t_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    kept = spans.select("host", "t_start", "t_end").filter("t_start <= t_end").distinct()
    number = F.count_if(F.col("__new")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = kept.withColumn("__new", reached.isNull() | (F.col("t_start") > reached)).withColumn("__run", number)
    return runs.groupBy("host", "__run").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"))


def label_by_host_window(events: DataFrame, windows: DataFrame, cell_s: float = CELL_S) -> DataFrame:
    """Label 1 for events inside any (host, t_start, t_end) span; other labels stay.

    Spans are merged and matched with the base cells in which a host has events at all; the events then meet one row of their host and cell,
    which says that all of it is covered or by which spans, so they are joined once and never multiplied."""
    cells, levels = _step_cells(_merged(windows).withColumn("step_id", F.lit(0)), 0.0, cell_s)
    base = time_cell(F.col("ts"), cell_s)
    busy = events.select("host", base.alias("__cell")).distinct().withColumn("__at", in_levels(F.col("__cell"), levels))
    met = busy.join(cells, (busy["host"] == cells["__host"]) & (busy["__at"] == cells["__at"]))
    whole = (F.col("__lo") <= F.col("__cell") * cell_s) & (F.col("__hi") >= (F.col("__cell") + 1) * cell_s)
    spans = F.collect_list(F.when(~whole, F.struct("__lo", "__hi")))
    marks = met.groupBy("host", "__cell").agg(F.bool_or(whole).alias("__whole"), spans.alias("__spans"))
    joined = events.withColumn("__cell", base).join(marks, ["host", "__cell"], "left")
    inside = F.col("__whole") | F.exists("__spans", lambda s: F.col("ts").between(s["__lo"], s["__hi"]))
    return joined.withColumn("label", F.when(inside, F.lit(1)).otherwise(F.col("label"))).select(*events.columns)


def tactic_coverage(steps: DataFrame, required: list[str] = fixed.TACTICS) -> DataFrame:
    """Each required tactic and whether a step's technique belongs to it."""
    tactic = C.tactic_of(F.col("technique_id"))
    wide = steps.agg(F.array(*[
        F.struct(F.lit(t).alias("tactic"), F.coalesce(F.bool_or(tactic == t), F.lit(False)).alias("covered")) for t in required
    ]).alias("c"))
    return wide.select(F.explode("c").alias("c")).select("c.*")


def resolve_labels(
    steps: DataFrame, procs: DataFrame, pad_s: float = 5.0, max_depth: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(malicious guids with hops, fallback host windows, tactic coverage).
    steps: step_id, host, technique_id, t_start, t_end; procs: process creations with
    guid, parent_guid, host, ts, event_id."""
    seeds = matched_guids(steps, procs, pad_s)
    guids = malicious_closure(procs, seeds, max_depth)
    return guids, unmatched_steps(steps, procs, pad_s), tactic_coverage(steps)


def apply_labels(events: DataFrame, guids: DataFrame, windows: DataFrame, mode: str = "union") -> DataFrame:
    """Labels from guids and fallback windows. 'union' uses both; 'fallback' uses the windows
    only when no process matched at all."""
    from alertloom.operators.normalize import label_by_guid

    labelled = label_by_guid(events, guids)
    if mode == "fallback" and not guids.isEmpty():
        return labelled
    return label_by_host_window(labelled, windows)
