"""Substring dedup on words: repeated runs of token k-mers, compacted along nonbranching paths of their De Bruijn graph."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.common import attach, forget, in_batches, stage, staged
from alertloom.llm.windows import OTHER, TEXT, Rolling, candidates, keyed, merged, texts_with

WIDTH = 35
GRAM = 8
RANGES = "array<struct<lo:int,hi:int>>"
EDGES = "array<struct<h1:bigint,h2:bigint,p:int,own:boolean>>"


def split(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").split()


def symbols(text: str) -> np.ndarray:
    words = split(text)
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def compact(paths: DataFrame) -> DataFrame:
    """Join repeated paths end to end. paths: t, size, lo, hi, gram, whole; one row per occurrence of a path (a run of k-mer edges that share
    their least gram) in a text. A path whose occurrences are all followed by one other path, which always follows it, is
    nonbranching; such chains are found by pointer doubling, joins whose rounds grow with the logarithm of a chain's
    length. Returns span: t, size, lo, hi, one row per occurrence of a chain. Its place in the text must agree for
    all its members (`lo` less the member's distance from the head), else they stay separate spans."""
    spark, before = paths.sparkSession, len(staged())
    paths = paths.select("t", "size", "lo", "hi", F.xxhash64("gram", "whole").alias("node"))
    here = Window.partitionBy(*TEXT).orderBy("lo")
    follows = F.lead("lo").over(here) == F.col("hi") + 1
    steps = paths.withColumns({"next": F.when(follows, F.lead("node").over(here)), "step": F.col("hi") - F.col("lo") + 1})
    after = steps.groupBy("node").agg(F.min("next").alias("next"), (F.count("*") == F.count("next")).alias("always"), F.min("next").eqNullSafe(F.max("next")).alias("one"), F.min("step").alias("step"))
    out = stage(after.where("always and one and next <> node").select("node", "next", "step"), "single")
    behind = steps.withColumn("prev", F.when(F.lag("hi").over(here) + 1 == F.col("lo"), F.lag("node").over(here)))
    behind = behind.groupBy("node").agg((F.count("*") == F.count("prev")).alias("always"), F.min("prev").eqNullSafe(F.max("prev")).alias("one"))
    links = out.join(behind.where("always and one").select(F.col("node").alias("next")), "next").selectExpr("next node", "node up", "cast(step as bigint) far")
    links = stage(links, "links")
    while True:
        higher = links.selectExpr("node up", "up top", "far more")
        doubled = links.join(higher, "up", "left").selectExpr("node", "coalesce(top, up) up", "far + coalesce(more, 0) far", "top is not null moved")
        doubled = stage(doubled, "links")
        forget(spark, staged()[before:-1])
        links = doubled.drop("moved")
        if not doubled.where("moved").limit(1).count():
            break
    heads = links.select("node", F.col("up").alias("head"), "far")
    sizes = paths.groupBy("node").agg(F.count("*").alias("n")).join(heads, "node", "left")
    sizes = stage(sizes, "heads")
    forget(spark, staged()[before:-1])
    named = attach(paths, sizes, ["node"], "n")
    chains = named.select("t", "size", "lo", "hi", F.coalesce("head", "node").alias("head"), (F.col("lo") - F.coalesce("far", F.lit(0))).alias("start"))
    return chains.groupBy("t", "size", "head", "start").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("t", "size", "lo", "hi")


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (half-open word ranges that were removed).

    A window of `width` words that starts anywhere else too, in the same text or another, is an edge that repeats; every
    word under one goes, first occurrence included, judged on the input. Words are split at ASCII white space and not
    changed. Null and empty texts have no words. Rows with the same text get the same answer, with or without a doc_id;
    shorter texts than a window stay whole; an empty table gives no rows.

    Paths of edges whose copies are whole are decided from their hashes and compacted; where copies differ, the edges of
    one representative per path are counted. The texts themselves are shuffled once. What a later table replaces is removed."""
    spark, before = docs.sparkSession, len(staged())
    found = candidates(docs, symbols, width, gram)
    spans = compact(found.where("state <> 'open'"))
    whole = spans.groupBy(*TEXT).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    lines = found.where("state <> 'same'").select(*TEXT, F.struct("lo", "hi", (F.col("state") == "open").alias("own")).alias("x"))
    lines = lines.groupBy(*TEXT).agg(F.collect_set("x").alias("look"))
    rows = texts_with(docs, whole.join(lines, TEXT, "full"))

    def first_pass(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, ranges, look in zip(*(batch.column(c).to_pylist() for c in ("text", "ranges", "look"))):
            if look:
                out.append((None, None, None, None, text, ranges or [], edges(text, look, width)))
            else:
                out.append((*finish(text, ranges or [], [], width), None, None, None))
        return pa.RecordBatch.from_pylist(
            [{"t": t, "size": s} | dict(zip(names, o)) for t, s, o in zip(batch.column("t").to_pylist(), batch.column("size").to_pylist(), out)], schema=shape
        )

    names = ["n_words", "n_removed", "kept_sha256", "spans", "text", "ranges", "edges"]
    pair = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
    edge = pa.list_(pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("p", pa.int32()), ("own", pa.bool_())]))
    shape = pa.schema([("t", pa.int64()), ("size", pa.int32()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pair), ("text", pa.string()), ("ranges", pair), ("edges", edge)])
    done = f"t bigint, size int, n_words bigint, n_removed bigint, kept_sha256 string, spans {RANGES}"
    looked = stage(in_batches(rows, first_pass, f"{done}, text string, ranges {RANGES}, edges {EDGES}"), "looked")
    forget(spark, staged()[before:-1])
    pending = looked.where("edges is not null")
    each = pending.select(*TEXT, F.explode("edges").alias("e")).select(*TEXT, "e.*")
    twice = each.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    again = attach(each.where("own"), stage(twice, "edges"), ["h1", "h2"], "n").where("n is not null")
    starts = again.groupBy(*TEXT).agg(F.collect_set("p").alias("starts"))

    def second_pass(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = zip(*(batch.column(c).to_pylist() for c in ("t", "size", "text", "ranges", "starts")))
        made = [{"t": t, "size": s} | dict(zip(names, finish(x, r, p or [], width))) for t, s, x, r, p in columns]
        return pa.RecordBatch.from_pylist(made, schema=pa.schema(list(shape)[:6]))

    late = in_batches(pending.select(*TEXT, "text", "ranges").join(starts, TEXT, "left"), second_pass, done)
    answers = looked.where("edges is null").drop("text", "ranges", "edges").unionByName(late)
    answers = stage(answers, "answers")
    forget(spark, staged()[before:-1])
    ids = stage(keyed(docs).select("doc_id", *TEXT), "ids")
    answers = answers.join(ids.groupBy(*TEXT).agg(F.count("*").alias("n")), TEXT)
    return attach(ids, answers, TEXT, "n").select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")


def edges(text: str, look: list[dict], width: int) -> list[dict]:
    """Two independent hashes of each window that starts in one of the ranges, with its start."""
    values = symbols(text)
    out = []
    for base in (None, OTHER):
        rolling = Rolling(len(values)) if base is None else Rolling(len(values), base)
        at = np.concatenate([np.arange(x["lo"], x["hi"] + 1) for x in look])
        out.append(rolling.span(rolling.prefix(values), at, at + width).view(np.int64).tolist())
    own = np.concatenate([np.full(x["hi"] + 1 - x["lo"], x["own"]) for x in look]).tolist()
    return [{"h1": a, "h2": b, "p": p, "own": o} for a, b, p, o in zip(*out, at.tolist(), own)]


def finish(text: str, ranges: list[dict], starts: list[int], width: int) -> tuple:
    words = split(text)
    gone = merged([(r["lo"], r["hi"] + width) for r in ranges] + [(p, p + width) for p in starts])
    kept, at = [], 0
    for low, high in gone:
        kept += words[at:low]
        at = high
    kept += words[at:]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest(), [{"lo": a, "hi": b} for a, b in gone]
