"""Language identification with bit-sliced Bloom filters over letter n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import in_batches

NGRAM = 3
COUNT_SLOTS = 1 << 17
FILTER_SLOTS = 1 << 18
PROBES = 3
LEAST_SHARE = 3e-5
SLICE = 1 << 20
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def grams(text: str) -> tuple[np.ndarray, bool]:
    """Hashes of the n-grams of the text, and whether it has a letter: lower case, each run of anything but letters counts as one space.
    Texts are taken in slices that overlap by an n-gram."""
    found, any_letter = [], False
    for start in range(0, max(1, len(text)), SLICE):
        part = f" {text[start : start + SLICE + NGRAM].lower()} "
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        known = letters()[codes]
        any_letter |= bool(known.any())
        codes[~known] = 32
        keep = known.copy()
        keep[1:] |= known[:-1]
        keep[:-1] |= known[1:]
        keep[1:] &= known[1:] | known[:-1]
        codes = codes[keep].astype(np.uint64)
        if len(codes) < NGRAM:
            continue
        h = codes[: len(codes) - NGRAM + 1].copy()
        for k in range(1, NGRAM):
            h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - NGRAM + 1 + k]
        found.append(h)
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), any_letter


def probe(h: np.ndarray, k: int, slots: int) -> np.ndarray:
    return ((h * MIX[k]) >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


def learn(rows: DataFrame) -> dict:
    """The filters, from all rows of (text, lang) with a lang. `lang` is a closed vocabulary; its values and a fixed-size filter
    are what the driver holds. An n-gram belongs to every language in which it makes up LEAST_SHARE of
    the n-grams; so names, quotations and other languages' lines do not fill the filters."""

    def count(batch: pa.RecordBatch):
        per: dict[str, list] = {}
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            per.setdefault(lang, []).append(grams(text)[0])
        for lang, hashes in per.items():
            values, n = np.unique(np.concatenate(hashes), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(n)], ["lang", "gram", "n"]
            )

    counted = in_batches(rows.where("lang is not null").select(F.coalesce("text", F.lit("")).alias("text"), "lang"), count, "lang string, gram bigint, n bigint")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    sizes = {r["lang"]: r["total"] for r in totals.collect()}
    common = counted.join(F.broadcast(totals), "lang").where(F.col("n") >= F.col("total") * LEAST_SHARE).select("lang", "gram").toPandas()
    langs = sorted(sizes, key=lambda lang: (-sizes[lang], lang))
    masks = np.zeros((max(1, -(-len(langs) // 64)), FILTER_SLOTS), np.uint64)
    for i, lang in enumerate(langs):
        h = common.loc[common["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for k in range(PROBES):
            masks[i // 64, probe(h, k, FILTER_SLOTS)] |= np.uint64(1 << (i % 64))
    false = [float(((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() ** PROBES) for i in range(len(langs))]
    return {"langs": langs, "masks": masks, "false": np.array(false)}


def identify(text: str | None, model: dict) -> tuple[str, float, float]:
    """(language, share of its n-grams among all languages', share of the text's n-grams that are its own)."""
    h, any_letter = grams(text or "")
    langs = model["langs"]
    if not any_letter or not langs:
        return "und", 0.0, 0.0
    counts = np.zeros(len(langs))
    if len(h):
        at = [probe(h, k, FILTER_SLOTS) for k in range(PROBES)]
        for word, slices in enumerate(model["masks"]):
            hits = slices[at[0]]
            for more in at[1:]:
                hits &= slices[more]
            for i in range(word * 64, min(len(langs), word * 64 + 64)):
                counts[i] = np.count_nonzero(hits & np.uint64(1 << (i % 64)))
        counts = np.maximum(0, (counts - len(h) * model["false"]) / (1 - model["false"]))
    best = int(counts.argmax())
    whole = counts.sum()
    return langs[best], float(counts[best] / whole) if whole else 0.0, float(min(1.0, counts[best] / max(1, len(h))))


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """The rows of docs (doc_id, text and any others) with lang_pred, score and coverage. `und` where the text is null or
    has no letter; where no n-gram is known, the language with most training text, with score 0; ties go the same way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name not in ("text", "lang_pred", "score", "coverage")]

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [identify(t, shared.value) for t in rows.column("text").to_pylist()]
        lang, score, coverage = zip(*found)
        columns = [rows.column(f.name) for f in keep]
        return pa.RecordBatch.from_arrays(
            [*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(coverage, pa.float64())],
            [*(f.name for f in keep), "lang_pred", "score", "coverage"],
        )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return in_batches(docs.select(*[f.name for f in keep], "text"), batch, f"{kinds}, lang_pred string, score double, coverage double")


def accepted(docs: DataFrame, model: dict, least_coverage: float) -> DataFrame:
    """The rows of docs, with all their columns, whose text has letters and at least `least_coverage` of its n-grams in its language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [identify(t, shared.value) for t in rows.column("text").to_pylist()]
        return rows.filter(pa.array([lang != "und" and coverage >= least_coverage for lang, _, coverage in found], pa.bool_()))

    return in_batches(docs, batch, docs.schema)
