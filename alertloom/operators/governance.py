"""Quality and privacy gates: score validation, forbidden words, personal data, consent,
manifest rules, split access."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom import fixed
from alertloom.functions import columns as C
from alertloom.operators.splits import set_diff


def validate_scores(scores: DataFrame, expected: DataFrame, key: str = "session_id", score: str = "agent_score") -> DataFrame:
    """One row per fault (session_id, error); empty when the scores are valid. The score
    column may be text, as read from an untyped file."""
    text = F.col(score).cast("string")
    number = text.try_cast("double")
    blank = F.coalesce(F.col(key), F.lit("")) == ""
    row_fault = (
        F.when(blank, "missing or empty session_id").when(number.isNull(), "agent_score not numeric")
        .when(~number.between(0.0, 1.0) | F.isnan(number), "agent_score out of [0, 1]")
    )
    faults = scores.select(F.col(key), row_fault.alias("error")).filter(F.col("error").isNotNull())
    named = scores.filter(~blank)
    twice = named.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(key, F.lit("duplicate session_id").alias("error"))
    wrong = set_diff(expected, named, key).filter(F.col("kind") != "common").select(
        key, F.when(F.col("kind") == "missing", "not scored").otherwise("not in the requested split").alias("error")
    )
    return faults.unionByName(twice).unionByName(wrong)


def _names(schema: T.DataType, path: str) -> list[str]:
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in [f"{path}.{f.name}", *_names(f.dataType, f"{path}.{f.name}")]]
    if isinstance(schema, T.ArrayType):
        return _names(schema.elementType, path + "[]")
    if isinstance(schema, T.MapType):
        return _names(schema.valueType, path + "{}")
    return []


def _holds(value: Column, kind: T.DataType, word: str) -> Column:
    """Whether some text inside a value, at any nesting, contains the word; the names of struct fields are not values."""
    no = F.lit(False)
    if isinstance(kind, T.StringType):
        return F.coalesce(F.lower(value).contains(word), no)
    some = lambda values, inner: F.coalesce(F.exists(values, lambda x: _holds(x, inner, word)), no)
    if isinstance(kind, T.ArrayType):
        return some(value, kind.elementType)
    if isinstance(kind, T.MapType):
        return some(F.map_keys(value), kind.keyType) | some(F.map_values(value), kind.valueType)
    if isinstance(kind, T.StructType):
        return reduce(or_, (_holds(value.getField(f.name), f.dataType, word) for f in kind.fields), no)
    return no


def forbidden_words(df: DataFrame, word: str) -> DataFrame:
    """Where a word occurs: column and field names at any nesting (n null), and values per
    column with the number of rows that contain it."""
    word = word.lower()
    spark = df.sparkSession
    names = [p for p in _names(df.schema, "$") if word in p.rsplit(".", 1)[-1].lower()]
    named = spark.createDataFrame([(p, "name", None) for p in names], "path string, kind string, n long")
    cells = []
    for f in df.schema.fields:
        nested = isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))
        if not nested and not isinstance(f.dataType, T.StringType):
            continue
        held = _holds(C.quoted(f.name), f.dataType, word)
        cells.append(F.struct(F.lit(f"$.{f.name}").alias("path"), F.lit("value").alias("kind"), F.count_if(held).alias("n")))
    if not cells:
        return named
    found = df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*").filter(F.col("n") > 0)
    return named.unionByName(found)


def scan_pii(texts: DataFrame, key: str, text: str = "text", patterns: Sequence[tuple[str, str]] = fixed.SCAN_PATTERNS) -> DataFrame:
    """First hit of every pattern on every line of whole texts: key, line (from 1), pattern,
    matched (longer than 80 characters is cut to 77 and '...').

    A text is split into lines only when some pattern hits it somewhere; a line hit is
    always a text hit, so this skips work and loses nothing."""
    low = texts.withColumn("__low", F.lower(text))
    any_hit = F.lit(False)
    for name, p in sorted(patterns, key=lambda x: len(fixed.SCAN_HINTS.get(x[0], "")), reverse=True):
        hint = fixed.SCAN_HINTS.get(name)
        hit = F.col(text).rlike(p)
        any_hit = any_hit | ((F.col("__low").contains(hint) & hit) if hint else hit)
    lines = low.filter(any_hit).select(key, F.posexplode(F.split(text, fixed.LINE_BREAKS, -1)).alias("__i", "__line"))
    found = [
        F.struct(F.lit(name).alias("pattern"), F.regexp_extract("__line", p, 0).alias("matched")) for name, p in patterns
    ]
    hits = lines.select(key, (F.col("__i") + 1).alias("line"), F.explode(F.filter(F.array(*found), lambda h: h["matched"] != "")).alias("h"))
    cut = F.when(F.length("h.matched") > 80, F.concat(F.substring("h.matched", 1, 77), F.lit("..."))).otherwise(F.col("h.matched"))
    return hits.select(key, "line", "h.pattern", cut.alias("matched"))


def consent_join(sessions: DataFrame, consent: DataFrame, coverage: Sequence[tuple[str, bool]] = fixed.CONSENT_VERSIONS, human: str = "human_real") -> DataFrame:
    """Sessions with `publishable` and, when not, the reason. Only the human channel needs
    consent. sessions: session_id, family, consent_id; consent: consent_id, consent_text_version."""
    latest = consent.filter(C.blank_to_null(F.col("consent_id")).isNotNull()).groupBy("consent_id").agg(
        F.max_by(F.coalesce("consent_text_version", F.lit("")), F.struct("ts", "consent_text_version")).alias("__version")
    )
    allowed = C.literal_map(dict(coverage))[F.col("__version")]
    joined = sessions.withColumn("family", F.coalesce("family", F.lit("?"))).join(latest, "consent_id", "left")
    reason = (
        F.when(F.col("family") != human, None)
        .when(C.blank_to_null(F.col("consent_id")).isNull(), "missing_consent_id")
        .when(F.col("__version").isNull(), "consent_not_found")
        .when(allowed.isNull(), "unknown_consent_version")
        .when(~allowed, "version_not_publishable")
    )
    return joined.withColumn("reason", reason).withColumn("publishable", F.col("reason").isNull()).drop("__version")


def publishable(sessions: DataFrame, consent: DataFrame, coverage: Sequence[tuple[str, bool]] = fixed.CONSENT_VERSIONS) -> tuple[DataFrame, DataFrame]:
    """(sessions that may be released, excluded sessions with their reason)."""
    joined = consent_join(sessions, consent, coverage)
    kept = joined.filter("publishable").select(*sessions.columns)
    return kept, joined.filter(~F.col("publishable")).select("session_id", "family", "reason")


def check_manifest(rows: DataFrame) -> DataFrame:
    """Manifest rows with the default framework filled in and `violation` (null when fine)."""
    subtype = F.coalesce("benign_subtype", F.lit(""))
    fault = (
        F.when(~F.coalesce("class", F.lit("")).isin(fixed.CAMPAIGN_CLASSES), "unknown class")
        .when(~subtype.isin(fixed.BENIGN_SUBTYPES), "unknown benign_subtype")
        .when((F.col("class") == "hard_negative") & (subtype == ""), "hard_negative without benign_subtype")
    )
    given = C.blank_to_null(F.col("framework"))
    default = F.when(F.col("generator").isin(fixed.FRAMEWORKS), F.col("generator")).otherwise("manual")
    return rows.withColumn("framework", F.coalesce(given, default)).withColumn("violation", fault)


def split_for(mode: str, splits: DataFrame, wanted: Sequence[str] | None = None) -> DataFrame:
    """Rows of the splits a mode may read; asking for another split is an error."""
    if mode not in fixed.SPLIT_ACCESS:
        raise ValueError(f"unknown mode {mode!r}, expected one of {sorted(fixed.SPLIT_ACCESS)}")
    allowed = fixed.SPLIT_ACCESS[mode]
    refused = [w for w in (wanted or []) if w not in allowed]
    if refused:
        raise PermissionError(f"mode {mode!r} may not read {refused}")
    return splits.filter(F.col("split").isin(list(wanted or allowed)))
