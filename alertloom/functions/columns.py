"""Column functions: time, text, hashing, user agents, labels, cost. All are built-in
Spark expressions; the two blake2b forms are Arrow UDFs and used only on request."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom import fixed


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def blank_to_null(column: Column) -> Column:
    return F.nullif(column.cast("string"), F.lit(""))


def pick(df: DataFrame, names: Sequence[str]) -> str | None:
    """The first candidate that is a column of the table (a choice per table, not per row)."""
    return next((n for n in names if n in df.columns), None)


def quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def to_unix(df: DataFrame, name: str) -> Column:
    """Unix seconds: numbers stay as they are, timestamps and ISO text are read as UTC,
    text that is no timestamp becomes null."""
    kind = df.schema[name].dataType
    column = quoted(name)
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, T.StringType):
        column = F.try_to_timestamp(column)
    return F.unix_micros(column.cast("timestamp")) / F.lit(1e6)


def to_unix_ms_aware(column: Column) -> Column:
    """Unix seconds from a number, milliseconds when above 1e12 (decided per value)."""
    v = column.cast("double")
    return F.when(v > 1e12, v / 1000.0).otherwise(v)


def text_to_unix(column: Column) -> Column:
    """Unix seconds from JSON text: a number (seconds or milliseconds) or an ISO time."""
    number = column.try_cast("double")
    iso = F.unix_micros(F.try_to_timestamp(column)) / F.lit(1e6)
    return F.coalesce(to_unix_ms_aware(number), iso)


def utc_day(ts: Column) -> Column:
    """UTC date of unix seconds; missing or non-positive times fall in 'unknown'."""
    return F.when(ts > 0, F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd")).otherwise(F.lit("unknown"))


def action_of(channel: Column, event_id: Column) -> Column:
    """(channel, event id) -> action name, with numbered names for unknown ids."""
    eid = event_id.cast("string").try_cast("double").cast("int")
    source = F.lower(F.coalesce(channel.cast("string"), F.lit("")))
    sysmon, security = literal_map(fixed.SYSMON_ACTIONS), literal_map(fixed.SECURITY_ACTIONS)
    number = eid.cast("string")
    named = (
        F.when(source.contains("sysmon"), F.coalesce(sysmon[eid], F.concat(F.lit("sysmon_"), number)))
        .when(source.contains("security"), F.coalesce(security[eid], F.concat(F.lit("security_"), number)))
        .otherwise(F.coalesce(sysmon[eid], security[eid], F.concat(F.lit("event_"), number)))
    )
    return F.when(eid.isNull(), F.lit("unknown")).otherwise(named)


def event_id_number(column: Column) -> Column:
    """Event id as a number, -1 where it cannot be read."""
    return F.coalesce(column.cast("string").try_cast("double").cast("int"), F.lit(-1))


def target_of(df: DataFrame, host: Column) -> Column:
    """The first filled target field of the event, else its host."""
    fields = [blank_to_null(quoted(n)) for n in fixed.TARGET_FIELDS if n in df.columns]
    return F.coalesce(*fields, host.cast("string"), F.lit("unknown"))


def tactic_of(technique: Column) -> Column:
    """ATT&CK technique or sub-technique id -> tactic, '' outside the vocabulary."""
    base = F.substring_index(F.trim(technique.cast("string")), ".", 1)
    return F.coalesce(literal_map(fixed.TECHNIQUE_TACTIC)[base], F.lit(""))


def safe_log1p(column: Column) -> Column:
    v = F.coalesce(column.cast("double"), F.lit(0.0))
    return F.log1p(F.greatest(F.lit(0.0), F.when(F.isnan(v), 0.0).otherwise(v)))


@F.pandas_udf(T.LongType())
def blake2b_number(texts: pd.Series) -> pd.Series:
    return texts.map(lambda s: int.from_bytes(hashlib.blake2b((s or "").encode(), digest_size=4).digest(), "big"))


def path_bucket(path: Column, buckets: int = 16, exact: bool = False) -> Column:
    """Path hashed to `buckets` values in [0, 1). The default digest is built in; `exact`
    takes the blake2b digest for features that must equal an older table's."""
    text = F.coalesce(path, F.lit(""))
    number = blake2b_number(text) if exact else F.conv(F.substring(F.sha2(text, 256), 57, 8), 16, 10).cast("long")
    return (number % buckets) / F.lit(float(buckets))


def hex_norm(column: Column) -> Column:
    """Hex text as a share of 16^8; longer text gives more than 1, anything that is not hex 0."""
    ok = column.rlike("^[0-9a-fA-F]+$")
    return F.when(ok, F.conv(column, 16, 10).cast("double") / F.lit(float(16**8))).otherwise(F.lit(0.0))


def ua_score(ua: Column) -> Column:
    text = F.coalesce(ua, F.lit(""))
    return (
        F.when(text == "", 0.0)
        .when(text.contains("Chrome") | text.contains("Chromium"), 1.0)
        .when(text.contains("Mozilla"), 0.6)
        .when(text.contains("curl") | F.lower(text).contains("python") | text.contains("wget"), 0.3)
        .otherwise(0.1)
    )


def ua_bucket(ua: Column) -> Column:
    """Coarse browser and device bucket, the only user-agent value kept for people."""
    text = F.coalesce(ua, F.lit(""))
    device = F.when(text.rlike(fixed.UA_MOBILE), "mobile").otherwise("desktop")
    return (
        F.when(text.rlike(fixed.UA_FIREFOX), F.concat(F.lit("firefox-"), device))
        .when(text.rlike(fixed.UA_CHROMIUM), F.concat(F.lit("chrome-"), device))
        .when(text.rlike(fixed.UA_SAFARI), F.concat(F.lit("safari-"), device))
        .otherwise("other")
    )


def ua_hash(ua: Column) -> Column:
    return F.substring(F.sha1(F.coalesce(ua, F.lit(""))), 1, 8)


def header_set_hash(headers: Column) -> Column:
    """8 hex digits for the set of header names, order and letter case aside."""
    names = F.array_sort(F.array_distinct(F.transform(F.map_keys(headers), F.lower)))
    return F.substring(F.sha1(F.concat_ws(",", names)), 1, 8)


def class_of(src_label: Column) -> Column:
    return (
        F.when(src_label.isin(fixed.AGENT_LABELS), "agent")
        .when(src_label.isin(fixed.BENIGN_BOT_LABELS), "benign_bot")
        .when(src_label.isin(fixed.HUMAN_LABELS), "human")
        .otherwise("unknown")
    )


def backend_of(family: Column) -> Column:
    """Backend part of an agent family name, null for other families."""
    return blank_to_null(F.regexp_extract(family, fixed.BACKEND_FAMILY, 1))


def model_slug_of(family: Column) -> Column:
    return blank_to_null(F.regexp_extract(family, fixed.BACKEND_FAMILY, 2))


def super_family(family: Column) -> Column:
    """Backend for agent families named by backend and model, else the family itself."""
    return F.coalesce(backend_of(family), family, F.lit(""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def family_name(backend: Column, model: Column) -> Column:
    return F.concat(F.lit("llm_"), slug(backend), F.lit("_"), slug(model))


def config_sha(config: dict[str, Column], exact: bool = False) -> Column:
    """8 hex digits for a configuration: its JSON with sorted keys, hashed."""
    body = F.to_json(F.struct(*[config[k].alias(k) for k in sorted(config)]), {"ignoreNullFields": "false"})
    if exact:
        return F.lpad(F.lower(F.hex(blake2b_number(body))), 8, "0")
    return F.substring(F.sha2(body, 256), 1, 8)


def cost_cents(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Cents from tokens and cents per million; null where no price is known."""
    return (tokens_in * price_in + tokens_out * price_out) / F.lit(1_000_000.0)


def alerts_per_hour(rate: Column, mean_minutes: Column) -> Column:
    return rate * 60.0 / mean_minutes


def sorted_ids_sha256(ids: Column) -> Column:
    """sha256 of the sorted ids, one per line; the checksum a split file carries."""
    return F.sha2(F.array_join(F.array_sort(ids), "\n"), 256)
