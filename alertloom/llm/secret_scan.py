"""Secret scan: candidate strings, and a random forest that removes false findings. DataFrame operations and Spark's own forest only."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import stage

CANDIDATE = r"[A-Za-z0-9+/=_\-]{16,}"
SPACES = r"[\x20\x09-\x0D]+"
DICTIONARY_WORDS = 1000
SAMPLE_ROWS = 50_000
TREES = 40
DEPTH = 8
THRESHOLD = 0.5
#: Words that stand before an assigned credential.
KEYWORDS = "token|secret|passw|pwd|key|auth|credential|bearer|private"
#: Words in paths that hold examples rather than live values.
EXAMPLES = "test|example|sample|fixture|mock|doc|readme"

FEATURES = [
    "length", "digit_share", "upper_share", "lower_share", "hex_share", "distinct_share", "transitions", "letter_digit", "digit_letter", "letter_letter",
    "digit_digit", "coverage", "path_length", "path_example", "path_digits", "quoted", "after_assignment", "keyword_before",
    "keyword_near", "before_length", "after_length", "before_letters",
]


def candidates(docs: DataFrame, path: str) -> DataFrame:
    """One row per candidate: doc_id, at (number of the word), run (number of the run in it), candidate, path, quoted, before2,
    before1, after1.

    A candidate is a run of 16 or more letters, digits and + / = _ - with a digit in it, in a word of the text (words are
    split at ASCII white space; a word may hold several). Its neighbours are what stands beside it in its word, together with
    the run before or after that, without the quotes around it; else the words beside. Missing neighbours are empty."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"))
    plain = plain.where(F.col("text").rlike(CANDIDATE))
    words = plain.select("doc_id", "path", F.split("text", SPACES).alias("w"))
    hits = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (F.length(F.col("w")[i]) >= 16) & F.col("w")[i].rlike(CANDIDATE) & F.col("w")[i].rlike("[0-9]"))
    near = lambda k: F.coalesce(F.get("w", F.col("at") + k), F.lit(""))
    rows = words.select("doc_id", "path", "w", F.explode(hits).alias("at"))
    rows = rows.select("doc_id", "path", "at", F.col("w")[F.col("at")].alias("word"), near(-2).alias("before2"), near(-1).alias("before1"), near(1).alias("after1"))
    rows = rows.select("*", F.regexp_extract_all("word", F.lit(CANDIDATE), 0).alias("runs"), F.split("word", CANDIDATE).alias("gaps")).drop("w", "word")
    text = lambda name, k: F.coalesce(F.get(F.col(name), k), F.lit(""))
    run = lambda k: F.struct(
        k.alias("run"), F.col("runs")[k].alias("candidate"), text("gaps", k).rlike("[\"'`]$").alias("quoted"),
        F.concat(text("runs", k - 1), F.regexp_replace(text("gaps", k), "[\"'`]+$", "")).alias("left"),
        F.concat(F.regexp_replace(text("gaps", k + 1), "^[\"'`]+", ""), text("runs", k + 1)).alias("right"),
    )
    every = F.filter(F.transform(F.sequence(F.lit(0), F.size("runs") - 1), run), lambda r: r["candidate"].rlike("[0-9]"))
    rows = rows.where(F.size("runs") > 0).select("doc_id", "path", "at", "before2", "before1", "after1", F.explode(every).alias("own"))
    inside, follows = F.col("own.left").rlike(r"[\p{L}\p{N}=:]"), F.col("own.right").rlike(r"[\p{L}\p{N}]")
    return rows.select(
        "doc_id", "path", "at", "own.run", "own.candidate", "own.quoted", F.when(inside, F.col("before1")).otherwise(F.col("before2")).alias("before2"),
        F.when(inside, F.col("own.left")).otherwise(F.col("before1")).alias("before1"), F.when(follows, F.col("own.right")).otherwise(F.col("after1")).alias("after1"),
    )


def dictionary(docs: DataFrame, size: int = DICTIONARY_WORDS) -> list[str]:
    """The `size` most frequent words of four or more letters, counted over all texts."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where(F.length("w") >= 4)
    return sorted(r["w"] for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect())


def features(found: DataFrame, words: list[str]) -> DataFrame:
    """The candidates with the columns FEATURES, all doubles without nulls."""
    c, n = F.col("candidate"), F.length("candidate")
    count = lambda pattern: F.regexp_count(c, F.lit(pattern))
    share = lambda pattern: count(pattern) / n
    pairs = n - 1
    known = F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")
    hidden = F.lower(c)
    covered = F.aggregate(F.filter(known, lambda w: F.contains(hidden, w)), F.lit(0), lambda s, w: s + F.length(w))
    near = F.lower(F.concat_ws(" ", "before2", "before1"))
    made = {
        "length": n, "digit_share": share("[0-9]"), "upper_share": share("[A-Z]"), "lower_share": share("[a-z]"), "hex_share": share("[0-9a-fA-F]"),
        "distinct_share": F.size(F.array_distinct(F.split(c, ""))) / n,
        "transitions": count("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])") / pairs,
        "letter_digit": count("(?<=[A-Za-z])(?=[0-9])") / pairs, "digit_letter": count("(?<=[0-9])(?=[A-Za-z])") / pairs,
        "letter_letter": count("(?<=[A-Za-z])(?=[A-Za-z])") / pairs, "digit_digit": count("(?<=[0-9])(?=[0-9])") / pairs,
        "coverage": F.least(covered / n, F.lit(1.0)), "path_length": F.length("path"), "path_example": F.lower("path").rlike(EXAMPLES),
        "path_digits": F.regexp_count("path", F.lit("[0-9]")), "quoted": F.col("quoted"), "after_assignment": F.col("before1").rlike("[=:]$"),
        "keyword_before": F.lower("before1").rlike(KEYWORDS), "keyword_near": near.rlike(KEYWORDS), "before_length": F.length("before1"),
        "after_length": F.length("after1"), "before_letters": F.regexp_count("before1", F.lit(r"\p{L}")),
    }
    return found.withColumns({k: v.cast("double") for k, v in made.items()})


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """The forest, from labelled findings: FEATURES and `label` (0 or 1; rows with null are left out). At most `sample_rows` of
    them, in the order of a hash of their features. Null with no findings; with one kind of label, a forest that always says it."""
    known = labelled.where("label is not null").select(*FEATURES, F.col("label").cast("double").alias("label"))
    sample = stage(known.orderBy(F.xxhash64(*FEATURES, "label")).limit(sample_rows), "findings")
    if not sample.limit(1).count():
        return None
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=4, subsamplingRate=0.8)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]).fit(sample)


def scan(found: DataFrame, model) -> DataFrame:
    """Findings with their probability: doc_id, at, run, length, candidate_sha256 (the string itself is not repeated), probability, is_secret.

    Without a model every candidate stays a finding. Repeated rows give repeated findings; texts that are null or empty,
    and an empty table, give none; rows without a doc_id are scanned too."""
    if model is None:
        scored = found.withColumn("probability", F.lit(1.0))
    else:
        scored = model.transform(found)
        kinds = model.stages[-1].numClasses
        scored = scored.withColumn("probability", vector_to_array("probability")[1] if kinds > 1 else F.lit(0.0))
    return scored.select(
        "doc_id", "at", "run", F.col("length").cast("int").alias("length"), F.sha2("candidate", 256).alias("candidate_sha256"), "probability", (F.col("probability") >= THRESHOLD).alias("is_secret")
    )
