"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import documents, in_batches, stage

SAMPLE_ROWS = 8192
BUCKETS = 1 << 14
DIMENSIONS = 64
NONZERO = 6
REACH = 2
#: Places that are summed at a time.
SLICE = 1 << 15
HIDDEN = 32
EPOCHS = 60
THRESHOLD = 0.7
TOKEN = re.compile(r"[^\W\d_]+|\d+|_+|[^\w\s]+")


def tokens(text: str) -> list[str]:
    """Runs of letters, digits and signs; a long or capitalized run of letters is followed by its shape, a line that stood in the text
    before is followed by a mark."""
    out, lines = [], set()
    for line in text.split("\n"):
        for t in TOKEN.findall(line):
            out.append(t)
            if len(t) > 1 and t.isupper():
                out.append("<upper>")
            elif len(t) > 12:
                out.append("<long>")
        if line:
            if line in lines:
                out.append("<again>")
            lines.add(line)
    return out


def bucket(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS


def index_vectors() -> np.ndarray:
    """A sparse ternary vector per bucket: a few +1 and -1 at places drawn from a fixed seed."""
    rng = np.random.default_rng(8)
    out = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for row in out:
        row[rng.choice(DIMENSIONS, NONZERO, replace=False)] = rng.choice([-1.0, 1.0], NONZERO)
    return out


def buckets(words, known: dict) -> list[int]:
    """The words' buckets; `known` remembers those of words seen lately."""
    if len(known) > 1 << 18:
        known.clear()
    at = []
    for t in words:
        if (b := known.get(t)) is None:
            b = known[t] = bucket(t)
        at.append(b)
    return at


def add_neighbours(at: np.ndarray, index: np.ndarray, sums: np.ndarray, seen: np.ndarray) -> None:
    """Add to each bucket the index vectors of the neighbours of its places in `at`, within REACH, and their number. BUCKETS marks a place without a
    word, and has a vector of zeros. Places are taken in slices; in a slice neighbours are summed by shifting it, then places by sorting it once."""
    for low in range(0, len(at), SLICE):
        start, stop = max(0, low - REACH), min(len(at), low + SLICE + REACH)
        part = at[start:stop]
        vectors, there = index[part], (part != BUCKETS).astype(np.int64)
        near, n = np.zeros_like(vectors), np.zeros(len(part), np.int64)
        for reach in range(1, min(REACH, len(part) - 1) + 1):
            near[:-reach] += vectors[reach:]
            near[reach:] += vectors[:-reach]
            n[:-reach] += there[reach:]
            n[reach:] += there[:-reach]
        inner = slice(low - start, low - start + min(SLICE, len(at) - low))
        own = part[inner]
        order = np.argsort(own, kind="stable")
        words, starts = np.unique(own[order], return_index=True)
        sums[words] += np.add.reduceat(near[inner][order], starts, axis=0, dtype=sums.dtype)
        seen[words] += np.add.reduceat(n[inner][order], starts)


def learn_vectors(docs: DataFrame) -> np.ndarray:
    """Context vectors of all texts of docs: a word's is its own index vector plus the mean of its neighbours'. Sums have one row per bucket and task.
    Texts are joined into runs of places, with a gap between them; a very long one is summed in slices like any run."""

    def run(batches):
        index = np.vstack([index_vectors(), np.zeros((1, DIMENSIONS), np.float32)]).astype(np.int8)
        sums, seen, known = np.zeros((BUCKETS + 1, DIMENSIONS), np.int64), np.zeros(BUCKETS + 1, np.int64), {}
        waiting: list[int] = []
        for batch in batches:
            for text in batch.column("text").to_pylist():
                waiting += buckets(tokens(text), known)
                waiting += [BUCKETS] * REACH
                if len(waiting) >= SLICE:
                    add_neighbours(np.array(waiting, np.uint16), index, sums, seen)
                    waiting = []
        if waiting:
            add_neighbours(np.array(waiting, np.uint16), index, sums, seen)
        sums, seen = sums[:BUCKETS], seen[:BUCKETS]
        used = np.flatnonzero(seen)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(seen[used]), pa.array(list(sums[used].astype(np.float32)), pa.list_(pa.float32()))], ["bucket", "n", "sums"]
            )

    parts = docs.select("text").mapInArrow(run, "bucket bigint, n bigint, sums array<float>")
    total = [F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(DIMENSIONS)]
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n"), *total).toPandas()
    out = index_vectors()
    if len(found):
        out[found["bucket"].to_numpy()] += (found[[f"s{k}" for k in range(DIMENSIONS)]].to_numpy() / found[["n"]].to_numpy()).astype(np.float32) * 4
    return out


def pooled(text: str, vectors: np.ndarray, known: dict) -> np.ndarray:
    """Mean word vector of the text, with the logarithm of its length and the share of its commonest words."""
    counts: Counter = Counter(tokens(text))
    total = sum(counts.values())
    if not total:
        return np.zeros(DIMENSIONS + 2, np.float32)
    at = buckets(counts, known)
    weights = np.fromiter(counts.values(), np.float32, len(counts)) / total
    return np.concatenate([weights @ vectors[at], [np.log1p(total) / 10, len(counts) / total]]).astype(np.float32)


def pool_documents(docs: DataFrame, vectors: np.ndarray, finish, kinds: dict) -> DataFrame:
    """Columns of docs but text, and those that finish(pooled vectors) makes; kinds: their names and Arrow types."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    keep = [f for f in docs.schema.fields if f.name != "text"]
    known: dict = {}

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        x = np.stack([pooled(t, shared.value, known) for t in rows.column("text").to_pylist()])
        made = [pa.array(c, k[1]) for c, k in zip(finish(x), kinds.values())]
        return pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in keep), *made], [*(f.name for f in keep), *kinds])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keep] + [f"{n} {k[0]}" for n, k in kinds.items()])
    return in_batches(docs, batch, schema)


class Network:
    """Two layers (tanh, logistic), trained with Adam; a temperature fitted on rows kept aside divides the logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, aside: np.ndarray):
        rng = np.random.default_rng(3)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.scale
        shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), ()]
        self.w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), s) if i in (0, 2) else np.zeros(s) for i, s in enumerate(shapes)]
        self.temperature = 1.0
        m, v, step = [0.0] * 4, [0.0] * 4, 0
        rows = np.flatnonzero(~aside)
        for _ in range(EPOCHS):
            for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 128)):
                step += 1
                hidden = np.tanh(x[part] @ self.w[0] + self.w[1])
                error = (1 / (1 + np.exp(-(hidden @ self.w[2] + self.w[3]))) - y[part]) / max(1, len(part))
                back = np.outer(error, self.w[2]) * (1 - hidden**2)
                for i, g in enumerate((x[part].T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ error + 1e-4 * self.w[2], error.sum())):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.w[i] = self.w[i] - 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if aside.any():
            logits, truth = self.logits(x[aside]), y[aside]
            loss = lambda t: np.logaddexp(0, -np.where(truth > 0, logits, -logits) / t).mean()
            self.temperature = min(np.geomspace(0.25, 8, 61), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits((x - self.mean) / self.scale) / self.temperature, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS):
    """(word vectors, network): the vectors from all docs, labelled or not; the network from at most `sample_rows` labelled
    documents, in the order of a hash of their id.

    docs: doc_id, text; labels: doc_id, quality. Labels that are null are left out; an id with several labels counts as what
    most of them say (1 on a tie). None if there is no labelled document."""
    marks = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    ids = docs.where("doc_id is not null").select("doc_id").join(marks, "doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    ids = F.broadcast(stage(ids, "sample_ids"))
    sample = stage(docs.join(ids, "doc_id").select("doc_id", "text", (F.col("y") >= 0.5).cast("double").alias("y")), "sample")
    vectors = learn_vectors(docs)
    rows = pool_documents(sample, vectors, lambda x: [list(x)], {"x": ("array<float>", pa.list_(pa.float32()))})
    rows = rows.toPandas().sort_values(["doc_id"], kind="stable")
    if not len(rows):
        return None
    x, y = np.stack(rows["x"]).astype(np.float64), rows["y"].to_numpy()
    aside = np.arange(len(y)) % 5 == 4
    return vectors, Network(x, y, aside)


def score_documents(docs: DataFrame, model) -> DataFrame:
    """docs with score (0 to 1, higher: better) and predicted (1 if score >= THRESHOLD) in place of text.

    Null and empty texts are scored like a text without words. Without a model every score is 0.5. Repeated rows, and rows
    without a doc_id, are scored like any other; an empty table gives no rows."""
    vectors, network = model or (np.zeros((BUCKETS, DIMENSIONS), np.float32), None)

    def finish(x: np.ndarray):
        s = network.score(x.astype(np.float64)) if network else np.full(len(x), 0.5)
        return s, (s >= THRESHOLD).astype(np.int32)

    return pool_documents(docs, vectors, finish, {"score": ("double", pa.float64()), "predicted": ("int", pa.int32())})
