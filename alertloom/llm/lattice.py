"""Document likelihood: a subword lattice behind discounted word counts, summed over all segmentations."""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.llm.common import documents, in_batches, stage

KNOWN_WORDS = 1 << 17
WORD_ROWS = 8192
PASSES = 1
LOG10 = math.log(10)
SPACE = "▁"


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(maxsize=2)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def as_text(words) -> pa.Array:
    return pa.array(list(words), pa.binary()).cast(pa.string())


class Lattice:
    """log probability of words under pieces drawn one after the other: the first from those that start a word, each later
    one from the rest, with a fixed chance to go on. A character without a piece is its bytes. Over all words the
    probabilities sum to at most 1. counts: the weight of each piece, by its number in the vocabulary."""

    def __init__(self, pieces: list[str], counts: np.ndarray, go: float):
        starts = np.array([p.startswith(SPACE) and SPACE not in p[1:] for p in pieces])
        inner = np.array([SPACE not in p and p not in ("<s>", "</s>", "<unk>") for p in pieces])
        self.weight = np.full(len(pieces), -np.inf)
        for side in (starts, inner):
            self.weight[side] = np.log((counts[side] + 0.01) / (counts[side] + 0.01).sum())
        self.go, self.stop = math.log(go), math.log(1 - go)
        numbers = {p: i for i, p in enumerate(pieces)}
        self.bytes = [numbers[f"<0x{b:02X}>"] for b in range(256)]
        self.first = with_prefixes({p[1:]: i for p, i in numbers.items() if starts[i]})
        self.rest = with_prefixes({p: i for p, i in numbers.items() if inner[i] and i not in set(self.bytes)})

    def arcs(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """word, from node, to node (0: before the word, k + 1: after k characters), log weight, piece (-1: bytes), where pieces may lie."""
        word, low, high, cost, piece = [], [], [], [], []

        def add(k, i, j, c, p):
            word.append(k), low.append(i), high.append(j), cost.append(c), piece.append(p)

        for k, w in enumerate(words):
            n = len(w)
            for j in range(n + 1):
                if (p := self.first.get(w[:j])) is None:
                    break
                if p >= 0:
                    add(k, 0, j + 1, 0.0, p)
            for i in range(n):
                alone = True
                for j in range(i + 1, n + 1):
                    if (p := self.rest.get(w[i:j])) is None:
                        break
                    if p >= 0:
                        add(k, i + 1, j + 1, self.go, p)
                        alone &= j > i + 1
                if alone:
                    raw = w[i].encode("utf-8", "replace")
                    add(k, i + 1, i + 2, len(raw) * self.go + sum(self.weight[self.bytes[b]] for b in raw), -1)
        piece = np.array(piece, np.int64)
        weights = np.array(cost) + np.where(piece >= 0, self.weight[piece], 0.0)
        return np.array(word, np.int64), np.array(low, np.int64), np.array(high, np.int64), weights, piece

    def forward(self, words: list[str], arcs=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log probability per word, alpha per node, the words' first nodes): all words advance together, a character at a time."""
        word, low, high, weights, _ = arcs or self.arcs(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        base = np.concatenate([[0], np.cumsum(lengths + 2)])
        alpha = np.full(base[-1], -np.inf)
        alpha[base[:-1]] = 0.0
        sweep(alpha, word, high, base[word] + low, base[word] + high, weights)
        return alpha[base[1:] - 1] + self.stop, alpha, base

    def expected(self, words: list[str]) -> np.ndarray:
        """How often each piece is used in the words, over all segmentations in proportion to their probability."""
        arcs = self.arcs(words)
        word, low, high, weights, piece = arcs
        total, alpha, base = self.forward(words, arcs)
        beta = np.full(base[-1], -np.inf)
        beta[base[1:] - 1] = 0.0
        sweep(beta, word, -low, base[word] + high, base[word] + low, weights)
        used = np.exp(alpha[base[word] + low] + weights + beta[base[word] + high] - (total - self.stop)[word])
        return np.bincount(piece[piece >= 0], used[piece >= 0], minlength=len(self.weight))


def with_prefixes(pieces: dict[str, int]) -> dict[str, int]:
    """The pieces, and -1 for what only begins one, so that a search can stop early."""
    return {p[:k]: -1 for p in pieces for k in range(len(p))} | pieces


def sweep(sums: np.ndarray, word: np.ndarray, stage_of: np.ndarray, source: np.ndarray, target: np.ndarray, weights: np.ndarray) -> None:
    """Add up, in log space, what reaches each target node; stages in order, so that the sources are done before."""
    order = np.lexsort((word, stage_of))
    edges = np.flatnonzero(np.diff(stage_of[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            to = target[part]
            heads = np.concatenate([[0], np.flatnonzero(np.diff(to)) + 1])
            sums[to[heads]] = np.logaddexp.reduceat(sums[source[part]] + weights[part], heads)


def piece_counts(words: DataFrame, path: str, passes: int) -> tuple[np.ndarray, float]:
    """Weights of the vocabulary's pieces, and the chance to go on, from all different words of the column `token`: first the
    file's own segmentation, then `passes` rounds of expectation over all segmentations. Each task sends one row per piece."""
    sp = processor(path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    counts, go = None, 0.5
    for _ in range(passes + 1):
        shared = words.sparkSession.sparkContext.broadcast((counts, go))
        found = dict(words.mapInArrow(_count_pieces(pieces, path, shared), "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect())
        n = found.pop(-1, 0.0)
        counts = np.zeros(len(pieces))
        for piece, used in found.items():
            counts[piece] = used
        go = min(0.99, max(0.01, 1 - n / counts.sum())) if counts.sum() else 0.5
    return counts, go


def _count_pieces(pieces: list[str], path: str, shared):
    def run(batches):
        counts, go = shared.value
        model = Lattice(pieces, counts, go) if counts is not None else None
        sums, n = np.zeros(len(pieces)), 0
        for batch in batches:
            words = [w for w in batch.column("token").to_pylist() if SPACE not in w]
            n += len(words)
            if model and words:
                sums += model.expected(words)
            elif words:
                ids = processor(path).encode(words, num_threads=1)
                sums += np.bincount(np.fromiter((i for own in ids for i in own), np.int64), minlength=len(pieces))
        if n:
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([*used, -1], pa.int64()), pa.array([*sums[used], float(n)], pa.float64())], ["piece", "n"])

    return run


def vocabulary(rows: DataFrame, path: str, passes: int) -> tuple[DataFrame, dict]:
    """The staged table (token, c, base, logp) of all words of the rows (text, train), and the numbers of the model. c counts training rows."""

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen, learned = Counter(), Counter()
        for text, train in zip(batch.column("text").to_pylist(), batch.column("train").to_pylist()):
            (learned if train else seen).update(tokens(text))
        n = [learned.get(w, 0) for w in learned] + [0] * sum(w not in learned for w in seen)
        return pa.RecordBatch.from_arrays([as_text([*learned, *(w for w in seen if w not in learned)]), pa.array(n, pa.int64())], ["token", "c"])

    counts = stage(in_batches(rows, count, "token string, c bigint").groupBy("token").agg(F.sum("c").alias("c")), "counts")
    words = counts.where("c > 0").agg(F.sum("c"), F.count("*"), F.sum((F.col("c") == 1).cast("long")), F.sum((F.col("c") == 2).cast("long"))).first()
    ends = rows.where("train").count()
    total, kinds, once, twice = (int(x or 0) for x in words)
    facts = {"N": total + ends, "V": kinds + (ends > 0), "ends": ends, "discount": once / (once + 2 * twice) if twice else 0.5}
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(WORD_ROWS))
    used, facts["go"] = piece_counts(counts.where("c > 0").select("token"), path, passes)
    facts["spare"] = facts["discount"] * kinds / max(1, total) if total else 1.0
    facts["end"] = ends / facts["N"] if ends else 0.5
    shared = rows.sparkSession.sparkContext.broadcast(used)
    built = []

    def weigh(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not built:
            sp = processor(path)
            built.append(Lattice([sp.id_to_piece(i) for i in range(sp.get_piece_size())], shared.value, facts["go"]))
        logs = built[0].forward(batch.column("token").to_pylist())[0]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], ["token", "c", "lattice"])

    weighed = in_batches(counts, weigh, "token string, c bigint, lattice double", WORD_ROWS)
    base = F.log10((F.col("c") + 0.5) / (facts["N"] + 0.5 * (facts["V"] + 1)))
    seen = F.greatest(F.col("c") - facts["discount"], F.lit(0.0)) / max(1, total)
    inner = F.log(F.lit(facts["spare"])) + F.col("lattice")
    most = F.greatest(inner, F.when(seen > 0, F.log(seen)))
    logp = most + F.log(F.exp(inner - most) + F.when(seen > 0, F.exp(F.log(seen) - most)).otherwise(0.0)) + math.log(1 - facts["end"])
    return stage(weighed.select("token", "c", base.alias("base"), (logp / LOG10).alias("logp")), "words"), facts


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The words above a count, as low as leaves at most `most` of them. Counts are grouped by eighths of a power of two, so the driver
    sees a few hundred totals, and no task sends more than its share of the words."""
    level = F.floor(F.log2("c") * 8)
    sizes = {r["level"]: r["count"] for r in words.where("c > 0").groupBy(level.alias("level")).count().collect()}
    least, taken = max(sizes, default=0) + 1, 0
    for k in sorted(sizes, reverse=True):
        taken += sizes[k]
        if taken > most:
            break
        least = k
    return words.where((F.col("c") > 0) & (level >= least))


def score_documents(docs: DataFrame, path: str | None = None, passes: int = PASSES) -> DataFrame:
    """docs: doc_id, text (null counts as empty) and train (boolean; rows with true are learned from). One row per document:
    doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    The model draws words and one end per text: an end as often as texts end; a word from its discounted count or, with
    the mass taken from the counts, from the lattice of all its segmentations into pieces of the existing vocabulary. The
    file's scores are merge ranks, so the pieces are weighted by their use in the different training words, by expectation over
    all segmentations. All log10.

    The KNOWN_WORDS most frequent words are looked up in a broadcast of that size; the others are joined, and of
    these no word has much over 1/KNOWN_WORDS of all rows. Rows are told apart by a number given when they are staged, so that
    missing or repeated ids do no harm. Without training rows every word comes from the lattice alone."""
    path = path or model_file()
    rows = documents(docs, "train")
    words, facts = vocabulary(rows, path, passes)
    top = frequent(words, KNOWN_WORDS).toPandas()
    shared = rows.sparkSession.sparkContext.broadcast((top["token"].tolist(), top["c"].to_numpy() > 0, top["base"].to_numpy(), top["logp"].to_numpy()))
    built = {}

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not built:
            built.update({w.encode(): i for i, w in enumerate(shared.value[0])})
        _, known, base, logp = shared.value
        sums, rest, times = [], [], []
        for text in batch.column("text").to_pylist():
            own = tokens(text)
            at = np.fromiter((built.get(w, -1) for w in own), np.int64, len(own))
            rare = Counter(w for w, k in zip(own, at.tolist()) if k < 0)
            at = at[at >= 0]
            sums.append((len(own) + 1, int(known[at].sum()), float(base[at].sum()), float(logp[at].sum())))
            rest.append(rare)
            times.append(len(rare))
        edges = pa.array(np.cumsum([0, *times]), pa.int32())
        listed = pa.ListArray.from_arrays(edges, as_text(w for r in rest for w in r))
        counts = pa.ListArray.from_arrays(edges, pa.array([n for r in rest for n in r.values()], pa.int32()))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("train"), *(pa.array(c, k) for c, k in zip(zip(*sums), kinds)), listed, counts],
            ["doc_id", "train", "n_tokens", "known", "base", "logp", "words", "times"],
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, train boolean, n_tokens bigint, known bigint, base double, logp double, words array<string>, times array<int>"
    cut = stage(in_batches(rows, split, schema).withColumn("row", F.monotonically_increasing_id()), "rows")
    rare = cut.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("token"), F.col("w.times").alias("n"))
    sums = rare.join(words, "token").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known2"), F.sum(F.col("n") * F.col("base")).alias("base2"), F.sum(F.col("n") * F.col("logp")).alias("logp2")
    )
    end_base = math.log10((facts["ends"] + 0.5) / (facts["N"] + 0.5 * (facts["V"] + 1)))
    whole = cut.drop("words", "times").join(sums, "row", "left").na.fill(0, ["known2", "base2", "logp2"])
    return whole.select(
        "doc_id", "train", "n_tokens", (F.col("known") + F.col("known2") + (1 if facts["ends"] else 0)).cast("long").alias("n_known"),
        F.lit(facts["N"]).cast("long").alias("train_tokens"), (F.col("base") + F.col("base2") + end_base).alias("base_score"),
        (F.col("logp") + F.col("logp2") + math.log10(facts["end"])).alias("score"),
    )
