"""Language ID, likelihood, quality, secrets, packing, decontamination and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from alertloom.llm import language, lattice, leaks, packing, quality, queries, secret_scan
from plain import TEXTS, awkward, shingle_set, union

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op1_language_id"](spark, SF).join(docs, "doc_id").where("held_out").toPandas()
    assert len(found) > 200 and (found["lang"] == found["lang_pred"]).mean() > 0.98
    assert found["score"].between(0, 1).all()


def test_language_of_awkward_rows(spark):
    docs = awkward(spark, TEXTS)
    model = language.learn(docs.select("text", "lang"))
    found = language.predict(docs, model).select("doc_id", "lang_pred", "score", "coverage").collect()
    assert len(found) == len(TEXTS)
    letters = Counter((i, any(c.isalpha() for c in t or "")) for i, t in TEXTS)
    assert Counter((r["doc_id"], r["lang_pred"] != "und") for r in found) == letters
    assert language.predict(docs.limit(0), model).count() == 0
    nothing = language.learn(docs.where("lang = 'none'").select("text", "lang"))
    assert {r["lang_pred"] for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.accepted(docs, model, 0.2).columns == docs.columns


def segmentations(word, first, rest, go):
    """Total probability over all ways to write the word."""
    def tail(i):
        return 1.0 if i == len(word) else sum(go * rest[word[i:j]] * tail(j) for j in range(i + 1, len(word) + 1) if word[i:j] in rest)

    return (1 - go) * sum(first[word[:k]] * tail(k) for k in range(len(word) + 1) if word[:k] in first)


def test_lattice_sums_all_segmentations():
    pieces = [f"<0x{b:02X}>" for b in range(256)] + ["▁", "▁a", "▁ab", "a", "b", "ab", "ba", "c"]
    counts = np.array([1.0] * 256 + [3, 2, 5, 1, 2, 4, 1, 2])
    model = lattice.Lattice(pieces, counts, 0.4)
    first = {p[1:]: math.exp(model.weight[i]) for i, p in enumerate(pieces) if p.startswith("▁")}
    rest = {p: math.exp(model.weight[i]) for i, p in enumerate(pieces) if i >= 259}
    words = ["", "a", "ab", "abab", "cab", "ababbabac", "b"]
    got = model.forward(words)[0]
    assert np.allclose(np.exp(got), [segmentations(w, first, rest, 0.4) for w in words])
    assert np.isfinite(model.forward(["aé日"])[0]).all()
    used = model.expected(["ab"])
    whole = segmentations("ab", first, rest, 0.4)
    assert math.isclose(used[258], 0.6 * first["ab"] / whole) and math.isclose(used[260], 0.6 * 0.4 * (first["a"] + first[""] * 0.4 * rest["a"]) * rest["b"] / whole)


def test_likelihood_of_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(lattice, "KNOWN_WORDS", 2)
    docs = awkward(spark, TEXTS).withColumn("train", F.expr("doc_id is null or doc_id % 2 = 1"))
    found = lattice.score_documents(docs).collect()
    own = [lattice.tokens(t or "") for i, t in TEXTS if i is None or i % 2]
    counts = Counter(w for ws in own for w in ws)
    n, v = sum(counts.values()) + len(own), len(counts) + 1
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    expected = []
    for i, t in TEXTS:
        ws = lattice.tokens(t or "")
        expected.append((i, len(ws) + 1, sum(w in counts for w in ws) + 1, n, round(sum(base(counts[w]) for w in ws) + base(len(own)), 6)))
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)


def test_likelihood_without_training_rows(spark):
    docs = awkward(spark, TEXTS)
    found = lattice.score_documents(docs.withColumn("train", F.lit(False))).collect()
    assert len(found) == len(TEXTS) and all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in found)
    assert lattice.score_documents(docs.limit(0).withColumn("train", F.lit(True))).count() == 0


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.QUERIES["op8_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = (found.loc[found["quality"] == k, "score"].to_numpy() for k in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert ((found["score"] >= 0.7).astype(int) == found["predicted"]).all()


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark, TEXTS)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 1), (11, 0, 0), (10, 1, 0)], "doc_id bigint, quality int, toxic int")
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = quality.score_documents(plain, quality.fit(plain, labels)).collect()
    assert len(found) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["score"] for r in quality.score_documents(plain, quality.fit(plain, labels.limit(0))).collect()} == {0.5}
    assert quality.score_documents(plain.limit(0), None).count() == 0


def test_word_vectors_come_from_all_texts(spark):
    """A word of texts without a label, or outside the sample, has its neighbours in its vector."""
    texts = [(1, "good words here"), (2, "bad words there"), (3, "zebra stripes"), (4, "zebra stripes"), (5, "quagga stripes")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, 1)], "doc_id bigint, quality int")
    vectors, index = quality.fit(docs, labels, sample_rows=2)[0], quality.index_vectors()
    own, beside = (quality.bucket(w) for w in ("zebra", "stripes"))
    assert np.allclose(vectors[own], index[own] + 4 * index[beside])
    assert np.allclose(vectors[beside], index[beside] + 4 * (2 * index[own] + index[quality.bucket("quagga")]) / 3)


def test_secrets(spark):
    rng = random.Random(6)
    texts = list(TEXTS)
    for k in range(40):
        texts.append((100 + k, f'some words token = "{rng.getrandbits(160):040x}" and more'))
        texts.append((200 + k, f"card {rng.randrange(10**15, 10**16)} and id {rng.getrandbits(128):032x} here"))
    found = secret_scan.features(secret_scan.candidates(awkward(spark, texts), "source"), ["words", "more"])
    labelled = found.withColumn("label", F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") < 200).cast("int")))
    got = {(r["doc_id"], r["length"]): r["is_secret"] for r in secret_scan.scan(found, secret_scan.fit(labelled)).collect()}
    assert all(got[100 + k, 40] for k in range(40)) and not any(got[200 + k, n] for k in range(40) for n in (16, 32))
    assert all(r["is_secret"] for r in secret_scan.scan(found, secret_scan.fit(labelled.limit(0))).collect())
    assert not any(r["is_secret"] for r in secret_scan.scan(found, secret_scan.fit(labelled.where("label = 0"))).collect())
    assert secret_scan.candidates(awkward(spark, TEXTS), "source").count() == 0


def test_several_secrets_in_one_word(spark):
    rng = random.Random(16)
    a, b, c, path = f"{rng.getrandbits(128):032x}", f"{rng.getrandbits(160):040x}", f"{rng.getrandbits(80):020x}", "a/long/path/without/harm/and/with/2/digits/in/it/2"
    texts = [
        (1, f'x {{"id":"{a}","my_long_variable_key="{b}","path":"{path}"}} y'), (2, f"{a},{b},{c}"), (3, f"u token = '{a}' v"), (4, f"/get?k:{c}&p:{a}"),
    ]
    found = secret_scan.candidates(awkward(spark, texts), "source").collect()
    got = {(r["doc_id"], r["candidate"]): (r["at"], r["run"], r["quoted"], r["before2"], r["before1"], r["after1"]) for r in found}
    assert len(found) == len(got) == 9
    assert got[1, a] == (1, 0, True, "x", '{"id":', ",\"my_long_variable_key=") and got[1, path][2]
    assert got[1, b][1:5] == (2, True, "x", "my_long_variable_key=")
    assert {k: v[1] for k, v in got.items() if k[0] == 2} == {(2, a): 0, (2, b): 1, (2, c): 2}
    assert got[3, a] == (3, 0, True, "token", "=", "v") and {(4, c), (4, a)} <= set(got)
    scored = secret_scan.scan(secret_scan.features(secret_scan.candidates(awkward(spark, texts), "source"), []), None)
    assert scored.select("doc_id", "at", "run").distinct().count() == 9


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 1024])
    counts = Counter(rng.randint(1, capacity) if seed % 2 else min(capacity, int(rng.expovariate(8 / capacity)) + 1) for _ in range(3000))
    made, used = packing.plan(counts, capacity), Counter()
    for times, lengths in made:
        assert sum(lengths) <= capacity and times > 0
        for s in lengths:
            used[s] += times
    assert used == counts
    least = max(-(-sum(s * n for s, n in counts.items()) // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    assert sum(t for t, _ in made) <= least * 1.02 + 1


def test_dominance_keeps_the_optimum():
    """On small instances, the sets that are fixed belong to a best packing."""
    rng = random.Random(9)

    def best(items, capacity):
        least = len(items)

        def place(k, rooms):
            nonlocal least
            if len(rooms) >= least:
                return
            if k == len(items):
                least = len(rooms)
                return
            for r in sorted(set(rooms)):
                if r >= items[k]:
                    place(k + 1, [*rooms[: rooms.index(r)], r - items[k], *rooms[rooms.index(r) + 1 :]])
            place(k + 1, [*rooms, capacity - items[k]])

        place(0, [])
        return least

    for _ in range(60):
        items = sorted((rng.randint(2, 18) for _ in range(9)), reverse=True)
        left = dict(Counter(items))
        fixed = packing.reduce_by_dominance(left, 20)
        rest = sorted(Counter(left).elements(), reverse=True)
        assert sum(t for t, _ in fixed) + best(rest, 20) == best(items, 20)


@pytest.mark.parametrize("capacity", [16, 1024])
def test_packing(spark, capacity):
    texts = [*TEXTS, (70, "text with <|endoftext|> inside")]
    found = packing.pack(awkward(spark, texts), capacity).toPandas()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    expected = Counter()
    for (i, _), x in zip(texts, whole.encode_batch([t or "" for _, t in texts], add_special_tokens=False)):
        ids = np.array([*x.ids, 2], "<u4")
        for piece, (start, length) in enumerate(packing.cuts(len(ids), capacity)):
            expected[i, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    got = Counter((None if math.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    assert got == expected
    for _, own in found.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= capacity
    assert packing.pack(awkward(spark, TEXTS).limit(0)).count() == 0


def test_packing_of_special_tokens(spark, tmp_path):
    """The query and the pipeline's stage against the tokenizer file as it is."""
    texts = [(1, "text with <|endoftext|> inside"), (2, "<|endoftext|><|endoftext|>"), (3, "<|endoftext |> no"), (4, "plain"), (5, None)]
    docs = awkward(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    whole, expected = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set()
    for i, t in texts:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.add((i, len(ids), zlib.crc32(ids.tobytes())))
    for found in (queries.QUERIES["op6_best_fit_packing"](spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))):
        assert {(r["doc_id"], r["length"], r["ids_crc32"]) for r in found.collect()} == expected


def test_leaks_against_all_windows(spark):
    rng = random.Random(7)
    vocabulary = [f"v{k}" for k in range(30)]
    items = [(k, " ".join(rng.choices(vocabulary, k=rng.choice([2, 4, 8, 30, 60])))) for k in range(12)] + [(50, None), (51, ""), (52, "v1, V2; v3 (v4)")]
    texts = list(TEXTS)
    for k, (_, t) in enumerate(items):
        words = (t or "").split()
        if len(words) > 20:
            words[1] = "other"
        around = lambda: " ".join(rng.choices(vocabulary, k=rng.randrange(20)))
        texts += [(100 + k, f"{around()} {' '.join(words)} {around()}"), (200 + k, " ".join(words).upper()), (300 + k, f"{' '.join(words)} {around()} {t}")]
    benchmark = spark.createDataFrame([(i, t, None) for i, t in items], "item_id bigint, text string, doc_id int")
    found = {(r["doc_id"], r["item_id"]): (r["start"], r["n_words"], round(r["similarity"], 9)) for r in leaks.find_leaks(awkward(spark, texts), benchmark).collect()}
    expected = {}
    for i, text in texts:
        tokens = leaks.words(text)
        for item, t in items:
            own = leaks.words(t)
            if not own or not tokens:
                continue
            width, size = min(5, len(own)), min(len(own), len(tokens))
            for start in range(len(tokens) - size + 1):
                s = leaks.similarity(Counter(leaks.shingles(tokens[start : start + size], width)), Counter(leaks.shingles(own, width)))
                if s >= 0.8 and s > expected.get((i, item), (0, 0, 0.0))[2] + 1e-12:
                    expected[i, item] = (start, size, s)
    assert expected and found == {k: (a, b, round(s, 9)) for k, (a, b, s) in expected.items()}
    assert leaks.find_leaks(awkward(spark, texts), benchmark.limit(0)).count() == 0 == leaks.find_leaks(awkward(spark, texts).limit(0), benchmark).count()


def test_pipeline(spark, sf):
    """Each stage against a plain version of it on the rows that its predecessor kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(
        spark.createDataFrame([(None, "", "en", "s", 0), (5000, None, None, None, None), (5001, "123 ...", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    ).repartition(3)
    kept = []
    for name, step in corpus_pipeline.STAGES:
        columns, docs = docs.columns, corpus_pipeline.stage_result(spark, lambda: step(spark, docs, sf), name)
        kept.append((name, docs.toPandas()))
        assert docs.columns == columns or name == "best_fit_packing"
    rows = {name: dict(zip(x["doc_id"].astype(int), x["text"])) for name, x in kept[:-1]}
    first, second, third, fourth = rows.values()
    assert len(first) == kept[0][1].shape[0] == 200 and not {5000, 5001} & set(first)
    largest = {}
    for i, t in first.items():
        largest[t] = max(largest.get(t, i), i)
    assert second == {i: t for t, i in largest.items()}
    sets = {i: shingle_set(t) for i, t in second.items()}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    groups = union(ids, pairs)
    assert len(third) <= len(set(groups.values())) and set(third) <= set(second)
    assert all(min(x for x in ids if groups[x] == groups[i]) == i for i in third)
    items = [leaks.words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {i for i, t in third.items() if any(" ".join(w) in " ".join(leaks.words(t)) for w in items)}
    assert held and set(fourth) <= set(third) - held and len(set(third) - held - set(fourth)) <= 2
    packed = kept[-1][1]
    assert set(packed["doc_id"].astype(int)) == set(fourth) and packed.groupby("sequence_id")["length"].sum().max() <= 1024


def test_every_stage_takes_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, sf)
        assert docs.count() == 0, name


@pytest.mark.parametrize("size", [3, 7, 1 << 15])
def test_sums_of_neighbours_equal_a_loop(monkeypatch, size):
    monkeypatch.setattr(quality, "SLICE", size)
    rng = np.random.default_rng(4)
    index = np.vstack([quality.index_vectors(), np.zeros((1, quality.DIMENSIONS), np.float32)]).astype(np.int8)
    texts = [rng.integers(0, 9, n) for n in (0, 1, 2, 3, 40, 5)]
    places = np.concatenate([np.r_[t, [quality.BUCKETS] * quality.REACH] for t in texts]).astype(np.uint16)
    sums, seen = np.zeros((quality.BUCKETS + 1, quality.DIMENSIONS), np.int64), np.zeros(quality.BUCKETS + 1, np.int64)
    quality.add_neighbours(places, index, sums, seen)
    want, count = np.zeros_like(sums), np.zeros_like(seen)
    for t in texts:
        for i, a in enumerate(t):
            for j in range(max(0, i - quality.REACH), min(len(t), i + quality.REACH + 1)):
                if i != j:
                    want[a] += index[t[j]]
                    count[a] += 1
    assert (sums[: quality.BUCKETS] == want[: quality.BUCKETS]).all() and (seen[: quality.BUCKETS] == count[: quality.BUCKETS]).all()
