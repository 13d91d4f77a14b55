"""Exact, near and substring dedup against plain loops."""

import hashlib
import os
import random
import threading

import numpy as np
import pytest

from alertloom.llm import common, debruijn, exact, simhash, suffixes, windows
from alertloom.session import shared_folder
from plain import TEXTS, awkward, fingerprint, repeats, shingle_set, union


@pytest.mark.parametrize("bits,capacity", [(64, 1 << 16), (64, 2), (2, 1)])
def test_exact_dedup(spark, bits, capacity):
    rows = exact.exact_dedup(awkward(spark, TEXTS), hash_bits=bits, capacity=capacity).collect()
    assert len(rows) == len(TEXTS)
    groups = {}
    for i, text in TEXTS:
        groups.setdefault(text or "", []).append(i)
    expected = []
    for i, text in TEXTS:
        ids = groups[text or ""]
        keep = max((x for x in ids if x is not None), default=None)
        expected.append((i, keep, len(ids), i == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, expected)) == sorted(str(tuple(r)[:5]) for r in rows)


def test_exact_dedup_of_nothing(spark):
    assert exact.exact_dedup(awkward(spark, TEXTS).limit(0)).count() == 0


def test_directory_covers_each_key_once(spark):
    keys = spark.range(5000).select((common.F.xxhash64("id")).alias("h"))
    leaves = exact.directory(keys, capacity=40).collect()
    assert sum(r["n"] for r in leaves) == 5000 and max(r["n"] for r in leaves) <= 40
    assert sum(2.0 ** -r["depth"] for r in leaves) <= 1.0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(7, 7)]
    top = union({x for p in pairs for x in p}, pairs)
    low = {}
    for n, t in top.items():
        low[t] = min(low.get(t, n), n)
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    linked = {n for a, b in pairs if a != b for n in (a, b)}
    assert found == {n: low[top[n]] for n in linked}


def test_anchors_meet_every_close_pair():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    for blocks in (4, 7, 12):
        for flips in range(3):
            close = fps.copy()
            for _ in range(flips):
                close ^= np.uint64(1) << rng.integers(0, 64, len(fps), dtype=np.uint64)
            sent, homes = simhash.anchors(fps, blocks, 2), simhash.anchors(close, blocks, 2)
            assert all(home[0] in own for own, home in zip(sent, homes))
            assert all(len(set(own.tolist())) == len(own) for own in sent)


def near_texts():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(200)]
    base = [" ".join(rng.choices(words, k=rng.choice([3, 40, 300]))) for _ in range(40)]
    texts = list(TEXTS)
    for k, b in enumerate(base):
        texts.append((100 + k, b))
        w = b.split()
        w[len(w) // 2] = "other"
        texts.append((200 + k, " ".join(w)))
        texts.append((300 + k, b.upper()))
    return texts


@pytest.mark.parametrize("block_rows", [1 << 15, 4])
def test_near_duplicates(spark, monkeypatch, block_rows):
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block_rows)
    texts = near_texts()
    fps = [fingerprint(t) for _, t in texts]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    top = union(range(len(fps)), pairs)
    low = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            low[top[k]] = min(low.get(top[k], i), i)
    expected = [(i, fps[k], low.get(top[k])) for k, (i, _) in enumerate(texts)]
    found = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(awkward(spark, texts)).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))


def test_similar_documents(spark):
    texts = [(k, t) for k, (_, t) in enumerate(near_texts())]
    sets, fps = [shingle_set(t) for _, t in texts], [fingerprint(t, 5) for _, t in texts]
    close = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) if sets[a] or sets[b] else True
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2 or close(a, b)]
    top = union(range(len(texts)), pairs)
    low = {}
    for k in range(len(texts)):
        low[top[k]] = min(low.get(top[k], k), k)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(awkward(spark, texts)).collect()}
    assert found == {k: low[top[k]] for k in range(len(texts))}


def linked(texts):
    """The component_id of each text by its place in the list, from whole shingle sets and whole fingerprints."""
    sets, fps = [shingle_set(t) for t in texts], [fingerprint(t, 5) for t in texts]
    close = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2 or close(a, b)]
    top, low = union(range(len(texts)), pairs), {}
    for k in range(len(texts)):
        low[top[k]] = min(low.get(top[k], k), k)
    return {k: low[top[k]] for k in range(len(texts))}


def test_similarity_of_long_texts(spark):
    """Pairs of 2,000 words just above and just below 0.8, and texts in which one line is repeated thousands of times."""
    rng, texts = random.Random(11), []
    fresh = lambda n: [f"x{rng.getrandbits(40):x}" for _ in range(n)]
    for k in range(16):
        words, d = fresh(2004), 210 if k % 2 else 236
        texts += [" ".join(words), " ".join(words[:-d] + fresh(d))]
    line = fresh(8)
    for _ in range(4):
        texts.append(" ".join(line * 3000 + fresh(600)))
    expected = linked(texts)
    assert len(set(expected.values())) == 8 + 16 + 4
    found = simhash.similar_documents(awkward(spark, list(enumerate(texts)))).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


@pytest.mark.parametrize("block", [512, 4])
def test_near_copies_that_share_a_passage_with_others(spark, monkeypatch, block):
    """Twelve pairs at 0.8 whose common words are to 95% a passage that all texts hold; no other two are linked."""
    monkeypatch.setattr(simhash, "PAIR_BLOCK", block)
    rng = random.Random(12)
    fresh = lambda n: [f"x{rng.getrandbits(40):x}" for _ in range(n)]
    passage, texts = fresh(500), [" ".join(fresh(3))]
    for _ in range(12):
        both = fresh(26)
        texts += [" ".join(passage + both + fresh(58)) for _ in range(2)]
    texts += [" ".join(passage + fresh(100)) for _ in range(30)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(awkward(spark, list(enumerate(texts)))).collect()}
    assert found == linked(texts)
    assert all(found[k] == found[k + 1] for k in range(1, 25, 2))


def repeated_texts(seed):
    rng = random.Random(seed)
    texts = list(TEXTS) + [(50, "ab " * 40), (51, "xab " + "ab " * 9)]
    passage = " ".join(rng.choices("abcdefgh", k=30))
    for k in range(60):
        own = " ".join(rng.choices("abcdefgh", k=rng.randrange(40)))
        cut = rng.randrange(len(passage))
        texts.append((100 + k, f"{own} {passage[cut : cut + rng.randrange(60)]} {own[::-1]}"))
    return texts


@pytest.mark.parametrize("seed,width,gram", [(1, 6, 3), (2, 5, 1), (3, 9, 9)])
def test_word_repeats(spark, seed, width, gram):
    texts = repeated_texts(seed)
    plain = repeats([(t or "").encode().split() for _, t in texts], width, b" ".join)
    found = debruijn.remove_repeats(awkward(spark, texts), width, gram).collect()
    expected = [(i, n, gone, sha) for (i, _), (n, gone, _, sha) in zip(texts, plain)]
    assert sorted(map(str, expected)) == sorted(str((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"])) for r in found)
    assert all(sum(s["hi"] - s["lo"] for s in r["spans"]) == r["n_removed"] for r in found)


@pytest.mark.parametrize("seed,width,gram,rows", [(1, 12, 5, 4096), (2, 10, 2, 1), (3, 8, 8, 3)])
def test_byte_repeats(spark, seed, width, gram, rows):
    texts = repeated_texts(seed)
    plain = repeats([(t or "").encode() for _, t in texts], width, bytes)
    found = suffixes.remove_repeats(awkward(spark, texts), width, gram, rows).collect()
    assert sorted(str((i, *p)) for (i, _), p in zip(texts, plain)) == sorted(str(tuple(r)[:5]) for r in found)


def test_no_repeats_of_nothing(spark):
    empty = awkward(spark, TEXTS).limit(0)
    assert debruijn.remove_repeats(empty).count() == suffixes.remove_repeats(empty).count() == simhash.near_duplicates(empty).count() == 0


def test_super_windows_hold_every_window_once():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 4, 500).astype(np.uint64)
    m, lo, hi, _, _ = windows.super_windows(values, 20, 4, windows.Rolling(1000))
    assert [p for a, b in zip(lo, hi) for p in range(a, b + 1)] == list(range(481))
    assert ((m >= hi) & (m <= lo + 16)).all()


def test_deep_shallow_order():
    rng = random.Random(4)
    strings = [bytes(rng.choices(b"ab", k=rng.randrange(200))) for _ in range(150)] + [b"a" * 150] * 3 + [b"a" * 149, b""]
    order = suffixes.deep_shallow(strings, shallow=16)
    assert sorted(order) == list(range(len(strings))) and [strings[i] for i in order] == sorted(strings)


def test_planted_passages_of_over_fifty_words(spark):
    """Passages of 60 words in two texts each: both operators remove them where they have 400 bytes or more; below that only the one that counts words does.
    Texts without a passage lose nothing."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    text = lambda n, size: " ".join(word(size) for _ in range(n))
    long, short = text(60, 7), text(60, 4)
    rows = [(1, f"{text(80, 6)} {long} {text(30, 6)}"), (2, f"{long} {text(90, 6)}"), (3, f"{text(70, 6)} {short}"), (4, f"{short} {text(70, 6)}"), (5, text(200, 6)), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(long) >= 400 > len(short)
    by_words = {r.doc_id: r.n_removed for r in debruijn.remove_repeats(docs).collect()}
    by_bytes = {r.doc_id: (r.n_removed, r.n_bytes) for r in suffixes.remove_repeats(docs).collect()}
    assert by_words == {1: 60, 2: 60, 3: 60, 4: 60, 5: 0, 6: 0}
    assert all(len(long) <= by_bytes[k][0] <= len(long) + 4 for k in (1, 2))
    assert [by_bytes[k][0] for k in (3, 4, 5, 6)] == [0, 0, 0, 0]
    assert {k: n for k, (_, n) in by_bytes.items()} == {k: len(t or "") for k, t in rows}


def on_disk(spark):
    folder = f"{shared_folder(spark)}/llm"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def label(name):
    return name.rpartition("-")[0]


def test_word_repeats_keep_on_disk_only_what_the_result_reads(spark, monkeypatch):
    """The super-windows and their counts are gone when paths are joined, and all but the answers at the end."""
    before, seen = on_disk(spark), []
    compact = debruijn.compact
    monkeypatch.setattr(debruijn, "compact", lambda paths: [seen.append(sorted(map(label, on_disk(spark) - before))), compact(paths)][1])
    found = debruijn.remove_repeats(awkward(spark, repeated_texts(1)), 6, 3)
    assert seen == [["candidates"]]
    assert sorted(map(label, on_disk(spark) - before)) == ["answers", "ids"]
    assert found.count() == len(repeated_texts(1))


def test_near_copies_keep_on_disk_only_what_the_result_reads(spark, monkeypatch):
    """The sets of all documents are gone when sets are compared, and all but the result at the end."""
    before, seen = on_disk(spark), []
    compared = simhash.compared
    monkeypatch.setattr(simhash, "compared", lambda *a: [seen.append(set(map(label, on_disk(spark) - before))), compared(*a)][1])
    texts = [(k, t) for k, (_, t) in enumerate(near_texts())]
    found = simhash.similar_documents(awkward(spark, texts))
    assert seen and all("sets" in x and "shingles" not in x for x in seen)
    assert sorted(map(label, on_disk(spark) - before)) == ["similar"]
    assert found.count() == len(texts)


def test_components_keep_one_round(spark):
    before = on_disk(spark)
    found = common.components(spark.range(40).selectExpr("id a", "id + 1 b"))
    assert list(map(label, on_disk(spark) - before)) == ["small"]
    assert {r["root"] for r in found.collect()} == {0}


def test_staged_tables_of_other_threads_stay(spark):
    def other():
        tables.append(common.stage(spark.range(3), "other"))

    def make():
        worker = threading.Thread(target=other)
        worker.start()
        worker.join()
        return common.stage(spark.range(5), "own")

    tables = []
    assert common.stage_result(spark, make, "result").count() == 5
    assert tables[0].count() == 3


@pytest.mark.parametrize("small", [0, 1 << 14])
@pytest.mark.parametrize("sizes", [[], [1] * 30, [5000, 40, 3, 3, 1], [1] * 1200, [3000] + [1] * 1200])
def test_attach_is_a_left_join(spark, monkeypatch, small, sizes):
    """No key, few keys, hot and rare ones, rare ones only; a null key and one that the table lacks find nothing."""
    monkeypatch.setattr(common, "SMALL_ROWS", small)
    table = spark.createDataFrame([(k, n, 10 * k) for k, n in enumerate(sizes)], "k bigint, n bigint, x bigint")
    rows = [(k, k % 3) for k in range(len(sizes))] + [(None, 0), (-1, 1)]
    found = common.attach(spark.createDataFrame(rows, "k bigint, y int"), table, ["k"], "n")
    assert found.columns == ["k", "y", "n", "x"]
    expected = [(k, y, sizes[k], 10 * k) if k is not None and k >= 0 else (k, y, None, None) for k, y in rows]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)
    nothing = common.attach(spark.createDataFrame(rows, "k bigint, y int"), spark.createDataFrame([], "k bigint, n bigint, x array<bigint>"), ["k"], "n")
    assert {(r["n"], r["x"]) for r in nothing.collect()} == {(None, None)}


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars around their smallest nodes already are their own result."""
    labels, stage = [], common.stage
    monkeypatch.setattr(common, "stage", lambda df, label: [labels.append(label), stage(df, label)][1])
    found = common.components(spark.createDataFrame([(5, 1), (1, 6), (7, 2), (2, 2)], "a bigint, b bigint"))
    assert {(r["node"], r["root"]) for r in found.collect()} == {(1, 1), (5, 1), (6, 1), (2, 2), (7, 2)}
    assert labels == ["edges"]
    assert {r["root"] for r in common.components(spark.createDataFrame([(5, 1), (6, 5)], "a bigint, b bigint")).collect()} == {1}
    assert labels[-1] == "small"


def test_sets_of_documents_without_near_copies_are_not_written(spark, monkeypatch):
    """Only documents that share a sampled fingerprint with another have their sets written, once for texts that differ in case or white space."""
    written, stage = {}, simhash.stage

    def noted(df, label):
        out = stage(df, label)
        if "hashes" in out.columns:
            written.setdefault(label, out.count())
        return out

    monkeypatch.setattr(simhash, "stage", noted)
    rng = random.Random(13)
    fresh = lambda n: [f"x{rng.getrandbits(40):x}" for _ in range(n)]
    words = fresh(400)
    texts = [" ".join(fresh(60)) for _ in range(50)] + [" ".join(words), "  ".join(words).upper(), " ".join(words[:-12] + fresh(12)), " ".join(words)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(awkward(spark, list(enumerate(texts)))).collect()}
    assert found == linked(texts) and found[53] == found[52] == 50
    assert written == {"sets": 2}


def test_texts_that_share_only_a_passage_are_not_looked_up(spark):
    """A set with over a fifth of its shingles in no other set has no partner at 0.8; near copies stay."""
    rng = random.Random(14)
    own = lambda n: rng.sample(range(1 << 40), n)
    passage, both = own(60), own(60)
    sets = [sorted(passage + own(20)) for _ in range(40)] + [sorted(both + own(7)) for _ in range(2)] + [sorted(passage + own(14))]
    table = spark.createDataFrame(list(enumerate(sets)), "key bigint, hashes array<bigint>")
    members = spark.createDataFrame([(k, k, k) for k in range(len(sets))], "key bigint, fp bigint, root bigint")
    assert {r["key"] for r in simhash.crowded(members, table, 0.8).collect()} == {40, 41, 42}
    pivots = spark.createDataFrame([], "key bigint, pivots array<struct<place:int,pivot:bigint,far:double>>")
    assert [(r["ka"], r["kb"]) for r in simhash.partners(members, table, 0.8, pivots).collect()] == [(40, 41)]
