"""Circulant MinHash near-duplicates against all pairs."""

import random
import re

import numpy as np
import pytest

from netloom.llm import minhash, queries, textops

SCHEMA = "doc_id long, text string, n long, component string, key string"


def brute_set(text, words=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute(rows, words=2, least=80):
    """``(doc_id, n, component, kept)``, by an inverted index so that all pairs with a shingle in common are told."""
    sets = [brute_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    met = {}
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for j in holders[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if 100 * both >= least * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
                met[i, j] = True
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    low = {g: min((d for d in ids if d is not None), default=None) for g, ids in groups.items()}
    return sorted(((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


def family(rng, n, size, changed, words):
    base = [rng.choice(words) for _ in range(size)]
    return [" ".join(rng.choice(words) if rng.random() < changed else w for w in base) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    texts = [None, "", " \n", "one", "One", "one two", "ONE  two", "two one", "É é", "é É", "a a a a", "a a", "naïve 🙂 text", "x\x1fy z", "one two three four five six", "one two three four five six seven"]
    for size in (6, 12, 40, 200):
        for changed in (0.02, 0.05, 0.1):
            texts += family(rng, 12, size, changed, words)
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts += [f"{shared} {' '.join(rng.choice(words) for _ in range(60))}" for _ in range(60)]
    texts += ["one two three four five six"] * 40 + [" ".join(rng.choice(words) for _ in range(60_000))] * 2
    out = list(enumerate(texts))
    return [*out, out[20], out[20], (out[20][0], "another text with this id"), (None, texts[20]), (None, "no id at all"), (None, None)]


def test_against_all_pairs(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "c", "k") for d, t in rows], SCHEMA).repartition(6)
    assert told(minhash.near_duplicates(docs)) == [(*r[:3], r[0] == r[2]) for r in brute(rows)]


def test_other_shingles_and_similarity(spark, rows):
    some = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    assert told(minhash.near_duplicates(docs, words=3, least=90)) == brute(some, 3, 90)


def test_query(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert told(queries.op11_minhash_near_dedup(spark, sf_dir)) == brute(docs)


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_family_of_very_many_and_loose_sharers(spark):
    """A star and its stragglers, not all pairs, and still the groups of all pairs."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = family(rng, 700, 150, 0.05, words)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert told(minhash.near_duplicates(docs)) == brute(list(enumerate(texts)))


def test_a_large_family_with_many_stragglers(spark, monkeypatch):
    """Copies with few changes are one component; those with many meet it in most groups and are settled in tiles."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(120)]
    noisy = lambda share: " ".join(rng.choice(words) if rng.random() < share else w for w in base)
    texts = [noisy(0.02) for _ in range(200)] + [noisy(0.08) for _ in range(200)] + [noisy(0.14) for _ in range(100)]
    monkeypatch.setattr(minhash, "TILE", 40)
    seen, settled = [], minhash.settled
    monkeypatch.setattr(minhash, "settled", lambda strays, members, *rest: seen.append((strays.count(), members.count())) or settled(strays, members, *rest))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert told(minhash.near_duplicates(docs)) == brute(list(enumerate(texts)))
    assert seen[0][0] > 30 and seen[0][1] > 100


def test_bands_meet_as_often_as_the_theory_says():
    """Sets with a similarity of 0.8: agreeing coordinates, and pairs none of whose bands agree."""
    rng = np.random.default_rng(3)
    agreeing, missed = [], 0
    for size in (9, 45, 450):
        for _ in range(200):
            union = rng.integers(0, 1 << 63, size * 10 // 9, dtype=np.uint64)
            a, b = union[: size], union[len(union) - size :]
            x, y = minhash.signature(a), minhash.signature(b)
            agreeing.append((x == y).mean())
            keys = minhash.band_keys(np.stack((x, y)))
            missed += not (keys[0] == keys[1]).any()
    assert abs(np.mean(agreeing) - 0.8) < 0.02 and missed == 0


def test_signature_is_the_least_number_at_each_turn():
    shingles = np.array([3, 99, 12345, 2**60], np.uint64)
    at = minhash.places(shingles)
    number = np.random.default_rng(minhash.SEED).permutation(minhash.PLACES)
    assert minhash.signature(shingles).tolist() == [min(number[(p + k) % minhash.PLACES] for p in at) for k in range(minhash.COORDINATES)]


def test_hashes_of_sequences_that_cancel():
    """A Thue-Morse word and its complement are equal modulo powers of two for any odd base."""
    word = "ab"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    b = textops.Block([f"{word} {other}".encode()])
    assert b.words[0] != b.words[1]
    assert textops.Block([word.encode()]).words[0] == b.words[0]
