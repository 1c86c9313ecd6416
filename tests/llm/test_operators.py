"""Operators against brute force, and their defined results on odd input."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netloom.llm import chat, decontam, langid, neardup, packing, pii, quality_model, quality_rules, sharding, textops
from netloom.operators.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string"
LONG = "alpha beta gamma delta epsilon zeta eta theta " * 3000
ODD = [
    (1, None, None, None, None, "x"),
    (2, "", "en", None, 0, None),
    (3, "  \n\t ", "en", "s", 5, "y"),
    (4, "12 34 !!", "en", "s", 8, "y"),
    (None, "a text without an id and some more words", "en", "s", 1, "z"),
    (5, LONG, "en", "s", len(LONG), "z"),
    (6, "the same text twice over and over again", "en", "s", 1, "z"),
    (6, "the same text twice over and over again", "en", "s", 1, "z"),
    (7, "naïve café – Ünïcode 🙂 text\nwith two lines of it", "fr", "s", 1, "z"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


# 1 -------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.97 and len(got) > 100
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_odd_input(odd, empty):
    got = langid.identify(odd)
    assert got.count() == len(ODD)
    rows = by_id(got)
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 for i in (1, 2, 3, 4))
    assert rows[7]["lang_pred"] in ("en", "fr") and 0 <= rows[7]["score"] <= 1 and rows[None]["held_out"] is False
    assert langid.identify(empty).count() == 0


def test_language_of_texts_without_letters(spark):
    """Numbers of any script are no letters; one letter anywhere is."""
    rows = [(1, "½"), (2, "²³"), (3, "①②"), (4, "Ⅷ"), (5, "12 . _"), (6, "1 ª"), (7, "日本"), (8, "x")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows] + [(k, "some words of a text", "en") for k in range(20, 40)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert [got[i] for i, _ in rows] == ["und"] * 5 + ["en"] * 3


def test_language_decision_against_plain_loops():
    """Family by the largest margin, then every pair inside it votes with its probability."""
    draw = np.random.default_rng(4)
    x = np.abs(draw.normal(size=(60, 12)))
    lang = [("de", "en", "fr", "es", "it")[i % 5] for i in range(60)]
    x[np.arange(60), np.arange(60) % 5] += 3
    model = langid.fit(x, lang)
    got, score, family = model.predict(x)
    for i in range(60):
        z = np.append(x[i], 1.0)
        margin = {f: float(z @ w) for f, w in model.family.items()}
        best = max(sorted(margin), key=lambda f: margin[f])
        odds = {f: np.exp(langid.SLOPE * (m - margin[best])) for f, m in margin.items()}
        votes = Counter()
        for (a, b), w in model.pair.items():
            if langid.FAMILIES[a] == best:
                p = 1 / (1 + np.exp(-langid.SLOPE * (z @ w)))
                votes[a] += p
                votes[b] += 1 - p
        pick = max(sorted(votes), key=lambda c: votes[c])
        assert (family[i], got[i]) == (best, pick)
        assert score[i] == pytest.approx(odds[best] / sum(odds.values()) * votes[pick] / (len(model.members[best]) - 1))
    assert np.mean([g == c for g, c in zip(got, lang, strict=True)]) > 0.95


def test_language_predictions_ignore_neighbours():
    texts = ["der die das und", "the and of that", "le la les des", ""]
    whole = langid.features(texts)
    assert all(np.allclose(whole[i], langid.features([t])[0]) for i, t in enumerate(texts))


# 3 -------------------------------------------------------------------------------------------


def brute_contamination(docs, items):
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))) if w else Counter()
    out = {}
    for d, text in docs:
        w = words(text)
        for k, item in items:
            x = words(item)
            best = 0.0
            for s in range(len(w) - len(x) + 1 if x else 0):
                a, b = grams(w[s : s + len(x)]), grams(x)
                both = sum((a & b).values())
                best = max(best, both / (sum(a.values()) + sum(b.values()) - both))
            if best >= 0.8:
                out[d, k] = best
    return out


def test_decontamination_against_brute_force(spark):
    draw = np.random.default_rng(3)
    word = lambda n: [f"w{i}" for i in draw.integers(0, 400, n)]
    items = [(k, " ".join(word(n))) for k, n in enumerate((3, 12, 30, 40, 45))]
    docs = []
    for d in range(30):
        body = word(60)
        if d % 3:
            x = items[d % 5][1].split()
            if d % 4 == 1 and len(x) > 20:
                x[0] = "changed"
            if d % 4 == 2 and len(x) > 20:
                x = x[1:]
            body[20:20] = x
        docs.append((d, " ".join(body).title() + "!!"))
    docs += [(100, None), (101, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (90, None), (91, " ")], "item_id long, text string")
    want = brute_contamination(docs, items)
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(df, bench).collect()}
    assert got == pytest.approx(want) and len(want) > 15
    parts = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(df, bench, items_at_once=2).collect()}
    assert parts == pytest.approx(want)
    assert {r["doc_id"] for r in decontam.clean(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_odd_input(spark, odd, empty):
    bench = spark.createDataFrame([(1, "the same text twice over and over again")], "item_id long, text string")
    assert [r["doc_id"] for r in decontam.contaminated(odd, bench).collect()] == [6, 6]
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(odd, bench.limit(0)).count() == 0
    assert decontam.clean(odd, bench).count() == len(ODD) - 2


# 4 -------------------------------------------------------------------------------------------


def test_packing_plan_is_a_packing():
    draw = np.random.default_rng(0)
    for _ in range(60):
        capacity = int(draw.choice([7, 30, 100]))
        histogram = {int(k): int(n) for k, n in zip(draw.integers(1, capacity + 1, 20), draw.choice([1, 2, 3, 9, 40], 20), strict=True)}
        bins, used = defaultdict(list), defaultdict(int)
        for length, a, b, first, each, offset in packing.plan(histogram, capacity):
            assert a == used[length]
            used[length] = b
            for r in range(a, b):
                bins[first + (r - a) // each].append((offset + (r - a) % each * length, length))
        assert used == histogram
        for inside in bins.values():
            at = 0
            for offset, length in sorted(inside):
                assert offset == at
                at += length
            assert at <= capacity and sum(3 * n > capacity for _, n in inside) <= 2


def test_packing_of_documents(docs):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    packed = packing.pack(docs, keep_ids=True)
    rows = packed.collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for d in docs.collect():
        ids = [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 0]
        own = sorted(pieces[d["doc_id"]], key=lambda r: r["piece"])
        assert [i for r in own for i in r["ids"]] == ids and [r["start"] for r in own] == list(range(0, len(ids), 2048))
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["length"] == len(r["ids"]) for r in own)
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for inside in held.values():
        assert [o for o, _ in sorted(inside)] == [0, *np.cumsum([n for _, n in sorted(inside)])[:-1]] and sum(n for _, n in inside) <= 2048
    assert len(held) <= -(-sum(r["length"] for r in rows) // 2048) * 1.02 + 1
    assert packing.sequences(packed).where(F.size("ids") > 2048).count() == 0


def test_packing_odd_input(odd, empty):
    rows = packing.pack(odd).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ODD} and packing.pack(empty).count() == 0
    assert sum(r["doc_id"] == 6 for r in rows) == 2 and [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)


def test_words_are_coded_as_whole_texts():
    code, whole = packing.Coder(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    texts = ["Don't stop 0 10 0x0", "é́ Ünï  x\t\ny\x0bz\x85w\xa0v", "", " ", "<|endoftext|> a", "日本語 🙂🙂 1,000.50", "It's 'S o'clock\r\n"]
    assert [np.frombuffer(r, "<u4").tolist() for r in code.encode(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_worker_lets_go_of_the_words_of_packing(spark, sf_dir):
    """A worker serves one stage after another: what packing remembers does not stay while languages are found."""
    held = packing.coder(packing.TOKENIZER)
    assert packing.coder(packing.TOKENIZER) is held
    textops.memory_of("langid")
    assert packing.coder(packing.TOKENIZER) is not held


def test_texts_go_to_workers_in_small_batches(spark, sf_dir):
    """Of 3,000 texts in one partition no batch holds over 1,000, in the stages that a pipeline begins and ends with."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit("en").alias("lang"))
    for operator in (packing.tokenise, lambda d: langid.predict(d, langid.Model({}, {}, {}))):
        spark.conf.unset(key)
        operator(docs)
        sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
        assert sorted(r["n"] for r in sizes) == [1000] * 3
    spark.conf.set(key, "77")
    packing.tokenise(docs)
    assert spark.conf.get(key) == "77"
    spark.conf.unset(key)


def test_a_text_goes_to_the_worker_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.predict(docs, langid.train(docs), keep=("text", "source", "n_chars"))
    sent = got._jdf.queryExecution().analyzed().children().head().output().mkString(",")
    assert sorted(c.split("#")[0] for c in sent.split(",")) == ["doc_id", "n_chars", "source", "text"]
    assert got.columns == ["doc_id", "lang_pred", "score", "family", "text", "source", "n_chars"]
    assert sorted(got.select("doc_id", "text", "source", "n_chars").collect()) == sorted(docs.select("doc_id", "text", "source", "n_chars").collect())


# 5 -------------------------------------------------------------------------------------------

PERSONAL = "Mail a.b@c.example.com, +1 (555) 555-1234 or 10.0.0.300 or 10.0.0.30; pay 4111 1111 1111 1111 not 4111 1111 1111 1112."


def test_base_spans():
    got = [(k, PERSONAL[s:e]) for s, e, k in pii.base_spans(PERSONAL)]
    assert got == [("email", "a.b@c.example.com"), ("phone", "+1 (555) 555-1234"), ("ip", "10.0.0.30"), ("card", "4111 1111 1111 1111")]


def test_base_spans_match_the_plain_patterns():
    draw = np.random.default_rng(8)
    for _ in range(3000):
        text = "".join(draw.choice(list("ab@..-+ 0129()\n"), 40))
        plain = [(m.start(), m.end(), k) for k in pii.KINDS for m in pii.PATTERNS[k].finditer(text) if pii.valid(k, m[0])]
        assert pii.base_spans(text) == sorted(plain, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_long_runs_take_linear_time():
    weights = {k: np.zeros(len(pii.FEATURES)) for k in pii.KINDS}
    for text in ("1" * 200_000, "a" * 200_000 + "1", "1." * 50_000, "@" * 20_000, "a@" * 20_000):
        pii.spans_of(text, weights)


def test_field_adds_and_base_stays(spark, docs):
    weights = pii.train(docs)
    rows = [(1, PERSONAL), (2, "two 7536784127813050 4845168114407329 cards"), (3, "no data here"), (4, None), (5, "é 1.2.3.4 é")]
    got = by_id(pii.find(spark.createDataFrame(rows, "doc_id long, text string"), weights))
    for i, text in rows:
        base = pii.base_spans(text or "")
        listed = [tuple(x.split(":")) for x in got[i]["spans"].split(",") if x]
        assert {(k, str(s), str(e)) for s, e, k in base} <= set(listed)
        assert got[i]["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert got[i]["n_email"] == sum(k == "email" for _, _, k in base)
    assert got[2]["n_card"] == 0 and got[2]["n_added"] >= 1 and got[3]["spans"] == "" and got[5]["spans"] == "ip:2:9"
    assert by_id(pii.redact(spark.createDataFrame(rows, "doc_id long, text string"), weights))[5]["text"] == "é <ip> é"


def _drawn_stretches(spark, n=150):
    """Stretches with base spans, of texts that the field was not fitted on."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 7 = 3").where(F.col("text").rlike("[0-9@]")).select("text").collect()
    out = []
    for r in rows:
        base = pii.base_spans(r["text"])
        for at, stretch, before, after in pii.stretches(r["text"]):
            own = [(s - at, e - at, k) for s, e, k in base if at <= s and e <= at + len(stretch)]
            out.append((stretch, before, after, own))
    return out


def test_field_finds_what_the_patterns_cannot(spark):
    """Recall and precision on held-out stretches whose spans were rewritten so that most match no base pattern."""
    weights = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 7 <> 3"))
    draw, found, true, both, by_base = np.random.default_rng(1), 0, 0, 0, 0
    for stretch, before, after, own in _drawn_stretches(spark):
        text, spans = pii.spoiled(stretch, own, draw)
        base, every = pii.spans_of(before + text + after, weights)
        got = {(s - len(before), e - len(before), k) for s, e, k in every}
        found, true, both = found + len(got), true + len(spans), both + len(got & set(spans))
        by_base += len({(s - len(before), e - len(before), k) for s, e, k in base} & set(spans))
    assert true > 80 and by_base < 0.4 * true
    assert both >= 0.95 * true and both >= 0.95 * found
    for text in ("Version 2.0.1 of 2024-01-02", "GNU GPL 3.0, Apache 2.0", "9807915762804490", "token = 9c8b45435718dcc700c184a7e303cdc64c6a8f7f", "look at the dot above"):
        assert pii.spans_of(text, weights) == ([], [])


def test_rewritten_spans_lie_where_they_are_said_to():
    draw = np.random.default_rng(2)
    for _ in range(50):
        spans = pii.base_spans(PERSONAL)
        text, moved = pii.spoiled(PERSONAL, spans, draw)
        digits = lambda t: re.sub("[^0-9a-z]|dot|at", "", t)
        assert [k for _, _, k in moved] == [k for _, _, k in spans]
        assert all(digits(text[s:e]).lstrip("0") == digits(PERSONAL[x:y]) for (s, e, _), (x, y, _) in zip(moved, spans, strict=True))


def test_decode_against_enumeration():
    draw = np.random.default_rng(3)
    for _ in range(30):
        segments = [(i, j, pii.KINDS[int(draw.integers(4))], draw.normal(size=3)) for i in range(6) for j in range(i + 1, 7) if draw.random() < 0.4]
        weights = {k: draw.normal(size=3) for k in pii.KINDS}

        def best(at, segments=segments, weights=weights):
            if at == 6:
                return 0.0, []
            options = [best(at + 1)]
            for i, j, k, x in segments:
                if i == at:
                    s, rest = best(j)
                    options.append((s + float(weights[k] @ x), [(i, j, k), *rest]))
            return max(options, key=lambda o: o[0])

        assert pii.decode(pii.Lattice(list(range(7)), segments), weights) == best(0)[1]


def test_expectations_match_enumeration():
    draw = np.random.default_rng(2)
    scored = [(i, j, float(draw.normal())) for i in range(5) for j in range(i + 1, 6) if draw.random() < 0.6]

    def every(at):
        if at == 5:
            return [0.0]
        out = every(at + 1)
        for i, j, s in scored:
            if i == at:
                out = out + [s + t for t in every(j)]
        return out

    assert pii._forward(6, scored)[-1] == pytest.approx(np.log(np.exp(every(0)).sum()))


def test_personal_data_odd_input(odd, empty):
    assert pii.find(odd).where("spans <> ''").count() == 0 and pii.find(odd).count() == len(ODD) and pii.find(empty).count() == 0


# 6 -------------------------------------------------------------------------------------------


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    tri, cover, seen, dup = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2)), set(), set(), 0
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            cover |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_rules_against_brute_force(docs, odd):
    for df in (docs, odd):
        text = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        for r in quality_rules.quality_rules(df).collect():
            got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
            assert got == brute_rules(text[r["doc_id"]])
            assert r["base_failed"] == (got[0] < 50 or 100 * got[4] > 50 * got[0]) and not (r["kept"] and r["base_failed"])


def test_rules_judge_repetition(spark, empty):
    clean = " ".join(f"word{i}" for i in range(400))
    loop = " ".join(f"a{i % 9}" for i in range(90)) + " " + " ".join(f"x{i}" for i in range(110))
    got = by_id(quality_rules.quality_rules(spark.createDataFrame([(1, clean), (2, loop)], "doc_id long, text string")))
    assert got[1]["kept"] and not got[2]["base_failed"] and not got[2]["kept"]
    assert quality_rules.quality_rules(empty).count() == 0


# 7 -------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    labels = read("labels")
    got = quality_model.score_documents(read("documents").join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)


def test_quality_against_dense_algebra(spark):
    """Statistics by plain Python, the kernel, the normal equations and the binned calibration, on one small table."""
    draw = np.random.default_rng(6)
    texts = [" ".join(draw.choice(["Alpha", "be", "gamma,", "12", "d|d", "#", "the", "Of!"], int(draw.integers(1, 60)))) + "\n" * int(draw.integers(0, 3)) for _ in range(120)]
    y = [int(t.count("#") * 8 > len(t.split())) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(y)), "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality_model.score_documents(docs, labels).collect()}
    x = np.stack([quality_model.statistics([t.encode()])[0] for t in texts])
    for t, row in zip(texts, x, strict=True):
        named = dict(zip(quality_model.STATISTICS, row, strict=True))
        w = t.split()
        assert named["log_words"] == pytest.approx(np.log1p(len(w))) and named["word_length"] == pytest.approx(np.mean([len(v) for v in w]))
        assert named["distinct_words"] == pytest.approx(len(set(w)) / len(w)) and named["digit_share"] == pytest.approx(sum(c.isdigit() for c in t) / len(t))
        counts = np.array(list(Counter(t.encode()).values())) / len(t.encode())
        assert named["byte_entropy"] == pytest.approx(-(counts * np.log2(counts)).sum())
    learn = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(len(texts))])
    kernel = quality_model.Kernel(x[learn].mean(0), x[learn].std(0))
    z = kernel(x)
    # with many features the products come to the Gaussian kernel itself
    wide = quality_model.Kernel(kernel.mean, kernel.sd, features=40_000)(x)[:, :-1]
    near = wide @ wide.T
    unit = np.clip((x - kernel.mean) / kernel.sd, -8, 8)
    gauss = np.exp(-((unit[:, None] - unit[None]) ** 2).sum(2) / (2 * quality_model.WIDTH**2))
    assert np.abs(near - gauss).max() < 0.04
    n, target = int(learn.sum()), np.array(y, float)
    weights = np.linalg.solve(z[learn].T @ z[learn] + quality_model.RIDGE * n * np.diag([1.0] * quality_model.FEATURES + [1e-9]), z[learn].T @ target[learn])
    raw = z @ weights
    place = np.clip(np.floor((raw - quality_model.LOW) * (quality_model.BINS / (quality_model.HIGH - quality_model.LOW))), 0, quality_model.BINS - 1).astype(int)
    # isotonic rates by the largest lower averages of all intervals
    positive = np.bincount(place[learn], target[learn], quality_model.BINS)
    count = np.bincount(place[learn], minlength=quality_model.BINS)
    used = np.flatnonzero(count)
    p, c = np.cumsum(np.append(0, positive[used])), np.cumsum(np.append(0, count[used]))
    rate = [max(min((p[j] - p[i]) / (c[j] - c[i]) for j in range(k + 1, len(used) + 1)) for i in range(k + 1)) for k in range(len(used))]
    want = np.interp(place, used, rate)
    assert np.mean([abs(got[i] - want[i]) < 1e-6 for i in range(len(texts))]) > 0.97
    assert all(abs(got[i] - want[i]) < 1e-6 for i in np.flatnonzero(np.isin(place, used)))


def test_quality_odd_input(spark, odd, empty):
    labels = spark.createDataFrame([(6, 1, 0), (7, 0, 0), (7, None, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality_model.score_documents(odd, labels)
    assert got.count() == len(ODD) and got.where("score is null").count() == 0
    assert {r["score"] for r in quality_model.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score_documents(empty, labels).count() == 0


def test_isotonic():
    got = quality_model.isotonic(np.array([0, 3, 1, 0, 4.0]), np.array([2, 4, 4, 0, 4.0]))
    assert list(got[[0, 1, 2, 4]]) == [0, 0.5, 0.5, 1] and (np.diff(got) >= 0).all()


# 8 -------------------------------------------------------------------------------------------

CHAT = "conv_id long, turn long, role string, text string, extra string"


def test_chat_round_trip(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|> <\\\\| <|", "", "é 🙂\n\n x", "<|endoftext|>", None]
    rows = [(c, t, ("user", "assistant", "system", None)[(c + t) % 4], nasty[(c * 3 + t) % len(nasty)], "e") for c in range(5) for t in range(4)] + [(None, 0, "assistant", "x", None)]
    turns = chat.format_turns(spark.createDataFrame(rows, CHAT))
    got = {r["conv_id"]: r for r in chat.digest(turns).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.digest(chat.format_turns(spark.createDataFrame([], CHAT))).count() == 0


def test_escapes():
    for t in ["<|x|>", "<\\|", "<\\\\|a<|", "plain", "<", "|<|"]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)


# 9 -------------------------------------------------------------------------------------------


def _signed(x):
    return x - (x >> 63 << 64)


def brute_print(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(marks, radius=2):
    parent = list(range(len(marks)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    u = np.array(marks, np.uint64)
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= radius):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(marks))]


def test_near_duplicates_against_brute_force(docs, odd):
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text").where("doc_id is not null and doc_id <> 6")).groupBy("doc_id").agg(F.first("text").alias("text"))
    data = sorted((r["doc_id"], r["text"]) for r in rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect())
    marks = [brute_print(t) for _, t in data]
    roots = brute_groups(marks)
    got = by_id(neardup.near_duplicates(rows))
    for (i, _), m, r in zip(data, marks, roots, strict=True):
        assert got[i]["fingerprint"] == f"{m:016x}" and got[i]["component_id"] == data[r][0]


@pytest.mark.parametrize("leaves", [1 << 16, 2])
def test_trie_join_connects_as_all_pairs_do(spark, leaves):
    draw = np.random.default_rng(5)
    marks = {int(b) ^ sum(1 << int(k) for k in draw.choice(64, draw.integers(0, 5), replace=False)) for b in draw.integers(0, 2**63, 60) for _ in range(6)}
    marks = sorted(marks)
    roots = brute_groups(marks)
    want = defaultdict(set)
    for m, r in zip(marks, roots, strict=True):
        want[r].add(_signed(m))
    links = neardup.trie_self_join(spark.createDataFrame([(_signed(m),) for m in marks], "fp long"), leaves=leaves)
    got = defaultdict(set)
    for r in connected_components(links).collect():
        got[r["component"]].add(r["id"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_near_duplicates_odd_input(odd, empty):
    got = neardup.near_duplicates(odd)
    assert got.count() == len(ODD)
    rows = by_id(got)
    assert rows[1]["component_id"] == rows[2]["component_id"] == rows[3]["component_id"] == 1 and rows[1]["fingerprint"] == "0" * 16
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.keep_one(odd)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7] and kept.columns == odd.columns
    assert neardup.keep_one(empty).count() == 0
    none = spark_of(odd).createDataFrame([], "fp long")
    assert neardup.trie_self_join(none).count() == 0


def spark_of(df):
    return df.sparkSession


def test_keep_one_loses_no_unlinked_row(spark):
    """Several rows without an id, an id shared by unlinked texts, copies under many ids, and equal rows: against brute force."""
    text = [" ".join(f"w{k}x{i}" for i in range(40)) for k in range(9)]
    rows = [(None, text[0], 1), (None, text[1], 2), (7, text[2], 3), (7, text[3], 4), (7, text[3], 3), (8, text[3], 5), (9, text[4], 6), (9, text[4], 6), (None, text[4], 7), (None, text[5], 8), (None, text[5], 8), (3, None, 9), (4, "", 9)]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _n long"))
    marks = [brute_print(t) for _, t, _ in rows]
    groups = defaultdict(list)
    for row, root in zip(rows, brute_groups(marks), strict=True):
        groups[root].append(row)
    body = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    want = [min(g, key=lambda r: (r[0] is None, r[0] or 0, body(r[1]), r[2])) for g in groups.values()]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) == 7


CLASH = ["gone", "_b", "_id", "_n", "row", "key", "of", "id", "body", "at", "line", "n", "h", "words", "fp", "component", "_order", "_range", "_first", "_local"]


def test_clashing_column_names(spark):
    rows = [(1, "the same line of a text\nand one more of it", "x"), (2, "the same line of a text", "y"), (None, "quite another text without an id", "z")]
    plain = spark.createDataFrame(rows, "doc_id long, text string, a string")
    docs = plain.select("doc_id", "text", F.lit("en").alias("lang"), *[F.col("a").alias(c) for c in CLASH])
    from netloom.llm import linededup

    assert {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()} == {1: rows[0][1], 2: "", None: rows[2][1]}
    bench = spark.createDataFrame([(1, rows[2][1])], "item_id long, text string")
    for out in (neardup.keep_one(docs), decontam.clean(docs, bench)):
        assert out.columns == docs.columns
    assert decontam.clean(docs, bench).count() == 2 and neardup.keep_one(docs).count() == 3
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out in (langid.identify(docs), packing.pack(docs), pii.find(docs), quality_rules.quality_rules(docs), quality_model.score_documents(docs, labels), neardup.near_duplicates(docs), sharding.shard_documents(docs)):
        assert out.count() == 3
    turns = spark.createDataFrame([(1, 0, "user", "a", "x")], "conv_id long, turn long, role string, text string, a string").select("conv_id", "turn", "role", "text", *[F.col("a").alias(c) for c in CLASH])
    assert chat.digest(chat.format_turns(turns)).count() == 1

# 10 ------------------------------------------------------------------------------------------


def test_sharding_code_does_not_grow_with_the_shards(spark, docs):
    """Code of a draw for each shard took an executor over its memory while it was compiled."""
    debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")

    def most(shards):
        rows = sharding.assign(docs.select("doc_id"), F.col("doc_id"), sharding.topology(shards))
        made = debug.codegenStringSeq(rows._jdf.queryExecution().executedPlan())
        return max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size()))

    assert most(24) <= most(25) + 8 and most(25) < 2000 and most(48) < 2000


def test_sharding(docs, odd, empty):
    rows = sharding.shard_documents(docs.select("doc_id", "text").union(odd.select("doc_id", "text"))).collect()
    tree, grown = sharding.topology(24), sharding.topology(25)

    def draw(key, node, weight):
        return -np.log(((xxhash.xxh64_intdigest(f"{key}|{node}", 42) >> 11) + 0.5) / (1 << 53)) / weight

    def place(key, tree):
        best = lambda nodes: min(range(len(nodes)), key=lambda k: draw(key, *nodes[k]))
        i = best([(f"{i}", sum(map(sum, r))) for i, r in enumerate(tree)])
        j = best([(f"{i}/{j}", sum(r)) for j, r in enumerate(tree[i])])
        k = best([(f"{i}/{j}/{k}", w) for k, w in enumerate(tree[i][j])])
        return sum(len(r) for x in tree[:i] for r in x) + sum(map(len, tree[i][:j])) + k

    slots = defaultdict(list)
    for r in rows:
        key = "" if r["doc_id"] is None else r["doc_id"]
        assert r["shard"] == place(key, tree) and r["grown_shard"] == place(key, grown)
        assert r["grown_shard"] in (r["shard"], 24)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 24
    one = next(r for r in rows if r["doc_id"] == 7 and r["size"] != 8)
    assert by_id(sharding.shard_documents(odd))[1]["size"] == 8 and by_id(sharding.shard_documents(odd))[1]["text_crc32"] == 0
    assert by_id(sharding.shard_documents(odd))[7]["text_crc32"] == zlib.crc32(ODD[8][1].encode()) and one["law"] == "key"
    assert sharding.shard_documents(empty).count() == 0


# shared --------------------------------------------------------------------------------------


def test_blocks_hash_equal_strings_equally():
    b = textops.Block([b"x y x y", b"y x\nx y", b"", b"  x  "])
    assert b.n_words.tolist() == [4, 4, 0, 1] and b.words[0] == b.words[2] == b.words[-1] != b.words[1]
    first, h = b.grams(2)
    assert len(h) == 6 and h[0] == h[2]
