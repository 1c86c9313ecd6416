"""Fill-in-the-middle and the Merkle manifest against plain restatements of their contracts."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from netloom.llm import fim, merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, output string, node string"
sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

TEXTS = [
    None,
    "",
    " ",
    "\n\t ",
    "word",
    " word",
    "word ",
    "two words",
    "naïve 🙂 text — with odd spaces\x0band\x1fmore\n",
    "<P>",
    "a <S>b c",
    "x<M> y",
    "< P> <P <<S <X> P> S>",
    "one <\n<P\nthree> four>",
    "a < b",
    "\n\n lines\nof\n\nwords \n",
    "alpha beta gamma " * 90_000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, ("en", None, "", "fr", "é")[i % 5], None if i % 3 else f"s{i}", None if i % 4 == 1 else i, "a", "b", "c") for i, t in enumerate(TEXTS * 30)]
    rows += [rows[7], rows[7], (rows[7][0], "other", *rows[7][2:]), (None, "no id here", "en", "s", 3, "a", "b", "c"), (None, None, None, None, None, "a", "b", "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digits = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(digits[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, sha(text), sha(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"
    return n, form, len(a), len(b), sha(out), sha(text)


def digests(docs):
    out = fim.restore(fim.transform(docs))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2("restored", 256))


def test_fim_against_plain_restatement(odd):
    got = sorted(map(tuple, digests(odd).collect()), key=repr)
    want = sorted(((r["doc_id"], *plain_fim(r["doc_id"], r["text"])) for r in odd.collect()), key=repr)
    assert got == want
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fim_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op12_fill_in_middle(spark, sf_dir).collect()
    assert len(got) == len(docs) and all(tuple(r)[1:] == plain_fim(r["doc_id"], docs[r["doc_id"]]) for r in got)


def test_fim_of_nothing_and_of_what_is_none_of_its_outputs(spark, odd):
    assert digests(odd.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, "psm", "<P>a<S>b")], "doc_id long, form string, output string")
    with pytest.raises(Exception, match="each marker once"):
        fim.restore(bad).collect()
    every = fim.transform(odd, rate=100, suffix_first=0).where("form <> 'plain'")
    assert {r["form"] for r in every.collect()} == {"psm"}


def fields(r, n_chars):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n_chars, r["text"]))


def plain_tree(nodes):
    """The root, and for each node its siblings level by level with the side each stands on."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(place):
            pair = nodes[k - k % 2 : k - k % 2 + 2]
            proofs[i].append(("".join(pair[: k % 2]), "".join(pair[k % 2 + 1 :])))
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        place = [k // 2 for k in place]
    return nodes[0], proofs


def plain_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append(((r["doc_id"] is not None, r["doc_id"] or 0), sha(fields(r, r["n_chars"])), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([leaf for _, leaf, _ in sorted(by[x], key=lambda t: t[:2])]) for x in langs}
    root, over = plain_tree([trees[x][0] for x in langs])
    out = []
    for x, top in zip(langs, over, strict=True):
        for (_, leaf, r), own in zip(sorted(by[x], key=lambda t: t[:2]), trees[x][1], strict=True):
            hit = r["n_chars"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            node = sha(fields(r, r["n_chars"] + 1)) if hit else leaf
            for before, after in own + top:
                node = sha(before + node + after)
            out.append((r["doc_id"], leaf, trees[x][0], root, sha("".join(a + b for a, b in own + top)), node, node == root))
    return sorted(out, key=repr)


def as_queried(docs, levels):
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = merkle.manifest(docs, {"n_chars": tampered}, levels)
    return sorted(map(tuple, out.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256), "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_manifest_against_plain_restatement(odd, levels):
    """With few levels a superblock, several rounds go up and down."""
    want = plain_manifest(odd.collect())
    got = as_queried(odd, levels)
    assert got == want and {w[-1] for w in want} == {True, False}


def test_manifest_of_few_rows(spark, odd):
    assert merkle.manifest(odd.limit(0)).count() == 0
    for n in (1, 2, 3):
        some = spark.createDataFrame(odd.collect()[:n], SCHEMA)
        assert as_queried(some, 1) == plain_manifest(some.collect())
    one_lang = odd.where("lang = 'en'")
    assert as_queried(one_lang, 2) == plain_manifest(one_lang.collect())


def test_manifest_query_and_proofs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert sorted(map(tuple, queries.op13_merkle_manifest(spark, sf_dir).collect()), key=repr) == plain_manifest(docs.collect())
    held = merkle.verify(merkle.manifest(docs)).select("verified", "holds").distinct().collect()
    assert [tuple(r) for r in held] == [(True, True)]


def test_large_ids_are_kept(spark):
    docs = spark.createDataFrame([(2**62 + 1, "a", "en", "s", 1), (None, "b", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in merkle.manifest(docs).collect()} == {2**62 + 1, None}
