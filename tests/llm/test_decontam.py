"""Documents that are short or have no id are judged like the others; no item is lost, however short."""

from collections import Counter

import numpy as np
import pytest

from netloom.llm import decontam

ITEM = [f"word{k}" for k in range(30)]


def test_short_documents_and_rows_without_an_id(spark):
    bench = spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")
    rows = [(1, " ".join(ITEM[:-1])), (2, " ".join(ITEM[:20])), (3, " ".join(ITEM[:3])), (None, "before " + " ".join(ITEM) + " after"), (None, "a clean row"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["similarity"] for r in decontam.contaminated(docs.where("doc_id is not null"), bench).collect()} == {1: 25 / 26}
    assert sorted(decontam.clean(docs, bench).collect(), key=str) == sorted([*rows[1:3], *rows[4:]], key=str)


def altered(draw, words, similarity):
    """A passage whose five-word shingles are at least so similar: words are changed at random while that holds."""
    def shingles(w):
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    whole, now = shingles(words), list(words)
    for k in draw.permutation(len(words)):
        other = [*now[:k], "changed", *now[k + 1 :]]
        if similar(whole, shingles(other)) >= similarity:
            now = other
    return now


def similar(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


@pytest.mark.parametrize("at_end", [False, True])
def test_no_item_is_lost_at_any_length(spark, at_end):
    """Passages at similarities down to 0.8, inside longer texts and as whole documents that lack words at the end."""
    draw = np.random.default_rng(5)
    word = lambda: "w" + str(int(draw.integers(3000)))
    items, docs, want = [], [], set()
    for n in (5, 6, 7, 8, 9, 10, 12, 15, 20, 25, 40, 60, 90, 120):
        for _ in range(60):
            k = len(items)
            item = [word() for _ in range(n)]
            items.append((k, " ".join(item)))
            size = n - 4
            if at_end:
                # s of size shingles are left: s / size is 0.8 or more
                less = int(draw.integers(0, size - -(-size * 4 // 5) + 1))
                text = item[: n - less]
            else:
                text = [*[word() for _ in range(30)], *altered(draw, item, 0.8), *[word() for _ in range(30)]]
            docs.append((k, " ".join(text)))
            want.add((k, k))
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and min(r["similarity"] for r in got) < 0.85


def test_blocks_of_items_by_bytes(spark, monkeypatch):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12))) for k in range(20)]
    docs = spark.createDataFrame(items, "doc_id long, text string")
    monkeypatch.setattr(decontam, "BYTES_AT_ONCE", 300)
    assert decontam.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id")).count() == 20
