"""Line numbers over several files, and the filter that tells which rows a join needs."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from netloom.operators import hubs
from netloom.plans import session
from netloom.sources import text


def test_lines_in_one_file_and_in_seven(spark, tmp_path):
    """Ids that occur in several files: the last line wins, however the files are cut and packed."""
    draw = random.Random(2)
    said = [f"id{draw.randrange(40):02d} {round(draw.random(), 6)}" for _ in range(3000)]
    (tmp_path / "one").write_text("\n".join(said) + "\n")
    (tmp_path / "many").mkdir()
    cuts = [0, *sorted(draw.sample(range(3000), 6)), 3000]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / "many" / f"f{k}.txt").write_text("".join(x + "\n" for x in said[a:b]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1k", "5k", before):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for path in ("one", "many"):
                got = [(r["line"], r["value"]) for r in text.lines(spark, str(tmp_path / path)).orderBy("line").collect()]
                assert got == list(enumerate(said))
                last = {r["id"]: r["score"] for r in text.read_scores(spark, str(tmp_path / path)).collect()}
                assert last == {x.split()[0]: float(x.split()[1]) for x in said}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_edges_in_several_files(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "b").write_text("a\tb\t.2\nb\ta\t.7\n")
    (tmp_path / "e" / "a").write_text("a\tb\t.9\nb\tc\t.5\n")
    got = {(r["src"], r["dst"]): r["w"] for r in text.read_network(spark, str(tmp_path / "e")).edges.collect()}
    assert got == {("a", "b"): 0.7, ("b", "c"): 0.5}


@pytest.mark.parametrize("n", [0, 10, 20_000])
def test_filter_keeps_every_row_that_is_needed_and_few_others(spark, n):
    keys = spark.range(n).select((F.col("id") * 7).alias("k"))
    rows = spark.range(100_000).select("id", F.lit("x").alias("k"))
    hit, miss = hubs.needed(rows, F.col("id"), keys)
    due = {7 * i for i in range(n) if 7 * i < 100_000}
    got = {r["id"] for r in hit.collect()}
    assert due <= got and hit.columns == rows.columns and hit.count() + miss.count() == 100_000
    assert len(got - due) < 0.05 * 100_000


def test_null_keys_are_keys(spark):
    """What follows may be a null-safe join."""
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, k string")
    hit, _ = hubs.needed(rows, F.col("k"), spark.createDataFrame([("a",), (None,)], "k string"))
    assert sorted(r["id"] for r in hit.collect()) == [1, 2]


def test_cut_leaves_no_shuffle_files(spark):
    """What was shuffled for a cut is deleted with it, and the session's own setting stays."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for n in re.findall(r"shuffle_\d+_\d+_\d+\.data", blocks.getAllFiles().mkString(" "))}
    setting, before = spark.conf.get(session.CLEANUP), shuffled()
    out = session.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(session.CLEANUP) == setting
    assert out.count() == 7
