import pytest
from pyspark.sql import functions as F

from netloom import cli
from netloom.operators import learn
from netloom.sources import sinks, text


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edge_and_score_files(spark, tmp_path):
    p = tmp_path / "edges.tsv"
    p.write_text("1\t2\t-0.5\n2\t1\t0.7\n3\t3\t0.9\n4\t5\tNA\n\n6\t7\n")
    net = text.read_network(spark, str(p))
    assert rows(net.vertices) == [("1",), ("2",), ("3",)] and rows(net.edges) == [("1", "2", 0.7)]
    s = tmp_path / "s.txt"
    s.write_text("a 1\nb 2\n\na 3\n")
    assert rows(text.read_scores(spark, str(s))) == [("a", 3.0), ("b", 2.0)]


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">s1 first one\nABC\n DEF\n\n>s2\n\n>s3 c\nGHI\n")
    got = text.read_fasta(spark, str(tmp_path / "x.fa"))
    assert rows(got) == [("s1", "first one", "ABCDEF"), ("s3", "c", "GHI")]
    long = spark.createDataFrame([("a", "", "x" * 205)], "id string, comment string, data string")
    sinks.save_fasta(long, str(tmp_path / "out"), 80)
    assert rows(text.read_fasta(spark, str(tmp_path / "out"))) == [("a", "", "x" * 205)]


OBO = """format-version: 1.2

[Term]
id: T:1
name: root

[Term]
id: T:2
name: two
alt_id: T:9
is_a: T:1 ! root
relationship: part_of T:3 ! elsewhere

[Term]
id: T:4
is_a: T:1
is_obsolete: true

[Typedef]
id: part_of
"""


def test_obo(spark, tmp_path):
    (tmp_path / "o.obo").write_text(OBO)
    got = text.read_obo(spark, str(tmp_path / "o.obo"), ["part_of"])
    assert rows(got["rel"]) == [("T:2", "T:1"), ("T:2", "T:3")]
    assert rows(got["terms"].select("id")) == [("T:1",), ("T:2",), ("T:3",)] and rows(got["alt"]) == [("T:9", "T:2")]


def test_predictions_config_and_calibration(spark, tmp_path):
    (tmp_path / "p.txt").write_text("AUTHOR x\nMODEL 1\ns1 t1 0.5\ns1 t1 0.7\nEND\ns2 t1 0.9\n")
    assert rows(text.read_predictions(spark, str(tmp_path / "p.txt"))) == [("s1", "t1", 0.7)]
    (tmp_path / "c.txt").write_text("# c\na = 1 # x\nb=two\n")
    assert text.read_config(spark, str(tmp_path / "c.txt")) == {"a": "1", "b": "two"}
    (tmp_path / "d.txt").write_text("oops\n")
    with pytest.raises(ValueError):
        text.read_config(spark, str(tmp_path / "d.txt"))
    (tmp_path / "k.tsv").write_text("a\t0.5\nb\tNAS\nc\t\n")
    assert rows(text.read_calibration(spark, str(tmp_path / "k.tsv"))) == [("a", 0.5), ("b", 0.0), ("c", 0.0)]


def test_csv_policies(spark, tmp_path):
    (tmp_path / "x.csv").write_text('# c\n 1 ,"a ""b""", 999\n2,x,-999\n')
    ddl = "n int, s string, t tinyint"
    assert rows(text.read_csv(spark, str(tmp_path / "x.csv"), ddl, comment="#", overflow="saturate")) == [(1, 'a "b"', 127), (2, "x", -128)]
    assert [r["t"] for r in text.read_csv(spark, str(tmp_path / "x.csv"), ddl, comment="#", overflow="ignore").collect()] == [None, None]
    with pytest.raises(Exception, match="(?i)overflow|cast|invalid"):
        text.read_csv(spark, str(tmp_path / "x.csv"), ddl, comment="#").collect()


def test_matrix_and_windows(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,2\n3,4\n")
    assert [r["x"] for r in text.read_matrix(spark, str(tmp_path / "m.csv")).orderBy("row").collect()] == [[1, 2], [3, 4]]
    series = learn.points(spark.createDataFrame([(1, i, float(i)) for i in range(6)] + [(2, 0, 1.0)], "id long, t long, x double"), "id", ["t"], "x")
    assert [r["x"] for r in learn.windows(series, 4).orderBy("at").collect()] == [[0, 1, 2, 3], [1, 2, 3, 4]]


def test_command_line(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("a\tb\t.9\na\tc\t.6\nb\tc\t.3\nc\td\t.8\n")
    (tmp_path / "g.txt").write_text("a 1\nb 0\nc 0\nd 0\n")
    cli.main(["make-net", "-e", str(tmp_path / "e.tsv"), "-o", str(tmp_path / "net")], spark)
    cli.main(["nbp", "-n", str(tmp_path / "net"), "-g", str(tmp_path / "g.txt"), "-o", str(tmp_path / "out"), "-cutoff", "0", "-d", "3"], spark)
    got = dict(rows(text.read_scores(spark, str(tmp_path / "out"))))
    assert got["a"] == 1 and got["b"] == pytest.approx(1) and got["c"] == pytest.approx(2.325 / 2.7)
    assert cli.main(["inspect-net", "-n", str(tmp_path / "net"), "-cutoff", "0"], spark).first()["n_components"] == 1
    assert rows(cli.main(["neighbor-of", "-n", str(tmp_path / "net"), "-g", "a", "-cutoff", "0.5"], spark)) == [("b", 0.9), ("c", 0.6)]
    with pytest.raises(SystemExit):
        cli.main(["neighbor-of", "-n", str(tmp_path / "net"), "-g", "zz"], spark)
    assert cli.main(["get-auc", str(tmp_path / "g.txt"), str(tmp_path / "out")], spark).first()["auc"] is not None
    cli.main(["make-adj", "-n", str(tmp_path / "net"), "-o", str(tmp_path / "adj"), "-d", str(tmp_path / "idx"), "-cutoff", "0"], spark)
    assert rows(spark.read.text(str(tmp_path / "adj"))) == [("0\t1\t2",), ("1\t0\t2",), ("2\t0\t1\t3",), ("3\t2",)]


def test_networks_learn(spark):
    import numpy as np

    draw = np.random.default_rng(0)
    x = draw.normal(size=(300, 4))
    data = [(i, v.tolist(), [float(v[0] + v[1] > 0)]) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "id long, x array<double>, y array<double>")
    nets = learn.train(df, learn.Settings(epochs=25, models=2))
    got = {r["id"]: r["f"][0] for r in learn.predict(df, nets).collect()}
    assert np.mean([(got[i] > 0.5) == bool(y[0]) for i, _, y in data]) > 0.9
    oob = learn.predict_out_of_bag(df, nets).collect()
    assert len(oob) == 300 and any(r["f"] is None for r in oob)


@pytest.mark.parametrize("name", learn.LOSSES)
def test_loss_gradients(name):
    import numpy as np

    draw = np.random.default_rng(1)
    f, y = draw.uniform(0.1, 0.9, (5, 3)), draw.integers(0, 2, (5, 3)).astype(float)
    a = np.array([[1, 1, 1], [0, 1, 0], [0, 0, 1.0]])
    value, slope = learn.loss(name, f, y, a)
    for i in range(5):
        for j in range(3):
            up, down = f.copy(), f.copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            assert (learn.loss(name, up, y, a)[0][i] - learn.loss(name, down, y, a)[0][i]) / 2e-6 == pytest.approx(slope[i, j], abs=1e-5)


def test_streaming_form(spark, tmp_path):
    from netloom.streaming import scores

    spark.sql("select timestamp'2024-01-01 10:00:00' ts, 'a' id, 1D score union all select timestamp'2024-01-01 11:00:00', 'a', 3D").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, id string, score double").parquet(str(tmp_path / "in"))
    q = scores.windowed_scores(stream).writeStream.format("memory").queryName("ws").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("ws").select("id", "n", F.col("mean"))) == [("a", 2, 2.0)]
