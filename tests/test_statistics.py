import math
import random
from decimal import Decimal, getcontext
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from netloom.functions.stats import MANY, TAILS, exact_p, fisher, hazen, student_p, student_tail, with_p_value
from netloom.operators import evaluate, ontology, tailstat


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("values, wanted", [([1, 2, 3, 4, 5], {0.0: 1, 0.25: 1.75, 0.5: 3, 0.95: 5, 1.0: 5}), ([1, 2, 3, 4], {0.25: 1.5, 0.5: 2.5, 0.9: 4})])
def test_hazen(spark, values, wanted):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    assert {r["p"]: r["q"] for r in hazen(df, "x", list(wanted)).collect()} == wanted
    assert hazen(df.where("x is null"), "x", [0.5]).count() == 0


def test_fisher(spark):
    df = spark.createDataFrame([(8, 2, 1, 5), (90, 10, 80, 30)], "a long, b long, c long, d long")
    want = {"left": (0.99912587, 0.99970121), "right": (0.02447552, 0.00110915), "both": (0.03496503, 0.00150342)}
    for tail, p in want.items():
        got = {r["a"]: r["p"] for r in fisher(df, tail).collect()}
        assert got[8] == pytest.approx(p[0], abs=1e-8) and got[90] == pytest.approx(p[1], abs=1e-8)
    big = spark.createDataFrame([(5000, 400, 6000, 500)], "a long, b long, c long, d long")
    left, right = fisher(big, "left").first()["p"], fisher(big.select((F.col("a") + 1).alias("a"), (F.col("b") - 1).alias("b"), (F.col("c") - 1).alias("c"), (F.col("d") + 1).alias("d")), "right").first()["p"]
    assert left + right == pytest.approx(1, abs=1e-8)


def _exact(a, b, c, d, tail):
    ab, ac, n = a + b, a + c, a + b + c + d
    p = {k: Fraction(math.comb(ab, k) * math.comb(n - ab, ac - k), math.comb(n, ac)) for k in range(max(0, a - d), min(ab, ac) + 1)}
    keep = {"left": lambda k: k <= a, "right": lambda k: k >= a, "both": lambda k: p[k] <= p[a] * (1 + Fraction(1, 10**7))}[tail]
    return float(sum(v for k, v in p.items() if keep(k)))


def test_fisher_keeps_its_digits_in_the_tails():
    draw = random.Random(1)
    for _ in range(400):
        m = draw.choice([3, 10, 60, 300])
        table = [draw.randint(0, m) for _ in range(4)]
        for tail in TAILS:
            assert exact_p(*map(float, table), tail) == pytest.approx(_exact(*table, tail), rel=1e-10)
    assert exact_p(4000.0, 10.0, 10.0, 4000.0, "right") < 1e-300 or exact_p(900.0, 10.0, 10.0, 900.0, "right") == pytest.approx(_exact(900, 10, 10, 900, "right"), rel=1e-9)


def test_student():
    assert student_p(2.228138852, 10, "left") == pytest.approx(0.975, abs=1e-8)
    assert student_p(-1, 1, "left") == pytest.approx(0.25, abs=1e-12)
    assert student_p(0, 5, "left") == 0.5 and math.isnan(student_p(1, 0))
    for t in (0.01, 0.5, 3.0, 50.0, 1e5, 1e60):
        one, two = math.atan(1 / t) / math.pi, 1 / (math.sqrt(t * t + 2) * (math.sqrt(t * t + 2) + t))
        assert student_p(t, 1, "right") == pytest.approx(one, rel=1e-10) and student_p(t, 2, "right") == pytest.approx(two, rel=1e-10)
        assert student_p(t, 7, "right") == student_p(-t, 7, "left") and student_p(-t, 2) == pytest.approx(2 * two, rel=1e-10)
    # even degrees of freedom have a finite sum
    t, df = 20.0, 1000
    cos2 = Fraction(df, df + 400)
    term = total = Fraction(1)
    for k in range(1, df // 2):
        term = term * cos2 * (2 * k - 1) / (2 * k)
        total += term
    sine = Decimal(400) / Decimal(df + 400)
    getcontext().prec = 120
    upper = (1 - (Decimal(400) / Decimal(df + 400)).sqrt() * Decimal(total.numerator) / Decimal(total.denominator)) / 2
    assert sine and student_p(t, df, "right") == pytest.approx(float(upper), rel=1e-10) == student_p(-t, df, "left")


def test_p_values_of_rows(spark):
    rows = spark.createDataFrame([(2.0, 2.0), (-2.0, 2.0), (None, 3.0)], "t double, df double")
    got = with_p_value(rows, "right").collect()
    assert got[0]["p"] == pytest.approx(1 - got[1]["p"]) and got[2]["p"] is None


def test_auc(spark):
    df = spark.createDataFrame([(0.9, True), (0.9, False), (0.7, True), (0.4, False), (0.4, True), (0.1, False)], "score double, label boolean")
    assert evaluate.auc(df).first()["auc"] == pytest.approx(0.611111, abs=1e-6)
    assert evaluate.auc(df, standard=True).first()["auc"] == pytest.approx(0.666667, abs=1e-6)
    same = df.withColumn("score", F.lit(1.0))
    assert evaluate.auc(same).first()["auc"] == 0 and evaluate.auc(same, standard=True).first()["auc"] == 0.5
    keyed = df.withColumn("k", F.lit(1))
    assert evaluate.auc(keyed, ["k"]).first()["auc"] == pytest.approx(0.611111, abs=1e-6)


def test_tail(spark):
    variants = spark.createDataFrame([("g1_a", "control"), ("g1_b", "control"), ("g2_c", "control"), ("g1_a", "case"), ("g2_d", "case"), ("g3_e", "case"), ("g3_e", "case")], "id string, grp string")
    v = spark.createDataFrame([("g1_a", 0.9), ("g1_b", 0.2), ("g2_c", 0.5), ("g2_d", 0.8)], "id string, score double")
    g = spark.createDataFrame([("g1", 1.0), ("g2", 0.5)], "id string, score double")
    scores = tailstat.combine(variants, v, g)
    assert {(r["grp"], r["id"]): r["score"] for r in scores.collect()} == {("control", "g1_a"): 0.9, ("control", "g1_b"): 0.2, ("control", "g2_c"): 0.25, ("case", "g1_a"): 0.9, ("case", "g2_d"): 0.4, ("case", "g3_e"): 0.0}
    cut = tailstat.cutoff(scores, 0.5)
    assert cut.first()["cutoff"] == 0.25
    assert tuple(tailstat.contingency(scores, cut).first()) == (1, 2, 1, 2)


def test_bootstrap_is_repeatable_and_takes_controls_first(spark):
    variants = spark.createDataFrame([(f"g_{i}", "case") for i in range(200)] + [("g_0", "control")], "id string, grp string")
    one = tailstat.bootstrap(variants, 10, 4)
    assert rows(one) == rows(tailstat.bootstrap(variants, 10, 4))
    share = one.count() / 2000
    assert 0.55 < share < 0.72 and rows(one.where("id = 'g_0'").select("grp").distinct()) == [("control",)]


@pytest.mark.parametrize(("q", "log"), [(0.95, False), (0.5, False), (0.0, True), (1.0, False)])
def test_bootstrap_tables_are_those_of_the_drawn_rows(spark, q, log):
    """Few scores, most of them equal, ids in both groups and repeated entries."""
    entries = [(f"g{i % 7}_{i}", "control" if i % 3 else "case") for i in range(600)] + [(f"g{i % 7}_{i}", "case") for i in range(0, 600, 5)]
    variants = spark.createDataFrame(entries, "id string, grp string").repartition(3)
    v = spark.createDataFrame([(f"g{i % 7}_{i}", (i % 4) / 4) for i in range(500)], "id string, score double")
    g = spark.createDataFrame([(f"g{i}", i / 5) for i in range(6)], "id string, score double")
    scores = tailstat.combine(tailstat.bootstrap(variants, 12, 4), v, g, log=log, keys=("rep", "grp"))
    want = tailstat.contingency(scores, tailstat.cutoff(scores, q, log, ["rep"]), ["rep"])
    pool = tailstat.combine(tailstat.pool(variants), v, g, log=log, keys=("grp", "n"))
    assert len(rows(want)) == 12
    assert rows(tailstat.bootstrap_tables(pool, 12, 4, q, log)) == rows(want)


REL = [("p", "r"), ("q", "r"), ("x", "p"), ("x", "q"), ("y", "x"), ("z", "q")]


def test_ontology(spark):
    rel = spark.createDataFrame(REL, "child string, parent string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(ontology.depths(rel)) == [("p", 1), ("q", 1), ("r", 0), ("x", 2), ("y", 3), ("z", 2)]
    assert rows(ontology.ancestors(rel, ids("y"))) == [(i,) for i in "pqrxy"]
    assert rows(ontology.subontology(rel, ids("r", "q", "y"))) == [("q", "r"), ("y", "q"), ("y", "r")]
    assert rows(ontology.leaves_of(rel, ids("r", "q", "y"))) == [("y",)]
    assert ontology.branching_factor(rel).first()[0] == 1.5
    assert rows(ontology.replenish(spark.createDataFrame([("s1", "y")], "seq string, term string"), rel)) == [("s1", t) for t in "pqrxy"]
    assert rows(ontology.children(rel, ids("q", "x"))) == [("y",), ("z",)]
    with pytest.raises(ontology.CycleError):
        ontology.topological(rel.union(spark.createDataFrame([("r", "y")], "child string, parent string")))
    with pytest.raises(ontology.CycleError):
        ontology.closure(rel.union(spark.createDataFrame([("r", "y")], "child string, parent string")))


def test_calibration(spark):
    df = spark.createDataFrame([("a", 0.0), ("b", 0.5), ("c", 1.0)], "id string, score double")
    assert rows(evaluate.calibrate(df, 0.1)) == [("a", 0.0), ("b", 0.1), ("c", 1.0)]
    assert dict(rows(evaluate.calibrate(df, 0.1, option=3)))["a"] == float("-inf")


@pytest.mark.parametrize("t", [0.3, 2.0, 5.0, 12.0])
def test_t_tails_of_very_many_degrees_are_normal(t):
    """Beyond the first term of its expansion in 1 / df the tail is that of the normal law."""
    normal = math.erfc(t / math.sqrt(2)) / 2
    density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
    for df in (1e6, 1e9, 1e12):
        want = normal + density * (t**3 + t) / (4 * df)
        assert abs(student_tail(t, df) / want - 1) < (1e-4 if df == 1e6 else 1e-9)
    # both ways of working it out agree where one hands over to the other
    assert abs(student_tail(t, MANY * 0.999999) / student_tail(t, MANY) - 1) < 1e-6
