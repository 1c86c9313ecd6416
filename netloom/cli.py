"""Command line: ``python -m netloom.cli PROGRAM ...``; results are folders of text or Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions.stats import hazen
from netloom.operators import evaluate, network, propagate, tailstat
from netloom.plans.session import local_session
from netloom.sources import sinks, text


def make_net(spark: SparkSession, o: argparse.Namespace) -> None:
    sinks.save_network(text.read_network(spark, o.e, o.n, o.d), o.o)


def merge_net(spark: SparkSession, o: argparse.Namespace) -> None:
    merged = network.merge(sinks.load_network(spark, o.n1), sinks.load_network(spark, o.n2), o.scheme, o.remove_singletons == "y")
    sinks.save_network(merged, o.o)


def nbp(spark: SparkSession, o: argparse.Namespace) -> None:
    genes = text.read_labels(spark, o.g).select("id", "label").distinct()
    if o.shuffle > 0:
        genes = propagate.shuffle_labels(genes, o.shuffle, o.seed)
    net = network.filter_edges(sinks.load_network(spark, o.n), o.cutoff)
    if o.rewire:
        net = network.rewire(net, o.rewire, o.seed)
    seeds = genes.where("label").select("id")
    capacity = propagate.CAPACITIES[o.ctype]
    if o.nfolds > 1:
        scores = propagate.cross_validated(net, propagate.folds_by_hash(genes, ["label"], o.nfolds, o.seed), o.d, capacity).where("score > 0")
    elif o.algo == 0:
        scores = propagate.one_time(propagate.functional_flow(net, seeds, o.d, capacity), genes)
    else:
        # nsim sweeps are shared out between the chains; each keeps one sample at least
        sweeps = o.lag_period * -(-o.nsim // (o.chains * o.lag_period))
        raw = propagate.random_field(net, seeds, o.alpha, o.beta, o.gamma, o.pi, o.burn_in, sweeps, o.lag_period, o.chains, o.seed)
        scores = propagate.one_time(raw, genes)
    sinks.save_table(scores.select("id", "score"), o.o)


def tail_stat(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    log = o.log == "y"
    ids = lambda path: text.read_items(spark, path).select("id").distinct()
    variants = ids(o.c).withColumn("grp", F.lit("case")).union(ids(o.t).withColumn("grp", F.lit("control")))
    keys = ("grp",)
    if o.bootstrap:
        variants, keys = tailstat.bootstrap(variants, o.bootstrap, o.seed), ("rep", "grp")
    v, g = text.read_scores(spark, o.v), text.read_scores(spark, o.g)
    if o.vcutoff > 0:
        v = tailstat.cut_low(v, o.vcutoff, log)
    if o.vmild:
        v = tailstat.mild(v, ids(o.vmild), log)
    if o.enforce:
        g = tailstat.enforce(g, ids(o.enforce), log)
    scores = tailstat.combine(variants, v, g, ids(o.excl) if o.excl else None, log, keys)
    by = [k for k in keys if k != "grp"]
    cut = tailstat.cutoff(scores, o.q, log, by)
    if o.outfmt == 2 and not by:
        return tailstat.tail_scores(scores)
    if o.stat == "auc":
        top = scores.join(F.broadcast(cut), by) if by else scores.join(F.broadcast(cut))
        return evaluate.auc(top.where("score >= cutoff").select(*by, "score", (F.col("grp") == "case").alias("label")), by)
    table = tailstat.statistics(tailstat.contingency(scores, cut, by))
    return table.select(*by, *(["a", "b", "c", "d"] if o.outfmt == 1 else []), {"pvalue": "p", "lr": "lr", "dor": "dor"}[o.stat])


def align_score(spark: SparkSession, o: argparse.Namespace) -> None:
    ids = lambda path: text.read_items(spark, path).select("id") if path else None
    out = evaluate.align(ids(o.g), text.read_scores(spark, o.s), ids(o.pos), ids(o.neg))
    sinks.save_table(out.select("id", F.format_string("%.8f", "score").alias("score")), o.o)


def get_auc(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return evaluate.auc(evaluate.label_scores(text.read_labels(spark, o.labels), text.read_scores(spark, o.predictions)))


def inspect_net(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    net = network.filter_edges(sinks.load_network(spark, o.n), o.cutoff)
    if o.d:
        sinks.save_table(network.degrees(net).select("id", "degree"), o.d)
    if o.goi:
        network.interest(net, text.read_items(spark, o.goi)).show()
    parts = network.components(net).agg(F.countDistinct("component").alias("n_components"))
    return network.summary(net).join(parts)


def neighbor_of(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    net = network.filter_edges(sinks.load_network(spark, o.n), o.cutoff)
    asked = spark.createDataFrame([(o.g,)], "id string")
    if network.subgraph(net, asked).vertices.isEmpty():
        raise SystemExit(f"no vertex {o.g}")
    return network.neighbors(net, asked).select("neighbor", "w")


def print_net(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return network.filter_edges(sinks.load_network(spark, o.n), o.cutoff).edges


def make_adj(spark: SparkSession, o: argparse.Namespace) -> None:
    net = network.filter_edges(sinks.load_network(spark, o.n), o.cutoff)
    sinks.save_adjacency(network.adjacency(net, o.bilateral == "Y", o.begin, o.inc_singleton == "Y"), o.o, o.d)


def make_gene_label(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    genes, positive = text.read_items(spark, o.genes).select("id"), text.read_items(spark, o.positives).select("id").distinct()
    both = genes.union(positive).distinct()
    return both.join(positive.withColumn("label", F.lit(1)), "id", "left").na.fill({"label": 0}).orderBy("id")


def ernet(spark: SparkSession, o: argparse.Namespace) -> None:
    if o.N:
        like = network.filter_edges(sinks.load_network(spark, o.N), o.cutoff)
        net = network.random_network(like.vertices, like.edges.count(), o.seed)
    elif o.M is not None:
        net = network.random_network(text.read_nodes(spark, o.n).vertices, o.M, o.seed)
    else:
        net = network.random_network_p(text.read_nodes(spark, o.n).vertices, o.p, o.seed)
    sinks.save_network(net, o.o)


def quantile(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    return hazen(text.read_lines(spark, o.values, "numeric"), "value", [o.p])


#: For each program: its function, required options, options with defaults, and positional arguments.
PROGRAMS = {
    "make-net": (make_net, ["e", "o"], {"n": None, "d": "\t"}, []),
    "merge-net": (merge_net, ["n1", "n2", "o"], {"scheme": "min", "remove-singletons": "y"}, []),
    "nbp": (nbp, ["n", "g", "o"], {"algo": 0, "cutoff": 0.5, "nfolds": 1, "rewire": 0.0, "shuffle": 0.0, "seed": 0, "ctype": 0, "d": 5, "pi": None, "alpha": 0.0, "beta": 0.0, "gamma": 0.0, "burn-in": 100, "lag-period": 10, "nsim": 2000, "chains": 16}, []),
    "tail-stat": (tail_stat, ["c", "t", "v", "g"], {"vcutoff": 0.0, "vmild": None, "excl": None, "enforce": None, "stat": "pvalue", "q": 0.95, "log": "n", "outfmt": 0, "bootstrap": 0, "seed": 0}, []),
    "align-score": (align_score, ["g", "s", "o"], {"pos": None, "neg": None}, []),
    "get-auc": (get_auc, [], {}, ["labels", "predictions"]),
    "inspect-net": (inspect_net, ["n"], {"d": None, "cutoff": 0.5, "goi": None}, []),
    "neighbor-of": (neighbor_of, ["n", "g"], {"cutoff": 0.5}, []),
    "print-net": (print_net, ["n"], {"cutoff": 0.5}, []),
    "make-adj": (make_adj, ["n", "o", "d"], {"cutoff": 0.5, "begin": 0, "inc-singleton": "Y", "bilateral": "Y"}, []),
    "make-gene-label": (make_gene_label, [], {}, ["genes", "positives"]),
    "ernet": (ernet, ["o"], {"n": None, "N": None, "p": 0.0, "M": None, "cutoff": 0.5, "seed": 0}, []),
    "quantile": (quantile, [], {"p": 0.5}, ["values"]),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="netloom")
    sub = top.add_subparsers(dest="program", required=True)
    for name, (_, required, defaults, positional) in PROGRAMS.items():
        p = sub.add_parser(name)
        for r in required:
            p.add_argument(f"-{r}", required=True)
        for option, default in defaults.items():
            kind = int if option == "M" else float if option == "pi" else type(default) if default is not None else str
            p.add_argument(f"-{option}", default=default, type=kind)
        for r in positional:
            p.add_argument(r)
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame | None:
    """Run one program; one that only prints writes all rows of its result, a partition at a time, and returns it."""
    options = parser().parse_args(arguments)
    shown = PROGRAMS[options.program][0](spark or local_session(), options)
    if shown is not None:
        print("\t".join(shown.columns))
        for row in shown.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))
    return shown


if __name__ == "__main__":
    main()
