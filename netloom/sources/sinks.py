"""Writers.  Tables go out as Parquet; text formats where a program downstream reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.operators.network import Network
from netloom.operators.ontology import top_terms, topological


def save_network(net: Network, path: str) -> None:
    """Vertices and edges as two Parquet tables, edges in ranges of ``src``."""
    net.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    net.edges.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")


def load_network(spark: SparkSession, path: str) -> Network:
    return Network(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def save_edges(net: Network, path: str, delimiter: str = "\t") -> None:
    net.edges.select("src", "dst", "w").write.mode("overwrite").csv(path, sep=delimiter)


def save_table(df: DataFrame, path: str, delimiter: str = "\t") -> None:
    df.write.mode("overwrite").csv(path, sep=delimiter)


def save_adjacency(numbered: DataFrame, lists: str, index: str) -> None:
    """``idx neighbour ...`` lines and an ``idx id`` file, from :func:`netloom.operators.network.adjacency`."""
    line = F.concat_ws("\t", F.col("idx").cast("string"), F.transform("neighbors", lambda x: x.cast("string")))
    numbered.select(line.alias("value")).write.mode("overwrite").text(lists)
    save_table(numbered.select("idx", "id"), index)


def matrix(net: Network, ids: list[str]) -> DataFrame:
    """Adjacency matrix of a few named vertices, ``-`` where there is no edge."""
    e = net.edges.where(F.col("src").isin(ids) & F.col("dst").isin(ids))
    both = e.union(e.select("dst", "src", "w"))
    return both.groupBy("src").pivot("dst", ids).agg(F.first("w").cast("string")).na.fill("-")


def save_fasta(sequences: DataFrame, path: str, width: int = 80) -> None:
    """Header and data lines of at most ``width`` characters; nothing is lost at a wrap."""
    head = F.concat(F.lit(">"), F.concat_ws(" ", "id", F.when(F.col("comment") != "", F.col("comment"))))
    wrapped = F.regexp_replace("data", f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(head, F.lit("\n"), wrapped).alias("value")).write.mode("overwrite").text(path)


def save_predictions(predictions: DataFrame, path: str, max_terms: int = 1500) -> None:
    """Best terms of each sequence; a score outside [0, 1] is an error."""
    bad = F.raise_error(F.concat(F.lit("score outside [0, 1]: "), F.col("score").cast("string"))).cast("double")
    checked = predictions.withColumn("score", F.when(F.isnan("score") | F.col("score").between(0, 1), F.col("score")).otherwise(bad))
    save_table(top_terms(checked, max_terms).select("seq", "term", F.format_string("%.6f", "score").alias("score")), path)


def save_ontology_text(names: DataFrame, rel: DataFrame, terms_path: str, rel_path: str) -> None:
    """``id name`` and ``parent child`` lines, parents before children."""
    level = topological(rel)
    save_table(names.join(level, "id", "left").orderBy("level", "id").select("id", "name"), terms_path)
    save_table(rel.join(level.withColumnRenamed("id", "parent"), "parent").orderBy("level", "parent", "child").select("parent", "child"), rel_path)


def save_matrix_csv(long: DataFrame, columns: list[str], path: str, digits: int = 6) -> None:
    """A wide CSV with header from ``row_tag, col_tag, v``; missing cells are 0."""
    wide = long.groupBy("row_tag").pivot("col_tag", columns).agg(F.first("v")).na.fill(0.0)
    wide.select(F.col("row_tag").alias("id"), *[F.format_string(f"%.{digits}e", F.col(f"`{c}`")).alias(c) for c in columns]).write.mode("overwrite").csv(path, header=True)


def save_ontology(ontology: dict[str, DataFrame], path: str) -> None:
    """``terms``, ``rel`` and ``alt``, as :func:`netloom.sources.text.read_obo` returns them, as Parquet."""
    for name in ("terms", "rel", "alt"):
        ontology[name].write.mode("overwrite").parquet(f"{path}/{name}")


def load_ontology(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("terms", "rel", "alt")}


def save_matrix(cells: DataFrame, path: str) -> None:
    """``row_tag, col_tag, v`` as Parquet."""
    cells.select("row_tag", "col_tag", "v").write.mode("overwrite").parquet(path)


def load_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("row_tag", "col_tag", "v")
