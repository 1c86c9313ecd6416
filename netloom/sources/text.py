"""Readers of the text formats, each with an explicit schema.

``line`` counts lines from 0 through a file, and through all files in the order
of their paths, however Spark cuts and packs them: a file and its lines in
several are read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netloom.operators.network import Network, from_edges
from netloom.operators.tailstat import last_score


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``line, value``: every line with its number.

    Rows of one block of a file are read in order by one task, so the number is
    the place within the block and the lines of all blocks before it, in the
    order of paths and of their starts.  A block is a row of what is sent out.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row")]
    read = spark.read.text(path).select(*place, "value")
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    span = read.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    span = span.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return read.join(F.broadcast(span), ["_file", "_start"]).select((F.col("_base") + F.col("_row")).alias("line"), "value")


def _fields(spark: SparkSession, path: str, names: list[str], delimiter: str = r"\s+") -> DataFrame:
    parts = F.split(F.trim("value") if delimiter == r"\s+" else F.col("value"), delimiter)
    told = lines(spark, path).where(F.trim("value") != "").withColumn("_f", parts)
    return told.select("line", *[F.get("_f", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """``line, id``: one row per token; several tokens may share a line."""
    return lines(spark, path).select("line", F.explode(F.split(F.trim("value"), r"\s+")).alias("id")).where("id <> ''")


def read_lines(spark: SparkSession, path: str, kind: str = "char") -> DataFrame:
    """``line, value``: one item per line, as text or as numbers."""
    value = F.col("value") if kind == "char" else F.expr("try_cast(trim(value) AS DOUBLE)")
    return lines(spark, path).select("line", value.alias("value"))


def read_network(spark: SparkSession, edges: str, nodes: str | None = None, delimiter: str = "\t") -> Network:
    """An edge file ``src, dst, weight``; see :func:`netloom.operators.network.from_edges` for its rules.

    Fields count as the delimiter cuts them; a short row has no weight and is
    dropped.
    """
    rows = _fields(spark, edges, ["src", "dst", "weight"], _literal(delimiter))
    return from_edges(rows.where("src <> '' and dst <> ''"), read_items(spark, nodes).select("id") if nodes else None)


def _literal(delimiter: str) -> str:
    return r"\Q" + delimiter + r"\E"


def read_nodes(spark: SparkSession, path: str) -> Network:
    """A network of vertices without edges."""
    none = spark.range(0).select(F.lit("").alias("src"), F.lit("").alias("dst"), F.lit(0.0).alias("w"))
    return Network(read_items(spark, path).select("id").distinct(), none)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``line, id, label``: 1 is positive, anything else is not."""
    return _fields(spark, path, ["id", "label"]).select("line", "id", F.coalesce(F.col("label") == "1", F.lit(False)).alias("label"))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """``id, score``: the last score of an id counts."""
    rows = _fields(spark, path, ["id", "score"]).select("line", "id", F.expr("try_cast(score AS DOUBLE)").alias("score"))
    return last_score(rows.where("score is not null"))


def read_calibration(spark: SparkSession, path: str) -> DataFrame:
    """``id, score``: empty, ``NAS`` and ``STL`` count as 0; a score outside [0, 1] is an error."""
    rows = _fields(spark, path, ["id", "score"], r"\t")
    empty = F.coalesce(F.trim("score"), F.lit("")).isin("", "NAS", "STL")
    value = F.when(empty, 0.0).otherwise(F.expr("try_cast(score AS DOUBLE)"))
    bad = F.raise_error(F.concat(F.lit("score outside [0, 1]: "), F.coalesce("score", F.lit("")))).cast("double")
    return rows.select("id", F.when(value.between(0, 1), value).otherwise(bad).alias("score"))


def read_aucs(spark: SparkSession, path: str) -> DataFrame:
    """``id, cutoff, steps, auc`` from four fields, or ``tag, auc`` rows from two: ``id`` is then the tag."""
    rows = _fields(spark, path, ["id", "cutoff", "steps", "auc"])
    short = F.col("steps").isNull()
    return rows.select("line", "id", F.when(~short, F.col("cutoff")).alias("cutoff"), "steps", F.expr("try_cast(coalesce(auc, cutoff) AS DOUBLE)").alias("auc"))


def read_p_values(spark: SparkSession, path: str) -> DataFrame:
    """``line, p``; the last line is the run without resampling."""
    return read_lines(spark, path, "numeric").select("line", F.col("value").alias("p"))


def read_annotations(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``seq, term`` from one or several two-column files."""
    return _fields(spark, paths, ["seq", "term"]).select("seq", "term")


def read_config(spark: SparkSession, path: str) -> dict[str, str]:
    """``name = value`` lines; ``#`` starts a comment; a line without ``=`` is an error."""
    out = {}
    said = spark.read.text(path).where(F.trim(F.substring_index("value", "#", 1)) != "")
    for row in said.toLocalIterator():
        text = row["value"].split("#", 1)[0].strip()
        if text:
            name, sign, value = text.partition("=")
            if not sign:
                raise ValueError(f"no '=' in {text!r}")
            out[name.strip()] = value.strip()
    return out


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``id, comment, data``: records start at ``>`` on a new line; data lines are trimmed and joined; records without data are dropped."""
    record = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>|\r", "").alias("value"))
    head = F.substring_index("value", "\n", 1)
    rest = F.when(F.instr("value", "\n") > 0, F.expr("substring(value, instr(value, '\n') + 1)")).otherwise("")
    clean = record.select(F.regexp_extract(head, r"^\s*(\S*)", 1).alias("id"), F.trim(F.regexp_extract(head, r"^\s*\S*\s+(.*)$", 1)).alias("comment"), F.regexp_replace(rest, r"\s+", "").alias("data"))
    return clean.where("data <> ''")


def alphabet(sequences: DataFrame, kind: str = "protein") -> DataFrame:
    """Upper-case data, and ``valid`` for letters A-Z (protein) or A, T, C, G, U (dna)."""
    pattern = {"protein": "^[A-Z]*$", "dna": "^[ATCGU]*$"}[kind]
    return sequences.withColumn("data", F.upper("data")).withColumn("valid", F.col("data").rlike(pattern))


def read_obo(spark: SparkSession, path: str, relations: list[str] | None = None) -> dict[str, DataFrame]:
    """``terms(id, name)``, ``rel(child, parent)``, ``alt(alt_id, id)`` of an ontology file.

    Only ``[Term]`` stanzas count and obsolete ones are skipped.  ``is_a`` always
    makes a parent, other relationships whose type starts with one of
    ``relations`` as well.  A parent that is defined nowhere becomes a term.  An
    alternative id that is also a term is an error.
    """
    stanza = spark.read.option("lineSep", "\n[").text(path).where(F.col("value").rlike(r"^\[?Term\]"))
    tag = stanza.select(F.transform(F.split("value", r"\r?\n"), lambda x: F.regexp_extract(x, r"^([a-z_]+):\s*(.*)$", 0)).alias("t"))
    value = lambda name: F.transform(F.filter("t", lambda x: x.startswith(f"{name}:")), lambda x: F.trim(F.regexp_replace(F.substring_index(x, "!", 1), r"^[^:]*:", "")))
    term = tag.select(F.get(value("id"), F.lit(0)).alias("id"), F.get(value("name"), F.lit(0)).alias("name"), value("alt_id").alias("alt"), value("is_a").alias("is_a"), value("relationship").alias("other"), F.array_contains(value("is_obsolete"), "true").alias("gone"))
    term = term.where("id is not null and not gone")
    parents = term.select(F.col("id").alias("child"), F.explode("is_a").alias("parent"))
    wanted: Column = F.lit(False)
    for r in relations or []:
        wanted |= F.col("o").startswith(r)
    more = term.select(F.col("id").alias("child"), F.explode("other").alias("o")).where(wanted).select("child", F.get(F.split("o", r"\s+"), F.lit(1)).alias("parent"))
    rel = parents.union(more).select("child", F.split("parent", r"\s+")[0].alias("parent")).distinct()
    undefined = rel.select(F.col("parent").alias("id")).distinct().join(term.select("id"), "id", "left_anti").withColumn("name", F.lit(""))
    alt = term.select(F.explode("alt").alias("alt_id"), "id").distinct()
    clash = alt.join(term.select(F.col("id").alias("alt_id")), "alt_id", "left_semi").limit(1).collect()
    if clash:
        raise ValueError(f"{clash[0]['alt_id']} is both a term and an alternative id")
    return {"terms": term.select("id", "name").distinct().union(undefined), "rel": rel, "alt": alt}


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """``seq, term, score`` of a prediction file; header tags are skipped and lines from ``END`` on ignored; the last score counts."""
    rows = lines(spark, path)
    end = rows.where(F.trim("value") == "END").agg(F.min("line").alias("_end"))
    body = rows.join(F.broadcast(end)).where((F.col("line") < F.coalesce("_end", F.lit((1 << 63) - 1))) & ~F.col("value").rlike(r"^\s*(AUTHOR|MODEL|KEYWORDS|ACCURACY|END)\b") & (F.trim("value") != ""))
    f = F.split(F.trim("value"), r"\s+")
    told = body.select("line", F.get(f, F.lit(0)).alias("seq"), F.get(f, F.lit(1)).alias("term"), F.get(f, F.lit(2)).try_cast("double").alias("score")).where("score is not null")
    return told.groupBy("seq", "term").agg(F.max_by("score", "line").alias("score"))


def read_matrix(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """``row, x``: one array of numbers per row; ``row`` follows the file."""
    rows = lines(spark, path).where(F.trim("value") != "")
    if header:
        rows = rows.join(F.broadcast(rows.agg(F.min("line").alias("_first")))).where(F.col("line") > F.col("_first"))
    return rows.select(F.col("line").alias("row"), F.transform(F.split("value", r"\s*,\s*"), lambda x: x.try_cast("double")).alias("x"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, trim: bool = True, comment: str | None = None, quote: str | None = '"', delimiter: str = ",", header: bool = False, overflow: str = "error", decimal_comma: bool = False, empty_lines: str = "skip") -> DataFrame:
    """A CSV file by policies: trimming, comments, empty lines, doubled quotes, overflow and decimal commas.

    A line whose first character is one of ``comment`` is none.  ``empty_lines``:
    ``skip`` takes lines of blanks as comments, ``row`` as rows of nulls.
    ``overflow`` of a number: ``error`` fails, ``ignore`` gives null, ``saturate``
    the nearest number of the type.  Columns are bound by position, or by name
    with ``header``; rows that are too short get nulls.
    """
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in want])
    reader = spark.read.option("sep", delimiter).option("header", header).option("enforceSchema", not header).option("ignoreLeadingWhiteSpace", trim).option("ignoreTrailingWhiteSpace", trim)
    reader = reader.option("quote", quote or "").option("escape", quote or "")
    if empty_lines not in ("skip", "row"):
        raise ValueError("empty_lines is skip or row")
    if empty_lines == "row" or len(comment or "") > 1:
        if header:
            raise ValueError("a header goes with one comment character, and with empty lines skipped")
        value = F.rtrim(F.col("value"), F.lit(" \t"))
        said = lines(spark, path).where(~F.left("value", F.lit(1)).isin(list(comment or "")) & ((F.lit(empty_lines == "row")) | (value != "")))
        options = {"sep": delimiter, "quote": quote or "", "escape": quote or "", "ignoreLeadingWhiteSpace": str(trim).lower(), "ignoreTrailingWhiteSpace": str(trim).lower(), "mode": "PERMISSIVE"}
        fields = ", ".join(f"`{f.name}` string" for f in want)
        rows = said.select(F.when(value != "", F.from_csv("value", fields, options)).alias("f")).select(*[F.col("f")[f.name].alias(f.name) for f in want])
    else:
        if comment:
            reader = reader.option("comment", comment)
        rows = reader.schema(text).csv(path)
    limits = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}
    out = []
    for f in want:
        c, kind = F.col(f.name), f.dataType.simpleString()
        if decimal_comma and kind in ("double", "float"):
            c = F.regexp_replace(c, ",", ".")
        if kind == "string":
            cast = c
        elif overflow == "error":
            cast = c.cast(f.dataType)
        elif overflow == "saturate" and kind in limits:
            top = (1 << limits[kind]) - 1
            wide = c.try_cast("decimal(38,0)")
            cast = F.least(F.greatest(wide, F.lit(-top - 1).cast("decimal(38,0)")), F.lit(top).cast("decimal(38,0)")).cast(f.dataType)
        else:
            cast = c.try_cast(f.dataType)
        out.append(cast.alias(f.name))
    return rows.select(*out)
