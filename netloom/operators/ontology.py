"""Ontologies: directed acyclic ``(child, parent)`` relations, and annotations on them.

Depth and order need a row a term: runs of terms with one parent each are
jumped over in doubling steps, and what is left is peeled from the top.  Scores
and annotations go up level by level, combined at each.  Where all ancestors
are asked for, ways up double their length per round.  A term that is its own
ancestor, by a loop to itself too, is an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.operators.hubs import join_by_key
from netloom.plans.session import cut, discard

#: Levels up to which scores go up one by one.
MOST_LEVELS = 64
#: Terms of a block, about, and blocks that go out by broadcast at once.
BLOCK, SENT = 32, 1 << 15


class CycleError(ValueError):
    """The relations do not form an acyclic graph."""


def terms(rel: DataFrame) -> DataFrame:
    return rel.select(F.explode(F.array("child", "parent")).alias("id")).distinct()


def roots(rel: DataFrame) -> DataFrame:
    return terms(rel).join(rel.select(F.col("child").alias("id")), "id", "left_anti")


def leaves(rel: DataFrame) -> DataFrame:
    return terms(rel).join(rel.select(F.col("parent").alias("id")), "id", "left_anti")


def parents(rel: DataFrame, ids: DataFrame) -> DataFrame:
    return rel.join(ids.select(F.col("id").alias("child")), "child", "left_semi").select("child", "parent")


def children(rel: DataFrame, ids: DataFrame) -> DataFrame:
    """Children of a set, less the set itself."""
    found = rel.join(ids.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
    return found.join(ids.select("id"), "id", "left_anti")


def resolve(ids: DataFrame, known: DataFrame, alt: DataFrame) -> DataFrame:
    """``id, valid``: the id itself if known, else the one it stands for; null if neither."""
    a = alt.select(F.col("alt_id").alias("id"), F.col("id").alias("_alt"))
    k = known.select("id", F.col("id").alias("_own"))
    return ids.join(k, "id", "left").join(a, "id", "left").select("id", F.coalesce("_own", "_alt").alias("valid"))


def ways_up(rel: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``id, ancestor, near, far``: every strict ancestor of each term, with the shortest and the longest way to it; within ``keys``, if given."""
    keys = keys or []
    known = cut(rel.select(*keys, F.col("child").alias("id"), F.col("parent").alias("ancestor")).distinct().withColumns({"near": F.lit(1), "far": F.lit(1)}))
    before = None
    while True:
        told = known.agg(F.count("*").alias("n"), F.sum("near"), F.sum("far"), F.count(F.when(F.col("id") == F.col("ancestor"), 1)).alias("loops")).first()
        if told["loops"]:
            raise CycleError("a term is its own ancestor")
        if told == before:
            return known
        above = known.select(*keys, F.col("id").alias("ancestor"), F.col("ancestor").alias("top"), F.col("near").alias("near2"), F.col("far").alias("far2"))
        longer = known.join(above, [*keys, "ancestor"]).select(*keys, "id", F.col("top").alias("ancestor"), (F.col("near") + F.col("near2")).alias("near"), (F.col("far") + F.col("far2")).alias("far"))
        old, before = known, told
        known = cut(known.union(longer).groupBy(*keys, "id", "ancestor").agg(F.min("near").alias("near"), F.max("far").alias("far")))
        discard(old)


def closure(rel: DataFrame) -> DataFrame:
    """``id, ancestor`` for every term and each of its ancestors, itself included."""
    return ways_up(rel).select("id", "ancestor").union(terms(rel).select("id", F.col("id").alias("ancestor")))


def ancestors(rel: DataFrame, ids: DataFrame) -> DataFrame:
    """Ancestors of a set, itself included; unknown ids are ignored."""
    return closure(rel).join(ids.select("id"), "id", "left_semi").select(F.col("ancestor").alias("id")).distinct()


def offspring(rel: DataFrame, ids: DataFrame) -> DataFrame:
    return closure(rel).join(ids.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()


def _anchored(rel: DataFrame) -> DataFrame:
    """``id, anchor, way, own``: for every term the first one on its way up that has no parent or several, and how far it is; itself, 0, where it is one.

    ``rel`` holds each relation once.  A term with a single parent points to
    it; pointers double their length per round, so a chain takes the logarithm
    of its length.  Pointers that never end run in a loop.
    """
    lone = rel.groupBy("child").agg(F.count("*").alias("n"), F.first("parent").alias("parent")).where("n = 1")
    jump = cut(lone.select(F.col("child").alias("id"), F.col("parent").alias("anchor"), F.lit(1).cast("long").alias("way")))
    total = jump.count()
    for _ in range(total.bit_length() + 1):
        held = jump.groupBy(F.col("anchor").alias("id")).agg(F.count("*").alias("n"))
        above = jump.join(held, "id").select(F.col("id").alias("anchor"), F.col("anchor").alias("top"), F.col("way").alias("more"), "n")
        if above.isEmpty():
            break
        longer = join_by_key(jump, above, ["anchor"], "n", total).select("id", F.col("top").alias("anchor"), (F.col("way") + F.col("more")).alias("way"))
        ended = jump.join(above.select("anchor"), "anchor", "left_anti").select("id", "anchor", "way")
        old, jump = jump, cut(longer.union(ended))
        discard(old)
    else:
        if total:
            raise CycleError("a term is its own ancestor")
    own = terms(rel).join(jump.select("id"), "id", "left_anti")
    return jump.union(own.select("id", F.col("id").alias("anchor"), F.lit(0).cast("long").alias("way")))


def levels(rel: DataFrame) -> DataFrame:
    """``id, depth, level``: the shortest and the longest way from a root to each term; written down.

    Terms with several parents are told once all of these are (Kahn's order); a
    round tells all that can be told, with the runs of single parents below
    them.  So there are as many rounds as terms with several parents lie above
    each other, and no state is larger than the relations.
    """
    rel = cut(rel.select("child", "parent").where("child is not null and parent is not null").distinct())
    if not rel.where("child = parent").isEmpty():
        raise CycleError("a term is its own ancestor")
    place = cut(_anchored(rel))
    several = place.where("id = anchor").select(F.col("id").alias("child"))
    up = rel.join(several, "child").join(place.withColumnRenamed("id", "parent"), "parent")
    links = cut(up.groupBy("child", "anchor").agg((F.min("way") + 1).alias("near"), (F.max("way") + 1).alias("far")))
    told = cut(several.join(links.select("child").distinct(), "child", "left_anti").select(F.col("child").alias("anchor"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("level")))
    waiting = cut(links.groupBy("child").agg(F.count("*").alias("open")).withColumns({"depth": F.lit(None).cast("long"), "level": F.lit(None).cast("long")}))
    found, new = [told], told
    left = waiting.count()
    while left:
        come = links.join(new, "anchor").groupBy("child").agg(F.count("*").alias("n"), F.min(F.col("depth") + F.col("near")).alias("d"), F.max(F.col("level") + F.col("far")).alias("l"))
        after = cut(waiting.join(come, "child", "left").select("child", (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"), F.least("depth", "d").alias("depth"), F.greatest("level", "l").alias("level")))
        discard(waiting)
        new = cut(after.where("open = 0").select(F.col("child").alias("anchor"), "depth", "level"))
        waiting = after.where("open > 0")
        got = new.count()
        if not got:
            raise CycleError("a term is its own ancestor")
        left -= got
        found.append(new)
        if len(found) > 32:
            found = [cut(reduce(DataFrame.union, found))]
    anchor = reduce(DataFrame.union, found)
    held = place.groupBy("anchor").agg(F.count("*").alias("n"))
    every = join_by_key(place, anchor.join(held, "anchor"), ["anchor"], "n", place.count())
    out = cut(every.select("id", (F.col("depth") + F.col("way")).cast("int").alias("depth"), (F.col("level") + F.col("way")).cast("int").alias("level")))
    discard(rel, place, links)
    return out


def depths(rel: DataFrame) -> DataFrame:
    """``id, depth``: 0 at the roots, else one more than the smallest depth of a parent."""
    return levels(rel).select("id", "depth")


def topological(rel: DataFrame) -> DataFrame:
    """``id, level``: the longest way from a root; ordered by it and the id, parents come before children."""
    return levels(rel).select("id", "level")


def branching_factor(rel: DataFrame) -> DataFrame:
    return rel.select("child", "parent").distinct().agg(F.try_divide(F.count("*").cast("double"), F.countDistinct("parent")).alias("branching"))


def subontology(rel: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations among the listed terms, where children of dropped terms go to the dropped terms' parents.

    A way up is only followed through dropped terms.
    """
    return subontologies(rel, ids.select(F.lit(0).alias("member"), "id"), 1).select("child", "parent")


def subontologies(rel: DataFrame, chosen: DataFrame, members: int) -> DataFrame:
    """``member, child, parent``: the sub-ontology of each member 0 to ``members - 1``, whose terms are its rows of ``chosen`` (``member, id``).

    All members are contracted together; a relation is a row for each of them.
    """
    each = rel.select("child", "parent").distinct().withColumn("member", F.explode(F.array(*[F.lit(m) for m in range(members)])))
    rel = cut(each.select("member", "child", "parent"))
    chosen = chosen.select(F.col("member").cast("int").alias("member"), "id").distinct()
    inside = lambda df, c: df.join(chosen.withColumnRenamed("id", c), ["member", c], "left_semi").select(*df.columns)
    outside = lambda df, c: df.join(chosen.withColumnRenamed("id", c), ["member", c], "left_anti").select(*df.columns)
    passed = ways_up(outside(rel, "child"), ["member"]).select("member", F.col("id").alias("parent"), F.col("ancestor").alias("top"))
    own = inside(rel, "child")
    led = outside(own, "parent").join(passed, ["member", "parent"]).select("member", "child", F.col("top").alias("parent"))
    return inside(own.union(led), "parent").select("member", "child", "parent").distinct()


def split(rel: DataFrame) -> DataFrame:
    """``root, child, parent``: the relations among the terms under each root."""
    over = closure(rel).join(roots(rel).withColumnRenamed("id", "ancestor"), "ancestor", "left_semi").select(F.col("ancestor").alias("root"), "id")
    over = cut(over)
    a = rel.join(over.select("root", F.col("id").alias("child")), "child")
    return a.join(over.select("root", F.col("id").alias("parent")), ["root", "parent"], "left_semi").select("root", "child", "parent").distinct()


def leaves_of(rel: DataFrame, ids: DataFrame) -> DataFrame:
    """Terms of a set without a strict descendant in it."""
    chosen = ids.select("id").distinct()
    below = closure(rel).where("id <> ancestor").join(chosen, "id", "left_semi").select(F.col("ancestor").alias("id"))
    return chosen.join(terms(rel), "id", "left_semi").join(below, "id", "left_anti")


def annotate(rows: DataFrame, known: DataFrame, alt: DataFrame) -> DataFrame:
    """``seq, term``: annotations with alternative ids resolved and unknown terms dropped."""
    told = resolve(rows.select(F.col("term").alias("id")).distinct(), known, alt).where("valid is not null")
    return rows.join(told.withColumnRenamed("id", "term"), "term").select("seq", F.col("valid").alias("term")).distinct()


def carried(scores: DataFrame, rel: DataFrame) -> DataFrame:
    """``seq, term, score``: each term scores as high as its best descendant; terms without a relation are left out.

    The lowest level goes first.  What a level has is combined once, before and
    after the shuffle, and handed to the parents, so every row of the result
    goes up once by each relation of its term.  Hierarchies of over MOST_LEVELS
    are carried by their closure, whose rounds are few.
    """
    place = levels(rel).select("id", "level")
    deep = place.agg(F.max("level")).first()[0] or 0
    if deep > MOST_LEVELS:
        up = scores.join(closure(rel).withColumnRenamed("id", "term"), "term")
        return up.groupBy("seq", F.col("ancestor").alias("term")).agg(F.max("score").alias("score"))
    at = place.withColumnRenamed("id", "term")
    above = rel.select("child", "parent").distinct().join(place.withColumnRenamed("id", "parent"), "parent").select(F.col("child").alias("term"), "parent", "level")
    parts, done = [cut(scores.join(at, "term").groupBy("seq", "term", "level").agg(F.max("score").alias("score")), by="level")], []
    for level in range(deep, -1, -1):
        here = reduce(DataFrame.union, [p.where(F.col("level") == level) for p in parts])
        done.append(cut(here.groupBy("seq", "term").agg(F.max("score").alias("score"))))
        if level:
            sent = done[-1].join(above, "term").groupBy("seq", F.col("parent").alias("term"), "level").agg(F.max("score").alias("score"))
            parts.append(cut(sent, by="level"))
    discard(*parts)
    return reduce(DataFrame.union, done)


def replenish(annotation: DataFrame, rel: DataFrame) -> DataFrame:
    """Annotations carried to all ancestors."""
    return carried(annotation.select("seq", "term", F.lit(1).alias("score")), rel).select("seq", "term")


def propagate_scores(predictions: DataFrame, rel: DataFrame) -> DataFrame:
    """``seq, term, score``: each term scores as high as its best descendant."""
    return carried(predictions.select("seq", "term", "score"), rel)


def counts(annotation: DataFrame, known: DataFrame) -> DataFrame:
    """One row: sequences, terms (all of the ontology) and annotations."""
    a = annotation.agg(F.countDistinct("seq").alias("n_sequences"), F.count("*").alias("n_annotations"))
    return a.join(known.agg(F.count("*").alias("n_terms"))).select("n_sequences", "n_terms", "n_annotations")


POSITIVE = ("positive", "colocalizes_with", "contributes_to")


def annotation_matrix(annotation: DataFrame, chosen: list[str]) -> DataFrame:
    """``seq`` and a 0/1 column per chosen term; the long form is the natural one for more terms."""
    yes = F.col("qualifier").isin(*POSITIVE) if "qualifier" in annotation.columns else F.lit(True)
    return annotation.where(yes).groupBy("seq").pivot("term", chosen).agg(F.lit(1)).na.fill(0)


def transfer_terms(annotation: DataFrame, src: str, dst: str) -> DataFrame:
    """Copy the terms of one sequence to another."""
    return annotation.union(annotation.where(F.col("seq") == src).select(F.lit(dst).alias("seq"), "term")).distinct()


def transfer_sequences(annotation: DataFrame, src: str, dst: str) -> DataFrame:
    """Copy the sequences of one term to another that has some."""
    there = annotation.where(F.col("term") == dst).limit(1).select(F.lit(1).alias("_x"))
    copied = annotation.where(F.col("term") == src).join(F.broadcast(there)).select("seq", F.lit(dst).alias("term"))
    return annotation.union(copied).distinct()


def top_terms(predictions: DataFrame, k: int = 1500) -> DataFrame:
    """The ``k`` best terms of each sequence, rounded to 6 decimals; NaN counts as 0 and scores must end above it."""
    scored = predictions.withColumn("score", F.round(F.nanvl(F.col("score"), F.lit(0.0)), 6)).where("score > 0")
    over = Window.partitionBy("seq").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k)


def names(known: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, name`` of the listed terms of ``known`` (``id, name``); null for an unknown one."""
    return ids.select("id").join(known.select("id", "name"), "id", "left")


def size(rel: DataFrame, known: DataFrame | None = None) -> int:
    """How many terms there are: those of the relations, and those of ``known`` (``id``) that have none."""
    every = terms(rel) if known is None else terms(rel).union(known.select("id")).distinct()
    return every.count()


def equal(one: DataFrame, other: DataFrame) -> bool:
    """Whether two ontologies list the same terms in the same order, parents first."""
    a, b = topological(one), topological(other)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def terms_of(annotation: DataFrame, sequences: DataFrame) -> DataFrame:
    """``seq, term``: what the listed sequences (``seq``) are annotated with."""
    return annotation.join(sequences.select("seq"), "seq", "left_semi").select("seq", "term").distinct()


def sequences_of(annotation: DataFrame, wanted: DataFrame) -> DataFrame:
    """``term, seq``: what is annotated with the listed terms (``term``)."""
    return annotation.join(wanted.select("term"), "term", "left_semi").select("term", "seq").distinct()


def add_annotations(annotation: DataFrame, rows: DataFrame) -> DataFrame:
    return annotation.select("seq", "term").union(rows.select("seq", "term")).distinct()


def remove_annotations(annotation: DataFrame, rows: DataFrame) -> DataFrame:
    return annotation.join(rows.select("seq", "term"), ["seq", "term"], "left_anti").select("seq", "term")


def densified(best: DataFrame, sequences: DataFrame, known: DataFrame, size: int = BLOCK, sent: int = SENT) -> DataFrame:
    """``seq, term, score``: every one of ``sequences`` (``seq``, each once) has every term of ``known`` (``id``), 0 where ``best`` (each pair once) has none.

    Terms are dealt into blocks.  Of a block that a sequence has no score in all
    terms are told at once, of the others those without one; the blocks go out
    by broadcast.  So only what has a score is shuffled and written, and each
    row of the grid is made where it is read.
    """
    every = known.select(F.col("id").alias("term")).where("term is not null").distinct()
    n = every.count() // size + 1
    block = F.pmod(F.xxhash64("term"), F.lit(n)).cast("int").alias("block")
    blocks = cut(every.groupBy(block).agg(F.collect_list("term").alias("every")))
    scored = cut(best.where("seq is not null").join(every, "term", "left_semi").select("seq", "term", F.coalesce("score", F.lit(0.0)).alias("score"), block))
    own = cut(scored.groupBy("seq", "block").agg(F.collect_list("term").alias("own")))
    held = own.groupBy("seq").agg(F.collect_list("block").alias("held"))
    parts = int(best.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # each row makes many: as many files as tasks
    lacking = cut(sequences.join(held, "seq", "left").select("seq", F.coalesce("held", F.array().cast("array<int>")).alias("held")).repartition(parts))
    out = scored.select("seq", "term", "score")
    for k in range(0, n, sent):
        some = F.broadcast(blocks.where(F.col("block").between(k, k + sent - 1)))
        rest = own.join(some, "block").select("seq", "own", F.explode("every").alias("term")).where(~F.array_contains("own", F.col("term"))).drop("own")
        whole = lacking.join(some, ~F.array_contains("held", F.col("block"))).select("seq", F.explode("every").alias("term"))
        out = out.union(rest.union(whole).withColumn("score", F.lit(0.0)))
    return out


def load_predictions(rows: DataFrame, known: DataFrame, alt: DataFrame, rel: DataFrame, dense: bool = True) -> DataFrame:
    """``seq, term, score`` of predictions as the ontology has them.

    Alternative ids become the terms they stand for and unknown terms go; each
    term scores as high as its best descendant; with ``dense`` every sequence
    has every term of ``known`` (``id``), 0 where nothing scores it.
    """
    rows = cut(rows.select("seq", "term", "score"))
    told = resolve(rows.select(F.col("term").alias("id")).distinct(), known.select("id"), alt).where("valid is not null")
    own = cut(rows.join(told.withColumnRenamed("id", "term"), "term").groupBy("seq", F.col("valid").alias("term")).agg(F.max("score").alias("score")))
    lone = known.select("id").join(terms(rel), "id", "left_anti").distinct()
    best = carried(own, rel).union(own.join(lone.withColumnRenamed("id", "term"), "term").select("seq", "term", "score"))
    out = densified(best, rows.select("seq").distinct(), known) if dense else best
    if dense:
        discard(own)
    discard(rows)
    return out
