"""Similarity joins by shared keys: links that connect what all similar pairs with a key in common connect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.operators.components import connected_components
from netloom.operators.hubs import join_by_key, needed
from netloom.plans.session import cut, discard

#: Pairs of one group are dealt to a task for each so many.
SALT = 512
#: Members of a group that all others are held against first, besides its pivot.
AGENTS = 4
#: Components of more members than this are large: what meets them is settled for all of it at once, where that can be done.
LARGE = 64
#: Stragglers are held against further members of their groups until the pairs left are no more than the members, or until
#: fewer than one in SELDOM of these pairs is a link, in so many rounds at most.
ROUNDS, SELDOM = 4, 50
#: Members of a group that a straggler is held against in one row, where their texts are at hand.
TILE = 64


def meeting(members: DataFrame, traits: DataFrame) -> DataFrame:
    """``key, id, n, t`` of ``members`` (``key, id``, each pair once) whose key is shared by ``n`` of two or more; written down.

    ``traits`` (``id, t``) tells of each member what a first look at a pair needs.
    """
    shared = cut(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    rows = cut(needed(members, F.col("key"), shared.select("key"))[0])
    met = cut(join_by_key(rows, shared.withColumn("size", F.col("n")), ["key"], "n", total).withColumnRenamed("size", "n"))
    weight = met.groupBy("id").agg(F.sum("n").alias("w")).join(traits, "id")
    out = cut(met.join(weight, "id"))
    discard(shared, rows, met)
    return out


def _salted(pairs: DataFrame) -> DataFrame:
    """``a, b, salt`` once each, from ``a, b, n``."""
    salt = F.pmod(F.xxhash64("b"), F.floor(F.col("n") / SALT) + 1)
    return pairs.groupBy("a", "b").agg(F.min(salt).alias("salt"))


def _placed(met: DataFrame, links: DataFrame, total: int, large: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``id, comp, many`` of what ``links`` name, ``met`` with ``comp``, and the members of groups in which components meet.

    ``many`` is the size of a component of more than ``large`` members, else null.
    """
    component = cut(connected_components(links).withColumnRenamed("component", "comp"))
    placed = component.withColumn("many", F.lit(None).cast("long"))
    if large is not None:
        most = component.groupBy("comp").agg(F.count("*").alias("many")).where(F.col("many") > large)
        placed = component.join(most, "comp", "left").select("id", "comp", "many")
    told = cut(met.join(placed, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    each = told.groupBy("key", "comp").agg(F.count("*").alias("c"), F.max("many").alias("many"))
    large = F.collect_list(F.when(F.col("many").isNotNull(), F.struct("many", "comp")))
    mixed = each.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("best"), F.sum("c").alias("n"), F.count("*").alias("kinds"), large.alias("large")).where("kinds > 1")
    mixed = mixed.select("key", "n", F.col("best.comp").alias("main"), "large", (F.floor(F.col("n") / SALT) + 1).alias("salts"))
    return placed, told, cut(join_by_key(told.withColumn("size", F.col("n")).drop("n"), mixed, ["key"], "n", total))


def _further(group: DataFrame, alike: Callable[[str, str, str], Column], turn: int, total: int) -> DataFrame:
    """``a, b, n``: stragglers of each group and four others of it: of the main component one by chance and those with the least and
    the greatest traits, at its rim, and the straggler that meets most."""
    one = F.struct("t", "id", "comp")
    main, stray = F.col("comp") == F.col("main"), F.col("comp") != F.col("main")
    chance = F.min(F.when(main, F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), one.alias("m"))))["m"]
    middle = F.max(F.when(stray, F.struct("w", one.alias("m"))))["m"]
    rim = [F.min(F.when(main, one)), F.max(F.when(main, one))]
    lead = group.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(chance, middle, *rim)).alias("lead"))
    held = join_by_key(group.where(stray).select("key", "id", "comp", "t", "size"), lead, ["key"], "n", total)
    held = held.select("id", "comp", F.col("t").alias("tb"), "size", F.explode("lead").alias("lead")).where("comp <> lead.comp")
    held = held.select(F.least("lead.id", "id").alias("a"), F.greatest("lead.id", "id").alias("b"), F.col("lead.t").alias("ta"), "tb", F.col("size").alias("n"))
    return held.where(alike("ta", "tb", "n")).select("a", "b", "n")


def _in_tiles(single: DataFrame, rest: Callable[[Column, Column, Column], Column], text: DataFrame, similar_texts: Callable[[Column, Column], Column]) -> DataFrame:
    """``(a, b)``: similar pairs of a straggler and another component of its group, from a row for each straggler and tile of TILE members.

    A pair that meets in several groups is looked at in the one of least key.
    """
    keys = single.groupBy("id").agg(F.collect_list("key").alias("keys"))
    tiles = F.floor(F.col("size") / TILE) + 1
    member = F.struct("id", "comp", (F.col("comp") == F.col("main")).alias("main"), "t", "keys", "line").alias("m")
    told = cut(single.join(keys.join(text, "id"), "id").select("key", "size", tiles.alias("tiles"), member))
    tile = told.groupBy("key", F.pmod(F.xxhash64("m.id"), F.col("tiles")).alias("deal")).agg(F.collect_list("m").alias("tile"))
    stray = told.where("not m.main").select("key", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("deal"), "m")

    def found(o: Column) -> Column:
        m = F.col("m")
        # of two strays each meets the other once
        apart = (m["comp"] != o["comp"]) & (o["main"] | (m["id"] < o["id"])) & rest(m["t"], o["t"], F.col("size"))
        here = F.array_min(F.array_intersect(m["keys"], o["keys"])) == F.col("key")
        return apart & here & similar_texts(m["line"], o["line"])

    hits = stray.join(tile, ["key", "deal"]).select("m.id", F.explode(F.transform(F.filter("tile", found), lambda o: o["id"])).alias("o_id"))
    out = cut(hits.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b")).distinct())
    discard(told)
    return out


def similar(met: DataFrame, alike: Callable[[str, str, str], Column], judge: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame, DataFrame], DataFrame] | None = None, agents: int = AGENTS, rest: Callable[[str, str, str], Column] | None = None, rounds: int = 0, tiled: tuple[DataFrame, Callable[[Column, Column], Column]] | None = None) -> DataFrame:
    """``(a, b)``: pairs that ``judge`` finds similar and that connect all that similar pairs with a shared key connect.

    ``met`` is what ``meeting`` returns.  ``alike`` tells from the names of two
    members' traits, and of the size of the group they meet in, whether the
    pair is worth judging.  ``judge`` takes pairs ``a, b, salt``, each once, and returns
    the similar ones; a pair's ``a`` may stand in very many pairs, which
    ``salt`` deals into tasks.

    In each group all members are held against a few of it: the one that meets
    most others, which is near the middle of a family, and some by chance.
    What is in another component than most of the group after that is held
    against all of its group; only pairs that are alike leave the join.  So a
    family of any size costs a star and its stragglers.

    The first look may be choosier than the last one: ``rest``, if given, tells
    in place of ``alike`` which pairs of different components are worth judging.
    In up to ``rounds`` rounds stragglers are held against further members
    before that, so that a family wider than its star leaves few.

    ``tiled``, if given, is a frame of ``id, line`` and tells from two lines
    whether they are similar: what is still apart then is held against whole
    tiles of its group in a row each, and neither pairs nor their lines are
    shuffled.  ``alike`` and ``rest`` take columns too there.

    A large family may have many stragglers.  ``settle`` gets them as ``id,
    comp`` with the component that they met, and the members of these as ``id,
    comp``; it returns links to members, so that no row a pair is made.
    """
    total = met.count()
    told = F.struct("id", "t")
    some = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), told.alias("m")))["m"].alias(f"m{k}") for k in range(agents)]
    lead = met.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("w", told.alias("m")))["m"].alias("pivot"), *some)
    lead = lead.select("key", "n", F.array_distinct(F.array("pivot", *[f"m{k}" for k in range(agents)])).alias("lead"))
    held = join_by_key(met.withColumn("size", F.col("n")).drop("n"), lead, ["key"], "n", total)
    held = held.select(F.explode("lead").alias("lead"), F.col("id").alias("b"), F.col("t").alias("tb"), F.col("size").alias("n"))
    held = held.select(F.col("lead.id").alias("a"), F.col("lead.t").alias("ta"), "b", "tb", "n").where("a <> b").where(alike("ta", "tb", "n"))
    links = cut(judge(_salted(held)))

    rest = rest or alike
    placed, told, group = _placed(met, links, total, LARGE if settle else None)
    for turn in range(rounds):
        left = group.where("comp <> main").agg(F.sum("size")).first()[0] or 0
        if left <= total:
            break
        asked = cut(_salted(_further(group, rest, turn, total)))
        found = cut(judge(asked))
        links, seldom = links.union(found), found.count() * SELDOM < asked.count()
        discard(told, group, asked)
        placed, told, group = _placed(met, links, total, LARGE if settle else None)
        if seldom:
            break

    if settle:
        strays = group.select("id", F.struct(F.coalesce("many", F.lit(0)).alias("many"), "comp").alias("own"), F.explode("large").alias("of"))
        strays = cut(strays.where((F.col("own.comp") != F.col("of.comp")) & (F.col("own") < F.col("of"))).select("id", F.col("of.comp").alias("comp")).distinct())
        links = links.union(cut(settle(strays, placed.where("many is not null").select("id", "comp"))))

    if tiled:
        found = _in_tiles(group.where("many is null"), rest, *tiled)
        discard(told, group)
        return links.union(found)

    # of two strays each meets the other once
    apart = (F.col("comp") != F.col("o_comp")) & (F.col("o_main") | (F.col("id") < F.col("o_id")))
    single = group.where("many is null")
    stray = single.where("comp <> main").select("key", F.pmod(F.xxhash64("id"), F.col("salts")).alias("deal"), "id", "comp", "t", "size")
    deals = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("deal")
    every = single.select("key", deals, F.col("id").alias("o_id"), F.col("comp").alias("o_comp"), F.col("t").alias("o_t"), (F.col("comp") == F.col("main")).alias("o_main"))
    on = [stray[c] == every[c] for c in ("key", "deal")]
    pairs = stray.join(every, on[0] & on[1] & apart & rest("t", "o_t", "size"))
    rest = cut(judge(_salted(pairs.select(F.least("id", "o_id").alias("a"), F.greatest("id", "o_id").alias("b"), F.col("size").alias("n")))))
    discard(told, group)
    return links.union(rest)
