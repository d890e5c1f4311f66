"""Product against product: competitors, alternatives, battles, benchmarks, heat map.

"Best k of the others" is answered for all products at once without forming pairs: the
candidates of a group are ranked once, every product reads the first k + 1 of its groups and
drops itself. Work and shuffle stay linear in the products, also in a hot category.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewatlas.functions.columns import primary_niche
from reviewatlas.functions.frames import apart, keep_one, spread, top_k, whole
from reviewatlas.functions.neighbours import containment_pairs, nearest_within
from reviewatlas.operators import aspects

#: What a family without a niche looks for: in match-ups a word that no niche holds; elsewhere nothing in particular, so that every
#: candidate with a niche fits.
NO_NICHE, ANY_NICHE = "NONE", ""


def niche_members(parents: DataFrame) -> DataFrame:
    """(parent_asin, wanted): for every primary niche in use, the families whose niche list
    holds it as a substring; for the empty one, all families with a niche. Matching runs on the distinct niche words only."""
    words = parents.select("parent_asin", F.explode(F.split("niche", ",")).alias("_word")).withColumn(
        "_word", F.trim("_word")
    )
    wanted = parents.select(F.coalesce(primary_niche("niche"), F.lit(NO_NICHE)).alias("wanted")).filter(
        F.col("wanted") != ""
    )
    pairs = containment_pairs(wanted, "wanted", words, "_word")
    named = words.join(pairs, "_word").select("parent_asin", "wanted").distinct()
    return named.unionByName(parents.filter(F.col("niche").isNotNull()).select("parent_asin", F.lit(ANY_NICHE).alias("wanted")))


def _seekers(parents: DataFrame) -> DataFrame:
    return parents.filter(F.col("category").isNotNull()).select(
        "parent_asin", "category", F.coalesce(primary_niche("niche"), F.lit(ANY_NICHE)).alias("wanted")
    )


def best_of_category(candidates: DataFrame, parents: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """For every family the best ``k`` candidates of its category, niche matches first.

    ``candidates``: rows with ``parent_asin, category`` and what ``order`` needs; several rows
    per family are allowed. Result: seeker columns ``for_asin``, ``niche_match`` and ``rank``
    plus the candidate row. A family is never offered itself.
    """

    # rows of one family are dropped together, so k others need the best k + 1 families
    def leaders(df: DataFrame, by: list[str]) -> DataFrame:
        """Rows that can still be among the best k once one family is taken out."""
        per_family = top_k(df, [*by, "parent_asin"], order, k, rank="_in")
        first = per_family.filter("_in = 1")
        heads = top_k(first, by, order, k + 1, rank="_f").select(*by, "parent_asin", "_f")
        return per_family.join(heads, [*by, "parent_asin"], "left_semi").drop("_in")

    seekers = _seekers(parents)
    by_niche = leaders(candidates.join(niche_members(parents), "parent_asin"), ["category", "wanted"])
    by_category = leaders(candidates, ["category"])
    offered = (
        seekers.withColumnRenamed("parent_asin", "for_asin").join(by_niche, ["category", "wanted"])
        .withColumn("niche_match", F.lit(1))
        .unionByName(
            seekers.withColumnRenamed("parent_asin", "for_asin").join(by_category, "category")
            .withColumn("niche_match", F.lit(0))
        )
        .filter(F.col("for_asin") != F.col("parent_asin"))
    )
    names = [c for c in offered.columns if c not in ("niche_match", "wanted")]
    once = offered.groupBy(*names).agg(F.max("niche_match").alias("niche_match"))
    return top_k(once, "for_asin", [F.desc("niche_match"), *order], k, rank="rank")


def better_alternatives(
    products: DataFrame, parents: DataFrame, tags: DataFrame, mapping: DataFrame,
    criteria: str | None = "Quality", min_n: int = 10, k: int = 3,
) -> DataFrame:
    """Best-liked other families of the category on an aspect or aspect category."""
    counted = (
        tags.groupBy("parent_asin", F.col("aspect").alias("raw_aspect"))
        .agg(F.count("*").alias("n"), F.count_if(F.expr(aspects.IS_POSITIVE)).alias("pos"))
    )
    known = aspects.resolve_aspects(counted, mapping, "exact")
    if criteria and criteria != "Overall":
        known = known.filter((F.col("std_category") == criteria) | (F.col("standard_aspect") == criteria))
    liked = known.groupBy("parent_asin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    titles = products.groupBy("parent_asin", "title").agg(F.count("*").alias("rows"))
    candidates = (
        titles.join(liked, "parent_asin").join(parents.select("parent_asin", "category"), "parent_asin")
        .withColumn("total_mentions", F.col("rows") * F.col("n"))
        .filter(F.col("total_mentions") > min_n)
        .withColumn("positive_score", F.round(F.col("pos") * 100.0 / F.col("n"), 1))
        .select("parent_asin", "title", "category", "total_mentions", "positive_score")
    )
    order = [F.desc("positive_score"), F.asc("parent_asin"), F.asc_nulls_last("title")]
    return best_of_category(candidates, parents, order, k)


def rivals(products: DataFrame, parents: DataFrame, min_reviews: int = 5, k: int = 3) -> DataFrame:
    """Top rated families of the category with enough ratings."""
    rated = products.groupBy("parent_asin").agg(
        F.max("real_average_rating").alias("rating"), F.max("real_total_ratings").alias("reviews"),
        F.min("title").alias("_title"), F.min("brand").alias("_brand"),
    )
    candidates = (
        parents.select("parent_asin", "category", "title", "brand").join(rated, "parent_asin")
        .filter(F.col("reviews") > min_reviews)
        .select(
            "parent_asin", "category", F.coalesce("title", "_title").alias("title"),
            F.coalesce("brand", "_brand").alias("brand"), "rating", "reviews",
        )
    )
    order = [F.desc_nulls_last("rating"), F.desc("reviews"), F.asc("parent_asin")]
    return best_of_category(candidates, parents, order, k)


def competitor_gaps(
    products: DataFrame, parents: DataFrame, tags: DataFrame, mapping: DataFrame, k: int = 3, weak: int = 3
) -> DataFrame:
    """For each rival and each of our top weaknesses: the rival's positive mentions of it.
    Rivals without an advantage keep one row with a null aspect."""
    ours = aspects.top_aspects(tags, mapping, "Negative", "exact", weak).select(
        F.col("parent_asin").alias("for_asin"), "aspect"
    )
    liked = tags.filter(aspects.IS_POSITIVE).groupBy("parent_asin", F.col("aspect").alias("raw_aspect")).agg(
        F.count("*").alias("n")
    )
    # a tag answers to its raw and to its standard name
    named = (
        aspects.resolve_aspects(liked, mapping, "exact")
        .select("parent_asin", "n", F.explode(F.array_distinct(F.array("raw_aspect", "aspect"))).alias("aspect"))
        .groupBy("parent_asin", "aspect").agg(F.sum("n").alias("positive_mentions"))
    )
    found = rivals(products, parents, k=k).select(
        "for_asin", "parent_asin", F.substring("title", 1, 50).alias("title"), "brand",
        F.round("rating", 2).alias("rating"), "reviews", "rank",
    )
    gains = found.select("for_asin", "parent_asin").join(ours, "for_asin").join(named, ["parent_asin", "aspect"])
    return found.join(gains, ["for_asin", "parent_asin"], "left")


def match_competitors(
    products: DataFrame, parents: DataFrame,
    bands: tuple[tuple[float, float], tuple[float, float]] = ((0.6, 1.4), (0.4, 1.6)),
    min_hits: int = 5, k: int = 100,
) -> DataFrame:
    """Other family heads of the category with a rating volume near ours.

    The narrow band is used unless it holds fewer than ``min_hits``. Same niche scores 10,
    same product line 1; ties go to the nearest volume. Each of the four score classes is the
    nearest-volume list of one group (category, with or without niche and line), and the best
    ``k`` of their union are the best ``k`` overall.
    """
    if k < min_hits:
        raise ValueError("k must not be below min_hits")
    heads = products.filter("asin = parent_asin").select(
        "asin", "title", "real_total_ratings", "real_average_rating", "product_line"
    ).join(parents.select(F.col("parent_asin").alias("asin"), "category", "niche"), "asin")
    wanted = F.coalesce(primary_niche("niche"), F.lit(NO_NICHE))
    mine = (
        heads.filter(F.col("category").isNotNull())
        .select(
            "asin", "category", wanted.alias("wanted"), F.coalesce("product_line", F.lit("NONE")).alias("line"),
            F.coalesce("real_total_ratings", F.lit(0)).cast("bigint").alias("x"),
        )
    )
    pool = heads.filter(F.col("category").isNotNull() & F.col("real_total_ratings").isNotNull())
    members = niche_members(parents).withColumnRenamed("parent_asin", "asin")
    blank, sep = F.lit("\x02"), "\x01"

    def group(score: int, wanted: Column, line: Column) -> Column:
        return F.concat_ws(sep, F.lit(score).cast("string"), "category", wanted, line)

    def placed(rows: DataFrame, scores: tuple[int, int], wanted: Column) -> DataFrame:
        """Each row in its group without and, where it has a line, with the product line."""
        with_line = F.when(F.col("product_line").isNotNull(), group(scores[1], wanted, F.col("product_line")))
        groups = F.explode(F.array_compact(F.array(group(scores[0], wanted, blank), with_line)))
        return rows.select(groups.alias("grp"), F.col("real_total_ratings").cast("bigint").alias("x"), "asin")

    points = placed(pool, (0, 1), blank).unionByName(placed(pool.join(members, "asin"), (10, 11), F.col("wanted")))
    near = nearest_within(points, ["grp"], "x", "asin", k, bands)

    keys = F.explode(F.array(*[
        F.struct(F.lit(score).alias("score"), group(score, wanted, line).alias("grp"))
        for score, wanted, line in (
            (0, blank, blank), (1, blank, F.col("line")), (10, F.col("wanted"), blank), (11, F.col("wanted"), F.col("line")),
        )
    ]))
    asked = mine.select("asin", "x", keys.alias("q")).select(F.col("asin").alias("for_asin"), "x", "q.score", "q.grp")
    lists = asked.join(near, ["grp", "x"])
    classes = (11, 10, 1, 0)

    def of(score: int, band: str) -> Column:
        return F.first(F.when(F.col("score") == score, F.col(band)), ignorenulls=True)

    # one row per seeker with its four bounded lists; the rest is arithmetic inside the row
    gathered = lists.groupBy("for_asin").agg(
        *[of(c, "near_0").alias(f"n{c}") for c in classes], *[of(c, "near_1").alias(f"w{c}") for c in classes]
    )
    others = F.size(F.filter("n0", lambda e: e["key"] != F.col("for_asin")))
    empty = F.array().cast("array<struct<diff:bigint,key:string,x:bigint>>")
    chosen = gathered.select(
        "for_asin",
        *[F.coalesce(F.when(others >= min_hits, F.col(f"n{c}")).otherwise(F.col(f"w{c}")), empty).alias(f"l{c}") for c in classes],
    )

    def fresh(score: int) -> Column:
        """Items of a class that no higher class holds."""
        above = F.flatten(F.array(*[F.col(f"l{c}")["key"] for c in classes if c > score])) if score < 11 else F.array().cast("array<string>")
        kept = F.filter(f"l{score}", lambda e: (e["key"] != F.col("for_asin")) & ~F.array_contains(above, e["key"]))
        return F.transform(kept, lambda e: F.struct(F.lit(score).alias("score"), e["diff"].alias("volume_gap"), e["key"].alias("asin")))

    # classes in falling order, each already by (gap, id): their concatenation is the ranking
    ranking = F.slice(F.concat(*[fresh(c) for c in classes]), 1, k)
    best = chosen.select("for_asin", F.posexplode(ranking).alias("pos", "e")).select(
        "for_asin", "e.score", "e.volume_gap", "e.asin", (F.col("pos") + 1).alias("rank")
    )
    me = mine.select(F.col("asin").alias("for_asin"), F.col("wanted").alias("_w"), F.col("line").alias("_l"))
    smart = F.coalesce(F.col("niche").contains(F.col("_w")), F.lit(False)) | F.coalesce(F.col("product_line") == F.col("_l"), F.lit(False))
    return (
        best.join(heads, "asin").join(me, "for_asin")
        .withColumn("is_smart", smart)
        .drop("_w", "_l")
    )


def _percent(pos: Column, neg: Column) -> Column:
    """Share of positive estimates; 0 when there are none at all."""
    return pos / (pos + neg + 1e-9) * 100


def niche_benchmark(impact: DataFrame, products: DataFrame, min_total: int = 50) -> DataFrame:
    """Average satisfaction per (niche, aspect) over the families of a niche."""
    niches = products.select(F.col("asin").alias("parent_asin"), "main_niche").filter(
        F.col("main_niche").isNotNull() & ~F.col("main_niche").isin("", "None", "Non-defined")
    )
    pos, total = F.sum("est_positive"), F.sum(F.col("est_positive") + F.col("est_negative"))
    return (
        impact.join(niches, "parent_asin").groupBy("main_niche", "aspect")
        .agg(pos.alias("_p"), total.alias("_t"))
        .filter(F.col("_t") > min_total)
        .select("main_niche", "aspect", (F.col("_p") / F.col("_t") * 100).alias("market_avg"))
    )


def winner(mine: Column, theirs: Column, tie: float = 0.10, min_score: int = 2) -> Column:
    top = F.greatest(mine, theirs)
    even = (top < min_score) | (F.abs(mine - theirs) / top < tie)
    return F.when(even, "tie").when(mine > theirs, "a").otherwise("b")


def battle(impact: DataFrame, products: DataFrame, pairs: DataFrame, tie: float = 0.10, min_score: int = 2) -> DataFrame:
    """Aspects liked on both sides of every pair, who wins, and the niche average."""
    side = impact.select(
        "parent_asin", "aspect", F.col("est_positive").alias("pop"),
        _percent(F.col("est_positive"), F.col("est_negative")).alias("sat"),
    ).filter("pop > 0")
    a = side.select(F.col("parent_asin").alias("a"), "aspect", F.col("pop").alias("pop_a"), F.col("sat").alias("sat_a"))
    b = side.select(F.col("parent_asin").alias("b"), "aspect", F.col("pop").alias("pop_b"), F.col("sat").alias("sat_b"))
    niche = products.select(F.col("asin").alias("a"), "main_niche")
    return (
        pairs.join(a, "a").join(b, ["b", "aspect"]).join(niche, "a", "left")
        .join(niche_benchmark(impact, products), ["main_niche", "aspect"], "left")
        .withColumn("winner", winner(F.col("pop_a"), F.col("pop_b"), tie, min_score))
        .select("a", "b", "aspect", "pop_a", "pop_b", "sat_a", "sat_b", "market_avg", "winner")
    )


def unique_aspects(impact: DataFrame, pairs: DataFrame) -> DataFrame:
    """Liked aspects only one side of a pair has."""
    slim = impact.select("parent_asin", "aspect", "est_positive")

    def only(me: str, them: str) -> DataFrame:
        held = pairs.join(slim, F.col(me) == F.col("parent_asin")).drop("parent_asin")
        other = slim.select(F.col("parent_asin").alias(them), "aspect")
        return held.join(other, [them, "aspect"], "left_anti").select("a", "b", F.lit(me).alias("side"), "aspect", "est_positive")

    return only("a", "b").unionByName(only("b", "a")).filter("est_positive > 0")


def top_weaknesses(impact: DataFrame, k: int = 5) -> DataFrame:
    bad = impact.filter("net_impact < 0").select("parent_asin", "aspect", "est_negative")
    return top_k(bad, "parent_asin", [F.desc("est_negative"), F.asc("aspect")], k, rank="rank")


def head_to_head(tags: DataFrame, mapping: DataFrame, pairs: DataFrame, min_n: int = 2, k: int = 10) -> DataFrame:
    """Positive shares of the aspects both sides of a pair have."""
    sides = aspects.aspect_sentiment(tags, mapping, "norm", min_n).select("parent_asin", "aspect", "mentions", "pos_ratio")

    def side(s: str) -> DataFrame:
        return sides.select(
            F.col("parent_asin").alias(s), "aspect", F.col("pos_ratio").alias(f"score_{s}"),
            F.col("mentions").alias(f"mentions_{s}"),
        )

    both = pairs.join(side("a"), "a").join(side("b"), ["b", "aspect"])
    order = [F.desc(F.col("mentions_a") + F.col("mentions_b")), F.asc("aspect")]
    return top_k(both, ["a", "b"], order, k).select("a", "b", "aspect", "score_a", "score_b", "mentions_a", "mentions_b")


def legacy_battle(tags: DataFrame, mapping: DataFrame, pairs: DataFrame, min_n: int = 2, hi: float = 70.0) -> DataFrame:
    """Long form of both sides of a pair: shared or exclusive aspects with their positive share."""
    sides = aspects.aspect_counts(tags, mapping, "exact").filter(F.col("mentions") >= min_n).select(
        "parent_asin", "aspect", "mentions", aspects.positive_ratio(None).alias("pos_pct")
    )
    long = pairs.select("a", "b", F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("a").alias("me"), F.col("b").alias("them")),
        F.struct(F.lit("b").alias("side"), F.col("b").alias("me"), F.col("a").alias("them")),
    )).alias("p")).select("a", "b", "p.*")
    held = long.join(sides, F.col("me") == F.col("parent_asin")).drop("parent_asin")
    other = sides.select(F.col("parent_asin").alias("them"), "aspect", F.lit(True).alias("_both"))
    return (
        held.join(other, ["them", "aspect"], "left")
        .select(
            "a", "b", "side", "aspect", "mentions", F.round("pos_pct", 6).alias("pos_pct"),
            F.coalesce("_both", F.lit(False)).alias("shared"), (F.col("pos_pct") > hi).alias("strong"),
        )
    )


def tale_of_tape(products: DataFrame, pairs: DataFrame) -> DataFrame:
    """Official ratings of both sides and the differences; a missing left value counts as 0."""
    def side(s: str) -> DataFrame:
        return products.select(
            F.col("asin").alias(s), F.col("real_average_rating").alias(f"rating_{s}"), F.col("real_total_ratings").alias(f"total_{s}")
        )

    return (
        pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        .withColumn("rating_delta", F.round(F.col("rating_b") - F.coalesce("rating_a", F.lit(0.0)), 6))
        .withColumn("total_delta", F.col("total_b") - F.coalesce("total_a", F.lit(0)))
        .select("a", "b", "rating_a", "total_a", "rating_b", "total_b", "rating_delta", "total_delta")
    )


def _most_rated(products: DataFrame, parents: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(families with a category, the ``k`` most rated of each category with their rank ``lead``)."""
    rated = products.groupBy("parent_asin").agg(F.max("real_total_ratings").alias("volume"))
    listed = rated.join(parents.select("parent_asin", "category").filter(F.col("category").isNotNull()), "parent_asin")
    order = [F.desc_nulls_last("volume"), F.asc("parent_asin")]
    return listed, top_k(listed, "category", order, k, rank="lead")


def heatmap_candidates(products: DataFrame, parents: DataFrame, k: int = 15) -> DataFrame:
    """Every family with itself and the ``k`` most rated others of its category."""
    listed, leaders = _most_rated(products, parents, k + 1)
    order = [F.desc_nulls_last("volume"), F.asc("parent_asin")]
    offered = (
        listed.select(F.col("parent_asin").alias("for_asin"), "category").join(leaders.drop("lead"), "category")
        .filter(F.col("for_asin") != F.col("parent_asin"))
    )
    others = top_k(offered, "for_asin", order, k).select("for_asin", F.col("parent_asin").alias("asin"))
    return others.unionByName(listed.select(F.col("parent_asin").alias("for_asin"), F.col("parent_asin").alias("asin")))


def heatmap_cells(impact: DataFrame, products: DataFrame, parents: DataFrame, penalty: float = 3.0) -> DataFrame:
    """Long form: one row per product and aspect, negatives weighing ``penalty`` times."""
    label = F.concat(F.substring("brand", 1, 10), F.lit(" ("), F.col("asin"), F.lit(")"))
    named = (
        products.select("asin", F.col("brand").alias("_b"), F.coalesce("real_total_ratings", F.lit(0)).alias("total_ratings"))
        .join(parents.select(F.col("parent_asin").alias("asin"), F.col("brand").alias("_pb")), "asin", "left")
        .withColumn("brand", F.coalesce("_pb", "_b", F.lit("Unknown")))
        .withColumn("brand", F.when(F.col("brand").isin("", "None"), "Unknown").otherwise(F.col("brand")))
        .select("asin", label.alias("label"), "total_ratings")
    )
    return (
        impact.withColumnRenamed("parent_asin", "asin").join(named, "asin")
        .withColumn("score", (F.col("est_positive") - F.col("est_negative") * penalty))
        .select("asin", "label", "aspect", "score", "est_positive", "est_negative", "total_ratings")
    )


def heatmap_drivers(cells: DataFrame, products: DataFrame, parents: DataFrame, k: int = 10, peers: int = 15) -> DataFrame:
    """Per heat map (``for_asin``, with the ``peers`` most rated others of its category): the ``k`` most positive and ``k`` most
    negative aspects over its products, with their weight (sum of absolute scores).

    The cells of a category's first ``peers`` + 1 families are summed once. One of these families has exactly that sum; any
    other has the sum of the first ``peers`` and its own cells. So a family meets one row of its category, not the cells of all its peers.
    """
    listed, leaders = _most_rated(products, parents, peers + 1)
    own = cells.select(F.col("asin").alias("parent_asin"), "aspect", "score")
    first = F.col("lead") <= peers
    sums = (
        leaders.select("parent_asin", "category", "lead").join(own, "parent_asin").groupBy("category", "aspect")
        .agg(
            F.sum("score").alias("all"), F.sum(F.abs("score")).alias("all_w"),
            F.sum(F.when(first, F.col("score"))).alias("some"), F.sum(F.when(first, F.abs("score"))).alias("some_w"),
        )
    )
    # bounded: the cells of peers + 1 products, and of one product
    market = sums.groupBy("category").agg(F.collect_list(F.struct("aspect", "all", "all_w", "some", "some_w")).alias("market"))
    mine = own.groupBy("parent_asin").agg(F.collect_list(F.struct("aspect", "score")).alias("mine"))
    inside = leaders.select("parent_asin", F.lit(True).alias("inside"))
    rows = listed.join(inside, "parent_asin", "left").join(mine, "parent_asin", "left").join(market, "category", "left")
    total = "array<struct<aspect:string,market_score:double,weight:double>>"
    rows = rows.withColumn("totals", F.expr(f"""
        CASE WHEN inside THEN transform(market, m -> named_struct('aspect', m.aspect, 'market_score', m.all, 'weight', m.all_w))
        ELSE concat(
          transform(filter(coalesce(market, array()), m -> m.some IS NOT NULL AND NOT exists(coalesce(mine, array()), o -> o.aspect <=> m.aspect)),
            m -> named_struct('aspect', m.aspect, 'market_score', m.some, 'weight', m.some_w)),
          transform(coalesce(mine, array()), o -> transform(array(filter(coalesce(market, array()), m -> m.aspect <=> o.aspect)[0]),
            m -> named_struct('aspect', o.aspect, 'market_score', o.score + coalesce(m.some, 0D), 'weight', abs(o.score) + coalesce(m.some_w, 0D)))[0]))
        END""").cast(total))

    def strongest(section: str, sign: int) -> DataFrame:
        kept = F.filter("totals", lambda x: x["market_score"] * sign > 0)
        order = F.array_sort(F.transform(kept, lambda x: F.struct((x["market_score"] * -sign).alias("o"), x["aspect"].alias("aspect"), x.alias("x"))))
        found = rows.select(F.col("parent_asin").alias("for_asin"), F.posexplode(F.slice(order, 1, k)).alias("at", "e"))
        return found.select("for_asin", "e.x.*", F.lit(section).alias("section"), (F.col("at") + 1).alias("rank"))

    return strongest("positive", 1).unionByName(strongest("negative", -1))


def heatmap_pivot(cells: DataFrame, chosen: Sequence[str]) -> DataFrame:
    """Wide form for a chosen product list, missing aspects as 0, strongest aspects first."""
    rows = cells.filter(F.col("asin").isin(*chosen))
    wide = rows.groupBy("aspect").pivot("asin", list(chosen)).agg(F.first("score"))
    wide = wide.na.fill(0.0, list(chosen))
    weight = sum((F.abs(F.col(c)) for c in chosen), F.lit(0.0))
    return wide.withColumn("weight", weight).filter("weight > 0").orderBy(F.desc("weight"), F.asc("aspect"))


def _first_heads(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows of every group with its smallest ``_head``, all of them where several share it."""
    place = F.rank().over(Window.partitionBy(*keys).orderBy("_head"))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")


def swot(tags: DataFrame, mapping: DataFrame, min_n: int = 3, hi: float = 75.0, lo: float = 40.0) -> DataFrame:
    """Strengths (5), weaknesses (5, each with one complaint) and controversial aspects (3)."""
    rated = aspects.aspect_sentiment(tags, mapping, "norm", min_n).select("parent_asin", "aspect", "mentions", "pos_ratio")
    bucket = F.when(F.col("pos_ratio") >= hi, "strength").when(F.col("pos_ratio") <= lo, "weakness").otherwise("controversial")
    ranked = top_k(rated.withColumn("bucket", bucket), ["parent_asin", "bucket"], [F.desc("mentions"), F.asc("aspect")], 5, rank="rank")
    ranked = ranked.filter((F.col("bucket") != "controversial") | (F.col("rank") <= 3))
    # the first complaint per (family, raw aspect), then at most five weaknesses look through them. Quotes are told apart by their first
    # characters; only those that share them are compared whole
    negative, quotes = apart(tags.filter(aspects.IS_NEGATIVE).withColumn("_head", F.substring("quote", 1, 64)), "quote")
    each = negative.filter(F.col("quote").isNotNull()).select("parent_asin", F.col("aspect").alias("raw"), "_head", "quote").distinct()
    complaints = _first_heads(each, "parent_asin", "raw")
    weak = ranked.filter("bucket = 'weakness'").select("parent_asin", "aspect")
    samples = (
        weak.join(complaints, "parent_asin")
        .filter(F.lower("raw").contains(F.lower("aspect")))
    )
    few = _first_heads(spread(samples, "parent_asin", "aspect"), "parent_asin", "aspect").select("parent_asin", "aspect", "quote").distinct()
    samples = whole(few, quotes, "quote").groupBy("parent_asin", "aspect").agg(F.min("quote").alias("sample_complaint"))
    return ranked.join(samples, ["parent_asin", "aspect"], "left")


def swot_summary(kpis: DataFrame) -> DataFrame:
    return kpis.select(F.col("asin").alias("parent_asin"), F.round("avg_rating", 2).alias("avg_rating"), "total_reviews")


def representative(products: DataFrame) -> DataFrame:
    """One product row per family, the smallest id first."""
    return keep_one(products, "parent_asin", [F.asc("asin")])
