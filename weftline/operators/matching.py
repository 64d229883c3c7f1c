"""Joins with tolerance, prefixes, containment and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule table up to so many rows is broadcast; beyond it texts are cut up and joined for equality.
SMALL = 10_000
#: Characters of a phrase, or words of it, that are joined for equality before the whole is compared.
HEAD, HEAD_WORDS = 8, 5


def within(a: Column, b: Column, tolerance: float, floor: float = 16) -> Column:
    """b equals a within a share of a, or within the floor."""
    return F.abs(a - b) <= F.greatest(F.lit(float(floor)), a * tolerance)


def tolerance_anti(left: DataFrame, right: DataFrame, value: str, other: str, by: Sequence[str] = (), tolerance: float = 0.15, floor: float = 16, width: float | None = None) -> DataFrame:
    """Rows of left with no row of right (of the same group) within tolerance.

    right is bucketed by width (of the logarithm, as the tolerance is relative)
    and left looks in its own bucket and the neighbours, so the join stays an
    equi-join of any size.
    """
    import math

    step = width or math.log1p(max(tolerance, 1e-6))
    lo_edge = floor / max(tolerance, 1e-6)

    def bucket(x: Column) -> Column:
        # below lo_edge the floor is the tolerance: linear buckets; above it logarithmic ones, continuing the numbers
        top = int(lo_edge // floor)
        return F.when(x < lo_edge, F.floor(x / floor)).otherwise(top + 1 + F.floor(F.log(F.greatest(x, F.lit(lo_edge)) / lo_edge) / step)).cast("long")

    rhs = right.select(*[F.col(k).alias(f"__{k}") for k in by], F.col(other).alias("__other"), bucket(F.col(other)).alias("__b")).distinct()
    lhs = left.withColumn("__id", F.monotonically_increasing_id())
    from weftline.session import cut

    lhs = cut(lhs)
    probes = lhs.withColumn("__p", F.explode(F.sequence(bucket(F.col(value)) - 2, bucket(F.col(value)) + 2)))
    on = (F.col("__p") == F.col("__b")) & within(F.col(value), F.col("__other"), tolerance, floor)
    for k in by:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    hit = probes.join(rhs, on, "left_semi").select("__id").distinct()
    return lhs.join(hit, "__id", "left_anti").drop("__id")


def both_ways(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """(key, side): keys of one side that the other lacks."""
    a = left.select(key).distinct().join(right.select(key), key, "left_anti").withColumn("side", F.lit(left_name))
    b = right.select(key).distinct().join(left.select(key), key, "left_anti").withColumn("side", F.lit(right_name))
    return a.unionByName(b)


def set_sizes(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(op, n): sizes of the union, the intersection and both differences of the distinct keys of two sides, by one aggregate."""
    sides = left.select(key, F.lit(1).alias("side")).unionByName(right.select(key, F.lit(2).alias("side"))).groupBy(key).agg(F.bit_or("side").alias("in"))
    n = sides.agg(F.count("*").alias("union"), F.count_if(F.col("in") == 3).alias("intersect"), F.count_if(F.col("in") == 1).alias("left"), F.count_if(F.col("in") == 2).alias("right"))
    return n.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in n.columns]), F.array(*n.columns))).alias("op", "n"))


def collisions(df: DataFrame, name: str, owner: str) -> DataFrame:
    """(name, owners, n): names that more than one owner claims."""
    return df.groupBy(name).agg(F.array_sort(F.collect_set(owner)).alias("owners"), F.count_distinct(owner).alias("n")).where("n > 1")


def contained_pairs(df: DataFrame, name: str, owners: str | None = None) -> DataFrame:
    """(inner, outer): distinct names where one without spaces is contained in another without spaces and dots; pairs of a shared owner are left out.

    Every name is cut into its substrings of the lengths that inner names
    have, and these are joined for equality.
    """
    rows = df.groupBy(name).agg(F.collect_set(owners).alias("owners")) if owners else df.select(name).distinct().withColumn("owners", F.array().cast("array<string>"))
    inner = rows.select(F.col(name).alias("inner"), F.replace(F.col(name), F.lit(" "), F.lit("")).alias("part"), F.col("owners").alias("io")).where("part <> ''")
    lengths = inner.select(F.length("part").alias("size")).distinct()
    flat = rows.select(F.col(name).alias("outer"), F.regexp_replace(name, "[ .]", "").alias("flat"), F.col("owners").alias("oo"))
    cuts = flat.join(F.broadcast(lengths), F.col("size") <= F.length("flat")).select(
        "outer", "oo", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("flat") - F.col("size") + 1), lambda i: F.substring(F.col("flat"), i, F.col("size"))))).alias("part")
    )
    pairs = inner.join(cuts, "part").where("inner <> outer")
    return (pairs.where(~F.arrays_overlap("io", "oo")) if owners else pairs).select("inner", "outer").distinct()


def flat_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[ .]", ""))


def resolve(asked: DataFrame, names: DataFrame, query: str, name: str, owner: str) -> DataFrame:
    """(query, outcome, owner, owners): a name resolved exactly, else by a prefix either way of 3 characters or more that leads to one owner.

    hit, ambiguous or miss. Prefixes of names, and names that are prefixes of
    the query, are two equi-joins on cut-off strings, of the lengths that the
    other side has; what names begin with is kept once for each owner. Only
    these lengths are broadcast: Spark takes a cut-up table to be as small as
    the file it comes from, and would put it through the driver.
    """
    q = asked.select(query).distinct().withColumns({"__low": F.lower(F.trim(F.col(query))), "__flat": flat_name(F.col(query))})
    n = names.select(F.lower(F.trim(F.col(name))).alias("__name"), flat_name(F.col(name)).alias("__nflat"), F.col(owner).alias("__owner")).distinct()
    asked_flat, named_flat = q.where(F.length("__flat") >= 3), n.where(F.length("__nflat") >= 3).select("__nflat", "__owner").distinct()

    def cuts(df: DataFrame, flat: str, others: DataFrame, other: str) -> DataFrame:
        """df with __p, what each string begins with, in the lengths of the other side's strings."""
        sizes = others.select(F.length(other).alias("__size")).distinct()
        return df.join(F.broadcast(sizes), F.col("__size") <= F.length(flat)).withColumn("__p", F.substring(F.col(flat), F.lit(1), F.col("__size")))

    cut_names = cuts(named_flat, "__nflat", asked_flat, "__flat").select("__owner", "__p").distinct()
    cut_query = cuts(asked_flat, "__flat", named_flat, "__nflat").select(query, "__p")
    exact = q.join(n.hint("merge"), F.col("__low") == F.col("__name")).select(query, "__owner", F.lit(0).alias("__arm"))
    begins = asked_flat.join(cut_names.hint("merge"), F.col("__flat") == F.col("__p")).select(query, "__owner", F.lit(1).alias("__arm"))
    begun = cut_query.join(named_flat.hint("merge"), F.col("__p") == F.col("__nflat")).select(query, "__owner", F.lit(1).alias("__arm"))
    best = exact.unionByName(begins).unionByName(begun).groupBy(query, "__arm").agg(F.array_sort(F.collect_set("__owner")).alias("owners"))
    best = best.groupBy(query).agg(F.min_by("owners", "__arm").alias("owners"))
    return q.select(query).join(best.hint("merge"), query, "left").select(
        query,
        F.when(F.col("owners").isNull(), "miss").when(F.size("owners") == 1, "hit").otherwise("ambiguous").alias("outcome"),
        F.when(F.size("owners") == 1, F.element_at("owners", 1)).alias(owner),
        F.coalesce("owners", F.array().cast("array<string>")).alias("owners"),
    )


def overlapping(left: DataFrame, right: DataFrame, by: Sequence[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Rows whose intervals overlap, within groups: (start, end) columns of either side, cut into bins of a width so the join is an equi-join."""
    lo, hi = (F.floor(F.col(c) / width) for c in a)
    l_bins = left.withColumn("__bin", F.explode(F.sequence(lo, hi)))
    lo, hi = (F.floor(F.col(c) / width) for c in b)
    r_bins = right.withColumn("__bin", F.explode(F.sequence(lo, hi)))
    joined = l_bins.join(r_bins, [*by, "__bin"]).where((F.col(a[0]) < F.col(b[1])) & (F.col(a[1]) > F.col(b[0])))
    # a pair is kept in the first bin that both reach
    return joined.where(F.col("__bin") == F.greatest(F.floor(F.col(a[0]) / width), F.floor(F.col(b[0]) / width))).drop("__bin")


def near_above(df: DataFrame, others: DataFrame, by: Sequence[str], top: str, other_top: str, reach: float) -> DataFrame:
    """Rows with another row of the group below them, nearer than reach."""
    bins = others.select(*by, F.col(other_top).alias("__t"), F.floor(F.col(other_top) / reach).alias("__bin"))
    mine = df.withColumn("__id", F.monotonically_increasing_id())
    probes = mine.withColumn("__bin", F.explode(F.array(F.floor(F.col(top) / reach), F.floor(F.col(top) / reach) + 1)))
    gap = F.col("__t") - F.col(top)
    hit = probes.join(bins, [*by, "__bin"]).where((gap > 0) & (gap < reach))
    return hit.drop("__bin", "__t").dropDuplicates(["__id"]).drop("__id")


def is_small(rules: DataFrame) -> bool:
    """Whether a rule table has at most SMALL rows; reads no more than these."""
    return rules.limit(SMALL + 1).count() <= SMALL


def phrases_in(texts: DataFrame, phrases: DataFrame, text: str, phrase: str) -> DataFrame:
    """texts x phrases where the phrase is contained.

    A small rule table is broadcast. A larger one is joined for equality: the
    first HEAD characters of each phrase (all of a shorter one) with the
    stretches of that length of each text, then compared whole.
    """
    if is_small(phrases):
        return texts.join(F.broadcast(phrases), F.contains(F.col(text), F.col(phrase)))
    heads = phrases.where(F.length(phrase) > 0).withColumn("__size", F.least(F.length(phrase), F.lit(HEAD))).withColumn("__head", F.substring(F.col(phrase), F.lit(1), F.col("__size")))
    row = texts.withColumn("__id", F.monotonically_increasing_id())
    body = row.withColumn("__size", F.explode(F.array(*[F.lit(k) for k in range(1, HEAD + 1)]))).join(F.broadcast(heads.select("__size").distinct()), "__size")
    stretches = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - F.col("__size") + 1), lambda i: F.substring(F.col(text), i, F.col("__size"))))
    cut_up = body.where(F.length(text) >= F.col("__size")).select("__id", *texts.columns, "__size", F.explode(stretches).alias("__head"))
    found = cut_up.join(heads, ["__size", "__head"]).where(F.contains(F.col(text), F.col(phrase))).select(*texts.columns, *phrases.columns)
    return found.unionByName(texts.where(F.col(text).isNotNull()).join(F.broadcast(phrases.where(F.length(phrase) == 0)), F.lit(True)).select(*texts.columns, *phrases.columns))


def word_phrases_in(texts: DataFrame, phrases: DataFrame, id_col: str, text: str, phrase: str) -> DataFrame:
    """(id, columns of phrases): texts that hold all words of a phrase in a row, words being what stands between white space.

    The first HEAD_WORDS words of each phrase (all of a shorter one) are
    joined by hash with the words that begin at each place of each text, then
    all words are compared. The heads of up to SMALL phrases are broadcast, so
    that places without one never leave their task, and a place that has one
    takes its words along; of more phrases both sides are shuffled, so both may
    grow. Null texts and phrases without words match nothing; rows that repeat
    an id count as one.
    """
    split = lambda c: F.filter(F.split(F.col(c), r"\s+"), lambda w: w != "")
    rules = phrases.withColumn("__w", split(phrase)).withColumn("__k", F.least(F.size("__w"), F.lit(HEAD_WORDS))).where("__k > 0").withColumn("__h", F.xxhash64(F.slice("__w", F.lit(1), F.col("__k"))))
    sizes = rules.select("__k").distinct()
    row = texts.select(F.col(id_col).alias("__id"), split(text).alias("__t"))
    starts = row.join(F.broadcast(sizes), F.size("__t") >= F.col("__k"))
    grams = F.transform(F.sequence(F.lit(1), F.size("__t") - F.col("__k") + 1), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("__t", i, F.col("__k"))).alias("h")))
    inlined = F.inline(F.transform(grams, lambda g: F.struct(g["at"].alias("__at"), g["h"].alias("__h"))))
    if is_small(phrases):
        heads = rules.groupBy("__k", "__h").agg(F.max(F.size("__w")).alias("__n"))
        near = starts.select("__id", "__t", "__k", inlined).join(F.broadcast(heads), ["__k", "__h"]).select("__id", "__k", "__h", F.slice("__t", F.col("__at"), F.col("__n")).alias("__s"))
        hit = near.join(rules, ["__k", "__h"]).where(F.slice("__s", F.lit(1), F.size("__w")) == F.col("__w"))
        return hit.select(F.col("__id").alias(id_col), *phrases.columns).distinct()
    spots = starts.select("__id", "__k", inlined)
    likely = spots.join(rules, ["__k", "__h"]).drop("__k", "__h")
    hit = likely.join(row, "__id").where(F.slice("__t", F.col("__at"), F.size("__w")) == F.col("__w"))
    return hit.select(F.col("__id").alias(id_col), *phrases.columns).distinct()


def two_sided(left: DataFrame, right: DataFrame, key: Sequence[str], values: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """(key..., state): missing left, missing right, differs or same, with the worst difference of numeric values."""
    a = left.select(*key, *[F.col(v).alias(f"__a_{v}") for v in values], F.lit(True).alias("__l"))
    b = right.select(*key, *[F.col(v).alias(f"__b_{v}") for v in values], F.lit(True).alias("__r"))
    worst = F.greatest(*[F.abs(F.col(f"__a_{v}") - F.col(f"__b_{v}")) for v in values], F.lit(0.0)) if values else F.lit(0.0)
    j = a.join(b, list(key), "full_outer")
    return j.select(*key, F.when(F.col("__l").isNull(), "missing left").when(F.col("__r").isNull(), "missing right").when(worst > tolerance, "differs").otherwise("same").alias("state"), F.when(F.col("__l") & F.col("__r"), worst).alias("worst"))
