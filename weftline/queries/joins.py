"""Queries of joins with tolerance, prefixes, containment and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import capture, crawl, matching, motion, tallies
from weftline.queries.registry import query
from weftline.session import table


@query("tolerance_anti_join", """with l as (select distinct round(o_totalprice)::double as v from orders), r as (select distinct round(abs(c_acctbal) * 50)::double as v from customer)
 select v from l where not exists (select 1 from r where abs(l.v - r.v) <= greatest(16.0, l.v * 0.0005))""")  # fmt: skip
def tolerance_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals without a balance (fifty times as large) within tolerance; some have one, some don't."""
    left = table(spark, sf_dir, "orders").select(F.round("o_totalprice").cast("double").alias("v")).distinct()
    right = table(spark, sf_dir, "customer").select(F.round(F.abs("c_acctbal") * 50).cast("double").alias("other")).distinct()
    return matching.tolerance_anti(left, right, "v", "other", tolerance=0.0005, floor=16)


@query("duration_tolerance", """with l as (select distinct user_id, round(value * 20)::double as v from events where event_type = (select min(event_type) from events)), r as (select distinct user_id, round(value * 20)::double as v from events where event_type = (select max(event_type) from events))
 select user_id, v from l where not exists (select 1 from r where r.user_id = l.user_id and abs(l.v - r.v) <= greatest(16.0, l.v * 0.15))""")  # fmt: skip
def duration_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations of one kind without one of another kind within tolerance, per user."""
    rows = table(spark, sf_dir, "events")
    ends = rows.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    rows = rows.crossJoin(F.broadcast(ends)).select("user_id", F.round(F.col("value") * 20).cast("double").alias("v"), (F.col("event_type") == F.col("lo")).alias("left"), (F.col("event_type") == F.col("hi")).alias("right"))
    left = rows.where("left").select("user_id", "v").distinct()
    return matching.tolerance_anti(left, rows.where("right").select("user_id", F.col("v").alias("other")), "v", "other", ["user_id"])


@query("curve_anti_join", "select distinct p_name from part where p_brand = 'Brand#11' and p_name not in (select p_name from part where p_brand = 'Brand#22')")
def curve_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curves of one side that the other never uses; names stand for curves."""
    side = F.when(F.col("p_brand") == "Brand#11", "reference").when(F.col("p_brand") == "Brand#22", "build")
    used = table(spark, sf_dir, "part").select(side.alias("side"), F.lit("easing").alias("kind"), F.concat(F.lit("cubic-bezier "), "p_name").alias("value")).where("side is not null")
    return motion.lost_curves(used.groupBy("side", "kind", "value").agg(F.count("*").alias("n"))).select(F.replace("value", F.lit("cubic-bezier "), F.lit("")).alias("p_name"))


@query("property_anti_join", "with p as (select p_size, p_name || ' ' || p_brand as value from part), a as (select value from p where p_size <= 25 group by value having count(*) >= 2) select value from a where value not in (select value from p where p_size > 25)")
def property_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values used twice or more on one side and never on the other."""
    side = F.when(F.col("p_size") <= 25, "reference").when(F.col("p_size") > 25, "build")
    used = table(spark, sf_dir, "part").select(side.alias("side"), F.lit("carrier").alias("kind"), F.concat("p_name", F.lit(" "), "p_brand").alias("value")).where("side is not null")
    return motion.lost_properties(used.groupBy("side", "kind", "value").agg(F.count("*").alias("n")))


@query("two_way_difference", "with p as (select p_size, p_name || ' ' || p_brand as value from part), a as (select distinct value from p where p_size <= 20), b as (select distinct value from p where p_size > 30) select value, 'fabricated' as side from (select * from a except select * from b) union all select value, 'dropped' from (select * from b except select * from a)")
def two_way_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_size", F.concat("p_name", F.lit(" "), "p_brand").alias("value"))
    return matching.both_ways(part.where("p_size <= 20"), part.where("p_size > 30"), "value", "fabricated", "dropped")


@query("name_collisions", "select p_name, count(distinct p_partkey) as n from part group by p_name having count(distinct p_partkey) > 1")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.collisions(table(spark, sf_dir, "part"), "p_name", "p_partkey").select("p_name", "n")


@query("name_contains_pairs", """with n as (select name, list_distinct(list(owner)) as owners from (select p_name || ' ' || p_type as name, p_brand as owner from part union all select p_name, 'Brand#' || (p_size % 25 + 1) from part) group by name)
 select distinct a.name as inner, b.name as outer from n a, n b where a.name <> b.name and replace(a.name, ' ', '') <> '' and contains(regexp_replace(b.name, '[ .]', '', 'g'), replace(a.name, ' ', '')) and not list_has_any(a.owners, b.owners)""".replace("as inner", 'as "inner"').replace("as outer", 'as "outer"'))  # fmt: skip
def name_contains_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names within longer ones, where no brand has both."""
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat("p_name", F.lit(" "), "p_type").alias("name"), F.col("p_brand").alias("owner")).unionByName(part.select(F.col("p_name").alias("name"), F.concat(F.lit("Brand#"), (F.col("p_size") % 25 + 1).cast("string")).alias("owner")))
    return matching.contained_pairs(names, "name", "owner")


@query("prefix_resolution", """with n as (select distinct lower(trim(c_name)) as name, lower(regexp_replace(c_name, '[ .]', '', 'g')) as flat, c_mktsegment as owner from customer),
 q as (select distinct q, lower(trim(q)) as low, lower(regexp_replace(q, '[ .]', '', 'g')) as flat from (select substr(c_name, 1, 10 + (c_custkey % 9)::int) as q from customer union all select 'zz' || c_custkey from customer union all select c_name || 'x' from customer)),
 e as (select q.q, list_sort(list_distinct(list(owner))) as o from q join n on low = name group by q.q),
 p as (select q.q, list_sort(list_distinct(list(owner))) as o from q join n on length(q.flat) >= 3 and length(n.flat) >= 3 and (starts_with(n.flat, q.flat) or starts_with(q.flat, n.flat)) group by q.q)
 select q.q as query, case when coalesce(e.o, p.o) is null then 'miss' when len(coalesce(e.o, p.o)) = 1 then 'hit' else 'ambiguous' end as outcome, case when len(coalesce(e.o, p.o)) = 1 then coalesce(e.o, p.o)[1] end as owner from q left join e on e.q = q.q left join p on p.q = q.q""")  # fmt: skip
def prefix_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    asked = c.select(F.expr("substring(c_name, 1, 10 + cast(c_custkey % 9 as int))").alias("query"))
    asked = asked.unionByName(c.select(F.concat(F.lit("zz"), "c_custkey").alias("query"))).unionByName(c.select(F.concat("c_name", F.lit("x")).alias("query")))
    return matching.resolve(asked, c, "query", "c_name", "c_mktsegment").select("query", "outcome", F.col("c_mktsegment").alias("owner"))


@query("range_semi_join", "select distinct a.l_orderkey, a.l_linenumber from lineitem a where a.l_linestatus = 'O' and exists (select 1 from lineitem b where b.l_orderkey = a.l_orderkey and b.l_linestatus = 'O' and b.l_extendedprice - a.l_extendedprice > 0 and b.l_extendedprice - a.l_extendedprice < 2200)")
def range_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("double").alias("top"))
    others = rows.select("l_orderkey", F.col("top").alias("other_top"))
    return matching.near_above(rows, others, ["l_orderkey"], "top", "other_top", 2200.0).select("l_orderkey", "l_linenumber").distinct()


DAYS_SQL = "date_diff('day', date '1990-01-01', {0}::date)"


@query("interval_overlap", f"""with i as (select o_custkey as k, o_orderkey as id, {DAYS_SQL.format('o_orderdate')} as s, {DAYS_SQL.format('o_orderdate')} + 40 + (o_orderkey % 30) as e from orders)
 select a.id, count(*) as overlaps from i a join i b on a.k = b.k and a.id <> b.id and a.s < b.e and a.e > b.s group by a.id""")  # fmt: skip
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), day.cast("long").alias("s"), (day + 40 + F.col("o_orderkey") % 30).cast("long").alias("e"))
    other = rows.select("k", F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return matching.overlapping(rows, other, ["k"], ("s", "e"), ("s2", "e2"), 60).where("id <> id2").groupBy("id").agg(F.count("*").alias("overlaps"))


@query("two_sided_compare", """with a as (select l_partkey as k, sum(round(l_quantity)::bigint)::double as q from lineitem where l_returnflag = 'R' group by 1), b as (select l_partkey as k, sum(round(l_quantity)::bigint)::double as q from lineitem where l_returnflag = 'A' group by 1)
 select coalesce(a.k, b.k) as k, case when a.k is null then 'missing left' when b.k is null then 'missing right' when abs(a.q - b.q) > 5 then 'differs' else 'same' end as state, abs(a.q - b.q) as worst from a full join b on a.k = b.k""")  # fmt: skip
def two_sided_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = lambda f: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.sum(F.round("l_quantity").cast("long")).cast("double").alias("q"))
    return matching.two_sided(q("R"), q("A"), ["k"], ["q"], 5.0)


@query("null_safe_fill", "select e.event_id, coalesce(case when e.value > 50 then e.value end, d.m) as filled from events e left join (select user_id, event_type, max(value) as m from events group by all) d on e.user_id = d.user_id and e.event_type = d.event_type")
def null_safe_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later event fills what an earlier one lacks, by key."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("element"), F.col("event_type").alias("property"), "value")
    ends = rows.select("element", "property", F.col("value").alias("to"), F.col("value").alias("seq"))
    return capture.filled_ends(rows.withColumn("to", F.when(F.col("value") > 50, F.col("value"))), ends).select("event_id", F.col("to").alias("filled"))


@query("composite_anti_join", "select e.event_id from events e where e.value > 90 and not exists (select 1 from events f where f.user_id = e.user_id and f.event_type = e.event_type and f.value < 10)")
def composite_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one channel that none of the other covers, by two keys."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("target"), F.col("event_type").alias("name"), "value")
    return capture.uncovered_waapi(rows.where("value < 10"), rows.where("value > 90")).select("event_id")


@query("unlisted_keys", "select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F') and c_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def unlisted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a listing holds that was neither reached nor skipped with a reason."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    reached = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"))
    return crawl.unexplained(c, reached, c.where("c_mktsegment = 'BUILDING'")).select(F.col("key").alias("c_custkey"))


@query("distinct_shares", "with c as (select l_returnflag as v, count(*) as n from lineitem group by 1) select v, n, (select sum(n) from c)::bigint as total, case when n / (select sum(n) from c) >= 0.05 then 'structural' else 'decoration' end as tier from c")
def distinct_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.share_tiers(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("v")), "v")
