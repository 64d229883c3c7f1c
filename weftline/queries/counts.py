"""Queries of counting, ranking and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import capture, library, matching, motion, tallies
from weftline.queries.registry import query
from weftline.session import table


@query("value_tally_top12", "select event_type, value, n, rank from (select event_type, value, n, row_number() over (partition by event_type order by n desc, value) as rank from (select event_type, round(value)::bigint as value, count(*) as n from events group by 1, 2)) where rank <= 12")
def value_tally_top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.round("value").cast("long").alias("value"))
    return tallies.tally(rows, "value", ["event_type"])


@query("segment_tally", "select kind, value, n, rank from (select kind, value, count(*) as n, row_number() over (partition by kind order by count(*) desc, value) as rank from (select 'return' as kind, l_returnflag as value from lineitem union all select 'status', l_linestatus from lineitem union all select 'discount', (l_discount * 100)::int::varchar from lineitem) where value not in ('', 'none', 'normal', 'auto', '0px', 'rgba(0, 0, 0, 0)') group by kind, value) where rank <= 12")
def segment_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("value")) for k, v in (("return", F.col("l_returnflag")), ("status", F.col("l_linestatus")), ("discount", F.round(F.col("l_discount") * 100).cast("int")))])
    return tallies.tally(items.select(F.explode(kinds).alias("x")).select("x.*"), "value", ["kind"])


@query("zero_safe_tally", "select l_discount, count(*) as n from lineitem where l_discount is not null group by l_discount")
def zero_safe_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.zero_safe_tally(table(spark, sf_dir, "lineitem"), "l_discount")


@query("usage_share_tiers", "with c as (select round(value / 10)::bigint as v, count(*) as n from events group by 1) select v, n, (select sum(n) from c)::bigint as total, case when n / (select sum(n) from c) >= 0.05 then 'structural' else 'decoration' end as tier from c")
def usage_share_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.share_tiers(table(spark, sf_dir, "events").select(F.round(F.col("value") / 10).cast("long").alias("v")), "v")


MS_SQL = "(epoch_us(ts) // 1000)"


@query(
    "stagger_ladders",
    f"""with g as (select user_id, event_type, count(*) as n, list_sort(list_distinct(list({MS_SQL}))) as d from events group by user_id, event_type having count(*) > 1),
 p as (select user_id, event_type, n, d, unnest(range(1, len(d) + 1)) as i from g), w as (select user_id, event_type, i, d[i + 1] - d[i] as gap from p where i < len(d)),
 f as (select user_id, event_type, gap, min(i) as i from w group by all)
 select g.user_id, g.event_type, g.n, array_to_string(g.d, ' ') as delays, (select string_agg(gap::varchar, ' ' order by i) from f where f.user_id = g.user_id and f.event_type = g.event_type) as stagger from g""",
)
def stagger_ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ms", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long"))
    out = tallies.ladders(rows, ["user_id", "event_type"], "ms")
    return out.select("user_id", "event_type", "n", F.array_join(F.col("delays").cast("array<string>"), " ").alias("delays"), F.array_join(F.col("stagger").cast("array<string>"), " ").alias("stagger"))


@query("keep_first", "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events) where rn = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return tallies.keep_first(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("longest_equal_run", "with m as (select *, event_type is distinct from lag(event_type) over w or row_number() over w = 1 as new from events window w as (partition by user_id order by ts, event_id)), r as (select *, sum(new::int) over (partition by user_id order by ts, event_id) as run from m) select user_id, max(n) as longest from (select user_id, run, count(*) as n from r group by 1, 2) group by 1")
def longest_equal_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.equal_runs(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("longest_true_run", "with m as (select *, value > 50 as f from events), r as (select *, sum((not f)::int) over (partition by user_id order by ts, event_id) as run from m) select user_id, max(n) as longest from (select user_id, run, count(*) filter (f) as n from r group by 1, 2) group by 1")
def longest_true_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.true_runs(table(spark, sf_dir, "events").withColumn("f", F.col("value") > 50), ["user_id"], "f", ["ts", "event_id"])


@query("sign_changes", "with m as (select user_id, (value > 50) <> lag(value > 50) over (partition by user_id order by ts, event_id) as c from events where event_type <> (select min(event_type) from events)) select user_id, coalesce(sum(c::int), 0)::bigint as changes from m group by user_id")
def sign_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of side between neighbours, after rows of one kind are left out."""
    rows = table(spark, sf_dir, "events")
    least = rows.agg(F.min("event_type").alias("least"))
    kept = rows.join(F.broadcast(least), F.col("event_type") != F.col("least"))
    return tallies.sign_changes(kept, ["user_id"], F.col("value") > 50, ["ts", "event_id"])


@query("carry_forward", "select user_id, event_id, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_purchase from events")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("p", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return rows.select("user_id", "event_id", tallies.carried(rows, ["user_id"], "p", ["ts", "event_id"]).alias("last_purchase"))


@query("max_by_groups", "select p_brand, p_size, n from (select p_brand, p_size, count(*) as n, row_number() over (partition by p_brand order by p_size desc, count(*) desc) as rn from part group by 1, 2) where rn = 1")
def max_by_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return tallies.largest_of(counted, ["p_brand"], "p_size", "n")


@query("most_common_shape", "select user_id, event_type, n from (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, min(event_id)) as rn from events group by 1, 2) where rn = 1")
def most_common_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.most_common(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("skip_reasons", "select user_id, min_by(event_type, (pri, event_id)) as reason from (select *, case when event_type = 'error' then 0 else 1 end as pri from events) group by user_id")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("reason"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("pri"), "event_id")
    return tallies.skip_reasons(rows, "user_id", "reason", "pri", "event_id")


@query("reason_histogram", "select o_orderstatus as reason, count(*) as n from orders group by 1")
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tallies.reason_histogram(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("reason")))


@query("zero_duration_drop", "select event_type, count(*) filter (value >= 10) as kept, count(*) filter (value < 10) as dropped from events group by event_type")
def zero_duration_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions that take no time are left out and counted."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("side"), F.lit("CSSTransition").alias("kind"), F.floor(F.col("value") / 10).alias("duration"))
    left = motion.kept(rows).groupBy("side").agg(F.count("*").alias("kept"))
    return motion.dropped(rows).join(left, "side", "left").select(F.col("side").alias("event_type"), F.coalesce("kept", F.lit(0)).alias("kept"), "dropped")


@query("set_ops", """with a as (select distinct user_id from events where event_type = (select min(event_type) from events)), b as (select distinct user_id from events where event_type = (select max(event_type) from events))
 select 'union' as op, count(*) as n from (select * from a union select * from b) union all select 'intersect', count(*) from (select * from a intersect select * from b)
 union all select 'left', count(*) from (select * from a except select * from b) union all select 'right', count(*) from (select * from b except select * from a)""")  # fmt: skip
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    ends = rows.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))
    a, b = (rows.join(F.broadcast(ends), F.col("event_type") == F.col(c)).select("user_id") for c in ("lo", "hi"))
    return matching.set_sizes(a, b, "user_id")


@query("subset_lines", r"select doc_id, i, line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i, l[i] as line from (select doc_id, string_split_regex(text, '[\n ]') as l from documents)) where regexp_full_match(line, '[|:\- ]*') and line <> ''")
def subset_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made of table marks alone; words stand for lines."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[\n ]")).alias("i", "line"))
    return rows.where(library.marks_only(F.col("line")) & (F.col("line") != "")).select("doc_id", (F.col("i") + 1).alias("i"), "line")


@query("spec_first_listing", "select s_suppkey, row_number() over (order by s_nationkey <> 7, s_name) as place from supplier")
def spec_first_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One kind of rows first, then by name: places are given from a range-partitioned sort."""
    from weftline.operators import ordering

    return ordering.numbered(table(spark, sf_dir, "supplier").withColumn("late", F.col("s_nationkey") != 7), ["late", "s_name"], "place").select("s_suppkey", "place")


@query("length_order_top20", "select p_partkey, row_number() over (order by length(p_name) desc, p_name, p_partkey) as place from part qualify place <= 20")
def length_order_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest names first, ties by name: a top-k report."""
    return tallies.ranked(table(spark, sf_dir, "part"), [], [F.desc(F.length("p_name")), F.asc("p_name"), F.asc("p_partkey")], 20).select("p_partkey", F.col("rank").alias("place"))


@query("extreme_elements", "select o_custkey, min(o_totalprice) as first_top, max(o_totalprice) as last_bottom, count(distinct floor(o_totalprice / 8000 + 0.5)) as n_rows from orders group by o_custkey")
def extreme_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_totalprice").alias("first_top"), F.max("o_totalprice").alias("last_bottom"), F.count_distinct(F.floor(F.col("o_totalprice") / 8000 + 0.5)).alias("n_rows"))


@query("pattern_support", "select p_type as pattern, count(distinct p_brand) as entries from part group by p_type having count(distinct p_brand) >= 2")
def pattern_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns that two entries or more support."""
    return library.pattern_support(table(spark, sf_dir, "part"), "p_type", "p_brand").select(F.col("p_type").alias("pattern"), "entries")


@query("largest_canvases", "select o_custkey as page, arg_max(o_orderkey, (round(o_totalprice)::bigint * (o_orderkey % 300), o_orderkey)) as id, bool_or(w) as warn from (select *, (max((round(o_totalprice)::bigint * (o_orderkey % 300), o_orderkey)) over (partition by o_custkey) = (round(o_totalprice)::bigint * (o_orderkey % 300), o_orderkey)) and round(o_totalprice) >= 200 and o_orderkey % 300 >= 200 as w from orders) group by o_custkey")
def largest_canvases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as canvases of their customers' pages: the largest, and whether both of its sides are large."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("id"), F.round("o_totalprice").cast("long").alias("css_w"), (F.col("o_orderkey") % 300).alias("css_h"))
    return capture.largest_canvas(rows)


@query("fidelity_grades", "select p_partkey, case when p_size % 5 > 0 and p_size % 3 > 0 and p_size % 7 > 0 then 'spec' when p_size % 4 > 0 and p_size % 2 = 0 then 'signature-only' when p_size % 4 > 0 or p_size % 2 > 0 then 'partial' else 'none' end as grade from part")
def fidelity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of captures of p_size % 5 animations, whose targets and triggers, easings and numbers come from other remainders."""
    n = F.col("p_size")
    many = lambda k, x: F.when(k > 0, F.transform(F.sequence(F.lit(1), k), lambda _: x)).otherwise(F.filter(F.array(x), lambda _: F.lit(False)))
    one = F.struct(F.when(n % 3 > 0, F.lit("div")).otherwise("").alias("target"), F.when(n % 7 > 0, F.lit("scroll")).alias("trigger"))
    rows = table(spark, sf_dir, "part").select("p_partkey", many(n % 5, one).alias("animations"), many(n % 4, F.lit("ease")).alias("easings"), many(n % 2, F.lit(1)).alias("numerics"))
    return rows.select("p_partkey", motion.fidelity(rows).alias("grade"))


@query("carrier_properties", """with p as (select p_partkey, case when p_size % 3 = 0 then ['opacity', 'cursor'] else ['z-index'] end || case when p_size % 2 = 0 then ['transform', 'opacity'] else [] end || [case p_size % 5 when 0 then 'width' when 1 then 'cursor' end] as k, case p_size % 5 when 0 then 'width' when 1 then 'cursor' end as own from part),
 f as (select p_partkey, own, list_sort(list_distinct(list_filter(k, lambda x: x in ('opacity', 'transform', 'width')))) as c from p)
 select p_partkey, array_to_string(case when len(c) > 0 then c when own is null then [] else [own] end, ' ') as carriers from f""")  # fmt: skip
def carrier_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties that carry motion, of the keyframes and the property that remainders of p_size give."""
    n, word = F.col("p_size"), lambda *k: F.create_map(*[x for c in k for x in (F.lit(c), F.lit("0"))])
    first = F.when(n % 3 == 0, word("opacity", "cursor")).otherwise(word("z-index"))
    last = F.when(n % 2 == 0, word("transform", "opacity"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.struct(first.alias("from"), last.alias("to")).alias("values"), F.when(n % 5 == 0, "width").when(n % 5 == 1, "cursor").alias("property"))
    return rows.select("p_partkey", F.array_join(F.array_sort(motion.carriers(rows)), " ").alias("carriers"))
