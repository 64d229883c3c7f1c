"""Queries that trace what texts state to measured documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import provenance
from weftline.queries.registry import query
from weftline.session import cut, table

TOTAL_SQL = "printf('%.2f', o_totalprice + 10000)"
HEX_SQL = "lower(lpad(to_hex(o_orderkey % 16777216), 6, '0'))"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(capture_id, doc): each order with its lines as a measured document: a time, a list of pairs of lengths and numbers, a key that states a time, a note with units, colours and a curve."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("capture_id")).agg(F.array_join(F.array_sort(F.collect_list(F.format_string("[%d, %d]", F.col("l_quantity").cast("int"), F.col("l_linenumber").cast("int")))), ", ").alias("lines"))
    # joined by the id itself, so that what documents hold is already where their ids are
    o = table(spark, sf_dir, "orders").withColumn("capture_id", F.col("o_orderkey").cast("string")).join(lines, "capture_id")
    doc = F.format_string(
        '{"duration": %s, "container": {"lines": [%s]}, "rest 12s": true, "none": null, "note": "in %ds %dpx #%s rgb(%d, 7, 9) 3x4 cubic-bezier(0.1, .2,0.30, 1)"}',
        F.format_string("%.2f", F.col("o_totalprice") + 10000), F.col("lines"), (F.col("o_custkey") % 59 + 1).cast("int"), F.col("o_custkey").cast("int"),
        F.lower(F.lpad(F.hex(F.col("o_orderkey") % 16777216), 6, "0")), (F.col("o_orderkey") % 300).cast("int"),
    )
    return o.select("capture_id", doc.alias("doc"))


@query(
    "measured_leaves",
    f"""with o as (select * from orders where o_orderkey in (select l_orderkey from lineitem)),
 v as (select o_orderkey as id, 'blob' as class, null as role, unnest(['duration', 'container', 'lines', 'rest 12s', 'none', 'note']) as value from o
  union all select o_orderkey, 'blob', null, 'in ' || (o_custkey % 59 + 1) || 's ' || o_custkey || 'px #' || {HEX_SQL} || ' rgb(' || (o_orderkey % 300) || ', 7, 9) 3x4 cubic-bezier(0.1, .2,0.30, 1)' from o
  union all select o_orderkey, 'hex', null, '#' || {HEX_SQL} from o union all select o_orderkey, 'hex', null, '#' || lower(lpad(to_hex(o_orderkey % 300), 2, '0')) || '0709' from o where o_orderkey % 300 <= 255
  union all select o_orderkey, 'bezier', null, '0.1 0.2 0.3 1' from o),
 n as (select o_orderkey as id, 'num' as class, 'time' as role, {TOTAL_SQL}::decimal(18, 4) as x from o union select o_orderkey, 'num', 'time', 12 from o union select o_orderkey, 'num', 'time', o_custkey % 59 + 1 from o
  union select o_orderkey, 'num', 'len', o_custkey from o union select l_orderkey, 'num', 'len', l_quantity::int from lineitem where l_orderkey in (select o_orderkey from o) union select l_orderkey, 'num', null, l_linenumber from lineitem where l_orderkey in (select o_orderkey from o)
  union select o_orderkey, 'num', null, unnest([0.1, 0.2, 0.3, 1, 7, 9, 3, 4]) from o union select o_orderkey, 'num', null, o_orderkey % 300 from o
  union select l_orderkey, 'count', null, count(*) from lineitem where l_orderkey in (select o_orderkey from o) group by l_orderkey union select o_orderkey, 'count', null, 2 from o)
 select id::varchar as capture_id, class, coalesce(role, '') as role, count(*) as n, sum(x)::decimal(38, 4)::varchar as total, null as shown from n group by all
 union all select id::varchar, class, '', count(distinct value), null, string_agg(distinct value, ' ' order by value) from v group by all""",
)
def measured_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents of all orders hold, by class and role."""
    rows = provenance.measured_values(captures(spark, sf_dir)).withColumn("role", F.coalesce("role", F.lit("")))
    number, value = F.col("class").isin("num", "count"), F.col("value")
    # numbers are summed by hash before texts are collected, so only a few rows of a group are sorted
    sums = rows.groupBy("capture_id", "class", "role", F.when(~number, value).alias("text")).agg(F.count("*").alias("n"), F.sum(F.when(number, value.cast("decimal(18,4)"))).alias("total"))
    total = F.sum("total").cast("decimal(38,4)").cast("string")
    return sums.groupBy("capture_id", "class", "role").agg(F.sum("n").alias("n"), total.alias("total"), F.nullif(F.array_join(F.array_sort(F.collect_list("text")), " "), F.lit("")).alias("shown"))


@query(
    "untraced_values",
    f"""with o as (select *, {TOTAL_SQL} as t from orders where o_orderkey in (select l_orderkey from lineitem)), l as (select l_orderkey as k, list(l_quantity::int) as q from lineitem group by 1), x as (select * from o join l on k = o_orderkey)
 select o_orderkey::varchar as capture_id, 'num' as class, t || 'px' as raw from x where t::double <> o_custkey and not list_contains(q, t::double)
 union all select o_orderkey::varchar, 'num', (o_custkey + 1) || 'px' from x where not list_contains(q, (o_custkey + 1)::int)
 union all select o_orderkey::varchar, 'num', (o_orderkey + 100000)::varchar from x where round_even(t::double, 0) <> o_orderkey + 100000 and o_custkey <> o_orderkey + 100000
 union all select o_orderkey::varchar, 'hex', '#00ff00' from x where o_orderkey % 2 = 1
 union all select o_orderkey::varchar, 'month', 'May 2026' from x where o_orderkey % 3 = 0""",
)
def untraced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sentence about each order states without a measurement: a time as a length, a length that is one off, a free number, a colour, a month; the rest of it traces back."""
    seen = cut(captures(spark, sf_dir))
    k, total = F.col("o_orderkey"), F.format_string("%.2f", F.col("o_totalprice") + 10000)
    text = F.concat(
        F.lit("Total "), total, F.lit("px, "), total, F.lit("ms, "), (F.col("o_custkey") % 59 + 1).cast("int") * 1000, F.lit("ms, "), F.col("o_custkey").cast("string"), F.lit(" of them, "), (F.col("o_custkey") + 1).cast("string"), F.lit("px; "),
        (k + 100000).cast("string"), F.lit(" #"), F.lower(F.lpad(F.hex(k % 16777216), 6, "0")), F.when(k % 2 == 1, " #0F0").otherwise(""), F.when(k % 3 == 0, " May 2026").otherwise(""),
    )
    entries = table(spark, sf_dir, "orders").select(k.cast("string").alias("capture_id"), text.alias("text")).join(seen.select("capture_id"), "capture_id", "left_semi")
    return provenance.untraced(cut(provenance.asserted_values(entries)), cut(provenance.measured_values(seen)))
