"""Joins that read whole tables, against brute force on small ones: no key of the tables decides what is looked at."""

from weftline.queries import QUERIES


def tables(spark, folder, **rows):
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_tolerance_anti_join_reads_every_order(spark, tmp_path):
    parts = [100.0, 900.0, 1500.0, 9000.0, 20000.0]
    items = [(1, 905.0 * 40), (96, 1520.0 * 40), (97, 100.0 * 40), (98, 9017.0 * 40)]  # an order of each remainder counts
    sf = tables(spark, tmp_path, part=([(v,) for v in parts], "p_retailprice double"), lineitem=(items, "l_orderkey bigint, l_extendedprice double"))
    want = {float(round(v)) for v in parts if not any(abs(round(v) - round(x / 40)) <= max(16.0, round(v) * 0.002) for _, x in items)}
    assert {r.v for r in QUERIES["tolerance_anti_join"](spark, sf).collect()} == want == {1500.0, 20000.0}


def test_prefix_resolution_asks_for_every_customer(spark, tmp_path):
    rows = [(k, f"Customer#{k:09d}", ["A", "B", "C"][k % 3]) for k in range(1, 60)]
    sf = tables(spark, tmp_path, customer=(rows, "c_custkey bigint, c_name string, c_mktsegment string"))
    asked = {q for k, name, _ in rows for q in (name[: 10 + k % 9], f"zz{k}", name + "x")}
    want = {}
    for q in asked:
        low = q.lower()
        owners = {o for _, n, o in rows if n.lower() == low} or {o for _, n, o in rows if n.lower().startswith(low) or low.startswith(n.lower())}
        want[q] = ("miss", None) if not owners else ("hit", *owners) if len(owners) == 1 else ("ambiguous", None)
    got = {r["query"]: (r.outcome, r.owner) for r in QUERIES["prefix_resolution"](spark, sf).collect()}
    assert got == want
