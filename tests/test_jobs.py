from heddle.operators import assembly as A
from heddle.plans import registry

SF = "/root/testdata/sf0.001"


def test_route_metrics_of_all_requests(spark):
    rows = registry.queries()["A18_route_metrics_all"](spark, SF).collect()
    assert sum(r.requests for r in rows) == spark.read.parquet(f"{SF}/events.parquet").count()
    assert len({r.route for r in rows}) > 10


def test_all_ambiguous_parts(spark):
    rows = [(i, "" if i % 7 else "k", 0 if i % 5 else 3, i % 6, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "part_id long, collection_key string, total_parts int, attempts int, posted_at long")
    want = [r[0] for r in rows if r[1] == "" and r[2] == 0 and r[3] < 5]
    assert len(want) > 200 and sorted(r.part_id for r in A.ambiguous_parts(df).collect()) == want
    assert sorted(r.part_id for r in A.ambiguous_parts(df, 200).collect()) == want[-200:]
    assert "P03_ambiguous_parts_all" in registry.queries()


def test_pass_and_route_queries_return_all(spark):
    """The whole state of groups in A11 and A12, and every method and status of a route in A18."""
    queries, sql = registry.queries(), registry.oracle_sql()
    whole = set(queries["ST13_pass_outcomes"](spark, SF).columns)
    for name in ("A11_consecutive_failures", "A12_last_success_times"):
        assert set(queries[name](spark, SF).columns) == whole and sql[name] == sql["ST13_pass_outcomes"]
    assert {"method", "route", "status"} < set(queries["A18_route_metrics_all"](spark, SF).columns)
