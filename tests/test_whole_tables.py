from arcwise.plans.queries import QUERIES


def test_whole_tables(spark, tmp_path):
    """Lines of any quantity count, against brute force."""
    rows = [(o, p, (o * p) % 4, 1 + (o * 7 + p) % 50, 10.25 * p) for o in range(24) for p in {o * 3 % 20, o * 3 % 20 + 1, 30 + o % 5 if o < 12 else 40}]
    rows += [(99, 70, 9, 1, 1.0), (99, 71, 9, 2, 2.0), (99, 71, 9, 3, 2.5)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_quantity int, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))

    def run(name):
        return [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()]

    def components(pairs):
        group = {v: v for p in pairs for v in p}
        for _ in group:
            for a, b in pairs:
                group[a] = group[b] = min(group[a], group[b])
        return group

    bought = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]}
    assert dict(run("whole_components")) == components(bought)
    ends = [v for p in bought for v in p]
    assert dict(run("whole_degrees")) == {v: ends.count(v) for v in ends}
    sold = {}
    for _, p, s, _, price in rows:
        sold[f"p{p}", f"s{s}"] = sold.get((f"p{p}", f"s{s}"), 0) + int(price * 100 + 0.5)
    assert {(a, b): w for a, b, w in run("whole_part_suppliers")} == sold
    group = list(components(set(sold)).values())
    assert dict(run("whole_component_sizes")) == {g: group.count(g) for g in group}
