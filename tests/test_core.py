import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenframe.functions import text
from lumenframe.operators import joins, relations, shape
from lumenframe.operators.pipe import Pipe
from lumenframe.plans import analysis, catalogue, dialects, statements
from lumenframe.sources import tables
from lumenframe.streaming import events
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE_SQL:
        assert differences(df, catalogue.ORACLE_SQL[name], SF) is None
    else:
        df.collect()


@pytest.mark.parametrize("name", ["join_theta", "graph_two_hop"])
def test_whole_tables(spark, name):
    sf = "/root/testdata/sf0.01"
    df = catalogue.QUERIES[name](spark, sf)
    assert differences(df, catalogue.ORACLE_SQL[name], sf) is None
    assert df.agg(F.max(df.columns[0])).first()[0] > 300


def test_less_join_of_odd_rows_in_packs(spark):
    nan = float("nan")
    a = [(k, i, i % 7 if i % 11 else None, float(i * 37 % 101) if i % 13 else nan) for k in ("x", "y", None) for i in range(60)]
    b = [(k, i, i % 9 if i % 17 else None, None if i % 19 == 0 else nan if i % 23 == 0 else float(i * 29 % 97)) for k in ("x", "z", None) for i in range(80)]
    left, right = spark.createDataFrame(a, "k string, i int, low int, large double"), spark.createDataFrame(b, "k string, j int, high int, small double")
    want = sorted((r.i, r.j) for r in left.join(right, "k").filter("low < high AND large > small").collect())
    for pack in (1, 5, 64):
        assert sorted((r.i, r.j) for r in joins.less_join(left, right, ["k"], "low", "high", "large", "small", classes=4, pack=pack).collect()) == want
    assert want and not joins.less_join(left, right.filter("high IS NULL"), ["k"], "low", "high", "large", "small").head(1)


def test_theta_joins_run_in_many_tasks(spark):
    df = catalogue.QUERIES["join_theta"](spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan and "CartesianProduct" not in plan


def test_sketches_are_made_per_group_only(spark):
    plan = catalogue.QUERIES["agg_approx_bounds"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    sketching = [line for line in plan.splitlines() if "theta_sketch_agg" in line and "keys=[" in line]
    assert sketching and not any("l_partkey" in line.split("keys=[")[1].split("]")[0] for line in sketching)


def test_streams_equal_batches(spark, tmp_path):
    e = tables.table(spark, SF, "events")
    e.repartition(3).write.parquet(f"{tmp_path}/in")
    last = e.agg(F.max("ts")).first()[0] + dt.timedelta(days=30)
    e.limit(1).withColumn("ts", F.lit(last)).write.mode("append").parquet(f"{tmp_path}/in")  # lets the watermark pass
    s = events.read_stream(spark, f"{tmp_path}/in", e.schema)
    make = lambda d, late: events.tumbling(d, "ts", "1 hour", ["event_type"], F.count("*").alias("n"), late=late)
    events.run_available(make(s, "1 day"), f"{tmp_path}/out", f"{tmp_path}/c1")
    want = make(e.withColumn("ts", F.col("ts").cast("timestamp")), None)
    got = spark.read.schema(want.schema).parquet(f"{tmp_path}/out")
    assert {tuple(r) for r in got.collect()} - {tuple(r) for r in want.collect()} == set() and got.count() > 0
    events.run_available(events.dedup(s.drop("props"), ["event_type"]), f"{tmp_path}/d", f"{tmp_path}/c2")
    assert spark.read.parquet(f"{tmp_path}/d").count() == e.select("event_type").distinct().count()


def test_streams_join_by_interval_and_keep_state(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    a = [(1, at(0), 10), (1, at(30), 11), (2, at(5), 12)]
    b = [(1, at(4), 20), (1, at(0), 21), (1, at(31), 22), (2, at(50), 23)]
    want = {(1, 10, 20), (1, 11, 22)}
    spark.createDataFrame(a, "k int, t timestamp, x int").write.parquet(f"{tmp_path}/a")
    spark.createDataFrame(b, "k int, s timestamp, y int").write.parquet(f"{tmp_path}/b")
    tables_ = [spark.read.parquet(f"{tmp_path}/{n}") for n in "ab"]
    assert {(r.k, r.x, r.y) for r in events.interval_join(*tables_, ["k"], "t", "s", "10 minutes").collect()} == want
    streams = [events.read_stream(spark, f"{tmp_path}/{n}", d.schema) for n, d in zip("ab", tables_)]
    events.run_available(events.interval_join(*streams, ["k"], "t", "s", "10 minutes", late="1 hour"), f"{tmp_path}/out", f"{tmp_path}/c1")
    assert {(r.k, r.x, r.y) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want
    seen = {}
    counted = events.counted_by_key(streams[0], "k", "t", "1 hour")
    counted.writeStream.outputMode("update").foreachBatch(lambda d, _: seen.update({r.k: r.n for r in d.collect()})).option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    assert seen == {1: 2, 2: 1}


def test_asof_of_nulls_and_ties(spark):
    a = spark.createDataFrame([(1, 5, "x"), (1, None, "y"), (2, 1, "z")], "k int, t int, a string")
    b = spark.createDataFrame([(1, 5, 10), (1, 3, 7), (2, 2, 9), (1, None, 4)], "k int, t int, v int")
    assert {(r.a, r.v) for r in joins.asof_join(a, b, "t", ["k"], how="left").collect()} == {("x", 10), ("y", None), ("z", None)}
    assert {(r.a, r.v) for r in joins.asof_join(a, b, "t", ["k"], strict=True).collect()} == {("x", 7)}
    assert {(r.a, r.v) for r in joins.asof_join(a, b, "t", ["k"], direction="forward").collect()} == {("x", 10), ("z", 9)}


def test_connect_by_stops_at_cycles(spark):
    e = spark.createDataFrame([(1, None), (2, 1), (3, 2), (1, 3)], "id int, mgr int")
    assert sorted((r.id, r.level) for r in relations.connect_by(e, "id", "mgr", F.col("mgr").isNull()).collect()) == [(1, 1), (2, 2), (3, 3)]


def test_merge_deletes_and_inserts(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "k int, v int")
    s = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "k int, v int")
    got = relations.merge(t, s, ["k"], {"v": "s.v"}, delete_when="t.v = 20")
    assert {tuple(r) for r in got.collect()} == {(1, 1), (3, 3), (None, 30)}


def test_graph_paths(spark):
    g = relations.Graph(spark.createDataFrame([(i,) for i in range(4)], "id int"), spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "src int, dst int"))
    got = g.paths(g.nodes().filter("id = 0"), "id", 1, 2)
    assert {(r.end, r.length) for r in got.collect()} == {(1, 1), (2, 2)}
    assert {(r.a, r.b) for r in g.hop(g.nodes().select(F.col("id").alias("a")), "a", "b", "any").filter("a = 1").collect()} == {(1, 0), (1, 2)}


def test_numbered_holds_at_scale(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 1_000_000
        df = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id")).alias("v"), "id")
        got = joins.numbered(df, ["v"], "at").agg(F.count_distinct("at"), F.min("at"), F.max("at")).first()
        assert tuple(got) == (n, 0, n - 1)
        both = joins.positional_join(df, df.select(F.col("id").alias("j"), F.col("v").alias("w")), ["id"], ["j"])
        assert both.count() == n and both.filter("id <=> j").count() == n
        assert shape.top_percent(df, 50, ["id"]).agg(F.count("*"), F.max("id")).first()[:] == (n // 2, n // 2 - 1)
        assert shape.top_percent(df, 0, ["id"]).count() == 0 and shape.top_percent(df, 100, ["id"]).count() == n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_asof_null_keys_and_slices(spark):
    a = spark.createDataFrame([(None, 5, "x"), (1, 40, "y"), (1, 2, "z")], "k int, t int, l string")
    b = spark.createDataFrame([(None, 5, 1), (1, 3, 2), (1, 4, 3)], "k int, t int, v int")
    for slices in (None, lambda t: F.floor(t / 10)):
        assert {(r.l, r.v) for r in joins.asof_join(a, b, "t", ["k"], how="left", slice_by=slices).collect()} == {("x", None), ("y", 3), ("z", None)}
        assert {(r.l, r.v) for r in joins.asof_join(a, b, "t", ["k"], slice_by=slices).collect()} == {("y", 3)}
        assert {(r.l, r.v) for r in joins.asof_join(a, b, "t", ["k"], direction="forward", slice_by=slices).collect()} == {("z", 2)}


def test_range_join_of_wide_ranges(spark):
    p = spark.createDataFrame([(float(x),) for x in (-5, 0, 3, 10**6, 10**9, 2 * 10**9)], "v double")
    r = spark.createDataFrame([(0.0, 1e9), (3.0, 3.0), (2.5, 3.5), (9.0, 1.0), (-7.0, 10.0)], "lo double, hi double")
    want = {(v[0], lo, hi) for v in p.collect() for lo, hi in r.collect() if lo <= v[0] <= hi}
    assert {tuple(x) for x in joins.range_join(p, r, "v", "lo", "hi", 1.0).collect()} == want


def test_row_patterns_that_overlap(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 20), (2, 1, 9), (2, 2, 1), (2, 3, 2)], "k int, t int, v int")
    over = {"A": F.col("v") > 1, "B": F.col("v") > 8}
    got = relations.match_recognize(df, ["k"], ["t"], "A B", over, {"a": ("last", "A", "t"), "b": ("last", "B", "t")}, "k int, match_number long, a int, b int")
    assert {tuple(r) for r in got.collect()} == {(1, 1, 1, 2)}
    got = relations.match_recognize(df, ["k"], ["t"], "A+ B", over, {"n": ("count", "A", "t"), "s": ("sum", "", "v")}, "k int, match_number long, n int, s int")
    assert {tuple(r) for r in got.collect()} == {(1, 1, 2, 34)}
    got = relations.match_recognize(df, ["k"], ["t"], "(A | X){2}", over, {}, "k int, t int, match_number long, classifier string", skip="to next row", all_rows=True)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 1, "A"), (1, 2, 1, "A"), (1, 2, 2, "A"), (1, 3, 2, "A"), (2, 1, 1, "A"), (2, 2, 1, "X"), (2, 2, 2, "X"), (2, 3, 2, "A")]


def test_merge_arms(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30), (None, 1)], "k int, v int")
    s = spark.createDataFrame([(1, 1), (2, 2), (5, 5), (6, -6)], "k int, v int")
    arms = [(relations.MATCHED, "s.v > 1", "delete"), (relations.MATCHED, None, {"v": "t.v + s.v"}), (relations.NOT_MATCHED, "s.v > 0", {}), (relations.NOT_BY_SOURCE, "t.k = 3", {"v": "-1"})]
    assert {tuple(r) for r in relations.merge_into(t, s, ["k"], arms).collect()} == {(1, 11), (3, -1), (None, 1), (5, 5)}
    with pytest.raises(Exception, match="several source rows"):
        relations.merge(t, s.union(s), ["k"], {"v": "s.v"}).collect()
    assert relations.merge(t, s.union(s), ["k"], insert_rows=False).count() == 4


def test_connect_by_columns(spark):
    e = spark.createDataFrame([(1, None, "z"), (2, 1, "b"), (3, 1, "a"), (4, 2, "c"), (2, 4, "x")], "id int, mgr int, n string")
    got = {(r.id, r.level, r.root, r.is_leaf, r.is_cycle) for r in relations.connect_by(e, "id", "mgr", F.col("mgr").isNull(), siblings=["n"]).collect()}
    assert got == {(1, 1, 1, False, False), (2, 2, 1, False, False), (3, 2, 1, True, False), (4, 3, 1, True, True)}
    assert [r.id for r in relations.connect_by(e, "id", "mgr", F.col("mgr").isNull(), siblings=["n"]).orderBy("place").collect()] == [1, 3, 2, 4]


def test_graph_match(spark):
    people = spark.createDataFrame([(1, "ann"), (2, "bob"), (3, "cy")], "id int, name string")
    knows = spark.createDataFrame([(1, 2, 2001), (2, 3, 2005), (3, 1, 2009)], "src int, dst int, since int")
    g = relations.Graph({"Person": people}, {"KNOWS": knows, "LIKES": knows.limit(0)})
    got = g.match("(a:Person)-[e:KNOWS]->(b:Person)-[f:KNOWS]->(c)", {"x": "a.name", "y": "c.name", "s": "e.since"}, "e.since > 2002")
    assert {tuple(r) for r in got.collect()} == {("bob", "ann", 2005), ("cy", "bob", 2009)}
    assert {tuple(r) for r in g.match("(a)<-[:KNOWS|LIKES]-(b)", {"x": "a.id", "y": "b.id"}).collect()} == {(2, 1), (3, 2), (1, 3)}
    assert g.match("(a)-[:KNOWS]->(b)-[:KNOWS]->(c)-[:KNOWS]->(a)", {"x": "a.id"}).count() == 3
    assert g.match("(a)-[:KNOWS]-(b)", {"x": "a.id"}).count() == 6


def test_frames_that_exclude(spark):
    df = spark.createDataFrame([(1, 1, 10), (1, 1, 20), (1, 2, 5), (1, 3, None)], "k int, o int, v int")
    got = lambda **x: {(r.o, r.v, r.s) for r in shape.excluding(df, "v", ["k"], "o", -1, 0, "s", **x).collect()}
    assert got(exclude="group") == {(1, 10, None), (1, 20, None), (2, 5, 30), (3, None, 5)}
    assert got(exclude="ties") == {(1, 10, 10), (1, 20, 20), (2, 5, 35), (3, None, 5)}
    assert got(exclude="current row", function="count") == {(1, 10, 1), (1, 20, 1), (2, 5, 2), (3, None, 1)}


def test_shapes(spark):
    df = spark.createDataFrame([(1, {"a": 1}, [[1, 2], [3]], '[{"x": 1, "in": [{"y": 2}, {"y": 3}]}, {"x": 4}]')], "key int, m map<string,int>, a array<array<int>>, j string")
    assert [(r.key_, r.value, r.path) for r in shape.flatten(df, F.col("m")).collect()] == [("a", 1, "a")]
    assert [(r.path, r.value) for r in shape.flatten(df, F.col("a"), recursive=True).collect()] == [("[0][0]", 1), ("[0][1]", 2), ("[1][0]", 3)]
    assert shape.flatten(df, F.col("a"), mode="object").count() == 0
    assert {(r.n, r.x, r.y) for r in shape.json_table(df, "j", "x int", nested={"in": "y: int"}, ordinality="n").collect()} == {(1, 1, 2), (1, 1, 3), (2, 4, None)}
    o = spark.createDataFrame([('{"a": "t", "b": 2, "c": true, "d": [1], "e": {"f": 1}, "g": null}', "p.q.r", "<r><i k='1'>x</i><i k='2'>y</i></r>")], "j string, s string, x string")
    assert {(r.key, r.value, r.type) for r in shape.json_pairs(o, "j").collect()} == {("a", "t", 1), ("b", "2", 2), ("c", "true", 3), ("d", "[1]", 4), ("e", '{"f":1}', 5), ("g", None, 0)}
    assert [(r["index"], r.value) for r in shape.split_to_table(o, "s", ".").collect()] == [(1, "p"), (2, "q"), (3, "r")]
    assert [(r.k, r.t) for r in shape.xml_nodes(o, "x", "/r/i", {"k": ("@k", "int"), "t": ("text()", "string")}).collect()] == [(1, "x"), (2, "y")]


def test_more_pipe_stages(spark, tmp_path):
    df, seen = spark.createDataFrame([(1,), (2,)], "k int"), []
    assert sorted(r.k for r in Pipe(df).recursive_union(lambda d: d.filter("k < 4").select((F.col("k") + 2).alias("k"))).df.collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.k for r in Pipe(df).recursive_union(lambda d: d.select((F.col("k") % 3 + 1).alias("k")), all_=False).df.collect()) == [1, 2, 3]
    assert [p.df.count() for p in Pipe(df).fork(lambda p: p.where("k > 1"), lambda p: p)] == [1, 2]
    assert Pipe(df).tee(lambda p: p.export_data(f"{tmp_path}/t")).df.count() == 2 and spark.read.parquet(f"{tmp_path}/t").count() == 2
    assert Pipe(df).log(lambda d: seen.append(d.count())).with_("ks", lambda p: p.where("k = 1")).if_((False, lambda p: p), (True, lambda p: p.where("k = 2"))).df.count() == 1
    assert seen == [2] and spark.table("ks").count() == 1 and Pipe(df).static_describe().described == [("k", "int", True)]
    assert [tuple(r) for r in Pipe(df).describe().df.collect()] == [(0, "k", "int")]
    assert Pipe(df).create_table("pipe_made").count() == 2 and Pipe(df).insert("pipe_made", by_name=True).count() == 4


def test_pipe_stages(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, s string")
    assert Pipe(df).union(df).distinct().df.count() == 2
    assert Pipe(df).except_(df.limit(0), all_=True).df.count() == 3
    assert Pipe(df).assert_(F.col("k") > 0).df.count() == 3
    with pytest.raises(Exception, match="k is 1"):
        Pipe(df).assert_(F.col("k") > 1, "k is 1").df.collect()
    with pytest.raises(ValueError, match="unknown"):
        Pipe(df).set(nope=F.lit(1))


def test_text_functions(spark):
    df = spark.createDataFrame([("abc", "2024-01-31", "2024-02-01")], "s string, a string, b string").select("s", F.to_timestamp("a").alias("a"), F.to_timestamp("b").alias("b"))
    r = df.select(text.similar_to(F.col("s"), "a(b|x)%").alias("x"), text.glob(F.col("s"), "a*[bc]").alias("g"), text.boundary_diff("month", F.col("a"), F.col("b")).alias("m"), text.boundary_diff("day", F.col("a"), F.col("b")).alias("d"), text.div0(F.lit(1.0), F.lit(0.0)).alias("z")).first()
    assert tuple(r) == (True, True, 1, 1, 0.0)
    odd = spark.createDataFrame([("a.b",), ("axb",), ("x\ny",), ("]",)], "s string")
    of = lambda c: [r[0] for r in odd.select(c).collect()]
    assert of(text.similar_to(F.col("s"), "a.b")) == [True, False, False, False]
    assert of(text.similar_to(F.col("s"), "x%|[]%_]")) == [False, False, True, True]
    assert of(text.glob(F.col("s"), "[!a]*")) == [False, False, True, True]


LINEAGE = [
    ("SELECT 1 AS c FROM t", "c", set()),
    ("WITH c AS (SELECT a FROM t) SELECT a FROM c", "a", {"t.a"}),
    ("WITH c (x) AS (SELECT a FROM t) SELECT x FROM c", "x", {"t.a"}),
    ("WITH c AS (SELECT * FROM t) SELECT * FROM c", "a", {"t.a"}),
    ("SELECT a FROM t UNION SELECT b FROM u", "a", {"t.a", "u.b"}),
    ("SELECT a FROM t INTERSECT SELECT x FROM u", "a", {"t.a", "u.x"}),
    ("SELECT a FROM t EXCEPT SELECT x FROM u", "a", {"t.a"}),
    ("SELECT (SELECT max(x) FROM u WHERE u.b = t.b) AS m FROM t", "m", {"u.x"}),
    ("WITH a AS (SELECT c1 FROM t), b AS (SELECT c1 AS c2 FROM a) SELECT c2 FROM b", "c2", {"t.c1"}),
    ("SELECT e + b AS e FROM t LATERAL VIEW explode(arr) v AS e", "e", {"t.arr", "t.b"}),
    ("SELECT a, count(*) AS n FROM t GROUP BY ROLLUP(a)", "a", {"t.a"}),
    ("WITH RECURSIVE r(n) AS (SELECT a FROM t UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT n FROM r", "n", {"t.a"}),
    ("SELECT sum(b) OVER (PARTITION BY a) AS w FROM t", "w", {"t.a", "t.b"}),
    ("SELECT p.a AS q FROM t p JOIN t o ON p.a = o.b", "q", {"t.a"}),
]


@pytest.fixture
def small(spark):
    spark.sql("SELECT 1 AS a, 2 AS b, 3 AS c1, array(1) AS arr").createOrReplaceTempView("t")
    spark.sql("SELECT 1 AS b, 2 AS x, named_struct('p', 1) AS s").createOrReplaceTempView("u")
    return spark


@pytest.mark.parametrize("sql, column, want", LINEAGE)
def test_lineage(small, sql, column, want):
    assert {f"{r.source_table}.{r.source_column}" for r in analysis.lineage(small, sql).collect() if r.name == column} == want
    steps = analysis.hops(small, sql).filter(F.col("name") == column).collect()
    assert {f"{r.source_table}.{r.column}" for r in steps if r.kind == "origin"} == want
    assert all(r.parent is None or r.parent < r.hop for r in steps)


def test_hops_pass_renames(small):
    got = analysis.hops(small, "WITH c AS (SELECT a AS x, b FROM t) SELECT x AS y, sum(b + 1) AS s FROM c GROUP BY x").collect()
    assert [(r.name, r.hop, r.parent, r.column, r.kind, r.via) for r in got] == [("y", 0, None, "a", "origin", "y,x"), ("s", 0, None, "s", "aggregate", ""), ("s", 1, 0, "b", "origin", "")]


def test_all_faults_at_once(small):
    got = analysis.diagnostics(small, "SELECT nope, t.a, zip FROM t JOIN u ON t.b = u.b\nWHERE b > 1 AND u.s.q = 1 AND abs(1, 2) = 3 AND array_contains(a, 1)").collect()
    assert [(r.kind, r.line, r.column, r.end_column, r.fragment) for r in got] == [
        ("unknown-column", 1, 7, 11, "nope"), ("unknown-column", 1, 18, 21, "zip"), ("ambiguous-column", 2, 6, 7, "b"),
        ("unknown-field", 2, 16, 21, "u.s.q"), ("wrong-arity", 2, 30, 39, "abs(1, 2)"), ("wrong-argument-type", 2, 48, 68, "array_contains(a, 1)"),
    ]
    assert [(r.kind, r.fragment) for r in analysis.diagnostics(small, "SELECT k.z, a, qq FROM missing k JOIN t ON k.i = t.a").collect()][-1] == ("unknown-table", "missing")
    assert "ambiguous-table" in {r.kind for r in analysis.diagnostics(small, "SELECT 1 FROM t JOIN t").collect()}
    assert [r.kind for r in analysis.diagnostics(small, "SELEC a").collect()] == ["syntax"]
    assert analysis.diagnostics(small, "WITH c AS (SELECT a FROM t) SELECT a FROM c").count() == 0


def test_scopes_stars_and_everything(small):
    sql = "WITH c AS (SELECT * FROM t) SELECT c.*, d.x, 1 AS one FROM c JOIN (SELECT * FROM u) d ON c.b = d.b WHERE c.a IN (SELECT b FROM u)"
    assert [tuple(r) for r in analysis.scopes(small, sql).collect()] == [(0, None, "with", "c", None), (1, 0, "table", "t", "t"), (0, None, "cte", "c", None), (0, None, "subquery", "d", None), (2, 0, "table", "u", "u"), (3, 0, "table", "u", "u")]
    assert [tuple(r)[1:] for r in analysis.expand_star(small, sql).collect()] == [("a", "t", "a"), ("b", "t", "b"), ("c1", "t", "c1"), ("arr", "t", "arr"), ("x", "u", "x"), ("one", None, None)]
    whole = analysis.analyze(small, "SELECT a[1] AS f FROM (SELECT arr AS a FROM t)", "duckdb")
    assert whole["types"].first().type == "int" and whole["lineage"].first().source_column == "arr"
    assert set(analysis.analyze(small, "SELEC 1")) == {"diagnostics"}


def test_statements_are_classed(spark):
    of = {"SELECT 1": "query", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a": "dml", "(SELECT 1)": "query", "CREATE VIEW v AS SELECT 1": "ddl", "GRANT SELECT ON t TO x": "dcl", "BEGIN TRANSACTION": "tcl", "BEGIN SELECT 1; END": "compound", "SHOW TABLES": "utility", "": "other", "SELECT 1; SELECT 2": "compound"}
    assert {q: statements.category(q) for q in of} == of
    assert [(r.category, r.kind) for r in statements.classes(spark, "SELECT 1; GRANT x ON t TO y; DELETE FROM t", "postgres").collect()] == [("query", "query"), ("dcl", "other"), ("dml", "dml")]


def test_changes_as_text(spark):
    spark.createDataFrame([(1, 10, "a"), (2, 20, "b"), (None, 30, "c")], "k int, v int, s string").createOrReplaceTempView("tt")
    spark.createDataFrame([(1, 5), (3, 7)], "k int, d int").createOrReplaceTempView("dd")
    rows = lambda sql, dialect="spark": {tuple(r) for r in statements.change(spark, sql, dialect)[1].collect()}
    assert rows("UPDATE tt SET v = v / 3, s = upper(s) WHERE k = 2", "postgres") == {(1, 10, "a"), (2, 6, "B"), (None, 30, "c")}
    assert rows("UPDATE tt SET v = tt.v + dd.d FROM dd WHERE tt.k = dd.k AND dd.d > 1", "postgres") == {(1, 15, "a"), (2, 20, "b"), (None, 30, "c")}
    assert rows("DELETE FROM tt AS x WHERE x.k IN (SELECT k FROM dd)") == {(2, 20, "b"), (None, 30, "c")}
    assert rows("DELETE FROM tt USING dd WHERE tt.k = dd.k", "postgres") == {(2, 20, "b"), (None, 30, "c")}
    assert (9, None, "z") in rows("INSERT INTO tt (s, k) VALUES ('z', 9)") and len(rows("INSERT INTO tt BY NAME SELECT 'q' AS s, 4 AS k", "duckdb")) == 4
    assert rows("INSERT OVERWRITE TABLE tt SELECT 1, 2, 'x'") == {(1, 2, "x")}
    assert rows("MERGE INTO tt AS a USING (SELECT * FROM dd) AS b ON a.k = b.k WHEN MATCHED AND b.d > 6 THEN DELETE WHEN MATCHED THEN UPDATE SET v = a.v + b.d WHEN NOT MATCHED THEN INSERT (k, v) VALUES (b.k, b.d * 2) WHEN NOT MATCHED BY SOURCE AND a.k = 2 THEN DELETE", "tsql") == {(1, 15, "a"), (3, 14, None), (None, 30, "c")}
    assert statements.change(spark, "CREATE TABLE made AS (SELECT TOP 1 k FROM tt ORDER BY v)", "tsql")[0] == "made" and rows("CREATE TABLE made AS SELECT k FROM tt WHERE k = 2") == {(2,)}
    with pytest.raises(ValueError, match="equal columns"):
        rows("MERGE INTO tt USING dd ON tt.k < dd.k WHEN MATCHED THEN DELETE")


def test_files_by_extension(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    for fmt in ("parquet", "orc", "json", "csv"):
        tables.save(df, f"{tmp_path}/t.{fmt}", fmt, header="true")
        assert tables.file_scan(spark, f"{tmp_path}/t.{fmt}", "k int, s string").count() == 2
    spark.createDataFrame([(1,), (2,)], "k int").write.parquet(f"{tmp_path}/f.parquet")
    assert dialects.run(spark, f"SELECT sum(k) AS s FROM '{tmp_path}/f.parquet' JOIN read_parquet('{tmp_path}/f.parquet') USING (k)", "duckdb").first().s == 3
    with pytest.raises(ValueError, match="no reader"):
        tables.file_scan(spark, "x.unknown")
    assert shape.star(df, ilike="K").columns == ["k"]
