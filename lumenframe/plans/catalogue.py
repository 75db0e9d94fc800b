"""The catalogue: one query per operator, and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import joins, relations, shape
from ..operators.pipe import Pipe
from ..sources.tables import table, views
from . import dialects

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, read) under its name, with its SQL."""

    def add(make):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return make(spark, lambda name: table(spark, sf_dir, name))

        QUERIES[make.__name__] = run
        if sql is not None:
            ORACLE_SQL[make.__name__] = sql
        return make

    return add


def same(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """Registers SQL that Spark runs, and DuckDB too unless ``oracle`` is given."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables.split())
        return spark.sql(sql)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql


# Aggregation
same("agg_q1", "lineitem", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")
same("agg_having", "lineitem", "SELECT l_suppkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_suppkey HAVING count(*) > 50")
same("agg_filter", "lineitem", "SELECT l_linestatus, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, round(sum(l_quantity) FILTER (WHERE l_discount > 0.05), 2) AS discounted FROM lineitem GROUP BY l_linestatus")
same("agg_distinct", "lineitem", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, round(sum(DISTINCT l_quantity), 2) AS q FROM lineitem GROUP BY l_returnflag")
same("agg_percentile", "lineitem", "SELECT l_returnflag, round(percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p25, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS d50 FROM lineitem GROUP BY l_returnflag",
     "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, quantile_disc(l_quantity, 0.5) AS d50 FROM lineitem GROUP BY l_returnflag")
same("agg_median", "lineitem", "SELECT l_linestatus, round(median(l_extendedprice), 4) AS m FROM lineitem GROUP BY l_linestatus")
same("agg_mode", "lineitem", "SELECT l_returnflag, max_by(l_shipmonth, struct(n, l_shipmonth)) AS top_month FROM (SELECT l_returnflag, month(l_shipdate) AS l_shipmonth, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY l_returnflag",
     "SELECT l_returnflag, max_by(m, n * 100 + m) AS top_month FROM (SELECT l_returnflag, CAST(month(l_shipdate) AS INTEGER) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY l_returnflag")
same("agg_stats", "lineitem", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 5) AS vp, round(avg(l_tax), 8) AS a, round(stddev_pop(l_tax), 8) AS sp, round(var_samp(l_discount), 8) AS vs FROM lineitem GROUP BY l_returnflag")
same("agg_corr", "lineitem", "SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cp FROM lineitem GROUP BY l_linestatus")
same("agg_regr", "lineitem", "SELECT l_linestatus, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity) AS n FROM lineitem GROUP BY l_linestatus")
same("agg_listagg", "nation region", "SELECT r_name, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
     "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
same("agg_collect", "nation", "SELECT n_regionkey, sort_array(collect_list(n_name)) AS names, array_size(collect_set(n_nationkey)) AS n FROM nation GROUP BY n_regionkey",
     "SELECT n_regionkey, list(n_name ORDER BY n_name) AS names, CAST(len(list(DISTINCT n_nationkey)) AS INTEGER) AS n FROM nation GROUP BY n_regionkey")
same("agg_map", "nation region", "SELECT r_name, array_join(transform(array_sort(map_entries(map_from_entries(collect_list(struct(n_nationkey, n_name))))), e -> concat(e.key, '=', e.value)), ';') AS m FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
     "SELECT r_name, string_agg(n_nationkey || '=' || n_name, ';' ORDER BY n_nationkey) AS m FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
same("agg_histogram", "orders", "SELECT CAST(floor(o_totalprice / 10000) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
same("agg_max_by", "orders", "SELECT o_orderstatus, max_by(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS k, min_by(o_orderkey, o_totalprice * 1000000 + o_orderkey) AS lo FROM orders GROUP BY o_orderstatus")
same("agg_bool", "orders", "SELECT o_orderpriority, bool_and(o_totalprice > 0) AS all_pos, bool_or(o_orderstatus = 'P') AS any_p FROM orders GROUP BY o_orderpriority")
same("agg_bit", "orders", "SELECT o_orderpriority, bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o, bit_xor(o_orderkey) AS x FROM orders GROUP BY o_orderpriority")
same("group_rollup", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
same("group_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same("group_sets", "lineitem", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
same("grouping_id", "lineitem", "SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
same("group_all", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")


@query()
def approx_count_distinct(spark, read):
    return read("lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query()
def approx_percentile(spark, read):
    return read("lineitem").groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", [0.1, 0.5, 0.9], 1000).alias("p"))


@query()
def sketches(spark, read):
    sketch = read("lineitem").groupBy("l_returnflag").agg(F.hll_sketch_agg("l_partkey").alias("s"))
    return sketch.agg(F.hll_sketch_estimate(F.hll_union_agg("s")).alias("parts"))


# Projection and predicates
same("scan_projection", "orders", "SELECT o_orderkey, o_totalprice * 2 AS twice, upper(o_orderstatus) AS st FROM orders")
same("filter_predicates", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderstatus IN ('O', 'F') AND o_orderpriority LIKE '%-%' AND o_orderdate IS NOT NULL AND NOT (o_orderkey IS NOT DISTINCT FROM 7)")
same("filter_like_any", "part", "SELECT p_partkey FROM part WHERE p_name LIKE ANY ('%a%e%', 'b%') AND p_type ILIKE '%E%' AND p_brand RLIKE '[0-9]$'",
     "SELECT p_partkey FROM part WHERE (p_name LIKE '%a%e%' OR p_name LIKE 'b%') AND p_type ILIKE '%E%' AND regexp_matches(p_brand, '[0-9]$')")
same("alias_lateral", "orders", "SELECT o_orderkey, o_totalprice AS p, round(p * 0.5, 3) AS half FROM orders")
same("distinct_rows", "orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
same("from_first", "region", "FROM region SELECT r_regionkey, r_name")
same("cond_case", "lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 20 THEN 'mid' ELSE 'small' END AS c FROM lineitem")
same("cond_nullif", "lineitem", "SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'N') AS r, coalesce(nullif(l_linestatus, 'O'), '-') AS s, greatest(l_tax, l_discount) AS g FROM lineitem")
same("cond_decode", "orders", "SELECT o_orderkey, decode(o_orderstatus, 'O', 'open', 'F', 'done', 'other') AS s, if(o_totalprice > 50000, 1, 0) AS b FROM orders",
     "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS s, CASE WHEN o_totalprice > 50000 THEN 1 ELSE 0 END AS b FROM orders")
same("cond_div0", "lineitem", "SELECT l_orderkey, l_linenumber, try_divide(l_quantity, l_linenumber - 1) AS q FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN l_quantity / (l_linenumber - 1) END AS q FROM lineitem")


@query("SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer")
def star_exclude(spark, read):
    return shape.star(read("customer"), exclude=["c_acctbal", "c_mktsegment"])


@query("SELECT * REPLACE (upper(c_name) AS c_name) FROM customer")
def star_replace(spark, read):
    return shape.star(read("customer"), replace={"c_name": F.upper("c_name")})


@query("SELECT * RENAME (c_name AS customer_name) FROM customer")
def star_rename(spark, read):
    return shape.star(read("customer"), rename={"c_name": "customer_name"})


@query("SELECT c_custkey, c_nationkey FROM customer")
def star_ilike(spark, read):
    return shape.star(read("customer"), ilike="%KEY")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(spark, read):
    return shape.distinct_on(read("orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def qualify_top1(spark, read):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return shape.qualify(read("orders").select("o_orderkey", "o_custkey", "o_orderdate"), F.row_number().over(w) == 1).drop("o_orderdate")


# Joins
same("join_inner", "customer orders", "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
same("join_left", "customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
same("join_right", "customer orders", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
same("join_full", "nation supplier", "SELECT n_nationkey, s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey < 12) n FULL JOIN supplier ON n_nationkey = s_nationkey")
same("join_cross", "nation region", "SELECT n_name, r_name FROM nation CROSS JOIN region")
same("join_semi", "customer orders", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
same("join_anti", "customer orders", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
same("join_using", "lineitem", "SELECT l_orderkey, a.n AS n, b.q AS q FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) a JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) b USING (l_orderkey)")
same("join_natural", "nation region", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")


@query("SELECT a.p_partkey AS x, b.p_partkey AS y FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size < b.p_size AND a.p_retailprice > b.p_retailprice")
def join_theta(spark, read):
    a, b = (read("part").select("p_brand", *(F.col(c).alias(f"{side}_{c}") for c in ("p_partkey", "p_size", "p_retailprice"))) for side in "ab")
    pairs = joins.less_join(a, b, ["p_brand"], "a_p_size", "b_p_size", "a_p_retailprice", "b_p_retailprice")
    return pairs.select(F.col("a_p_partkey").alias("x"), F.col("b_p_partkey").alias("y"))


same("join_nested", "customer orders nation", "SELECT n_name, c_custkey, o_orderkey FROM nation LEFT JOIN (customer JOIN orders ON c_custkey = o_custkey) ON n_nationkey = c_nationkey")
same("join_chain", "customer orders lineitem nation region", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
same("subq_scalar", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
same("subq_in", "orders customer", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
same("subq_not_in", "orders customer", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
same("subq_exists", "orders customer", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
same("subq_correlated", "orders", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.8 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
SPLIT = "(SELECT user_id, ts, event_id, value FROM events WHERE event_id % 3 = 0)", "(SELECT user_id, ts, max(value) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY user_id, ts)"


def _asof_sides(read):
    e = read("events")
    left = e.filter("event_id % 3 = 0").select("user_id", "ts", "event_id")
    return left, e.filter("event_id % 3 <> 0").groupBy("user_id", "ts").agg(F.max("value").alias("v"))


@query(f"SELECT a.user_id, a.event_id, b.v FROM {SPLIT[0]} a ASOF JOIN {SPLIT[1]} b ON a.user_id = b.user_id AND a.ts >= b.ts")
def join_asof(spark, read):
    return joins.asof_join(*_asof_sides(read), "ts", ["user_id"]).select("user_id", "event_id", "v")


@query(f"SELECT a.user_id, a.event_id, b.v FROM {SPLIT[0]} a ASOF LEFT JOIN {SPLIT[1]} b ON a.user_id = b.user_id AND a.ts > b.ts")
def join_asof_left(spark, read):
    return joins.asof_join(*_asof_sides(read), "ts", ["user_id"], how="left", strict=True).select("user_id", "event_id", "v")


@query("SELECT n_name, r_name FROM (SELECT * FROM nation ORDER BY n_name DESC) POSITIONAL JOIN (SELECT * FROM region ORDER BY r_name)")
def join_positional(spark, read):
    return joins.positional_join(read("nation"), read("region"), [F.desc("n_name")], [F.asc("r_name")]).select("n_name", "r_name")


@query("SELECT p_partkey, lo FROM part JOIN (SELECT CAST(range * 40 + 900 AS DOUBLE) AS lo, CAST(range * 40 + 970 AS DOUBLE) AS hi FROM range(30)) ON p_retailprice BETWEEN lo AND hi")
def join_range(spark, read):
    ranges = spark.range(30).select((F.col("id") * 40 + 900).cast("double").alias("lo"), (F.col("id") * 40 + 970).cast("double").alias("hi"))
    return joins.range_join(read("part"), ranges, "p_retailprice", "lo", "hi", 70).select("p_partkey", "lo")


TOP2 = "(SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)"


@query(f"SELECT c_custkey, o_orderkey FROM customer, LATERAL {TOP2} t")
def apply_cross(spark, read):
    return joins.apply_top(read("customer"), read("orders"), "c_custkey", "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 2).select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey, o_orderkey FROM customer LEFT JOIN LATERAL {TOP2} t ON true")
def apply_outer(spark, read):
    return joins.apply_top(read("customer"), read("orders"), "c_custkey", "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 2, outer=True).select("c_custkey", "o_orderkey")


same("join_lateral", "customer orders", f"SELECT c_custkey, n, m FROM customer, LATERAL (SELECT count(*) AS n, max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) t")

# Windows
same("win_rank", "orders", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
same("win_ntile", "orders", "SELECT o_orderkey, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS q FROM orders")
same("win_percent_rank", "orders", "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 8) AS pr, round(cume_dist() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice), 8) AS cd FROM orders")
same("win_lag_lead", "orders", "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS a, lead(o_orderkey, 2, -1) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS a, lead(o_orderkey, 2, -1) OVER w AS b FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
same("win_first_last_nth", "orders", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
same("win_rows", "events", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 3) AS s FROM events")
same("win_range", "events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
same("win_named", "lineitem", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER w, 2) AS s, count(*) OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
same("win_ignore_nulls", "orders", "SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM orders",
     "SELECT o_orderkey, last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM orders")


@query("SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS s FROM orders")
def win_groups(spark, read):
    return shape.groups_frame(read("orders"), F.sum("o_orderkey"), ["o_custkey"], F.col("o_orderpriority"), -1, 0, "s").select("o_orderkey", "s")


@query("SELECT o_orderkey, sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW)::BIGINT AS s FROM orders")
def win_exclude(spark, read):
    return shape.sum_excluding_current(read("orders"), "o_orderkey", ["o_custkey"], ["o_orderdate", "o_orderkey"], -1, 1, "s").select("o_orderkey", "s")


same("order_by_all", "region", "SELECT r_name, r_regionkey FROM region ORDER BY ALL")
same("table_shorthand", "region", "SELECT r_regionkey, r_name FROM region UNION ALL TABLE region", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
same("cluster_by", "orders", "SELECT o_orderkey FROM (SELECT /*+ REPARTITION(3) */ o_orderkey, o_custkey FROM orders DISTRIBUTE BY o_custkey SORT BY o_orderkey)", "SELECT o_orderkey FROM orders")
same("join_hints", "orders customer", "SELECT /*+ SHUFFLE_HASH(c) */ o_orderkey, c_name FROM orders o JOIN customer c ON o_custkey = c_custkey", "SELECT o_orderkey, c_name FROM orders o JOIN customer c ON o_custkey = c_custkey")
same("lateral_view_outer", "nation", "SELECT n_nationkey, x FROM nation LATERAL VIEW OUTER explode(CASE WHEN n_nationkey % 2 = 0 THEN array(1, 2) END) t AS x", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN i END AS x FROM nation, (SELECT unnest([1, 2]) AS i) WHERE n_nationkey % 2 = 0 OR i = 1")
same("predicate_truth", "orders", "SELECT o_orderkey, (nullif(o_orderstatus, 'P') = 'O') IS TRUE AS t, (nullif(o_orderstatus, 'P') = 'O') IS NOT FALSE AS f, (nullif(o_orderstatus, 'P') = 'O') IS UNKNOWN AS u FROM orders",
     "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P') = 'O', false) AS t, coalesce(nullif(o_orderstatus, 'P') = 'O', true) AS f, (nullif(o_orderstatus, 'P') = 'O') IS NULL AS u FROM orders")
same("like_all", "part", "SELECT p_partkey FROM part WHERE p_name LIKE ALL ('%a%', '%e%') AND p_type NOT LIKE ALL ('%x%', '%y%')", "SELECT p_partkey FROM part WHERE p_name LIKE '%a%' AND p_name LIKE '%e%' AND p_type NOT LIKE '%x%' AND p_type NOT LIKE '%y%'")
same("tvf_range", "", "SELECT id * 2 AS x FROM range(5, 25, 4)", "SELECT CAST(range * 2 AS BIGINT) AS x FROM range(5, 25, 4)")
same("str_hashes", "customer", "SELECT c_custkey, sha1(c_name) AS s1, sha2(c_name, 512) IS NOT NULL AS ok, crc32(encode(c_name, 'UTF-8')) >= 0 AS c FROM customer", "SELECT c_custkey, sha1(c_name) AS s1, true AS ok, true AS c FROM customer")
same("csv_functions", "nation", "SELECT n_nationkey, from_csv(concat_ws(',', n_nationkey, n_name), 'a INT, b STRING').b AS b, to_csv(named_struct('a', n_nationkey, 'b', n_name)) AS t FROM nation", "SELECT n_nationkey, n_name AS b, n_nationkey || ',' || n_name AS t FROM nation")
same("xml_functions", "nation", "SELECT n_nationkey, xpath_string(concat('<a><b>', n_name, '</b></a>'), 'a/b') AS b, xpath_int(concat('<a><b>', n_nationkey, '</b></a>'), 'a/b') AS i, from_xml(concat('<r><k>', n_nationkey, '</k></r>'), 'k INT').k AS k FROM nation", "SELECT n_nationkey, n_name AS b, n_nationkey AS i, n_nationkey AS k FROM nation")
same("json_types", "events", "SELECT event_id, json_array_length(concat('[', user_id, ',1]')) AS n, array_join(json_object_keys(to_json(named_struct('u', user_id, 't', event_type))), ',') AS k, schema_of_variant(parse_json(to_json(named_struct('u', user_id % 2 = 0)))) AS s FROM events",
     "SELECT event_id, 2 AS n, 'u,t' AS k, 'OBJECT<u: BOOLEAN>' AS s FROM events")
same("window_time_q", "events", "SELECT window_time(w) AS t, n FROM (SELECT window AS w, count(*) AS n FROM events GROUP BY window(ts, '1 hour'))", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) + INTERVAL '3599.999999' SECOND AS t, count(*) AS n FROM events GROUP BY 1")
same("named_arguments", "nation", "SELECT n_nationkey, mask(str => n_name, lowerChar => 'l', upperChar => 'U', digitChar => NULL) AS m FROM nation", "SELECT n_nationkey, regexp_replace(regexp_replace(n_name, '[a-z]', 'l', 'g'), '[A-Z]', 'U', 'g') AS m FROM nation")
same("url_functions", "customer", "SELECT c_custkey, url_encode(c_name) AS e, url_decode(url_encode(c_name)) AS d FROM customer", "SELECT c_custkey, url_encode(c_name) AS e, c_name AS d FROM customer")

# Limits
same("topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10")
same("limit_offset", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")


@query("SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC NULLS LAST) <= 7")
def top_with_ties(spark, read):
    return shape.top_with_ties(read("part").select("p_partkey", "p_size"), 7, ["-p_size"])


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= ceil(count(*) OVER () * 5 / 100.0)")
def top_percent(spark, read):
    return shape.top_percent(read("orders"), 5, [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey")


# Set operations
A, B = "(SELECT n_nationkey % 7 AS k FROM nation)", "(SELECT s_nationkey % 5 + 3 AS k FROM supplier)"
for _name, _op in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    same(_name, "nation supplier", f"SELECT k FROM {A} a {_op} SELECT k FROM {B} b")
same("setop_precedence", "nation supplier", f"SELECT k FROM {A} a UNION SELECT k FROM {B} b INTERSECT SELECT r_k AS k FROM (SELECT s_nationkey AS r_k FROM supplier) c")


@query("SELECT n_nationkey AS k, n_name FROM nation UNION ALL BY NAME SELECT r_name, r_regionkey AS k FROM region")
def union_by_name(spark, read):
    return shape.union_by_name(read("nation").select(F.col("n_nationkey").alias("k"), "n_name"), read("region").select("r_name", F.col("r_regionkey").alias("k")))


# Reshape
@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders GROUP BY o_custkey")
def pivot_static(spark, read):
    wide = shape.pivot(read("orders"), ["o_custkey"], "o_orderstatus", ["O", "F"], F.count(F.lit(1)))
    return wide.select("o_custkey", F.coalesce("O", F.lit(0)).alias("o"), F.coalesce("F", F.lit(0)).alias("f"))


@query("SELECT o_orderpriority, round(max(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS F, round(max(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS O, round(max(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY o_orderpriority")
def pivot_dynamic(spark, read):
    return shape.pivot(read("orders"), ["o_orderpriority"], "o_orderstatus", None, F.round(F.max("o_totalprice"), 2))


@query("SELECT p_partkey, name, value FROM (SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 10 THEN p_type END AS p_type FROM part) UNPIVOT (value FOR name IN (p_name, p_brand, p_type))")
def unpivot(spark, read):
    p = read("part").select("p_partkey", "p_name", "p_brand", F.when(F.col("p_size") > 10, F.col("p_type")).alias("p_type"))
    return shape.unpivot(p, ["p_partkey"], ["p_name", "p_brand", "p_type"], "name", "value")


@query("SELECT p_partkey, name, value FROM (SELECT p_partkey, p_name, CASE WHEN p_size > 10 THEN p_type END AS p_type FROM part) UNPIVOT INCLUDE NULLS (value FOR name IN (p_name, p_type))")
def unpivot_nulls(spark, read):
    p = read("part").select("p_partkey", "p_name", F.when(F.col("p_size") > 10, F.col("p_type")).alias("p_type"))
    return shape.unpivot(p, ["p_partkey"], ["p_name", "p_type"], "name", "value", nulls=True)


# Pipe stages
@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey HAVING count(*) > 3 ORDER BY s DESC, o_custkey LIMIT 15")
def pipe_chain(spark, read):
    p = Pipe(read("orders")).where("o_orderstatus <> 'P'").aggregate(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s"), group_by=["o_custkey"])
    return p.where("n > 3").order_by(F.desc("s"), "o_custkey").limit(15).df


@query("SELECT o_orderkey AS k, o_custkey, round(o_totalprice * 2, 3) AS o_totalprice, o_orderkey + 1 AS nxt FROM orders")
def pipe_extend_set_drop_rename(spark, read):
    p = Pipe(read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")).extend(nxt=F.col("o_orderkey") + 1)
    return p.set(o_totalprice=F.round(F.col("o_totalprice") * 2, 3)).drop("o_orderstatus").rename(o_orderkey="k").df


@query("SELECT o_orderstatus, max(o_totalprice) AS m FROM orders GROUP BY o_orderstatus")
def pipe_aggregate(spark, read):
    return Pipe(read("orders")).aggregate(F.max("o_totalprice").alias("m"), group_by=["o_orderstatus"]).df


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def pipe_join(spark, read):
    return Pipe(read("orders")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name").df


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders")
def pipe_window(spark, read):
    return Pipe(read("orders")).window(rn=F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))).select("o_orderkey", "rn").df


@query("SELECT DISTINCT o_orderstatus FROM orders")
def pipe_distinct(spark, read):
    return Pipe(read("orders")).select("o_orderstatus").distinct().df


# Sources and hierarchies
same("values_inline", "", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (2, 'y')) AS t(a, b)")
same("cte_chain", "orders", "WITH a(k, p) AS (SELECT o_custkey, o_totalprice FROM orders), b AS (SELECT k, max(p) AS m FROM a GROUP BY k) SELECT k, m FROM b WHERE m > 1000")
same("cte_recursive", "", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 12) SELECT n, f FROM t")
TREE = "(SELECT n_nationkey AS id, CASE WHEN n_nationkey < 2 THEN NULL ELSE n_nationkey // 2 END AS boss FROM nation)"


@query(f"WITH RECURSIVE h AS (SELECT id, 1 AS level FROM {TREE} a WHERE boss IS NULL UNION ALL SELECT c.id, h.level + 1 FROM {TREE} c JOIN h ON c.boss = h.id) SELECT id, level FROM h")
def hierarchy_connect_by(spark, read):
    tree = read("nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") >= 2, F.floor(F.col("n_nationkey") / 2).cast("int")).alias("boss"))
    return relations.connect_by(tree, "id", "boss", F.col("boss").isNull()).select("id", "level")


same("unnest_array", "embeddings", "SELECT vec_id, explode(embedding) AS v FROM embeddings", "SELECT vec_id, unnest(embedding) AS v FROM embeddings")
same("unnest_ordinality", "embeddings", "SELECT vec_id, pos, col AS v FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, col", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, embedding[i] AS v FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS index, l[i] AS value, '[' || (i - 1) || ']' AS path FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))")
def flatten(spark, read):
    return shape.flatten(read("documents"), F.split("text", "\n")).select("doc_id", "index", "value", "path")


@query("SELECT event_id, CAST(i AS BIGINT) AS i, 'u' || user_id AS u FROM events, (SELECT unnest([1, 2]) AS i)")
def json_table(spark, read):
    e = read("events").select("event_id", F.to_json(F.array(*(F.struct(F.lit(i).alias("i"), F.concat(F.lit("u"), "user_id").alias("u")) for i in (1, 2)))).alias("j"))
    return shape.json_table(e, "j", "i: long, u: string").drop("j")


@query()
def sample_rows(spark, read):
    return read("lineitem").sample(0.1, seed=3).select("l_orderkey", "l_linenumber")


# Scalar functions
same("str_case", "customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, concat(c_name, '-', c_mktsegment) AS c, reverse(c_name) AS r FROM customer")
same("str_pad_trim", "customer", "SELECT c_custkey, lpad(c_mktsegment, 14, '*') AS a, rpad(c_mktsegment, 3, '.') AS b, trim(concat('  ', c_name, ' ')) AS t, substring(c_name, 3, 4) AS s, repeat('ab', 2) AS r, replace(c_name, '0', 'o') AS p FROM customer")
same("str_split", "customer", "SELECT c_custkey, split_part(c_name, '#', 2) AS p, instr(c_name, '#') AS i, left(c_name, 3) AS a, right(c_name, 2) AS b, ascii(c_name) AS x FROM customer", "SELECT c_custkey, split_part(c_name, '#', 2) AS p, instr(c_name, '#') AS i, left(c_name, 3) AS a, right(c_name, 2) AS b, ascii(c_name) AS x FROM customer")
same("str_regex", "part", "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS e, regexp_like(p_type, '^[A-Z]') AS m FROM part",
     "SELECT p_partkey, regexp_replace(p_brand, '[0-9]+', '#', 'g') AS r, regexp_extract(p_brand, '([0-9]+)', 1) AS e, regexp_matches(p_type, '^[A-Z]') AS m FROM part")
same("str_distance", "nation", "SELECT a.n_name AS x, b.n_name AS y, levenshtein(a.n_name, b.n_name) AS d FROM nation a CROSS JOIN nation b", "SELECT a.n_name AS x, b.n_name AS y, levenshtein(a.n_name, b.n_name) AS d FROM nation a CROSS JOIN nation b")
same("str_hash", "documents", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM documents", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
same("date_parts", "orders", "SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, day(o_orderdate) AS d, dayofyear(o_orderdate) AS dy, weekofyear(o_orderdate) AS w FROM orders")
same("date_trunc", "orders", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, date_trunc('year', o_orderdate) AS y FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_trunc('year', o_orderdate) AS TIMESTAMP) AS y FROM orders")
same("date_diff", "orders", "SELECT o_orderkey, datediff(CAST(o_orderdate AS DATE), DATE '1995-01-01') AS d, CAST(floor(months_between(date_trunc('month', o_orderdate), TIMESTAMP '1995-01-01 00:00:00')) AS BIGINT) AS m FROM orders",
     "SELECT o_orderkey, CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS d, date_diff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS m FROM orders")
same("date_arith", "orders", "SELECT o_orderkey, o_orderdate + INTERVAL '3' DAY AS a, add_months(CAST(o_orderdate AS DATE), 1) AS b, last_day(CAST(o_orderdate AS DATE)) AS l FROM orders",
     "SELECT o_orderkey, o_orderdate + INTERVAL '3' DAY AS a, CAST(CAST(o_orderdate AS DATE) + INTERVAL '1' MONTH AS DATE) AS b, last_day(CAST(o_orderdate AS DATE)) AS l FROM orders")
same("date_format", "orders", "SELECT o_orderkey, date_format(o_orderdate, 'yyyy/MM/dd HH:mm') AS f, unix_timestamp(o_orderdate) AS u FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M') AS f, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS u FROM orders")
same("math_basic", "lineitem", "SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, round(sqrt(l_quantity), 8) AS s, round(power(l_quantity, 1.5), 5) AS p, round(ln(l_extendedprice), 8) AS n, round(exp(l_tax), 8) AS e, sign(l_discount - 0.05) AS g FROM lineitem")
same("math_trig", "lineitem", "SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 8) AS a, round(cos(l_quantity), 8) AS b, round(atan2(l_tax, l_quantity), 8) AS c, round(degrees(l_tax), 8) AS d, round(radians(l_quantity), 8) AS r FROM lineitem")
same("math_round", "lineitem", "SELECT l_orderkey, l_linenumber, CAST(ceil(l_extendedprice) AS BIGINT) AS c, CAST(floor(l_extendedprice) AS BIGINT) AS f, round(l_extendedprice, 0) AS r, mod(l_orderkey, 7) AS m FROM lineitem")
same("math_bit", "lineitem", "SELECT l_orderkey, l_linenumber, l_orderkey & 15 AS a, l_orderkey | 8 AS o, CAST(bit_count(l_orderkey) AS INTEGER) AS n FROM lineitem")
same("arr_basic", "embeddings", "SELECT vec_id, size(embedding) AS n, array_max(embedding) AS mx, embedding[0] AS f, element_at(embedding, -1) AS l, array_contains(embedding, embedding[3]) AS c FROM embeddings",
     "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, list_max(embedding) AS mx, embedding[1] AS f, embedding[-1] AS l, list_contains(embedding, embedding[4]) AS c FROM embeddings")
same("arr_lambda", "embeddings", "SELECT vec_id, size(filter(embedding, x -> x > 0)) AS p, round(aggregate(transform(embedding, x -> CAST(x AS DOUBLE) * 2), 0D, (a, x) -> a + x), 5) AS s, exists(embedding, x -> x > 0.5) AS e FROM embeddings",
     "SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS p, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)), 5) AS s, len(list_filter(embedding, lambda x: x > 0.5)) > 0 AS e FROM embeddings")
same("arr_set", "nation", "SELECT n_nationkey, array_sort(array_distinct(array(n_regionkey, 1, 1))) AS d, array_sort(array_union(array(n_regionkey), array(2, 3))) AS u, array_sort(array_except(array(1, 2, 3), array(n_regionkey))) AS e FROM nation",
     "SELECT n_nationkey, list_sort(list_distinct([n_regionkey, 1, 1])) AS d, list_sort(list_distinct([n_regionkey, 2, 3])) AS u, list_sort(list_filter([1, 2, 3], lambda x: x <> n_regionkey)) AS e FROM nation")
same("arr_slice", "embeddings", "SELECT vec_id, slice(embedding, 2, 3) AS s, flatten(array(array(1), array(2, 3))) AS f FROM embeddings", "SELECT vec_id, embedding[2:4] AS s, flatten([[1], [2, 3]]) AS f FROM embeddings")
same("map_basic", "nation", "SELECT n_nationkey, map('a', n_regionkey, 'b', 2)['a'] AS a, size(map_keys(map('a', 1, 'b', 2))) AS n, element_at(map('k', n_name), 'k') AS v FROM nation",
     "SELECT n_nationkey, MAP {'a': n_regionkey, 'b': 2}['a'] AS a, CAST(len(map_keys(MAP {'a': 1, 'b': 2})) AS INTEGER) AS n, MAP {'k': n_name}['k'] AS v FROM nation")
same("struct_basic", "nation", "SELECT n_nationkey, s.a AS a, s.b AS b FROM (SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey + 1) AS s FROM nation)", "SELECT n_nationkey, s.a AS a, s.b AS b FROM (SELECT n_nationkey, struct_pack(a := n_name, b := n_regionkey + 1) AS s FROM nation)")
same("json_extract", "events", "SELECT event_id, get_json_object(j, '$.u') AS u, get_json_object(j, '$.n.v') AS v FROM (SELECT event_id, to_json(named_struct('u', user_id, 'n', named_struct('v', event_type))) AS j FROM events)",
     "SELECT event_id, json_extract_string(j, '$.u') AS u, json_extract_string(j, '$.n.v') AS v FROM (SELECT event_id, json_object('u', user_id, 'n', json_object('v', event_type)) AS j FROM events)")
same("variant_get", "events", "SELECT event_id, variant_get(parse_json(j), '$.u', 'bigint') AS u FROM (SELECT event_id, to_json(named_struct('u', user_id)) AS j FROM events)", "SELECT event_id, user_id AS u FROM events")
DOT = "aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * y), 0D, (s, x) -> s + x)"
same("vec_dot", "embeddings", f"SELECT a.vec_id AS x, round({DOT}, 4) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "SELECT a.vec_id AS x, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
NORM = "sqrt(aggregate({0}.embedding, 0D, (s, x) -> s + CAST(x AS DOUBLE) * x))"
same("vec_cosine", "embeddings", f"SELECT a.vec_id AS x, round({DOT} / ({NORM.format('a')} * {NORM.format('b')}), 4) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "SELECT a.vec_id AS x, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
same("vec_l2", "embeddings", "SELECT a.vec_id AS x, round(sqrt(aggregate(zip_with(a.embedding, b.embedding, (x, y) -> (CAST(x AS DOUBLE) - y) * (CAST(x AS DOUBLE) - y)), 0D, (s, x) -> s + x)), 4) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1", "SELECT a.vec_id AS x, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
same("url_parse", "pages", "SELECT page_id, parse_url(url, 'PROTOCOL') AS p, parse_url(url, 'HOST') AS h FROM pages", "SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS p, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS h FROM pages")

# Events over time, in their batch form
same("ev_tumbling", "events", "SELECT window.start AS w, event_type, count(*) AS n, round(sum(value), 3) AS s FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS TIMESTAMP) AS w, event_type, count(*) AS n, round(sum(value), 3) AS s FROM events GROUP BY 1, 2")
same("ev_sliding", "events", "SELECT window.start AS w, count(*) AS n FROM events GROUP BY window(ts, '1 hour', '30 minutes')", "SELECT w, count(*) AS n FROM (SELECT CAST(unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS TIMESTAMP) AS w FROM events) GROUP BY w")
same("ev_session", "events", "SELECT user_id, session_window.start AS a, session_window.end AS b, count(*) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')",
     "SELECT user_id, min(ts) AS a, max(ts) + INTERVAL '30 minutes' AS b, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL '30 minutes' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events)) GROUP BY user_id, s")
same("ev_bucket", "events", "SELECT date_trunc('day', ts) AS d, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS d, count(*) AS n, count(DISTINCT user_id) AS u FROM events GROUP BY 1")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def ev_dedup(spark, read):
    return shape.distinct_on(read("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


# Row patterns, graphs, changes
@query("""WITH l AS (SELECT user_id, event_id, ts, CASE WHEN value < lag(value) OVER w THEN 'D' WHEN value > lag(value) OVER w THEN 'U' ELSE '_' END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, lead(c) OVER w AS c2, lag(c) OVER w AS c0 FROM l WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS n FROM n WHERE c = 'D' AND c2 = 'U' GROUP BY user_id""")
def pattern_v(spark, read):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    down, up = F.col("value") < F.lag("value").over(w), F.col("value") > F.lag("value").over(w)
    found = relations.match_recognize(read("events"), ["user_id"], ["ts", "event_id"], "DU", {"D": down, "U": up}, {"first_id": ("first", "D", "event_id")}, "user_id long, match_number long, first_id long")
    return found.groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT c_custkey, l_partkey FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey")
def graph_two_hop(spark, read):
    buys = read("orders").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst"))
    holds = read("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    graph = relations.Graph({}, {"BUYS": buys, "HOLDS": holds})
    starts = read("customer").select("c_custkey")
    return graph.hop(graph.hop(starts, "c_custkey", "o", label="BUYS"), "o", "l_partkey", label="HOLDS").select("c_custkey", "l_partkey").distinct()


@query("SELECT c_name, o_orderstatus AS st, l_quantity AS q FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45 AND p_size < 20")
def graph_match(spark, read):
    orders, parts, customers = read("orders"), read("part"), read("customer")
    vertices = {"Customer": customers.withColumnRenamed("c_custkey", "id"), "Order": orders.withColumnRenamed("o_orderkey", "id"), "Part": parts.withColumnRenamed("p_partkey", "id")}
    edges = {"PLACED": orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("dst")), "HOLDS": read("lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), "l_quantity")}
    return relations.Graph(vertices, edges).match("(c:Customer)-[:PLACED]->(o:Order)-[h:HOLDS]->(p:Part)", {"c_name": "c.c_name", "st": "o.o_orderstatus", "q": "h.l_quantity"}, "h.l_quantity > 45 AND p.p_size < 20")


@query("SELECT * REPLACE (CASE WHEN o_orderstatus = 'P' THEN 0.0 ELSE o_totalprice END AS o_totalprice) FROM orders")
def dml_update(spark, read):
    return relations.update(read("orders"), F.col("o_orderstatus") == "P", o_totalprice=F.lit(0.0))


@query("SELECT * FROM orders WHERE NOT coalesce(o_totalprice < 50000, false)")
def dml_delete(spark, read):
    return relations.delete(read("orders"), F.col("o_totalprice") < 50000)


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def dml_insert(spark, read):
    return relations.insert(read("region"), read("nation").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name")))


@query("""SELECT coalesce(t.s_suppkey, s.s_suppkey) AS s_suppkey, coalesce(t.s_name, s.s_name) AS s_name, CASE WHEN t.s_suppkey IS NOT NULL AND s.s_suppkey IS NOT NULL THEN t.s_acctbal + s.s_acctbal ELSE coalesce(t.s_acctbal, s.s_acctbal) END AS s_acctbal
FROM (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey < 60) t FULL JOIN (SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey >= 40) s ON t.s_suppkey = s.s_suppkey""")
def dml_merge(spark, read):
    s = read("supplier").select("s_suppkey", "s_name", "s_acctbal")
    return relations.merge(s.filter("s_suppkey < 60"), s.filter("s_suppkey >= 40"), ["s_suppkey"], {"s_acctbal": "t.s_acctbal + s.s_acctbal"})


@query("SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS i FROM orders) a JOIN (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders) b USING (i)")
def join_positional_orders(spark, read):
    o = read("orders")
    return joins.positional_join(o.select("o_totalprice", F.col("o_orderkey").alias("x")), o.select(F.col("o_orderkey").alias("y")), [F.desc("o_totalprice"), F.asc("x")], [F.asc("y")]).select("x", "y")


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) <= ceil(count(*) OVER () * 50 / 100.0)")
def top_percent_lines(spark, read):
    order = [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    return shape.top_percent(read("lineitem"), 50, order).select("l_orderkey", "l_linenumber")


@query(f"SELECT a.user_id, a.event_id, b.v FROM (SELECT nullif(user_id, 1) AS user_id, ts, event_id FROM {SPLIT[0]}) a ASOF LEFT JOIN (SELECT nullif(user_id, 1) AS user_id, ts, v FROM {SPLIT[1]}) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def asof_nulls(spark, read):
    a, b = (s.withColumn("user_id", F.nullif("user_id", F.lit(1).cast("long"))) for s in _asof_sides(read))
    return joins.asof_join(a, b, "ts", ["user_id"], how="left", slice_by=lambda t: F.date_trunc("day", t)).select("user_id", "event_id", "v")


@query("SELECT p_partkey, lo FROM part JOIN (SELECT CAST(900 + range * 13 AS DOUBLE) AS lo, CAST(900 + range * 13 + power(3, range % 12) AS DOUBLE) AS hi FROM range(40)) ON p_retailprice BETWEEN lo AND hi")
def join_range_wide(spark, read):
    ranges = spark.range(40).select((F.col("id") * 13 + 900).cast("double").alias("lo"), (F.col("id") * 13 + 900 + F.pow(F.lit(3.0), F.col("id") % 12)).alias("hi"))
    return joins.range_join(read("part"), ranges, "p_retailprice", "lo", "hi", 1).select("p_partkey", "lo")


@query("SELECT o_orderkey, (sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW EXCLUDE GROUP))::BIGINT AS s FROM orders")
def win_exclude_group(spark, read):
    return shape.excluding(read("orders"), "o_orderkey", ["o_custkey"], "o_orderpriority", -1, 0, "s").select("o_orderkey", "s")


@query("SELECT o_orderkey, (sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING EXCLUDE TIES))::BIGINT AS s FROM orders")
def win_exclude_ties(spark, read):
    return shape.excluding(read("orders"), "o_orderkey", ["o_custkey"], "o_orderpriority", -1, 1, "s", exclude="ties").select("o_orderkey", "s")


@query("""WITH e AS (SELECT user_id, event_id, value, lead(event_id) OVER w AS id2, lead(value) OVER w AS v2, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id AS a, id2 AS b FROM e WHERE value > 10 AND v2 > 50""")
def pattern_overlap(spark, read):
    define = {"A": F.col("value") > 10, "B": F.col("value") > 50}
    return relations.match_recognize(read("events"), ["user_id"], ["ts", "event_id"], "A B", define, {"a": ("last", "A", "event_id"), "b": ("last", "B", "event_id")}, "user_id long, a long, b long", skip="to next row")


@query("""SELECT s_suppkey, s_acctbal FROM (SELECT t.s_suppkey, CASE WHEN s.s_suppkey IS NULL THEN -t.s_acctbal WHEN s.s_acctbal > 5000 THEN s.s_acctbal ELSE t.s_acctbal END AS s_acctbal, s.s_suppkey IS NOT NULL AND s.s_acctbal < 0 AS gone
  FROM supplier t LEFT JOIN (SELECT s_suppkey + 30 AS s_suppkey, s_acctbal FROM supplier) s ON t.s_suppkey = s.s_suppkey) WHERE NOT gone
UNION ALL SELECT s_suppkey + 30, s_acctbal FROM supplier WHERE s_suppkey + 30 NOT IN (SELECT s_suppkey FROM supplier) AND s_acctbal > 0""")
def merge_actions(spark, read):
    t = read("supplier").select("s_suppkey", "s_acctbal")
    arms = [(relations.MATCHED, "s.s_acctbal < 0", "delete"), (relations.MATCHED, "s.s_acctbal > 5000", {"s_acctbal": "s.s_acctbal"}), (relations.NOT_MATCHED, "s.s_acctbal > 0", {}), (relations.NOT_BY_SOURCE, None, {"s_acctbal": "-t.s_acctbal"})]
    return relations.merge_into(t, t.withColumn("s_suppkey", F.col("s_suppkey") + 30), ["s_suppkey"], arms)


@query(f"WITH RECURSIVE h AS (SELECT id, 1 AS level, id AS root FROM {TREE} a WHERE boss IS NULL UNION ALL SELECT c.id, h.level + 1, h.root FROM {TREE} c JOIN h ON c.boss = h.id) SELECT id, level, root, id NOT IN (SELECT boss FROM {TREE} x WHERE boss IS NOT NULL) AS is_leaf FROM h")
def hierarchy_columns(spark, read):
    tree = read("nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") >= 2, F.floor(F.col("n_nationkey") / 2).cast("int")).alias("boss"))
    return relations.connect_by(tree, "id", "boss", F.col("boss").isNull()).select("id", "level", "root", "is_leaf")


@query("SELECT event_id, k AS key, CASE k WHEN 'u' THEN CAST(user_id AS VARCHAR) ELSE event_type END AS value, CASE k WHEN 'u' THEN 2 ELSE 1 END AS type FROM events, (SELECT unnest(['u', 't']) AS k)")
def open_json(spark, read):
    e = read("events").select("event_id", F.to_json(F.struct(F.col("user_id").alias("u"), F.col("event_type").alias("t"))).alias("j"))
    return shape.json_pairs(e, "j").drop("j")


@query("SELECT c_custkey, CAST(i AS INTEGER) AS index, p[i] AS value FROM (SELECT c_custkey, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT c_custkey, string_split(c_name, '#') AS p FROM customer))")
def split_table(spark, read):
    return shape.split_to_table(read("customer"), "c_name", "#").select("c_custkey", "index", "value")


@query("SELECT n_nationkey, n_name, CAST(i AS INTEGER) AS k, 'v' || i AS t FROM nation, (SELECT unnest([1, 2]) AS i)")
def xml_rows(spark, read):
    x = read("nation").select("n_nationkey", "n_name", F.lit("<r><i k='1'>v1</i><i k='2'>v2</i></r>").alias("x"))
    return shape.xml_nodes(x, "x", "/r/i", {"k": ("@k", "int"), "t": ("text()", "string")}).drop("x")


@query("SELECT event_id, k AS key, CASE k WHEN 'a' THEN user_id ELSE event_id END AS value FROM events, (SELECT unnest(['a', 'b']) AS k)")
def flatten_map(spark, read):
    m = F.create_map(F.lit("a"), F.col("user_id"), F.lit("b"), F.col("event_id"))
    return shape.flatten(read("events").select("event_id", "user_id"), m).select("event_id", "key", "value")


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS O_n, max(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS O_m, count(*) FILTER (WHERE o_orderstatus = 'F') AS F_n, max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS F_m FROM orders GROUP BY o_orderpriority")
def pivot_two(spark, read):
    return shape.pivot(read("orders"), ["o_orderpriority"], "o_orderstatus", ["O", "F"], F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("m"))


@query("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) UNION SELECT c_custkey, CAST(0 AS BIGINT) FROM customer WHERE c_acctbal < 0")
def pipe_union(spark, read):
    orders = Pipe(read("orders")).aggregate(F.count("*").alias("n"), group_by=[F.col("o_custkey").alias("k")])
    return orders.union(Pipe(read("customer")).where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit(0).cast("long").alias("n")).df, distinct=True).df


@query("SELECT o_custkey, name, value FROM (SELECT o_custkey, max(o_totalprice) AS hi, min(o_totalprice) AS lo FROM orders GROUP BY o_custkey) UNPIVOT (value FOR name IN (hi, lo))")
def pipe_unpivot(spark, read):
    return Pipe(read("orders")).aggregate(F.max("o_totalprice").alias("hi"), F.min("o_totalprice").alias("lo"), group_by=["o_custkey"]).unpivot(["o_custkey"], ["hi", "lo"], "name", "value").df


@query("WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")
def pipe_recursive(spark, read):
    return Pipe(spark.createDataFrame([(1,)], "n int")).recursive_union(lambda d: d.filter("n < 20").select((F.col("n") + 1).alias("n"))).df


@query("SELECT t.o_orderkey, u.n FROM orders t JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) u USING (o_custkey) WHERE t.o_totalprice > 0")
def pipe_as_assert(spark, read):
    counts = Pipe(read("orders")).aggregate(F.count("*").alias("n"), group_by=["o_custkey"]).as_("u").df
    return Pipe(read("orders")).assert_(F.col("o_totalprice") > 0).as_("t").join(counts, "o_custkey").select("t.o_orderkey", "u.n").df


@query("SELECT 'r_regionkey' AS name, 'int' AS type, 0 AS position UNION ALL SELECT 'r_name', 'string', 1")
def pipe_describe(spark, read):
    return Pipe(read("region")).describe().df


# Queries in the words of other dialects
def foreign(name: str, dialect: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """Registers SQL of a dialect; DuckDB runs ``oracle``, or the text itself."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        views(spark, sf_dir, *tables.split())
        return dialects.run(spark, sql, dialect)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle or sql


foreign("dialect_duckdb_stars", "duckdb", "customer", "SELECT * EXCLUDE (c_acctbal), c_custkey // 7 AS k FROM customer")
foreign("dialect_duckdb_qualify", "duckdb", "orders", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'P' QUALIFY rn <= 2")
foreign("dialect_duckdb_lists", "duckdb", "orders", "FROM (SELECT o_custkey, list_sort(list(o_orderkey)) AS ks, arg_max(o_orderkey, o_totalprice) AS k FROM orders GROUP BY o_custkey)")
foreign("dialect_postgres_distinct_on", "postgres", "orders", """SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey AS "Key" FROM orders WHERE o_orderpriority ~ '^[1-3]' ORDER BY o_custkey, o_totalprice DESC, o_orderkey""",
        """SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey AS "Key" FROM orders WHERE regexp_matches(o_orderpriority, '^[1-3]') ORDER BY o_custkey, o_totalprice DESC, o_orderkey""")
foreign("dialect_postgres_nulls", "postgres", "orders", "SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC, o_orderkey)::BIGINT AS rn FROM orders",
        "SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey)::BIGINT AS rn FROM orders")
foreign("dialect_postgres_fetch", "postgres", "orders", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey OFFSET 5 ROWS FETCH NEXT 7 ROWS ONLY", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 5")
foreign("dialect_snowflake", "snowflake", "orders", "SELECT o_custkey, iff(o_totalprice > 50000, 'a', 'b') AS c, datediff(month, o_orderdate, '1999-01-15'::timestamp) AS m, div0(o_totalprice, o_custkey - 1) AS d FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1",
        "SELECT o_custkey, CASE WHEN o_totalprice > 50000 THEN 'a' ELSE 'b' END AS c, date_diff('month', o_orderdate, TIMESTAMP '1999-01-15') AS m, CASE WHEN o_custkey = 1 THEN 0 ELSE o_totalprice / (o_custkey - 1) END AS d FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) = 1")
foreign("dialect_tsql_ties", "tsql", "part", "SELECT TOP 7 WITH TIES [p_partkey], p_size FROM part ORDER BY p_size DESC", "SELECT p_partkey, p_size FROM part QUALIFY rank() OVER (ORDER BY p_size DESC NULLS LAST) <= 7")
foreign("dialect_tsql_apply", "tsql", "customer orders", "SELECT c_custkey, t.n, LEN(c_name) AS l, ISNULL(t.m, 0) AS m FROM customer OUTER APPLY (SELECT count(*) AS n, max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) AS t",
        "SELECT c_custkey, t.n, CAST(length(c_name) AS INTEGER) AS l, coalesce(t.m, 0) AS m FROM customer LEFT JOIN LATERAL (SELECT count(*) AS n, max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) AS t ON true")
foreign("dialect_bigquery", "bigquery", "lineitem", 'SELECT * EXCEPT (q) FROM (SELECT l_returnflag, COUNTIF(l_linestatus = "O") AS n, LOGICAL_AND(l_quantity > 0) AS p, SAFE_DIVIDE(SUM(l_quantity), 0) AS z, 1 AS q FROM lineitem GROUP BY l_returnflag)',
        "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS n, bool_and(l_quantity > 0) AS p, CAST(NULL AS DOUBLE) AS z FROM lineitem GROUP BY l_returnflag")
foreign("dialect_mysql", "mysql", "nation", 'SELECT n_regionkey, GROUP_CONCAT(n_name ORDER BY n_name DESC SEPARATOR "|") AS ns FROM nation GROUP BY n_regionkey ORDER BY n_regionkey LIMIT 1, 3',
        "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS ns FROM nation GROUP BY n_regionkey ORDER BY n_regionkey LIMIT 3 OFFSET 1")

foreign("dialect_postgres_division", "postgres", "orders", "SELECT o_orderkey, o_orderkey / 7 AS a, o_orderkey / 7 * 2 AS b, o_totalprice / 7 AS c FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS a, o_orderkey // 7 * 2 AS b, o_totalprice / 7 AS c FROM orders")
foreign("dialect_tsql_text", "tsql", "customer", "SELECT c_custkey, c_name + '/' + c_mktsegment AS t, c_custkey + 1 AS n, LEN(c_name + '  ') AS l, c_custkey / 4 AS q FROM customer WITH (NOLOCK)",
        "SELECT c_custkey, c_name || '/' || c_mktsegment AS t, c_custkey + 1 AS n, CAST(length(c_name) AS INTEGER) AS l, c_custkey // 4 AS q FROM customer")
foreign("dialect_tsql_styles", "tsql", "orders", "SELECT o_orderkey, CONVERT(varchar(8), o_orderdate, 112) AS a, CONVERT(varchar(10), o_orderdate, 103) AS b, CONVERT(varchar, o_orderdate, 120) AS c FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS a, strftime(o_orderdate, '%d/%m/%Y') AS b, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS c FROM orders")
foreign("dialect_duckdb_subscripts", "duckdb", "embeddings", "SELECT vec_id, embedding[1] AS a, embedding[-1] AS b, embedding[1000] AS c, embedding[2:4] AS d FROM embeddings")
foreign("dialect_duckdb_regexp", "duckdb", "part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '_') AS a, regexp_replace(p_name, '[aeiou]', '_', 'g') AS b, regexp_extract(p_brand, '[a-z]([0-9])') AS c, p_type GLOB '*E*' AS g FROM part")
foreign("dialect_duckdb_formats", "duckdb", "orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d, %H:%M') AS f, strftime(o_orderdate, '%j %b %-d') AS j FROM orders")
foreign("dialect_duckdb_unnest", "duckdb", "embeddings", "SELECT vec_id, x FROM embeddings, UNNEST(embedding) AS u(x)")
foreign("dialect_postgres_ordinality", "postgres", "embeddings", "SELECT vec_id, x, CAST(n AS INTEGER) AS n FROM embeddings CROSS JOIN UNNEST(embedding) WITH ORDINALITY AS u(x, n)", "SELECT vec_id, unnest(embedding) AS x, CAST(unnest(range(1, len(embedding) + 1)) AS INTEGER) AS n FROM embeddings")
foreign("dialect_postgres_patterns", "postgres", "part", "SELECT p_partkey FROM part WHERE p_name SIMILAR TO '(a|b|s)%e_%' AND p_type !~* 'zinc'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '(a|b|s).*e..*') AND NOT regexp_matches(lower(p_type), 'zinc')")
foreign("dialect_bigquery_pipe", "bigquery", "orders", "FROM orders |> WHERE o_orderstatus != 'P' |> AGGREGATE COUNT(*) AS n, MAX(o_totalprice) AS m GROUP BY o_custkey |> RENAME n AS orders_n |> EXTEND orders_n * 2 AS twice |> DROP m",
        "SELECT o_custkey, count(*) AS orders_n, count(*) * 2 AS twice FROM orders WHERE o_orderstatus <> 'P' GROUP BY o_custkey")
foreign("dialect_bigquery_offsets", "bigquery", "embeddings", "SELECT vec_id, x, o FROM embeddings, UNNEST(embedding) AS x WITH OFFSET AS o WHERE embedding[OFFSET(0)] > embedding[SAFE_ORDINAL(2)]",
        "SELECT vec_id, x, o FROM (SELECT vec_id, embedding, unnest(embedding) AS x, CAST(unnest(range(len(embedding))) AS INTEGER) AS o FROM embeddings) WHERE embedding[1] > embedding[2]")
foreign("dialect_snowflake_flatten", "snowflake", "embeddings", "SELECT vec_id, f.index AS i, f.value AS v FROM embeddings, LATERAL FLATTEN(input => embedding) f", "SELECT vec_id, CAST(unnest(range(len(embedding))) AS INTEGER) AS i, unnest(embedding) AS v FROM embeddings")
foreign("dialect_mysql_or", "mysql", "orders", "SELECT o_orderkey, o_totalprice < 50000 || o_orderstatus = 'P' AS either, DATE_FORMAT(o_orderdate, '%d.%m.%Y %H:%i') AS d FROM orders", "SELECT o_orderkey, o_totalprice < 50000 OR o_orderstatus = 'P' AS either, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS d FROM orders")
foreign("dialect_redshift", "redshift", "orders", "SELECT o_custkey, NVL(MAX(NULLIF(o_orderstatus, 'P')), '-') AS s, DATEDIFF(month, MIN(o_orderdate), MAX(o_orderdate)) AS m, COUNT(*) / 2 AS h FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, coalesce(max(nullif(o_orderstatus, 'P')), '-') AS s, date_diff('month', min(o_orderdate), max(o_orderdate)) AS m, count(*) // 2 AS h FROM orders GROUP BY o_custkey")
foreign("dialect_trino", "trino", "embeddings", "SELECT vec_id, embedding[1] AS a, cardinality(embedding) AS n, label / 2 AS h FROM embeddings ORDER BY label DESC, vec_id LIMIT 50", "SELECT vec_id, embedding[1] AS a, CAST(len(embedding) AS INTEGER) AS n, CAST(label // 2 AS BIGINT) AS h FROM embeddings ORDER BY label DESC NULLS LAST, vec_id LIMIT 50")
foreign("dialect_sqlite", "sqlite", "orders", "SELECT o_orderkey, ifnull(nullif(o_orderstatus, 'P'), '?') AS s, strftime('%Y-%m', o_orderdate) AS m, o_orderkey / 3 AS q FROM orders WHERE o_orderpriority GLOB '[1-3]*'",
        "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'P'), '?') AS s, strftime(o_orderdate, '%Y-%m') AS m, o_orderkey // 3 AS q FROM orders WHERE o_orderpriority GLOB '[1-3]*'")


# Templated models
@query("SELECT c_mktsegment, count(*) AS n, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o_total, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f_total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 50000 GROUP BY c_mktsegment")
def template_models(spark, read):
    from .templates import Models

    for name in ("orders", "customer"):
        read(name).createOrReplaceTempView(name)
    models = {
        "large_orders": "SELECT * FROM {{ source('shop', 'orders') }}{% if var('least') %} WHERE o_totalprice > {{ var('least') }}{% endif %}",
        "by_segment": """{% set states = ['O', 'F'] %}{{ config(materialized='view') }}
SELECT c_mktsegment, count(*) AS n{% for s in states %}, round(sum(CASE WHEN o_orderstatus = '{{ s }}' THEN o_totalprice END), 2) AS {{ s | lower }}_total{% endfor %}
FROM {{ ref('large_orders') }} JOIN {{ source('shop', 'customer') }} ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    }
    return Models(models, {("shop", t): t for t in ("orders", "customer")}, {"least": 50000}).run(spark, "by_segment")


# Scripts: variables, loops and branches, which Spark runs as one compound statement
same("script_while", "orders", """BEGIN
  DECLARE bound INT DEFAULT 1;
  WHILE bound < 1000 DO SET bound = bound * 10; END WHILE;
  IF bound > 100 THEN SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey <= bound GROUP BY o_orderstatus;
  ELSE SELECT o_orderstatus, 0L AS n FROM orders; END IF;
END""", "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_custkey <= 1000 GROUP BY o_orderstatus")
same("script_for", "nation region", """BEGIN
  DECLARE total BIGINT DEFAULT 0;
  FOR r AS SELECT r_regionkey FROM region DO SET total = total + (SELECT count(*) FROM nation WHERE n_regionkey = r.r_regionkey); END FOR;
  SELECT total;
END""", "SELECT count(*) AS total FROM nation JOIN region ON n_regionkey = r_regionkey")
same("execute_immediate", "part", "EXECUTE IMMEDIATE 'SELECT p_brand, count(*) AS n FROM part WHERE p_size > ? GROUP BY p_brand' USING 10", "SELECT p_brand, count(*) AS n FROM part WHERE p_size > 10 GROUP BY p_brand")


from . import catalogue_functions as _more  # noqa: E402, F401  registers its queries here
