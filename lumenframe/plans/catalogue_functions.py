"""More queries of the catalogue: functions by family, statements as text, what a query means."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import shape
from ..sources.tables import views
from ..streaming import events
from . import analysis, statements
from .catalogue import ORACLE_SQL, QUERIES, query, same

# Strings
same("str_more", "customer", "SELECT c_custkey, initcap(lower(c_name)) AS i, translate(c_name, '0123', 'abcd') AS t, overlay(c_name PLACING '_' FROM 2 FOR 3) AS o, substring_index(c_name, '#', 1) AS s, locate('#', c_name) AS l, char(65 + c_nationkey) AS ch, concat_ws('/', c_name, NULL, c_mktsegment) AS w FROM customer",
     "SELECT c_custkey, upper(substr(c_name, 1, 1)) || lower(substr(c_name, 2)) AS i, translate(c_name, '0123', 'abcd') AS t, substr(c_name, 1, 1) || '_' || substr(c_name, 5) AS o, split_part(c_name, '#', 1) AS s, CAST(instr(c_name, '#') AS INTEGER) AS l, chr(65 + c_nationkey) AS ch, concat_ws('/', c_name, NULL, c_mktsegment) AS w FROM customer")
same("str_format", "customer", "SELECT c_custkey, format_number(c_acctbal, 2) AS n, printf('%05d|%s', c_custkey, c_mktsegment) AS p, base64(encode(c_name, 'UTF-8')) AS b, hex(c_custkey) AS h, space(2) || 'x' AS sp, btrim('--x--', '-') AS t, octet_length(c_name) AS ol, bit_length(c_name) AS bl FROM customer",
     "SELECT c_custkey, format('{:,.2f}', c_acctbal) AS n, printf('%05d|%s', c_custkey, c_mktsegment) AS p, to_base64(encode(c_name)) AS b, to_hex(c_custkey) AS h, '  x' AS sp, trim('--x--', '-') AS t, CAST(octet_length(encode(c_name)) AS INTEGER) AS ol, CAST(bit_length(c_name) AS INTEGER) AS bl FROM customer")
same("str_search", "part", "SELECT p_partkey, contains(p_name, 'a') AS c, startswith(p_type, 'S') AS s, endswith(p_brand, '1') AS e, regexp_count(p_name, '[aeiou]') AS n, regexp_instr(p_name, '[aeiou]') AS i, array_size(regexp_extract_all(p_name, '([aeiou])', 1)) AS al, regexp_substr(p_brand, '[0-9]+') AS sub FROM part",
     "SELECT p_partkey, contains(p_name, 'a') AS c, starts_with(p_type, 'S') AS s, ends_with(p_brand, '1') AS e, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER) AS n, CAST(CASE WHEN regexp_matches(p_name, '[aeiou]') THEN length(regexp_extract(p_name, '^[^aeiou]*')) + 1 ELSE 0 END AS INTEGER) AS i, CAST(len(regexp_extract_all(p_name, '[aeiou]')) AS INTEGER) AS al, nullif(regexp_extract(p_brand, '[0-9]+'), '') AS sub FROM part")
# Numbers
same("math_more", "lineitem", "SELECT l_orderkey, l_linenumber, round(cbrt(l_quantity), 8) AS c, round(hypot(l_quantity, 3), 8) AS h, factorial(l_linenumber) AS f, pmod(-l_orderkey, 7) AS p, conv(CAST(l_orderkey AS STRING), 10, 16) AS x, bin(l_linenumber) AS b, round(log2(l_quantity), 8) AS l2, round(log10(l_quantity), 8) AS l10, round(log(3, l_quantity), 7) AS l3 FROM lineitem",
     "SELECT l_orderkey, l_linenumber, round(cbrt(l_quantity), 8) AS c, round(sqrt(l_quantity * l_quantity + 9), 8) AS h, CAST(factorial(l_linenumber) AS BIGINT) AS f, ((-l_orderkey % 7) + 7) % 7 AS p, upper(to_hex(l_orderkey)) AS x, bin(l_linenumber) AS b, round(log2(l_quantity), 8) AS l2, round(log10(l_quantity), 8) AS l10, round(ln(l_quantity) / ln(3), 7) AS l3 FROM lineitem")
same("math_bits", "lineitem", "SELECT l_orderkey, l_linenumber, shiftleft(l_orderkey, 2) AS a, shiftright(l_orderkey, 1) AS b, l_orderkey ^ 5 AS x, ~l_linenumber AS n, CAST(getbit(l_orderkey, 1) AS INT) AS g, l_orderkey DIV 4 AS d, l_orderkey % 5 AS m FROM lineitem",
     "SELECT l_orderkey, l_linenumber, l_orderkey << 2 AS a, l_orderkey >> 1 AS b, xor(l_orderkey, 5) AS x, ~l_linenumber AS n, CAST((l_orderkey >> 1) & 1 AS INTEGER) AS g, l_orderkey // 4 AS d, l_orderkey % 5 AS m FROM lineitem")
same("math_buckets", "lineitem", "SELECT l_orderkey, l_linenumber, width_bucket(l_quantity, 0, 50, 5) AS w, bround(l_quantity / 4, 0) AS br, rint(l_quantity / 4) AS ri, nanvl(l_tax, 0) AS nv, least(l_tax, l_discount) AS le, positive(l_linenumber) AS p, negative(l_linenumber) AS ng FROM lineitem",
     "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_quantity >= 50 THEN 6 ELSE floor(l_quantity / 10) + 1 END AS BIGINT) AS w, round_even(l_quantity / 4, 0) AS br, round_even(l_quantity / 4, 0) AS ri, l_tax AS nv, least(l_tax, l_discount) AS le, l_linenumber AS p, -l_linenumber AS ng FROM lineitem")
# Dates
same("date_more", "orders", "SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) AS a, next_day(CAST(o_orderdate AS DATE), 'MON') AS b, date_add(CAST(o_orderdate AS DATE), 10) AS c, date_sub(CAST(o_orderdate AS DATE), 3) AS d, dayofweek(o_orderdate) AS e, weekday(o_orderdate) AS f, extract(HOUR FROM o_orderdate) AS h, monthname(o_orderdate) AS mn FROM orders",
     "SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) AS a, CAST(CAST(o_orderdate AS DATE) + CAST(8 - isodow(o_orderdate) AS INTEGER) AS DATE) AS b, CAST(o_orderdate AS DATE) + 10 AS c, CAST(o_orderdate AS DATE) - 3 AS d, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS e, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS f, CAST(hour(o_orderdate) AS INTEGER) AS h, strftime(o_orderdate, '%b') AS mn FROM orders")
same("date_stamps", "orders", "SELECT o_orderkey, timestampadd(HOUR, 5, o_orderdate) AS a, timestampdiff(DAY, TIMESTAMP_NTZ '1992-01-01 00:00:00', o_orderdate) AS d, unix_date(CAST(o_orderdate AS DATE)) AS u, date_from_unix_date(unix_date(CAST(o_orderdate AS DATE))) AS r, to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy') AS t, CAST(o_orderdate AS DATE) - DATE '1992-01-01' > INTERVAL '100' DAY AS i FROM orders",
     "SELECT o_orderkey, o_orderdate + INTERVAL 5 HOUR AS a, date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS d, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INTEGER) AS u, CAST(o_orderdate AS DATE) AS r, CAST(o_orderdate AS DATE) AS t, CAST(o_orderdate AS DATE) - DATE '1992-01-01' > 100 AS i FROM orders")
# Conditions and conversions
same("cond_more", "orders", "SELECT o_orderkey, nvl2(nullif(o_orderstatus, 'P'), 'y', 'n') AS a, ifnull(nullif(o_orderstatus, 'F'), '-') AS b, zeroifnull(nullif(o_custkey, 7)) AS z, nullifzero(o_custkey % 2) AS nz, equal_null(nullif(o_orderstatus, 'P'), NULL) AS q FROM orders",
     "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'y' ELSE 'n' END AS a, coalesce(nullif(o_orderstatus, 'F'), '-') AS b, coalesce(nullif(o_custkey, 7), 0) AS z, nullif(o_custkey % 2, 0) AS nz, nullif(o_orderstatus, 'P') IS NULL AS q FROM orders")
same("cast_more", "orders", "SELECT o_orderkey, try_cast(o_orderpriority AS INT) AS a, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_orderkey AS STRING) AS s, boolean(o_orderkey % 2) AS b, try_to_number(left(o_orderpriority, 1), '9') AS n, string(o_custkey) AS st, to_number('1,234', '9,999') AS tn FROM orders",
     "SELECT o_orderkey, try_cast(o_orderpriority AS INTEGER) AS a, CAST(o_totalprice AS DECIMAL(12, 1)) AS d, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderkey % 2 AS BOOLEAN) AS b, CAST(left(o_orderpriority, 1) AS DECIMAL(1, 0)) AS n, CAST(o_custkey AS VARCHAR) AS st, CAST(1234 AS DECIMAL(4, 0)) AS tn FROM orders")
# Collections
same("arr_more", "nation", "SELECT n_nationkey, array_insert(array(1, 2), 2, n_regionkey) AS i, array_append(array(1), n_regionkey) AS a, array_prepend(array(1), n_regionkey) AS p, array_remove(array(1, 2, 1), 1) AS r, array_repeat(n_regionkey, 2) AS rep, array_position(array(5, n_regionkey), n_regionkey) AS pos, sequence(1, 5, 2) AS s, array_compact(array(1, NULL, 2)) AS c, arrays_overlap(array(1, 2), array(n_regionkey)) AS o FROM nation",
     "SELECT n_nationkey, [1, n_regionkey, 2] AS i, [1, n_regionkey] AS a, [n_regionkey, 1] AS p, [2] AS r, [n_regionkey, n_regionkey] AS rep, CAST(list_position([5, n_regionkey], n_regionkey) AS BIGINT) AS pos, [1, 3, 5] AS s, [1, 2] AS c, list_has_any([1, 2], [n_regionkey]) AS o FROM nation")
same("lambda_more", "embeddings", "SELECT vec_id, forall(embedding, x -> x < 100) AS f, size(zip_with(embedding, embedding, (a, b) -> a + b)) AS z, reduce(transform(embedding, x -> CAST(x > 0 AS INT)), 0, (s, x) -> s + x) AS r, array_max(transform(embedding, (x, i) -> i)) AS mi, size(array_sort(embedding, (a, b) -> CASE WHEN a < b THEN 1 WHEN a > b THEN -1 ELSE 0 END)) AS srt FROM embeddings",
     "SELECT vec_id, len(list_filter(embedding, lambda x: x >= 100)) = 0 AS f, CAST(len(embedding) AS INTEGER) AS z, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS r, CAST(len(embedding) - 1 AS INTEGER) AS mi, CAST(len(embedding) AS INTEGER) AS srt FROM embeddings")
same("map_more", "nation", "SELECT n_nationkey, map_filter(m, (k, v) -> v > 1)['b'] AS f, transform_values(m, (k, v) -> v * 10)['a'] AS t, transform_keys(m, (k, v) -> upper(k))['A'] AS u, map_concat(m, map('c', 9))['c'] AS c, map_contains_key(m, 'b') AS h, str_to_map('x:1,y:2')['y'] AS s, map_zip_with(m, m, (k, a, b) -> a + b)['b'] AS z, cardinality(m) AS n FROM (SELECT n_nationkey, map('a', n_regionkey, 'b', 2) AS m FROM nation)",
     "SELECT n_nationkey, m['b'] AS f, m['a'] * 10 AS t, m['a'] AS u, 9 AS c, map_contains(m, 'b') AS h, '2' AS s, m['b'] * 2 AS z, CAST(cardinality(m) AS INTEGER) AS n FROM (SELECT n_nationkey, MAP {'a': n_regionkey, 'b': 2} AS m FROM nation)")
same("gen_more", "nation", "SELECT n_nationkey, k, v FROM nation LATERAL VIEW stack(2, 'name', n_name, 'region', CAST(n_regionkey AS STRING)) t AS k, v", "SELECT n_nationkey, unnest(['name', 'region']) AS k, unnest([n_name, CAST(n_regionkey AS VARCHAR)]) AS v FROM nation")
same("gen_inline", "nation", "SELECT n_nationkey, a, b FROM nation LATERAL VIEW inline(array(named_struct('a', n_name, 'b', 1), named_struct('a', 'x', 'b', 2))) t AS a, b", "SELECT n_nationkey, unnest([n_name, 'x']) AS a, unnest([1, 2]) AS b FROM nation")
same("json_more", "events", "SELECT event_id, from_json(j, 'u BIGINT, l ARRAY<INT>').l[1] AS l, s.a AS a, s.b AS b FROM (SELECT event_id, j, json_tuple(j, 'u', 't') AS (a, b) FROM (SELECT event_id, to_json(named_struct('u', user_id, 't', event_type, 'l', array(1, 2))) AS j FROM events)) AS s",
     "SELECT event_id, 2 AS l, CAST(user_id AS VARCHAR) AS a, event_type AS b FROM events")
same("variant_more", "events", "SELECT event_id, variant_get(v, '$.l[1]', 'int') AS l, try_variant_get(v, '$.t', 'int') AS t, is_variant_null(variant_get(v, '$.n')) AS n, schema_of_variant(v) AS s FROM (SELECT event_id, parse_json(concat('{\"u\":', user_id, ',\"l\":[1,2],\"t\":\"x\",\"n\":null}')) AS v FROM events)",
     "SELECT event_id, 2 AS l, CAST(NULL AS INTEGER) AS t, true AS n, 'OBJECT<l: ARRAY<BIGINT>, n: VOID, t: STRING, u: BIGINT>' AS s FROM events")
same("variant_rows", "nation", "SELECT n_nationkey, t.key AS k, variant_get(t.value, '$', 'int') AS v FROM nation, LATERAL variant_explode(parse_json(concat('{\"a\":', n_regionkey, ',\"b\":7}'))) t", "SELECT n_nationkey, unnest(['a', 'b']) AS k, unnest([n_regionkey, 7]) AS v FROM nation")
same("misc_functions", "nation", "SELECT n_nationkey, typeof(n_name) AS t, coalesce(assert_true(n_nationkey >= 0), 'ok') AS a, current_database() IS NOT NULL AS d, length(uuid()) AS u, length(version()) > 0 AS v, input_file_name() LIKE '%nation%' AS f FROM nation",
     "SELECT n_nationkey, 'string' AS t, 'ok' AS a, true AS d, 36 AS u, true AS v, true AS f FROM nation")
same("hash_more", "customer", "SELECT c_custkey, sha2(c_name, 224) = sha2(c_name, 224) AS s, hash(c_name) = hash(c_name) AS h, xxhash64(c_name) = xxhash64(c_name) AS x, crc32(encode('123456789', 'UTF-8')) AS c, md5('a') AS m FROM customer",
     "SELECT c_custkey, true AS s, true AS h, true AS x, CAST(3421780262 AS BIGINT) AS c, md5('a') AS m FROM customer")
# Aggregates
same("agg_more", "lineitem", "SELECT l_returnflag, count_if(l_quantity > 25) AS ci, max(l_shipdate) AS mx, round(try_avg(l_tax), 8) AS ta, array_size(collect_set(l_linestatus)) AS cs, bool_or(l_tax > 0.07) AS bo, every(l_quantity > 0) AS ev, round(regr_avgx(l_tax, l_quantity), 6) AS rx, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ri, round(covar_samp(l_quantity, l_discount), 8) AS cv FROM lineitem GROUP BY l_returnflag",
     "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS ci, max(l_shipdate) AS mx, round(avg(l_tax), 8) AS ta, CAST(count(DISTINCT l_linestatus) AS INTEGER) AS cs, bool_or(l_tax > 0.07) AS bo, bool_and(l_quantity > 0) AS ev, round(regr_avgx(l_tax, l_quantity), 6) AS rx, round(regr_intercept(l_extendedprice, l_quantity), 3) AS ri, round(covar_samp(l_quantity, l_discount), 8) AS cv FROM lineitem GROUP BY l_returnflag")

@query("SELECT DISTINCT l_returnflag, true AS d, true AS h, true AS p, true AS t FROM lineitem")
def agg_approx_bounds(spark, read):
    # beside a DISTINCT, Spark would make all sketches for every pair of flag and part, so the exact counts are made apart
    rows = read("lineitem")
    sketches = rows.groupBy("l_returnflag").agg(
        F.expr("approx_count_distinct(l_partkey, 0.02)").alias("d"),
        F.expr("hll_sketch_estimate(hll_sketch_agg(l_partkey))").alias("h"),
        F.expr("theta_sketch_estimate(theta_sketch_agg(l_partkey))").alias("t"),
        F.expr("abs(approx_percentile(l_quantity, 0.5) - percentile(l_quantity, 0.5)) <= 1").alias("p"),
    )
    exact = rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_distinct("l_partkey").alias("n"))
    near = lambda c: F.expr(f"abs({c} - n) <= 0.1 * n").alias(c)
    return sketches.join(exact, F.col("l_returnflag").eqNullSafe(F.col("flag"))).select("l_returnflag", near("d"), near("h"), "p", near("t"))


same("agg_top_k", "orders", "SELECT array_join(array_sort(transform(approx_top_k(o_orderstatus, 3, 100), x -> concat(x.item, ':', x.count))), ',') AS t FROM orders",
     "SELECT string_agg(o_orderstatus || ':' || n, ',' ORDER BY o_orderstatus) AS t FROM (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1)")
# Functions of one's own
for _name, _make, _use, _oracle in (
    ("udf_sql", "CREATE OR REPLACE TEMPORARY FUNCTION lf_net(p DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN p * (1 - d)", "SELECT l_orderkey, l_linenumber, round(lf_net(l_extendedprice, l_discount), 4) AS n FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS n FROM lineitem"),
    ("udf_table", "CREATE OR REPLACE TEMPORARY FUNCTION lf_nations(r INT) RETURNS TABLE (k INT, n STRING) RETURN SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = r", "SELECT r_name, k, n FROM region, LATERAL lf_nations(r_regionkey)", "SELECT r_name, n_nationkey AS k, n_name AS n FROM region JOIN nation ON n_regionkey = r_regionkey"),
):

    def _defined(spark, sf_dir, make=_make, use=_use):
        views(spark, sf_dir, "lineitem", "nation", "region")
        spark.sql(make)
        return spark.sql(use)

    QUERIES[_name], ORACLE_SQL[_name] = _defined, _oracle


@query("SELECT l_returnflag, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) AS w FROM lineitem GROUP BY l_returnflag")
def udaf_weighted_mean(spark, read):
    """An aggregate of one's own as an expression over built-in ones, so it combines before the shuffle."""
    weighted = F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity")
    return read("lineitem").groupBy("l_returnflag").agg(F.round(weighted, 4).alias("w"))


@query("SELECT c_custkey, i AS n, upper(p[i]) AS w FROM (SELECT c_custkey, p, CAST(unnest(range(1, len(p) + 1)) AS INTEGER) AS i FROM (SELECT c_custkey, string_split(c_name, '#') AS p FROM customer))")
def udtf_words(spark, read):
    @F.udtf(returnType="n: int, w: string")
    class LfWords:
        def eval(self, value: str):
            for i, w in enumerate(value.split("#"), 1):
                yield i, w.upper()

    spark.udtf.register("lf_words", LfWords)
    read("customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, n, w FROM customer, LATERAL lf_words(c_name)")


@query("SELECT CAST(time_bucket(INTERVAL '15 minutes', ts) AS TIMESTAMP) AS b, count(*) AS n FROM events GROUP BY 1")
def time_buckets(spark, read):
    return read("events").groupBy(text.time_bucket("15 minutes", F.col("ts")).alias("b")).agg(F.count("*").alias("n"))


@query("SELECT a.event_id AS x, b.event_id AS y FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 10 MINUTE AND a.event_type <> b.event_type")
def ev_interval_join(spark, read):
    e = read("events")
    a, b = (e.select("user_id", F.col("ts").alias(f"t{i}"), F.col("event_id").alias(i), F.col("event_type").alias(f"k{i}")) for i in ("x", "y"))
    return events.interval_join(a, b, ["user_id"], "tx", "ty", "10 minutes").filter("kx <> ky").select("x", "y")


@query("SELECT count(*) AS n, count(DISTINCT l_orderkey * 8 + l_linenumber) <= 500 AS few FROM (SELECT * FROM lineitem LIMIT 500)")
def sample_exact_rows(spark, read):
    return shape.sample_rows(read("lineitem"), 500, 3).agg(F.count("*").alias("n"), (F.count_distinct(F.col("l_orderkey") * 8 + F.col("l_linenumber")) <= 500).alias("few"))


# Statements as text
def changed(name: str, dialect: str, tables: str, sql: str, oracle: str) -> None:
    def run(spark, sf_dir):
        views(spark, sf_dir, *tables.split())
        return statements.change(spark, sql, dialect)[1]

    QUERIES[name], ORACLE_SQL[name] = run, oracle


changed("text_update", "postgres", "orders", "UPDATE orders SET o_totalprice = o_totalprice / 2, o_orderstatus = 'X' WHERE o_orderkey / 2 < 100", "SELECT * REPLACE (CASE WHEN o_orderkey // 2 < 100 THEN o_totalprice / 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey // 2 < 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus) FROM orders")
changed("text_delete", "tsql", "orders customer", "DELETE FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE LEN(c_mktsegment + ' ') > 8)", "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE length(c_mktsegment) > 8)")
changed("text_insert", "duckdb", "region nation", "INSERT INTO region BY NAME SELECT n_name AS r_name, n_nationkey + 50 AS r_regionkey FROM nation", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 50, n_name FROM nation")
changed("text_merge", "snowflake", "supplier nation", "MERGE INTO supplier USING (SELECT n_nationkey + 90 AS k, n_name FROM nation) AS n ON supplier.s_suppkey = n.k WHEN MATCHED AND n.k > 95 THEN DELETE WHEN MATCHED THEN UPDATE SET s_name = n.n_name WHEN NOT MATCHED THEN INSERT (s_suppkey, s_name) VALUES (n.k, upper(n.n_name))",
        "SELECT s_suppkey, coalesce(n_name, s_name) AS s_name, s_nationkey, s_acctbal FROM supplier LEFT JOIN (SELECT n_nationkey + 90 AS k, n_name FROM nation) ON s_suppkey = k WHERE k IS NULL OR k <= 95 UNION ALL SELECT n_nationkey + 90, upper(n_name), NULL, NULL FROM nation WHERE n_nationkey + 90 NOT IN (SELECT s_suppkey FROM supplier)")
changed("text_create_as", "bigquery", "orders", "CREATE TABLE IF NOT EXISTS big AS SELECT * EXCEPT (o_orderdate) FROM orders WHERE o_totalprice > 100000", "SELECT * EXCLUDE (o_orderdate) FROM orders WHERE o_totalprice > 100000")
changed("text_delete_using", "postgres", "orders customer", "DELETE FROM orders USING customer WHERE orders.o_custkey = customer.c_custkey AND customer.c_acctbal < 0", "SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")


# What a query means
MEANING = {
    "lineage_q": ("lineage", "SELECT c.c_name, sum(o.o_totalprice) AS total, count(*) AS n FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_name", "position, name, source_table, source_column", "(0, 'c_name', 'customer', 'c_name'), (1, 'total', 'orders', 'o_totalprice')"),
    "lineage_deep_q": ("lineage", "WITH a (k, p) AS (SELECT o_custkey, o_totalprice FROM orders UNION ALL SELECT c_custkey, c_acctbal FROM customer) SELECT k, (SELECT max(c_name) FROM customer WHERE c_custkey = k) AS m, s FROM (SELECT k, sum(p) AS s FROM a GROUP BY ROLLUP(k))", "position, name, source_table, source_column", "(0, 'k', 'customer', 'c_custkey'), (0, 'k', 'orders', 'o_custkey'), (1, 'm', 'customer', 'c_name'), (2, 's', 'customer', 'c_acctbal'), (2, 's', 'orders', 'o_totalprice')"),
    "hops_q": ("hops", "WITH a AS (SELECT o_custkey AS k, o_totalprice * 2 AS p FROM orders) SELECT k AS id, max(p) AS m FROM a GROUP BY k", "position, name, hop, parent, column, kind, via, source_table", "(0, 'id', 0, NULL, 'o_custkey', 'origin', 'id,k', 'orders'), (1, 'm', 0, NULL, 'm', 'aggregate', '', NULL), (1, 'm', 1, 0, 'p', 'computed', '', NULL), (1, 'm', 2, 1, 'o_totalprice', 'origin', '', 'orders')"),
    "types_q": ("types", "SELECT o_orderkey + 1 AS k, o_totalprice / 2 AS h, count(*) OVER () AS n, array(o_orderstatus) AS a FROM orders", "position, name, type", "(0, 'k', 'bigint'), (1, 'h', 'double'), (2, 'n', 'bigint'), (3, 'a', 'array<string>')"),
    "nullability_q": ("nullability", "SELECT o_orderkey, count(*) AS n, coalesce(max(o_custkey), 0) AS c FROM orders GROUP BY o_orderkey", "position, name, nullable", "(0, 'o_orderkey', true), (1, 'n', false), (2, 'c', false)"),
    "scopes_q": ("scopes", "WITH a AS (SELECT * FROM orders) SELECT * FROM a JOIN (SELECT * FROM customer) c ON a.o_custkey = c.c_custkey", "scope, parent, kind, name, table", "(0, NULL, 'with', 'a', NULL), (1, 0, 'table', 'orders', 'orders'), (0, NULL, 'cte', 'a', NULL), (0, NULL, 'subquery', 'c', NULL), (2, 0, 'table', 'customer', 'customer')"),
    "stars_q": ("expand_star", "SELECT c.*, o_orderkey AS k, 1 AS one FROM customer c JOIN orders ON c_custkey = o_custkey", "position, name, source_table, source_column", "(0, 'c_custkey', 'customer', 'c_custkey'), (1, 'c_name', 'customer', 'c_name'), (2, 'c_nationkey', 'customer', 'c_nationkey'), (3, 'c_acctbal', 'customer', 'c_acctbal'), (4, 'c_mktsegment', 'customer', 'c_mktsegment'), (5, 'k', 'orders', 'o_orderkey'), (6, 'one', NULL, NULL)"),
}
for _name, (_kind, _sql, _columns, _rows) in MEANING.items():

    def _meant(spark, sf_dir, kind=_kind, sql=_sql):
        views(spark, sf_dir, "orders", "customer")
        return getattr(analysis, kind)(spark, sql)

    QUERIES[_name] = _meant
    _quoted = ", ".join(f'"{c}"' for c in _columns.split(", "))
    ORACLE_SQL[_name] = f"SELECT {_quoted} FROM (VALUES {_rows}) AS t({_quoted})"


def diagnostics_q(spark, sf_dir):
    views(spark, sf_dir, "orders", "customer")
    found = analysis.diagnostics(spark, "SELECT nope, o_orderkey FROM orders o JOIN customer o2 ON abs(1, 2) = 3\nWHERE array_contains(o_custkey, 1)")
    return found.select("kind", "line", "column", "end_line", "end_column", "fragment")


QUERIES["diagnostics_q"] = diagnostics_q
ORACLE_SQL["diagnostics_q"] = """SELECT * FROM (VALUES ('unknown-column', 1, 7, 1, 11, 'nope'), ('wrong-arity', 1, 58, 1, 67, 'abs(1, 2)'), ('wrong-argument-type', 2, 6, 2, 34, 'array_contains(o_custkey, 1)')) AS t(kind, line, "column", end_line, end_column, fragment)"""


def statements_q(spark, sf_dir):
    return statements.classes(spark, "SELECT 1; CREATE TABLE t (a INT); MERGE INTO t USING u ON 1 = 1 WHEN MATCHED THEN DELETE; GRANT SELECT ON t TO x; COMMIT", "postgres").select("position", "category", "kind")


QUERIES["statements_q"] = statements_q
ORACLE_SQL["statements_q"] = "SELECT * FROM (VALUES (0, 'query', 'query'), (1, 'ddl', 'ddl'), (2, 'dml', 'dml'), (3, 'dcl', 'other'), (4, 'tcl', 'other')) AS t(position, category, kind)"


def tokens_q(spark, sf_dir):
    return analysis.tokens(spark, 'SELECT "a b", 1.5 -- x\nFROM t', "postgres")


QUERIES["tokens_q"] = tokens_q
ORACLE_SQL["tokens_q"] = """SELECT * FROM (VALUES (0, 'word', 'SELECT', 0, 6), (1, 'name', '"a b"', 7, 12), (2, 'sign', ',', 12, 13), (3, 'number', '1.5', 14, 17), (4, 'word', 'FROM', 23, 27), (5, 'word', 't', 28, 29)) AS t(position, kind, text, "start", stop)"""
