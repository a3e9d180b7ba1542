"""The relational operators that lineage pipelines use, on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import rename_with_suffix
from ..operators.relational import asof_join, rule_value, upsert
from .registry import Registry
from .tables import table

query = Registry()


def money(column, digits: int = 4):
    """An exact number for sums, so that the order of addition does not matter."""
    return column.cast(f"decimal(18,{digits})") if not isinstance(column, str) else F.col(column).cast(f"decimal(18,{digits})")


def total(column, name: str):
    return F.sum(money(column)).cast("double").alias(name)


# ---- projections and derivations -----------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def scan_select(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross,
  CAST(l_quantity AS BIGINT) % 7 AS bucket, -l_quantity AS negated FROM lineitem""")
def derive_arith(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), (net * (1 + F.col("l_tax"))).alias("gross"), (F.col("l_quantity").cast("bigint") % 7).alias("bucket"), (-F.col("l_quantity")).alias("negated"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS dd, CAST(quarter(o_orderdate) AS INT) AS q,
  CAST(dayofyear(o_orderdate) AS INT) AS doy, strftime(o_orderdate, '%Y-%m') AS ym, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS due, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS age,
  CAST(CAST(last_day(o_orderdate) AS DATE) AS VARCHAR) AS month_end, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR) AS month_start, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS VARCHAR) AS plus2, CAST(hour(o_orderdate) AS INT) AS h FROM orders""")
def derive_dates(spark, d):
    c = F.col("o_orderdate")
    day = F.to_date(c)
    return table(spark, d, "orders").select("o_orderkey", F.year(c).alias("y"), F.month(c).alias("m"), F.dayofmonth(c).alias("dd"), F.quarter(c).alias("q"), F.dayofyear(c).alias("doy"), F.date_format(c, "yyyy-MM").alias("ym"), F.date_add(day, 30).cast("string").alias("due"), F.datediff(F.lit("1999-01-01").cast("date"), day).cast("bigint").alias("age"), F.last_day(day).cast("string").alias("month_end"), F.trunc(day, "month").cast("string").alias("month_start"), F.add_months(day, 2).cast("string").alias("plus2"), F.hour(c).alias("h"))


@query("""SELECT c_custkey, upper(c_name) AS up, lower(c_mktsegment) AS low, CAST(length(c_name) AS INT) AS n, substr(c_name, 1, 4) AS head, c_mktsegment || '-' || CAST(c_nationkey AS VARCHAR) AS tag,
  replace(c_name, '#', '_') AS safe, regexp_extract(c_name, '([0-9]+)', 1) AS digits, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS padded, rpad(c_mktsegment, 12, '.') AS wide, reverse(c_mktsegment) AS back,
  CAST(instr(c_name, '#') AS INT) AS at, translate(c_mktsegment, 'AEIOU', 'aeiou') AS vowels, trim('  ' || c_mktsegment || ' ') AS trimmed, split_part(c_name, '#', 1) AS part1, concat_ws('|', c_mktsegment, NULL, c_name) AS joined FROM customer""")
def derive_strings(spark, d):
    name, seg, key = F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")
    return table(spark, d, "customer").select(
        "c_custkey", F.upper(name).alias("up"), F.lower(seg).alias("low"), F.length(name).alias("n"), F.substring(name, 1, 4).alias("head"), F.concat(seg, F.lit("-"), key).alias("tag"), F.regexp_replace(name, "#", "_").alias("safe"),
        F.regexp_extract(name, "([0-9]+)", 1).alias("digits"), F.lpad(key, 4, "0").alias("padded"), F.rpad(seg, 12, ".").alias("wide"), F.reverse(seg).alias("back"), F.instr(name, "#").alias("at"), F.translate(seg, "AEIOU", "aeiou").alias("vowels"),
        F.trim(F.concat(F.lit("  "), seg, F.lit(" "))).alias("trimmed"), F.split_part(name, F.lit("#"), F.lit(1)).alias("part1"), F.concat_ws("|", seg, F.lit(None).cast("string"), name).alias("joined"))


@query("""SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS fl, CAST(ceil(p_retailprice) AS BIGINT) AS ce, abs(p_size - 25) AS dist, sqrt(p_size) AS root, power(p_size, 2) AS sq, round(ln(p_retailprice), 6) AS logp,
  round(log10(p_retailprice), 6) AS log10p, greatest(p_size, 10) AS hi, least(p_size, 10) AS lo, CAST(sign(p_size - 25) AS DOUBLE) AS sg, round(exp(p_size / 50.0), 6) AS e, round(sin(p_size), 6) AS s, round(atan(p_size), 6) AS at FROM part""")
def derive_math(spark, d):
    p, s = F.col("p_retailprice"), F.col("p_size")
    return table(spark, d, "part").select("p_partkey", F.floor(p).alias("fl"), F.ceil(p).alias("ce"), F.abs(s - 25).alias("dist"), F.sqrt(s).alias("root"), F.pow(s, 2).alias("sq"), F.round(F.log(p), 6).alias("logp"), F.round(F.log10(p), 6).alias("log10p"), F.greatest(s, F.lit(10)).alias("hi"), F.least(s, F.lit(10)).alias("lo"), F.signum(s - 25).alias("sg"), F.round(F.exp(s / F.lit(50.0)), 6).alias("e"), F.round(F.sin(s), 6).alias("s"), F.round(F.atan(s), 6).alias("at"))


@query("""SELECT e.event_id, nullif(event_type, 'view') AS nv, coalesce(nullif(event_type, 'view'), 'seen') AS filled, nullif(event_type, 'view') IS NULL AS missing,
  CASE WHEN nullif(event_type, 'view') IS NOT NULL THEN 1 ELSE 0 END AS has, ifnull(nullif(user_id, 1), 0) AS u FROM events e""")
def derive_nulls(spark, d):
    nv = F.nullif(F.col("event_type"), F.lit("view"))
    return table(spark, d, "events").select("event_id", nv.alias("nv"), F.coalesce(nv, F.lit("seen")).alias("filled"), nv.isNull().alias("missing"), F.nvl2(nv, F.lit(1), F.lit(0)).alias("has"), F.nvl(F.nullif(F.col("user_id"), F.lit(1)), F.lit(0)).cast("bigint").alias("u"))


@query("SELECT md5(c_name) AS m, sha1(c_name) AS s1, sha256(c_name) AS s2, to_base64(encode(c_mktsegment)) AS b64, c_custkey FROM customer")
def derive_hashes(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select(F.md5(name).alias("m"), F.sha1(name).alias("s1"), F.sha2(name, 256).alias("s2"), F.base64(F.encode(F.col("c_mktsegment"), "utf-8")).alias("b64"), "c_custkey")


@query("SELECT s_suppkey AS supplier_key, s_name AS supplier, s_nationkey FROM supplier")
def derive_rename(spark, d):
    return table(spark, d, "supplier").withColumnRenamed("s_suppkey", "supplier_key").withColumnRenamed("s_name", "supplier").drop("s_acctbal")


@query("SELECT n_nationkey AS n_nationkey_dim, n_name AS n_name_dim, n_regionkey AS n_regionkey_dim FROM nation")
def suffix_rename(spark, d):
    return rename_with_suffix(table(spark, d, "nation"), "_dim")


@query("SELECT * EXCLUDE (p_retailprice, p_type) FROM part")
def drop_columns(spark, d):
    return table(spark, d, "part").drop("p_retailprice", "p_type")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'gold' WHEN o_totalprice > 150000 AND o_orderstatus <> 'F' THEN 'silver' WHEN o_orderpriority LIKE '1-%' THEN 'urgent' ELSE 'base' END AS tier FROM orders")
def when_chain_tier(spark, d):
    tier = F.when(F.col("o_totalprice") > 300000, "gold").when((F.col("o_totalprice") > 150000) & (F.col("o_orderstatus") != "F"), "silver").when(F.col("o_orderpriority").like("1-%"), "urgent").otherwise("base")
    return table(spark, d, "orders").select("o_orderkey", tier.alias("tier"))


_PREDICATES = {"big": "l_quantity > 40", "cheap": "l_extendedprice < 20000", "returned": "l_returnflag = 'R'"}


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_extendedprice < 20000 THEN 'cheap' WHEN l_returnflag = 'R' THEN 'returned' END AS rule FROM lineitem")
def predicate_dict_first_match(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rule_value(_PREDICATES).alias("rule"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity > 40 THEN 'big' END, CASE WHEN l_extendedprice < 20000 THEN 'cheap' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS rules FROM lineitem""")
def predicate_dict_array(spark, d):
    hits = F.filter(F.array(*[F.when(F.expr(p), F.lit(k)) for k, p in _PREDICATES.items()]), lambda x: x.isNotNull())
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(hits, ",").alias("rules"))


@query("""SELECT o_orderkey, kind, value FROM orders, LATERAL (VALUES ('status', o_orderstatus), ('priority', o_orderpriority)) AS v(kind, value)""")
def struct_fields(spark, d):
    pairs = F.array(F.struct(F.lit("status").alias("kind"), F.col("o_orderstatus").alias("value")), F.struct(F.lit("priority").alias("kind"), F.col("o_orderpriority").alias("value")))
    return table(spark, d, "orders").select("o_orderkey", F.inline(pairs))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("""SELECT o_custkey, CAST(len(l) AS BIGINT) AS n, array_to_string(list_sort(l), ',') AS all_status, array_to_string(list_transform(list_sort(l), lambda x: x || '!'), ',') AS marked,
  CAST(len(list_filter(l, lambda x: x <> 'F')) AS BIGINT) AS open, list_contains(l, 'P') AS has_p FROM (SELECT o_custkey, list(DISTINCT o_orderstatus) AS l FROM orders GROUP BY o_custkey)""")
def higher_order(spark, d):
    s = F.sort_array(F.collect_set("o_orderstatus"))
    held = table(spark, d, "orders").groupBy("o_custkey").agg(s.alias("l"))
    return held.select("o_custkey", F.size("l").cast("bigint").alias("n"), F.array_join("l", ",").alias("all_status"), F.array_join(F.transform("l", lambda x: F.concat(x, F.lit("!"))), ",").alias("marked"), F.size(F.filter("l", lambda x: x != "F")).cast("bigint").alias("open"), F.array_contains("l", "P").alias("has_p"))


# ---- filters -------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 30 AND l_discount < 0.05) OR (l_returnflag = 'R' AND NOT l_linestatus = 'O')")
def filter_compound(spark, d):
    return table(spark, d, "lineitem").filter(((F.col("l_quantity") > 30) & (F.col("l_discount") < 0.05)) | ((F.col("l_returnflag") == "R") & ~(F.col("l_linestatus") == "O"))).select("l_orderkey", "l_linenumber")


@query("""SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 30 AND p_brand IN (SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE '%1') AND p_name NOT LIKE '%zz%' AND regexp_matches(p_type, '[A-Z]') AND p_type ILIKE '%e%'""")
def filter_in_like_between(spark, d):
    part = table(spark, d, "part")
    brands = part.filter(F.col("p_brand").like("%1")).select("p_brand").distinct()
    return part.filter(F.col("p_size").between(10, 30) & ~F.col("p_name").like("%zz%") & F.col("p_type").rlike("[A-Z]") & F.col("p_type").ilike("%e%")).join(brands, "p_brand", "left_semi").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' AND o_orderpriority IS NOT DISTINCT FROM '1-URGENT'")
def filter_range_nullsafe(spark, d):
    c = F.col("o_orderdate")
    return table(spark, d, "orders").filter((c >= F.lit("1995-01-01").cast("timestamp_ntz")) & (c < F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("o_orderpriority").eqNullSafe("1-URGENT")).select("o_orderkey")


# ---- joins ---------------------------------------------------------------------------------------


def _orders_customers(spark, d):
    return table(spark, d, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey"), table(spark, d, "customer").filter("c_acctbal > 0").select("c_custkey", "c_mktsegment")


_O = "(SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000) o"
_C = "(SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0) c"


def _join_query(name: str, how: str, sql: str) -> None:
    def run(spark, d):
        o, c = _orders_customers(spark, d)
        return o.join(c, o.o_custkey == c.c_custkey, how)

    query(sql, name)(run)


for _name, _how, _word in (("join_inner", "inner", "JOIN"), ("join_left", "left", "LEFT JOIN"), ("join_right", "right", "RIGHT JOIN"), ("join_full", "full", "FULL JOIN")):
    _join_query(_name, _how, f"SELECT * FROM {_O} {_word} {_C} ON o_custkey = c_custkey")
_join_query("join_semi", "left_semi", f"SELECT * FROM {_O} WHERE EXISTS (SELECT 1 FROM {_C} WHERE o_custkey = c_custkey)")
_join_query("join_anti", "left_anti", f"SELECT * FROM {_O} WHERE NOT EXISTS (SELECT 1 FROM {_C} WHERE o_custkey = c_custkey)")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, d):
    # two tables of fixed size
    return table(spark, d, "region").select("r_name").crossJoin(table(spark, d, "nation").select("n_name"))


@query("SELECT key, n_name, s_name FROM (SELECT n_nationkey AS key, n_name FROM nation) JOIN (SELECT s_nationkey AS key, s_name FROM supplier) USING (key)")
def join_using(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), "n_name").join(table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), "s_name"), ["key"])


@query("""SELECT a.s_suppkey AS low, b.s_suppkey AS high FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal""")
def join_theta(spark, d):
    s = table(spark, d, "supplier")
    a, b = s.alias("a"), s.alias("b")
    return a.join(b, (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_acctbal") < F.col("b.s_acctbal"))).select(F.col("a.s_suppkey").alias("low"), F.col("b.s_suppkey").alias("high"))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN (SELECT c_custkey, c_name, c_nationkey FROM customer) ON o_custkey = c_custkey JOIN (SELECT n_nationkey, n_name FROM nation) ON c_nationkey = n_nationkey")
def join_projected_side(spark, d):
    c, n = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), table(spark, d, "nation").select("n_nationkey", "n_name")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query("""SELECT e.event_id, (SELECT max(s.ts) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup' AND s.ts <= e.ts) AS signed_at FROM events e WHERE e.event_type = 'purchase'""")
def join_asof(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'signup'").select("user_id", "ts", F.col("ts").alias("signed_at"))
    return asof_join(left, right, ["user_id"], "ts", ["signed_at"]).select("event_id", "signed_at")


# ---- aggregations --------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue,
  round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def agg_multi(spark, d):
    held = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return held.groupBy("l_returnflag", "l_linestatus").agg(total("l_quantity", "sum_qty"), total(F.col("l_extendedprice") * (1 - F.col("l_discount")), "revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderstatus) AS states, count(*) AS n FROM orders GROUP BY ALL")
def agg_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct("o_orderstatus").alias("states"), F.count("*").alias("n"))


@query("SELECT c_mktsegment, round(stddev(c_acctbal), 4) AS sd, round(var_samp(c_acctbal), 2) AS var, round(avg(c_acctbal), 4) AS mean, count(*) AS n FROM customer GROUP BY ALL")
def agg_stats(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.stddev(b), 4).alias("sd"), F.round(F.variance(b), 2).alias("var"), F.round(F.avg(b), 4).alias("mean"), F.count("*").alias("n"))


@query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS states, CAST(len(list(o_orderkey)) AS BIGINT) AS n FROM orders GROUP BY ALL")
def agg_collect(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("states"), F.size(F.collect_list("o_orderkey")).cast("bigint").alias("n"))


@query("""SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS o, count(*) FILTER (l_linestatus = 'F') AS f, CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(18,4)) ELSE 0 END) AS DOUBLE) AS f_qty FROM lineitem GROUP BY ALL""")
def agg_pivot_conditional(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_linestatus") == "F").alias("f"), F.sum(F.when(F.col("l_linestatus") == "F", money("l_quantity")).otherwise(F.lit(0).cast("decimal(18,4)"))).cast("double").alias("f_qty"))


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY ALL""")
def agg_pivot(spark, d):
    return table(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.count(F.lit(1))).fillna(0)


_GROUPED = "CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS revenue, count(*) AS n FROM orders GROUP BY"


@query(f"SELECT o_orderstatus, o_orderpriority, {_GROUPED} ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(total("o_totalprice", "revenue"), F.count("*").alias("n"))


@query(f"SELECT o_orderstatus, o_orderpriority, {_GROUPED} CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(total("o_totalprice", "revenue"), F.count("*").alias("n"))


@query(f"SELECT o_orderstatus, o_orderpriority, {_GROUPED} GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark, d):
    orders = table(spark, d, "orders")
    return orders.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(total("o_totalprice", "revenue"), F.count("*").alias("n"))


@query("""SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS spent FROM orders GROUP BY o_custkey HAVING count(*) >= 5""")
def agg_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(total("o_totalprice", "spent"), F.count("*").alias("n")).filter("n >= 5").drop("n")


# ---- windows -------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def win_dedupe_latest(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


@query("""SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS rn, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS INT) AS rk,
  CAST(dense_rank() OVER (ORDER BY s_nationkey) AS INT) AS dr, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), 6) AS cd FROM supplier""")
def win_rank_family(spark, d):
    by = Window.partitionBy("s_nationkey")
    key = by.orderBy("s_suppkey")
    nations = table(spark, d, "supplier").select("s_nationkey").distinct()  # 25 at most: a global window over few rows
    dense = nations.withColumn("dr", F.dense_rank().over(Window.orderBy("s_nationkey")))
    ranked = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.row_number().over(by.orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("rn"), F.rank().over(by.orderBy("s_name")).alias("rk"), F.round(F.percent_rank().over(key), 6).alias("pr"), F.round(F.cume_dist().over(key), 6).alias("cd"))
    return ranked.join(dense, "s_nationkey").drop("s_nationkey")


@query("SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS INT) AS quartile FROM customer")
def win_ntile(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")).alias("quartile"))


@query("""SELECT event_id, lag(event_type) OVER w AS before, lead(event_type, 2) OVER w AS after2, first_value(event_type) OVER w AS opening, last_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_lag_lead(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "events").select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type", 2).over(w).alias("after2"), F.first("event_type").over(w).alias("opening"), F.last("event_id").over(whole).alias("final"))


@query("""SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last3,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM orders""")
def win_frame_rows(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", F.sum(money("o_totalprice")).over(w.rowsBetween(-2, 0)).cast("double").alias("last3"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("nth"))


@query("""SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM part""")
def win_frame_range(spark, d):
    return table(spark, d, "part").select("p_partkey", F.count("*").over(Window.partitionBy("p_brand").orderBy("p_size").rangeBetween(-5, 5)).alias("near"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh, event_id FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
SELECT user_id, CAST(sid AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY ALL""")
def win_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.expr("ts - interval 6 hours") <= F.lag("ts").over(w)
    marked = table(spark, d, "events").withColumn("fresh", F.when(gap, 0).otherwise(1))
    return marked.withColumn("session", F.sum("fresh").over(w)).groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count("*").alias("n"))


# ---- sets, sorts, limits -------------------------------------------------------------------------


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_union(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).union(table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k"))).distinct()


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_union_all(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).unionByName(table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal < 5000")
def set_intersect(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).intersect(table(spark, d, "customer").filter("c_acctbal < 5000").select(F.col("c_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'O' EXCEPT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def set_except_all(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'O'").select("o_orderpriority").exceptAll(o.filter("o_orderstatus = 'P'").select("o_orderpriority"))


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_rows(spark, d):
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) <= 2""")
def topk_per_group(spark, d):
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    return table(spark, d, "supplier").withColumn("rn", F.row_number().over(w)).filter("rn <= 2").select("s_nationkey", "s_suppkey", "s_acctbal")


@query("""SELECT c_custkey, c_name, c_acctbal + 100 AS c_acctbal FROM customer WHERE c_nationkey = 3 UNION ALL SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey <> 3 UNION ALL SELECT -1 - s_suppkey, s_name, s_acctbal FROM supplier""")
def upsert_merge(spark, d):
    c = table(spark, d, "customer")
    target = c.select("c_custkey", "c_name", "c_acctbal")
    changed = c.filter("c_nationkey = 3").select("c_custkey", "c_name", (F.col("c_acctbal") + 100).alias("c_acctbal"))
    fresh = table(spark, d, "supplier").select((-1 - F.col("s_suppkey")).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return upsert(target, changed.unionByName(fresh), ["c_custkey"])


QUERIES, SQL = query.queries, query.sql
