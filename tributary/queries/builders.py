"""The column builders and predicates that pipelines are written with, and the formats they read, family by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path
from .registry import Registry
from .tables import table

query = Registry()


@query("""SELECT o_orderkey, 'status,priority' AS keys, o_orderstatus || ',' || o_orderpriority AS vals, o_orderstatus AS one, CAST(NULL AS VARCHAR) AS absent, 2 AS n, 'priority' AS kept, 'a=' || o_orderstatus || ';b=' || o_orderpriority AS paired, 'k:' || o_orderstatus AS built,
  true AS has_status, 'status!,priority!' AS renamed, o_orderstatus || '?,' || o_orderpriority || '?' AS asked FROM orders""")
def build_maps(spark, d):
    """create_map, map_from_arrays, map_from_entries, named_struct and what is asked of maps."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    m = F.create_map(F.lit("status"), s, F.lit("priority"), p)
    pairs = F.map_entries(F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(s, p)))
    entry = F.named_struct(F.lit("k"), F.lit("k"), F.lit("v"), s)
    return table(spark, d, "orders").select(
        "o_orderkey", F.array_join(F.map_keys(m), ",").alias("keys"), F.array_join(F.map_values(m), ",").alias("vals"), F.element_at(m, F.lit("status")).alias("one"), F.try_element_at(m, F.lit("none")).alias("absent"), F.size(m).alias("n"),
        F.array_join(F.map_keys(F.map_filter(m, lambda k, v: k != "status")), ",").alias("kept"), F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("paired"),
        F.concat_ws(":", F.map_keys(F.map_from_entries(F.array(entry)))[0], F.map_values(F.map_from_entries(F.array(entry)))[0]).alias("built"), F.map_contains_key(m, "status").alias("has_status"),
        F.array_join(F.map_keys(F.transform_keys(m, lambda k, v: F.concat(k, F.lit("!")))), ",").alias("renamed"), F.array_join(F.map_values(F.transform_values(m, lambda k, v: F.concat(v, F.lit("?")))), ",").alias("asked"))


_A = "[o_orderstatus, 'F', 'O', o_orderstatus]"


@query(f"""SELECT o_orderkey, array_to_string(list_sort(list_distinct({_A})), ',') AS distinct_, array_to_string(list_sort(list_distinct(list_concat({_A}, ['F', 'P']))), ',') AS union_, array_to_string(list_sort(list_distinct(list_intersect({_A}, ['F', 'P']))), ',') AS both_,
  array_to_string(list_sort(list_distinct(list_filter({_A}, lambda x: x NOT IN ('F', 'P')))), ',') AS except_, list_contains({_A}, 'P') AS has_p, CAST(list_position({_A}, 'O') AS BIGINT) AS at_o, array_to_string(list_sort({_A}), ',') AS sorted_,
  array_to_string(list_concat({_A}, ['F', 'P']), '') AS flat, array_to_string(range(1, o_orderkey % 4 + 2), ',') AS counted, len(list_filter({_A}, lambda x: x = 'P')) > 0 AS some_p, len(list_filter({_A}, lambda x: x = 'P')) = 4 AS all_p, {_A}[2] AS second, 4 AS n, array_to_string(list_reverse({_A}), '') AS back, 'F' AS least, array_to_string({_A}[2:3], '') AS part FROM orders""")
def build_arrays(spark, d):
    """Set and order functions of arrays, nested ones flattened, and questions about all or some elements."""
    a = F.array("o_orderstatus", F.lit("F"), F.lit("O"), F.col("o_orderstatus"))
    b = F.array(F.lit("F"), F.lit("P"))
    text = lambda x: F.array_join(x, ",")
    return table(spark, d, "orders").select(
        "o_orderkey", text(F.array_sort(F.array_distinct(a))).alias("distinct_"), text(F.array_sort(F.array_union(a, b))).alias("union_"), text(F.array_sort(F.array_intersect(a, b))).alias("both_"), text(F.array_sort(F.array_except(a, b))).alias("except_"),
        F.array_contains(a, "P").alias("has_p"), F.array_position(a, "O").alias("at_o"), text(F.array_sort(a)).alias("sorted_"), F.array_join(F.flatten(F.array(a, b)), "").alias("flat"), text(F.sequence(F.lit(1), F.col("o_orderkey") % 4 + 1)).alias("counted"),
        F.exists(a, lambda x: x == "P").alias("some_p"), F.forall(a, lambda x: x == "P").alias("all_p"), F.element_at(a, 2).alias("second"), F.size(a).alias("n"), F.array_join(F.reverse(a), "").alias("back"), F.array_min(F.array(F.lit("O"), F.lit("F"))).alias("least"), F.array_join(F.slice(a, 2, 2), "").alias("part"))


@query("""SELECT c_custkey, CAST(i - 1 AS INT) AS pos, string_split(c_name, '#')[i] AS part FROM customer, unnest(range(1, len(string_split(c_name, '#')) + 1)) AS u(i)""")
def explode_positions(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.posexplode(F.split("c_name", "#")).alias("pos", "part"))


@query("""SELECT s_suppkey, CAST(x AS INT) AS x FROM supplier, unnest([1, 2]) AS u(x) WHERE s_acctbal > 0 UNION ALL SELECT s_suppkey, NULL FROM supplier WHERE s_acctbal <= 0 OR s_acctbal IS NULL""")
def explode_keeping_empty(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.explode_outer(F.when(F.col("s_acctbal") > 0, F.array(F.lit(1), F.lit(2)))).alias("x"))


@query("""SELECT p_partkey, ltrim('  ' || p_brand) AS l, rtrim(p_brand || '  ') AS r, substr(p_type, 2, 3) AS mid, printf('%05d-%s', p_size, p_brand) AS shown, format('{:,.2f}', p_retailprice) AS money, CAST(len(string_split(p_type, ' ')) AS INT) AS words, initcap AS capital,
  starts_with(p_type, 'S') AS s, contains(p_type, 'A') AS a, CAST(ascii(p_brand) AS INT) AS code, repeat(p_brand, 2) AS twice, CAST(strpos(p_type, 'A') AS INT) AS place, left(p_brand, 3) AS le, right(p_brand, 2) AS ri
  FROM (SELECT *, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS initcap FROM part)""")
def build_strings(spark, d):
    b, t = F.col("p_brand"), F.col("p_type")
    return table(spark, d, "part").select(
        "p_partkey", F.ltrim(F.concat(F.lit("  "), b)).alias("l"), F.rtrim(F.concat(b, F.lit("  "))).alias("r"), t.substr(2, 3).alias("mid"), F.format_string("%05d-%s", "p_size", "p_brand").alias("shown"), F.format_number("p_retailprice", 2).alias("money"), F.size(F.split(t, " ")).alias("words"), F.initcap(t).alias("capital"),
        t.startswith("S").alias("s"), t.contains("A").alias("a"), F.ascii(b).alias("code"), F.repeat(b, 2).alias("twice"), F.locate("A", t).alias("place"), F.left(b, F.lit(3)).alias("le"), F.right(b, F.lit(2)).alias("ri"))


@query("""SELECT p_partkey, round_even(p_retailprice, 1) AS bankers, round(log2(p_retailprice), 6) AS l2, round(cos(p_size), 6) AS c, round(tan(p_size), 6) AS t, round(asin(p_size / 50.0), 6) AS ia, round(acos(p_size / 50.0), 6) AS ic, round(atan(p_size), 6) AS it, round(cbrt(p_size), 6) AS cube,
  p_size % 7 AS rest, CAST(p_size // 7 AS BIGINT) AS whole, round(degrees(p_size), 6) AS deg, CAST(p_size & 12 AS INT) AS band, CAST(p_size | 3 AS INT) AS bor, CAST(xor(p_size, 5) AS INT) AS bxor, CAST(bit_count(p_size) AS INT) AS ones, isnan(CAST(p_size AS DOUBLE)) AS nan FROM part""")
def build_math(spark, d):
    p, s = F.col("p_retailprice"), F.col("p_size")
    r = lambda x: F.round(x, 6)
    return table(spark, d, "part").select(
        "p_partkey", F.bround(p, 1).alias("bankers"), r(F.log2(p)).alias("l2"), r(F.cos(s)).alias("c"), r(F.tan(s)).alias("t"), r(F.asin(s / 50.0)).alias("ia"), r(F.acos(s / 50.0)).alias("ic"), r(F.atan(s)).alias("it"), r(F.cbrt(s)).alias("cube"), (s % 7).alias("rest"), F.expr("p_size div 7").alias("whole"), r(F.degrees(s)).alias("deg"),
        s.bitwiseAND(12).alias("band"), s.bitwiseOR(3).alias("bor"), s.bitwiseXOR(5).alias("bxor"), F.bit_count(s).alias("ones"), F.isnan(s.cast("double")).alias("nan"))


@query("""SELECT event_id, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(second(ts) AS INT) AS s, CAST(dayofweek(ts) + 1 AS INT) AS dow, CAST(CAST(ts AS DATE) - 3 AS VARCHAR) AS before, CAST(date_diff('month', date_trunc('month', ts), DATE '1995-01-01') AS DOUBLE) AS months, strftime(ts, '%Y-%m-%d %H:%M:%S') AS back,
  strftime(CAST(ts AS DATE) + CAST((8 - isodow(ts)) AS INT), '%Y-%m-%d') AS monday, true AS today, strftime(ts, '%d.%m.%Y %H:%M') AS german, CAST(weekofyear(ts) AS INT) AS week, strftime(make_date(CAST(year(ts) AS INT), 1, 1), '%Y-%m-%d') AS year_start FROM events""")
def build_dates(spark, d):
    """Parts and arithmetic of times; the round trip through seconds does not depend on the session's zone."""
    t = F.col("ts")
    day = F.to_date(t)
    return table(spark, d, "events").select(
        "event_id", F.hour(t).alias("h"), F.minute(t).alias("mi"), F.second(t).alias("s"), F.dayofweek(t).alias("dow"), F.date_sub(day, 3).cast("string").alias("before"), F.months_between(F.lit("1995-01-01").cast("date"), F.trunc(day, "month")).alias("months"), F.from_unixtime(F.unix_timestamp(t.cast("timestamp"))).alias("back"), F.next_day(day, "Mon").cast("string").alias("monday"),
        (F.current_date() >= F.lit("2020-01-01").cast("date")).alias("today"), F.date_format(F.to_timestamp(F.date_format(t, "dd/MM/yyyy HH:mm"), "dd/MM/yyyy HH:mm"), "dd.MM.yyyy HH:mm").alias("german"), F.weekofyear(t).alias("week"), F.trunc(day, "year").cast("string").alias("year_start"))


@query("SELECT c_custkey, c_name AS back, CAST(NULL AS VARCHAR) AS none, coalesce(nullif(c_mktsegment, 'BUILDING'), '?') AS i, true AS same_hash FROM customer")
def build_encodings(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", F.decode(F.unbase64(F.base64(F.encode(n, "utf-8"))), "utf-8").alias("back"), F.decode(F.encode(F.lit(None).cast("string"), "utf-8"), "utf-8").alias("none"), F.ifnull(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("?")).alias("i"),
        ((F.hash(n) == F.hash(F.concat(n, F.lit("")))) & (F.xxhash64(n) == F.xxhash64(F.concat(n, F.lit("")))) & (F.crc32(n) == F.crc32(F.concat(n, F.lit(""))))).alias("same_hash"))


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS once, round((avg(l_quantity ^ 3) - 3 * avg(l_quantity) * avg(l_quantity ^ 2) + 2 * avg(l_quantity) ^ 3) / var_pop(l_quantity) ^ 1.5, 4) AS skew,
  round((avg(l_quantity ^ 4) - 4 * avg(l_quantity) * avg(l_quantity ^ 3) + 6 * avg(l_quantity) ^ 2 * avg(l_quantity ^ 2) - 3 * avg(l_quantity) ^ 4) / var_pop(l_quantity) ^ 2 - 3, 4) AS kurt, true AS near, round(quantile_cont(l_quantity, 0.5), 6) AS mid FROM lineitem GROUP BY ALL""")
def agg_moments(spark, d):
    """mean, sum_distinct, skewness, kurtosis, median and whether the approximate distinct count is within a tenth."""
    q = F.col("l_quantity")
    near = F.abs(F.approx_count_distinct("l_partkey", 0.02) / F.countDistinct("l_partkey") - 1) <= 0.1
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.mean(q), 6).alias("mean"), F.sum_distinct("l_linenumber").cast("bigint").alias("once"), F.round(F.skewness(q), 4).alias("skew"), F.round(F.kurtosis(q), 4).alias("kurt"), near.alias("near"), F.round(F.median(q), 6).alias("mid"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority ILIKE '%URGENT' AND regexp_matches(o_orderpriority, '^[1-5]-') AND contains(o_orderpriority, 'U') AND starts_with(o_orderpriority, '1') AND ends_with(o_orderpriority, 'T') AND o_totalprice BETWEEN 1000 AND 400000
  AND o_custkey IS NOT NULL AND NOT (o_orderdate IS NULL) AND (o_orderkey & 1) = 1 AND substr(o_orderpriority, 1, 1) = '1' AND CAST(o_orderkey AS VARCHAR) <> '7'""")
def filter_vocabulary(spark, d):
    """All predicates of columns in one filter."""
    s, p, k = F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey")
    keep = s.isin("F", "P") & p.ilike("%urgent") & p.rlike("^[1-5]-") & p.contains("U") & p.startswith("1") & p.endswith("T") & F.col("o_totalprice").between(1000, 400000) & F.col("o_custkey").isNotNull() & ~F.col("o_orderdate").isNull()
    return table(spark, d, "orders").filter(keep & (k.bitwiseAND(1) == 1) & (p.substr(1, 1) == "1") & ~k.cast("string").eqNullSafe("7")).select("o_orderkey")


@query("""SELECT event_id, k, CAST(k % 2 AS BIGINT) AS odd, k AS again FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def json_typed(spark, d):
    """from_json with a schema, getField, getItem and to_json."""
    parsed = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    boxed = F.from_json(F.to_json(F.struct(F.array(F.col("p").getField("k")).alias("xs"))), "xs array<bigint>")
    return parsed.select("event_id", F.col("p").getField("k").alias("k"), (F.col("p.k") % 2).alias("odd"), boxed["xs"].getItem(0).alias("again"))


@query("SELECT format, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('csv'), ('json'), ('orc'), ('parquet'), ('text')) AS f(format)")
def read_formats(spark, d):
    """A table written and read again in every format that needs no further jar."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    whole = None
    for name in ("csv", "json", "orc", "parquet", "text"):
        path = scratch_path(spark, name)
        if name == "text":
            nation.select(F.concat_ws("\t", *nation.columns).alias("value")).write.text(path)
            parts = F.split("value", "\t")
            back = spark.read.text(path).select(*(parts[i].cast(f.dataType).alias(f.name) for i, f in enumerate(nation.schema.fields)))
        else:
            nation.write.format(name).option("header", True).save(path)
            back = spark.read.format(name).option("header", True).schema(nation.schema).load(path)
        back = back.withColumn("format", F.lit(name))
        whole = back if whole is None else whole.unionByName(back)
    return whole


@query("SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def set_except_some(spark, d):
    """A difference that leaves rows."""
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").filter("s_acctbal > 8000").select("s_nationkey"))


QUERIES, SQL = query.queries, query.sql
