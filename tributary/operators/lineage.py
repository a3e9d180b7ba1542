"""Lineage queries over one relation of typed edges.

An edge has kind, source, right_source, target and, by kind, output_col and source_cols (derives), aggs
and group_keys (aggregates), kept_cols or removed_cols (projects), is_passthrough (opaque transforms). A
graph is what shares a ``graph_id``; every query answers all graphs at once.

The resolver walks from written tables back to the tables read, one frontier join a round. A column that
a node computes follows the columns it is computed from, all of them; any other column passes through.
A column's role is that of the computation nearest the written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, partitions
from .closure import closure

UNRESOLVED = "<unresolved>"


def is_table(column: str) -> Column:
    return F.col(column).startswith("table:") | F.col(column).startswith("ext:")


def column_steps(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(computed, passing): how columns of a target come from its sources.

    computed: graph_id, node, col, from_node, from_col, role; passing: graph_id, node, from_node, only
    (the columns that pass, or null for all), without (those that do not).
    """
    base = ["graph_id", F.col("target").alias("node"), F.col("source").alias("from_node")]
    derived = edges.filter("kind = 'derives' and output_col is not null")
    role = F.lit("derived")
    by_column = derived.select(*base, F.col("output_col").alias("col"), F.explode_outer(F.array_distinct("source_cols")).alias("from_col"), role.alias("role"))
    grouped = edges.filter("kind = 'aggregates'")
    values = grouped.select(*base, F.explode("aggs").alias("agg")).select("graph_id", "node", "from_node", F.col("agg.output").alias("col"), F.col("agg.input").alias("from_col"), F.lit("aggregate").alias("role"))
    keys = grouped.select(*base, F.explode("group_keys").alias("col")).select("graph_id", "node", "from_node", "col", F.col("col").alias("from_col"), F.lit("group_key").alias("role"))
    computed = by_column.unionByName(values).unionByName(keys).filter("col is not null").distinct()
    none = F.lit(None).cast("array<string>")
    removed = F.col("removed_cols") if "removed_cols" in edges.columns else none
    if "removed_cols" in edges.columns:  # what a rename takes away passes none of the derivations of its node
        renamed = F.array_distinct(F.flatten(F.collect_list("removed_cols")))
        derives = derived.groupBy(*base).agg(renamed.alias("without")).select("graph_id", "node", "from_node", none.alias("only"), F.when(F.size("without") > 0, F.col("without")).alias("without"))
    else:
        derives = derived.select(*base, none.alias("only"), none.alias("without"))
    moving = edges.filter("kind in ('filters', 'reads', 'writes', 'projects') or (kind = 'derives' and output_col is null) or (kind = 'opaque_transform' and is_passthrough)")
    plain = moving.select(*base, F.when(F.col("kind") == "projects", F.col("kept_cols")).alias("only"), F.when(F.col("kind") == "projects", removed).alias("without"))
    # a semi or anti join gives the columns of its left side only
    both = F.when(F.col("join_type").isin("left_semi", "left_anti"), F.array("source")).otherwise(F.array("source", "right_source")) if "join_type" in edges.columns else F.array("source", "right_source")
    sides = edges.filter("kind = 'joins'").select("graph_id", F.col("target").alias("node"), F.explode(both).alias("from_node"), none.alias("only"), none.alias("without"))
    return computed, plain.unionByName(derives).unionByName(sides).filter("from_node is not null").distinct()


PROVENANCE = "graph_id string, `table` string, `column` string, role string, from_table string, from_column string"


def _walk(rows) -> list[tuple]:
    """Provenance of one graph from its steps (kind, node, col, from_node, from_col, role, only, without)."""
    computed: dict[tuple, list] = {}
    passing: dict[str, list] = {}
    wanted: list[tuple] = []
    for kind, node, col, from_node, from_col, role, only, without in rows:
        if kind == "c":
            computed.setdefault((node, col), []).append((from_node, from_col, role))
        elif kind == "p":
            passing.setdefault(node, []).append((from_node, None if only is None else frozenset(only), frozenset(without if without is not None else ())))
        else:
            wanted.append((from_node, from_col, node, col))
    found: dict[tuple, str] = {}
    starts: dict[tuple, list] = {}
    for table, column, node, col in wanted:
        starts.setdefault((table, column), []).append((node, col))
    for (table, column), begin in starts.items():
        seen, frontier = set(), {(node, col): "passthrough" for node, col in begin}
        while frontier:
            fresh: dict[tuple, str] = {}
            for (node, col), role in frontier.items():
                seen.add((node, col))
                if node.startswith(("table:", "ext:")):
                    key = (table, column, node, col)
                    found[key] = min(found.get(key, role), role)
                    continue
                steps = computed.get((node, col))
                if steps is not None:
                    reached = [((f, c), r if role == "passthrough" else role) for f, c, r in steps if c is not None and f is not None]
                else:
                    reached = [((f, col), role) for f, only, without in passing.get(node, ()) if (only is None or col in only) and col not in without]
                for state, r in reached:
                    if state not in seen:
                        fresh[state] = min(fresh.get(state, r), r)
            frontier = fresh
    return [(table, column, role, node, col) for (table, column, node, col), role in found.items()]


def _local(steps: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        def flush(graph, rows):
            found = _walk(rows)
            columns = [pa.array([graph] * len(found), pa.string()), *(pa.array([f[i] for f in found], pa.string()) for i in range(5))]
            return pa.RecordBatch.from_arrays(columns, names=["graph_id", "table", "column", "role", "from_table", "from_column"])

        graph, held = None, []
        for batch in batches:
            for g, *row in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if g != graph and held:
                    yield flush(graph, held)
                    held = []
                graph = g
                held.append(row)
        if held:
            yield flush(graph, held)

    return steps.repartition(partitions(steps.sparkSession), "graph_id").sortWithinPartitions("graph_id").mapInArrow(run, PROVENANCE)


def provenance(edges: DataFrame, wanted: DataFrame | None = None, columns: DataFrame | None = None, group_rows: int = 200_000) -> DataFrame:
    """(graph_id, table, column, role, from_table, from_column) of every column of every written table.

    ``wanted`` names (graph_id, table, column) to resolve; without it these are the columns that some
    node upstream of a write computes or keeps. ``columns`` (node, col) gives the known schema of nodes
    and tables; a node in it passes only its own columns. What cannot be followed further is left out.
    Graphs up to ``group_rows`` steps are walked in one task each, larger ones by distributed joins, with
    the same result.
    """
    edges = durable(edges.filter("graph_id is not null"), "edges")
    computed, passing = (durable(x, "steps") for x in column_steps(edges))
    writes = edges.filter("kind = 'writes' and target is not null and source is not null").select("graph_id", F.col("target").alias("table"), F.col("source").alias("node")).distinct()
    if wanted is None:
        wanted = known_outputs(edges, computed, passing)
    if columns is not None:
        known = columns.select("node").distinct()
        has = columns.select("node", "col").distinct()
        passing = passing.join(columns.groupBy("node").agg(F.collect_set("col").alias("own")).withColumnRenamed("node", "from_node"), "from_node", "left")
        # a known source passes its own columns only
        passing = durable(passing.withColumn("only", F.when(F.col("own").isNull(), F.col("only")).when(F.col("only").isNull(), F.col("own")).otherwise(F.array_intersect("only", "own"))).drop("own").select("graph_id", "node", "from_node", "only", "without"), "steps")
        marked = computed.join(known.withColumnRenamed("node", "from_node").withColumn("k", F.lit(True)), "from_node", "left").join(has.select(F.col("node").alias("from_node"), F.col("col").alias("from_col")).withColumn("h", F.lit(True)), ["from_node", "from_col"], "left")
        computed = durable(marked.withColumn("from_col", F.when(F.col("k").isNull() | F.col("h"), F.col("from_col"))).select("graph_id", "node", "from_node", "col", "from_col", "role"), "steps")
    start = durable(writes.join(wanted, ["graph_id", "table"]).select("graph_id", "table", "column", "node").distinct(), "start")
    none, empty = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    steps = computed.select("graph_id", F.lit("c").alias("kind"), "node", "col", "from_node", "from_col", "role", empty.alias("only"), empty.alias("without"))
    steps = steps.unionByName(passing.select("graph_id", F.lit("p").alias("kind"), "node", none.alias("col"), "from_node", none.alias("from_col"), none.alias("role"), "only", "without"))
    steps = steps.unionByName(start.select("graph_id", F.lit("w").alias("kind"), "node", F.col("column").alias("col"), F.col("table").alias("from_node"), F.col("column").alias("from_col"), none.alias("role"), empty.alias("only"), empty.alias("without")))
    large = durable(steps.groupBy("graph_id").count().filter(F.col("count") > group_rows).select("graph_id"), "large")
    if large.isEmpty():
        return _local(steps)
    far = lambda df: df.join(large, "graph_id", "left_semi")
    return _local(steps.join(large, "graph_id", "left_anti")).unionByName(_distributed(far(computed), far(passing), far(start)))


def _distributed(computed: DataFrame, passing: DataFrame, start: DataFrame) -> DataFrame:
    """The same walk for graphs of any size, one frontier join a round."""
    state = ["graph_id", "table", "column", "node", "col"]
    step = durable(start.select("graph_id", "table", "column", "node", F.col("column").alias("col"), F.lit("passthrough").alias("role")), "step")
    found, seen = None, None
    while not step.isEmpty():
        ends = step.filter(is_table("node"))
        found = ends if found is None else found.unionByName(ends)
        seen = step.select(*state) if seen is None else seen.unionByName(step.select(*state))
        frontier = step.filter(~is_table("node"))
        hit = frontier.join(computed.withColumnRenamed("role", "step_role"), ["graph_id", "node", "col"]).filter("from_col is not null and from_node is not null")
        hit = hit.select("graph_id", "table", "column", F.col("from_node").alias("node"), F.col("from_col").alias("col"), F.when(F.col("role") == "passthrough", F.col("step_role")).otherwise(F.col("role")).alias("role"))
        rest = frontier.join(computed.select("graph_id", "node", "col").distinct(), ["graph_id", "node", "col"], "left_anti")
        through = rest.join(passing, ["graph_id", "node"]).filter((F.col("only").isNull() | F.array_contains("only", F.col("col"))) & (F.col("without").isNull() | ~F.array_contains("without", F.col("col"))))
        through = through.select("graph_id", "table", "column", F.col("from_node").alias("node"), "col", "role")
        step = hit.unionByName(through).groupBy(*state).agg(F.min("role").alias("role"))
        step = durable(step.join(seen, state, "left_anti"), "step")
    found = step if found is None else found
    result = found.groupBy("graph_id", "table", "column", F.col("node").alias("from_table"), F.col("col").alias("from_column")).agg(F.min("role").alias("role"))
    return result.select("graph_id", "table", "column", "role", "from_table", "from_column")


def nodes_before(edges: DataFrame, passing: DataFrame) -> DataFrame:
    """(graph_id, table, node, depth): the nodes whose columns a written table may have, over steps that pass columns, up to those that fix them."""
    writes = edges.filter("kind = 'writes' and target is not null").select("graph_id", F.col("target").alias("table"), F.col("source").alias("node")).distinct()
    # an aggregation or a projection fixes the columns: nothing above it adds one
    closed = edges.filter("kind = 'aggregates' or (kind = 'projects' and kept_cols is not null)").select("graph_id", F.col("target").alias("node")).distinct()
    # a table passes on all columns of what its open steps lead to, other written tables included
    tagged = writes.withColumn("at", F.concat(F.lit("w:"), "table"))
    open_ = passing.join(closed, ["graph_id", "node"], "left_anti").filter("from_node is not null").select("graph_id", F.col("node").alias("src"), F.col("from_node").alias("dst"))
    open_ = open_.filter(~is_table("src")).unionByName(tagged.select("graph_id", F.col("at").alias("src"), F.col("node").alias("dst"))).distinct()
    seen = closure(open_, tagged.select("graph_id", F.col("at").alias("seed"), F.col("at").alias("node")).distinct(), group="graph_id")
    return seen.select("graph_id", F.substring("seed", 3, 1 << 30).alias("table"), "node", "depth")


def operations(edges: DataFrame) -> DataFrame:
    """(graph_id, table, column, op, window): what computes a column of a written table nearest to it: 'derive', the aggregate's name or 'group_key', and the window it is taken over.

    Of several computations equally near, the first by name counts.
    """
    edges = durable(edges.filter("graph_id is not null"), "edges")
    text = lambda c: F.coalesce(F.array_join(f"window_spec.{c}", ","), F.lit(""))
    over = F.when(F.col("window_spec").isNotNull(), F.concat(text("partition_cols"), F.lit("|"), text("order_cols"), F.lit("|"), F.coalesce("window_spec.frame", F.lit(""))))
    base = ["graph_id", F.col("target").alias("node")]
    made = edges.filter("kind = 'derives' and output_col is not null").select(*base, F.col("output_col").alias("column"), F.lit("derive").alias("op"), over.alias("window"))
    none = F.lit(None).cast("string").alias("window")
    made = made.unionByName(edges.filter("kind = 'aggregates'").select(*base, F.explode("aggs").alias("a")).select("graph_id", "node", F.col("a.output").alias("column"), F.col("a.op").alias("op"), none))
    made = made.unionByName(edges.filter("kind = 'aggregates'").select(*base, F.explode("group_keys").alias("column")).withColumn("op", F.lit("group_key")).withColumn("window", none)).filter("column is not null")
    seen = durable(nodes_before(edges, durable(column_steps(edges)[1], "steps")), "seen")
    near = seen.join(made, ["graph_id", "node"]).groupBy("graph_id", "table", "column").agg(F.min(F.struct("depth", F.coalesce("op", F.lit("")).alias("op"), F.coalesce("window", F.lit("")).alias("window"))).alias("m"))
    return near.select("graph_id", "table", "column", "m.op", F.nullif("m.window", F.lit("")).alias("window"))


def known_outputs(edges: DataFrame, computed: DataFrame, passing: DataFrame) -> DataFrame:
    """(graph_id, table, column): columns that nodes before a write compute or keep, and those of written tables that it passes on; a later step of the walk may still drop them."""
    named = computed.select("graph_id", "node", "col").unionByName(edges.filter("kind = 'projects'").select("graph_id", F.col("target").alias("node"), F.explode("kept_cols").alias("col"))).distinct()
    seen = durable(nodes_before(edges, passing).drop("depth"), "seen")
    own = durable(seen.join(named, ["graph_id", "node"]).select("graph_id", "table", F.col("col").alias("column")).distinct(), "own")
    onto = seen.filter(is_table("node")).select("graph_id", F.col("table").alias("src"), F.col("node").alias("dst"))
    above = closure(onto, onto.select("graph_id", F.col("src").alias("seed"), F.col("src").alias("node")), group="graph_id").select("graph_id", F.col("seed").alias("of"), F.col("node").alias("table"))
    return own.unionByName(above.join(own, ["graph_id", "table"]).select("graph_id", F.col("of").alias("table"), "column")).distinct()


def forward_index(found: DataFrame) -> DataFrame:
    """(graph_id, src, dst): columns as table.column, from what they come from to what comes of them."""
    name = lambda t, c: F.concat(F.regexp_replace(t, "^(?:table|ext):", ""), F.lit("."), F.col(c))
    return found.select("graph_id", name("from_table", "from_column").alias("src"), name("table", "column").alias("dst")).distinct()


def resolve_seeds(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(case, node, status) of each asked (case, table, column) among nodes (table.column).

    qualified: the table's name parts equal those of a node's table, or the last ones of either are the
    whole other (case ignored); ambiguous: that holds for several tables none of which is part of
    another; unqualified_heuristic: no table matches, and the column alone does; unresolved: nothing
    does, with a null node. Column names are compared with case.
    """
    parts = nodes.select("node", F.regexp_extract("node", r"^(.*)\.[^.]*$", 1).alias("of"), F.regexp_extract("node", r"([^.]*)$", 1).alias("col")).distinct()
    segments = lambda c: F.reverse(F.split(F.lower(c), r"\."))
    same = parts.join(asked, F.col("col") == F.col("column")).withColumns({"a": segments("of"), "b": segments("table")})
    shorter = F.least(F.size("a"), F.size("b"))
    same = same.withColumn("fits", (F.length("table") > 0) & (F.slice("a", F.lit(1), shorter) == F.slice("b", F.lit(1), shorter)))
    fitting = same.filter("fits")
    # a table is maximal unless its parts are the last ones of another matching table
    x, y = fitting.alias("x"), fitting.alias("y")
    inside = (F.col("x.case") == F.col("y.case")) & (F.size("x.a") < F.size("y.a")) & (F.slice("y.a", F.lit(1), F.size("x.a")) == F.col("x.a"))
    maximal = x.join(y, inside, "left_anti").select("x.case", "x.node", "x.of")
    exact = fitting.filter("lower(of) = lower(table)").select("case", "node", "of")
    chosen = exact.unionByName(maximal.join(exact.select("case").distinct(), "case", "left_anti"))
    tables = chosen.groupBy("case").agg(F.countDistinct(F.lower("of")).alias("n"))
    named = chosen.join(tables, "case").select("case", "node", F.when(F.col("n") > 1, "ambiguous").otherwise("qualified").alias("status"))
    bare = same.filter("table is null or length(table) = 0 or not fits").join(named.select("case").distinct(), "case", "left_anti").select("case", "node", F.lit("unqualified_heuristic").alias("status"))
    some = named.unionByName(bare)
    none = asked.select("case").distinct().join(some.select("case").distinct(), "case", "left_anti").select("case", F.lit(None).cast("string").alias("node"), F.lit("unresolved").alias("status"))
    return some.unionByName(none).distinct()


def table_links(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst): a file that reads src writes dst; coarse, as files are not looked into."""
    reads = edges.filter("kind = 'reads' and source is not null").select("graph_id", "file", F.col("source").alias("src")).distinct()
    writes = edges.filter("kind = 'writes' and target is not null").select("graph_id", "file", F.col("target").alias("dst")).distinct()
    return reads.join(writes, ["graph_id", "file"]).filter("src <> dst").select("graph_id", "src", "dst").distinct()


def table_tiers(edges: DataFrame) -> DataFrame:
    """(graph_id, table, tier): mid if read and written, sink if only written, else source."""
    ends = edges.filter("kind = 'reads' and source is not null").select("graph_id", F.col("source").alias("table"), F.lit(True).alias("r"), F.lit(False).alias("w"))
    ends = ends.unionByName(edges.filter("kind = 'writes' and target is not null").select("graph_id", F.col("target").alias("table"), F.lit(False).alias("r"), F.lit(True).alias("w")))
    return ends.groupBy("graph_id", "table").agg(F.bool_or("r").alias("r"), F.bool_or("w").alias("w")).select("graph_id", "table", F.when(F.col("r") & F.col("w"), "mid").when(F.col("w"), "sink").otherwise("source").alias("tier"))


def merged_tables(edges: DataFrame, prefix: str = "table:") -> DataFrame:
    """(graph_id, table, written_by, read_by): one row a table (or what else the prefix names), the files that touch it in the order of their first edge."""
    touch = edges.filter((F.col("kind") == "reads") & F.col("source").startswith(prefix)).select("graph_id", F.col("source").alias("table"), "file", "ordinal", F.lit("r").alias("how"))
    touch = touch.unionByName(edges.filter((F.col("kind") == "writes") & F.col("target").startswith(prefix)).select("graph_id", F.col("target").alias("table"), "file", "ordinal", F.lit("w").alias("how")))
    first = touch.filter("file is not null").groupBy("graph_id", "table", "how", "file").agg(F.min("ordinal").alias("at"))
    ordered = lambda how: F.transform(F.array_sort(F.collect_list(F.when(F.col("how") == how, F.struct("at", "file")))), lambda x: x["file"])
    return first.groupBy("graph_id", "table").agg(ordered("w").alias("written_by"), ordered("r").alias("read_by"))


def predicate_use(edges: DataFrame) -> DataFrame:
    """(graph_id, predicate_id, cond, uses, n_edges, targets): the conditions of rules and of the rules in structs, each once in a graph."""
    own = edges.select("graph_id", "edge_id", "target", F.explode("rule_logic").alias("r"))
    inner = edges.select("graph_id", "edge_id", "target", F.explode("struct_fields").alias("f")).select("graph_id", "edge_id", "target", F.explode("f.rule_logic").alias("r"))
    conds = own.unionByName(inner).select("graph_id", "edge_id", "target", "r.cond").filter("cond is not null and cond <> 'otherwise'")
    # first by edge, so that a condition of very many edges is not gathered
    by_edge = conds.groupBy("graph_id", "cond", "edge_id", "target").agg(F.count("*").alias("uses"))
    held = by_edge.groupBy("graph_id", "cond").agg(F.sum("uses").alias("uses"), F.countDistinct("edge_id").alias("n_edges"), F.countDistinct("target").alias("targets"))
    return held.select("graph_id", F.concat(F.lit("P"), F.substring(F.md5("cond"), 1, 10)).alias("predicate_id"), "cond", "uses", "n_edges", "targets")


def integrity(readings: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, graph_id, id): edge ids that occur twice in the readings, and intermediate ends of edges that nothing produces; unresolved ends are exempt."""
    twice = readings.groupBy("graph_id", "edge_id").count().filter("count > 1").select(F.lit("duplicate id").alias("problem"), "graph_id", F.col("edge_id").alias("id"))
    ends = edges.select("graph_id", F.explode(F.array("source", "right_source")).alias("id")).filter(f"id is not null and not startswith(id, '{UNRESOLVED}')").filter(~is_table("id")).distinct()
    made = edges.select("graph_id", F.col("target").alias("id")).filter("id is not null").distinct()
    return twice.unionByName(ends.join(made, ["graph_id", "id"], "left_anti").select(F.lit("dangling end").alias("problem"), "graph_id", "id"))


def edge_key(with_logic: bool = False) -> Column:
    """What makes two edges the same: kind, ends without line numbers, columns; ``with_logic`` adds predicates, keys and rules."""
    end = lambda c: F.coalesce(F.regexp_replace(c, r"^(df:[^:]*):[^:]*:", "$1:"), F.lit(""))
    cols = F.array_join(F.array_sort(F.coalesce("source_cols", F.array().cast("array<string>"))), ",")
    parts = ["kind", end("source"), end("right_source"), end("target"), F.coalesce("output_col", F.lit("")), cols]
    if with_logic:
        parts += [F.coalesce(F.col(c).cast("string") if c == "expr_id" else F.to_json(c), F.lit("")) for c in ("expr_id", "referenced_cols", "join_keys", "group_keys", "aggs", "rule_logic", "kept_cols")]
    return F.concat_ws("|", *parts)


def compare(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One pass over two sets of rows: keys and change (added, removed or same)."""
    a, b = old.select(*keys).distinct().withColumn("was", F.lit(True)), new.select(*keys).distinct().withColumn("is", F.lit(True))
    return a.join(b, keys, "full_outer").select(*keys, F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").otherwise("same").alias("change"))


def columns_by_table(found: DataFrame) -> DataFrame:
    """(graph_id, table, columns): the columns of every written table in a provenance, in order."""
    return found.groupBy("graph_id", "table").agg(F.array_sort(F.collect_set("column")).alias("columns"))


def graph_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(graph_id, part, id, change, n_downstream) of two states of graphs: tables, columns of written tables, and edges with their logic, added or removed.

    ``n_downstream`` counts, for a column, what depends on it in the state that has it; a removed column with any is a breaking change.
    """
    old, new = durable(old, "old"), durable(new, "new")
    was, now = durable(provenance(old), "was"), durable(provenance(new), "now")
    ends = lambda e: e.filter("kind = 'reads'").select("graph_id", F.col("source").alias("id")).unionByName(e.filter("kind = 'writes'").select("graph_id", F.col("target").alias("id"))).filter(is_table("id")).distinct()
    columns = lambda p: p.select("graph_id", F.concat(F.regexp_replace("table", "^(?:table|ext):", ""), F.lit("."), "column").alias("id")).distinct()
    keys = lambda e: e.select("graph_id", edge_key(True).alias("id")).distinct()
    parts = []
    for name, a, b in (("table", ends(old), ends(new)), ("column", columns(was), columns(now)), ("edge", keys(old), keys(new))):
        parts.append(compare(a, b, ["graph_id", "id"]).filter("change <> 'same'").select("graph_id", F.lit(name).alias("part"), "id", "change"))
    changes = durable(parts[0].unionByName(parts[1]).unionByName(parts[2]), "changes")
    reach = [breaking(changes.filter(f"part = 'column' and change = '{change}'").select("graph_id", F.col("id").alias("node")), forward_index(p)).withColumn("change", F.lit(change)) for change, p in (("removed", was), ("added", now))]
    reach = reach[0].unionByName(reach[1]).select("graph_id", F.col("node").alias("id"), "change", "n_downstream").withColumn("part", F.lit("column"))
    return changes.join(reach, ["graph_id", "part", "id", "change"], "left").select("graph_id", "part", "id", "change", F.coalesce("n_downstream", F.lit(0)).alias("n_downstream"))


def breaking(removed: DataFrame, fwd: DataFrame) -> DataFrame:
    """(graph_id, node, n_downstream) of removed columns something in the old graph depends on."""
    reach = closure(fwd, removed.select("graph_id", F.col("node").alias("seed"), "node"), group="graph_id")
    return reach.filter("seed <> node").groupBy("graph_id", F.col("seed").alias("node")).agg(F.count("*").alias("n_downstream"))
