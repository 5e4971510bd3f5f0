"""Queries of the document engine over the driver's tables, and their oracle SQL.

Documents are rendered from relational rows, so the oracle is plain SQL over the
original columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import sql
from .operators import bind, command, conform, edit, events, targeted, typed
from .operators.shred import shred
from .plans import jsonpath
from .streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table; a file of fewer partitions than there are cores is dealt anew, since parsing costs far more than that."""
    df, cores = spark.read.parquet(f"{sf}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _lines(order: list[str], text: Column) -> Column:
    """Rendered rows of a group, in order, joined."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    return F.array_join(F.transform(rows, lambda x: x["_t"]), "")


def _fmt(pattern: str, *cols: str) -> Column:
    return F.format_string(pattern, *cols)


def regions(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "nation").join(_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.groupBy("r_regionkey", "r_name").agg(_lines(["n_nationkey"], _fmt("  - {key: %d, name: \"%s\"}\n", "n_nationkey", "n_name")).alias("t"))
    return n.select(F.col("r_regionkey").alias("k"), F.concat(_fmt("name: \"%s\"\nnations:\n", "r_name"), "t").alias("t"))


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), _fmt("# nation\nname: \"%s\" # its name\nregion: %d\ntags: [a, b, c]\n", "n_name", "n_regionkey").alias("t"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    i = _table(spark, sf, "lineitem")
    row = F.format_string("  - {part: %d, line: %d, qty: %s, flag: \"%s\"}\n", F.col("l_partkey"), F.col("l_linenumber"), F.col("l_quantity").cast("long").cast("string"), F.col("l_returnflag"))
    # dealt in a fixed number of partitions: small texts would be gathered in few, and parsing has the larger cost
    i = i.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey").groupBy("l_orderkey").agg(_lines(["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], row).alias("t"))
    return i.select(F.col("l_orderkey").alias("k"), F.concat(F.lit("items:\n"), "t").alias("t"))


def customers(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("k"), F.concat(_fmt("c:\n  - {key: %d, seg: \"%s\"", "c_custkey", "c_mktsegment"), F.when(F.col("c_acctbal") > 5000, F.lit(", vip: true")).otherwise(F.lit("")), F.lit("}\n")).alias("t"))


def parts(spark: SparkSession, sf: str) -> DataFrame:
    p = _table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("k"), _fmt("p:\n  - brand: \"%s\"\n    type: \"%s\"\n    size: %d\n    a: %d.50\n    b: %d5e-1\n", "p_brand", "p_type", "p_size", "p_size", "p_size").alias("t"))


def _run(docs: Callable[[SparkSession, str], DataFrame], spark: SparkSession, sf: str, path: str, columns: tuple[str, ...] = ("pointer", "text", "rank")) -> DataFrame:
    return jsonpath.query_texts(docs(spark, sf), "k", "t", path, columns)


_ITEMS = "items AS (SELECT l_orderkey, l_partkey, CAST(l_quantity AS BIGINT) AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)"


def _number(text: str = "text") -> Column:
    return F.col(text).cast("bigint")


@_query("name_selector", "SELECT event_id, '/k' AS pointer, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def name_selector(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events").where("props is not null")
    m = jsonpath.query_texts(e, "event_id", "props", "$.k", ("pointer", "text"))
    return m.select(F.col("doc_key").alias("event_id"), "pointer", _number().alias("k"))


@_query("wildcard", "SELECT n_regionkey AS region, '/nations/' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) || '/name' AS pointer, n_name AS name FROM nation")
def wildcard(spark: SparkSession, sf: str) -> DataFrame:
    return _run(regions, spark, sf, "$.nations[*].name").select(F.col("doc_key").alias("region"), "pointer", F.col("text").alias("name"))


@_query("index_negative", f"WITH {_ITEMS} SELECT l_orderkey AS order_key, l_partkey AS part FROM items WHERE i = n - 1")
def index_negative(spark: SparkSession, sf: str) -> DataFrame:
    return _run(orders, spark, sf, "$.items[-1].part").select(F.col("doc_key").alias("order_key"), _number().alias("part"))


@_query("slice_step", f"WITH {_ITEMS} SELECT l_orderkey AS order_key, l_partkey AS part FROM items WHERE i % 2 = 0")
def slice_step(spark: SparkSession, sf: str) -> DataFrame:
    return _run(orders, spark, sf, "$.items[::2].part").select(F.col("doc_key").alias("order_key"), _number().alias("part"))


@_query("slice_reverse", f"WITH {_ITEMS} SELECT l_orderkey AS order_key, n - 1 - i AS place, l_partkey AS part FROM items")
def slice_reverse(spark: SparkSession, sf: str) -> DataFrame:
    m = _run(orders, spark, sf, "$.items[::-1].part")
    w = F.expr("row_number() over (partition by doc_key order by rank) - 1")
    return m.select(F.col("doc_key").alias("order_key"), w.cast("bigint").alias("place"), _number().alias("part"))


@_query("union_bag", f"WITH {_ITEMS} SELECT l_orderkey AS order_key, l_partkey AS part FROM items WHERE i = 0 UNION ALL SELECT l_orderkey, l_partkey FROM items WHERE i = 0")
def union_bag(spark: SparkSession, sf: str) -> DataFrame:
    return _run(orders, spark, sf, "$.items[0,0].part").select(F.col("doc_key").alias("order_key"), _number().alias("part"))


@_query("descendant", "SELECT r_regionkey AS region, r_name AS name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT n_regionkey, n_name FROM nation")
def descendant(spark: SparkSession, sf: str) -> DataFrame:
    return _run(regions, spark, sf, "$..name").select(F.col("doc_key").alias("region"), F.col("text").alias("name"))


@_query("filter_compare", f"WITH {_ITEMS} SELECT l_orderkey AS order_key, l_partkey AS part FROM items WHERE qty > 25")
def filter_compare(spark: SparkSession, sf: str) -> DataFrame:
    return _run(orders, spark, sf, "$.items[?@.qty > 25].part").select(F.col("doc_key").alias("order_key"), _number().alias("part"))


@_query("filter_logic", f"WITH {_ITEMS} SELECT l_orderkey AS order_key, l_partkey AS part FROM items WHERE (qty <= 10 OR qty >= 40) AND NOT (qty = 45)")
def filter_logic(spark: SparkSession, sf: str) -> DataFrame:
    return _run(orders, spark, sf, "$.items[?(@.qty <= 10 || @.qty >= 40) && !(@.qty == 45)].part").select(F.col("doc_key").alias("order_key"), _number().alias("part"))


@_query("filter_root", f"WITH {_ITEMS} SELECT a.l_orderkey AS order_key, a.l_partkey AS part FROM items a JOIN items b ON a.l_orderkey = b.l_orderkey AND b.i = 0 WHERE a.qty < b.qty")
def filter_root(spark: SparkSession, sf: str) -> DataFrame:
    return _run(orders, spark, sf, "$.items[?@.qty < $.items[0].qty].part").select(F.col("doc_key").alias("order_key"), _number().alias("part"))


@_query("filter_exists", "SELECT c_custkey AS cust FROM customer WHERE c_acctbal > 5000")
def filter_exists(spark: SparkSession, sf: str) -> DataFrame:
    return _run(customers, spark, sf, "$.c[?@.vip].key").select(_number().alias("cust"))


@_query("filter_not", "SELECT c_custkey AS cust FROM customer WHERE NOT (c_acctbal > 5000)")
def filter_not(spark: SparkSession, sf: str) -> DataFrame:
    return _run(customers, spark, sf, "$.c[?!@.vip].key").select(_number().alias("cust"))


@_query("filter_match", "SELECT p_partkey AS part, CAST(p_size AS BIGINT) AS size FROM part WHERE regexp_full_match(p_brand, 'Brand#1.')")
def filter_match(spark: SparkSession, sf: str) -> DataFrame:
    return _run(parts, spark, sf, "$.p[?match(@.brand, 'Brand#1.')].size").select(F.col("doc_key").alias("part"), _number().alias("size"))


@_query("filter_search", "SELECT p_partkey AS part, p_type AS type FROM part WHERE regexp_matches(p_type, '[AEIOU]{1}[A-Z]$')")
def filter_search(spark: SparkSession, sf: str) -> DataFrame:
    return _run(parts, spark, sf, "$.p[?search(@.type, '[AEIOU]{1}[A-Z]$')].type").select(F.col("doc_key").alias("part"), F.col("text").alias("type"))


@_query("fn_length", "SELECT l_orderkey AS order_key FROM lineitem GROUP BY 1 HAVING count(*) > 3")
def fn_length(spark: SparkSession, sf: str) -> DataFrame:
    return _run(orders, spark, sf, "$[?length(@) > 3]").select(F.col("doc_key").alias("order_key"))


@_query("fn_count", f"WITH {_ITEMS} SELECT l_orderkey AS order_key FROM items WHERE qty > 25 GROUP BY 1 HAVING count(*) = 2")
def fn_count(spark: SparkSession, sf: str) -> DataFrame:
    return _run(orders, spark, sf, "$[?count(@[?@.qty > 25]) == 2]").select(F.col("doc_key").alias("order_key"))


@_query("fn_value", f"WITH {_ITEMS} SELECT l_orderkey AS order_key FROM items WHERE n = 1 AND qty > 10")
def fn_value(spark: SparkSession, sf: str) -> DataFrame:
    return _run(orders, spark, sf, "$[?value(@..qty) > 10]").select(F.col("doc_key").alias("order_key"))


@_query("numkey_equal", "SELECT p_partkey AS part FROM part")
def numkey_equal(spark: SparkSession, sf: str) -> DataFrame:
    return _run(parts, spark, sf, "$.p[?@.a == @.b]").select(F.col("doc_key").alias("part"))


@_query("alias_occurrences", "SELECT n_nationkey AS nation, p.pointer, r_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('/base/name'), ('/copy/name')) AS p(pointer)")
def alias_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    n = _table(spark, sf, "nation").join(_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    d = n.select(F.col("n_nationkey").alias("k"), _fmt("base: &r {name: \"%s\"}\ncopy: *r\n", "r_name").alias("t"))
    return jsonpath.query(shred(d, "k", "t"), "$.*.name").select(F.col("doc_key").alias("nation"), "pointer", F.col("text").alias("name"))


@_query("multi_doc", "SELECT n_regionkey AS region, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS doc_ix, CAST(n_nationkey AS BIGINT) AS id FROM nation")
def multi_doc(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(_lines(["n_nationkey"], _fmt("---\nid: %d\n", "n_nationkey")).alias("t"))
    return jsonpath.query(shred(d, "k", "t"), "$.id").select(F.col("doc_key").alias("region"), "doc_ix", _number().alias("id"))


@_query("pointer_get", "SELECT n_nationkey AS nation, n_name AS name FROM nation")
def pointer_get(spark: SparkSession, sf: str) -> DataFrame:
    m = edit.pointer_get(shred(nations(spark, sf), "k", "t"), "/name")
    return m.select(F.col("doc_key").alias("nation"), F.col("text").alias("name"))


_HEAD, _TAIL = "'# nation' || chr(10) || ", "'region: ' || n_regionkey || chr(10) || 'tags: [a, b, c]' || chr(10)"
_NAME = "'name: \"' || n_name || '\" # its name' || chr(10) || "
_EDITS: dict[str, tuple[list[dict], str]] = {
    "edit_replace": ([{"op": "replace", "path": "/region", "value": "{id: 7}"}], _HEAD + _NAME + "'region: {id: 7}' || chr(10) || 'tags: [a, b, c]' || chr(10)"),
    "edit_add": ([{"op": "add", "path": "/tags/1", "value": "x"}, {"op": "add", "path": "/new", "value": "1"}], _HEAD + _NAME + "'region: ' || n_regionkey || chr(10) || 'tags: [a, x, b, c]' || chr(10) || 'new: 1' || chr(10)"),
    "edit_remove": ([{"op": "remove", "path": "/tags/0"}, {"op": "remove", "path": "/name"}], _HEAD + "'region: ' || n_regionkey || chr(10) || 'tags: [b, c]' || chr(10)"),
    "edit_rename_key": ([{"op": "rename-key", "path": "/region", "value": "true"}], _HEAD + _NAME + "'\"true\": ' || n_regionkey || chr(10) || 'tags: [a, b, c]' || chr(10)"),
    "edit_move": ([{"op": "move", "from": "/region", "path": "/tags/-"}], _HEAD + _NAME + "'tags: [a, b, c, ' || n_regionkey || ']' || chr(10)"),
    "edit_copy": ([{"op": "copy", "from": "/tags/2", "path": "/last"}], _HEAD + _NAME + _TAIL + " || 'last: c' || chr(10)"),
    "edit_patch": ([{"op": "test", "path": "/tags", "value": "['a', \"b\", c]"}, {"op": "replace", "path": "/tags/1", "value": "z"}], _HEAD + _NAME + "'region: ' || n_regionkey || chr(10) || 'tags: [a, z, c]' || chr(10)"),
    "edit_rollback": ([{"op": "remove", "path": "/name"}, {"op": "test", "path": "/region", "value": "-1"}], _HEAD + _NAME + _TAIL),
}


def _edit(ops: list[dict]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = nations(spark, sf).withColumn("e", edit.edited(F.col("t"), ops))
        return d.select(F.col("k").alias("nation"), F.col("e.ok").alias("ok"), F.col("e.text").alias("text"))

    return run


for _name, (_ops, _sql) in _EDITS.items():
    _query(_name, f"SELECT n_nationkey AS nation, {'false' if _name == 'edit_rollback' else 'true'} AS ok, {_sql} AS text FROM nation")(_edit(_ops))


@_query("typed_read", "SELECT s_suppkey AS suppkey, s_name AS name, CAST(s_nationkey AS INT) AS nation FROM supplier")
def typed_read(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), _fmt("suppkey: %d\nname: \"%s\"\nnation: '%d'\nextra: [1, 2]\n", "s_suppkey", "s_name", "s_nationkey").alias("t"))
    fields = T.StructType([T.StructField("suppkey", T.LongType()), T.StructField("name", T.StringType()), T.StructField("nation", T.IntegerType())])
    return typed.read_fields(shred(d, "k", "t"), fields).select("suppkey", "name", "nation")


@_query("merge_keys", "SELECT c_custkey AS cust, CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'none' END AS seg FROM customer")
def merge_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "customer")
    d = c.select(F.col("c_custkey").alias("k"), F.concat(F.lit("base: &b {seg: none, x: 1}\nc:\n  <<: *b\n"), F.when(F.col("c_acctbal") > 5000, _fmt("  seg: \"%s\"\n", "c_mktsegment")).otherwise(F.lit(""))).alias("t"))
    m = typed.merged_members(shred(d, "k", "t"), "/c").where("key = 'seg'")
    return m.select(F.col("doc_key").alias("cust"), F.regexp_replace("json", '^"|"$', "").alias("seg"))


@_query("canonical_group", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1")
def canonical_group(spark: SparkSession, sf: str) -> DataFrame:
    """Grouping by canonical text: spellings of one value fall together."""
    e = _table(spark, sf, "events").where("props is not null")
    nodes = shred(e.select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.regexp_replace("props", '^\\{"k": ([0-9]+)\\}$', "k: $1.0")).alias("t")), "event_id", "t")
    m = nodes.where("pointer = '/k'").groupBy("canon").agg(F.count("*").alias("n"))
    return m.select(F.col("canon").cast("double").cast("bigint").alias("k"), "n")


@_query("numeric_top", "SELECT p_partkey AS part, CAST(p_size AS BIGINT) AS size FROM part ORDER BY p_size DESC, p_partkey LIMIT 10")
def numeric_top(spark: SparkSession, sf: str) -> DataFrame:
    m = _run(parts, spark, sf, "$.p[0].a", ("text", "num"))
    return m.orderBy(F.col("num").desc(), "doc_key").limit(10).select(F.col("doc_key").alias("part"), F.col("text").cast("double").cast("bigint").alias("size"))


@_query("extracted_join", f"WITH {_ITEMS} SELECT p_brand AS brand, CAST(sum(qty) AS BIGINT) AS qty, count(*) AS n FROM items JOIN part ON l_partkey = p_partkey GROUP BY 1")
def extracted_join(spark: SparkSession, sf: str) -> DataFrame:
    found = _run(orders, spark, sf, "$.items[*]", ("json",))
    items = found.select(F.from_json("json", "part bigint, qty bigint").alias("i")).select("i.*")
    p = _table(spark, sf, "part")
    return items.join(p, F.col("part") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.sum("qty").alias("qty"), F.count("*").alias("n"))


@_query("parse_errors")
def parse_errors(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "documents")
    return shred(d, "doc_id", "text", "PERMISSIVE").groupBy(F.col("doc_key").alias("doc_id")).agg(F.max("error").alias("error"), F.count("pre").alias("nodes"))


_TAGGED = "n_nationkey, n_name, n_regionkey FROM nation"


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with a directive, an anchor, a local tag and a comment."""
    n = _table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").alias("k"), _fmt("%%YAML 1.2\n---\nname: &n \"%s\" # its name\nregion: !r %d\nlike: *n\n", "n_name", "n_regionkey").alias("t"))


@_query("event_scan", f"SELECT n_nationkey AS nation, '+STR' || chr(10) || '+DOC ---' || chr(10) || '+MAP' || chr(10) || '=VAL :name' || chr(10) || '=VAL &n \"' || n_name || chr(10) || '=VAL :region' || chr(10) || '=VAL <!r> :' || n_regionkey || chr(10) || '=VAL :like' || chr(10) || '=ALI *n' || chr(10) || '-MAP' || chr(10) || '-DOC' || chr(10) || '-STR' || chr(10) AS events FROM (SELECT {_TAGGED})")
def event_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select(F.col("k").alias("nation"), sql.yaml_event_text("t").alias("events"))


@_query("event_counts", "SELECT e.event AS event, CAST(count(*) * e.n AS BIGINT) AS n FROM nation, (VALUES ('+STR', 1), ('+DOC', 1), ('+MAP', 1), ('=VAL', 5), ('=ALI', 1), ('-MAP', 1), ('-DOC', 1), ('-STR', 1)) AS e(event, n) GROUP BY e.event, e.n")
def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return events.events(_texts(spark, sf), "k", "t").groupBy("event").agg(F.count("*").alias("n"))


@_query("tokens_lossless", "SELECT n_nationkey AS nation, '%YAML 1.2' || chr(10) || '---' || chr(10) || 'name: &n \"' || n_name || '\" # its name' || chr(10) || 'region: !r ' || n_regionkey || chr(10) || 'like: *n' || chr(10) AS text FROM nation")
def tokens_lossless(spark: SparkSession, sf: str) -> DataFrame:
    return events.tokens_text(events.tokens(_texts(spark, sf), "k", "t")).select(F.col("doc_key").alias("nation"), "text")


@_query("token_kinds", "SELECT n_nationkey AS nation, '# its name' AS comment, '&n' AS anchor, '!r' AS tag FROM nation")
def token_kinds(spark: SparkSession, sf: str) -> DataFrame:
    t = events.tokens(_texts(spark, sf), "k", "t")
    return t.groupBy(F.col("doc_key").alias("nation")).agg(*(F.max(F.when(F.col("kind") == k, F.col("text"))).alias(k) for k in ("comment", "anchor", "tag")))


@_query("directive_scan", "SELECT n_nationkey AS nation, 'YAML' AS name, '1.2' AS version FROM nation")
def directive_scan(spark: SparkSession, sf: str) -> DataFrame:
    return events.directives(_texts(spark, sf), "k", "t").select(F.col("doc_key").alias("nation"), "name", F.col("params")[0].alias("version"))


@_query("render_block", "SELECT s_suppkey AS suppkey, 'key: ' || s_suppkey || chr(10) || 'tags:' || chr(10) || '  - a' || chr(10) || '  - \"1\"' || chr(10) || 'at:' || chr(10) || '  nation: ' || s_nationkey || chr(10) AS text FROM supplier")
def render_block(spark: SparkSession, sf: str) -> DataFrame:
    v = F.struct(F.col("s_suppkey").alias("key"), F.array(F.lit("a"), F.lit("1")).alias("tags"), F.struct(F.col("s_nationkey").alias("nation")).alias("at"))
    return _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("suppkey"), sql.to_yaml(v).alias("text"))


@_query("render_flow", "SELECT event_id, '{k: ' || json_extract_string(props, '$.k') || '}' AS text FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def render_flow(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "events").where("props is not null and get_json_object(props, '$.k') is not null")
    return e.select("event_id", sql.yaml_flow("props").alias("text"))


@_query("remove_matches", f"WITH {_ITEMS} SELECT l_orderkey AS order_key, CAST(count(*) FILTER (WHERE qty > 25) AS INT) AS removed, true AS ok, CAST(count(*) FILTER (WHERE qty <= 25) AS BIGINT) AS kept FROM items GROUP BY 1")
def remove_matches(spark: SparkSession, sf: str) -> DataFrame:
    got = targeted.edit_matches(orders(spark, sf), "k", "t", "$.items[?@.qty > 25]", "remove")
    return got.select(F.col("doc_key").alias("order_key"), F.col("n_targets").alias("removed"), "ok", F.size(F.from_json(F.get_json_object(sql.yaml_json("text"), "$.items"), "array<string>")).cast("bigint").alias("kept"))


@_query("test_matches", f"WITH {_ITEMS} SELECT l_orderkey AS order_key, count(*) AS n, bool_and(l_partkey = 7) AS equal FROM items GROUP BY 1")
def test_matches(spark: SparkSession, sf: str) -> DataFrame:
    return targeted.test_matches(orders(spark, sf), "k", "t", "$.items[*].part", "7.0").select(F.col("doc_key").alias("order_key"), "n", "equal")


_PART = T.StructType(
    [
        T.StructField("partBrand", T.StringType(), False, {"yaml": {"alias": ["brand"]}}),
        T.StructField("size", T.IntegerType(), False),
        T.StructField("kind", T.StructType([T.StructField("variant", T.StringType()), T.StructField("big", T.IntegerType())]), True, {"yaml": {"enum": True}}),
        T.StructField("unit", T.StringType(), True, {"yaml": {"default": "cm"}}),
        T.StructField("rest", T.MapType(T.StringType(), T.DoubleType()), True, {"yaml": {"rest": True}}),
    ]
)


def _bound(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("p_size") > 25, _fmt("!big %d", "p_size")).otherwise(F.lit("small"))
    p = _table(spark, sf, "part")
    p = p.select("p_partkey", F.concat(_fmt("# part\nbrand: \"%s\"\nsize: %d # cm\nextra: %d.5\nkind: ", "p_brand", "p_size", "p_size"), kind, F.lit("\n")).alias("t"))
    return p.withColumn("r", bind.read(F.col("t"), _PART, "kebab-case"))


@_query("struct_read", "SELECT p_partkey AS part, p_brand AS brand, CAST(p_size AS INT) AS size, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS variant, CASE WHEN p_size > 25 THEN CAST(p_size AS INT) END AS big, 'cm' AS unit, CAST(p_size AS DOUBLE) + 0.5 AS extra FROM part")
def struct_read(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("r.value")
    return _bound(spark, sf).select(F.col("p_partkey").alias("part"), v["partBrand"].alias("brand"), v["size"].alias("size"), v["kind"]["variant"].alias("variant"), v["kind"]["big"].alias("big"), v["unit"].alias("unit"), v["rest"]["extra"].alias("extra"))


_SIZE = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("seen", T.BooleanType())])


@_query("struct_write", "SELECT p_partkey AS part, true AS ok, '# part' || chr(10) || 'brand: \"' || p_brand || '\"' || chr(10) || 'size: ' || (p_size + 1) || ' # cm' || chr(10) || 'extra: ' || p_size || '.5' || chr(10) || 'kind: ' || CASE WHEN p_size > 25 THEN '!big ' || p_size ELSE 'small' END || chr(10) || 'seen: true' || chr(10) AS text FROM part")
def struct_write(spark: SparkSession, sf: str) -> DataFrame:
    new = F.struct((F.col("r.value.size") + 1).alias("size"), F.lit(True).alias("seen"))
    got = _bound(spark, sf).select("p_partkey", bind.write(F.col("t"), new, _SIZE).alias("w"))
    return got.select(F.col("p_partkey").alias("part"), "w.ok", "w.text")


@_query("deep_merge", "SELECT c_custkey AS cust, 'seg: ' || c_mktsegment || chr(10) || 'key: ' || c_custkey || chr(10) AS text FROM customer")
def deep_merge(spark: SparkSession, sf: str) -> DataFrame:
    c = _table(spark, sf, "customer").select("c_custkey", _fmt("{<<: [{key: %d}, {key: 0, seg: x}], seg: %s}", "c_custkey", "c_mktsegment").alias("t"))
    return c.select(F.col("c_custkey").alias("cust"), sql.yaml_merge("t").alias("text"))


# -- edits and reading of hard texts, over whole tables
def _customers(spark: SparkSession, sf: str, text: Column) -> DataFrame:
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"), text.alias("t"))


def _edited(d: DataFrame, ops: list[dict]) -> DataFrame:
    return d.select("k", edit.edited(F.col("t"), ops).alias("e")).select(F.col("k").alias("cust"), "e.ok", "e.text")


_N, _Q, _CR = "chr(10)", "chr(39)", "chr(13)"


@_query("hard_documents", f"SELECT c_custkey AS cust, c_custkey % 6 IN (0, 4) AS ok, CASE c_custkey % 6 WHEN 0 THEN '? a' || {_N} || ': 1' || {_N} WHEN 1 THEN 'b: 1' || {_N} || 'b: 2' || {_N} WHEN 2 THEN '%YAML 1.2 x' || {_N} || '---' || {_N} || 'b: 1' || {_N} WHEN 3 THEN 'a:' || {_N} || chr(9) || 'b: 1' || {_N} WHEN 4 THEN 'a: 1 # c' || {_N} ELSE '- [' || {_N} || chr(9) || 'b]' || {_N} END AS text FROM customer")
def hard_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One failure a document and none of the job: explicit and duplicate keys, bad directives, tabs."""
    texts = ["? a\n: 1\n? b\n: 2\n", "b: 1\nb: 2\n", "%YAML 1.2 x\n---\nb: 1\n", "a:\n\tb: 1\n", "a: 1 # c\nb: 2\n", "- [\n\tb]\n"]
    t = F.array(*map(F.lit, texts))[(F.col("c_custkey") % 6).cast("int")]
    return _edited(_customers(spark, sf, t), [{"op": "remove", "path": "/b"}])


@_query("dynamic_pattern", "SELECT p_partkey AS part FROM part WHERE p_partkey % 2 = 0 AND regexp_full_match(p_brand, 'Brand#1.')")
def dynamic_pattern(spark: SparkSession, sf: str) -> DataFrame:
    """Patterns from the data; a bad one is false in its own document."""
    p = _table(spark, sf, "part")
    d = p.select(F.col("p_partkey").alias("k"), F.format_string("p:\n  - brand: \"%s\"\n    like: '%s'\n", "p_brand", F.when(F.col("p_partkey") % 2 == 0, "Brand#1.").otherwise("(")).alias("t"))
    return jsonpath.query_texts(d, "k", "t", "$.p[?match(@.brand, @.like)]", ("pointer",)).select(F.col("doc_key").alias("part"))


@_query("root_of_empty", "SELECT c_custkey AS cust, CASE WHEN c_custkey % 2 = 0 THEN 'empty' ELSE 'num' END AS kind FROM customer")
def root_of_empty(spark: SparkSession, sf: str) -> DataFrame:
    d = _customers(spark, sf, F.when(F.col("c_custkey") % 2 == 0, "---\n").otherwise("--- 1\n"))
    return jsonpath.query_texts(d, "k", "t", "$", ("kind",)).select(F.col("doc_key").alias("cust"), "kind")


@_query("join_plan", "SELECT n_regionkey AS region, n_name AS name FROM nation WHERE n_nationkey > 5")
def join_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The same language over a node table, as for tables that are stored."""
    return jsonpath.query(shred(regions(spark, sf), "k", "t"), "$.nations[?@.key > 5].name").select(F.col("doc_key").alias("region"), F.col("text").alias("name"))


@_query("edit_keeps_quotes", f"SELECT c_custkey AS cust, true AS ok, 'seg: ' || {_Q} || 'it' || {_Q} || {_Q} || 's' || {_Q} || ' # s' || {_N} || 'key: ' || c_custkey || {_N} || 'q: \"z\"' || {_N} AS text FROM customer")
def edit_keeps_quotes(spark: SparkSession, sf: str) -> DataFrame:
    d = _customers(spark, sf, _fmt("seg: '%s' # s\nkey: %d\nq: \"x\"\n", "c_mktsegment", "c_custkey"))
    return _edited(d, [{"op": "replace", "path": "/seg", "value": "\"it's\""}, {"op": "set", "path": "/q", "value": "z"}])


@_query("edit_keeps_line_ends", f"SELECT c_custkey AS cust, true AS ok, 'key: ' || c_custkey || {_CR} || {_N} || 'l:' || {_CR} || {_N} || '  - a' || {_CR} || {_N} || '  - b' || {_CR} || {_N} || 'new: 1' || {_CR} || {_N} AS text FROM customer")
def edit_keeps_line_ends(spark: SparkSession, sf: str) -> DataFrame:
    d = _customers(spark, sf, _fmt("key: %d\r\nl:\r\n  - a\r\n", "c_custkey"))
    return _edited(d, [{"op": "add", "path": "/l/-", "value": "b"}, {"op": "add", "path": "/new", "value": "1"}])


@_query("edit_flow_lines", f"SELECT c_custkey AS cust, true AS ok, 'l: [' || {_N} || '  1,' || {_N} || '  ' || c_custkey || ',' || {_N} || '  x' || {_N} || ']' || {_N} AS text FROM customer")
def edit_flow_lines(spark: SparkSession, sf: str) -> DataFrame:
    d = _customers(spark, sf, _fmt("l: [\n  1,\n  %d\n]\n", "c_custkey"))
    return _edited(d, [{"op": "add", "path": "/l/-", "value": "x"}])


@_query("edit_guards_anchors", f"SELECT c_custkey AS cust, NOT c_acctbal > 5000 AS ok, CASE WHEN c_acctbal > 5000 THEN 'a: &k {{n: ' || c_custkey || '}}' || {_N} || 'b: *k' || {_N} ELSE 'b: 1' || {_N} || 'c: &k {{n: ' || c_custkey || '}}' || {_N} END AS text FROM customer")
def edit_guards_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """A move that would take an anchor from an alias is refused; without the alias the anchor moves along."""
    d = _customers(spark, sf, F.concat(_fmt("a: &k {n: %d}\n", "c_custkey"), F.when(F.col("c_acctbal") > 5000, "b: *k\n").otherwise("b: 1\n")))
    return _edited(d, [{"op": "move", "from": "/a", "path": "/c"}])


@_query("edit_renames_anchored_keys", f"SELECT c_custkey AS cust, true AS ok, '&x ' || {_Q} || 'new key' || {_Q} || ': ' || c_custkey || {_N} || 'b: *x' || {_N} AS text FROM customer")
def edit_renames_anchored_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _edited(_customers(spark, sf, _fmt("&x 'a': %d\nb: *x\n", "c_custkey")), [{"op": "rename-key", "path": "/a", "value": "new key"}])


@_query("edit_renames_clashing_anchors", f"SELECT c_custkey AS cust, true AS ok, 'a: &k ' || c_custkey || {_N} || 'b: [&k_1 1, *k_1]' || {_N} AS text FROM customer")
def edit_renames_clashing_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return _edited(_customers(spark, sf, _fmt("a: &k %d\n", "c_custkey")), [{"op": "add", "path": "/b", "value": "[&k 1, *k]"}])


@_query("patch_members", "SELECT c_custkey AS cust, CASE WHEN c_acctbal > 5000 THEN NULL ELSE 'a: 2' || chr(10) END AS text FROM customer")
def patch_members(spark: SparkSession, sf: str) -> DataFrame:
    """Patches from a column; one with a member twice is refused."""
    p = F.when(F.col("c_acctbal") > 5000, "[{op: replace, op: replace, path: /a, value: 2}]").otherwise("[{op: replace, path: /a, value: 2}]")
    return _table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), sql.yaml_patch(F.lit("a: 1\n"), p).alias("text"))


_ORDERED = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("unit", T.StringType(), True, {"yaml": {"comment": "of the size"}}), T.StructField("brand", T.StringType()), T.StructField("own", T.IntegerType(), True, {"yaml": {"skip": True}})])


@_query("struct_write_ordered", f"SELECT p_partkey AS part, true AS ok, 'size: ' || p_size || {_N} || '# of the size' || {_N} || 'unit: cm' || {_N} || 'brand: \"' || p_brand || '\"' || {_N} AS text FROM part")
def struct_write_ordered(spark: SparkSession, sf: str) -> DataFrame:
    p = _table(spark, sf, "part").select("p_partkey", "p_size", _fmt("size: %d\nbrand: \"%s\"\n", "p_size", "p_brand").alias("t"))
    new = F.struct(F.col("p_size").cast("int").alias("size"), F.lit("cm").alias("unit"), F.lit(None).cast("string").alias("brand"), F.lit(7).alias("own"))
    return p.select(F.col("p_partkey").alias("part"), bind.write(F.col("t"), new, _ORDERED, ordered=True).alias("w")).select("part", "w.ok", "w.text")


bind.register_codec("centimetres", lambda v: int(str(v).removesuffix(" cm")), lambda v: f"{v} cm")
_CODED = T.StructType([T.StructField("size", T.IntegerType(), True, {"yaml": {"with": "centimetres"}}), T.StructField("id", T.StructType([T.StructField("value", T.LongType())]), True, {"yaml": {"newtype": True}})])


@_query("codec_read", "SELECT p_partkey AS part, CAST(p_size AS INT) AS size, CAST(p_partkey AS BIGINT) AS id FROM part")
def codec_read(spark: SparkSession, sf: str) -> DataFrame:
    p = _table(spark, sf, "part").select("p_partkey", bind.read(_fmt("size: %d cm\nid: %d\n", "p_size", "p_partkey"), _CODED).alias("r"))
    return p.select(F.col("p_partkey").alias("part"), "r.value.size", F.col("r.value.id.value").alias("id"))


@_query("directive_edit", f"SELECT s_suppkey AS supp, '%YAML 1.2' || {_N} || '---' || {_N} || 'k: ' || s_suppkey || {_N} AS put, '---' || {_N} || 'k: ' || s_suppkey || {_N} AS taken FROM supplier")
def directive_edit(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supp"), sql.yaml_set_directive(_fmt("k: %d\n", "s_suppkey"), F.lit("YAML"), F.lit("1.2")).alias("put"))
    return d.withColumn("taken", sql.yaml_remove_directive("put", F.lit("YAML")))


@_query("get_stream", f"WITH {_ITEMS} SELECT l_orderkey AS order_key, string_agg('---' || chr(10) || l_partkey || chr(10), '' ORDER BY i) AS stream FROM items GROUP BY 1")
def get_stream(spark: SparkSession, sf: str) -> DataFrame:
    d = orders(spark, sf).select(F.col("k").alias("order_key"), command.executed(F.col("t"), command="get", query="$.items[*].part").alias("r"))
    return d.select("order_key", F.col("r.output").alias("stream"))


@_query("syntax_counts", "SELECT k.kind AS kind, CAST(count(*) * k.n AS BIGINT) AS n FROM supplier, (VALUES ('stream', 1), ('document', 1), ('block_mapping', 1), ('entry', 3), ('key', 3), ('value', 3), ('scalar', 7), ('flow_sequence', 1), ('item', 2), ('comment', 1), ('indicator', 6)) AS k(kind, n) GROUP BY k.kind, k.n")
def syntax_counts(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), _fmt("key: %d # id\ntags: [a, b]\nn: x\n", "s_suppkey").alias("t"))
    return events.syntax(d, "k", "t").groupBy("kind").agg(F.count("*").alias("n"))


@_query("conformance", "SELECT CASE c_custkey % 4 WHEN 2 THEN 'differs' WHEN 3 THEN 'refused' ELSE 'passed' END AS category, count(*) AS n FROM customer GROUP BY 1")
def conformance(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey") % 4
    want = F.when(c == 2, "+STR\n-STR\n").otherwise(_fmt("+STR\n+DOC\n=VAL :%d\n-DOC\n-STR\n", "c_custkey"))
    d = _table(spark, sf, "customer").select("c_custkey", F.when(c.isin(1, 3), "[").otherwise(F.col("c_custkey").cast("string")).alias("t"), want.alias("want"), (c == 1).alias("invalid"))
    return conform.histogram(conform.conformance(d, "c_custkey", "t", "want", "invalid"))


@_query("error_places", "SELECT s_suppkey AS supp, 3 AS line, 4 AS col FROM supplier")
def error_places(spark: SparkSession, sf: str) -> DataFrame:
    d = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), _fmt("a: %d\nb: é\nc: [1\n", "s_suppkey").alias("t"))
    return shred(d, "k", "t", "PERMISSIVE").select(F.col("doc_key").alias("supp"), F.col("error_line").alias("line"), F.col("error_column").alias("col"))


@_query("scalar_styles", f"SELECT s_suppkey AS supp, s_name || {_N} || ' x' || {_N} AS literal, s_name || ' y' AS folded, 'a b ' || s_name AS plain, 'A' || chr(9) || s_name AS escaped, s_name || ' z' AS quoted, '255' AS hex FROM supplier")
def scalar_styles(spark: SparkSession, sf: str) -> DataFrame:
    n = "s_name"
    t = F.format_string("literal: |\n  %s\n   x\nfolded: >-\n  %s\n  y\nplain: a\n  b\n  %s\nescaped: \"\\x41\\t%s\"\nquoted: '%s\n  z'\n? hex\n: 0xFF\n", n, n, n, n, n)
    j = _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supp"), F.from_json(sql.yaml_json(t), "literal string, folded string, plain string, escaped string, quoted string, hex string").alias("j"))
    return j.select("supp", "j.*")


@_query("append_documents", f"SELECT s_suppkey AS supp, 'k: ' || s_suppkey || {_N} || '---' || {_N} || 'n: 1' || {_N} AS text FROM supplier")
def append_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supp"), sql.yaml_append(_fmt("k: %d", "s_suppkey"), F.lit('{"n": 1}')).alias("text"))


@_query("windowed_stream", "SELECT strftime(ts, '%Y-%m-%d %H') AS hour, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL GROUP BY 1, 2")
def windowed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Event-time windows over a stream that is read to its end; the memory sink holds one row a window and value."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    live = spark.readStream.schema(schema).parquet(f"{sf}/events*.parquet").where("props is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.windowed_counts(live, "ts", "event_id", "props", "/k")
    name = f"windowed_{abs(hash((sf, spark.sparkContext.applicationId)))}"
    counts.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), F.col("json").alias("k"), "n")
