"""The star schema read as an object graph: a row is an object, a foreign key a reference.

An id is a code of the table times 10**12 plus the key.  The statements run unchanged in Spark and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dump import HeapDump
from ..functions.rules import is_skip
from ..operators import graph, sizes
from ..operators.dag import GraphIndex, condense
from .storage import Scratch, stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")
_EVENT = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"
_LINE = "7000000000000 + l_orderkey * 10 + l_linenumber"
_PLACE = "row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey)"

REFS_SQL = f"""
SELECT 1000000000000 + CAST(n_regionkey AS BIGINT) AS src, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS BIGINT) AS pos, 2000000000000 + CAST(n_nationkey AS BIGINT) AS dst FROM {{nation}}
UNION ALL SELECT 2000000000000 + CAST(n_nationkey AS BIGINT), CAST(0 AS BIGINT), 1000000000000 + CAST(n_regionkey AS BIGINT) FROM {{nation}}
UNION ALL SELECT 3000000000000 + c_custkey, CAST(0 AS BIGINT), 2000000000000 + CAST(c_nationkey AS BIGINT) FROM {{customer}}
UNION ALL SELECT 4000000000000 + s_suppkey, CAST(0 AS BIGINT), 2000000000000 + CAST(s_nationkey AS BIGINT) FROM {{supplier}}
UNION ALL SELECT 6000000000000 + o_orderkey, CAST(0 AS BIGINT), 3000000000000 + o_custkey FROM {{orders}}
UNION ALL SELECT DISTINCT {_LINE}, CAST(0 AS BIGINT), 6000000000000 + l_orderkey FROM {{lineitem}}
UNION ALL SELECT {_LINE}, CAST(2 * {_PLACE} - 1 AS BIGINT), 5000000000000 + l_partkey FROM {{lineitem}}
UNION ALL SELECT {_LINE}, CAST(2 * {_PLACE} AS BIGINT), 4000000000000 + l_suppkey FROM {{lineitem}}
UNION ALL SELECT src, CAST(0 AS BIGINT), dst FROM (SELECT 8000000000000 + event_id AS src, 8000000000000 + lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM {{events}}) e WHERE dst IS NOT NULL
UNION ALL SELECT 8000000000000 + event_id, CAST(1 AS BIGINT), 3000000000000 + user_id FROM {{events}}
UNION ALL SELECT 8000000000000 + event_id, CAST(2 AS BIGINT), 9000000000000 + {_EVENT} FROM {{events}}
UNION ALL SELECT DISTINCT 9000000000000 + {_EVENT}, CAST(0 AS BIGINT), 9100000000000 FROM {{events}}
UNION ALL SELECT 9100000000000, CAST(r_regionkey AS BIGINT), 1000000000000 + CAST(r_regionkey AS BIGINT) FROM {{region}}
"""

OBJECTS_SQL = f"""
SELECT 1000000000000 + CAST(r_regionkey AS BIGINT) AS id, 'builtins.dict' AS type, CAST(NULL AS STRING) AS value, CAST(64 AS BIGINT) AS size FROM {{region}}
UNION ALL SELECT 2000000000000 + CAST(n_nationkey AS BIGINT), 'builtins.list', NULL, CAST(56 + n_nationkey AS BIGINT) FROM {{nation}}
UNION ALL SELECT 3000000000000 + c_custkey, 'app.Customer', NULL, CAST(48 + c_custkey % 97 AS BIGINT) FROM {{customer}}
UNION ALL SELECT 4000000000000 + s_suppkey, 'builtins.function', CASE WHEN s_suppkey % 10 = 0 THEN concat('typing.', s_name) ELSE concat('app.', s_name) END, CAST(136 AS BIGINT) FROM {{supplier}}
UNION ALL SELECT 5000000000000 + p_partkey, 'builtins.str', p_name, CAST(49 + length(p_name) AS BIGINT) FROM {{part}}
UNION ALL SELECT 6000000000000 + o_orderkey, 'builtins.tuple', NULL, CAST(40 + o_orderkey % 89 AS BIGINT) FROM {{orders}}
UNION ALL SELECT DISTINCT {_LINE}, 'app.LineItem', CAST(NULL AS STRING), CAST(56 + 8 * l_linenumber AS BIGINT) FROM {{lineitem}}
UNION ALL SELECT 8000000000000 + event_id, concat('app.', event_type), NULL, CAST(32 + event_id % 53 AS BIGINT) FROM {{events}}
UNION ALL SELECT DISTINCT 9000000000000 + {_EVENT}, 'builtins.type', concat('app.', event_type), CAST(1000 AS BIGINT) FROM {{events}}
UNION ALL SELECT 9100000000000, 'builtins.module', 'module app', CAST(72 AS BIGINT)
UNION ALL SELECT 11000000000000 + doc_id, 'builtins.str', CASE WHEN length(text) > 1000 THEN concat(substring(text, 1, 1000), '...<truncated>') ELSE text END, CAST(49 + length(text) AS BIGINT) FROM {{documents}}
"""

#: The links of REFS_SQL without their places, some of them repeated: no row is sorted, and a row's links are made together.
LINKS_SQL = f"""
SELECT 1000000000000 + CAST(n_regionkey AS BIGINT) AS src, 2000000000000 + CAST(n_nationkey AS BIGINT) AS dst FROM {{nation}}
UNION ALL SELECT 2000000000000 + CAST(n_nationkey AS BIGINT), 1000000000000 + CAST(n_regionkey AS BIGINT) FROM {{nation}}
UNION ALL SELECT 3000000000000 + c_custkey, 2000000000000 + CAST(c_nationkey AS BIGINT) FROM {{customer}}
UNION ALL SELECT 4000000000000 + s_suppkey, 2000000000000 + CAST(s_nationkey AS BIGINT) FROM {{supplier}}
UNION ALL SELECT 6000000000000 + o_orderkey, 3000000000000 + o_custkey FROM {{orders}}
UNION ALL SELECT {_LINE}, explode(array(6000000000000 + l_orderkey, 5000000000000 + l_partkey, 4000000000000 + l_suppkey)) FROM {{lineitem}}
UNION ALL SELECT 8000000000000 + event_id, 8000000000000 + lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) FROM {{events}}
UNION ALL SELECT 8000000000000 + event_id, explode(array(3000000000000 + user_id, 9000000000000 + {_EVENT})) FROM {{events}}
UNION ALL SELECT DISTINCT 9000000000000 + {_EVENT}, 9100000000000 FROM {{events}}
UNION ALL SELECT 9100000000000, 1000000000000 + CAST(r_regionkey AS BIGINT) FROM {{region}}
"""


def _link(pos: object, dst: str) -> str:
    return f"named_struct('pos', CAST({pos} AS BIGINT), 'dst', {dst})"


_NO_LINKS = "CAST(array() AS ARRAY<STRUCT<pos: BIGINT, dst: BIGINT>>)"
_WHOLE = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
_LINES = f"SELECT *, {_PLACE} AS nth, collect_list(struct(l_partkey, l_suppkey)) OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey {_WHOLE}) AS parts FROM {{lineitem}}"

#: OBJECTS_SQL with the links of REFS_SQL in each row, by place: a row's links are made together, and objects and links are not joined.
RECORDS_SQL = f"""
SELECT 1000000000000 + CAST(r_regionkey AS BIGINT) AS id, 'builtins.dict' AS type, CAST(NULL AS STRING) AS value, CAST(64 AS BIGINT) AS size, coalesce(transform(nations, (n, i) -> {_link("i", "2000000000000 + CAST(n.n_nationkey AS BIGINT)")}), {_NO_LINKS}) AS links FROM {{region}} LEFT JOIN (SELECT n_regionkey, sort_array(collect_list(struct(n_nationkey))) AS nations FROM {{nation}} GROUP BY n_regionkey) ON r_regionkey = n_regionkey
UNION ALL SELECT 2000000000000 + CAST(n_nationkey AS BIGINT), 'builtins.list', NULL, CAST(56 + n_nationkey AS BIGINT), array({_link(0, "1000000000000 + CAST(n_regionkey AS BIGINT)")}) FROM {{nation}}
UNION ALL SELECT 3000000000000 + c_custkey, 'app.Customer', NULL, CAST(48 + c_custkey % 97 AS BIGINT), array({_link(0, "2000000000000 + CAST(c_nationkey AS BIGINT)")}) FROM {{customer}}
UNION ALL SELECT 4000000000000 + s_suppkey, 'builtins.function', CASE WHEN s_suppkey % 10 = 0 THEN concat('typing.', s_name) ELSE concat('app.', s_name) END, CAST(136 AS BIGINT), array({_link(0, "2000000000000 + CAST(s_nationkey AS BIGINT)")}) FROM {{supplier}}
UNION ALL SELECT 5000000000000 + p_partkey, 'builtins.str', p_name, CAST(49 + length(p_name) AS BIGINT), {_NO_LINKS} FROM {{part}}
UNION ALL SELECT 6000000000000 + o_orderkey, 'builtins.tuple', NULL, CAST(40 + o_orderkey % 89 AS BIGINT), array({_link(0, "3000000000000 + o_custkey")}) FROM {{orders}}
UNION ALL SELECT {_LINE}, 'app.LineItem', NULL, CAST(56 + 8 * l_linenumber AS BIGINT), concat(array({_link(0, "6000000000000 + l_orderkey")}), flatten(transform(parts, (p, i) -> array({_link("2 * i + 1", "5000000000000 + p.l_partkey")}, {_link("2 * i + 2", "4000000000000 + p.l_suppkey")})))) FROM ({_LINES}) WHERE nth = 1
UNION ALL SELECT 8000000000000 + event_id, concat('app.', event_type), NULL, CAST(32 + event_id % 53 AS BIGINT), concat(if(before IS NULL, {_NO_LINKS}, array({_link(0, "8000000000000 + before")})), array({_link(1, "3000000000000 + user_id")}, {_link(2, f"9000000000000 + {_EVENT}")})) FROM (SELECT event_id, event_type, user_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM {{events}})
UNION ALL SELECT DISTINCT 9000000000000 + {_EVENT}, 'builtins.type', concat('app.', event_type), CAST(1000 AS BIGINT), array({_link(0, "9100000000000")}) FROM {{events}}
UNION ALL SELECT 9100000000000, 'builtins.module', 'module app', CAST(72 AS BIGINT), sort_array(collect_list({_link("r_regionkey", "1000000000000 + CAST(r_regionkey AS BIGINT)")})) FROM {{region}}
UNION ALL SELECT 11000000000000 + doc_id, 'builtins.str', CASE WHEN length(text) > 1000 THEN concat(substring(text, 1, 1000), '...<truncated>') ELSE text END, CAST(49 + length(text) AS BIGINT), {_NO_LINKS} FROM {{documents}}
"""


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in text})


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, REFS_SQL)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) of the refs; links may be repeated, and lead nowhere (null)."""
    return _sql(spark, sf_dir, LINKS_SQL)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type, value, size, links): the objects, each with its links (pos, dst) in order."""
    return _sql(spark, sf_dir, RECORDS_SQL)


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, OBJECTS_SQL).withColumn("is_skip", is_skip(F.col("type"), F.col("value")))


def first_line(spark: SparkSession, sf_dir: str) -> int | None:
    """The least id of a line item, from the table's keys: no objects are made and told apart for that."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.min(F.expr(_LINE)).cast("long")).first()[0]


_KEPT: dict[tuple[str, str, str], object] = {}


def _kept(spark: SparkSession, sf_dir: str, what: str, make):
    """Tables that several queries of a session share are made once."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "edges", lambda: stored(graph.usable_refs(_objects(spark, sf_dir), links(spark, sf_dir)).sortWithinPartitions("dst", "src"), "edges"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, size, is_skip): no types and values are stored for sizes."""
    return _kept(spark, sf_dir, "objects", lambda: stored(objects(spark, sf_dir).select("id", "size", "is_skip"), "objects"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, size) of all objects, stored."""
    return _objects(spark, sf_dir).select("id", "size")


def exact_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, subtree_size), stored."""
    return _kept(spark, sf_dir, "sizes", lambda: sizes.exact_sizes(nodes(spark, sf_dir), edges(spark, sf_dir)))


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(spark, sf_dir, "refs", lambda: stored(refs(spark, sf_dir), "refs"))


def plain(spark: SparkSession, sf_dir: str) -> HeapDump:
    """The graph as a dump without sizes, stored once by id, links with their sources: look-ups of few objects or sources read few row groups."""

    def make() -> HeapDump:
        made = records(spark, sf_dir).withColumn("is_skip", is_skip(F.col("type"), F.col("value")))
        by_id = stored(made.repartitionByRange("id").sortWithinPartitions("id"), "by-id")
        return HeapDump(by_id.select("id", "type", "value", "size", F.lit(None).cast("long").alias("subtree_size"), "is_skip"), by_id.select(F.col("id").alias("src"), F.inline("links")))

    return _kept(spark, sf_dir, "plain", make)


def index(spark: SparkSession, sf_dir: str) -> GraphIndex:
    """The condensed graph."""
    return _kept(spark, sf_dir, "index", lambda: GraphIndex.build(_objects(spark, sf_dir), edges(spark, sf_dir)))


def component_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) between strong components.  Trees and levels of the index are not made for that; where it was made already, its links are read."""
    if (spark.sparkContext.applicationId, sf_dir, "index") in _KEPT:
        return index(spark, sf_dir).links.select("src", "dst")

    def make() -> DataFrame:
        with Scratch(spark, "condensed") as work:
            return stored(condense(work, _objects(spark, sf_dir), edges(spark, sf_dir)).links, "links")

    return _kept(spark, sf_dir, "component_links", make)


def dump(spark: SparkSession, sf_dir: str, exact: bool = False) -> HeapDump:
    """The graph as a dump; with exact subtree sizes if asked for."""
    if not exact:
        plain = objects(spark, sf_dir).select("id", "type", "value", "size", F.lit(None).cast("long").alias("subtree_size"), "is_skip")
        return HeapDump(plain, refs(spark, sf_dir))

    def make() -> HeapDump:
        sized_objects = objects(spark, sf_dir).join(exact_sizes(spark, sf_dir), "id")
        return HeapDump(stored(sized_objects.select("id", "type", "value", "size", "subtree_size", "is_skip"), "sized"), _refs(spark, sf_dir), index(spark, sf_dir))

    return _kept(spark, sf_dir, "dump", make)
