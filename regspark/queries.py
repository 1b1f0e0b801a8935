"""Every operator as a query over the star schema's tables, with its meaning in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cols as c
from .operators import checks, diff, export, oplog, read, search, stats
from .plans import apply, link, views
from .schema import CREATE, DELETE_KEY, SET, Limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_TREE = r"""
places AS (SELECT n_nationkey, r_name || '\' || n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey),
cust AS (SELECT c.*, place || '\C' || c_custkey AS cpath FROM customer c JOIN places ON c_nationkey = n_nationkey),
ord AS (SELECT o.*, cpath || '\O' || o_orderkey AS opath FROM orders o JOIN cust ON o_custkey = c_custkey),
keys AS (
  SELECT r_name AS path, '' AS parent_path, r_name AS name, 1 AS depth, 0::BIGINT AS last_write FROM region
  UNION ALL SELECT place, split_part(place, '\', 1), split_part(place, '\', 2), 2, 0 FROM places
  UNION ALL SELECT cpath, split_part(cpath, '\', 1) || '\' || split_part(cpath, '\', 2), 'C' || c_custkey, 3, 0 FROM cust
  UNION ALL SELECT opath, o2.cpath, 'O' || o_orderkey, 4, epoch(o_orderdate)::BIGINT FROM ord o1 JOIN (SELECT c_custkey AS k, cpath FROM cust) o2 ON o1.o_custkey = o2.k),
vals AS (
  SELECT cpath AS key_path, 'Segment' AS name, 1 AS reg_type, ((length(c_mktsegment) + 1) * 2)::BIGINT AS size, c_mktsegment AS string_val, NULL::BIGINT AS number_val FROM cust
  UNION ALL SELECT cpath, 'Nation', 4, 4, NULL, c_nationkey::BIGINT FROM cust
  UNION ALL SELECT cpath, 'Key', 11, 8, NULL, c_custkey FROM cust
  UNION ALL SELECT opath, 'Status', 1, (length(o_orderstatus) + 1) * 2, o_orderstatus, NULL FROM ord
  UNION ALL SELECT opath, 'Key', 11, 8, NULL, o_orderkey FROM ord
  UNION ALL SELECT opath, '', 1, (length(o_orderpriority) + 1) * 2, o_orderpriority, NULL FROM ord)"""

_SNAP = r"""
src AS (SELECT 'Orders\D' || (o_orderkey % 100) || '\O' || o_orderkey AS path, epoch(o_orderdate)::BIGINT AS w, * FROM orders),
old_k AS (SELECT path, w AS last_write FROM src WHERE o_orderkey % 10 <> 0),
new_k AS (SELECT path, w AS last_write FROM src WHERE o_orderkey % 10 <> 1),
old_v AS (SELECT path AS key_path, 'Status' AS name, o_orderstatus AS s FROM src WHERE o_orderkey % 10 <> 0 UNION ALL SELECT path, '', o_orderpriority FROM src WHERE o_orderkey % 10 <> 0),
new_v AS (SELECT path AS key_path, 'Status' AS name, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM src WHERE o_orderkey % 10 <> 1 UNION ALL SELECT path, '', o_orderpriority FROM src WHERE o_orderkey % 10 <> 1),
vd AS (SELECT coalesce(o.key_path, n.key_path) AS key_path, coalesce(o.name, n.name) AS name, CASE WHEN o.key_path IS NULL THEN 'added' WHEN n.key_path IS NULL THEN 'removed' WHEN o.s IS DISTINCT FROM n.s THEN 'modified' ELSE 'unchanged' END AS status FROM old_v o FULL JOIN new_v n ON o.key_path = n.key_path AND o.name = n.name),
touched AS (SELECT DISTINCT key_path FROM vd WHERE status <> 'unchanged'),
kd AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN o.last_write <> n.last_write OR coalesce(o.path, n.path) IN (SELECT key_path FROM touched) THEN 'modified' ELSE 'unchanged' END AS status FROM old_k o FULL JOIN new_k n ON o.path = n.path)"""

_OPS = r"""
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
ops AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_id,
  CASE WHEN event_type = 'signup' THEN 'create_key' WHEN event_type = 'error' THEN CASE WHEN k % 4 = 0 THEN 'delete_key' ELSE 'delete_value' END ELSE 'set_value' END AS op,
  'users\u' || (user_id % 5) || '\t' || user_id || CASE WHEN k % 3 <> 0 THEN '\k' || (k % 7) ELSE '' END AS path,
  CASE WHEN k % 5 = 0 THEN '' ELSE event_type END AS vname, CAST(round(value * 100) AS BIGINT) AS number FROM ev),
anc AS (SELECT seq, event_id, op, path, unnest(list_transform(range(1, len(string_split(path, '\')) + 1), lambda i: array_to_string(string_split(path, '\')[1:i], '\'))) AS top FROM ops),
del AS (SELECT path AS top, max(seq) AS d FROM ops WHERE op = 'delete_key' GROUP BY 1),
dead AS (SELECT a.path, max(d) AS dead FROM (SELECT DISTINCT path, top FROM anc) a JOIN del USING (top) GROUP BY 1)"""


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql.strip()
        return f

    return add


def _customer_path(spark: SparkSession, sf_dir: str, key: int = 1) -> str:
    """The path of one customer, a one-row lookup with the filter in the scan."""
    return views._customers(spark, sf_dir).where(F.col("c_custkey") == key).first()["cpath"]


# ---- lookup and listing


@query(f"WITH {_TREE} SELECT path, name FROM keys WHERE depth = 1")
def list_keys_root(spark, sf):
    return read.list_keys(views.keys(spark, sf), "", recursive=False).select("path", "name")


@query(rf"WITH {_TREE} SELECT path, depth FROM keys WHERE path LIKE 'ASIA\%' ESCAPE '^'")
def list_keys_recursive(spark, sf):
    return read.list_keys(views.keys(spark, sf), "HKLM\\Asia").select("path", "depth")


@query(rf"WITH {_TREE} SELECT path, depth FROM keys WHERE path LIKE 'EUROPE\%' ESCAPE '^' AND depth <= 3")
def list_keys_maxdepth2(spark, sf):
    return read.list_keys(views.keys(spark, sf), "/europe/", max_depth=2).select("path", "depth")


@query(rf"WITH {_TREE} SELECT path, name, depth FROM keys WHERE path = (SELECT cpath FROM cust WHERE c_custkey = 1)")
def find_key_ci(spark, sf):
    p = _customer_path(spark, sf)
    return read.find(views.keys(spark, sf), "hkey_local_machine/ " + p.swapcase().replace("\\", "//")).select("path", "name", "depth")


@query(rf"WITH {_TREE} SELECT path, depth FROM keys WHERE path = (SELECT cpath FROM cust WHERE c_custkey = 2)")
def get_child(spark, sf):
    parent, _, name = _customer_path(spark, sf, 2).rpartition("\\")
    return read.get_child(views.keys(spark, sf), parent.lower(), name.lower()).select("path", "depth")


@query(f"WITH {_TREE} SELECT name, reg_type, size, string_val, number_val FROM vals WHERE key_path = (SELECT cpath FROM cust WHERE c_custkey = 1)")
def list_values(spark, sf):
    return read.list_values(views.values(spark, sf), _customer_path(spark, sf)).select("name", "reg_type", "size", "string_val", "number_val")


@query(f"WITH {_TREE} SELECT name, string_val FROM vals WHERE key_path = (SELECT cpath FROM cust WHERE c_custkey = 1) AND name = 'Segment'")
def get_value_ci(spark, sf):
    return read.get_value(views.values(spark, sf), _customer_path(spark, sf).lower(), "SEGMENT").select("name", "string_val")


@query(rf"WITH {_TREE} SELECT path, depth FROM keys WHERE path = (SELECT place FROM places JOIN cust ON c_nationkey = n_nationkey WHERE c_custkey = 1)")
def parent_of(spark, sf):
    return read.parent_of(views.keys(spark, sf), _customer_path(spark, sf)).select("path", "depth")


@query(f"WITH {_TREE}, k AS (SELECT parent_path AS p, count(*) AS n FROM keys GROUP BY 1), v AS (SELECT key_path AS p, count(*) AS n FROM vals GROUP BY 1) SELECT path, coalesce(k.n, 0) AS subkey_n, coalesce(v.n, 0) AS value_n FROM keys LEFT JOIN k ON k.p = path LEFT JOIN v ON v.p = path")
def stat_keys(spark, sf):
    return read.with_counts(views.keys(spark, sf), views.values(spark, sf)).select("path", "subkey_n", "value_n")


@query(rf"WITH {_TREE} SELECT path, lower(path) AS preorder, row_number() OVER (PARTITION BY parent_path ORDER BY lower(name)) AS place FROM keys")
def tree_preorder(spark, sf):
    """Each key's place among its parent's children, and the text that puts all keys in pre-order."""
    from pyspark.sql import Window

    t = read.tree(views.keys(spark, sf))
    place = F.row_number().over(Window.partitionBy("parent_path").orderBy(F.lower("name"))).cast("long")
    return t.select("path", F.array_join("preorder_key", "\\").alias("preorder"), place.alias("place"))


@query(f"WITH RECURSIVE {_TREE}, walk AS (SELECT 'AFRICA' AS node, 0 AS level UNION ALL SELECT k.path, level + 1 FROM walk JOIN keys k ON k.parent_path = node) SELECT level, count(*) AS n FROM walk GROUP BY level")
def walk_recursive(spark, sf):
    k = views.keys(spark, sf)
    edges = k.select(F.col("parent_path").alias("parent"), F.col("path").alias("child"))
    root = k.where("path = 'AFRICA'").select(F.col("path").alias("node"))
    return read.walk(edges, root).groupBy("level").agg(F.count("*").alias("n"))


@query(rf"WITH {_TREE} SELECT (SELECT count(*) FROM keys WHERE path LIKE 'ASIA\%' ESCAPE '^') AS subkeys, false AS allowed")
def delete_guard(spark, sf):
    return read.can_delete(views.keys(spark, sf), "asia")


# ---- search and presence


@query(f"WITH {_TREE} SELECT path FROM keys WHERE lower(name) LIKE '%c1%'")
def search_keys_substr(spark, sf):
    return search.search_keys(views.keys(spark, sf), "C1").select("path")


def _document_values(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select(F.concat(F.lit("Docs\\"), "source").alias("key_path"), F.concat(F.lit("D"), "doc_id").alias("name"), F.lit(1).alias("reg_type"), ((F.char_length("text") + 1) * 2).cast("long").alias("size"), F.col("text").alias("string_val"))


@query("SELECT 'Docs\\' || source AS key_path, 'D' || doc_id AS name FROM documents WHERE regexp_matches(text, '(?i)th[ae]n[a-c]+') OR regexp_matches('D' || doc_id, '(?i)th[ae]n[a-c]+')")
def search_values_regex(spark, sf):
    return search.search_values(_document_values(spark, sf), "th[ae]n[a-c]+", regex=True).select("key_path", "name")


@query(f"WITH {_TREE} SELECT path FROM keys WHERE lower(name) LIKE '%o1%' ORDER BY path LIMIT 25")
def search_limit_topk(spark, sf):
    return search.search_keys(views.keys(spark, sf), "o1", limit=25).select("path")


@query(rf"WITH {_TREE}, way AS (SELECT DISTINCT unnest(list_transform(range(1, depth + 1), lambda i: array_to_string(string_split(path, '\')[1:i], '\'))) AS path FROM keys WHERE lower(name) LIKE '%o10%') SELECT path, depth FROM keys WHERE path IN (SELECT path FROM way)")
def filter_with_ancestors(spark, sf):
    return search.filter_tree(views.keys(spark, sf), "o10").select("path", "depth")


@query(f"WITH {_TREE}, hit AS (SELECT key_path, CASE WHEN contains(lower(name), 'ke') THEN 1 WHEN contains(CASE reg_type WHEN 1 THEN 'reg_sz' WHEN 4 THEN 'reg_dword' ELSE 'reg_qword' END, 'ke') THEN 2 WHEN contains(lower(coalesce(string_val, number_val::VARCHAR)), 'ke') THEN 3 END AS place FROM vals) SELECT key_path, count(*) AS n_matches, ['name', 'type', 'value'][min(place)] AS matched_in FROM hit WHERE place IS NOT NULL GROUP BY 1")
def global_value_search(spark, sf):
    v = views.values(spark, sf)
    return search.global_search(v, F.coalesce("string_val", F.col("number_val").cast("string")), "KE")


def _wanted(spark, sf):
    cust = views._customers(spark, sf)
    return cust.select(F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Nowhere\\C"), "c_custkey")).otherwise(F.upper("cpath")).alias("path"))


_WANTED = r"wanted AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'Nowhere\C' || c_custkey ELSE upper(cpath) END AS path FROM cust)"


@query(f"WITH {_TREE}, {_WANTED} SELECT path FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE lower(k.path) = lower(w.path))")
def presence_missing(spark, sf):
    return read.missing(views.keys(spark, sf), _wanted(spark, sf))


@query(f"WITH {_TREE}, {_WANTED}, hit AS (SELECT lower(w.path) IN (SELECT lower(path) FROM keys) AS h FROM wanted w) SELECT count(*) FILTER (h) AS n_present, count(*) FILTER (NOT h) AS n_missing, bool_and(h) AS all_present FROM hit")
def presence_all(spark, sf):
    return read.presence(views.keys(spark, sf), _wanted(spark, sf))


# ---- statistics


@query(f"WITH {_TREE} SELECT (SELECT count(*) FROM keys) AS n_keys, (SELECT max(depth) FROM keys) AS max_depth, (SELECT count(*) FROM vals) AS n_values, (SELECT sum(size)::BIGINT FROM vals) AS total_size")
def stats_totals(spark, sf):
    return stats.totals(views.keys(spark, sf), views.values(spark, sf))


@query(f"WITH {_TREE} SELECT depth, count(*) AS n FROM keys GROUP BY 1")
def keys_by_level(spark, sf):
    return stats.by_level(views.keys(spark, sf))


@query(f"WITH {_TREE} SELECT CASE reg_type WHEN 1 THEN 'REG_SZ' WHEN 4 THEN 'REG_DWORD' ELSE 'REG_QWORD' END AS type_name, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM vals), 4) AS pct FROM vals GROUP BY 1")
def values_by_type_pct(spark, sf):
    return stats.by_type(views.values(spark, sf))


@query("WITH v AS (SELECT (length(text) + 1) * 2 AS s FROM documents) SELECT CASE WHEN s < 100 THEN '<100' WHEN s < 1024 THEN '100-1K' WHEN s < 10240 THEN '1K-10K' ELSE '>10K' END AS bucket, count(*) AS n FROM v GROUP BY 1")
def value_size_buckets(spark, sf):
    return stats.size_buckets(_document_values(spark, sf))


@query(f"WITH {_TREE} SELECT parent_path AS path, count(*) AS subkey_n FROM keys WHERE parent_path <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def largest_key(spark, sf):
    return stats.largest_key(views.keys(spark, sf))


@query("SELECT 'Docs\\' || source AS key_path, 'D' || doc_id AS name, ((length(text) + 1) * 2)::BIGINT AS size FROM documents ORDER BY size DESC, key_path, name LIMIT 1")
def largest_value(spark, sf):
    return stats.largest_value(_document_values(spark, sf))


@query("WITH g AS (SELECT l_suppkey, sum(l_quantity)::BIGINT AS used, (count(*) * 50)::BIGINT AS capacity FROM lineitem GROUP BY 1) SELECT *, round(used * 100.0::DOUBLE / capacity, 4) AS efficiency FROM g ORDER BY 4, 1 LIMIT 20")
def worst_k_efficiency(spark, sf):
    cells = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    return stats.worst_bins(cells, "l_suppkey", F.count("*") * 50)


@query("WITH g AS (SELECT l_suppkey, sum(l_quantity)::BIGINT * 100.0::DOUBLE / (count(*) * 50) AS x FROM lineitem GROUP BY 1), e AS (SELECT round(x, 4) AS e FROM g) SELECT CASE WHEN e >= 100 THEN '100' WHEN e >= 99 THEN '99' WHEN e >= 98 THEN '98' WHEN e >= 95 THEN '95' ELSE '<95' END AS class, count(*) AS n, count(*) FILTER (e < 80) AS poor FROM e GROUP BY 1")
def efficiency_classes(spark, sf):
    cells = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", F.col("l_quantity").cast("long").alias("size"))
    bins = cells.groupBy("l_suppkey").agg(F.round(c.percent(F.sum("size"), F.count("*") * 50), 4).alias("efficiency"))
    return stats.efficiency_classes(bins)


@query(rf"WITH {_TREE} SELECT top AS path, count(*) AS n FROM (SELECT unnest(list_transform(range(1, depth), lambda i: array_to_string(string_split(path, '\')[1:i], '\'))) AS top FROM keys) GROUP BY 1")
def subtree_counts(spark, sf):
    return stats.subtree_counts(views.keys(spark, sf))


# ---- differences


def _diffs(spark, sf):
    (ok, ov), (nk, nv) = views.snapshots(spark, sf)
    vd = diff.diff_values(ov, nv, data=("string_val",))
    return diff.diff_keys(ok, nk, vd), vd


@query(f"WITH {_SNAP} SELECT * FROM kd")
def diff_keys(spark, sf):
    return _diffs(spark, sf)[0]


@query(f"WITH {_SNAP} SELECT * FROM vd")
def diff_values(spark, sf):
    return _diffs(spark, sf)[1]


@query(rf"WITH {_SNAP}, hit AS (SELECT path, status FROM kd WHERE status IN ('added', 'removed')), way AS (SELECT DISTINCT unnest(['Orders', 'Orders\' || split_part(path, '\', 2)]) AS path FROM hit) SELECT path, status, false AS context FROM hit UNION ALL SELECT path, 'unchanged', true FROM way")
def diff_filter_ctx(spark, sf):
    return diff.filter_diff(_diffs(spark, sf)[0], "added", "removed")


@query(f"WITH {_SNAP} SELECT status, count(*) AS n FROM kd GROUP BY 1")
def diff_summary(spark, sf):
    return diff.summary(_diffs(spark, sf)[0])


@query(f"WITH {_SNAP} SELECT key_path, name, status FROM vd WHERE key_path IN (SELECT path FROM kd WHERE status IN ('modified', 'unchanged'))")
def diff_common_only(spark, sf):
    kd, vd = _diffs(spark, sf)
    return diff.common_values(vd, kd)


@query(f"WITH {_SNAP} SELECT key_path, name, CASE status WHEN 'added' THEN '+ ' WHEN 'removed' THEN '- ' WHEN 'modified' THEN '~ ' ELSE '  ' END || key_path || ' : ' || CASE WHEN name = '' THEN '(Default)' ELSE name END AS line FROM vd")
def diff_unified(spark, sf):
    return diff.unified(_diffs(spark, sf)[1])


# ---- change logs


def _ops(spark, sf):
    return views.edit_ops(spark, sf).withColumn("path_norm", F.lower("path"))


_DEDUP = "ded AS (SELECT max_by(event_id, seq) AS event_id, max(seq) AS seq FROM ops GROUP BY path, CASE op WHEN 'delete_key' THEN 'd' WHEN 'create_key' THEN 'k' ELSE 'v' END, CASE WHEN op IN ('set_value', 'delete_value') THEN vname ELSE '' END)"


@query(f"WITH {_OPS}, {_DEDUP} SELECT o.event_id AS id, op, path FROM ops o JOIN ded USING (event_id)")
def op_dedup_lww(spark, sf):
    return oplog.dedup(_ops(spark, sf)).select(F.col("seq.id").alias("id"), "op", "path")


@query(f"WITH {_OPS} SELECT event_id AS id, op FROM ops WHERE seq NOT IN (SELECT a.seq FROM anc a JOIN del USING (top) WHERE d > a.seq)")
def op_shadow_delete(spark, sf):
    return oplog.drop_shadowed(_ops(spark, sf)).select(F.col("seq.id").alias("id"), "op")


@query(rf"WITH {_OPS}, {_DEDUP} SELECT event_id AS id, path, len(string_split(path, '\'))::INTEGER AS depth, CASE op WHEN 'create_key' THEN 0 WHEN 'delete_key' THEN 1 WHEN 'delete_value' THEN 2 ELSE 3 END AS prio FROM ops JOIN ded USING (event_id) WHERE event_id NOT IN (SELECT a.event_id FROM anc a JOIN del USING (top) WHERE d > a.seq)")
def op_order(spark, sf):
    return oplog.optimize(_ops(spark, sf)).select(F.col("seq.id").alias("id"), "path", "depth", "prio")


@query(f"WITH {_OPS}, {_DEDUP}, n AS (SELECT (SELECT count(*) FROM ops) AS n_in, (SELECT count(*) FROM ded) AS n_dedup, (SELECT count(*) FROM ded WHERE event_id NOT IN (SELECT a.event_id FROM anc a JOIN del USING (top) WHERE d > a.seq)) AS n_out) SELECT *, round((n_in - n_out) * 100.0::DOUBLE / n_in, 4) AS reduction_pct FROM n")
def op_stats(spark, sf):
    return oplog.optimize_stats(_ops(spark, sf))


@query(f"WITH {_OPS}, made AS (SELECT top AS path, max(seq) AS seq FROM anc WHERE op IN ('create_key', 'set_value') GROUP BY 1), d2 AS (SELECT m.path, max(d) AS dead FROM (SELECT path, unnest(list_transform(range(1, len(string_split(path, '\\')) + 1), lambda i: array_to_string(string_split(path, '\\')[1:i], '\\'))) AS top FROM made) m JOIN del USING (top) GROUP BY 1) SELECT path FROM made LEFT JOIN d2 USING (path) WHERE dead IS NULL OR seq > dead")
def apply_keys(spark, sf):
    return apply.live_keys(_ops(spark, sf)).select("path")


_LIVE = "live AS (SELECT l.path, name, number FROM (SELECT path, vname AS name, max(seq) AS seq, max_by(op, seq) AS op, max_by(number, seq) AS number FROM ops WHERE op IN ('set_value', 'delete_value') GROUP BY 1, 2) l LEFT JOIN dead USING (path) WHERE op = 'set_value' AND (dead IS NULL OR seq > dead))"


@query(f"WITH {_OPS}, {_LIVE} SELECT * FROM live")
def apply_values(spark, sf):
    return apply.live_values(_ops(spark, sf), ["number"]).select("path", "name", "number")


_HALF = 1_710_000_000_000_000  # microseconds; inside the events' span or not, the query means the same


@query(f"WITH {_OPS}, {_LIVE}, half AS (SELECT o.* FROM ops o JOIN events e USING (event_id) WHERE epoch_us(e.ts) < {_HALF}), hdel AS (SELECT path AS top, max(seq) AS d FROM half WHERE op = 'delete_key' GROUP BY 1), hdead AS (SELECT a.path, max(d) AS dead FROM (SELECT DISTINCT path, top FROM anc) a JOIN hdel USING (top) GROUP BY 1), b AS (SELECT l.path, name, number FROM (SELECT path, vname AS name, max(seq) AS seq, max_by(op, seq) AS op, max_by(number, seq) AS number FROM half WHERE op IN ('set_value', 'delete_value') GROUP BY 1, 2) l LEFT JOIN hdead USING (path) WHERE op = 'set_value' AND (dead IS NULL OR seq > dead)), j AS (SELECT b.path AS bp, live.path AS ap, b.number AS bn, live.number AS an FROM b FULL JOIN live ON b.path = live.path AND b.name = live.name) SELECT count(*) FILTER (bp IS NULL) AS n_created, count(*) FILTER (ap IS NULL) AS n_deleted, count(*) FILTER (bp IS NOT NULL AND ap IS NOT NULL AND bn <> an) AS n_changed, count(*) FILTER (bp IS NOT NULL AND ap IS NOT NULL AND bn = an) AS n_same FROM j")
def apply_counts(spark, sf):
    ops = _ops(spark, sf)
    before = apply.live_values(ops.where(F.col("seq.ts") < _HALF), ["number"])
    return apply.applied(before, apply.live_values(ops, ["number"]), ["path_norm", "name"], ["number"])


@query(f"WITH {_OPS} SELECT event_id AS id, 'Software\\Base\\' || path AS path FROM ops")
def prefix_transform(spark, sf):
    return oplog.with_prefix(_ops(spark, sf), "HKLM\\Software\\Base").select(F.col("seq.id").alias("id"), "path")


def _link_sides(spark, sf):
    v = views.values(spark, sf).select("key_path", "name", "string_val")
    sup = spark.read.parquet(f"{sf}/supplier.parquet")
    child = sup.select(F.concat(F.lit("ASIA\\S"), "s_suppkey").alias("key_path"), F.lit("Name").alias("name"), F.col("s_name").alias("string_val"))
    again = views._customers(spark, sf).where("c_custkey % 10 = 0").select("cpath", F.lit("SEGMENT").alias("name"), F.lit("linked").alias("string_val"))
    return v, link.mounted(child, "key_path", "Mounted", flatten="asia").unionByName(again.select(F.col("cpath").alias("key_path"), "name", "string_val"))


_LINK = r"child AS (SELECT 'Mounted\S' || s_suppkey AS key_path, 'Name' AS name, s_name AS string_val FROM supplier UNION ALL SELECT cpath, 'SEGMENT', 'linked' FROM cust WHERE c_custkey % 10 = 0)"


@query(f"WITH {_TREE}, {_LINK} SELECT key_path, name, string_val FROM vals v WHERE NOT EXISTS (SELECT 1 FROM child c WHERE lower(c.key_path) = lower(v.key_path) AND lower(c.name) = lower(v.name)) UNION ALL SELECT * FROM child")
def link_overwrite(spark, sf):
    return link.link_values(*_link_sides(spark, sf), conflict=link.OVERWRITE)


@query(f"WITH {_TREE}, {_LINK} SELECT key_path, name, string_val FROM vals UNION ALL SELECT * FROM child c WHERE NOT EXISTS (SELECT 1 FROM vals v WHERE lower(c.key_path) = lower(v.key_path) AND lower(c.name) = lower(v.name))")
def link_skip(spark, sf):
    return link.link_values(*_link_sides(spark, sf), conflict=link.SKIP)


@query(rf"WITH {_TREE}, k AS (SELECT 'Mounted\S' || s_suppkey AS p FROM supplier) SELECT path FROM keys UNION SELECT p FROM k UNION SELECT 'Mounted'")
def link_keys(spark, sf):
    sup = spark.read.parquet(f"{sf}/supplier.parquet").select(F.concat(F.lit("S"), "s_suppkey").alias("path"))
    return link.link_keys(views.keys(spark, sf), link.mounted(sup, "path", "Mounted"))


# ---- constraints

_LIMITS = Limits(subkeys=40, values=2, value_size=22, key_name=8, value_name=6, depth=3)
_VIOLATIONS = r"""viol AS (
  SELECT 'depth' AS rule, path, depth::BIGINT AS found, 3::BIGINT AS most FROM keys WHERE depth > 3
  UNION ALL SELECT 'key_name', path, length(name), 8 FROM keys WHERE length(name) > 8
  UNION ALL SELECT 'subkeys', parent_path, count(*), 40 FROM keys GROUP BY 2 HAVING count(*) > 40
  UNION ALL SELECT 'value_name', key_path, length(name), 6 FROM vals WHERE length(name) > 6
  UNION ALL SELECT 'value_size', key_path, size, 22 FROM vals WHERE size > 22
  UNION ALL SELECT 'values', key_path, count(*), 2 FROM vals GROUP BY 2 HAVING count(*) > 2)"""


@query(f"WITH {_TREE}, {_VIOLATIONS} SELECT * FROM viol")
def validate_limits(spark, sf):
    return checks.validate(views.keys(spark, sf), views.values(spark, sf), _LIMITS)


@query(f"WITH {_TREE}, {_VIOLATIONS} SELECT * FROM viol ORDER BY lower(path), rule LIMIT 1")
def validate_first_violation(spark, sf):
    return checks.first_violation(checks.validate(views.keys(spark, sf), views.values(spark, sf), _LIMITS))


@query(f"WITH {_TREE}, {_VIOLATIONS} SELECT CASE WHEN rule IN ('depth', 'subkeys') THEN 'error' ELSE 'warning' END AS severity, count(*) AS n, 0 AS n_repairable FROM viol GROUP BY 1")
def severity_summary(spark, sf):
    v = checks.validate(views.keys(spark, sf), views.values(spark, sf), _LIMITS)
    return checks.severity_summary(v.withColumn("severity", F.when(F.col("rule").isin("depth", "subkeys"), "error").otherwise("warning")))


# ---- text and binary forms


def _parts(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    path = F.concat_ws(c.SEP, F.lit("Parts"), "p_brand", F.concat(F.lit("P"), "p_partkey"))
    one = F.struct(F.lit("Name\"x\\").alias("name"), F.lit(1).alias("reg_type"), c.sz_bytes("p_name").alias("data"))
    two = F.struct(F.lit("").alias("name"), F.lit(4).alias("reg_type"), c.dword_bytes("p_size").alias("data"))
    return p.select(path.alias("path"), "p_brand"), p.select(path.alias("key_path"), "p_brand", F.explode(F.array(one, two)).alias("v")).select("key_path", "p_brand", "v.*")


_LINES = r"""pk AS (SELECT 'Parts\' || p_brand || '\P' || p_partkey AS path, * FROM part)"""


@query(rf"""WITH {_LINES} SELECT path, 0 AS kind, '[' || path || ']' AS line FROM pk UNION ALL SELECT path, 1, '"Name\"x\\"="' || replace(replace(p_name, '\', '\\'), '"', '\"') || '"' FROM pk UNION ALL SELECT path, 1, '@=dword:' || printf('%08x', p_size) FROM pk""")
def reg_emit_lines(spark, sf):
    from .sources import regtext

    k, v = _parts(spark, sf)
    lines = regtext.lines(k, v)
    path = F.concat_ws(c.SEP, "preorder")
    named = lines.select(path.alias("low"), "kind", "line")
    return named.join(k.select(F.lower("path").alias("low"), "path").distinct(), "low").select("path", "kind", "line")


@query(rf"""WITH {_LINES} SELECT path, 'Name"x\' AS name, p_name AS string_val, NULL::BIGINT AS dword_val FROM pk UNION ALL SELECT path, '', NULL, p_size::BIGINT FROM pk""")
def reg_parse_roundtrip(spark, sf):
    from .sources import regtext

    k, v = _parts(spark, sf)
    lines = regtext.lines(k, v).withColumn("file", F.get("preorder", F.lit(1)))
    text = lines.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("preorder", "kind", "name", "line"))), lambda x: x.line), "\r\n").alias("body"))
    files = text.select(F.col("file").alias("path"), F.encode(F.concat(F.lit(regtext.HEADER + "\r\n\r\n"), "body"), "UTF-16LE").alias("content"))
    ops = regtext.parse_files(files).where(F.col("op") == SET)
    d = c.decode_value("reg_type", "data")
    return ops.select("path", "name", d["string_val"].alias("string_val"), d["dword_val"].alias("dword_val"))


@query("SELECT p_partkey, p_size::BIGINT AS back, lower(printf('%02x%02x%02x%02x', p_size % 256, (p_size // 256) % 256, (p_size // 65536) % 256, (p_size // 16777216) % 256)) AS hex FROM part")
def dword_hex_decode(spark, sf):
    b = c.dword_bytes("p_size")
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", c.dword(b).alias("back"), F.lower(F.hex(b)).alias("hex"))


@query("SELECT n_name, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(upper(n_name), ''), lambda x: ord(x)::BIGINT)), lambda a, x: (a * 37 + x) % 4294967296) AS hash FROM nation")
def lh_hash(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_name", c.lh_hash("n_name").alias("hash"))


@query(f"WITH {_OPS} SELECT event_id AS id, op, path, CASE WHEN op IN ('set_value', 'delete_value') THEN vname END AS name, CASE WHEN op = 'set_value' THEN number END AS number FROM ops")
def json_patch_roundtrip(spark, sf):
    ops = _ops(spark, sf).withColumns({"reg_type": F.when(F.col("op") == SET, 11), "data": c.qword_bytes("number"), "seq": F.col("seq.id")})
    back = oplog.from_patch(oplog.to_patch(ops))
    return back.select(F.col("seq").alias("id"), "op", "path", "name", c.qword("data").cast("long").alias("number"))


@query("SELECT o_orderkey, epoch_us(o_orderdate)::BIGINT * 10 + 116444736000000000 AS ft, epoch_us(o_orderdate)::BIGINT AS us FROM orders")
def filetime_roundtrip(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    return o.select("o_orderkey", c.micros_to_filetime("us").alias("ft"), c.filetime_to_micros(c.micros_to_filetime("us")).alias("us"))


@query("SELECT doc_id, text AS back, hash AS ok FROM (SELECT doc_id, text, true AS hash FROM documents)")
def utf16_roundtrip(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", c.utf16(c.sz_bytes("text")).alias("back"), (F.octet_length(c.sz_bytes("text")) % 2 == 0).alias("ok"))


@query("SELECT conv_id, string_agg(text, ' / ' ORDER BY turn) AS parts FROM conversations WHERE text <> '' GROUP BY 1")
def multi_sz_roundtrip(spark, sf):
    v = spark.read.parquet(f"{sf}/conversations.parquet").where("text <> ''")
    g = v.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x.text).alias("parts"))
    return g.select("conv_id", F.array_join(c.utf16_list(c.multi_sz_bytes("parts")), " / ").alias("parts"))


@query("SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(url, '\\', '/'), '/'), lambda x: trim(x)), lambda x: x <> ''), '\\') AS path FROM pages")
def url_paths(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", c.clean_path("url").alias("path"))


@query("SELECT vec_id, string_split(lower(regexp_replace(hex(label::VARCHAR), '(..)', '\\1,', 'g')), ',')[1] AS first_byte FROM embeddings")
def hex_list_first(spark, sf):
    b = F.encode(F.col("label").cast("string"), "UTF-8")
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.get(F.split(c.hex_list(c.parse_hex_list(c.hex_list(b))), ","), F.lit(0)).alias("first_byte"))


def _hives(spark, sf):
    """One image for each region."""
    from .sources import hivewriter

    cust = views._customers(spark, sf)
    hive = F.substring_index("cpath", c.SEP, 1)
    rest = F.substring(F.col("cpath"), F.length(hive) + 2, F.length("cpath"))
    k = cust.select(hive.alias("hive_id"), rest.alias("path"))
    v = cust.select(hive.alias("hive_id"), rest.alias("key_path"), F.lit("Segment").alias("name"), F.lit(1).alias("reg_type"), c.sz_bytes("c_mktsegment").alias("data"))
    return hivewriter.write(k, v).select("hive_id", F.col("image").alias("content"))


@query(rf"WITH {_TREE} SELECT split_part(cpath, '\', 1) AS hive_id, split_part(cpath, '\', 2) || '\' || split_part(cpath, '\', 3) AS key_path, 'Segment' AS name, c_mktsegment AS string_val FROM cust")
def regf_roundtrip(spark, sf):
    from .sources import regf

    v = regf.take_apart(_hives(spark, sf), "values", tolerant=False, id_col="hive_id")
    return v.select("hive_id", "key_path", "name", c.decode_value("reg_type", "data")["string_val"].alias("string_val"))


@query("SELECT r_name AS hive_id, unnest(['cells', 'checksum', 'file_size', 'hbins', 'root', 'sequence']) AS \"check\", true AS holds FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey)")
def verify_images(spark, sf):
    from .sources import regf

    t = regf.tables(_hives(spark, sf), id_col="hive_id")
    return checks.verify(t["hives"], t["hbins"], t["cells"])


_IN_USE = "SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey"
#: Records of an image: its customers, their nations and the root.
_NK = "nk AS (SELECT n_regionkey AS k, (count(DISTINCT c_custkey) + count(DISTINCT n_nationkey) + 1)::BIGINT AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1)"


@query(f"WITH {_NK} SELECT r_name AS hive_id, 'warning' AS severity, 'sequence numbers differ' AS issue, 1::BIGINT AS n FROM region WHERE r_regionkey IN ({_IN_USE}) UNION ALL SELECT r_name, 'error', 'checksum differs', 1 FROM region WHERE r_regionkey IN ({_IN_USE}) UNION ALL SELECT r_name, 'info', 'no last write time', n FROM nk JOIN region ON k = r_regionkey")
def diagnose_images(spark, sf):
    """Images whose second sequence number was overwritten."""
    from .sources import regf

    files = _hives(spark, sf)
    dirty = files.withColumn("content", F.overlay("content", F.lit(b"\x09\x00\x00\x00"), F.lit(9)))
    t = regf.tables(dirty, id_col="hive_id")
    found = checks.diagnose(t["hives"], t["hbins"], t["cells"], t["keys"], t["refs"], t["errors"])
    return found.groupBy("hive_id", "severity", "issue").agg(F.count("*").alias("n"))


@query(f"WITH {_TREE} SELECT lower(path) AS path_norm, repeat(' ', (depth - 1) * 2) || name AS line FROM keys")
def text_tree(spark, sf):
    return export.text_tree(views.keys(spark, sf)).select(F.array_join("preorder", "\\").alias("path_norm"), "line")


@query(f"WITH {_TREE}, v AS (SELECT key_path, CASE WHEN name = '' THEN '(Default)' ELSE name END AS name, CASE reg_type WHEN 1 THEN 'REG_SZ' WHEN 4 THEN 'REG_DWORD' ELSE 'REG_QWORD' END AS type, string_val, number_val FROM vals) SELECT path, v.name, type, coalesce(string_val, number_val::VARCHAR) AS value FROM keys LEFT JOIN v ON key_path = path")
def json_keys(spark, sf):
    v = views.values(spark, sf).withColumn("data", F.when(F.col("reg_type") == 1, c.sz_bytes("string_val")).when(F.col("reg_type") == 4, c.dword_bytes("number_val")).otherwise(c.qword_bytes("number_val")))
    j = export.json_keys(views.keys(spark, sf), v)
    back = F.from_json("json", "path string, name string, depth int, values array<struct<name: string, type: string, value: string>>")
    rows = j.select(back.alias("j")).select("j.path", F.explode_outer("j.values").alias("v"))
    return rows.select("path", "v.name", "v.type", "v.value")


@query("SELECT s_suppkey, CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f', b / 1024) || ' KB' ELSE printf('%.1f', b / 1048576) || ' MB' END AS shown FROM (SELECT s_suppkey, s_suppkey * s_suppkey * 8 AS b FROM supplier)")
def human_bytes(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", c.human_bytes(F.col("s_suppkey") * F.col("s_suppkey") * 8).alias("shown"))


@query(f"WITH {_OPS} SELECT op, count(*) AS n, count(DISTINCT path) AS n_paths FROM ops GROUP BY 1")
def op_counts(spark, sf):
    return _ops(spark, sf).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("path").alias("n_paths"))


# ---- printers, plans, sessions and repair


@query(rf"""WITH {_LINES},
u AS (SELECT path, p_name, array_to_string(list_transform(string_split(p_name, ''), lambda x: lower(hex(x)) || ',00'), ',') || ',00,00' AS hex FROM pk),
f AS (SELECT *, greatest(1, (80 - 4 - 18) // 3 + 1) AS k FROM u)
SELECT path, '"Name\"x\\"=hex(1):' || CASE WHEN length(hex) > 3 * k THEN substr(hex, 1, 3 * k - 1) || ',\' || chr(10) || '  ' || regexp_replace(substr(hex, 3 * k + 1), '(.{{74}}),', '\1,\\' || chr(10) || '  ', 'g') ELSE hex END AS line FROM f
UNION ALL SELECT path, '@=dword:' || printf('%08x', p_size) FROM pk UNION ALL SELECT path, '[\' || path || ']' FROM pk""")
def reg_print_lines(spark, sf):
    k, v = _parts(spark, sf)
    return export.printed_values(v).select(F.col("key_path").alias("path"), "line").unionByName(export.printed_keys(k))


@query(f"WITH {_TREE} SELECT lower(key_path) AS path_norm, name, repeat('  ', len(string_split(key_path, '\\'))) || CASE WHEN name = '' THEN '(Default)' ELSE name END || ' [REG_SZ] = ' || string_val AS line FROM vals WHERE reg_type = 1")
def text_values(spark, sf):
    v = views.values(spark, sf).where("reg_type = 1").withColumn("data", c.sz_bytes("string_val"))
    return export.text_values(v).select(F.array_join("preorder", "\\").alias("path_norm"), "name", "line")


@query(f"WITH {_TREE}, {_WANTED} SELECT k.path FROM keys k JOIN wanted w ON lower(w.path) = lower(k.path)")
def match_by_hash(spark, sf):
    w = _wanted(spark, sf).select(c.parent("path").alias("parent_path"), c.last_part("path").alias("name"))
    return read.match_children(views.keys(spark, sf), w).select("path")


@query(f"WITH {_OPS}, {_TREE.replace('keys AS', 'tkeys AS').strip()}, way AS (SELECT DISTINCT top AS path_norm FROM anc), aimed AS (SELECT path AS path_norm, count(*) AS n FROM ops GROUP BY 1), users AS (SELECT DISTINCT 'users\\u' || (user_id % 5) AS path_norm FROM events) SELECT path_norm, coalesce(n, 0)::BIGINT AS n_ops, path_norm IN (SELECT path_norm FROM users) AS exists FROM way LEFT JOIN aimed USING (path_norm)")
def annotate_plan(spark, sf):
    users = spark.read.parquet(f"{sf}/events.parquet").select(F.concat(F.lit("users\\u"), F.col("user_id") % 5).alias("path_norm"))
    return read.annotate(_ops(spark, sf), users)


@query("SELECT n_name AS file, count(c_custkey) AS n_keys, count(c_custkey) * 2 AS n_values, count(c_custkey) AS n_deletes FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def reg_log_counts(spark, sf):
    """Files in which each customer's section comes twice, with a value each, and a delete."""
    from .sources import regtext

    cust = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    part = F.concat(F.lit("[C"), "c_custkey", F.lit("]\r\n\"Segment\"=\""), "c_mktsegment", F.lit("\"\r\n[c"), "c_custkey", F.lit("]\r\n@=dword:00000001\r\n\"Old\"=-"))
    files = cust.groupBy(F.col("n_name").alias("path")).agg(F.concat(F.lit(regtext.HEADER + "\r\n"), F.array_join(F.collect_list(part), "\r\n")).alias("content"))
    return stats.log_counts(regtext.parse_files(files))


@query("SELECT c_custkey, n_name AS file FROM customer JOIN nation ON c_nationkey = n_nationkey")
def reg_first_create(spark, sf):
    """A key is created once in a file, by its first section, whatever the case of later ones."""
    from .sources import regtext

    cust = spark.read.parquet(f"{sf}/customer.parquet").join(spark.read.parquet(f"{sf}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey"))
    part = F.concat(F.lit("[C"), "c_custkey", F.lit("]\r\n[c"), "c_custkey", F.lit("]"))
    files = cust.groupBy(F.col("n_name").alias("path")).agg(F.concat(F.lit(regtext.HEADER + "\r\n"), F.array_join(F.collect_list(part), "\r\n")).alias("content"))
    ops = regtext.parse_files(files).where(F.col("op") == CREATE)
    return ops.select(F.expr("substring(path, 2)").cast("long").alias("c_custkey"), "file")


@query(f"WITH {_OPS} SELECT path, name, number FROM (SELECT path, vname AS name, number, op, row_number() OVER (PARTITION BY path, vname ORDER BY k % 2 DESC, seq DESC) AS r FROM (SELECT o.*, event_id AS k FROM ops o) WHERE op = 'set_value') WHERE r = 1")
def concat_logs(spark, sf):
    """Two logs one after the other: what the second sets wins, whatever the times."""
    ops = _ops(spark, sf).where(F.col("op") == SET)
    both = oplog.concat_logs(ops.where(F.col("seq.id") % 2 == 0), ops.where(F.col("seq.id") % 2 == 1))
    return oplog.dedup(both).select("path", "name", "number")


@query(f"WITH {_TREE}, {_LINK} SELECT c.key_path, c.name FROM child c JOIN vals v ON lower(c.key_path) = lower(v.key_path) AND lower(c.name) = lower(v.name)")
def link_conflicts(spark, sf):
    return link.conflicts(*_link_sides(spark, sf))


@query(rf"WITH {_TREE}, way AS (SELECT DISTINCT unnest(list_transform(range(1, 4), lambda i: array_to_string(string_split(cpath, '\')[1:i], '\'))) AS path FROM cust WHERE c_custkey % 5 <> 0) SELECT path FROM keys WHERE path IN (SELECT path FROM way)")
def filter_by_paths(spark, sf):
    return search.filter_paths(views.keys(spark, sf), _wanted(spark, sf)).select("path")


@query(f"WITH {_NK}, c AS (SELECT n_regionkey AS k, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1) SELECT r_name AS hive_id, 'nk' AS sig, nk.n FROM nk JOIN region ON k = r_regionkey UNION ALL SELECT r_name, 'vk', c.n FROM c JOIN region ON k = r_regionkey UNION ALL SELECT r_name, 'sk', 1 FROM nk JOIN region ON k = r_regionkey")
def cells_by_kind(spark, sf):
    from .sources import regf

    t = regf.tables(_hives(spark, sf), id_col="hive_id")
    use = stats.cells_by_use(t["cells"], t["refs"]).where("sig in ('nk', 'vk', 'sk')")
    return use.groupBy("hive_id", "sig").agg(F.sum("n").alias("n"))


@query(f"WITH {_NK} SELECT r_name AS hive_id, n AS ref_count, n AS used, true AS holds FROM nk JOIN region ON k = r_regionkey")
def security_counts(spark, sf):
    from .sources import regf

    t = regf.tables(_hives(spark, sf), id_col="hive_id")
    return checks.security_counts(t["security"], t["refs"]).select("hive_id", "ref_count", "used", "holds")


@query("SELECT r_name AS hive_id, 0::BIGINT AS bad_bins, true AS within FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey)")
def bin_efficiency(spark, sf):
    """Bins of written images: none holds more than it can, and the whole is between its parts."""
    from .sources import regf

    t = regf.tables(_hives(spark, sf), id_col="hive_id")
    bins = stats.bin_use(t["hbins"], t["cells"])
    bad = bins.groupBy("hive_id").agg(F.count_if((F.col("efficiency") > 100) | (F.col("used") <= 0)).alias("bad_bins"), F.min("efficiency").alias("lo"), F.max("efficiency").alias("hi"))
    return bad.join(stats.bin_summary(bins), "hive_id").select("hive_id", "bad_bins", ((F.col("overall") >= F.col("lo")) & (F.col("overall") <= F.col("hi"))).alias("within"))


@query("SELECT 'D' || doc_id AS name, md5(text) AS sum FROM documents WHERE source = (SELECT min(source) FROM documents)")
def big_values(spark, sf):
    """Texts as values, those over one block in several: written to an image and read back."""
    from .sources import hivewriter, regf

    d = spark.read.parquet(f"{sf}/documents.parquet")
    d = d.join(d.agg(F.min("source").alias("source")), "source").select(F.lit("h").alias("hive_id"), F.lit("Docs").alias("key_path"), F.concat(F.lit("D"), "doc_id").alias("name"), F.lit(1).alias("reg_type"), c.sz_bytes("text").alias("data"))
    image = hivewriter.write(d.select("hive_id", F.col("key_path").alias("path")).distinct(), d).select("hive_id", F.col("image").alias("content"))
    return regf.take_apart(image, "values", tolerant=False, id_col="hive_id").select("name", F.md5(F.encode(c.utf16("data"), "UTF-8")).alias("sum"))


@query("SELECT count(*) AS n, 2 + (CASE WHEN count(*) > 1024 THEN (count(*) + 1023) // 1024 ELSE 0 END)::BIGINT AS lists FROM customer")
def wide_key(spark, sf):
    """All customers under one key: over 1,024 subkeys the list is one of lists."""
    from .sources import hivewriter, regf

    cust = spark.read.parquet(f"{sf}/customer.parquet").select(F.lit("h").alias("hive_id"), F.concat(F.lit("All\\C"), "c_custkey").alias("path"))
    none = cust.select("hive_id", F.col("path").alias("key_path"), F.lit("").alias("name"), F.lit(0).alias("reg_type"), F.lit(None).cast("binary").alias("data")).where("false")
    t = regf.tables(hivewriter.write(cust, none).select("hive_id", F.col("image").alias("content")), tolerant=False, id_col="hive_id")
    return t["keys"].where("depth = 2").agg(F.count("*").alias("n")).join(t["refs"].where("kind = 'list'").agg(F.count("*").alias("lists")))


@query("SELECT n_name || ' é™ ' || chr(26085) AS wide, n_name || ' é™' AS narrow, n_nationkey FROM nation")
def name_encodings(spark, sf):
    """Names that fit one byte a character and names that need UTF-16, through an image."""
    from .sources import hivewriter, regf

    n = spark.read.parquet(f"{sf}/nation.parquet")
    key = n.select(F.lit("h").alias("hive_id"), F.concat("n_name", F.lit(" é™")).alias("path"), F.concat("n_name", F.lit(" é™ "), F.lit("日")).alias("name"), "n_nationkey")
    v = key.select("hive_id", F.col("path").alias("key_path"), "name", F.lit(4).alias("reg_type"), c.dword_bytes("n_nationkey").alias("data"))
    image = hivewriter.write(key.select("hive_id", "path"), v).select("hive_id", F.col("image").alias("content"))
    got = regf.take_apart(image, "values", tolerant=False, id_col="hive_id")
    return got.select(F.col("name").alias("wide"), F.col("key_path").alias("narrow"), c.dword("data").alias("n_nationkey"))


@query("SELECT r_name AS hive_id, length(place) AS name_bytes, 4 + 76 + length(place) AS record, place AS path FROM (SELECT r_name, n_name AS place FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT c_nationkey FROM customer))")
def record_sizes(spark, sf):
    from .api import Tree

    k, _ = Tree.from_images(_hives(spark, sf).withColumnRenamed("hive_id", "path")).layout()
    return k.where(~F.col("path").contains("\\") & (F.col("path") != "")).select("hive_id", "name_bytes", "record", "path")


def _broken(spark, sf):
    """Images with a second sequence number, a sum and a bin's offset that are wrong."""
    wrong = F.overlay("content", F.lit(b"\x09\x00\x00\x00"), F.lit(9))
    wrong = F.overlay(wrong, F.lit(b"\x01\x02\x03\x04"), F.lit(509))
    return _hives(spark, sf).withColumn("content", F.overlay(wrong, F.lit(b"\x00\x50\x00\x00"), F.lit(4096 + 5)))


@query(f"SELECT r_name AS hive_id, severity, n, repairable FROM region, (VALUES ('warning', 1::BIGINT, 1::BIGINT), ('error', 2, 2)) AS t(severity, n, repairable) WHERE r_regionkey IN ({_IN_USE})")
def diagnose_broken(spark, sf):
    from .sources import regf

    t = regf.tables(_broken(spark, sf), id_col="hive_id")
    found = checks.diagnose(*(t[x] for x in ("hives", "hbins", "cells", "keys", "refs", "errors"))).where("severity <> 'info'")
    return found.groupBy("hive_id", "severity").agg(F.count("*").alias("n"), F.count_if("repair.auto_apply").alias("repairable"))


@query("SELECT r_name AS hive_id, unnest(['cells', 'checksum', 'file_size', 'hbins', 'root', 'sequence']) AS \"check\", true AS holds FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey)")
def repair_images(spark, sf):
    """Broken images after the repairs that are safe: every check holds again."""
    from .operators import repair
    from .sources import regf

    files = _broken(spark, sf)
    t = regf.tables(files, id_col="hive_id")
    found = checks.diagnose(*(t[x] for x in ("hives", "hbins", "cells", "keys", "refs", "errors")))
    todo = repair.safe(repair.plan(found), files).where("safe").drop("safe")
    after = regf.tables(repair.apply(files, todo), id_col="hive_id")
    return checks.verify(after["hives"], after["hbins"], after["cells"])


@query(rf"""WITH {_TREE}, p AS (SELECT split_part(cpath, '\', 1) AS hive_id, split_part(cpath, '\', 2) AS nat, cpath FROM cust), e AS (SELECT hive_id, min(nat) AS lo, max(cpath) AS hi FROM p GROUP BY 1)
SELECT hive_id, 1 + count(DISTINCT nat) + count_if(nat <> lo)::BIGINT AS n_keys, count_if(nat <> lo AND cpath <> hi)::BIGINT AS n_values, 0 AS n_errors, 0 AS n_short FROM p JOIN e USING (hive_id) GROUP BY 1""")
def repair_records(spark, sf):
    """Images in which a key's subkey list, another's value list and a value's size are wrong, after repair: what was out of reach is gone, all else is whole."""
    from .operators import repair
    from .sources import regf

    names = ("hives", "hbins", "cells", "keys", "refs", "errors", "values")
    whole = _hives(spark, sf)
    t = regf.tables(whole, id_col="hive_id")
    field = lambda off, kind: (off + regf.HEADER_SIZE + 4 + regf.RECORD_FIELDS[kind][1] + 1).cast("int")
    k = t["keys"].groupBy("hive_id").agg(F.min_by("key_off", F.when(F.col("depth") == 1, F.col("path"))).alias("a"), F.max_by("key_off", F.when(F.col("depth") == 2, F.col("path"))).alias("b"))
    v = t["values"].groupBy("hive_id").agg(F.max_by("value_off", F.struct(F.substring_index("key_path", c.SEP, 1), -F.col("value_off"))).alias("v"))
    files = whole.join(k, "hive_id").join(v, "hive_id")
    for off, kind, wrong in (("a", "subkey_list", b"\xf0\xff\xff\x7f"), ("b", "value_list", b"\xf0\xff\xff\x7f"), ("v", "value_size", b"\x00\x10\x00\x00")):
        files = files.withColumn("content", F.overlay("content", F.lit(wrong), field(F.col(off), kind)))
    files = files.select("hive_id", "content")
    t = regf.tables(files, id_col="hive_id")
    todo = repair.safe(repair.plan(checks.diagnose(*(t[x] for x in names))), files).where("safe").drop("safe")
    t = regf.tables(repair.apply(files, todo), id_col="hive_id")
    n = lambda x, how: t[x].groupBy("hive_id").agg(how)
    out = n("keys", F.count("*").alias("n_keys")).join(n("values", F.count("*").alias("n_values")), "hive_id", "left").join(n("errors", F.count("*").alias("n_errors")), "hive_id", "left")
    out = out.join(n("values", F.count_if(F.octet_length("data") < F.col("size")).alias("n_short")), "hive_id", "left")
    return out.select("hive_id", "n_keys", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("n_values", "n_errors", "n_short")))


@query(f"SELECT r_name AS hive_id, line FROM region, (VALUES ('0x00000004,REGF,sequence numbers differ'), ('0x000001fc,REGF,checksum differs'), ('0x00001004,HBIN,offset field differs')) AS t(line) WHERE r_regionkey IN ({_IN_USE})")
def diagnostic_annotations(spark, sf):
    from .sources import regf

    t = regf.tables(_broken(spark, sf), id_col="hive_id")
    found = checks.diagnose(*(t[x] for x in ("hives", "hbins", "cells", "keys", "refs", "errors"))).where("severity <> 'info'")
    return export.hex_annotations(found).select("hive_id", "line")


def _scratch(spark):
    """A new folder that all executors share: the checkpoint folder's, or a temporary one where none is set and the master is local."""
    import tempfile
    import uuid

    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="regspark-")
    return f"{d}/{uuid.uuid4().hex}"


@query(f"SELECT r_name AS hive_id, true AS valid, true AS same FROM region WHERE r_regionkey IN ({_IN_USE})")
def backup_roundtrip(spark, sf):
    from .operators import repair

    store, files = _scratch(spark), _hives(spark, sf)
    repair.backup(files, store, "one")
    back = repair.restore(spark, store, "one").select("hive_id", F.sha2("content", 256).alias("got"))
    known = files.select("hive_id", F.sha2("content", 256).alias("want"))
    return repair.backups(spark, store).where("label = 'one'").join(back, "hive_id").join(known, "hive_id").select("hive_id", "valid", (F.col("got") == F.col("want")).alias("same"))


@query(rf"SELECT version, path FROM (SELECT 1::BIGINT AS version, r_name AS path FROM region UNION ALL SELECT 2, r_name FROM region UNION ALL SELECT 2, 'Added' UNION ALL SELECT 2, 'Added\N' || n_nationkey FROM nation UNION ALL SELECT 3, r_name FROM region)")
def session_versions(spark, sf):
    """A version, a session that is rolled back and then commits, and the first version made current again."""
    from .api import Tree
    from .plans import session

    store = _scratch(spark)
    regions = spark.read.parquet(f"{sf}/region.parquet").select(F.lit(0).cast("long").alias("seq"), F.lit(CREATE).alias("op"), F.col("r_name").alias("path"))
    added = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("seq"), F.lit(CREATE).alias("op"), F.concat(F.lit("Added\\N"), "n_nationkey").alias("path"))
    log = lambda df: df.select("seq", "op", "path", F.lower("path").alias("path_norm"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("reg_type"), F.lit(None).cast("binary").alias("data"))
    session.create(Tree.from_ops(log(regions)), store)
    s = session.Session.begin(spark, store)
    s.apply(log(regions.withColumn("path", F.lit("Gone")))).rollback()
    s.apply(log(added)).commit()
    session.restore(spark, store, 1)
    out = None
    for v in session.versions(spark, store):
        rows = session.open_version(spark, store, v).keys.select(F.lit(v).cast("long").alias("version"), "path")
        out = rows if out is None else out.unionByName(rows)
    return out
