"""Inventories and other inputs derived from the given tables.

Each recipe is a WITH clause that Spark SQL and DuckDB both read; queries and their
SQL counterparts start from the same one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from atticsweep.session import scratch_path

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

FILES = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, n_nationkey AS n, o_orderdate AS d,
         CAST(floor(o_totalprice * 100) AS BIGINT) AS sz,
         concat('/vol/', r_name, '/', n_name, '/cust_', o_custkey) AS cust_dir
  FROM orders JOIN customer ON c_custkey = o_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
f AS (
  SELECT k, c, d,
    CASE WHEN k % 29 = 0 THEN concat(cust_dir, '/node_modules') ELSE cust_dir END AS parent_path,
    CASE WHEN c % 10 = 1 THEN concat('._order_', k)
         WHEN k % 20 = 0 THEN concat('order_', k, '.tmp')
         WHEN k % 20 = 1 THEN concat('~$order_', k, '.docx')
         WHEN k % 20 = 2 THEN concat('order_', k, '.BAK')
         WHEN k % 20 = 3 THEN concat('~order_', k)
         WHEN k % 20 = 4 THEN concat('etilqs_', k)
         WHEN k % 20 = 5 THEN concat('order_', k, '.lnk')
         WHEN k % 20 = 6 THEN concat('order_', k, '.tmp.tmp')
         ELSE concat('order_', k, '.dat') END AS name,
    CASE WHEN c % 10 = 0 OR n = 3 OR k % 50 = 7 THEN CAST(0 AS BIGINT) ELSE sz END AS size_bytes,
    k % 37 = 0 AS is_reparse_point,
    CASE WHEN k % 37 = 0 OR k % 20 = 5 THEN concat(cust_dir, '/order_', k + 7, '.dat') END AS link_target
  FROM o),
dirs AS (
  SELECT '/vol' AS full_path, -1 AS c
  UNION ALL SELECT concat('/vol/', r_name), -1 FROM region
  UNION ALL SELECT concat('/vol/', r_name, '/', n_name), -1 FROM nation JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT concat('/vol/', r_name, '/', n_name, '/cust_', c_custkey), c_custkey
    FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  UNION ALL SELECT DISTINCT parent_path, -1 FROM f WHERE parent_path LIKE '%/node_modules'),
arch AS (
  SELECT concat('/vol/', r_name, '/', n_name) AS parent_path, c_custkey AS c,
         concat('CUST_', c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '.zip' ELSE '.tar.gz' END) AS name
  FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  WHERE c_custkey % 13 = 0 AND c_nationkey <> 3),
inv AS (
  SELECT concat(parent_path, '/', name) AS full_path, name, parent_path, FALSE AS is_directory,
         k % 11 = 0 AS is_hidden, FALSE AS is_system, is_reparse_point, size_bytes, d AS modified, link_target
  FROM f
  UNION ALL
  SELECT concat(parent_path, '/', name), name, parent_path, FALSE, FALSE, FALSE, FALSE,
         CAST(4096 AS BIGINT) * c, TIMESTAMP '2001-01-01 00:00:00', CAST(NULL AS VARCHAR(200)) FROM arch
  UNION ALL
  SELECT full_path, regexp_replace(full_path, '^.*/', ''), regexp_replace(full_path, '/[^/]*$', ''), TRUE,
         c > 0 AND c % 17 = 0, c > 0 AND c % 23 = 0, c > 0 AND c % 31 = 0, CAST(0 AS BIGINT),
         TIMESTAMP '2000-01-01 00:00:00', CASE WHEN c > 0 AND c % 31 = 0 THEN '/missing/target' END FROM dirs),
manifest AS (
  SELECT concat(a.parent_path, '/', a.name) AS archive_path, concat('order_', o_orderkey, '.dat') AS entry_name
  FROM arch a JOIN orders ON o_custkey = a.c WHERE a.c % 2 = 0 AND a.c % 78 <> 0
  UNION ALL
  SELECT concat(parent_path, '/', name), 'docs/' FROM arch WHERE c % 2 = 0 AND c % 78 <> 0),
probe AS (
  SELECT concat(parent_path, '/', name) AS full_path,
    CASE k % 5 WHEN 0 THEN 'unauthorized' WHEN 4 THEN 'other' ELSE 'io' END AS outcome,
    CASE k % 5 WHEN 1 THEN CAST(-2147024864 AS INT) WHEN 2 THEN CAST(-2147024863 AS INT)
               WHEN 3 THEN CAST(-2147024809 AS INT) END AS hresult,
    CASE WHEN k % 5 = 4 THEN 'NotSupportedException' END AS exception_name
  FROM f WHERE k % 97 < 5)
"""

# Every temporary file once more under its upper-case name, and a log with several probes of a file.
CASES = FILES.rstrip() + """,
cased AS (
  SELECT * FROM inv
  UNION ALL SELECT concat(parent_path, '/', upper(name)), upper(name), parent_path, is_directory, is_hidden, is_system,
    is_reparse_point, size_bytes, modified, link_target FROM inv WHERE NOT is_directory AND lower(name) LIKE '%.tmp'
  UNION ALL SELECT concat(parent_path, '/', lower(name)), lower(name), parent_path, is_directory, is_hidden, is_system,
    is_reparse_point, size_bytes, modified, link_target FROM inv WHERE NOT is_directory AND upper(name) = name AND size_bytes > 20000000),
probe_log AS (
  SELECT full_path, outcome, hresult, exception_name, CAST(1 AS BIGINT) AS probed_at FROM probe
  UNION ALL SELECT full_path, 'opened', CAST(NULL AS INT), CAST(NULL AS VARCHAR(50)), CAST(2 AS BIGINT) FROM probe WHERE length(full_path) % 3 = 0
  UNION ALL SELECT full_path, 'unauthorized', CAST(NULL AS INT), CAST(NULL AS VARCHAR(50)), CAST(length(full_path) % 3 + 1 AS BIGINT)
    FROM probe WHERE length(full_path) % 5 < 2
  UNION ALL SELECT full_path, 'io', CAST(-2147024864 AS INT), CAST(NULL AS VARCHAR(50)), CAST(NULL AS BIGINT) FROM probe)
"""

DOCS = """
WITH docs AS (
  SELECT concat('/lake/', source, '/', lang, '/doc_', doc_id, '.txt') AS full_path,
         concat('doc_', doc_id, '.txt') AS name, concat('/lake/', source, '/', lang) AS parent_path, FALSE AS is_directory,
         CAST(doc_id AS BIGINT) * 37 % 1000 AS age_rank,
         text FROM documents)
"""

APPS = """
WITH app_dirs AS (
  SELECT s_suppkey AS sk, CASE s_suppkey % 5 WHEN 0 THEN 'AppData/Roaming' WHEN 1 THEN 'AppData/Local'
           WHEN 2 THEN 'ProgramData' WHEN 3 THEN 'Program Files' ELSE 'Program Files (x86)' END AS label,
         CASE WHEN s_suppkey = 10 THEN 'nuget' ELSE s_name END AS name FROM supplier),
app_files AS (
  SELECT sk, label, name, l_partkey % 7 AS b,
         CASE WHEN sk % 7 = 0 THEN CAST(10 AS BIGINT) ELSE CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) * 1000 END AS size_bytes
  FROM app_dirs JOIN lineitem ON l_suppkey = sk GROUP BY sk, label, name, l_partkey % 7),
app_inv AS (
  SELECT concat('/apps/', label, '/', name, '/bin/f', b, '.dll') AS full_path, concat('/apps/', label, '/', name, '/bin') AS parent_path,
         FALSE AS is_directory, size_bytes FROM app_files
  UNION ALL SELECT concat('/apps/', label, '/', name), concat('/apps/', label), TRUE, CAST(0 AS BIGINT) FROM app_dirs
  UNION ALL SELECT concat('/apps/', label, '/', name, '/bin'), concat('/apps/', label, '/', name), TRUE, CAST(0 AS BIGINT) FROM app_dirs),
installed AS (
  SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'HKLM' ELSE 'HKCU' END AS hive, CASE WHEN s_suppkey % 9 = 0 THEN '  ' ELSE concat('{', s_suppkey, '}') END AS key_name,
         concat(upper(s_name), ' Suite') AS display_name, concat('/opt/inst', s_suppkey, '/') AS install_location,
         concat('Vendor ', s_nationkey) AS publisher FROM supplier WHERE s_suppkey % 3 = 0),
running AS (SELECT substring(c_name, length(c_name) - c_custkey % 7, 8) AS process_name FROM customer)
"""

NODES = """
WITH nodes AS (
  SELECT CAST(100 + r_regionkey AS BIGINT) AS frn, CAST(5 AS BIGINT) AS parent_frn, r_name AS name, TRUE AS is_directory FROM region
  UNION ALL SELECT CAST(1000 + n_nationkey AS BIGINT), CAST(100 + n_regionkey AS BIGINT), n_name, TRUE FROM nation
  UNION ALL SELECT 100000 + c_custkey, CAST(1000 + c_nationkey AS BIGINT), concat('cust_', c_custkey), TRUE FROM customer WHERE c_custkey % 41 <> 40
  UNION ALL SELECT 10000000 + o_orderkey, 100000 + o_custkey, concat('order_', o_orderkey, '.dat'), FALSE FROM orders)
"""

# One folder with most files, pairs of folders that are each other's parent, ids that were used again,
# a record with a reserved id, and parents that are reserved or the node itself.
ODD_NODES = """
WITH nodes AS (
  SELECT CAST(3 AS BIGINT) AS frn, CAST(5 AS BIGINT) AS parent_frn, 'reserved' AS name, TRUE AS is_directory
  UNION ALL SELECT CAST(50 AS BIGINT), CAST(5 AS BIGINT), 'inbox', TRUE
  UNION ALL SELECT CAST(100 + r_regionkey AS BIGINT), CAST(CASE r_regionkey WHEN 1 THEN 3 WHEN 2 THEN 102 ELSE 5 END AS BIGINT), r_name, TRUE
    FROM region
  UNION ALL SELECT CAST(1000 + n_nationkey AS BIGINT), CAST(100 + n_regionkey AS BIGINT), n_name, TRUE FROM nation
  UNION ALL SELECT CAST(100000 + c_custkey AS BIGINT),
    CAST(CASE WHEN c_custkey % 50 = 0 THEN 100001 + c_custkey WHEN c_custkey % 50 = 1 THEN 99999 + c_custkey
              ELSE 1000 + c_nationkey END AS BIGINT), concat('cust_', c_custkey), TRUE FROM customer
  UNION ALL SELECT CAST(10000000 + o_orderkey AS BIGINT), CAST(CASE WHEN o_orderkey % 3 = 0 THEN 100000 + o_custkey ELSE 50 END AS BIGINT),
    concat('order_', o_orderkey, '.dat'), FALSE FROM orders
  UNION ALL SELECT CAST(10000000 + o_orderkey AS BIGINT) + 281474976710656 * CAST(1 + o_orderkey % 2 AS BIGINT), CAST(100000 + o_custkey AS BIGINT),
    concat('again_', o_orderkey, '.dat'), FALSE FROM orders WHERE o_orderkey % 7 = 0)
"""

LONG_PATHS = """
WITH longp AS (
  SELECT concat('/deep/', repeat(concat('d', CAST(page_id % 10 AS VARCHAR(2)), '/'), 60 + CAST(page_id % 50 AS INT)), url) AS full_path,
         url AS name, page_id % 4 = 0 AS is_directory,
         CASE WHEN page_id % 4 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(length(html) AS BIGINT) END AS size_bytes FROM pages)
"""



def select(spark: SparkSession, sf_dir: str, recipe: str, query: str) -> DataFrame:
    """A query on top of a recipe over the tables in ``sf_dir``."""
    for table in TABLES:
        if table in recipe or table in query:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(f"{recipe} {query}")


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], spread: bool = True) -> DataFrame:
    """A derived table, written once per session and read back, as an ingested inventory would be.

    ``spread`` deals its rows out evenly, unless they come from a table that was.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch_path(spark, name)
        df = build()
        if spread:
            # The given tables may be one small file each, which would leave all but one core idle.
            df = df.repartition(spark.sparkContext.defaultParallelism)
        df.write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])
