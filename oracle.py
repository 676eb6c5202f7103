"""The queries of ``__spark_entry__`` once more, in plain SQL for DuckDB.

Written from the definitions and not from the library: chains of parents by
recursion or prefix tests, no join keys, no sums per folder beforehand.
"""

from __future__ import annotations

import fixtures

# Fixed values, as in the library.
EXCLUDED = """('SYSTEM VOLUME INFORMATION', 'RECYCLER', '$RECYCLE.BIN', 'WINSXS', 'SYSTEM32', 'GAC_MSIL', 'GAC_32',
  'NODE_MODULES', '.GIT', '.SVN', '.HG')"""
TEMP_EXTENSIONS = """('.TMP', '.TEMP', '.BAK', '.OLD', '.ORIG', '.LOG', '.~', '.SWP', '.SWO', '.DMP', '.CRASH',
  '.STACKDUMP', '.CHK', '.GID', '.CNT', '.CACHE', '.LCK', '.LOCK')"""
KNOWN = """('MICROSOFT', 'WINDOWS', 'PACKAGES', 'MICROSOFT.WINDOWS', 'CONNECTEDDEVICESPLATFORM', 'CRASHDUMPS',
  'D3DSCACHE', 'DIAGNOSTICS', 'GAMEDVR', 'PUBLISHERS', 'TEMP', 'HISTORY', 'TEMPORARY INTERNET FILES', 'INETCACHE',
  'INETCOOKIES', 'PROGRAMS', 'MICROSOFT_CORPORATION', '.NET', '.DOTNET', 'NUGET', 'NPM', 'PIP', 'CARGO', 'RUSTUP',
  'PYTHON', 'JAVA', 'GO', 'RUBY', 'PACKAGE CACHE', 'PACKAGEMANAGEMENT', 'WINDOWSAPPS', 'WINGET', 'CHOCOLATEY',
  'SCOOP', 'WINDOWS DEFENDER', 'WINDOWS SECURITY', 'WINDOWS UPDATE', 'WINDOWSPOWERSHELL', 'POWERSHELL')"""

# Walk rules: level below the root, the blocked folders, and what they leave.
WALK = f""",
lev AS (SELECT *, CAST(length(full_path) - length(replace(full_path, '/', '')) - 1 AS BIGINT) AS level FROM inv),
shut AS (
  SELECT * FROM lev WHERE is_directory AND level > 0
    AND (is_reparse_point OR is_system OR upper(name) IN {EXCLUDED})),
walk AS (
  SELECT * FROM lev e WHERE level > 0
    AND NOT EXISTS (SELECT 1 FROM shut s WHERE starts_with(e.full_path, concat(s.full_path, '/')))),
vis AS (SELECT * FROM walk w WHERE NOT is_directory OR NOT EXISTS (SELECT 1 FROM shut s WHERE s.full_path = w.full_path)),
extd AS (
  SELECT *, CASE WHEN name LIKE '%.%' AND name NOT LIKE '%.' THEN regexp_extract(name, '(\\.[^.]+)$', 1) ELSE '' END AS ext
  FROM vis)"""
IGNORED = """(size_bytes = 0 OR upper(name) IN ('DESKTOP.INI', 'THUMBS.DB', '.DS_STORE') OR starts_with(name, '._'))"""

TEMP_REASON = f"""CASE WHEN upper(ext) IN {TEMP_EXTENSIONS} THEN concat('Temp extension (', ext, ')')
    WHEN lower(name) = 'thumbs.db' THEN 'Windows thumbnail cache'
    WHEN lower(name) = 'desktop.ini' THEN 'Windows folder settings'
    WHEN lower(name) = '.ds_store' THEN 'macOS metadata'
    WHEN starts_with(name, '._') THEN 'macOS resource fork'
    WHEN starts_with(name, '~$') THEN 'Office lock file'
    WHEN starts_with(name, '~') THEN 'Temp/backup file'
    WHEN starts_with(lower(name), 'etilqs_') THEN 'SQLite temp file' END"""
AGE = """(epoch_us(TIMESTAMP '2001-06-01 00:00:00') - epoch_us(modified)) / 86400000000.0 / 365.0"""


def _result(scanner, source, detail="''", group="''", selected="TRUE", size="size_bytes", root="''", is_dir="is_directory"):
    return f"""SELECT '{scanner}' AS scanner, {root} AS root_id, full_path, name, CAST({size} AS BIGINT) AS size_bytes,
  modified, {group} AS "group", {detail} AS detail, {is_dir} AS is_directory, {selected} AS is_selected FROM {source}"""


TEMP = _result("temp_files", f"(SELECT *, {TEMP_REASON} AS why FROM extd WHERE NOT is_directory) WHERE why IS NOT NULL", "why")
ZERO = _result("zero_length_files", "extd WHERE NOT is_directory AND size_bytes = 0", "ext")
OLD = _result(
    "old_files",
    "vis WHERE NOT is_directory AND size_bytes <> 0 AND modified < TIMESTAMP '2001-06-01 00:00:00' - INTERVAL 365 DAY",
    f"printf('%.1f years', round({AGE}, 1))",
    selected="FALSE",
)
EMPTY = _result(
    "empty_folders",
    f"""(SELECT d.*, (SELECT count(*) FROM vis f WHERE NOT f.is_directory AND f.parent_path = d.full_path) AS n
       FROM vis d WHERE is_directory AND NOT EXISTS (
         SELECT 1 FROM vis f WHERE NOT is_directory AND NOT {IGNORED}
           AND starts_with(f.full_path, concat(d.full_path, '/'))))""",
    "CASE WHEN n > 0 THEN concat(n, ' ignored file(s)') ELSE 'Empty' END",
    size="0",
)
BIG = _result(
    "big_files",
    "(SELECT * FROM vis WHERE NOT is_directory ORDER BY size_bytes DESC, upper(full_path) DESC LIMIT 100)",
    selected="FALSE",
)
LINKS = _result(
    "broken_links",
    """walk w WHERE is_reparse_point AND link_target IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM inv t WHERE upper(t.full_path) = upper(w.link_target))""",
    "CASE WHEN is_directory THEN 'Junction/Dir symlink' ELSE 'File symlink' END",
    size="0",
)
SHORTCUTS = _result(
    "broken_shortcuts",
    """vis w WHERE NOT is_directory AND lower(name) LIKE '%.lnk' AND link_target IS NOT NULL
       AND NOT EXISTS (SELECT 1 FROM inv t WHERE upper(t.full_path) = upper(w.link_target))""",
    "link_target",
)
UNREADABLE = _result(
    "unreadable_files",
    """(SELECT v.*, CASE outcome WHEN 'unauthorized' THEN 'Access denied' WHEN 'io' THEN
         CASE hresult WHEN -2147024864 THEN 'Locked by another process' WHEN -2147024863 THEN 'Lock violation'
         ELSE printf('I/O error (0x%08X)', CAST(hresult AS BIGINT) + 4294967296) END ELSE exception_name END AS why
       FROM vis v JOIN probe USING (full_path) WHERE NOT is_directory)""",
    "why",
    selected="FALSE",
)
ARCHIVE_CTES = """,
packed AS (
  SELECT *, regexp_replace(name, '(\\.tar)?\\.(gz|bz2|xz)$|\\.(zip|7z|rar|tar|tgz|cab|iso)$', '', 'i') AS base FROM vis
  WHERE NOT is_directory AND regexp_matches(name, '\\.(zip|7z|rar|tar|gz|tgz|bz2|xz|cab|iso)$', 'i')),
paired AS (
  SELECT p.* FROM packed p WHERE base <> '' AND EXISTS (SELECT 1 FROM vis d WHERE d.is_directory
    AND d.parent_path = p.parent_path AND lower(d.name) = lower(p.base))),
overlap AS (
  SELECT p.full_path, count(*) AS total, count(f.full_path) AS found
  FROM paired p JOIN manifest m ON m.archive_path = p.full_path AND m.entry_name NOT LIKE '%/'
  LEFT JOIN (SELECT full_path FROM inv WHERE NOT is_directory) f
    ON lower(f.full_path) = lower(concat(p.parent_path, '/', p.base, '/', m.entry_name))
  WHERE lower(p.name) LIKE '%.zip' GROUP BY p.full_path),
judged AS (SELECT p.*, CAST(floor(found * 100.0 / total) AS INT) AS pct FROM paired p LEFT JOIN overlap o USING (full_path))"""
ARCHIVES = _result(
    "unpacked_archives",
    "judged",
    """CASE WHEN pct >= 80 THEN concat(pct, '% content match with ', base, '/')
       WHEN pct IS NOT NULL THEN concat(pct, '% overlap with ', base, '/') ELSE concat('Matches folder: ', base) END""",
    "CASE WHEN pct >= 80 THEN 'High confidence' ELSE 'Name match' END",
)
DOC_CTES = """,
sized AS (
  SELECT *, CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes, sha256(text) AS h,
         TIMESTAMP '2020-01-01 00:00:00' + to_days(CAST(age_rank AS INT)) AS modified FROM docs),
copies AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY modified, full_path) AS copy_no,
         count(*) OVER (PARTITION BY h) AS n, dense_rank() OVER (ORDER BY size_bytes DESC, h) AS all_rank
  FROM sized WHERE size_bytes > 0),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY size_bytes DESC, h) AS group_no FROM copies WHERE n >= 2)"""
DUPLICATES = _result(
    "duplicate_files",
    "numbered",
    "concat(substr(h, 1, 16), '...')",
    "concat('Group ', group_no)",
    "copy_no > 1",
    is_dir="FALSE",
)
LONG = _result(
    "long_paths",
    """(SELECT *, CAST(NULL AS TIMESTAMP) AS modified FROM longp) WHERE length(full_path) > 260""",
    "CAST(length(full_path) AS VARCHAR)",
    "CASE WHEN is_directory THEN 'Directory' ELSE 'File' END",
    "FALSE",
)
APP_CTES = """,
forms AS (
  SELECT display_name AS t FROM installed UNION SELECT replace(display_name, ' ', '') FROM installed
  UNION SELECT key_name FROM installed
  UNION SELECT regexp_extract(display_name, '^[^ .-]*') FROM installed
    WHERE hive = 'HKLM' AND length(regexp_extract(display_name, '^[^ .-]*')) > 3
  UNION SELECT regexp_extract(install_location, '([^/]+)/*$', 1) FROM installed WHERE hive = 'HKLM'
  UNION SELECT publisher FROM installed WHERE hive = 'HKLM'
  UNION SELECT replace(publisher, ' ', '') FROM installed WHERE hive = 'HKLM'),
tokens AS (SELECT DISTINCT upper(t) AS token FROM forms WHERE t IS NOT NULL AND trim(t) <> '')"""
ORPHANS = _result(
    "orphaned_app_data",
    f"""(SELECT a.name, concat('/apps/', label, '/', a.name) AS full_path, label, CAST(NULL AS TIMESTAMP) AS modified,
         (SELECT sum(size_bytes) FROM app_inv f WHERE NOT f.is_directory
            AND starts_with(f.full_path, concat('/apps/', label, '/', a.name, '/'))) AS total
       FROM app_dirs a WHERE upper(a.name) NOT IN {KNOWN} AND NOT EXISTS (
         SELECT 1 FROM tokens WHERE token = upper(a.name) OR (length(token) >= 4 AND length(a.name) >= 4
           AND (contains(upper(a.name), token) OR contains(token, upper(a.name))))))
       WHERE total >= 1024""",
    group="label",
    selected="FALSE",
    size="total",
    is_dir="TRUE",
)
SIZE_TEXT = """CASE WHEN s < 0 THEN '' WHEN s < 1024 THEN concat(s, ' B')
  WHEN s < 1048576 THEN printf('%.1f KB', round(s / 1024.0, 1))
  WHEN s < 1073741824 THEN printf('%.1f MB', round(s / 1048576.0, 1))
  ELSE printf('%.2f GB', round(s / 1073741824.0, 2)) END"""
TIME_TEXT = "coalesce(strftime(modified, '%Y-%m-%d %H:%M'), '')"


def _files(query: str, ctes: str = "") -> str:
    return f"{fixtures.FILES}{WALK}{ctes} {query}"


def _at_depth(n: int) -> str:
    """Walk rules with a depth limit: an entry is seen if its folder is within the limit."""
    return WALK.replace("lev e WHERE level > 0", f"lev e WHERE level > 0 AND level <= {n + 1}")


def statements() -> dict[str, str]:
    files = "SELECT full_path, is_directory, size_bytes FROM vis"
    recursive = fixtures.FILES.replace("WITH o AS", "WITH RECURSIVE o AS", 1)
    empty_depth2 = EMPTY.replace("FROM vis d WHERE is_directory", "FROM vis d WHERE is_directory AND level <= 2")
    planned = f"results AS ({TEMP} UNION ALL {ZERO} UNION ALL {EMPTY})"
    gone = """gone AS (SELECT e.* FROM inv e WHERE EXISTS (SELECT 1 FROM results r
      WHERE r.full_path = e.full_path OR starts_with(e.full_path, concat(r.full_path, '/'))))"""
    after_plan = _files(
        """SELECT full_path, is_directory, size_bytes FROM inv
           WHERE full_path NOT IN (SELECT full_path FROM gone)""",
        f", {planned}, {gone}",
    )
    freed = _files(
        """SELECT '' AS root_id, count(*) FILTER (WHERE NOT is_directory) AS files,
           count(*) FILTER (WHERE is_directory) AS folders, CAST(sum(size_bytes) AS BIGINT) AS freed_bytes FROM gone""",
        f", {planned}, {gone}",
    )
    walk_cased = WALK.replace("FROM inv)", "FROM cased)", 1)
    own_walk = WALK.replace(EXCLUDED, "('CUST_7', 'CUST_12')")
    # Of '*.tmp' only the first '.tmp' of a name may be its end.
    own_ignored = "(strpos(upper(name), '.TMP') > 0 AND strpos(upper(name), '.TMP') + 3 = length(name) OR starts_with(name, '~'))"
    two_scans = f"results AS ({TEMP} UNION ALL {OLD})"
    exported = f"""SELECT 'True' AS "Selected", name AS "Name", full_path AS "Path", size_bytes AS "Size",
      {TIME_TEXT} AS "Modified", detail AS "Detail", "group" AS "Group" FROM ({TEMP})"""
    return {
        "ingested_inventory": f"""{fixtures.FILES} SELECT '' AS root_id, full_path, name, parent_path,
            CAST(length(full_path) - length(replace(full_path, '/', '')) - 1 AS BIGINT) AS depth,
            is_directory, is_hidden, is_system, is_reparse_point, size_bytes * 1000 AS size_bytes,
            CASE WHEN size_bytes = 0 THEN NULL ELSE modified END AS modified,
            CAST(16 * CAST(is_directory AS INT) + 2 * CAST(is_hidden AS INT) + 4 * CAST(is_system AS INT)
              + 1024 * CAST(is_reparse_point AS INT) AS BIGINT) AS attributes, link_target FROM inv""",
        "decode_attributes": f"""{fixtures.FILES} SELECT full_path, CAST(16 * CAST(is_directory AS INT)
            + 2 * CAST(is_hidden AS INT) + 4 * CAST(is_system AS INT) + 1024 * CAST(is_reparse_point AS INT) AS BIGINT)
            AS bits, is_directory, is_hidden, is_system, is_reparse_point FROM inv""",
        "decode_size_time": f"""{fixtures.FILES} SELECT full_path, size_bytes * 1000 AS size_bytes,
            CASE WHEN size_bytes = 0 THEN NULL ELSE modified END AS modified FROM inv""",
        "path_parts": f"""{fixtures.FILES} SELECT full_path, name, parent_path,
            CASE WHEN regexp_matches(name, '\\.[^.]+$') THEN regexp_extract(name, '\\.[^.]+$') ELSE '' END AS extension,
            CAST(length(full_path) - length(replace(full_path, '/', '')) - 1 AS BIGINT) AS depth FROM inv""",
        "visible_entries": _files(files),
        "visible_entries_depth2": f"{fixtures.FILES}{_at_depth(2)} {files}",
        "visible_entries_skip_hidden": f"{fixtures.FILES}{WALK.replace('is_system OR', 'is_system OR is_hidden OR', 1)} {files}",
        "temp_files_depth3": f"{fixtures.FILES}{_at_depth(3)} {TEMP}",
        "own_scan": f"""{fixtures.FILES}{WALK} {_result("dat_files", "vis WHERE NOT is_directory AND ends_with(lower(name), '.dat')", "ext_text")}
            UNION ALL {TEMP}""".replace("ext_text", "concat('Data file of ', CAST(size_bytes AS VARCHAR), ' bytes')"),
        "ignored_files": f"""{fixtures.FILES} SELECT full_path, name, size_bytes FROM inv
            WHERE NOT is_directory AND {IGNORED}""",
        "wildcard_match": f"""{fixtures.FILES} SELECT full_path, name,
            strpos(upper(name), '.TMP') > 0 AND strpos(upper(name), '.TMP') + 3 = length(name) AS is_tmp,
            starts_with(upper(name), 'ORDER_') AS is_order,
            strpos(name, '_1') > 0 AND strpos(substr(upper(name), strpos(name, '_1') + 2), '.DAT') > 0
              AND strpos(substr(upper(name), strpos(name, '_1') + 2), '.DAT') + 3
                = length(substr(name, strpos(name, '_1') + 2)) AS is_middle,
            lower(name) = 'order_7.dat' AS is_exact, TRUE AS is_any FROM inv WHERE NOT is_directory""",
        "result_size_bounds": f"{fixtures.DOCS}{DOC_CTES} SELECT full_path, size_bytes FROM sized WHERE size_bytes BETWEEN 500 AND 2000",
        "formatted_rows": f"""{fixtures.FILES} SELECT full_path, s AS size_bytes, {SIZE_TEXT} AS size_text,
            {TIME_TEXT} AS modified_text FROM (SELECT full_path, modified, size_bytes * factor AS s
            FROM inv, (VALUES (1), (100), (10000)) v(factor) WHERE NOT is_directory)""",
        "folder_stats": _files(
            f"""SELECT '' AS root_id, d.full_path, d.name, d.level AS depth,
              count(*) FILTER (WHERE NOT c.is_directory) AS file_count,
              CAST(coalesce(sum(c.size_bytes) FILTER (WHERE NOT c.is_directory), 0) AS BIGINT) AS total_size,
              coalesce(bool_or(NOT c.is_directory AND NOT c.ignored), FALSE) AS has_non_ignored,
              count(*) FILTER (WHERE c.is_directory) AS subfolder_count
            FROM (SELECT * FROM vis UNION ALL SELECT * FROM lev WHERE level = 0) d
            LEFT JOIN (SELECT *, {IGNORED} AS ignored FROM vis) c ON c.parent_path = d.full_path
            WHERE d.is_directory GROUP BY d.full_path, d.name, d.level"""
        ),
        "folder_rollup": f"""{recursive}, up(folder, size_bytes) AS (
              SELECT parent_path, size_bytes FROM inv WHERE NOT is_directory
              UNION ALL SELECT d.parent_path, u.size_bytes FROM up u JOIN inv d ON d.full_path = u.folder
              WHERE d.is_directory AND NOT d.is_reparse_point AND d.full_path <> '/vol')
            SELECT '' AS root_id, d.full_path AS folder, CAST(coalesce(sum(u.size_bytes), 0) AS BIGINT) AS size_bytes
            FROM inv d LEFT JOIN up u ON u.folder = d.full_path WHERE d.is_directory GROUP BY d.full_path""",
        "empty_folders": _files(EMPTY),
        # A folder that was not entered counts as content of those above it.
        "empty_folders_strict": _files(
            EMPTY.replace(
                "AND NOT EXISTS (",
                "AND NOT EXISTS (SELECT 1 FROM shut s WHERE starts_with(s.full_path, concat(d.full_path, '/'))) AND NOT EXISTS (",
                1,
            )
        ),
        "empty_folders_own_lists": f"{fixtures.FILES}{own_walk} {EMPTY.replace(IGNORED, own_ignored)}",
        "temp_files_own_lists": f"{fixtures.FILES}{own_walk} {TEMP}",
        "empty_folders_depth2": f"{fixtures.FILES}{_at_depth(2)} {empty_depth2}",
        "big_files": _files(BIG),
        "big_files_per_root": _files(
            _result(
                "big_files",
                """(SELECT *, row_number() OVER (PARTITION BY split_part(full_path, '/', 3)
                      ORDER BY size_bytes DESC, upper(full_path) DESC) AS place FROM vis WHERE NOT is_directory)
                   WHERE place <= 5""",
                selected="FALSE",
                root="split_part(full_path, '/', 3)",
            )
        ),
        "duplicate_files": f"{fixtures.DOCS}{DOC_CTES} {DUPLICATES}",
        "duplicate_candidates": f"""{fixtures.DOCS}{DOC_CTES} SELECT full_path, size_bytes FROM sized
            WHERE size_bytes > 0 AND size_bytes IN (SELECT size_bytes FROM sized GROUP BY size_bytes HAVING count(*) >= 2)""",
        "big_files_of_any_case": f"""{fixtures.CASES}{walk_cased}
            {BIG.replace("(SELECT * FROM vis WHERE NOT is_directory ORDER BY", """(SELECT * FROM vis WHERE NOT is_directory
              QUALIFY row_number() OVER (PARTITION BY size_bytes, upper(full_path) ORDER BY full_path DESC) = 1 ORDER BY""")}""",
        "temp_files": _files(TEMP),
        "zero_length_files": _files(ZERO),
        "old_files": _files(OLD),
        "broken_links": _files(LINKS),
        "broken_shortcuts": _files(SHORTCUTS),
        "broken_shortcuts_env": _files(SHORTCUTS),
        "long_paths": f"{fixtures.LONG_PATHS} {LONG}",
        "unreadable_files": _files(UNREADABLE),
        "unreadable_files_of_log": f"""{fixtures.CASES}{WALK}, last_probe AS (
              SELECT full_path, CASE outcome WHEN 'unauthorized' THEN 'Access denied' WHEN 'io' THEN
                CASE hresult WHEN -2147024864 THEN 'Locked by another process' WHEN -2147024863 THEN 'Lock violation'
                ELSE printf('I/O error (0x%08X)', CAST(hresult AS BIGINT) + 4294967296) END ELSE exception_name END AS why
              FROM probe_log QUALIFY row_number() OVER (PARTITION BY full_path
                ORDER BY coalesce(probed_at, -1) DESC, why IS NULL, why) = 1)
            {_result("unreadable_files", "(SELECT v.*, why FROM vis v JOIN last_probe USING (full_path) WHERE NOT is_directory AND why IS NOT NULL)",
                     "why", selected="FALSE")}""",
        "unpacked_archives": _files(ARCHIVES, ARCHIVE_CTES),
        "installed_names": f"{fixtures.APPS}{APP_CTES} SELECT token FROM tokens",
        "installed_and_running_names": f"""{fixtures.APPS}{APP_CTES} SELECT token FROM tokens
            UNION SELECT upper(process_name) FROM running WHERE length(process_name) > 3""",
        "orphaned_app_data": f"{fixtures.APPS}{APP_CTES} {ORPHANS}",
        "resolved_paths": f"""{fixtures.NODES.replace("WITH nodes AS", "WITH RECURSIVE nodes AS", 1)},
            up(frn, above, path) AS (
              SELECT frn, parent_frn, name FROM nodes
              UNION ALL SELECT u.frn, n.parent_frn, concat(n.name, '/', u.path) FROM up u JOIN nodes n ON n.frn = u.above)
            SELECT frn, concat('C:/', arg_max(path, length(path))) AS path FROM up GROUP BY frn""",
        "resolved_odd_paths": f"""{fixtures.ODD_NODES.replace("WITH nodes AS", "WITH RECURSIVE nodes AS", 1)},
            last AS (SELECT frn % 281474976710656 AS frn, parent_frn AS above, name FROM nodes
              QUALIFY row_number() OVER (PARTITION BY frn % 281474976710656 ORDER BY frn // 281474976710656 DESC) = 1),
            step AS (SELECT frn, name, CASE WHEN above <> frn AND above >= 5 THEN above END AS above FROM last),
            up(frn, above, path, passed) AS (
              SELECT frn, above, name, [frn] FROM step
              UNION ALL SELECT u.frn, s.above, concat(s.name, '/', u.path), list_append(u.passed, s.frn)
              FROM up u JOIN step s ON s.frn = u.above WHERE NOT list_contains(u.passed, s.frn))
            SELECT frn, concat('C:/', arg_max(path, len(passed))) AS path FROM up GROUP BY frn""",
        "export_rows": _files(exported),
        "exported_csv": _files(exported),
        "exported_json": _files(
            f"""SELECT name AS "Name", full_path AS "FullPath", s AS "SizeBytes", {SIZE_TEXT} AS "Size",
              {TIME_TEXT} AS "Modified", detail AS "Detail", "group" AS "Group", is_selected AS "IsSelected",
              is_directory AS "IsDirectory" FROM (SELECT *, size_bytes AS s FROM ({TEMP}))"""
        ),
        "result_filter": _files(f"SELECT * FROM ({TEMP}) WHERE lower(concat(name, '|', full_path, '|', detail)) LIKE '%office lock%'"),
        "result_by_folder": _files(
            f"""SELECT scanner, root_id, regexp_replace(full_path, '/[^/]*$', '') AS parent_folder, count(*) AS findings,
              CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM ({TEMP}) GROUP BY ALL"""
        ),
        "sorted_results": _files(TEMP),
        "displayed_results": _files(
            f"""SELECT name AS "Name", full_path AS "Path", {SIZE_TEXT} AS "Size", {TIME_TEXT} AS "Modified",
              detail AS "Age" FROM (SELECT *, size_bytes AS s FROM ({OLD}))"""
        ),
        "selection_summary": _files(
            f"""SELECT scanner, count(*) FILTER (WHERE is_selected) AS selected_count,
              CAST(coalesce(sum(size_bytes) FILTER (WHERE is_selected), 0) AS BIGINT) AS selected_bytes
              FROM ({TEMP} UNION ALL {OLD} UNION ALL {EMPTY}) GROUP BY scanner"""
        ),
        "inverted_selection": _files(
            "SELECT scanner, full_path, NOT is_selected AS is_selected FROM results", f", {two_scans}"
        ),
        "select_all_and_none": _files(
            """SELECT choice, scanner, choice = 'all' AS is_selected, count(*) AS findings
               FROM results, (VALUES ('all'), ('none')) v(choice) GROUP BY choice, scanner""",
            f", {two_scans}",
        ),
        "remaining_results": _files(f"SELECT * FROM ({TEMP}) WHERE NOT starts_with(detail, 'Temp extension')"),
        "deletion_plan": _files(
            """SELECT 'RecycleBin' AS mode, root_id, full_path, bool_or(is_directory) AS is_directory,
               max(size_bytes) AS size_bytes, string_agg(scanner, ',' ORDER BY scanner) AS scanners,
               CAST(length(full_path) AS BIGINT) AS path_length FROM results WHERE is_selected GROUP BY root_id, full_path""",
            f", {planned}",
        ),
        "deletion_plan_by_case": f"""{fixtures.CASES}{walk_cased} SELECT 'Permanent' AS mode, '' AS root_id, full_path, is_directory,
            size_bytes, 'temp_files' AS scanners, CAST(length(full_path) AS BIGINT) AS path_length FROM ({TEMP})""",
        "inventory_after_plan_by_case": f"""{fixtures.CASES}{walk_cased} SELECT full_path, is_directory, size_bytes FROM cased
            WHERE full_path NOT IN (SELECT full_path FROM ({TEMP}) WHERE name = upper(name))""",
        "inventory_after_plan": after_plan,
        "inventory_after_large_plan": after_plan,
        "freed_bytes": freed,
        "freed_bytes_of_large_plan": freed,
        # The same rows as the batch scans.
        "streamed_temp_files": _files(TEMP),
        "streamed_old_files": _files(OLD),
        "streamed_zero_length_files": _files(ZERO),
        "streamed_long_paths": f"{fixtures.LONG_PATHS} {LONG}",
        "scan_all_summary": _fleet_summary(),
    }


def _fleet_summary() -> str:
    """All twelve scans over the four inventories; the largest 100 come from all of them together."""
    docs = fixtures.DOCS.replace("WITH docs AS", ", docs AS", 1)
    apps = fixtures.APPS.replace("WITH app_dirs AS", ", app_dirs AS", 1)
    longp = fixtures.LONG_PATHS.replace("WITH longp AS", ", longp AS", 1)
    more = """, other_files AS (
      SELECT full_path, size_bytes, regexp_extract(full_path, '[^/]*$') AS name, modified FROM sized
      UNION ALL SELECT full_path, size_bytes, regexp_extract(full_path, '[^/]*$'), CAST(NULL AS TIMESTAMP) FROM app_inv
        WHERE NOT is_directory
      UNION ALL SELECT full_path, size_bytes, name, CAST(NULL AS TIMESTAMP) FROM longp WHERE NOT is_directory),
    everything AS (SELECT full_path, size_bytes FROM vis WHERE NOT is_directory
      UNION ALL SELECT full_path, size_bytes FROM other_files),
    results AS ("""
    scans = " UNION ALL ".join(
        f"SELECT scanner, size_bytes, is_selected, \"group\" FROM ({q})"
        for q in (TEMP, ZERO, OLD, EMPTY, LINKS, SHORTCUTS, UNREADABLE, ARCHIVES, DUPLICATES, LONG, ORPHANS)
    )
    app_empty = """ UNION ALL SELECT 'empty_folders', 0, TRUE, '' FROM app_inv d WHERE is_directory AND NOT EXISTS (
        SELECT 1 FROM app_inv f WHERE NOT f.is_directory AND f.size_bytes > 0 AND starts_with(f.full_path, concat(d.full_path, '/')))
      UNION ALL SELECT 'empty_folders', 0, TRUE, '' FROM longp d WHERE is_directory AND NOT EXISTS (
        SELECT 1 FROM longp f WHERE NOT f.is_directory AND f.size_bytes > 0 AND starts_with(f.full_path, concat(d.full_path, '/')))
      UNION ALL SELECT 'big_files', size_bytes, FALSE, '' FROM (
        SELECT * FROM everything ORDER BY size_bytes DESC, upper(full_path) DESC LIMIT 100)
      UNION ALL SELECT 'zero_length_files', 0, TRUE, '' FROM other_files WHERE size_bytes = 0)"""
    return f"""{fixtures.FILES}{WALK}{ARCHIVE_CTES}{docs}{DOC_CTES}{apps}{APP_CTES}{longp}{more}{scans}{app_empty}
    SELECT scanner, count(*) AS findings, CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
      count(*) FILTER (WHERE scanner = 'duplicate_files' AND is_selected) AS recoverable_files,
      CAST(coalesce(sum(size_bytes) FILTER (WHERE scanner = 'duplicate_files' AND is_selected), 0) AS BIGINT)
        AS recoverable_bytes,
      count(DISTINCT CASE WHEN scanner = 'duplicate_files' THEN "group" END) AS duplicate_groups
    FROM results GROUP BY scanner"""
