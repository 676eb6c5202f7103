"""Storage-hygiene analytics over file inventories, on Spark."""

from atticsweep.functions.attributes import decode_attributes, decode_filetime, decode_size
from atticsweep.functions.match import is_ignored, size_between, wildcard_match
from atticsweep.functions.paths import depth_of, extension_of, name_of, parent_of
from atticsweep.functions.text import format_modified, format_size
from atticsweep.operators.access import unreadable_files
from atticsweep.operators.archives import unpacked_archives
from atticsweep.operators.duplicates import (
    candidate_files,
    duplicate_files,
    hash_groups,
    keep_oldest,
    number_groups,
    size_candidates,
)
from atticsweep.operators.folders import empty_folders, folder_stats
from atticsweep.operators.largest import big_files
from atticsweep.operators.leftovers import orphaned_app_data
from atticsweep.operators.links import broken_links, broken_shortcuts
from atticsweep.operators.prune import files, folders, visible
from atticsweep.operators.results import (
    by_parent_folder,
    display,
    filter_text,
    invert,
    remove_results,
    scan_summary,
    select_all,
    select_none,
    selection_summary,
    sort_results,
)
from atticsweep.operators.rollup import folder_rollup
from atticsweep.operators.rowlocal import long_paths, old_files, temp_files, zero_length_files
from atticsweep.plans.deletion import apply_plan, deletion_plan, freed_bytes
from atticsweep.plans.sweep import scan_all
from atticsweep.registry import SCANNERS, in_order, run_scan, scanner, unregister
from atticsweep.schema import INVENTORY_SCHEMA, RESULT_SCHEMA, Inputs, ScanOptions
from atticsweep.sources.archives import archive_members
from atticsweep.sources.export import export_csv, export_json
from atticsweep.sources.idtree import resolve_paths
from atticsweep.sources.programs import installed_names
from atticsweep.sources.storage import contents, walk_storage
from atticsweep.sources.tables import inventory_from_find_records, inventory_from_table
from atticsweep.streaming.scans import stream_scan

__all__ = [name for name in dir() if not name.startswith("_")]
