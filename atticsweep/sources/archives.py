"""Member lists of zip archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from atticsweep.sources.storage import ROWS_PER_BATCH, open_file

MEMBERS_SCHEMA = "root_id string, archive_path string, entry_name string"


def _member_names(path: str, content: bytes | None) -> Iterator[str]:
    """Member files of one archive, without folder entries; nothing if it cannot be read."""
    try:
        with io.BytesIO(content) if content is not None else open_file(path) as f, zipfile.ZipFile(f) as archive:
            names = [i.filename for i in archive.infolist()]
    except (OSError, ValueError, zipfile.BadZipFile, NotImplementedError):
        return
    for name in names:
        if not name.endswith(("/", "\\")):
            yield name


def archive_members(archives: DataFrame) -> DataFrame:
    """(root_id, archive_path, entry_name) for archives (root_id, full_path and perhaps content).

    Without a ``content`` column the files are opened at their paths, which reads
    only their central directory.
    """
    columns = [c for c in ("root_id", "full_path", "content") if c in archives.columns]
    schema = pa.schema([("root_id", pa.string()), ("archive_path", pa.string()), ("entry_name", pa.string())])

    def list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                rows = []
                for name in _member_names(row["full_path"], row.get("content")):
                    rows.append(
                        {"root_id": row.get("root_id") or "", "archive_path": row["full_path"], "entry_name": name}
                    )
                    if len(rows) == ROWS_PER_BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select(*columns).mapInArrow(list_members, MEMBERS_SCHEMA)
