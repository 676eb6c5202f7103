"""Small trees, and the scans once more as plain walks over them."""

from __future__ import annotations

import fnmatch
import random
from datetime import datetime

import atticsweep as att

RAW = (
    "full_path string, is_directory boolean, is_hidden boolean, is_system boolean, is_reparse_point boolean,"
    " size_bytes bigint, modified timestamp, link_target string"
)


def entry(path, size=None, hidden=False, system=False, link=False, modified=None, target=None):
    """A file, or a folder where no size is given."""
    return (path, size is None, hidden, system, link, size or 0, modified or datetime(2020, 1, 1), target)


def inventory(spark, rows, sep="\\", root="C:\\data"):
    return att.inventory_from_table(spark.createDataFrame(rows, RAW), sep, root)


def paths(df):
    return sorted(r["full_path"] for r in df.collect())


def random_tree(seed, n=120, sep="\\", root="C:\\data"):
    rng = random.Random(seed)
    folders, rows = [root], [entry(root)]
    names = ["a", "b", "Docs", "node_modules", ".git", "x.y"]
    for i in range(n):
        parent = rng.choice(folders)
        if rng.random() < 0.5:
            path = f"{parent}{sep}{rng.choice(names)}"
            if any(r[0].upper() == path.upper() for r in rows):
                path += str(i)
            rows.append(entry(path, None, rng.random() < 0.1, rng.random() < 0.1, rng.random() < 0.1))
            folders.append(path)
        else:
            name = rng.choice(["Thumbs.DB", "._f", "f.txt", "g.tmp", "h.log"])
            path = f"{parent}{sep}{i}" + name if name not in ("Thumbs.DB",) else f"{parent}{sep}{name}"
            if any(r[0].upper() == path.upper() for r in rows):
                continue
            rows.append(entry(path, rng.choice([0, 0, 5, 100]), rng.random() < 0.1))
    return rows


class Walk:
    """A recursive walk over rows, one folder at a time."""

    def __init__(self, rows, opts, root="C:\\data"):
        self.opts, self.root = opts, root
        self.children = {}
        for r in rows:
            if r[0] != root:
                self.children.setdefault(r[0].rsplit(opts.sep, 1)[0], []).append(r)

    def blocked(self, r):
        o = self.opts
        name = r[0].rsplit(o.sep, 1)[1].upper()
        return (
            r[4]
            or (o.skip_hidden and r[2])
            or (o.skip_system and r[3])
            or name in [n.upper() for n in o.excluded_folders]
        )

    def folders(self, folder=None, depth=0):
        """(folder, depth, files, entered subfolders) of each entered folder."""
        folder = folder or self.root
        if self.opts.max_depth >= 0 and depth > self.opts.max_depth:
            return
        rows = self.children.get(folder, [])
        subs = [r for r in rows if r[1] and not self.blocked(r)]
        yield folder, depth, [r for r in rows if not r[1]], subs
        for s in subs:
            yield from self.folders(s[0], depth + 1)

    def visible(self):
        return sorted(r[0] for _, _, files, subs in self.folders() for r in files + subs)

    def counts_as_content(self, r):
        name = r[0].rsplit(self.opts.sep, 1)[1].upper()
        if self.opts.ignore_empty_files and r[5] == 0:
            return False
        return not any(fnmatch.fnmatchcase(name, p.upper()) for p in self.opts.ignored_files)

    def empty(self):
        listed = list(self.folders())
        empty = set()
        for folder, _, files, _ in sorted(listed, key=lambda f: -f[1]):
            subs = [f for f, *_ in listed if f.rsplit(self.opts.sep, 1)[0] == folder]
            if folder != self.root and not any(map(self.counts_as_content, files)) and all(s in empty for s in subs):
                empty.add(folder)
        return sorted(empty)
