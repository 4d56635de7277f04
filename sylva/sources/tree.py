"""A file tree as a table: a Python data source, as the built-in listings drop hidden names, directories and links.

spark.dataSource.register(TreeSource); spark.read.format("tree").option("exclude", "a/**,b/").load(root)
Excluded directories are pruned with all they hold; excluded files stay in the listing unless exclude_files is "true".
Each top-level entry is a partition, so subtrees are listed by different tasks; root must be reachable from executors.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sylva.functions.globs import glob_regex

#: Directories that are never entered.
PRUNED = (".git", "node_modules", "vendor")
SCHEMA = "path string, abs_path string, is_dir boolean, is_symlink boolean, depth int, parent_path string, size_bytes bigint"


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.globs = [g for g in options.get("exclude", "").split(",") if g]
        self.regexes = [(r, "/" not in g and "**" not in g) for g in self.globs if (r := glob_regex(g, "walker"))]
        self.exclude_files = options.get("exclude_files", "false") == "true"

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(n) for n in sorted(os.listdir(self.root))]

    def excluded(self, path: str) -> bool:
        return any(re.search(r, path) or (base and re.search(r, path.rsplit("/", 1)[-1])) for r, base in self.regexes)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self.walk(partition.value)

    def walk(self, path: str) -> Iterator[tuple]:
        full = os.path.join(self.root, path)
        link = os.path.islink(full)
        is_dir = os.path.isdir(full) and not link
        if is_dir and (os.path.basename(path) in PRUNED or self.excluded(path)):
            return
        if not is_dir and self.exclude_files and self.excluded(path):
            return
        parent, _, _ = path.rpartition("/")
        yield path, full, is_dir, link, path.count("/") + int(is_dir), parent, None if is_dir else os.lstat(full).st_size
        if is_dir:
            for n in sorted(os.listdir(full)):
                yield from self.walk(f"{path}/{n}")
