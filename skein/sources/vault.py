"""Folders of markdown notes as a table, through a Python data source: one partition for each batch of files.

Spark's own readers leave out empty files and names that begin with a dot or underscore; this one reads every note,
passes over hidden folders and those of tools, and doesn't follow linked folders.
"""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SKIPPED = {".obsidian", ".git", ".trash", "node_modules", ".venv", "__pycache__"}
BATCH, BATCH_BYTES = 4096, 32 << 20


def registry_path() -> Path:
    home = Path.home()
    if sys.platform == "darwin":
        return home / "Library/Application Support/obsidian/obsidian.json"
    if os.name == "nt":
        return Path(os.environ.get("APPDATA", home / "AppData/Roaming")) / "obsidian/obsidian.json"
    return Path(os.environ.get("XDG_CONFIG_HOME", home / ".config")) / "obsidian/obsidian.json"


def registry(path: str | None = None) -> dict[str, str]:
    """Folder by id; nothing where the file is missing or isn't valid."""
    try:
        vaults = json.loads(Path(path or registry_path()).read_text(encoding="utf-8")).get("vaults", {})
        return {k: v["path"] for k, v in vaults.items() if "path" in v}
    except (OSError, ValueError, AttributeError, TypeError):
        return {}


def default_name() -> str | None:
    """The vault meant where none is named."""
    return os.environ.get("SKEIN_VAULT") or os.environ.get("OBSIDIAN_VAULT") or None


def resolve_vault(name: str | None = None, path: str | None = None) -> str | None:
    """By folder name, then by the start of an id, then as a folder; without a name the default one, else the first that exists."""
    known, name = registry(path), name or default_name()
    if not name:
        return next((p for p in known.values() if os.path.isdir(p)), None)
    for p in known.values():
        if os.path.basename(p.rstrip("/")).lower() == name.lower():
            return p
    for k, p in known.items():
        if k.startswith(name):
            return p
    folder = os.path.expanduser(name)
    return folder if os.path.isdir(folder) else None


def resolve_targets(name: str | None = None, path: str | None = None) -> list[str]:
    """"*", "stack" and "all": registered folders that hold no other one; "every": all; else a single one."""
    name = name or default_name()
    every = [p for p in dict.fromkeys(registry(path).values()) if os.path.isdir(p)]
    if name == "every":
        return every
    if name in ("*", "stack", "all"):
        real = [Path(p).resolve() for p in every]
        return [p for p, r in zip(every, real) if not any(o != r and o.is_relative_to(r) for o in real)]
    one = resolve_vault(name, path)
    return [one] if one else []


def noted(folder: str) -> bool:
    return folder not in SKIPPED and not folder.startswith(".")


def walk(root: str, prefix: str = ""):
    """(relative path, whole path, bytes) of each note below a prefix, in code-point order. Folders off the prefix aren't entered.

    root is a folder, or a URI of a file system that pyarrow knows (hdfs, s3, gs, file).
    """
    found = []
    if "://" in root:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, top = FileSystem.from_uri(root)
        todo = [top.rstrip("/")]
        while todo:
            for f in fs.get_file_info(FileSelector(todo.pop())):
                rel = f.path[len(top.rstrip("/")) + 1 :]
                if f.type == FileType.Directory and noted(f.base_name) and (prefix.startswith(rel + "/") or (rel + "/").startswith(prefix)):
                    todo.append(f.path)
                elif f.type == FileType.File and f.base_name.endswith(".md") and rel.startswith(prefix):
                    found.append((rel, f"{root.rstrip('/')}/{rel}", f.size))
    else:
        for folder, inner, files in os.walk(root):
            at = os.path.relpath(folder, root).replace(os.sep, "/")
            at = "" if at == "." else at + "/"
            inner[:] = [d for d in inner if noted(d) and (prefix.startswith(f"{at}{d}/") or f"{at}{d}/".startswith(prefix))]
            found += [(at + f, os.path.join(folder, f), None) for f in files if f.endswith(".md") and (at + f).startswith(prefix)]
        found = [(rel, full, size_of(full)) for rel, full, _ in found]
    yield from sorted(found)


def size_of(path: str) -> int | None:
    try:
        return os.path.getsize(path)
    except OSError:
        return None


def content_of(path: str) -> bytes:
    if "://" not in path:
        return Path(path).read_bytes()
    from pyarrow.fs import FileSystem

    fs, at = FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        return f.read()


class Files(InputPartition):
    def __init__(self, rows: list[tuple]):
        self.rows = rows


class VaultReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.content = options.get("content", "true").lower() == "true"
        self.prefix = options.get("prefix", "")

    def partitions(self):
        """Files in order, cut after BATCH_BYTES or BATCH files."""
        rows, seen, parts, held = [], set(), [], 0
        for o, root in enumerate(self.roots):
            for rel, full, size in walk(root, self.prefix):
                real = full if "://" in full else os.path.realpath(full)
                if real in seen:  # a folder within another
                    continue
                seen.add(real)
                if rows and (held + (size or 0) > BATCH_BYTES or len(rows) == BATCH):
                    parts.append(Files(rows))
                    rows, held = [], 0
                rows.append((len(seen) - 1, o, root, rel, full, size))
                held += size or 0
        return [*parts, Files(rows)]

    def read(self, partition):
        for i, o, root, rel, full, size in partition.rows:
            text = None
            if self.content:
                try:
                    text = content_of(full).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
                except OSError:
                    text = ""
            yield i, o, os.path.basename(root.rstrip("/")), rel, Path(rel).stem, size, text, root.rstrip("/") if "://" in root else os.path.realpath(root)


class VaultSource(DataSource):
    """Options: paths (comma separated) or path, folders or URIs; content=false reads names and sizes alone; prefix of relative paths.

    Filters aren't pushed down: Spark keeps the reader of a DataFrame, and a filter of one query would stay for the next.
    """

    @classmethod
    def name(cls):
        return "vault"

    def schema(self):
        return "note_id bigint, vault_ord int, vault string, relpath string, stem string, size bigint, content string, root string"

    def reader(self, schema):
        return VaultReader(self.options)


def read_vaults(spark: SparkSession, *roots: str, content: bool = True, prefix: str = "") -> DataFrame:
    """The notes of one or several folders, those below a prefix alone if one is given."""
    spark.dataSource.register(VaultSource)
    return spark.read.format("vault").option("paths", ",".join(roots)).option("content", str(content).lower()).option("prefix", prefix).load()
