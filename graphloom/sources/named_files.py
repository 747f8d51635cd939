"""Data source writers with a commit of their own: files under chosen names, and bundles of parts with a manifest.

Tasks write into a staging folder, each attempt under a name of its own.  The commit, on the driver, moves what the
successful attempts wrote into place and writes the marker last; until then, and if anything fails, nothing is visible.
Messages to the driver hold a few numbers per file, never contents.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING = "_staging"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    """(name, where it is staged, rows, bytes) of each file."""

    files: list[tuple[str, str, int, int]]


class _Staged(DataSourceWriter):
    def __init__(self, options):
        self.path, self.options = options["path"].rstrip("/"), dict(options)

    def _open(self, name: str):
        fs, root = _store(self.path)
        at = f"{root}/{STAGING}/{uuid.uuid4().hex}/{name}"
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return at, fs.open_output_stream(at)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.path)
        fs.create_dir(root, recursive=True)
        done = sorted(f for m in messages if m for f in m.files)
        for name, at, _, _ in done:
            fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
            fs.move(at, f"{root}/{name}")
        self._drop(fs, root)
        total = {"files": len(done), "rows": sum(f[2] for f in done), "bytes": sum(f[3] for f in done)}
        with fs.open_output_stream(f"{root}/{self.marker}") as out:
            out.write(json.dumps(self._manifest(done) | total).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(*_store(self.path))

    @staticmethod
    def _drop(fs, root: str) -> None:
        if fs.get_file_info(f"{root}/{STAGING}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{STAGING}")


class NamedFiles(DataSource):
    """Rows (name, line): a file for each name, its lines in the order of the rows; a name's rows are in one task, together.

    Options: path, and marker, a JSON text that the success marker holds beside the totals.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, line string"

    def writer(self, schema, overwrite: bool) -> NamedFilesWriter:
        return NamedFilesWriter(self.options)


class NamedFilesWriter(_Staged):
    marker = "_SUCCESS"

    def _manifest(self, done) -> dict:
        return json.loads(self.options.get("marker", "{}"))

    def write(self, iterator: Iterator) -> Written:
        done, name, out = [], None, None
        for row in iterator:
            if row.name != name:
                if out:
                    out.close()
                name, (at, out) = row.name, self._open(row.name)
                done.append([name, at, 0, 0])
            line = (row.line + "\n").encode()
            out.write(line)
            done[-1][2], done[-1][3] = done[-1][2] + 1, done[-1][3] + len(line)
        if out:
            out.close()
        return Written([tuple(d) for d in done])


class Bundle(DataSource):
    """Rows (path, content): a part of JSON lines for each task, and one manifest of parts.

    Options: path, and strict: with "true" a null content fails the whole bundle, else its entry is left out.
    """

    @classmethod
    def name(cls) -> str:
        return "bundle"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options)


class BundleWriter(_Staged):
    marker = "manifest.json"

    def _manifest(self, done) -> dict:
        return {"parts": [{"name": n, "entries": rows, "bytes": size} for n, _, rows, size in done]}

    def write(self, iterator: Iterator) -> Written:
        strict = self.options.get("strict", "false") == "true"
        name, rows, size, out = f"part-{uuid.uuid4().hex}.json", 0, 0, None
        for row in iterator:
            if row.content is None:
                if strict:
                    raise ValueError(f"{row.path} can't be had")
                continue
            if out is None:
                at, out = self._open(name)
            line = (json.dumps({"path": row.path, "content": row.content}, ensure_ascii=False) + "\n").encode()
            out.write(line)
            rows, size = rows + 1, size + len(line)
        if out is None:
            return Written([])
        out.close()
        return Written([(name, at, rows, size)])
