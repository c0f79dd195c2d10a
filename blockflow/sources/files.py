"""Files behind the data sources: ranges to read, and writes that are staged and then committed at once.

Paths may be local ones or URIs that Arrow's file systems know (file, hdfs, s3, gs). A task writes each of its files
under a name of its own in a staging folder; the commit moves the files of the tasks that succeeded, so a task that ran
twice leaves one file, and a job that failed leaves none.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import InputPartition, WriterCommitMessage

STAGING = "_staging-"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    if not re.match(r"[a-z0-9]+:", path):
        return fs.LocalFileSystem(), path.rstrip("/")
    system, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system, inner.rstrip("/")


def listed(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files of a folder in order of their names; hidden ones are left out."""
    system, at = opened(path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if found.type == fs.FileType.File:
        return [(at, found.size)]
    inside = system.get_file_info(fs.FileSelector(at, recursive=True))
    hidden = lambda p: any(x[:1] in "._" for x in p[len(at) + 1 :].split("/"))
    return sorted((f.path, f.size) for f in inside if f.type == fs.FileType.File and not hidden(f.path))


@dataclass
class Range(InputPartition):
    """What a task reads of a file: from `start` up to `stop`, in the reader's own units."""

    path: str
    start: int
    stop: int
    size: int


@dataclass
class Staged(WriterCommitMessage):
    """Final name and staged path of the files of a task."""

    files: list[tuple[str, str]]


class StagedWriter:
    """Staging, commit and abort of a folder of files, for data source writers to inherit."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.staging = STAGING + uuid.uuid4().hex

    def new(self, suffix: str) -> str:
        """A path of the task's own; parents exist afterwards."""
        system, at = opened(self.path)
        system.create_dir(f"{at}/{self.staging}", recursive=True)
        return f"{at}/{self.staging}/{uuid.uuid4().hex}{suffix}"

    def commit(self, messages) -> None:
        system, at = opened(self.path)
        files = sorted(f for m in messages if m is not None for f in m.files)
        names = [name for name, _ in files]
        twice = sorted({n for a, n in zip(names, names[1:]) if a == n})
        if twice:
            raise ValueError(f"written by more than one task: {twice[:5]}")
        system.create_dir(at, recursive=True)
        old = [p for p, _ in listed(at)]
        if self.overwrite:
            for p in old:
                system.delete_file(p)
        elif there := sorted({p.rpartition("/")[2] for p in old} & set(names)):
            raise FileExistsError(f"already there: {there[:5]}")
        for name, staged in files:
            system.move(staged, f"{at}/{name}")
        self.abort([])

    def abort(self, messages) -> None:
        system, at = opened(self.path)
        if system.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.staging}")
