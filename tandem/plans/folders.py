"""Data source that writes a folder and a file for each project on a local or mounted file system, laid out as Spark's own partitioned text.

Hadoop's local file system starts a process for each permission that it sets, several for a file, which is most of the work where projects are many and small. Tasks
write their files themselves here, each attempt under a hidden folder beside the result; the commit moves what the successful attempts wrote and shows all of it by one rename.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: What a folder's name says of null and of an empty value, and the characters that it has as %XX.
NOTHING = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = re.compile(r"[\x00-\x1F\"#%'*/:=?\\\x7F{\[\]^]")


def folder(keys: list[str], values: list[str | None]) -> str:
    """<key>=<value>/<key>=<value> of a project."""
    plain = lambda s: ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", s)
    return "/".join(f"{plain(k)}={plain(v) if v else NOTHING}" for k, v in zip(keys, values))


def merge(source: str, target: str) -> None:
    """Moves what is in one folder to another, a folder as a whole where the other has none of its name."""
    with os.scandir(source) as entries:
        found = list(entries)
    for e in found:
        to = f"{target}/{e.name}"
        if e.is_dir() and os.path.isdir(to):
            merge(e.path, to)
        else:
            os.rename(e.path, to)


@dataclass
class Written(WriterCommitMessage):
    attempt: str


class FolderWriter(DataSourceArrowWriter):
    """Rows (keys as strings, value) that lie together by keys in each task: a file has its project's values, a line each, in the order they come."""

    def __init__(self, path: str, keys: list[str]) -> None:
        self.path, self.keys = path.rstrip("/"), keys
        above, name = os.path.split(self.path)
        self.staging = f"{above}/.{name}-{uuid.uuid4().hex}"

    def write(self, iterator):
        part, tag = TaskContext.get().partitionId(), uuid.uuid4().hex
        os.makedirs(attempt := f"{self.staging}/{tag}")
        last, out, n = None, None, 0
        try:
            for batch in iterator:
                *keys, values = batch.columns
                for *project, value in zip(*(k.to_pylist() for k in keys), values):
                    if project != last:
                        if out:
                            out.close()
                        os.makedirs(place := f"{attempt}/{folder(self.keys, project)}", exist_ok=True)
                        # numbered, as null and an empty value share a folder
                        out, last, n = open(f"{place}/part-{part:05d}-{tag}.c{n:03d}.txt", "xb"), project, n + 1
                    out.write((value.as_py() or "").encode() + b"\n")
        finally:
            if out:
                out.close()
        return Written(attempt)

    def commit(self, messages):
        os.makedirs(every := f"{self.staging}/all")
        for m in messages:
            if m is not None:
                merge(m.attempt, every)
        open(f"{every}/_SUCCESS", "xb").close()
        shutil.rmtree(self.path, ignore_errors=True)
        os.rename(every, self.path)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.staging, ignore_errors=True)


class Folders(DataSource):
    @classmethod
    def name(cls):
        return "folders"

    def writer(self, schema, overwrite):
        if not overwrite:
            raise ValueError("folders are written anew")
        return FolderWriter(self.options["path"], schema.names[:-1])
