"""Versioned folders: data is written beside what is there, and becomes current when a manifest that names it is published."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import SparkSession


class Folder:
    """A folder of any file system that Spark reads; for small files and housekeeping, never for rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, below: str = "") -> list[str]:
        where = self._at(f"{self.path}/{below}".rstrip("/"))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(where)) if self._fs.exists(where) else []

    def text(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def put(self, name: str, text: str) -> None:
        """A whole file appears under its name at once, or not at all; one that is there is an error."""
        final, draft = self._at(f"{self.path}/{name}"), self._at(f"{self.path}/.{uuid.uuid4().hex}")
        if self._fs.exists(final):
            raise FileExistsError(f"{self.path}/{name}")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(f"{self.path}/{name}"), True)

    def temporary(self) -> None:
        """The folder goes when the session's process ends."""
        self._fs.deleteOnExit(self._at(self.path))


#: Manifests that stay, and with them the data they name: a reader has until the second next version to finish.
KEEP = 2


class Manifest:
    """The versions of a folder, newest last, each a small JSON file; the newest is what readers see.

    One writer at a time.  A version is published once: a writer that died before that has changed nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.folder = Folder(spark, path)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names("manifest") if n.endswith(".json") and n[0].isdigit())

    def get(self, version: int) -> dict:
        return json.loads(self.folder.text(f"manifest/{version:012d}.json"))

    def current(self) -> tuple[int, dict | None]:
        """The newest version and what it says; version 0 says nothing."""
        known = self.versions()
        return (known[-1], self.get(known[-1])) if known else (0, None)

    def publish(self, version: int, said: dict) -> None:
        self.folder.put(f"manifest/{version:012d}.json", json.dumps(said, sort_keys=True))

    def clean(self, keep: int = KEEP) -> None:
        """Drops all manifests but the newest `keep`, and of the data (data/<version>/<part>) all that these do not name."""
        versions = self.versions()
        for version in versions[:-keep]:
            self.folder.delete(f"manifest/{version:012d}.json")
        named = {path for v in versions[-keep:] for path in _paths(self.get(v))}
        for version in self.folder.names("data"):
            parts = {f"data/{version}/{p}" for p in self.folder.names(f"data/{version}") if p[0] != "." and not p.startswith("_SUCCESS")}
            if parts & named:
                for part in parts - named:
                    self.folder.delete(part)
            else:
                self.folder.delete(f"data/{version}")


def _paths(said: object) -> list[str]:
    """All texts in what a manifest says."""
    if isinstance(said, str):
        return [said]
    inside = said.values() if isinstance(said, dict) else said if isinstance(said, list) else []
    return [p for x in inside for p in _paths(x)]


def shared_folder(spark: SparkSession) -> str:
    """A new folder for results that a later step reads, where the driver and all executors see it.

    It lies below spark.checkpoint.dir; only where everything runs in one process may that be unset.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/fieldbook-shared"
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    Folder(spark, path).temporary()
    return path
