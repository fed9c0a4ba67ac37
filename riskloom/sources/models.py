"""A store of fitted models by version, in a folder that all executors and drivers share.

objects/<digest> holds a saved `PipelineModel` (or any model that Spark saves) under the digest of its files.
<name>/index-<n>.json lists a name's versions, a JSON object a line. To register, the model is saved aside
and moved to its digest, and only then is the next index moved into place, whole. So a writer that dies
leaves files that nothing refers to, readers see the index before or after and never a part of one, and of
two writers at once one finds its index taken and starts again from the other's.

Only the few lines of an index pass through the driver; files are hashed by Spark.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "model string, version string, digest string, metadata_hash string, registered_at double, description string, metrics map<string, double>, features array<string>, config map<string, string>, stage string"


def bumped(latest: str | None, part: str = "patch") -> str:
    """The next semantic version; the first is 1.0.0."""
    if latest is None:
        return "1.0.0"
    major, minor, patch = map(int, latest.split("."))
    return {"major": f"{major + 1}.0.0", "minor": f"{major}.{minor + 1}.0", "patch": f"{major}.{minor}.{patch + 1}"}[part]


def order(version: str) -> tuple[int, ...]:
    return tuple(map(int, version.split(".")))


def metadata_hash(info: dict) -> str:
    """md5 of the metadata as JSON with sorted keys: the same for the same metadata."""
    return hashlib.md5(json.dumps(info, sort_keys=True, default=str).encode()).hexdigest()


@dataclass
class ModelStore:
    spark: SparkSession
    root: str

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    @property
    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _indexes(self, name: str) -> list[int]:
        """Numbers of the indexes that are in place."""
        at = self._path(name)
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[6:-5]) for n in names if n.startswith("index-") and n.endswith(".json") and n[6:-5].isdigit())

    def entries(self, name: str) -> list[dict]:
        """The name's versions, oldest first."""
        return self._read(name)[1]

    def _read(self, name: str) -> tuple[int, list[dict]]:
        found = self._indexes(name)
        if not found:
            return 0, []
        text = self.spark.read.text(str(self._path(name, f"index-{found[-1]}.json"))).collect()
        return found[-1], sorted((json.loads(r.value) for r in text), key=lambda e: order(e["version"]))

    def versions(self, name: str) -> DataFrame:
        """The name's versions as a table."""
        found = self._indexes(name)
        if not found:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(str(self._path(name, f"index-{found[-1]}.json")))

    def _replace(self, name: str, number: int, entries: list[dict]) -> bool:
        """Puts index `number` in place, whole; False if another writer has put one there."""
        aside, there = self._path(name, f".{uuid.uuid4().hex}"), self._path(name, f"index-{number}.json")
        out = self._fs.create(aside, False)
        out.write(bytearray("".join(json.dumps(e, sort_keys=True) + "\n" for e in entries).encode()))
        out.close()
        done = not self._fs.exists(there) and self._fs.rename(aside, there)
        if not done:
            self._fs.delete(aside, False)
        return done

    def digest(self, path: str) -> str:
        """Of all files below: their places and contents."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        named = files.where(~F.col("path").rlike(r"/(_SUCCESS|[^/]*\.crc)$")).select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("place"), F.sha2("content", 256).alias("sha"))
        rows = sorted((r.place.split("/", 1)[1], r.sha) for r in named.collect())  # a model's few files
        return hashlib.sha256(json.dumps(rows).encode()).hexdigest()

    def register(self, name: str, model, metrics: dict[str, float] | None = None, features: list[str] | None = None, config: dict[str, str] | None = None, description: str = "", bump: str = "patch", version: str | None = None) -> str:
        """Saves `model` under a new version, which is returned. A version that exists is refused."""
        aside = "/".join([self.root, "objects", f".{uuid.uuid4().hex}"])
        model.save(aside)
        digest = self.digest(aside)
        if not self._fs.exists(self._path("objects", digest)):
            self._fs.rename(self._path("objects", aside.rpartition("/")[2]), self._path("objects", digest))
        else:
            self._fs.delete(self._path("objects", aside.rpartition("/")[2]), True)
        about = {"metrics": metrics or {}, "features": features or [], "config": config or {}, "description": description, "type": type(model).__name__}
        self._fs.mkdirs(self._path(name))
        while True:
            number, entries = self._read(name)
            new = version or bumped(entries[-1]["version"] if entries else None, bump)
            if any(e["version"] == new for e in entries):
                raise ValueError(f"{name} has a version {new}")
            entry = {"model": name, "version": new, "digest": digest, "metadata_hash": metadata_hash(about), "registered_at": time.time(), "description": description, "metrics": about["metrics"], "features": about["features"], "config": about["config"], "stage": "none"}
            if self._replace(name, number + 1, [*entries, entry]):
                return new

    def load(self, name: str, version: str | None = None, kind=PipelineModel, check: bool = True):
        """(model, entry) of a version, the latest without one; `check` compares the files with their digest first."""
        entries = self.entries(name)
        found = [e for e in entries if version is None or e["version"] == version]
        if not found:
            raise ValueError(f"{name} has no version {version or ''}".rstrip())
        path = "/".join([self.root, "objects", found[-1]["digest"]])
        if check and self.digest(path) != found[-1]["digest"]:
            raise ValueError(f"the files of {name} {found[-1]['version']} have changed")
        return kind.load(path), found[-1]

    def stage(self, name: str, version: str, stage: str = "production") -> None:
        """Moves a version to a stage; who was in it is retired."""
        while True:
            number, entries = self._read(name)
            if all(e["version"] != version for e in entries):
                raise ValueError(f"{name} has no version {version}")
            moved = [{**e, "stage": stage if e["version"] == version else "retired" if e["stage"] == stage else e["stage"]} for e in entries]
            if self._replace(name, number + 1, moved):
                return

    def retain(self, name: str, last: int) -> list[str]:
        """Drops all but the `last` newest versions and those in a stage; files that no version has any more go as well. Returns what was dropped."""
        while True:
            number, entries = self._read(name)
            kept = [e for i, e in enumerate(entries) if i >= len(entries) - last or e["stage"] in ("production", "staging")]
            gone = [e for e in entries if e not in kept]
            if not gone or self._replace(name, number + 1, kept):
                break
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path()) if s.isDirectory() and s.getPath().getName() != "objects"]
        used = {e["digest"] for n in names for e in self.entries(n)}
        for e in gone:
            if e["digest"] not in used:
                self._fs.delete(self._path("objects", e["digest"]), True)
        return [e["version"] for e in gone]
