"""Versioned fitted pipelines in a shared folder, with aliases that are switched atomically.

A version is one JSON manifest, ``versions/00000001.json``, beside a model folder of its own; it is
published only when its model is whole.  An alias is a log of such manifests: the newest one counts, and
the next can be made by one writer only.  Both rest on one primitive, ``publish``: a file is written
under another name and given its final one, which fails where that is taken.  The file system must offer
this (a rename that doesn't overwrite, or a hard link, on local paths); plain object stores don't.

A writer that is lost leaves a model folder or a file whose name starts with a dot, never half a version.
Old versions and old entries of an alias stay.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "name string, version bigint, path string, stages array<string>, inputs array<string>, tags map<string,string>"
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


class StoreError(ValueError):
    """A model, version or alias is missing or isn't what it should be."""


class Conflict(StoreError):
    """Another writer was first."""


@dataclass(frozen=True)
class Version:
    name: str
    version: int
    path: str
    stages: list[str]
    inputs: list[str]
    tags: dict[str, str]


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make ``path`` with ``text``, whole or not at all; False if it exists."""
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/.{name}.{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(hidden), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    out = fs.create(source, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a local rename overwrites
            try:
                os.link(source.toUri().getPath(), target.toUri().getPath())
            except FileExistsError:
                return False
            return True
        options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(source, target, options)
        except Exception:
            if fs.exists(target):
                return False
            raise
        return True
    finally:
        fs.delete(source, False)


class ModelStore:
    """Models below ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str, *more: str) -> str:
        for part in (name, *more):
            if not _NAME.fullmatch(part):
                raise StoreError(f"{part!r} is no name of a model or an alias")
        return "/".join([self.root, name, *more])

    def _entries(self, folder: str) -> dict[int, str]:
        """Number to path of a folder's manifests; an absent folder has none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return {int(n[:8]): f"{folder}/{n}" for n in names if re.fullmatch(r"\d{8}\.json", n)}

    def _read(self, path: str) -> dict:
        return json.loads(self.spark.read.option("wholetext", True).text(path).first()[0])

    def register(self, name: str, model: PipelineModel, tags: dict[str, str] | None = None) -> Version:
        """Save a fitted pipeline as the next version; a writer that is overtaken takes the one after."""
        folder = self._folder(name, "versions")
        path = f"{self.root}/{name}/model-{uuid.uuid4().hex[:12]}"
        model.write().save(path)
        stages = [type(s).__name__ for s in model.stages]
        inputs = next((list(s.getInputCols()) for s in model.stages if s.hasParam("inputCols") and s.isDefined("inputCols")), [])
        while True:
            n = max(self._entries(folder), default=0) + 1
            made = Version(name, n, path, stages, inputs, {k: str(v) for k, v in (tags or {}).items()})
            if publish(self.spark, f"{folder}/{n:08d}.json", json.dumps(made.__dict__, sort_keys=True)):
                return made

    def versions(self, name: str) -> DataFrame:
        """One row a version."""
        paths = list(self._entries(self._folder(name, "versions")).values())
        return self.spark.read.schema(VERSION).option("mode", "FAILFAST").json(paths).orderBy("version") if paths else self.spark.createDataFrame([], VERSION)

    def version(self, name: str, version: int) -> Version:
        entries = self._entries(self._folder(name, "versions"))
        if version not in entries:
            raise StoreError(f"{name} has no version {version}; there are {sorted(entries)}")
        return Version(**self._read(entries[version]))

    def _head(self, name: str, alias: str) -> tuple[int, int | None]:
        """(number of an alias's newest entry, version that it names); (0, None) if the alias was never set."""
        entries = self._entries(self._folder(name, f"alias-{alias}"))
        return (max(entries), self._read(entries[max(entries)])["version"]) if entries else (0, None)

    def resolve(self, name: str, alias: str) -> int:
        version = self._head(name, alias)[1]
        if version is None:
            raise StoreError(f"{name} has no alias {alias}")
        return version

    def promote(self, name: str, alias: str, version: int, expected: int | None) -> None:
        """Point ``alias`` at ``version`` if it names ``expected`` now (None: was never set), else ``Conflict``."""
        self.version(name, version)
        n, now = self._head(name, alias)
        if now != expected:
            raise Conflict(f"{name}@{alias} is at {now}, not at {expected}")
        if not publish(self.spark, f"{self._folder(name, f'alias-{alias}')}/{n + 1:08d}.json", json.dumps({"version": version, "before": now})):
            raise Conflict(f"{name}@{alias} was moved by another writer")

    def history(self, name: str, alias: str) -> DataFrame:
        """(entry, version, before) of all switches of an alias."""
        paths = list(self._entries(self._folder(name, f"alias-{alias}")).values())
        schema = "entry bigint, version bigint, before bigint"
        if not paths:
            return self.spark.createDataFrame([], schema)
        entry = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d+)", 1).cast("bigint").alias("entry")
        return self.spark.read.schema("version bigint, before bigint").json(paths).select(entry, "version", "before").orderBy("entry")

    def load(self, name: str, version: int | str, last: str | None = None, inputs: list[str] | None = None) -> PipelineModel:
        """The pipeline of a version or alias, as it was registered; nothing is fitted again.

        ``last`` names the type that the last stage must have, ``inputs`` the features in their order.
        """
        made = self.version(name, self.resolve(name, version) if isinstance(version, str) else version)
        model = PipelineModel.load(made.path)
        stages = [type(s).__name__ for s in model.stages]
        if stages != made.stages:
            raise StoreError(f"{name} {made.version} holds {stages}, but was registered as {made.stages}")
        if last is not None and stages[-1:] != [last]:
            raise StoreError(f"{name} {made.version} ends in {stages[-1] if stages else 'nothing'}, not in {last}")
        if inputs is not None and made.inputs != list(inputs):
            raise StoreError(f"{name} {made.version} reads {made.inputs}, not {list(inputs)}")
        return model
