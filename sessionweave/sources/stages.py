"""Stages whose results are kept and reused as long as nothing they come from has changed.

A stage's result lies in `folder`/`name`/`fingerprint`. The fingerprint covers the stage's plan, the sizes and times of the files that it
reads, and its settings. A manifest that names the fingerprint is written last, under another name first, so a stage that is killed
leaves nothing that a later run takes for a result; a later run starts at the first stage that has changed.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


class Stages:
    """Runs stages in one folder of any store that Spark writes to. `ran` and `reused` name what a run did."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.ran: list[str] = []
        self.reused: list[str] = []

    def _at(self, path: str) -> tuple:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self, name: str) -> dict | None:
        path, store = self._at(f"{self.folder}/{name}/{MANIFEST}")
        if not store.exists(path):
            return None
        lines = self.spark.read.text(f"{self.folder}/{name}/{MANIFEST}").collect()  # one line
        return json.loads("".join(r[0] for r in lines))

    def _write(self, name: str, said: dict) -> None:
        final, store = self._at(f"{self.folder}/{name}/{MANIFEST}")
        hidden = self._at(f"{self.folder}/{name}/.{uuid.uuid4().hex}")[0]
        out = store.create(hidden)
        out.write(json.dumps(said).encode())
        out.close()
        store.delete(final, False)
        if not store.rename(hidden, final):
            raise OSError(f"the manifest of {name} can't be written")

    def fingerprint(self, df: DataFrame, settings: dict | None = None) -> str:
        """Of the plan (numbers of columns and of stages' folders left out), the files that it reads, and the settings."""
        plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
        plan = re.sub(r"#\d+L?|@[0-9a-f]+|plan_id=\d+|resultId=\d+|rand\(-?\d+\)", "", plan)
        files = []
        for name in sorted(df.inputFiles()):
            path, store = self._at(name)
            status = store.getFileStatus(path)
            files.append((re.sub(r".*/(?=[^/]+/[^/]+$)", "", name) if name.startswith(self.folder) else name, status.getLen(), status.getModificationTime()))
        return hashlib.sha256(json.dumps([plan, df.schema.json(), files, settings or {}], sort_keys=True).encode()).hexdigest()[:32]

    def run(self, name: str, build: Callable[[], DataFrame], settings: dict | None = None) -> DataFrame:
        """The stage's result, read from its folder; `build` gives the plan, which runs only if no result of its fingerprint is there."""
        df = build()
        wanted = self.fingerprint(df, settings)
        said, path = self._manifest(name), f"{self.folder}/{name}/{wanted}"
        if said and said["fingerprint"] == wanted:
            self.reused.append(name)
        else:
            began = time.time()
            df.write.mode("overwrite").parquet(path)
            self._write(name, {"fingerprint": wanted, "settings": settings or {}, "seconds": round(time.time() - began, 3), "schema": df.schema.jsonValue()})
            if said:
                old, store = self._at(f"{self.folder}/{name}/{said['fingerprint']}")
                store.delete(old, True)
            self.ran.append(name)
        return self.spark.read.schema(df.schema).parquet(path)
