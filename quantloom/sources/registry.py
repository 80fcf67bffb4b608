"""The signal registry as versions in a shared folder: each commit is one file that no other writer may have made before.

A writer reads the latest version, checks its change against it (``operators.lifecycle``), and tries to make the next version's file. If another
writer was first, it begins anew with what that one has written; so two writers can't both insert a name or take the same step.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import lifecycle

#: How often a writer begins anew before it gives up.
ATTEMPTS = 50


class Registry:
    """The registry's events in ``folder``, which all writers share; ``schema`` holds name, seq, status, and metrics."""

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.files.mkdirs(self.path(self.folder))

    def version(self) -> int:
        """The last version's number; 0 for an empty registry."""
        names = (s.getPath().getName() for s in self.files.listStatus(self.path(self.folder)))
        return max((int(m[1]) for m in map(re.compile(r"v(\d{10})\.json").fullmatch, names) if m), default=0)

    def events(self, version: int | None = None) -> DataFrame:
        """All rows up to ``version`` (the last)."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).json([f"{self.folder}/v{k:010d}.json" for k in range(1, version + 1)])

    def _create(self, version: int, lines: list[str]) -> bool:
        """Make a version's file with its whole content, unless there is one: whether it was made."""
        draft, final = (f"{self.folder}/{name}" for name in (f".{uuid.uuid4().hex}", f"v{version:010d}.json"))
        out = self.files.create(self.path(draft), False)
        out.write(("\n".join(lines) + "\n").encode())
        out.close()
        if self.files.getScheme() == "file":  # a local rename would replace; a link doesn't
            local, target = (self.path(p).toUri().getPath() for p in (draft, final))
            try:
                os.link(local, target)
                return True
            except FileExistsError:
                return False
            finally:
                os.remove(local)
        made = self.files.rename(self.path(draft), self.path(final))
        if not made:
            self.files.delete(self.path(draft), False)
        return made

    def commit(self, change: Callable[[DataFrame], DataFrame]) -> int:
        """Add the rows that ``change`` adds to the events; the version that holds them. A RegistryError of ``change`` is final."""
        for _ in range(ATTEMPTS):
            version = self.version()
            before = self.events(version)
            added = change(before).join(before.select("name", "seq"), ["name", "seq"], "left_anti")
            # A commit holds what one writer adds at a time.
            lines = [json.dumps(json.loads(r[0]), sort_keys=True) for r in added.select(F.to_json(F.struct(*before.columns))).collect()]
            if self._create(version + 1, lines):
                return version + 1
        raise lifecycle.RegistryError(f"{ATTEMPTS} other writers were first")

    def insert(self, new: DataFrame) -> int:
        return self.commit(lambda events: lifecycle.insert(events, new))

    def advance(self, name: str, status: str, **values: object) -> int:
        return self.commit(lambda events: lifecycle.advance(events, name, status, **values))

    def update_metrics(self, name: str, **metrics: object) -> int:
        return self.commit(lambda events: lifecycle.update_metrics(events, name, **metrics))
