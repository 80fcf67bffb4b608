"""Files: cutting lineage in the shared folder, artifacts with digests, and the audit log."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark's setting by which a query's shuffle files are removed when it has ended.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; its own shuffle files aren't needed again and go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before) if before is not None else spark.conf.unset(SHUFFLE_CLEANUP)
    return spark.read.schema(df.schema).parquet(path)


def sha256_file(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def write_artifact(path: str | Path, data: bytes) -> str:
    """Write a small file and its digest beside it, each by replacing; returns the digest."""
    path = Path(path)
    digest = hashlib.sha256(data).hexdigest()
    for to, content in ((path, data), (path.with_name(path.name + ".sha256"), f"{digest}  {path.name}\n".encode())):
        with tempfile.NamedTemporaryFile(dir=path.parent, delete=False) as out:
            out.write(content)
            out.flush()
            os.fsync(out.fileno())
        os.replace(out.name, to)
    return digest


def verify_artifact(path: str | Path) -> bool:
    path = Path(path)
    beside = path.with_name(path.name + ".sha256")
    return path.exists() and beside.exists() and beside.read_text().split()[:1] == [sha256_file(path)]


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


class AuditLog:
    """Append-only JSON lines, each with the hash of its content and of the entry before."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.touch()

    def entries(self) -> list[dict]:
        return [json.loads(x) for x in self.path.read_text().splitlines() if x.strip()]

    def last(self) -> dict | None:
        """The last entry, read from the end of the file."""
        with self.path.open("rb") as file:
            at, tail = file.seek(0, 2), b""
            while at and tail.rstrip().count(b"\n") < 1:
                step = min(at, 1 << 16)
                at -= step
                file.seek(at)
                tail = file.read(step) + tail
        line = tail.rstrip().rsplit(b"\n", 1)[-1]
        return json.loads(line) if line else None

    def record(self, event: str, payload: dict, actor: str = "system") -> str:
        last = self.last()
        entry = {"timestamp": dt.datetime.now(dt.UTC).isoformat(), "actor": actor, "event": event, "payload": payload, "prev_hash": last["hash"] if last else None}
        digest = hashlib.sha256(canonical(entry).encode()).hexdigest()
        with self.path.open("a") as out:
            out.write(json.dumps(entry | {"hash": digest}) + "\n")
        return digest

    def verify(self) -> bool:
        before = None
        for e in self.entries():
            content = {k: v for k, v in e.items() if k != "hash"}
            if e.get("prev_hash") != before or hashlib.sha256(canonical(content).encode()).hexdigest() != e.get("hash"):
                return False
            before = e["hash"]
        return True
