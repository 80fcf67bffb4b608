"""The signal registry as an append-only event table, its lifecycle, and a hash-chained audit log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantloom.operators.ranges import lagged

# The lifecycle's transitions; every status but the last may also retire.
TRANSITIONS = (
    ("DISCOVERED", "VALIDATED"), ("VALIDATED", "STAGING"), ("STAGING", "PRODUCTION"), ("PRODUCTION", "RETIRED"),
    ("DISCOVERED", "RETIRED"), ("VALIDATED", "RETIRED"), ("STAGING", "RETIRED"),
)


def latest(events: DataFrame) -> DataFrame:
    """The current row of each signal: its last status, and for each metric the last value that isn't NULL.

    ``events``: name, seq, status and any further columns.
    """
    return events.groupBy("name").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in events.columns if c not in ("name", "seq")), F.max("seq").alias("seq"))


class RegistryError(ValueError):
    """A name that is taken or unknown, an unknown metric, or a forbidden step."""


def insert(events: DataFrame, new: DataFrame) -> DataFrame:
    """``events`` with the first rows of new signals (name and any metrics), DISCOVERED; a name that is taken or comes twice is an error."""
    names = new.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    taken = names.join(events.select("name").distinct(), "name", "left_semi").unionByName(names.where("n > 1")).first()
    if taken:
        raise RegistryError(f"signal already registered: {taken['name']}")
    first = new.withColumns({"seq": F.lit(1).cast(events.schema["seq"].dataType), "status": F.lit("DISCOVERED")})
    return events.unionByName(first, allowMissingColumns=True)


def get(events: DataFrame, name: str) -> Row | None:
    """The current row of one signal, None if there is none."""
    return latest(events.where(F.col("name") == name)).first()


def require(events: DataFrame, name: str) -> Row:
    """The current row of one signal, or a RegistryError."""
    if (found := get(events, name)) is None:
        raise RegistryError(f"no such signal: {name}")
    return found


def _appended(events: DataFrame, values: dict) -> DataFrame:
    row = events.sparkSession.range(1).select(*(F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in events.schema))
    return events.unionByName(row)


def update_metrics(events: DataFrame, name: str, **metrics: object) -> DataFrame:
    """``events`` with a row that holds new values of metrics and no status; those given as None stay as they are."""
    if strange := sorted(set(metrics) - (set(events.columns) - {"name", "seq", "status"})):
        raise RegistryError(f"no such metric: {', '.join(strange)}")
    return _appended(events, metrics | {"name": name, "seq": require(events, name)["seq"] + 1})


def advance(events: DataFrame, name: str, status: str, **fields: object) -> DataFrame:
    """``events`` with the next step of a signal, or a RegistryError if the lifecycle forbids it."""
    now = require(events, name)
    if (now["status"], status) not in TRANSITIONS:
        raise RegistryError(f"{name}: {now['status']} cannot become {status}")
    return _appended(events, fields | {"name": name, "seq": now["seq"] + 1, "status": status})


def by_status(events: DataFrame, status: str) -> DataFrame:
    return latest(events).where(F.col("status") == status).orderBy("name")


def stamped(events: DataFrame) -> DataFrame:
    """Each signal's times of validation, promotion and retirement (name, at, status)."""
    first = lambda s: F.min(F.when(F.col("status") == s, F.col("at")))
    return events.groupBy("name").agg(first("VALIDATED").alias("validated_at"), first("PRODUCTION").alias("promoted_at"), first("RETIRED").alias("retired_at"))


def bad_transitions(events: DataFrame) -> DataFrame:
    """name, seq, before, status of every step that the lifecycle forbids; a first status must be DISCOVERED.

    Rows without a status (updates of metrics) are no steps.
    """
    spark: SparkSession = events.sparkSession
    allowed = spark.createDataFrame(TRANSITIONS, "before string, status string")
    steps = events.where("status is not null").select("name", "seq", "status", F.lag("status").over(W.partitionBy("name").orderBy("seq")).alias("before"))
    started = steps.where("before is null and status <> 'DISCOVERED'")
    wrong = steps.where("before is not null").join(F.broadcast(allowed), ["before", "status"], "left_anti")  # seven rows
    return started.select("name", "seq", "before", "status").unionByName(wrong.select("name", "seq", "before", "status"))


def _verified(linked: DataFrame) -> DataFrame:
    return linked.withColumn("intact", F.col("hash").eqNullSafe(F.sha2("body", 256))).withColumn("ok", F.col("linked") & F.col("intact"))


def chain(entries: DataFrame, by: str = "chain") -> DataFrame:
    """Verification of hash-chained entries (chain, seq, body, prev_hash, hash): linked, intact, ok.

    ``body`` is the canonical text, previous hash included, that was hashed; the first entry has no previous hash. A chain is looked at
    by one task; ``long_chain`` is for chains of many entries.
    """
    before = F.lag("hash").over(W.partitionBy(by).orderBy("seq"))
    return _verified(entries.withColumn("linked", F.col("prev_hash").eqNullSafe(before)))


def long_chain(entries: DataFrame, by: str = "chain") -> DataFrame:
    """``chain`` for chains of any length: entries are dealt by ranges, and each range is told the hash before it."""
    found = lagged(entries, [by], ["seq"], "hash", "__before")
    return _verified(found.withColumn("linked", F.col("prev_hash").eqNullSafe(F.col("__before"))).drop("__before"))


# What library code may not contain.
CODE_RULES = (
    ("environment access", r"os\.(environ|getenv)"), ("print call", r"^\s*print\("), ("bare except", r"^\s*except\s*:"),
    ("credential literal", r"(?i)(api_?key|password|secret|token)\s*=\s*['\"][^'\"]{8,}['\"]"), ("wall clock", r"(datetime\.now|date\.today|time\.time)\("),
)


#: Files that a rule doesn't look at, and the folders that a rule looks at only: path within the tree, up to a pattern's end.
CODE_ALLOWED = {"environment access": ("*/settings.py",), "print call": ("*/__main__.py",)}
CODE_FOLDERS = {"wall clock": ("*/operators/*", "*/plans/*", "*/functions/*")}


def scan_tree(spark: SparkSession, folder: str, pattern: str = "*.py", allowed: Mapping[str, Sequence[str]] = CODE_ALLOWED, folders: Mapping[str, Sequence[str]] = CODE_FOLDERS) -> DataFrame:
    """path, line, rule of every finding in the files below ``folder``, paths and lines as an editor shows them.

    ``allowed`` names the files that a rule passes over, ``folders`` those that a rule is confined to; ``*`` stands for any characters.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder, wholetext=True)
    path = F.substring_index("_metadata.file_path", folder.rstrip("/").split("://")[-1] + "/", -1)
    text = F.regexp_replace("value", r"\r\n?", "\n")
    lines = files.select(path.alias("path"), F.posexplode(F.split(text, "\n")).alias("line", "value")).withColumn("line", (F.col("line") + 1).cast("long"))
    found = code_findings(lines)

    def listed(patterns: Mapping[str, Sequence[str]], otherwise: bool) -> Column:
        met = F.lit(otherwise)
        for rule, globs in patterns.items():
            own = reduce(Column.__or__, (F.concat(F.lit("/"), "path").like(g.replace("_", "\\_").replace("*", "%")) for g in globs))
            met = F.when(F.col("rule") == rule, own).otherwise(met)
        return met

    return found.where(~listed(allowed, False) & listed(folders, True))


def code_findings(lines: DataFrame) -> DataFrame:
    """path, line, rule for every rule that a line (path, line, value) breaks."""
    hits = F.array_compact(F.array(*(F.when(F.col("value").rlike(p), n) for n, p in CODE_RULES)))
    return lines.select("path", "line", F.explode(hits).alias("rule"))
