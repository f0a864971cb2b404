"""The emissions report as a data source: ``spark.read.format("emissions_report")``.

A report is a folder. Every write that commits adds one numbered report file, in the nested form
of a single report: project, running totals, and the files that hold its records. Tasks write
their records themselves; the driver sees a path and two sums a task. A number is taken by
creating its file, which only one writer can do, so writers that commit at the same time line up
and lose nothing. The numbers are the offsets of a stream that reads the folder.

The folder is on a file system that all executors mount.
"""

import json
import os
import uuid
from dataclasses import dataclass
from datetime import timezone

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition,
    WriterCommitMessage)

from newsmill.schemas import LEDGER

NAME = "emissions_report"
FILES, COMMITS = "records", "commits"
GRAMS = 1000


def register(spark: SparkSession) -> str:
    spark.dataSource.register(EmissionsReport)
    return NAME


def _home(options) -> str:
    path = options.get("path")
    if not path:
        raise ValueError("a report needs a path")
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


def _numbers(home: str) -> list[int]:
    folder = os.path.join(home, COMMITS)
    found = os.listdir(folder) if os.path.isdir(folder) else []
    return sorted(int(f.removesuffix(".json")) for f in found if f.endswith(".json"))


def _commit(home: str, number: int) -> dict:
    with open(os.path.join(home, COMMITS, f"{number:012d}.json"), encoding="utf-8") as file:
        return json.load(file)


def head(path: str) -> dict:
    """Project, totals and number of records, from the last report file alone."""
    home = _home({"path": path})
    numbers = _numbers(home)
    if not numbers:
        return {"project": None, "total_kg": 0.0, "total_g": 0.0, "records": 0}
    last = _commit(home, numbers[-1])
    return {k: last[k] for k in ("project", "total_kg", "total_g")} | {"records": last["count"]}


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    path: str | None
    kg: float
    count: int


class EmissionsReport(DataSource):
    """Options: ``path``, and ``project`` for a report that is begun."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        return LEDGER

    def reader(self, schema) -> "_Reader":
        return _Reader(_home(self.options))

    def writer(self, schema, overwrite) -> "_Writer":
        if overwrite:
            raise ValueError("a report is only appended to")
        return _Writer(_home(self.options), schema, self.options.get("project"))

    def streamReader(self, schema) -> "_StreamReader":
        return _StreamReader(_home(self.options))


def _records(partition: _File):
    from datetime import datetime
    with open(partition.path, encoding="utf-8") as file:
        for line in file:
            r = json.loads(line)
            ts = datetime.fromisoformat(r["timestamp"]).replace(tzinfo=timezone.utc) if r["timestamp"] else None
            yield ts, r["stage"], r["emissions_kg"], r["emissions_g"]


def _partitions(home: str, numbers) -> list[_File]:
    return [_File(os.path.join(home, FILES, name)) for n in numbers for name in _commit(home, n)["files"]]


class _Reader(DataSourceReader):
    def __init__(self, home: str):
        self.home = home

    def partitions(self):
        return _partitions(self.home, _numbers(self.home)) or [_File("")]

    def read(self, partition):
        return _records(partition) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of commits; a batch is the commits between two."""

    def __init__(self, home: str):
        self.home = home

    def initialOffset(self) -> dict:
        return {"commits": 0}

    def latestOffset(self) -> dict:
        numbers = _numbers(self.home)
        return {"commits": numbers[-1] + 1 if numbers else 0}

    def partitions(self, start: dict, end: dict):
        return _partitions(self.home, range(start["commits"], end["commits"])) or [_File("")]

    def read(self, partition):
        return _records(partition) if partition.path else iter(())


class _Writer(DataSourceWriter):
    def __init__(self, home: str, schema, project: str | None):
        self.home, self.names, self.project = home, schema.names, project

    def write(self, iterator) -> _Written:
        """One task: a file of its own, which no reader knows before the commit."""
        folder = os.path.join(self.home, FILES)
        os.makedirs(folder, exist_ok=True)
        name, kg, count = f"{uuid.uuid4().hex}.jsonl", 0.0, 0
        with open(os.path.join(folder, name), "w", encoding="utf-8") as file:
            for row in iterator:
                r = dict(zip(self.names, row))
                amount = r.get("emissions_kg") or 0.0
                ts = r.get("ts")
                if ts is not None and ts.tzinfo is not None:
                    ts = ts.astimezone(timezone.utc).replace(tzinfo=None)
                json.dump({"timestamp": ts.isoformat() if ts else None, "stage": r.get("stage"),
                           "emissions_kg": amount, "emissions_g": amount * GRAMS}, file)
                file.write("\n")
                kg, count = kg + amount, count + 1
        if not count:
            os.remove(os.path.join(folder, name))
        return _Written(name if count else None, kg, count)

    def commit(self, messages) -> None:
        written = [m for m in messages if m is not None and m.path]
        kg, count = sum(m.kg for m in written), sum(m.count for m in written)
        folder = os.path.join(self.home, COMMITS)
        os.makedirs(folder, exist_ok=True)
        while True:
            numbers = _numbers(self.home)
            before = _commit(self.home, numbers[-1]) if numbers else {
                "project": self.project, "total_kg": 0.0, "total_g": 0.0, "count": 0}
            total = before["total_kg"] + kg
            report = {"project": before["project"] or self.project, "total_kg": total,
                      "total_g": total * GRAMS, "count": before["count"] + count,
                      "files": [m.path for m in written]}
            # written in full under a name of its own, and then given the number, unless it is taken
            draft = os.path.join(folder, f"{uuid.uuid4().hex}.draft")
            with open(draft, "w", encoding="utf-8") as file:
                json.dump(report, file, indent=2)
            number = numbers[-1] + 1 if numbers else 0
            try:
                os.link(draft, os.path.join(folder, f"{number:012d}.json"))
                return
            except FileExistsError:
                continue
            finally:
                os.remove(draft)

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None and m.path and os.path.exists(os.path.join(self.home, FILES, m.path)):
                os.remove(os.path.join(self.home, FILES, m.path))
