"""Tables with versions that several writers change: compare-and-swap of a small manifest.

A version is a manifest, made by put-if-absent, that names a base and the changes since. A writer reads a
version, writes its changed rows beside it and asks for the next number; if another writer has it by then, nothing of
the change is seen and the writer decides anew on the newer version. A change costs its own rows, as
rows are replaced when the table is read: the newest change of a key stands for its rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.operators.lifecycle import transition_ok
from ledgerlark.sources import markers


class Snapshots:
    """A table below a shared folder. key: columns that name a row; NULL is a value like another."""

    def __init__(self, spark: SparkSession, folder: str, key: Sequence[str]):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), list(key)

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/versions/{version:012d}"

    def _put(self, version: int, base: str, changes: list[str], schema: str) -> bool:
        return markers.put_if_absent(self.spark, self._manifest(version), json.dumps({"base": base, "changes": changes, "schema": schema}))

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return path

    def create(self, rows: DataFrame) -> bool:
        """The first version; False if there is one."""
        return self._put(1, self._write(rows), [], rows.schema.json())

    def version(self) -> int:
        return int((markers.names(self.spark, f"{self.folder}/versions") or ["0"])[-1])

    def _told(self, version: int) -> tuple[str, list[str], T.StructType]:
        got = json.loads(markers.text(self.spark, self._manifest(version)))
        return got["base"], got["changes"], T.StructType.fromJson(json.loads(got["schema"]))

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest one if none is named."""
        base, changes, schema = self._told(self.version() if version is None else version)
        rows = self.spark.read.schema(schema).parquet(base)
        if not changes:
            return rows
        newer = None
        for place, path in enumerate(changes):
            got = self.spark.read.schema(schema).parquet(path).withColumn("_place", F.lit(place))
            newer = got if newer is None else newer.unionAll(got)
        last = newer.groupBy(*self.key).agg(F.max_by(F.struct(*schema.names), "_place").alias("_row"))
        same = F.lit(True)
        for k in self.key:
            same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        rest = rows.alias("t").join(last.alias("s"), same, "left_anti")
        return rest.unionAll(last.select("_row.*"))

    def commit(self, seen: int, changed: DataFrame) -> bool:
        """Make the version after `seen` with these rows in place of those of their keys; False if another writer came first."""
        base, changes, schema = self._told(seen)
        path = self._write(changed.select(*(F.col(f.name).cast(f.dataType) for f in schema)))
        if self._put(seen + 1, base, [*changes, path], schema.json()):
            return True
        markers.remove(self.spark, path)
        return False

    def compact(self) -> bool:
        """A version with the same rows and no changes to look up."""
        seen = self.version()
        rows = self.read(seen)
        return self._put(seen + 1, self._write(rows), [], rows.schema.json())

    def change(self, asked: DataFrame, outcome: Column, does: str, change: dict[str, Column], tries: int = 20) -> DataFrame:
        """Change the rows asked for whose outcome is `does`, and say what became of every key asked for, once each.

        outcome is over the table's columns; a key that the table doesn't have is not_found. The outcomes are those
        of the version that the change was made on.
        """
        missing = "_missing"
        for _ in range(tries):
            seen = self.version()
            rows = self.read(seen).withColumn(missing, F.lit(False))
            same = F.lit(True)
            for k in self.key:
                same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"t.{k}"))
            got = asked.select(*self.key).distinct().alias("a").join(rows.alias("t"), same, "left")
            got = got.select(*(F.col(f"a.{k}") for k in self.key), *(F.col(f"t.{c}") for c in rows.columns if c not in self.key), F.when(F.col(missing).isNull(), "not_found").otherwise(outcome).alias("outcome"))
            path = self._write(got)
            told = self.spark.read.schema(got.schema).parquet(path)
            if self.commit(seen, told.where(F.col("outcome") == does).withColumns(change)):
                return told.drop(missing)
            markers.remove(self.spark, path)
        raise RuntimeError(f"{tries} other writers came first")


def bulk_claim(leads: Snapshots, asked: DataFrame, user: str, at: Column, owner: str = "claimed_by", stamp: str = "claimed_at") -> DataFrame:
    """claimed, already_mine, taken (with its owner) or not_found for each id: of two users who ask at once one gets it."""
    outcome = F.when(F.col(owner).isNull(), "claimed").when(F.col(owner) == user, "already_mine").otherwise("taken")
    return leads.change(asked, outcome, "claimed", {owner: F.lit(user), stamp: at})


def bulk_assign(leads: Snapshots, asked: DataFrame, user: str | None, at: Column, to: str = "assigned_to", stamp: str = "updated_at") -> DataFrame:
    """assigned or not_found for each id; None takes the assignment away."""
    return leads.change(asked, F.lit("assigned"), "assigned", {to: F.lit(user).cast("string"), stamp: at})


def bulk_status(leads: Snapshots, asked: DataFrame, stage: str, at: Column, status: str = "stage", stamp: str = "updated_at") -> DataFrame:
    """moved, illegal (the stage machine says no) or not_found for each id."""
    may = F.coalesce(transition_ok(F.col(status), F.lit(stage)), F.lit(False))
    return leads.change(asked, F.when(may, "moved").otherwise("illegal"), "moved", {status: F.lit(stage), stamp: at})


