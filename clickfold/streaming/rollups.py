"""Month and all-time totals of the daily metrics.

Totals per product and name add up, so a month is the sum of its days and all time the sum of
its months. Every month carries a change number, raised when a batch or a recomputed day adds
to it. A month's totals are stored under the number they were computed for and are current
while it stands; the all-time totals name the months they hold, each with its number. Reading
takes the widest level that is current and folds days for the rest, so the result never depends
on when the totals were made.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from clickfold.operators.measures import rollup
from clickfold.schemas import PRODUCT_TOTALS
from clickfold.sources.tables import (
    drop_partitions,
    drop_path,
    marked,
    marker,
    partition_values,
    put_marker,
    read_text,
    table_exists,
    write_text,
)

#: Measures of some days (as YYYY-MM-DD), one row per day and product.
DayMeasures = Callable[[Sequence[str]], DataFrame]

KEYS = ("product_id", "product_name", "product_category")


class TotalsTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.changes_path = f"{root}/metric_changes"
        self.months_path = f"{root}/month_totals"
        self.all_path = f"{root}/all_totals"
        self.all_manifest_path = f"{root}/all_totals_of"

    def mark_changed(self, months: Iterable[str]) -> None:
        """Raise the change number of months (as YYYY-MM)."""
        for month in months:
            folder = f"{self.changes_path}/month={month}"
            newest = marker(self.spark, folder)
            put_marker(self.spark, folder, max(time.time_ns(), (newest or 0) + 1))

    def _changes(self) -> dict[str, int]:
        found = {}
        for month, path in partition_values(self.spark, self.changes_path):
            number = marker(self.spark, path)
            if number is not None:
                found[month] = number
        return found

    def _month_folder(self, month: str, number: int) -> str:
        return f"{self.months_path}/month={month}/version={number}"

    def _stored_month(self, month: str, number: int) -> bool:
        return table_exists(self.spark, f"{self._month_folder(month, number)}/_SUCCESS")

    def _all_manifest(self) -> tuple[int, dict[str, int]] | None:
        """Version of the newest all-time totals, and the months in them."""
        found = marked(self.spark, self.all_manifest_path)
        if not found:
            return None
        version, path = max(found)
        return version, json.loads(read_text(self.spark, path))

    def roll_up(self, measures: DayMeasures, days: Sequence[str]) -> int:
        """Store what is not current: changed months from their days, and all time from the
        months but the newest one, which is still growing. Returns the months computed.

        Change numbers are read first: what is added meanwhile raises them and so makes what
        was computed count as old.
        """
        changes, computed = self._changes(), 0
        for month, number in changes.items():
            if self._stored_month(month, number):
                continue
            own = [day for day in days if day.startswith(month)]
            totals = rollup(measures(own), *KEYS)
            totals.write.mode("overwrite").parquet(self._month_folder(month, number))
            drop_partitions(
                self.spark, f"{self.months_path}/month={month}", lambda v: int(v) < number
            )
            computed += 1
        closed = {m: changes[m] for m in sorted(changes)[:-1]}
        newest = self._all_manifest()
        if closed and (newest is None or newest[1] != closed):
            version = 1 if newest is None else newest[0] + 1
            rows = self._read([self._month_folder(m, n) for m, n in closed.items()])
            rollup(rows, *KEYS).write.mode("overwrite").parquet(f"{self.all_path}/version={version}")
            write_text(self.spark, f"{self.all_manifest_path}/{version}", json.dumps(closed))
            for old, path in marked(self.spark, self.all_manifest_path):
                if old < version:
                    drop_path(self.spark, path)
            drop_partitions(self.spark, self.all_path, lambda v: int(v) != version)
        return computed

    def _read(self, folders: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(PRODUCT_TOTALS).parquet(*folders)

    def read(self, measures: DayMeasures, days: Sequence[str]) -> DataFrame:
        """All-time totals: current all-time ones, current months, and days for the rest."""
        changes, newest = self._changes(), self._all_manifest()
        held = newest[1] if newest is not None else {}
        # One changed month makes the sum of all useless; the other months then stand in.
        current = bool(held) and all(changes.get(m) == n for m, n in held.items())
        folders = [f"{self.all_path}/version={newest[0]}"] if current else []
        loose = []
        months = sorted({*changes, *(day[:7] for day in days)})
        for month in months:
            if current and month in held:
                continue
            number = changes.get(month)
            if number is not None and self._stored_month(month, number):
                folders.append(self._month_folder(month, number))
            else:
                loose += [day for day in days if day.startswith(month)]
        parts = []
        if folders:
            parts.append(self._read(folders))
        if loose or not folders:
            parts.append(rollup(measures(loose), *KEYS))
        return rollup(reduce(DataFrame.unionByName, parts), *KEYS)
