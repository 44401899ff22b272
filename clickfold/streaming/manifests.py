"""Which files hold a day's events: the per-batch folders and merged ones.

A day that was compacted has a manifest: a file named by its generation that says which folder
of merged rows is the current one, which batches it holds and which of those were withdrawn
again. Merged rows keep their batch number, so reading a day as of a batch, and repeating one
batch, work after compaction as before. Writing the manifest is the one step that changes what
readers see; whatever it does not name is left over and can go.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession

from clickfold.sources.tables import marked, partition_values, read_text, write_text


@dataclass(frozen=True)
class Manifest:
    """A day's merged folder. ``generation`` numbers the manifests of a day, ``merged`` is the
    generation that wrote the folder; ``withdrawn`` batches have rows there that do not count."""

    day: str
    generation: int
    merged: int
    batches: tuple[int, ...]
    withdrawn: tuple[int, ...] = ()

    @property
    def folder(self) -> str:
        return f"event_date={self.day}/merged={self.merged}"

    def without(self, batch: int) -> Manifest:
        """The next generation, in which the batch's merged rows no longer count."""
        return replace(
            self,
            generation=self.generation + 1,
            batches=tuple(b for b in self.batches if b != batch),
            withdrawn=(*self.withdrawn, batch),
        )


def write_manifest(spark: SparkSession, root: str, manifest: Manifest) -> None:
    body = {
        "merged": manifest.merged,
        "batches": manifest.batches,
        "withdrawn": manifest.withdrawn,
    }
    path = f"{root}/event_date={manifest.day}/{manifest.generation}"
    write_text(spark, path, json.dumps(body))


def read_manifest(spark: SparkSession, root: str, day: str) -> Manifest | None:
    """The newest manifest of a day."""
    found = marked(spark, f"{root}/event_date={day}")
    if not found:
        return None
    generation, path = max(found)
    body = json.loads(read_text(spark, path))
    return Manifest(
        day, generation, body["merged"], tuple(body["batches"]), tuple(body["withdrawn"])
    )


def read_manifests(spark: SparkSession, root: str) -> Iterator[Manifest]:
    """The newest manifest of every day that has one."""
    for day, _ in partition_values(spark, root):
        manifest = read_manifest(spark, root, day)
        if manifest is not None:
            yield manifest
