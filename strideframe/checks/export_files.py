"""Writes the mapped tables as an export folder, so that source queries read real files.

A file is one JSON array. Each task streams the sorted rows of its athletes into their files,
line by line; no task holds the rows of an athlete, and nothing is moved by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, functions as F

from strideframe.checks.warehouse import Warehouse

# File names as devices write them.
FILE_NAMES = {
    "activities": "runner_0_summarizedActivities", "metrics": "MetricsAcuteTrainingLoad",
    "predictions": "RunRacePredictions", "readiness": "TrainingReadinessDTO",
    "maxmet": "MetricsMaxMetData", "history": "TrainingHistory",
}
NO_ATHLETE = "__HIVE_DEFAULT_PARTITION__"  # folder of rows without an athlete


def _write_arrays(root: str, name: str):
    """Writes the file of each athlete; rows come sorted. A task run again writes the same files
    again: each is written beside its place and takes it whole when it ends."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = pyarrow.fs.FileSystem.from_uri(root)
        current, out, n = None, None, 0

        def end() -> None:
            out.write(b"\n]\n")
            out.close()
            store.move(f"{base}/{current}/_{name}.part", f"{base}/{current}/{name}_0.json")

        for batch in batches:
            for athlete, document in zip(batch["athlete_id"], batch["document"]):
                lead = ",\n"
                if athlete != current:
                    if out is not None:
                        end()
                    store.create_dir(f"{base}/{athlete}", recursive=True)
                    out = store.open_output_stream(f"{base}/{athlete}/_{name}.part")
                    current, lead, n = athlete, "[\n", n + 1
                out.write((lead + document).encode())
        if out is not None:
            end()
        yield pd.DataFrame({"files": [n]})
    return run


def _documents(w: Warehouse, family: str) -> DataFrame:
    rows = w.family(family).drop("source_file", *(["date"] if family != "activities" else []))
    body = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "athlete_id"])
    if family == "activities":
        body = F.struct(F.array(body).alias("summarizedActivitiesExport"))
    athlete = F.coalesce("athlete_id", F.lit(NO_ATHLETE))
    return rows.select(athlete.alias("athlete_id"), F.to_json(body).alias("document"))


def write_export(w: Warehouse, root: str, families: list[str]) -> str:
    """One file an athlete and family, in the athlete's folder below the root.

    The number of tasks is stated, so that adaptive execution does not merge them by bytes: the
    work is in the number of files.
    """
    tasks = int(w.spark.conf.get("spark.sql.shuffle.partitions"))
    for family in families:
        rows = _documents(w, family).repartition(tasks, "athlete_id").sortWithinPartitions("athlete_id")
        rows.mapInPandas(_write_arrays(root, FILE_NAMES[family]), "files long").agg(F.sum("files")).collect()
    return root
