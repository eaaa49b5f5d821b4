"""The written export: whole files in place, nothing left beside them."""

import json
import os

from strideframe.checks import export_files
from strideframe.checks.warehouse import Warehouse


def test_files_are_written_in_place_and_whole(spark, tmp_path):
    spark.sql("select i as event_id, i % 5 as user_id, timestamp'2024-01-02 03:04:05' as ts, 'click' as event_type, "
              "cast(i as double) as value, concat('{\"k\": ', i % 9, '}') as props from (select explode(sequence(0, 199)) as i)"
              ).write.parquet(str(tmp_path / "in" / "events.parquet"))
    root = str(tmp_path / "out" / "export")
    export_files.write_export(Warehouse(spark, str(tmp_path / "in")), root, ["metrics", "maxmet"])
    assert os.listdir(tmp_path / "out") == ["export"]
    for athlete in range(5):
        assert sorted(os.listdir(f"{root}/{athlete}")) == ["MetricsAcuteTrainingLoad_0.json", "MetricsMaxMetData_0.json"]
        with open(f"{root}/{athlete}/MetricsAcuteTrainingLoad_0.json") as file:
            assert sorted(r["acwrPercent"] for r in json.load(file)) == [float(i) for i in range(200) if i % 5 == athlete]
