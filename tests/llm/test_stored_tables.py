"""Life of the tables that operators keep in the checkpoint folder."""

from __future__ import annotations

import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from weftline.llm import common
from weftline.llm.components import connected_components

ROOT = Path(__file__).resolve().parents[2]


def place(table) -> Path:
    return Path(common._PLACES[table].removeprefix("file:"))


def test_discarded_tables_are_gone_and_others_stay(spark):
    kept, gone = common.stored(spark.range(5)), common.stored(spark.range(7))
    folder = place(gone)
    assert folder.exists() and gone.count() == 7
    common.discard(gone, gone, spark.range(3))
    assert not folder.exists() and kept.count() == 5 and place(kept).exists()


def test_setting_of_the_user_outlives_writes_at_once(spark):
    for own in ("false", "true"):
        spark.conf.set(common.SHUFFLE_CLEANUP, own)
        with ThreadPoolExecutor(4) as pool:
            tables = list(pool.map(lambda n: common.stored(spark.range(200).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))), range(8)))
        assert spark.conf.get(common.SHUFFLE_CLEANUP) == own and all(t.count() == 7 for t in tables) and not common._WRITING
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            common.stored(spark.range(3).select((F.col("id") / F.lit(0)).alias("x")))
        assert spark.conf.get(common.SHUFFLE_CLEANUP) == own and not common._WRITING
    spark.conf.unset(common.SHUFFLE_CLEANUP)


def test_rounds_of_components_leave_one_table(spark):
    parent = Path(common.checkpoint_folder(spark).removeprefix("file:")) / "tables"
    files = set(parent.iterdir()) if parent.exists() else set()
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    found = connected_components(chain)
    assert {r.component for r in found.collect()} == {0} and found.count() == 61
    assert len(set(parent.iterdir()) - files) == 1


def test_tables_go_with_the_driver(tmp_path):
    code = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", CHECK).getOrCreate()
from weftline.llm.common import stored
table = stored(spark.range(3))
import pathlib
assert table.count() == 3 and list(pathlib.Path(CHECK).rglob("tables/*/*.parquet"))
pathlib.Path(CHECK, "other").mkdir()
spark.stop()
"""
    env = {**os.environ, "PYTHONPATH": f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"}
    subprocess.run([sys.executable, "-c", code.replace("CHECK", repr(str(tmp_path)))], check=True, env=env, timeout=300)
    assert not list(tmp_path.rglob("*.parquet")) and (tmp_path / "other").exists()
