from __future__ import annotations

import os
import subprocess
import sys
import zipfile
from pathlib import Path

import pytest

from postlake.__main__ import main
from postlake.plans import versions
from tests.test_feed import EXPECTED, SAMPLE, csv_text, line_of


def test_publish_rollback_export(spark, tmp_path):
    feed, store, out = tmp_path / "feed", str(tmp_path / "store"), str(tmp_path / "out")
    feed.mkdir()
    with zipfile.ZipFile(feed / "a.zip", "w") as z:
        z.writestr("feed.csv", csv_text([line_of(r) for r in SAMPLE]).encode("cp932"))
    assert main(["publish", "--feed", str(feed), "--store", store, "--zipped"]) == 0
    assert versions.current(spark, store).count() == len(EXPECTED)
    version = versions.current_version(spark, store)
    assert main(["rollback", "--store", store, "--data-version", version]) == 0
    assert main(["rollback", "--store", store, "--data-version", "v0"]) == 1
    assert main(["export", "--store", store, "--out", out]) == 0
    manifest = spark.read.json(f"{out}-manifest")
    assert sum(r.row_count for r in manifest.collect()) == len(EXPECTED)
    with pytest.raises(SystemExit):
        main(["rollback", "--store", store])


def test_tasks_do_not_need_the_package(tmp_path):
    """Python workers start in another folder and cannot import the package."""
    root = str(Path(__file__).parents[1])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from postlake.functions.text import normalize_keyword
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
df = spark.range(1).select(F.lit("１ ２").alias("s"))
print("found", df.select(normalize_keyword(F.col("s"))).first()[0])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert "found 12" in done.stdout, done.stderr[-500:]
