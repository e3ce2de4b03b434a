"""Folders of intermediate results: who deletes them, and when."""

import os
import subprocess
import sys
import threading
from pathlib import Path

from granary import session


def test_scratch_is_the_callers_own(spark):
    kept, paths = {}, {}

    def other():
        with session.scratch(spark):
            paths["other"] = session._folders[kept.setdefault("df", session.materialize(spark.range(3)))]
            ready.set()
            go.wait(60)

    ready, go = threading.Event(), threading.Event()
    run = threading.Thread(target=other)
    run.start()
    ready.wait(60)
    with session.scratch(spark):
        mine = session.materialize(spark.range(5))
        paths["mine"] = session._folders[mine]
        assert mine.count() == 5
    assert not os.path.exists(paths["mine"]) and os.path.exists(paths["other"])
    go.set()
    run.join()
    assert not os.path.exists(paths["other"])


def test_folders_go_when_the_driver_ends(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {str(Path(session.ROOT))!r})
from granary import session
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.checkpoint.dir", {str(tmp_path)!r}).config("spark.ui.enabled", "false").getOrCreate()
assert session.materialize(spark.range(3)).count() == 3
import os; assert any('-' not in x for x in os.listdir({str(tmp_path)!r}))
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, capture_output=True)
    assert all("-" in x for x in os.listdir(tmp_path))  # the folder that Spark itself makes there
