"""Where plan cuts are stored."""

from types import SimpleNamespace

import pytest

from waystone.session import scratch_path, shared_dir


def session(conf, checkpoint, master):
    made = []
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: made[0] if made else checkpoint,
        setCheckpointDir=made.append,
    )
    return SimpleNamespace(conf={"spark.checkpoint.dir": conf}, sparkContext=context)


def test_shared_folder():
    assert shared_dir(session("hdfs://x/y/", None, "yarn")) == "hdfs://x/y"
    assert shared_dir(session(None, "hdfs://x/z", "yarn")) == "hdfs://x/z"
    with pytest.raises(ValueError):
        shared_dir(session(None, None, "yarn"))
    local = session(None, None, "local[2]")
    assert shared_dir(local) == shared_dir(local)


def test_paths_are_fresh(spark):
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert scratch_path(spark, "a").startswith(spark.conf.get("spark.checkpoint.dir"))
