"""Scratch paths: the named folder is taken, and a cluster without one is refused."""

from types import SimpleNamespace

import pytest

from tidewatch.plans import scratch


def test_named_folder(spark):
    assert scratch.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/x-")


def test_cluster_without_a_folder():
    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda _: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context))
