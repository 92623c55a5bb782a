"""Where intermediate tables go."""

import os
from types import SimpleNamespace

import pytest

from wiretally.session import released, shared_folder, tabled


def _session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder)
    context = SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: "set", setCheckpointDir=None)
    return SimpleNamespace(conf=conf, sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://h:7077", "local-cluster[3,2,1024]", "k8s://h"])
def test_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError):
        shared_folder(_session(master))
    assert shared_folder(_session(master, "s3://b/x")) == "s3://b/x"


def test_local_session_makes_its_own(spark):
    assert os.path.isdir(shared_folder(spark))
    assert shared_folder(_session("local[4]")) and shared_folder(_session("local"))


def test_released_table_is_gone(spark):
    made = tabled(spark.range(5).toDF("x"), "gone")
    path = made.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
    assert os.path.isdir("/" + path.lstrip("/"))
    released(spark, path)
    assert not os.path.exists("/" + path.lstrip("/"))
