"""The shared folder: from the session, from the context, made on a local master, refused on a cluster; and its clearing."""

import os

import pytest

from graphloom.operators import checkpoints


class Conf:
    def __init__(self, value):
        self.value = value

    def get(self, key, default):
        return self.value or default


class Context:
    def __init__(self, master, conf=None, own=None):
        self.master, self.conf, self.own = master, conf, own

    def getConf(self):  # noqa: N802
        return Conf(self.conf)

    def getCheckpointDir(self):  # noqa: N802
        return self.own

    def setCheckpointDir(self, path):  # noqa: N802
        self.own = f"{path}/own"


class Session:
    def __init__(self, *args):
        self.sparkContext = Context(*args)


def test_where_the_folder_comes_from():
    assert checkpoints.shared_dir(Session("spark://m", "hdfs://x/y/")) == "hdfs://x/y"
    assert checkpoints.shared_dir(Session("spark://m", None, "s3a://b/c")) == "s3a://b/c"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoints.shared_dir(Session("spark://m"))
    local = Session("local[2]")
    assert checkpoints.shared_dir(local) == checkpoints.shared_dir(local) == local.sparkContext.own


def test_written_tables_go_when_cleared(spark, monkeypatch):
    monkeypatch.setattr(checkpoints, "_made", {})
    df = checkpoints.written(spark.range(5).toDF("a"))
    path = next(iter(checkpoints._made))
    assert df.count() == 5 and os.path.isdir(path.removeprefix("file:"))
    assert checkpoints.clear() == 1 and not os.path.exists(path.removeprefix("file:")) and not checkpoints._made


def test_iterations_without_a_named_folder(tmp_path):
    """A session of its own process, whose configuration names no folder: an iterative operator runs."""
    import subprocess
    import sys

    code = (
        "from pyspark import SparkConf, SparkContext\n"
        "from pyspark.sql import SparkSession\n"
        "conf = SparkConf().setMaster('local[2]').set('spark.ui.enabled', 'false').set('spark.sql.shuffle.partitions', '2')\n"
        "s = SparkSession(SparkContext(conf=conf))\n"
        "from graphloom.operators import graph\n"
        "e = s.createDataFrame([(1, 2), (2, 3), (3, 1)], 'src long, dst long')\n"
        "print('rows', graph.pagerank(e, rounds=2, tol=0).count(), s.sparkContext.getCheckpointDir())\n"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240, cwd=os.path.dirname(os.path.dirname(__file__)), env={**os.environ, "SPARK_CONF_DIR": str(tmp_path)})
    assert "rows 3" in out.stdout, out.stderr[-2000:]
