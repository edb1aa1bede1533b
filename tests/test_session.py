"""The scratch folder, its clearing, and the shuffle files of a written table."""

import glob
import os

import pytest

from quillon import session


def test_materialise_and_clear(spark):
    df = session.materialise(spark.range(5).selectExpr("id", "cast(null as string) as s"), "t")
    assert df.count() == 5 and df.schema["s"].dataType.simpleString() == "string"
    assert session.scratch_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir", "file:"))
    empty = session.materialise(spark.createDataFrame([], "a int"), "e")
    assert empty.count() == 0
    session.clear_scratch(spark)


def test_clear_scratch(spark):
    written = session.materialise(spark.range(3), "x")
    assert written.count() == 3
    assert spark.conf.get(session.CLEANUP) == "false"
    session.clear_scratch(spark)
    assert not glob.glob(session.scratch_dir(spark).removeprefix("file://") + "/*")


def test_discard(spark):
    a, b = (session.materialise(spark.range(3), n) for n in "ab")
    session.discard(a)
    assert b.count() == 3 and not os.path.exists(a._scratch_path.removeprefix("file://"))


class Cluster:
    """What ``scratch_dir`` asks of a session on a cluster."""

    def __init__(self, **conf):
        self.settings = conf
        self.conf = self
        self.sparkContext = self
        self.master, self.applicationId = "spark://host:7077", "app"

    def get(self, name, default=None):
        return self.settings.get(name.replace("spark.", "", 1).replace(".", "_"), default)


def test_no_local_folder_on_a_cluster():
    assert session.scratch_dir(Cluster(checkpoint_dir="hdfs://x/c/")) == "hdfs://x/c/quillon/app"
    assert session.scratch_dir(Cluster(sql_warehouse_dir="hdfs://x/w")) == "hdfs://x/w/scratch/quillon/app"
    for bad in ({}, {"sql_warehouse_dir": "file:/tmp/w"}, {"sql_warehouse_dir": "/tmp/w"}):
        with pytest.raises(RuntimeError):
            session.scratch_dir(Cluster(**bad))
