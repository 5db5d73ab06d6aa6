"""Where lineage is cut."""

import pytest

from tallygrain.session import ensure_checkpoint_dir, materialize


class Context:
    def __init__(self, master, current=None, named=None):
        self.master, self.current, self.named = master, current, named

    def getCheckpointDir(self):
        return self.current

    def setCheckpointDir(self, folder):
        self.current = folder

    def getConf(self):
        return self

    def get(self, key, default=None):
        return self.named if key == "spark.checkpoint.dir" else default


class Session:
    def __init__(self, context):
        self.sparkContext = self.conf = context


def test_the_named_folder_is_used():
    context = Context("spark://host", named="s3a://shared/checkpoints")
    assert ensure_checkpoint_dir(Session(context)) == "s3a://shared/checkpoints" == context.current


def test_a_folder_already_set_stays():
    assert ensure_checkpoint_dir(Session(Context("spark://host", current="hdfs:///c"))) == "hdfs:///c"


def test_a_cluster_without_a_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session(Context("yarn")))


def test_materialize_cuts_the_plan(spark):
    frame = materialize(spark.range(10).filter("id > 4"))
    assert frame.count() == 5
    assert "Filter" not in frame._jdf.queryExecution().optimizedPlan().toString()
