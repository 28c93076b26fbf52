"""Tables in the shared folder."""

import os

import pytest

from tracewell import session


def test_written_tables_live_in_the_shared_folder(spark):
    folder = session.own_folder(spark).removeprefix("file:")
    a = session.written(spark.range(10))
    assert a.count() == 10 and a.columns == ["id"] and os.path.isdir(folder)
    assert session.cut(spark.range(3)).count() == 3
    session.drop_written(spark)
    assert not os.path.isdir(folder)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        session.checkpoint_dir(Session())
    Conf.get = lambda self, key, default=None: "hdfs://x"
    assert session.checkpoint_dir(Session()) == "hdfs://x"
