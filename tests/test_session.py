"""Where intermediate tables go."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tagspark import session


def fake(master, named=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: named or default),
                           sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_the_folder_named_by_the_session_is_used():
    assert session.shared_dir(fake("yarn", "hdfs://shared/ckpt/")) == "hdfs://shared/ckpt"
    assert session.fresh_path(fake("yarn", "hdfs://x"), "t").startswith("hdfs://x/tagspark/app-1/t-")


def test_only_a_local_session_may_choose_its_own():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(fake("spark://host:7077"))
    local = fake("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)


def test_a_written_table_is_computed_once(spark):
    drawn = spark.range(100).select("id", F.rand().alias("x"))
    kept = session.written(drawn, "drawn")
    assert kept.schema == drawn.schema or kept.columns == drawn.columns
    assert sorted(kept.collect()) == sorted(kept.collect())


def test_written_tables_can_be_cleared(spark):
    import os
    session.written(spark.range(3), "gone").collect()
    folder = f"{session.shared_dir(spark)}/tagspark/{spark.sparkContext.applicationId}".removeprefix("file:")
    assert os.listdir(folder)
    session.clear_written(spark)
    assert not os.path.exists(folder)
