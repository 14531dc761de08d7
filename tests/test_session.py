import pytest

from pitchlens.session import _driver_memory, ensure_checkpoint_dir, shared_path


def test_checkpoint_dir_is_read_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    got = ensure_checkpoint_dir(spark)
    assert got and spark.conf.get("spark.checkpoint.dir") == got
    if configured:
        assert got == configured                     # a cluster's setting is used as is, never replaced
    assert ensure_checkpoint_dir(spark) == got       # stable
    assert shared_path(spark, "landed/x").startswith(got)


def test_driver_memory_is_bounded():
    mb = int(_driver_memory()[:-1])
    assert 1024 <= mb <= 16384


def test_a_cluster_without_a_shared_folder_is_refused():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())
