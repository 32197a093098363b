import pytest

from loomspan.sources.scratch import Scratch, shared_dir


def test_tables_survive_until_dropped_and_settings_return(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    scratch = Scratch(spark, "test")
    table = scratch.save(spark.range(10).repartition(3), "ids")
    assert table.count() == 10 and spark.conf.get(key, None) == before
    assert table._loomspan_path.startswith(shared_dir(spark))
    scratch.drop(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(table._loomspan_path).count()


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                return Context()

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            class Nothing:
                @staticmethod
                def isDefined():  # noqa: N802
                    return False

            return Nothing

    class Session:
        sparkContext = Context()  # noqa: N815

        class conf:  # noqa: N801
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
