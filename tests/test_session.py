from types import SimpleNamespace

import pytest

from shoploom.session import clear_tables, new_table, shared_folder, tables_folder


def test_tables_are_cleared(spark):
    path = new_table(spark)
    assert path.startswith(tables_folder(spark)) and path != new_table(spark)
    spark.range(3).write.parquet(path)
    assert clear_tables(spark) and not clear_tables(spark)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_must_name_its_folder(master):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
    unset, named = (SimpleNamespace(get=lambda key, default=None, value=value: value or default) for value in (None, "hdfs:///shared"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(SimpleNamespace(conf=unset, sparkContext=context))
    assert shared_folder(SimpleNamespace(conf=named, sparkContext=context)) == "hdfs:///shared"
