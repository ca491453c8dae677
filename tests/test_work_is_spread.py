"""Heavy work per row must not hang on how a small file was cut."""

from workloads.tools import catalogs

SMALL = "/root/testdata/sf0.001"


def test_catalogs_of_one_small_file_are_on_all_cores(spark):
    assert catalogs(spark, SMALL).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
