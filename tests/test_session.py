from pathlib import Path

from samplelake.session import drop_tables, materialise, new_table_path, shared_dir, spread


def test_tables_live_in_the_shared_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == folder
    kept = materialise(spark.range(5), "numbers")
    assert kept.count() == 5 and all(folder in f for f in kept.inputFiles())
    place = Path(new_table_path(spark, "x")).parent
    assert place.is_dir()
    drop_tables(spark)
    assert not place.exists()
    drop_tables(spark)
    assert materialise(spark.range(3), "again").count() == 3


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == 4
    assert spread(spark.range(10).repartition(9)).rdd.getNumPartitions() == 9
