"""Written tables: read back with their schema, kept while young, swept when old."""

import os

from tidemark.storage import materialize, scratch_dir, sweep


def test_tables_are_kept_while_young(spark):
    table = materialize(spark.range(5), "numbers")
    assert table.count() == 5 and sweep(spark, 1) == 0 and table.count() == 5
    folder = scratch_dir(spark).removeprefix("file://") + "/tidemark"
    mine = next(name for name in os.listdir(folder) if name.startswith("numbers-"))
    os.utime(f"{folder}/{mine}", (0, 0))
    assert sweep(spark, 1) == 1 and mine not in os.listdir(folder)
