import pytest

from nightframe.plans.appends import QUALITY, VITALS, pair
from nightframe.sources import shared
from nightframe.streaming import appends

SCHEMA = "id bigint, side string, t bigint, heart_rate double, hrv double"


def both(spark, root):
    v, q = (appends.read(spark, root, n, s).collect() for n, s in (("vitals", VITALS), ("quality", QUALITY)))
    return sorted(r["id"] for r in v), sorted(r["vitals_id"] for r in q)


class Breaks(appends.Appended):
    """Fails before the table of a name."""

    def __init__(self, root, name):
        super().__init__(root, pair)
        self.name = name

    def write(self, rows, path):
        if f"/{self.name}/" in path:
            raise OSError("no disk")
        super().write(rows, path)


def test_a_batch_run_twice_leaves_one_copy(spark):
    root = shared.folder(spark, "tables")
    batch = spark.createDataFrame([(1, "left", 10, 60.0, 40.0), (2, "left", 20, None, None)], SCHEMA)
    assert both(spark, root) == ([], [])
    for _ in range(2):
        appends.Appended(root, pair)(batch, 0)
    appends.Appended(root, pair)(spark.createDataFrame([(3, "right", 10, 61.0, 1.0)], SCHEMA), 1)
    assert both(spark, root) == ([1, 2, 3], [1, 2, 3]) and appends.committed(spark, root) == [0, 1]


def test_a_failure_between_the_tables_leaves_neither(spark):
    root = shared.folder(spark, "tables")
    batch = spark.createDataFrame([(1, "left", 10, 60.0, 40.0)], SCHEMA)
    with pytest.raises(OSError):
        Breaks(root, "quality")(batch, 0)
    assert both(spark, root) == ([], [])
    appends.Appended(root, pair)(batch, 0)  # the batch comes again
    assert both(spark, root) == ([1], [1])


def test_streamed_copies_count_once_also_over_a_restart(spark):
    source, root, state = (shared.folder(spark, x) for x in ("source", "tables", "state"))
    rows = [(k, "left", 1000 + 60 * k, 60.0, 1.0) for k in range(20)]
    for part in (rows[:12] + rows[3:6], rows[8:] + [(99, "left", 1060, 1.0, 1.0)]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(source)
        appends.run(appends.unique(spark.readStream.schema(SCHEMA).parquet(source), ["side", "t"]), root, state, pair)
    assert both(spark, root) == (list(range(20)), list(range(20)))
    assert len(appends.committed(spark, root)) >= 2
