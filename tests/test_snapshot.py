from pyspark.sql import functions as F

from sonaria.plans import checks


class Catalog:
    def __init__(self, df):
        self.df = df

    def __call__(self, name):
        assert name == "registered"
        return self.df


def test_products_are_counted_by_view(spark):
    rows = [("K1", "a", True, True, False), ("K1", "b", True, False, None), ("K2", "b", False, False, True), ("K3", "c", None, None, None), ("K81", "d", True, True, True), ("K270", "e", True, False, False)]
    df = spark.createDataFrame(rows, "reg_key string, content_dir string, in64 boolean, in32 boolean, in_user boolean")
    made = checks.snapshot_list(Catalog(df)).collect()
    assert [tuple(r) for r in made] == [("snapshot-000000006", "file time", "", 0, False), ("snapshot-000000002", "day 2", "before import", 3, True), ("snapshot-000000000", "day 0", "before import", 3, True)]
    assert checks.snapshot_list(Catalog(df.where(F.lit(False)))).collect() == []
