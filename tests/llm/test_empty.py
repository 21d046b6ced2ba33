import glob
import os

import __spark_entry__ as entry


def test_empty_tables(spark, sf, tmp_path):
    for p in glob.glob(f"{sf}/*.parquet"):
        spark.read.parquet(p).limit(0).write.parquet(f"{tmp_path}/{os.path.basename(p)}")
    for name in ("p1_found", "p1_recall", "p2_main", "p3_groups", "p4_found", "p6_dfr", "p7_counts", "p8_check", "p9_clean", "p10_restored", "p10_restoration"):
        entry.queries()[name](spark, str(tmp_path)).count()
