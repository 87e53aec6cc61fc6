"""Layers of checks: prerequisites are worked out once, whatever the number of layers."""

from pyspark.sql import functions as F

from rippleframe.operators import dataflow


def test_prerequisites_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    checks = spark.range(1, 9).select(F.col("id").alias("check_id"), F.lit(False).alias("degradable"), F.lit(False).alias("reactor"), F.lit(True).alias("passed"))
    needs = spark.range(2, 9).select(F.col("id").alias("check_id"), F.lit(0).alias("ord"), (F.col("id") - 1).alias("depends_on"))
    rows = dataflow.check_results(checks, needs.mapInArrow(counted, needs.schema)).collect()
    assert len(rows) == 8 and {r["status"] for r in rows} == {"PASS"}
    assert read.value <= 3 * 7  # two checks of the input and the step; before, every layer read it again
