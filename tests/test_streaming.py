"""Stateless functions on a stream."""

from pyspark.sql import functions as F

from lithograph.functions import geo as G
from lithograph.operators import catalog


def test_catalog_functions_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 0.0, 200.0, 5.0), ("b", 80.0, 10.0, 5.0)], "crater_id string, lat double, lon double, diam_km double").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("crater_id string, lat double, lon double, diam_km double").parquet(str(tmp_path / "in"))
    kept = catalog.filter_catalog(rows, 1, 10, -60, 60).withColumn("lon", G.wrap_lon(F.col("lon")))
    query = kept.writeStream.format("memory").queryName("kept").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    query.awaitTermination(60)
    assert [(r.crater_id, r.lon) for r in spark.table("kept").collect()] == [("a", -160.0)]
