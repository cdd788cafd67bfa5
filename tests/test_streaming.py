def test_newest_version_arrives(spark, tmp_path):
    from tessera.streaming.arrivals import arriving, newest

    folder = str(tmp_path / "in")
    rows = [("A_S1_HE_adj_v1.tiff",), ("A_S1_HE_adj_v3.tiff",), ("A_S1_HE_mask_v2.tiff",)]
    spark.createDataFrame(rows, "path string").selectExpr("path", "timestamp'2024-01-01 10:00:00' as arrived").write.parquet(folder)
    query = newest(arriving(spark, folder)).writeStream.format("memory").queryName("newest_files").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.awaitTermination(60)
    got = {(r.kind, r.version) for r in spark.table("newest_files").collect()}
    assert got == {("adj", 3), ("mask", 2)}
