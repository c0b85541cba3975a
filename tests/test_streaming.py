from tvloom.streaming import guide


def test_streams(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) as ts, cast(id % 2 as int) as k from range(20)")
    rows.selectExpr("ts", "if(k = 0, 'offline', 'online') as status", "cast(10 as int) as response_ms", "'u' as stream_url").write.parquet(f"{tmp_path}/p")
    rows.selectExpr("ts as published", "'A' as channel_id", "'s' as start", "'e' as stop", "if(k = 0, 'T', 't') as title").write.parquet(f"{tmp_path}/g")

    def run(path, f, mode):
        stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
        query = f(stream).writeStream.outputMode(mode).format("memory").queryName("out").option("checkpointLocation", f"{path}-state-{mode}").start()
        query.processAllAvailable()
        query.stop()
        return spark.sql("select * from out").collect()

    assert sum(r.probes for r in run(f"{tmp_path}/p", guide.probe_counts, "complete")) == 20
    assert len(run(f"{tmp_path}/g", guide.fresh_programmes, "append")) == 1
