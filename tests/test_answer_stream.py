import time

from lexvane.streaming.answers import INPUT, rolling_answers


def test_answers_live_expire_and_survive_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder, said = str(tmp_path / "in"), {}
    spark.createDataFrame([], INPUT).write.parquet(folder)

    def feed(*rows):
        spark.createDataFrame(list(rows), INPUT).coalesce(1).write.mode("append").parquet(folder)

    def run(*ids):
        """A query of its own on the same checkpoint, until these questions have replies: each call is a restart."""
        out = []
        stream = spark.readStream.schema(INPUT).parquet(folder)
        # A state that expires by the clock has a next batch at every trigger: the query is stopped, it does not end.
        q = rolling_answers(stream, 30).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(processingTime="1 second").start()
        until = time.time() + 90
        while time.time() < until and q.isActive and not set(ids) <= {r.query_id for r in out}:
            time.sleep(0.2)
        q.stop()
        said.update({r.query_id: (r.hit, r.response) for r in out})

    near, far = [0.999, 0.0447], [0.0, 1.0]
    feed(("answer", "n", None, "how long", [1.0, 0.0], "r1", 1), ("answer", "n", None, "how long now", [1.0, 0.0], "r2", 2), ("ask", "n", "a", "q", near, None, 3), ("ask", "m", "b", "q", near, None, 4), ("ask", "n", "c", "q", far, None, 0))
    run("a", "b", "c")
    assert said == {"a": (True, "r1"), "b": (False, None), "c": (False, None)}
    feed(("ask", "n", "d", "q", near, None, 5), ("ask", "n", "e", "q", far, None, 6))
    run("d", "e")
    assert said["d"] == (True, "r1") and said["e"] == (False, None)
    time.sleep(31)
    feed(("ask", "n", "f", "q", near, None, 7))
    run("f")
    assert said["f"] == (False, None)
