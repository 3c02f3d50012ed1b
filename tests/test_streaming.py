"""The stateful stream gives what the batch windows give."""

from datetime import date, timedelta

import numpy as np

from tidepanel.operators.timeseries import ewma_volatility
from tidepanel.streaming.running import ewma_stream


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(e, date(2020, 1, 1) + timedelta(days=i), None if rng.random() < 0.1 else float(rng.normal(0, 0.02))) for e in (1, 2) for i in range(60)]
    schema = "entity long, day date, value double"
    for k in range(3):
        part = [r for r in rows if (r[1] - date(2020, 1, 1)).days // 20 == k] + [(None, date(2020, 1, 1), 1.0), (1, None, 1.0)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ewma_stream(stream).writeStream.format("memory").queryName("ewma_out").option("checkpointLocation", str(tmp_path / "state")).outputMode("append").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    got = {(r["entity"], r["day"]): r["volatility"] for r in spark.table("ewma_out").collect()}
    batch = ewma_volatility(spark.createDataFrame(rows, schema), entity="entity", day="day", value="value").collect()
    assert len(got) == len(batch) == 120
    for r in batch:
        want = r["ewma_by_returns"]
        assert (want is None) == (got[r["entity"], r["day"]] is None)
        assert want is None or abs(want - got[r["entity"], r["day"]]) < 1e-12
