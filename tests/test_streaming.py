"""Row functions and row filters hold no state, so a stream accepts them."""

from pyspark.sql import functions as F

from aftershock.catalog import fixtures as fx
from aftershock.functions.moments import round_to_candle
from aftershock.functions.numbers import signed_surprise
from aftershock.operators.gates import macro_filter


def test_stateless_steps_on_a_stream(spark, sf, tmp_path):
    rows = fx.releases(spark, sf)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def step(df):
        surprise = signed_surprise(F.col("forecast"), F.col("actual"), F.col("forecast_error"))
        return macro_filter(df, "USD").select(
            "event_id", round_to_candle(F.col("datetime")).alias("slot"), surprise.alias("s")
        )

    query = (
        step(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination(120)
    want = step(rows)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
