"""The test tables as labelled time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import HIST, NAME, STORED_TIME, column
from ..operators.histograms import HISTOGRAM, bucket_of


def epoch_ms(name: str) -> Column:
    """Of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', `{name}`)")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_value{event_type, user_id}."""
    return _table(spark, sf_dir, "events").select(
        epoch_ms("ts").alias("ts_ms"), F.col("ts").alias(STORED_TIME), "value", F.lit("event_value").alias(column(NAME)), F.col("event_type").alias(column("event_type")), F.col("user_id").cast("string").alias(column("user_id")), "event_id"
    )


def events_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_value_by_type{event_type}."""
    return events(spark, sf_dir).withColumn(column(NAME), F.lit("event_value_by_type")).drop(column("user_id"))


def event_histograms(spark: SparkSession, sf_dir: str, schema: int = 1) -> DataFrame:
    """event_sizes{event_type, user_id}: a native histogram of one observation for each event; small ones are in zero's bucket."""
    rows = events(spark, sf_dir).withColumn(column(NAME), F.lit("event_sizes"))
    value, small = F.col("value"), F.abs("value") <= 1.0
    none = F.array().cast("array<struct<i:int,c:double>>")
    one = F.array(F.struct(bucket_of(value, schema).alias("i"), F.lit(1.0).alias("c")))
    side = lambda hit: F.when(hit & ~small, one).otherwise(none)
    hist = F.struct(F.lit(schema).alias("schema"), F.lit(1.0).alias("zero_threshold"), small.cast("double").alias("zero_count"), F.lit(1.0).alias("count"), value.alias("sum"), side(value > 0).alias("pos"), side(value < 0).alias("neg"))
    return rows.withColumns({HIST: hist.cast(HISTOGRAM), "value": F.lit(None).cast("double")})


def event_histograms_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_sizes_by_type{event_type}."""
    return event_histograms(spark, sf_dir).withColumn(column(NAME), F.lit("event_sizes_by_type")).drop(column("user_id"))


#: Sources whose series hold several events of one time, which all count in range functions.
EVERY = (events_by_type, event_histograms_by_type)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_price{orderstatus, orderpriority}."""
    return _table(spark, sf_dir, "orders").select(
        epoch_ms("o_orderdate").alias("ts_ms"), F.col("o_orderdate").alias(STORED_TIME), F.col("o_totalprice").alias("value"), F.lit("order_price").alias(column(NAME)), F.col("o_orderstatus").alias(column("orderstatus")), F.col("o_orderpriority").alias(column("orderpriority")), F.col("o_orderkey").alias("orderkey")
    )


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem_quantity{returnflag, linestatus}; several samples share a time."""
    return _table(spark, sf_dir, "lineitem").select(
        epoch_ms("l_shipdate").alias("ts_ms"), F.col("l_shipdate").alias(STORED_TIME), F.col("l_quantity").alias("value"), F.lit("lineitem_quantity").alias(column(NAME)), F.col("l_returnflag").alias(column("returnflag")), F.col("l_linestatus").alias(column("linestatus")), F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("linenumber")
    )
