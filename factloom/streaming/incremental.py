"""Row-local queries over appended facts as streams; other queries are run again in full."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.query import QuerySpec, row_local


def start(spark: SparkSession, spec: QuerySpec, source: str, schema, sink: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a spec over a folder of Parquet facts with a kind column. A row-local spec appends what
    new files give; any other is run over all facts whenever files arrive, and replaces the sink."""
    stream = spark.readStream.schema(schema).parquet(source)
    of_kind = lambda df: lambda kind: df.where(F.col("kind") == kind)
    if row_local(spec):
        out = spec.compile(of_kind(stream)).writeStream.format("parquet").outputMode("append").option("path", sink)
    else:

        def again(batch: DataFrame, _: int) -> None:
            every = batch.sparkSession.read.schema(schema).parquet(source)
            spec.compile(of_kind(every)).write.mode("overwrite").parquet(sink)

        out = stream.writeStream.foreachBatch(again)
    out = out.option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
