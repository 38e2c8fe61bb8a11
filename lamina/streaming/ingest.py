"""Streams into and out of tables of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lamina.session import Engine


def stream_into(engine: Engine, name: str, rows: DataFrame, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch of a streaming DataFrame becomes a part. A batch that is retried is published once, after a
    compaction too: parts carry the numbers of their batches and the checkpoint's name."""

    def publish(batch: DataFrame, number: int) -> None:
        engine.table(name).insert(batch, batch=f"{checkpoint}#{number}")

    return rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_from(engine: Engine, name: str, resumed: bool = False) -> DataFrame:
    """A streaming DataFrame of the table's rows, those of parts published later too, each row once.

    Only inserts are read, not what compactions made of them. Once vacuum() has deleted an insert's part, a new stream
    would miss its rows: that is an error, unless the stream is `resumed` from a checkpoint that has read them.
    """
    table = engine.table(name)
    parts = table._all()
    missing = {r for p in parts for r in p.replaces} - {p.id for p in parts}
    if (missing or any(p.lost for p in parts)) and not resumed:
        raise ValueError(f"parts of {name} were compacted and deleted; a new stream would miss their rows")
    return engine.spark.readStream.schema(table.schema.spark).parquet(table.files.where(f"{name}/part_*"))
