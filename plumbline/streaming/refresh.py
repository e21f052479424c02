"""Incremental refresh of derived tables: by polling fingerprints, or as a stream over a landing folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.sources.catalog import SourceCatalog, unpivot_text
from plumbline.sources.sinks import RECEIPT, Store, dirty

VERSION = "lex1"


def refresh(cat: SourceCatalog, store: Store, force: bool = False) -> list[tuple[str, str]]:
    """Re-derive the lexical values of tables that changed since their receipt; returns (table, change).

    Each table is a partition: what changed, was dropped or became empty is replaced or removed, and the rest stays as
    it is. Receipts are written last, so a refresh that was broken off is done again.
    """
    receipts = store.read("receipts", RECEIPT)
    now = cat.fingerprints()
    changes = dirty(now, receipts.limit(0) if force else receipts, VERSION)
    todo = [(r.artifact, r.change) for r in changes.collect()]  # a row a table
    live = [t for t, c in todo if c != "dropped" and cat.text_columns(t)]
    if live:
        store.replace_partitions(cat.lexical_values(live), "lex_values", live)
    # a table that is gone, or has no text column any more, loses its partition and no other
    store.drop_partitions("lex_values", [t for t, c in todo if t not in live])
    if todo:
        store.overwrite(now.withColumn("version", F.lit(VERSION)), "receipts")
    return todo


def stream_lexical_values(cat: SourceCatalog, table: str, landing: str, store: Store, checkpoint: str) -> StreamingQuery:
    """Files that arrive under landing are unpivoted and appended, each once; runs until all that is there is done."""
    t = cat.tables[table]
    schema = cat.frame(table).schema
    cols = cat.text_columns(table)
    rows = cat.spark.readStream.schema(schema).parquet(landing).withColumn("__rowid", F.expr(t.rowid).cast("long"))

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that is run again overwrites its own folder
        unpivot_text(batch, table, "__rowid", cols).write.mode("overwrite").parquet(f"{store.path('lex_stream')}/src_table={table}/epoch={epoch}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
