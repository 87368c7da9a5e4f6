"""The page pipeline on files as they arrive, and the admission of a bounded queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PipelineConfig
from ..plans import pages as plan
from ..sources import formats


def parse_stream(spark: SparkSession, folder: str, label_dim: DataFrame, out: str, checkpoint: str, backend, config: PipelineConfig = PipelineConfig(), files_per_batch: int = 64):
    """A started query that parses image files landing in ``folder`` and writes results to ``out`` (Parquet).
    Each file is one page, so no state is kept; a batch holds at most ``files_per_batch`` files."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", formats.IMAGE_FILES).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def each(batch: DataFrame, epoch: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # at most files_per_batch
        if paths:
            pictures = spark.read.format("image").load(paths).select(F.xxhash64("image.origin").alias("page_id"), F.element_at(F.split("image.origin", "/"), -1).alias("filename"), "image")
            plan.parse_images(pictures, label_dim, backend, config).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return files.select("path").writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admissions(arrivals: DataFrame, depth: int, service: float, key: str = "server") -> DataFrame:
    """key, seq, at, admitted: whether each arrival (key, seq, at in seconds) finds room in its server's queue, which holds
    ``depth`` waiting jobs (at least one) beside the one in service; a job takes ``service`` seconds, first come, first
    served. The state is the finish times of the jobs in the system, at most depth + 1."""
    room = max(depth, 1) + 1

    def run(batches):  # a server's arrivals come in order; only its jobs in the system are kept
        import pyarrow as pa

        now, busy = None, []
        for b in batches:
            ok = []
            for k, at in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != now:
                    now, busy = k, []
                busy = [t for t in busy if t > at]
                ok.append(len(busy) < room)
                if ok[-1]:
                    busy.append((busy[-1] if busy else at) + service)
            yield pa.record_batch([*b.columns, pa.array(ok, pa.bool_())], names=[*b.schema.names, "admitted"])

    rows = arrivals.select(key, F.col("seq").cast("long").alias("seq"), F.col("at").cast("double").alias("at"))
    kind = rows.schema[key].dataType.simpleString()
    return rows.repartition(key).sortWithinPartitions(key, "at", "seq").mapInArrow(run, f"{key} {kind}, seq long, at double, admitted boolean")
