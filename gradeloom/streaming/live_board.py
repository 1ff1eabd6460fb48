"""A board kept current by a stream of result rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gradeloom.operators.boards import board_of_marks, decision_marks, latest_per_task
from gradeloom.schemas import RESULT


class LiveBoard:
    """Latest row per (model, task) under a shared folder.

    Each micro-batch writes only its own reduced rows, under its batch id, so a
    repeated batch overwrites itself. Readers merge the newest base with the
    later batches; `compact` folds batches into a new base, so neither writes
    nor reads grow with the history.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        """The foreachBatch function. Rows without `ingest_seq` arrive in the order of batches, then as their files say."""
        latest_per_task(self._in_order(rows, batch_id)).drop("first_seen").write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch_id}")

    def _in_order(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The batch's rows with their `ingest_seq`."""
        if "ingest_seq" not in rows.columns:
            row = F.struct("arrival.*", F.monotonically_increasing_id().alias("row")) if "arrival" in rows.columns else F.struct(F.monotonically_increasing_id().alias("row"))
            rows = rows.withColumn("ingest_seq", F.struct(F.lit(batch_id).cast("bigint").alias("batch"), row.alias("place"))).drop("arrival")
        return rows.drop("arrival")

    def start(self, rows: DataFrame, checkpoint: str, **trigger):
        return (rows.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint)
                .trigger(**(trigger or {"processingTime": "30 seconds"})).start())

    def _read(self, kind: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{kind}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return None

    def _base(self) -> tuple[DataFrame | None, int]:
        base = self._read("base")
        if base is None:
            return None, -1
        newest = base.agg(F.max("upto").alias("u")).first()["u"]
        return base.filter(F.col("upto") == newest).drop("upto"), int(newest)

    def rows(self) -> DataFrame:
        """Latest row per (model, task) over everything received."""
        base, upto = self._base()
        deltas = self._read("deltas")
        recent = None if deltas is None else deltas.filter(F.col("batch") > upto).drop("batch")
        both = [d for d in (base, recent) if d is not None]
        if not both:
            raise ValueError(f"nothing received under {self.path}")
        merged = both[0] if len(both) == 1 else both[0].unionByName(both[1], allowMissingColumns=True)
        return latest_per_task(merged)

    def _for_base(self, rows: DataFrame) -> DataFrame:
        return rows.drop("first_seen")

    def compact(self) -> int:
        """Write a new base that covers all batches so far; returns the newest covered batch."""
        deltas = self._read("deltas")
        newest = int(deltas.agg(F.max("batch").alias("b")).first()["b"])
        self._for_base(self.rows()).write.mode("overwrite").parquet(f"{self.path}/base/upto={newest}")
        return newest


class LiveDecisionBoard(LiveBoard):
    """The decision board, kept current by a stream of result rows.

    The state is one mark per (model, task) without texts: a batch compares
    only its own newest answers with the task texts. A newer row of a task replaces
    the older mark, so what the older one gave to its model is taken back, and
    a quarantined row hides the older trusted one. After each batch the
    models that it names are counted again from their marks and written under
    the batch's id; a model's current line is the one of its latest batch.
    Other models are not touched, and a repeated batch overwrites itself.
    """

    def __init__(self, spark: SparkSession, path: str, tasks: DataFrame, lanes: DataFrame, panel: int = 20, min_coverage: int | None = None):
        super().__init__(spark, path)
        self.tasks, self.lanes, self.panel, self.min_coverage = tasks, lanes, panel, min_coverage

    def write_batch(self, rows: DataFrame, batch_id: int) -> None:
        delta = f"{self.path}/deltas/batch={batch_id}"
        decision_marks(self._in_order(rows, batch_id), self.tasks, self.lanes, self._keep).write.mode("overwrite").parquet(delta)
        named = self.spark.read.parquet(delta).select("model").distinct()
        # a model that has no trusted row left gets an empty line
        lines = named.join(self._count(self.rows().join(named, "model", "left_semi")), "model", "left")
        lines.write.mode("overwrite").parquet(f"{self.path}/boards/batch={batch_id}")

    def _keep(self, step: DataFrame, name: str) -> DataFrame:
        """The rows of a batch's step, stored until the next batch."""
        path = f"{self.path}/steps/{name}"
        step.write.mode("overwrite").parquet(path)
        return step.sparkSession.read.parquet(path)

    def _for_base(self, rows: DataFrame) -> DataFrame:
        return rows

    def _count(self, marks: DataFrame) -> DataFrame:
        return board_of_marks(marks.filter("taint IS NULL"), self.panel, self.min_coverage, show_exhausted=True)

    def recount(self) -> DataFrame:
        """All models' lines from the marks."""
        return self._count(self.rows())

    def board(self, show_exhausted: bool = False) -> DataFrame:
        """Each model's current line, best first."""
        lines = self.spark.read.parquet(f"{self.path}/boards")
        rest = [c for c in lines.columns if c not in ("model", "batch")]
        current = lines.groupBy("model").agg(F.max_by(F.struct(*rest), "batch").alias("line")).select("model", "line.*")
        shown = current.filter("status IS NOT NULL" if show_exhausted else "status <> 'unavailable'")
        return shown.orderBy(F.desc("ranking_eligible"), F.desc("utility"), F.desc_nulls_last("capability"), "model")


def result_stream(spark: SparkSession, path: str, numbered: bool = False, **options) -> DataFrame:
    """Appended result files as a stream. Rows carry their own `ingest_seq` (`numbered`), or `arrival` says which file and block they come from."""
    reader = spark.readStream.options(**options)
    if numbered:
        return reader.schema(StructType([*RESULT.fields, StructField("ingest_seq", LongType())])).json(path)
    m = F.col("_metadata")
    place = F.struct(m["file_modification_time"].alias("written"), m["file_path"].alias("file"), m["file_block_start"].alias("block"))
    return reader.schema(RESULT).json(path).withColumn("arrival", place)
