"""Task, result, shard, report and log files."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T, Window as W
from pyspark.sql.streaming import StreamingQuery

from gradeloom import fixed_values as fv
from gradeloom.operators.panel import opaque_node
from gradeloom.schemas import PANEL_SHARD, PANEL_TASK, RESULT, TASK


class TaskFileError(ValueError):
    """A task file broke the schema."""


def check_tasks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, violations) of a JSON-lines file: bad JSON, missing field, repeated id. Blank lines are skipped.

    The first line of a repeated id is the task. Repeats are found by a partial
    aggregation over (id, line), so a heavily repeated id stays cheap.
    """
    raw = spark.read.text(path).withColumn("line_id", F.monotonically_increasing_id()).filter(F.length(F.trim("value")) > 0)
    schema = T.StructType(TASK.fields + [T.StructField("_bad", T.StringType())])
    rows = raw.select("line_id", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}).alias("t"))
    missing = F.array_compact(F.array(*[F.when(F.length(F.coalesce(f"t.{f}", F.lit(""))) == 0, F.lit(f)) for f in fv.REQUIRED_FIELDS]))
    problem = (F.when(F.col("t").isNull() | F.col("t._bad").isNotNull(), "invalid JSON")
               .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ","))))
    flagged = rows.withColumn("problem", problem)
    firsts = flagged.filter("problem IS NULL").groupBy(F.col("t.task_id").alias("_id")).agg(F.min("line_id").alias("line_id")).select(
        "line_id", F.lit(True).alias("_first"))
    judged = flagged.join(firsts, "line_id", "left").withColumn("problem", F.when(
        F.col("problem").isNull() & F.col("_first").isNull(), F.concat(F.lit("duplicate task_id "), F.col("t.task_id"))).otherwise(F.col("problem")))
    good = judged.filter("problem IS NULL").select("line_id", "t.*").drop("_bad")
    defaults = {"project": "unknown", "category": "unclassified", "derived_from": "edit-pair", "goal_source": "user"}
    good = good.fillna({**{f: "" for f in ("file_name", "category_reason", "classifier", "source_session", "source_title", "original_goal")},
                        **defaults, "category_confidence": 0.0, "goal_relevance": 0.0, "is_test_file": False, "goal_had_alternatives": False})
    good = good.withColumn("oracle", F.coalesce("oracle", F.struct(F.lit("none").alias("kind"))))
    return good.withColumnRenamed("line_id", "ingest_seq"), judged.filter("problem IS NOT NULL").select("line_id", "problem")


def load_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a file that must be clean; the first violation raises."""
    tasks, violations = check_tasks(spark, path)
    first = violations.limit(1).collect()
    if first:
        raise TaskFileError(f"{path}: {first[0]['problem']}")
    return tasks


def save_tasks(tasks: DataFrame, path: str) -> None:
    tasks.write.mode("overwrite").json(path)


def arrival() -> Column:
    """Sort key of a row read from files: when its file was written, the file, the block in it, the row in the block.

    Splits are packed into tasks by size, so the row id alone says nothing
    about files; within one block it rises with the rows.
    """
    m = F.col("_metadata")
    return F.struct(m["file_modification_time"].alias("written"), m["file_path"].alias("file"), m["file_block_start"].alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Result rows; blank and malformed lines drop. `ingest_seq` is the sortable arrival of a row: newer files after older ones."""
    return spark.read.schema(RESULT).option("mode", "DROPMALFORMED").json(path).withColumn("ingest_seq", arrival())


def append_results(rows: DataFrame, path: str) -> None:
    """Append rows, one folder per model."""
    rows.write.mode("append").partitionBy("model").json(path)


def append_stream(rows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream of rows, one folder per model, each row once: the sink's log names the files of finished batches.

    `checkpoint` is a folder that driver and executors share; a query that is started again with it goes on after its
    last finished batch. Read `path` as a whole (`load_results`), so that the log decides which files count.
    """
    return (rows.writeStream.format("json").partitionBy("model").outputMode("append").option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "30 seconds"})).start(path))


def load_shards(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """JSON shards in one read, each an array of tasks or an object with `tasks`; absent shards are skipped."""
    found = [p for p in paths if _exists(spark, p)]
    if not found:
        return spark.createDataFrame([], PANEL_TASK)
    rows = spark.read.schema(PANEL_SHARD).option("multiLine", True).json(found)
    alone = F.array(F.struct(*[f.name for f in PANEL_TASK]))
    return rows.select(F.explode(F.coalesce("tasks", alone)).alias("t")).select("t.*")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return found is not None and len(found) > 0


def scan_text(spark: SparkSession, root: str, skip: Iterable[str] = fv.SWEEP_SKIP_SUFFIXES) -> DataFrame:
    """Every line of every text file below `root`: path, n (from 1), line. Lines end in "\\n"; an empty file has none.

    A large file is read in splits. A line's number is its place in its split and the lines of the splits before:
    a prefix scan over one row per split. As many splits as the scan has tasks reach all executors.
    """
    m = F.col("_metadata")
    rows = spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(root).select(
        m["file_path"].alias("path"), m["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    splits = rows.groupBy("path", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("at").alias("first"))
    earlier = F.sum("lines").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    starts = F.broadcast(splits.select("path", "block", (F.coalesce(earlier, F.lit(0)) + 1 - F.col("first")).alias("start")))
    keep = F.lit(True)
    for suffix in skip:
        keep = keep & ~F.col("path").endswith(suffix)
    return rows.join(starts, ["path", "block"]).filter(keep).select("path", (F.col("start") + F.col("at")).alias("n"), "line")


_CHILD = T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_message", T.StringType()), T.StructField("_type", T.StringType())])
_CASE = T.StructType([T.StructField("_classname", T.StringType()), T.StructField("_name", T.StringType()),
                      *[T.StructField(c, _CHILD) for c in ("failure", "error", "skipped")]])


def junit_rows(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Test outcomes of JUnit reports: report, nodeid, outcome, exc_type.

    `expected` (report, test_path): a report that is missing or holds no case
    becomes one error row, never a pass.
    """
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(_CASE).load(path)
    parts = F.filter(F.split(F.coalesce("_classname", F.lit("")), r"\."), lambda p: (p != "") & (p != "rootdir"))
    file = F.when(F.size(parts) == 0, "<unknown>").otherwise(F.concat(F.array_join(parts, "/"), F.lit(".py")))
    outcome = (F.when(F.col("failure").isNotNull(), "failed").when(F.col("error").isNotNull(), "error")
               .when(F.col("skipped").isNotNull(), "skipped").otherwise("passed"))
    rows = cases.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("report"),
                        F.concat(file, F.lit("::"), "_name").alias("nodeid"), outcome.alias("outcome"))
    rows = rows.withColumn("exc_type", _coarse(F.col("outcome")))
    if expected is None:
        return rows
    silent = expected.join(rows.select("report").distinct(), "report", "left_anti").select(
        "report", F.col("test_path").alias("nodeid"), F.lit("error").alias("outcome"), F.lit("Error").alias("exc_type"))
    return rows.unionByName(silent)


def _coarse(outcome):
    return F.when(outcome == "failed", "Failure").when(outcome == "error", "Error")


def tap_rows(spark: SparkSession, path: str, expected: DataFrame | None = None) -> DataFrame:
    """Test outcomes of TAP output with opaque node ids: report, nodeid, outcome, exc_type."""
    lines = spark.read.text(path).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("report"), F.trim("value").alias("line"))
    failed = F.regexp_extract("line", r"^not ok \d+ - (.*)$", 1)
    passed = F.when(F.instr("line", " - ") > 0, F.regexp_extract("line", r"^ok .*? - (.*)$", 1)).otherwise(F.col("line"))
    is_failed = F.col("line").rlike(r"^not ok \d+ - ")
    rows = lines.filter(F.col("line").startswith("ok ") | is_failed).select(
        "report", opaque_node(F.when(is_failed, F.trim(failed)).otherwise(passed)).alias("nodeid"),
        F.when(is_failed, "failed").otherwise("passed").alias("outcome")).withColumn("exc_type", _coarse(F.col("outcome")))
    if expected is None:
        return rows
    silent = expected.join(rows.select("report").distinct(), "report", "left_anti").select(
        "report", opaque_node(F.col("test_path")).alias("nodeid"), F.lit("error").alias("outcome"), F.lit("Error").alias("exc_type"))
    return rows.unionByName(silent)


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """`sha<TAB>subject` lines; lines without a tab drop, later tabs belong to the subject."""
    lines = spark.read.text(path).filter(F.instr("value", "\t") > 0)
    parts = F.split("value", "\t", 2)
    return lines.select(parts[0].alias("sha"), F.trim(parts[1]).alias("subject"))


def commit_files(spark: SparkSession, path: str) -> DataFrame:
    """`sha<TAB>path` lines, one changed file each."""
    return commit_log(spark, path).select("sha", F.col("subject").alias("path")).filter(F.length("path") > 0)
