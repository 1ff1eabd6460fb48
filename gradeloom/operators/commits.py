"""Commit triage and path conventions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom import fixed_values as fv


def is_test_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/")).rlike(fv.COMMIT_TEST_PATH)


def fix_commits(commits: DataFrame) -> DataFrame:
    """Commits whose subject declares a fix."""
    return commits.filter(F.trim("subject").rlike(fv.FIX_SUBJECT))


def triage(commits: DataFrame, files: DataFrame, repo: str) -> DataFrame:
    """Per fix commit: source and test file counts, task id, reject reason ('' = usable).

    `files` (sha, path) stays one row per file; a commit that touches a million
    files is two counters.
    """
    source = ~is_test_path(F.col("path")) & F.col("path").rlike(fv.COMMIT_SOURCE_SUFFIX)
    counts = files.groupBy("sha").agg(F.count_if(source).alias("source_files"), F.count_if(is_test_path(F.col("path"))).alias("test_files"))
    joined = fix_commits(commits).join(counts, "sha", "left").fillna(0, ["source_files", "test_files"])
    reason = (F.when(F.col("source_files") < 1, fv.COMMIT_NO_SOURCE).when(F.col("test_files") < 1, fv.COMMIT_NO_TEST).otherwise(""))
    return joined.withColumn("reject_reason", reason).withColumn(
        "task_id", F.concat(F.lit(repo.replace("/", "_") + "__"), F.substring(F.col("sha").cast("string"), 1, 10)))


def commit_files(commits: DataFrame, files: DataFrame) -> DataFrame:
    """Files of fix commits with their role: source, test or other."""
    role = F.when(is_test_path(F.col("path")), "test").when(F.col("path").rlike(fv.COMMIT_SOURCE_SUFFIX), "source").otherwise("other")
    return files.join(fix_commits(commits).select("sha"), "sha", "left_semi").withColumn("role", role)


def conventional_tests(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, test_path) for the nine places a Python module's test may live. Test files have none."""
    p = F.col(path)
    name = F.element_at(F.split(p, "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    folder = F.regexp_replace(p, r"[^/]*$", "")
    at = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    places = F.array_distinct(F.array(
        at(folder, "test_", stem, ".py"), at(folder, stem, "_test.py"), at(folder, "test", stem, ".py"),
        at(folder, "tests/test_", stem, ".py"), at(folder, "tests/", stem, "_test.py"),
        at("tests/test_", stem, ".py"), at("tests/", stem, "_test.py"), at("test/test_", stem, ".py"), at("test/", stem, "_test.py")))
    return paths.filter(~name.startswith("test_")).select(path, F.explode(places).alias("test_path"))


def source_test_pairs(paths: DataFrame, path: str = "path") -> DataFrame:
    """Conventional pairs whose test file exists among the paths."""
    known = paths.select(F.col(path).alias("test_path")).distinct()
    return conventional_tests(paths.select(path).distinct(), path).join(known, "test_path", "left_semi").select(path, "test_path")
