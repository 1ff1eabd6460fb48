"""Folders for data that a query writes before a source reads it back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from gradeloom.session import checkpoint_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
