"""Regular expressions, judged by the engine that runs them."""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException


def usable_pattern(pattern: str) -> str | None:
    """The pattern as Spark takes it, or None if it is no valid one.

    Named groups may be written ``(?P<name>...)``.  Spark matches by Java's engine, so Java's compiler decides,
    once, on the driver.
    """
    java = re.sub(r"(?<!\\)((?:\\\\)*)\(\?P<", r"\1(?<", pattern)
    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("a pattern needs an active Spark session")
    try:
        context._jvm.java.util.regex.Pattern.compile(java)
    except IllegalArgumentException:  # what Java's error of a bad pattern is
        return None
    return java
