"""What a plan shows of its scans."""

from pyspark.sql import DataFrame


def formatted(df: DataFrame) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def pushed_filters(df: DataFrame) -> str:
    """The filters that the scans of a plan evaluate themselves."""
    return "\n".join(line for line in formatted(df).splitlines() if "PushedFilters" in line)
