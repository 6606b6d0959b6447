"""Session settings that the operators expect."""

from pyspark.sql import SparkSession


def session(app: str = "colloquy", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` overrides or adds settings."""
    builder = SparkSession.builder.appName(app)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return builder.config(map=settings | conf).getOrCreate()
