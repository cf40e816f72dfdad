"""Session builder with the settings the engine is tuned for."""

from __future__ import annotations

import functools
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once an application, so their Python can import it wherever the driver started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def with_package(fn: Callable) -> Callable:
    """`fn(spark, ...)` with the package sent first."""

    @functools.wraps(fn)
    def call(spark, *args, **kwargs):
        ship_package(spark)
        return fn(spark, *args, **kwargs)

    return call


def get_session(app: str = "beatlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC timestamps, AQE with skew handling, and Arrow transfer; `conf` overrides any of it."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
