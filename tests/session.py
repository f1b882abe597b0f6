from __future__ import annotations

import os

from pyspark.sql import SparkSession


def make_session(cpus: str = "8", **conf: str) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("incident-analytics")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", os.environ.get("TEST_DRIVER_MEMORY", "8g"))
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
