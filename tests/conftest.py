import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    s = (SparkSession.builder.master("local[8]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def make_spectra(spark, rows, columns=()):
    """rows: (id, [(mz, intensity), ...], *extra) -> DataFrame id, pos, peaks, extras."""
    from peakloom.schema import PEAKS_DDL
    extra = ", ".join(columns)
    data = [(r[0], i, [tuple(map(float, p)) for p in r[1]], *r[2:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"id string, pos long, peaks {PEAKS_DDL}" + (", " + extra if extra else ""))
