from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from places import SF_DIR  # noqa: E402
from slotledger.schemas import view_schema  # noqa: E402
from slotledger.session import build_session  # noqa: E402
from slotledger.sources.driver_tables import driver_warehouse  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "slotledger-tests",
        master="local[4]",
        conf={
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "10000",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def warehouse(spark):
    return driver_warehouse(spark, SF_DIR)


@pytest.fixture(scope="session")
def frame(spark):
    """Rows of a view given as dicts; columns that are left out are null."""

    def build(view: str, rows: list[dict]):
        schema = view_schema(view)
        filled = [tuple(row.get(f.name) for f in schema.fields) for row in rows]
        return spark.createDataFrame(filled, schema)

    return build


@pytest.fixture(scope="session")
def stored(spark, warehouse, tmp_path_factory):
    """The derived warehouse written out, its histories in day folders."""
    from pyspark.sql import functions as F

    from slotledger.functions.clock import utc_date
    from slotledger.schemas import VIEWS
    from slotledger.sources.warehouse import Warehouse

    root = str(tmp_path_factory.mktemp("warehouse"))
    times = {"jobs": "creation_time", "jobs_timeline": "period_start"}
    for view in VIEWS:
        df = warehouse[view]
        if view in times:
            df = df.withColumn("dt", utc_date(F.col(times[view])))
            df.coalesce(1).write.partitionBy("dt").parquet(f"{root}/{view}")
        else:
            df.coalesce(1).write.parquet(f"{root}/{view}")
    return Warehouse.from_path(spark, root, by_day=tuple(times))
