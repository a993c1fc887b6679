import sys
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from changeledger.schema import LEDGER_SCHEMA  # noqa: E402

CATALOG = "target string, script string, kind string, version string, description string, checksum int"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (SparkSession.builder.master("local[4]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.ui.enabled", "false")
               .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
               .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
               .config("spark.driver.memory", "4g")
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def catalog(spark):
    """catalog(('t', 'V', '1.2', 11), ...) with script and description made up."""
    kinds = {"V": "SQL", "U": "UNDO_SQL", "R": "REPEATABLE"}

    def make(*rows):
        return spark.createDataFrame(
            [(t, f"{k}{v if k != 'R' else ''}__{v}.sql", kinds[k], None if k == "R" else v, v, c)
             for t, k, v, c in rows], CATALOG)
    return make


@pytest.fixture
def ledger(spark):
    """ledger(('t', rank, 'SQL', '1.2', 11, True), ...); version 'R:x' is repeatable x."""
    def make(*rows):
        full = []
        for target, rank, kind, version, checksum, success in rows:
            repeatable = version.startswith("R:")
            name = version[2:] if repeatable else version
            prefix = "R__" if repeatable else "U" if kind == "UNDO_SQL" else "V"
            script = f"R__{name}.sql" if repeatable else f"{prefix}{name}__{name}.sql"
            full.append((target, rank, None if repeatable else version, name, kind, script, checksum,
                         "me", datetime(2024, 1, 1, 0, 0, rank % 60), 5, success))
        return spark.createDataFrame(full, LEDGER_SCHEMA)
    return make


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
