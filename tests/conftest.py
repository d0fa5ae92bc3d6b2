import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexspark.session import builder

    session = (
        builder("tests").master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lib(spark):
    from gate.inputs import library

    return library(spark, SF)


@pytest.fixture(scope="session")
def criteria(spark):
    """Builds a corpus from dicts with any of its columns."""
    from lexspark.sources.schema import TESIS

    def build(rows):
        full = [[{"tipo_tesis": "Aislada", "rubro": "", "texto": "", "precedentes": "",
                  "materias": "", "anio": 2000, **r}.get(f) for f in TESIS.names] for r in rows]
        return spark.createDataFrame(full, TESIS)

    return build
