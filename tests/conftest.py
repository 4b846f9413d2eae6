import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    import os

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    from strandline.session import session

    spark = session("tests", cpus=4, shuffle_partitions=4)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
