import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import SMALL, duck, session


@pytest.fixture(scope="session")
def spark():
    return session()


@pytest.fixture(scope="session")
def con():
    return duck(SMALL)


@pytest.fixture
def sliced(spark):
    """Slices of a few rows, so that every key of the small tables is a hot key."""
    spark.conf.set("spark.cardwatch.sliceRows", "60")
    yield spark
    spark.conf.unset("spark.cardwatch.sliceRows")
