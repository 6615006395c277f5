import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reclattice.session import local_session

# (user, item, rating, timestamp); users 5 and 6 do not survive loading.
GOLDEN = [
    (1, 10, 5.0, 1), (1, 11, 4.0, 2), (1, 12, 5.0, 3), (1, 13, 4.0, 4), (1, 14, 5.0, 5),
    (2, 10, 4.0, 1), (2, 11, 5.0, 2), (2, 14, 4.0, 3),
    (3, 11, 4.0, 1), (3, 12, 4.0, 2), (3, 13, 5.0, 3), (3, 10, 5.0, 4),
    (4, 14, 4.0, 1), (4, 10, 5.0, 2),
    (5, 12, 5.0, 7), (5, 10, 3.0, 8),
    (6, 13, 2.0, 1), (6, 14, 3.0, 2),
]
SCHEMA = "user long, item long, rating double, timestamp long"


@pytest.fixture(scope="session")
def spark():
    session = local_session("4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def golden(spark):
    from reclattice.operators.split import chronological_split
    from reclattice.sources.loaders import clean_interactions

    return chronological_split(clean_interactions(spark.createDataFrame(GOLDEN, SCHEMA), 3.5), 0.3)


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())
