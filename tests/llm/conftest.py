from __future__ import annotations

import pytest


@pytest.fixture(scope="module", autouse=True)
def nothing_stays_cached(spark):
    """Tables cached here would show up in the plans that later modules look at."""
    yield
    spark.catalog.clearCache()
