import pytest
from pyspark.sql import functions as F


@pytest.fixture
def clash():
    """Adds columns whose names the operators use themselves."""

    def add(df, *names):
        return df.withColumns({n: F.lit("own") for n in names})

    return add
