import pytest

from holdfast.llm.registry import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def frame(spark):
    """Documents with columns whose names the operators might use themselves."""

    def make(rows, key="bigint"):
        clashing = [(*row, "x", -1, 0.5) for row in rows]
        schema = f"doc_id {key}, text string, words string, n bigint, score double"
        return spark.createDataFrame(clashing, schema).repartition(3)

    return make

