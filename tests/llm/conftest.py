import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def documents(spark):
    """documents from (doc_id, text) rows, with clashing extra columns."""

    def make(rows, lang="en", source="s"):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string").repartition(3)
        extras = {c: F.lit("x") for c in ("spans", "kept", "score", "anchors", "class_id", "size", "_key", "lang_pred")}
        return df.withColumns({"lang": F.lit(lang), "source": F.lit(source), "n_chars": F.length("text").cast("long"), **extras})

    return make
