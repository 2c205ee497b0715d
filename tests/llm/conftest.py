import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(texts, extra=None):
        rows = [(i, t, "en", "s", None if t is None else len(t)) if not isinstance(t, tuple) else (*t, "en", "s", 0) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)

    return make


#: Columns whose names the operators use inside or return.
CLASH = ["id", "row", "h", "block", "pos", "key", "n", "n_lines", "lang_pred", "score", "component", "text_h", "shard", "slot", "lost", "parts"]


@pytest.fixture(scope="session")
def clashing():
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({c: F.lit("x") for c in CLASH})
