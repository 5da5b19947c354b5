import pytest

from tests.conftest import spark  # noqa: F401

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):  # noqa: F811
    """Documents from (doc_id, text[, lang]) rows, with columns whose names clash with the operators' own."""
    from sitesift.llm.common import ready

    def docs(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", None if r[1] is None else len(r[1])) for r in rows]
        return ready(spark).createDataFrame(full, DDL).selectExpr("*", "1 as id", "'x' as fp", "2 as rid", "'y' as hash", "3 as spans", "4 as n_words", "true as template", "0 as part").repartition(parts)
    return docs
