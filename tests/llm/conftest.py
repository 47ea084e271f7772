"""Small awkward tables that every operator must take."""

import pytest

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, `DOC_ID` string, label int"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text[, lang[, source]]) with extra columns, one of which clashes but for its case."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", 0, "x", 1) for r in rows]
        spark.conf.set("spark.sql.caseSensitive", "true")
        try:
            return spark.createDataFrame(full, DDL)
        finally:
            spark.conf.unset("spark.sql.caseSensitive")

    return make
