from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, digest string, key string, fp string, score double, _unit string, _verdict string"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty, long and repeated texts, ties and clashing extra columns."""
    word = "alpha beta gamma delta epsilon zeta eta theta iota kappa "
    texts = [None, "", " \n\t ", word * 8, word * 8, "one", word * 3000, "ünï çödé 中文 \x0b x", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + word * 8]
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t else None) for i, t in enumerate(texts)]
    rows += [(None, word * 8, None, None, None), (None, None, None, None, None), rows[3], rows[3]]
    return spark.createDataFrame([(*r, 7, "d", "k", "f", 0.5, "u", "v") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
