"""Known rows beside a catalog."""

import pytest

from evidentia.operators import recon as K


def test_rows_that_share_a_key(spark):
    catalog = spark.createDataFrame([("a", 1), ("b", 2)], "url string, page_id long")
    known = spark.createDataFrame([("b", 3), ("c", 6), ("c", 9)], "url string, page_id long")
    got = sorted(tuple(r) for r in K.supplement(catalog, known, "url", "page_id").collect())
    assert got == [("a", 1), ("b", 2), ("c", 6), ("c", 9)]
    for row in (None, "page_id"):
        with pytest.raises(ValueError):
            K.supplement(catalog, known.union(known), "url", row)
