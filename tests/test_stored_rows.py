"""The rows of the fit and of the permutations are made once."""

import small_tables

from tidepanel.plans import catalog


def test_permutations_read_stored_rows(spark, tmp_path):
    out = catalog.QUERIES["permutation_importance"](spark, small_tables.write(spark, tmp_path))
    assert "l_extendedprice" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(r.feature for r in out.collect()) == ["f_std", "f_vol", "score"]
