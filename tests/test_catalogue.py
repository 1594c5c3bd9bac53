"""Every registered core query with SQL gives the same rows as DuckDB; the others give rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    """Equal rows in any order. Of the values of a rounded float column one in 10,000 may be off by one in the last place: sums taken
    in another order may fall on the other side of a tie."""
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols and len(want) == len(got)
    floats = [c for c in cols if got[c].dtype.kind == "f"]
    order = [c for c in cols if c not in floats] + floats
    a, b = (x[cols].sort_values(order, kind="stable").reset_index(drop=True) for x in (got, want))
    if a.astype(str).equals(b.astype(str)):
        return
    for c in cols:
        if c not in floats:
            assert a[c].astype(str).equals(b[c].astype(str)), c
            continue
        x, y = a[c].to_numpy(float), b[c].to_numpy(float)
        assert (np.isnan(x) == np.isnan(y)).all(), c
        places = max((len(str(v).partition(".")[2]) for v in x[np.isfinite(x)][:1000] if "e" not in str(v)), default=0)
        off = ~(np.isnan(x) | (x == y))
        assert off.sum() <= max(1, len(x) // 10_000) and (abs(x[off] - y[off]) < 1.5 * 10.0**-places).all(), (c, x[off][:5], y[off][:5])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(name, spark, duck):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got)
        return
    assert_same(got, duck.execute(catalogue.ORACLE_SQL[name]).df())


def test_no_window_over_everything(spark):
    """Scans over a whole table or a hot key are plans without a single partition."""
    for name in ("image_layout", "pulse_order", "cumulative_axis"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan, name


def test_frame_queries_take_the_whole_frame(spark):
    """Not looks of 64 lines: the turned frame has 64 lines, each as long as the frame is high."""
    top = catalogue.QUERIES["corner_turn"](spark, SF).agg(F.max("row"), F.max("col"), F.count("*")).first()
    assert tuple(top) == (63, 249, 250 * 64)
    for name in ("fft2_float", "quicklook"):
        assert catalogue.QUERIES[name](spark, SF).agg(F.max("row"), F.count("*")).first() == (249, 250 * 64), name
