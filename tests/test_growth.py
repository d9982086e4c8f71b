"""Work that must grow with the rows, not with their square."""

import pytest
from pyspark.sql import functions as F

from plantpulse.operators.order import SeriesSpec, lay_out, next_seen
from tests.helpers import column, series


@pytest.mark.parametrize("most", [None, 5])
def test_next_value_needs_no_frame_read_anew_for_each_row(spark, most):
    """A frame from the row to the end of a long series costs its square (cooldown over a million alerts of a type)."""
    values = [None, 1.0, None, None, 4.0, None, 2.0, None, None, None, None, 7.0, None]
    spec = SeriesSpec(max_rows=most)
    out = next_seen(lay_out(series(spark, values), spec), {"y": F.col("x")}).frame()
    assert column(out, "y") == [1.0, 1.0, 4.0, 4.0, 4.0, 2.0, 2.0, 7.0, 7.0, 7.0, 7.0, 7.0, None]
    windows = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line]
    # between blocks, one row a block is left
    assert windows and not any("currentrow$(), unboundedfollowing$()" in line for line in windows)
