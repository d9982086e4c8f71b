"""Row comparison shared by the tests."""

import math


def cell(value, digits=9):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, digits) + 0.0 if math.isfinite(value) else value
    return value


def rows(df, digits=9):
    names = sorted(df.columns)
    return sorted(([cell(r[n], digits) for n in names] for r in df.collect()), key=repr)


def same(left, right, digits=9):
    assert sorted(left.columns) == sorted(right.columns)
    a, b = rows(left, digits), rows(right, digits)
    assert len(a) == len(b)
    wrong = [(x, y) for x, y in zip(a, b) if not close(x, y)]
    assert not wrong, wrong[:3]


def close(x, y, tolerance=1e-9):
    return all(
        p == q or (isinstance(p, float) and isinstance(q, float) and math.isfinite(p) and math.isfinite(q)
                   and abs(p - q) <= tolerance * max(1.0, abs(p)))
        for p, q in zip(x, y))


def table(spark, schema, data):
    return spark.createDataFrame(data, schema)


def series(spark, values, unit=1, schema="double"):
    """One unit with consecutive readings; None is a gap."""
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 1)
    data = [(i, unit, start + timedelta(minutes=15 * i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"reading_id long, unit_id long, ts timestamp_ntz, x {schema}")


def column(df, name, order="reading_id"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]
