"""Comparison of a query's rows with those of its SQL."""

import datetime
import math


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(connection, sql):
    found = connection.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
