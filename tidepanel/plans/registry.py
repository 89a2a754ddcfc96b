"""Registered queries: name -> (Spark builder, output columns, DuckDB statement)."""

import re

QUERIES = {}
STATEMENTS = {}
# Doubles are cut at a fixed digit. Two engines break exact decimal ties differently, so the cut point is moved off them.
_SHIFT = 0.3717
_FIELD = re.compile(r"^(\w+):([sdtibf])(\d*)$")


def _fields(cols):
    for item in cols.split():
        name, kind, digits = _FIELD.match(item).groups()
        yield name, kind, int(digits or 6)


def spark_output(df, cols):
    """Cast to portable types: text, ISO dates, 64-bit integers and doubles cut at a fixed digit."""
    out = []
    for name, kind, digits in _fields(cols):
        c = f"`{name}`"
        if kind == "s":
            c = f"CAST({c} AS STRING)"
        elif kind == "d":
            c = f"date_format({c}, 'yyyy-MM-dd')"
        elif kind == "t":
            c = f"date_format({c}, 'yyyy-MM-dd HH:mm:ss.SSSSSS')"
        elif kind == "i":
            c = f"CAST({c} AS BIGINT)"
        elif kind == "b":
            c = f"CAST({c} AS BOOLEAN)"
        else:
            v = f"CAST({c} AS DOUBLE)"
            # adding zero turns a negative zero into a plain one
            cut = f"floor({v} * 1e{digits}D + {_SHIFT}D) / 1e{digits}D + 0D"
            c = f"CASE WHEN abs({v}) < 1e12D THEN {cut} WHEN NOT isnan({v}) THEN {v} END"
        out.append(f"{c} AS `{name}`")
    return df.selectExpr(*out)


def duck_output(sql, cols):
    out = []
    for name, kind, digits in _fields(cols):
        if kind == "s":
            c = f'CAST("{name}" AS VARCHAR)'
        elif kind == "d":
            c = f"strftime(\"{name}\", '%Y-%m-%d')"
        elif kind == "t":
            c = f"strftime(\"{name}\", '%Y-%m-%d %H:%M:%S.%f')"
        elif kind == "i":
            c = f'CAST("{name}" AS BIGINT)'
        elif kind == "b":
            c = f'CAST("{name}" AS BOOLEAN)'
        else:
            v = f'CAST("{name}" AS DOUBLE)'
            cut = f"floor({v} * 1e{digits}::DOUBLE + {_SHIFT}::DOUBLE) / 1e{digits}::DOUBLE"
            c = f"CASE WHEN abs({v}) < 1e12::DOUBLE THEN CASE WHEN {cut} = 0 THEN 0::DOUBLE ELSE {cut} END WHEN NOT isnan({v}) THEN {v} END"
        out.append(f'{c} AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({sql}) AS answer"


def query(name, cols, sql=None, sql_cols=None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with its output columns, and those of the statement if they differ."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: spark_output(fn(spark, sf_dir), cols)
        if sql is not None:
            STATEMENTS[name] = duck_output(sql, sql_cols or cols)
        return fn

    return wrap
