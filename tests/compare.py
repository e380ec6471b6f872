"""Order-free comparison of a Spark result with DuckDB's."""

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def open_duck(sf_dir):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return duck


def normal(table):
    """Columns by name, rows as sorted text."""
    table = table.select(sorted(table.column_names))
    columns = [c.to_pylist() for c in table.columns]
    return table.column_names, sorted(tuple(map(str, row)) for row in zip(*columns, strict=True))
