import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docloom.session import build_session

    home = tmp_path_factory.mktemp("spark")
    session = build_session(
        "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(home), "spark.checkpoint.dir": str(home / "shared")}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def folder():
    if not SMALL.exists():
        pytest.skip("no test tables")
    return str(SMALL)


@pytest.fixture(scope="session")
def duck(folder):
    import duckdb

    connection = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


KINDS = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}


def shown(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


@pytest.fixture(scope="session")
def same_as_sql(spark, folder, duck):
    """Holds a query against its SQL: names, types and rows."""

    def check(query, statement):
        df = query(spark, folder)
        relation = duck.sql(statement)
        columns = sorted(relation.columns)
        assert sorted(df.columns) == columns
        kinds = {c: KINDS.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
        assert dict(df.dtypes) == kinds
        places = [relation.columns.index(c) for c in columns]
        expected = sorted(tuple(shown(r[i]) for i in places) for r in relation.fetchall())
        assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == expected

    return check
