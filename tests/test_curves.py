import duckdb
import pandas as pd
import pytest

from lumivox.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("amounts", [
    [8495.0, 2985.0, 9325.0, -6295.0, 7975.0, 1125.0, 1375.0, 1005.0, 1015.0, 9995.0, 999995.0],
    [0.0, -0.0, 0.004, 0.005, -0.005, 0.994, 0.995, 1.005, -1.005, 999.994, 999.995, -999.995, None, float("inf"), float("-inf")],
])
def test_amounts_halfway_are_rounded_as_in_sql(spark, tmp_path, same_rows, amounts):
    customer = pd.DataFrame({"c_custkey": range(len(amounts)), "c_acctbal": pd.array(amounts, "float64")})
    customer.to_parquet(tmp_path / "customer.parquet")
    with duckdb.connect() as connection:
        connection.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
        theirs = connection.execute(ORACLE_SQL["prefix_si"]).df()
    same_rows(QUERIES["prefix_si"](spark, str(tmp_path)).toPandas(), theirs)
