"""Every query against the SQL of the same name."""

import duckdb
import pytest

from quadmosaic.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, small, duck, same_rows, name):
    df = QUERIES[name](spark, small)
    if name in ORACLE_SQL:
        same_rows(df, duck.sql(ORACLE_SQL[name]))
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 256 * 200
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


# The last tile of 50 lines has 6 or 7: a narrow one, one with room beside it, the second and the last of a square, a square of its own.
@pytest.mark.parametrize("name,lines", [("png_roundtrip", 206), ("png_roundtrip", 156), ("tiff_roundtrip", 206), ("tiff_roundtrip", 156), *[("pyramid_images", n) for n in (206, 257, 307, 356)]])
def test_last_tile_is_not_full(spark, small, tmp_path, same_rows, name, lines):
    spark.read.parquet(f"{small}/embeddings.parquet").where(f"vec_id < {lines}").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    same_rows(QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name]))
