"""The phone query against its SQL, on numbers with one character between them."""

import duckdb

import __spark_entry__ as entry

TEXTS = [
    "a 0123456789 +49 151 2345678 b", "+49 151 2345678 +49 151 2345678 +49 151 2345678", "+49 151 2345678  +49 151 2345678", "0123456789/0123456789/0123456789", "1234567890+1234567890",
    "(12) 345-678-901\n+12 345 678 901", "0123456789\n", "0123456789 ", "a0123456789", "0123456789a", "", None, "é0123456789", "_0123456789_", "٠١٢٣٤٥٦٧٨٩ +٠١٢٣٤٥٦٧٨٩",
]


def test_adjacent_numbers(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, entry.queries()["redact_phone"](spark, str(tmp_path)).collect()))
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(base.execute(entry.oracle_sql()["redact_phone"]).fetchall())
    assert got == want
    assert any("] +[" in (t or "") for _, t in want)
