"""An id with several texts, as in the SQL."""

from auditloom import registry
from tests.oracle import compare


def test_entropy_of_repeated_ids(spark, tmp_path):
    texts = [(1, "abca"), (1, "abcdefgh" * 8), (2, "once"), (3, ""), (3, "xyz"), (4, None), (4, "aab"), (None, "pq"), (None, "qrst"), (5, ""), (6, "é" * 60), (6, "é" * 60), (7, None), (7, None)]
    spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    _, diff = compare(registry.queries()["char_entropy"](spark, str(tmp_path)), registry.oracle_sql()["char_entropy"], str(tmp_path))
    assert not diff
