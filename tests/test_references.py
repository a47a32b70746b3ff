"""Words of references stand for themselves."""

from pyspark.sql import functions as F

from leafmill.functions import text as t


def test_letters_around_pmid_make_another_word(spark):
    lines = ["I. VELIKI PFPMID", "Naslov hkpmidba", "PMID: 12", "vidi pmid123", "PMIDs 1, 2"]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, line string").orderBy("k")
    assert [r.is_ref for r in rows.select(t.is_reference(F.col("line")).alias("is_ref")).collect()] == [False, False, True, True, True]
