import pytest
from pyspark.sql import functions as F

from leafgate.functions.text import ACRONYMS, deshout
from leafgate.operators import acronyms, manifest as mf

TEXTS = ["THE NASA ACT", None, "", "no shout", "NASA\nUSA XUSA USA_ USA-FBI", "ÉCOLE ABC\uffff NASA", "ABC abc ABC", "NASA"]


@pytest.mark.parametrize("bound", [0, 100])
def test_a_table_equals_the_list(spark, monkeypatch, bound):
    monkeypatch.setattr(acronyms, "BROADCAST_WORDS", bound)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(3)
    table = spark.createDataFrame([(a,) for a in (*ACRONYMS, "NASA", None)], "word string")
    want = sorted(map(tuple, rows.withColumn("text", deshout(F.col("text"))).collect()), key=str)
    assert sorted(map(tuple, acronyms.deshouted(rows, "id", table).collect()), key=str) == want
    none = sorted(map(tuple, acronyms.deshouted(rows, "id", table.limit(0)).collect()), key=str)
    assert none == sorted(map(tuple, rows.withColumn("text", deshout(F.col("text"), ["-"])).collect()), key=str)


def test_a_million_acronyms(spark):
    word = F.concat(*(F.char(65 + F.floor(F.col("id") / 26**i).cast("int") % 26) for i in range(5)))
    table = spark.range(1_000_000).select(word.alias("word"))
    rows = spark.createDataFrame([(1, "say AAAAA and ZZZZZ NOTAWORD"), (None, "say AAAAA")], "id long, text string")
    got = {r["id"]: r["text"] for r in acronyms.deshouted(rows, "id", table).collect()}
    assert got == {1: "say AAAAA and Zzzzz Notaword", None: "say Aaaaa"}


def test_names_in_an_order_without_case(spark):
    names = ["b", "A", "a", "C", "B2", "b1", "É", "é"]
    got = mf.stitched(spark.createDataFrame([("k", n) for n in names], "k string, fname string"), "k", fold=True).first()["files"]
    assert got == "|".join(sorted(names, key=lambda n: (n.lower(), n)))
