from pyspark.sql import functions as F

from cohortry.llm.line_dedup import dedup_lines

SCHEMA = "doc_id bigint, text string"


def kept(spark, rows, **options):
    found = dedup_lines(spark.createDataFrame(rows, SCHEMA), **options)
    return {(r["doc_id"], r["text"]): (r["kept"], r["n_lines"], r["n_dropped"]) for r in found.collect()}


def test_lines_stay_in_the_first_document(spark):
    rows = [(2, "A shared LINE\nown two"), (1, "own one\n  a shared line\t"), (3, "a shared line\na shared line\n\nshort\nlast"), (4, "short")]
    found = kept(spark, rows)
    assert found[rows[1]] == ("own one\n  a shared line\t", 2, 0)
    assert found[rows[0]] == ("own two", 2, 1)
    assert found[rows[2]] == ("\nshort\nlast", 5, 2)
    assert found[rows[3]] == ("short", 1, 0)


def test_higher_threshold(spark):
    rows = [(i, f"a line in several texts\nown line number {i}") for i in range(3)] + [(9, "own line number 1")]
    found = kept(spark, rows, documents=3)
    assert found[rows[0]][2] == 0 and found[rows[1]][2] == 1 and found[rows[2]][2] == 1
    assert found[rows[3]][2] == 0


def test_edge_cases(spark):
    long = "\n".join(f"line number {i} of many" for i in range(20_000))
    rows = [(1, None), (2, ""), (3, long), (4, long), (None, "line number 5 of many\nx"), (5, "line number 7 of many"), (5, "line number 7 of many"), (6, "ünïcode lines\nünïcode lines"), (6, "other text")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("_id", F.lit(1)).withColumn("kept", F.lit(2))
    found = {(r["doc_id"], r["text"]): (r["kept"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(df).collect()}
    assert found[(1, None)] == ("", 1, 0) and found[(2, "")] == ("", 1, 0)
    assert found[(3, long)] == (long, 20_000, 0)
    assert found[(4, long)] == ("", 20_000, 20_000)
    assert found[(None, "line number 5 of many\nx")] == ("x", 2, 1)
    assert found[(5, "line number 7 of many")] == ("", 1, 1)
    assert found[(6, "ünïcode lines\nünïcode lines")][2] == 0
    assert dedup_lines(df).count() == len(rows)
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
