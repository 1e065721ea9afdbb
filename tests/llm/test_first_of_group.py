"""One row of each group of near duplicates stays, whatever its id."""

from sightline.llm import simhash

A, B, C, D = ("the quick brown fox jumps over the lazy dog and rests by the river", "seven grey ships sailed north at dawn with salt and wool for the islands",
              "a ledger of debts was found under the floor of the old mill last spring", "nobody in the village could say who had rung the bells that winter night")


def test_one_row_of_each_group_stays(spark):
    rows = [(None, A), (None, B), (None, B), (4, C), (4, C), (3, C), (None, C), (3, D), (9, D), (9, A + " again " + B)]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long")
    kept = simhash.first_of_group(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    # a null id unlike any other, one of a group of null ids, and of C and D the smallest id though it has two texts
    assert got == sorted([(None, A), (None, B), (3, C), (3, D), (9, A + " again " + B)], key=str)


def test_repeated_rows_and_ids(spark):
    docs = spark.createDataFrame([(1, A), (5, B), (5, A), (7, C), (7, C), (7, C)], "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in simhash.first_of_group(docs).collect())
    assert got == [(1, A), (5, B), (7, C)]
