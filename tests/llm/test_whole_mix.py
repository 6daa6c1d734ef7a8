"""The texts of the mix: null and repeated ids, equal rows where the budget ends."""

import collections

from pyspark.sql import functions as F

from copyledger.llm import mixing
from llm.conftest import ROWS, SCHEMA, doc


def check(spark, rows, **how):
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix_sources(docs, **how)
    keyed = {(r["doc_id"], r["key"]): r["text"] for r in docs.select(
        "doc_id", "text", mixing.row_key().alias("key")).collect()}
    want, words = collections.Counter(), collections.Counter()
    for r in plan.collect():
        if r["copies"]:
            want[r["doc_id"], r["source"], keyed[r["doc_id"], r["key"]]] += r["copies"]
            words[r["source"]] += r["taken"]
    mix = mixing.mixed_documents(docs, plan)
    assert mix.columns == docs.columns
    got = mix.collect()
    assert collections.Counter((r["doc_id"], r["source"], r["text"]) for r in got) == want
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += len(r["text"].split())
    assert taken == words
    return got, plan.collect()


def test_mix_of_all_rows(spark):
    got, _ = check(spark, ROWS, share=2.0)
    assert any(r["doc_id"] is None for r in got) and any(r["doc_id"] == 9 for r in got)
    check(spark, ROWS)


def test_budget_that_ends_among_equal_rows(spark):
    rows = [doc(3, "just the same four")] * 10 + [doc(3, "just the same four", None)] * 3 + [doc(None, "no id here")] * 5
    got, plan = check(spark, rows)
    of = [r["copies"] for r in plan if r["doc_id"] == 3 and r["source"] == "a"]
    assert len(set(of)) == 2 and len(got) < 2 * len(rows)


def test_mix_keeps_columns_apart(spark):
    docs = spark.createDataFrame([doc(i, f"some words of {i}") for i in range(20)], SCHEMA)
    mix = mixing.mixed_documents(docs, mixing.mix_sources(docs, share=1.0))
    assert {r["row"] for r in mix.collect()} == {"clash"}
    assert mix.agg(F.countDistinct("doc_id")).first()[0] == 20
