"""One grouping-sets pass equals the separate breakdowns, null keys included."""

from pyspark.sql import functions as F

from copyledger.operators import stats as S

ROWS = [("2024", "may", "p", "done", 5, True), ("2024", "may", "q", "new", 7, False), ("2024", None, "q", "new", None, False),
        (None, "may", "p", "new", 3, True), (None, None, None, None, 2, None), ("2023", "may", "p", None, 1, False)]
SCHEMA = "year string, month string, project_name string, deduplication_status string, file_size_bytes long, " \
         "is_duplicate boolean"


def parts(df):
    return {name: sorted([tuple(r[k] for k in (*own, "file_count", "total_size", "duplicate_count"))
                          for r in df.filter(F.col("section") == name).collect()], key=str)
            for name, own in S.SECTIONS.items()}


def test_sections_equal_the_breakdowns(spark):
    files = spark.createDataFrame(ROWS, SCHEMA)
    got = S.report_sections(files)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1
    sections = parts(got)
    for name, want in (("year", S.breakdown_by_year(files)), ("month", S.breakdown_by_month(files)),
                       ("project", S.project_measures(files))):
        assert sections[name] == sorted([tuple(r) for r in want.collect()], key=str), name
    status = sorted([tuple(r) for r in S.status_breakdown(files).collect()], key=str)
    assert [r[:2] for r in sections["status"]] == status and sum(r[1] for r in status) == len(ROWS)
    assert S.report_sections(spark.createDataFrame([], SCHEMA)).count() == 0
