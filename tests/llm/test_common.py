import os

from loomtrace.llm import common


def test_only_own_tables_are_deleted(spark):
    got, path = common.materialised(spark.range(5), "numbers")
    assert got.count() == 5
    local = path.removeprefix("file://")
    other = os.path.join(os.path.dirname(os.path.dirname(local)), f"another-job-{os.getpid()}")
    os.makedirs(other)
    common.delete(spark, path)
    assert not os.path.exists(local)
    common.clean(spark)
    assert os.path.isdir(other) and not os.path.exists(os.path.dirname(local))
    os.rmdir(other)


def test_lower_bounds_of_the_session_stay(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    common.session(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "100"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    common.session(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(common.BATCH_ROWS)
