"""Tables in the shared folder: who removes them, and when."""

from pathlib import Path

from pyspark.sql import functions as F

from tickwise.plans.shared import Bucketed, Shared, scratch, session_dir


def there(table):
    return Path(table.path.removeprefix("file://")).exists()


def test_scratch_tables_go_with_their_step(spark):
    before = Shared(spark.range(3))
    with scratch():
        inside, result, kept = Shared(spark.range(4)), Shared(spark.range(5), result=True), Shared(spark.range(6), keep=True)
        assert there(inside)
    assert not there(inside) and there(before) and there(result) and there(kept)
    assert result.df.count() == 5 and before.path.startswith(session_dir(spark)) and not kept.path.startswith(session_dir(spark))
    before.drop()
    assert not there(before)


def test_buckets_are_read_without_a_shuffle(spark):
    key = F.struct((F.col("id") % 7).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("b")).alias("__key")
    known = Bucketed(spark.range(100).select(key))
    new = spark.range(150).select(key).distinct().join(known.df.hint("merge"), "__key", "left_anti")
    assert new.count() == spark.range(150).select(key).distinct().count() - known.plain.distinct().count()
    plan = new._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    known.forget()
    assert known.plain.count() == 100
