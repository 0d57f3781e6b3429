"""Tables that cut lineage live as long as something reads them, and the core stands without the training-text part."""

import os
import subprocess
import sys

from quillspark import session


def paths(spark):
    folder = session.shared_dir(spark)
    return {p for p in os.listdir(folder) if p.startswith("scope-")}


def test_scopes_delete_what_no_result_reads(spark):
    def build(spark, n):
        first = session.cut(spark.range(n), "scope-first")
        second = session.cut(first.selectExpr("id + 1 as id"), "scope-second")
        inner = session.scoped(lambda spark: session.cut(spark.range(3), "scope-inner"))(spark)
        return second.join(inner, "id", "left")

    out = session.scoped(build)(spark, 5)
    assert {p.split("-")[1] for p in paths(spark)} == {"second", "inner"}
    assert out.count() == 5
    session.clean(spark)
    assert not paths(spark)


def test_failed_scopes_leave_nothing(spark):
    def build(spark):
        session.cut(spark.range(2), "scope-failed")
        raise ValueError

    try:
        session.scoped(build)(spark)
    except ValueError:
        pass
    assert not paths(spark)


def test_shuffle_setting_is_restored(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    session.cut(spark.range(9).repartition(3), "scope-setting")
    assert spark.conf.get(setting, None) == before
    session.clean(spark)


def test_entry_without_libraries_of_training_text():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('p1_') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    queries, sql, training = out.stdout.split()
    assert int(queries) > 100 and int(sql) > 100 and training == "False"
