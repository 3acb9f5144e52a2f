import os

import pytest

from millrace import shared


def test_scope_removes_what_is_written_within(spark):
    a = shared.write_table(spark.range(3), "a")
    with shared.scope(spark, a) as keep:
        b = keep(shared.write_table(a.selectExpr("id + 1 as id"), "b"))
        shared.write_table(b, "c")
        with shared.scope(spark):
            d = shared.write_table(b, "d")
    there = lambda df: os.path.isdir(df.written)
    assert not there(a) and there(b) and not there(d)
    assert sorted(r.id for r in b.collect()) == [1, 2, 3]
    left = os.listdir(os.path.dirname(b.written))
    assert not [x for x in left if x.startswith(("a-", "c-", "d-"))]


def test_a_cluster_must_name_its_shared_folder():
    class Conf(dict):
        def getConf(self):  # noqa: N802
            return self

    class Session:
        conf = Conf()
        sparkContext = Conf()  # noqa: N815

    Session.sparkContext.master = "spark://host:7077"
    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())
    Session.sparkContext["spark.checkpoint.dir"] = "s3://x/y/"
    assert shared.shared_dir(Session()) == "s3://x/y"
