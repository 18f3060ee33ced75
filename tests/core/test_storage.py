"""Tables on the way to a result are deleted, also when it fails."""

import glob

import pytest

from coppice.plans.storage import materialize, settled, shared_dir


def test_settled(spark):
    at = shared_dir(spark).removeprefix("file://")
    there = lambda: {p.rsplit("-", 1)[0].rsplit("/", 1)[-1] for p in glob.glob(f"{at}/coppice/settle*")}

    def inner():
        return settled(spark, "settle-inner", lambda: materialize(spark.range(5), "settle-way").where("id > 1"))

    kept = settled(spark, "settle-outer", lambda: inner().union(materialize(spark.range(1), "settle-side")))
    assert sorted(r["id"] for r in kept.collect()) == [0, 2, 3, 4] and there() == {"settle-outer"}
    with pytest.raises(ZeroDivisionError):
        settled(spark, "settle-fails", lambda: [materialize(spark.range(2), "settle-lost"), 1 / 0])
    assert there() == {"settle-outer"}
    materialize(spark.range(1), "settle-free")
    assert there() == {"settle-outer", "settle-free"}
