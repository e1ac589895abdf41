"""Bundles, transfers, opaque tables and data-ID rewriting."""

import pytest

from orrery import queries
from orrery.operators import transfer
from orrery.operators.catalog import AmbiguityError
from orrery.plans.query import Catalog


def test_bundle_round_trip(spark, tmp_path):
    c = queries.catalog(spark, "/root/testdata/sf0.001")
    transfer.export(c, str(tmp_path / "bundle"), elements=["region", "nation", "supplier", "part"])
    back = transfer.load(spark, str(tmp_path / "bundle"), Catalog(c.universe))
    assert back.collections.chains == c.collections.chains
    a, b = (x.query().datasets("shipment", "all").frame() for x in (c, back))
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()
    again = transfer.transfer(back, back)
    assert again.types["shipment"].frame.count() == back.types["shipment"].frame.count()
    assert again.elements["nation"].count() == 25


def test_fetch(spark):
    t = spark.createDataFrame([(1, "a/b"), (2, "a/c"), (3, None)], "k long, p string")
    assert transfer.fetch(t, p="a/*").count() == 2 and transfer.fetch(t, k=[1, 3]).count() == 2
    assert transfer.fetch(t, p=None).count() == 1 and transfer.fetch(t, p="a/b", k=1).count() == 1


def test_rewritten(spark):
    c = queries.catalog(spark, "/root/testdata/sf0.001")
    assert transfer.rewritten(c, ["nation"], {"nation.name": "NATION_3"})["nation"] == 3
    with pytest.raises(LookupError):
        transfer.rewritten(c, ["nation"], {"nation.name": "nowhere"})
    with pytest.raises(AmbiguityError):
        transfer.rewritten(c, ["customer"], {"mktsegment": "BUILDING"})
