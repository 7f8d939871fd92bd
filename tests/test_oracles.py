"""Every query of the package itself against its SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from oracle import database, same

from lateweave.oracles import ORACLES
from lateweave.queries import QUERIES


@pytest.fixture(scope="module")
def db(folder):
    return database(folder)


@pytest.fixture(scope="module")
def results(spark, folder, request):
    """The rows of all queries asked for; several run at a time."""
    names = [i.callspec.params["name"] for i in request.session.items if i.module is request.module and hasattr(i, "callspec")]
    pool = ThreadPoolExecutor(6)
    yield {n: pool.submit(lambda n=n: QUERIES[n](spark, folder).toArrow()) for n in names}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(results, db, name):
    same(results[name].result(), db.execute(ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_learnt(results, name):
    """Training isn't reproducible across engines; every bag is counted or assigned once."""
    rows = results[name].result().to_pylist()
    bags = 90
    if name == "ivf_kmeans":
        assert sum(r["n_docs"] for r in rows) == bags
    else:
        assert sum(r["cnt"] for r in rows) == 5 * bags
        assert len({(r["doc_id"], r["rep"], r["part"]) for r in rows}) == len(rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["qid", "doc_id", "score", "rank"]
    assert set(e.oracle_sql()) <= set(e.queries())
