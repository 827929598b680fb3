import pytest

from lakeweave.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, con, name):
    oracle.same(con, catalog.QUERIES[name](spark, SF), catalog.SQL[name])


def test_sampling_keeps_to_its_fanout(spark):
    from collections import Counter

    edges = {(r["src"], r["dst"]) for r in catalog.fk_graph(spark, SF).collect()}
    rows = catalog.w5_neighbour_sampling(spark, SF).collect()
    counts = Counter((r["hop"], r["dst"]) for r in rows)
    assert all((r["src"], r["dst"]) in edges for r in rows)
    assert all(n <= (10, 5)[hop] for (hop, _), n in counts.items())
    again = {tuple(r) for r in catalog.w5_neighbour_sampling(spark, SF).collect()}
    assert again == {tuple(r) for r in rows}


def test_decoder_scores_every_pair(spark):
    rows = catalog.g5_g6_g8_g13_decoder(spark, SF).collect()
    assert len(rows) == catalog.key_pairs(spark).count() and all(0 <= r["score"] <= 1 for r in rows)


def test_flagship_comes_first_by_jaccard(spark):
    rows = catalog.flagship(spark, SF).collect()
    assert [r["jaccard"] for r in rows] == sorted((r["jaccard"] for r in rows), reverse=True)
