import pytest

from tarnwheel.llm import packing as P
from tarnwheel.llm import queries as Q

from ..test_entry import SF, compare, con  # noqa: F401


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, con, name):  # noqa: F811
    compare(spark, con, Q.QUERIES[name], Q.SQL[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_other_queries_run(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_the_attention_cost_binds(spark):
    free, bound = (P.fill(Q.QUERIES[n](spark, SF)) for n in ("p7_packed", "p7_attention"))
    over = f"cost > {Q.ATTENTION} and n_docs > 1"
    assert free.where(over).count() > 0 and bound.where(over).count() == 0
    total = lambda x: x.agg({"n_tokens": "sum", "n_docs": "sum"}).first()
    assert total(free) == total(bound)
