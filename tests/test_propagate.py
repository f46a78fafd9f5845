import pytest

from sitegrove.operators.traverse import propagate_min


@pytest.fixture(autouse=True)
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _least(edges, values):
    out = dict(values)
    rest = list(out)
    while rest:
        node = rest.pop()
        for f, t in edges:
            if f == node and (t not in out or (out[node] is not None and (out[t] is None or out[node] < out[t]))):
                out[t] = out[node]
                rest.append(t)
    return out


def test_chain_longer_than_64_edges(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(67)]
    values = [("n0", 1), ("n66", 9)]
    out = propagate_min(spark.createDataFrame(edges, "from_id string, to_id string"), spark.createDataFrame(values, "id string, value int"))
    assert {r.id: r.value for r in out.collect()} == _least(edges, values)


def test_null_values_on_a_cycle_end(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "b"), ("d", "c"), ("a", "e"), ("e", "a")]
    values = [("a", None), ("d", 3)]
    out = propagate_min(spark.createDataFrame(edges, "from_id string, to_id string"), spark.createDataFrame(values, "id string, value int"))
    assert {r.id: r.value for r in out.collect()} == _least(edges, values) == {"a": None, "b": 3, "c": 3, "d": 3, "e": None}
