"""Trees that are deeper than the fixture's."""

import pytest

from ndspark.operators import catalog


def test_paths_of_deep_trees(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(71)], "node_id bigint, parent_id bigint, name string").coalesce(1)
    got = {r.node_id: r.path for r in catalog.with_paths(nodes).collect()}
    assert got == {i: "".join(f"/n{k}" for k in range(1, i + 1)) for i in range(1, 71)}
    with pytest.raises(Exception, match="RECURSION_LEVEL_LIMIT"):
        catalog.with_paths(nodes.where("node_id < 9"), 5).collect()
