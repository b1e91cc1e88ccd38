"""The queries that end in paths and connections hold no table of the driver's either."""

import pytest

from tests import test_broadcasts
from wirespan.plans import catalog


@pytest.mark.parametrize("name", ["paths", "connections", "connections_csv", "draw_commands"])
def test_paths_and_what_follows_do_not_broadcast(spark, monkeypatch, name):
    test_broadcasts.test_steps_do_not_broadcast(spark, monkeypatch, name)


def test_draw_commands_find_connections_once(spark):
    """Segments and middles of paths come from one pass over the connections."""
    plan = catalog.queries()["draw_commands"](spark, test_broadcasts.SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(path_jids") == 1
