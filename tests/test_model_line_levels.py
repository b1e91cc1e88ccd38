"""The lines' starts go to cells of the sizes that tiles have, and to no others."""

from wirespan.operators import cover
from wirespan.plans import catalog


def test_starts_meet_tiles_at_their_levels_only(spark, monkeypatch):
    seen, join = [], catalog.overlapping
    monkeypatch.setattr(catalog, "overlapping", lambda *a, **k: seen.append(k.get("levels")) or join(*a, **k))
    catalog.queries()["model_lines"](spark, "/root/testdata/sf0.001")
    assert seen[0] and len(seen[0]) <= cover.LAST
