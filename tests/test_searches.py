"""The registered searches try every setting they are meant to, with all rows."""

import json
from collections import Counter

from permeon.operators.knn import KNN_GRID
from permeon.operators.tree_models import TREE_GRIDS
from permeon.plans.catalog import learning


def test_grid_search_covers_every_grid(spark, data):
    rows = learning.grid_search(spark, data).collect()
    assert Counter(r["model"] for r in rows) == {"LR": 3, "RF": 8, "ET": 8, "LGBM": 8, "XGB": 16, "KNN": 16}
    for name, grid in {**TREE_GRIDS, "KNN": KNN_GRID}.items():
        got = {r["params"] for r in rows if r["model"] == name}
        assert got == {json.dumps(s, sort_keys=True) for s in learning._product(grid)}
    assert all(0 <= r["mean_score"] <= 1 and r["std_score"] >= 0 for r in rows)


def test_sampled_settings_lie_in_the_ranges():
    forests, neighbours, boosting = (learning.drawn_settings(n) for n in ("RF", "KNN", "XGB"))
    assert (len(forests), len(neighbours), len(boosting)) == (50, 50, 100)
    assert {s["trees"] % 50 for s in forests} == {0} and max(s["trees"] for s in forests) > 800 and max(s["max_depth"] for s in forests) > 40
    assert {s["k"] for s in neighbours} <= set(range(1, 31)) and {s["metric"] for s in neighbours} == {"euclidean", "manhattan", "minkowski"}
    assert all(0 <= s["gamma"] <= 5 and 0.6 <= s["columns"] <= 1 and 3 <= s["max_depth"] <= 20 for s in boosting)
    assert learning.drawn_settings("XGB") == boosting


def test_sampled_search_runs_every_trial(spark, data):
    rows = learning.sampled_search(spark, data).collect()
    assert Counter(r["model"] for r in rows) == {"RF": 50, "KNN": 50, "XGB": 100}
    for name in learning.SEARCHES:
        assert Counter(r["params"] for r in rows if r["model"] == name) == Counter(json.dumps(s, sort_keys=True) for s in learning.drawn_settings(name))
