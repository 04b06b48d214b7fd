"""The walk-forward study reads its samples from a table of their own: no fold or fit plans the features again."""

from __future__ import annotations

import pytest

from tickloom import catalog
from tickloom.operators import folds


class Seen(Exception):
    pass


def test_folds_do_not_hold_the_plan_of_the_features(spark, monkeypatch):
    def walk_forward(rows, *_):
        assert rows.count() == rows.distinct().count()
        plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
        raise Seen(len(plan))

    monkeypatch.setattr(folds, "walk_forward", walk_forward)
    with pytest.raises(Seen) as e:
        catalog.queries()["walk_forward_study"](spark, "/root/testdata/sf0.001")
    assert e.value.args[0] <= 2
