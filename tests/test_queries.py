"""The registered queries of the classifier: the operators' own settings, and flags over real scores."""

import pytest

from inputlens.operators import liveness
from inputlens.plans import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture
def forests(monkeypatch):
    """Settings of every forest that is made; the forests themselves are small."""
    seen, real = [], liveness.RandomForestClassifier

    def small(**settings):
        seen.append((settings["numTrees"], settings["maxDepth"]))
        return real(**settings | {"numTrees": 2, "maxDepth": 2})

    monkeypatch.setattr(liveness, "RandomForestClassifier", small)
    return seen


@pytest.fixture
def minutes(monkeypatch):
    """Minutes of the automated sessions that are asked for."""
    seen, real = [], queries.automation_events

    def asked(spark, sessions, minutes_per_session=30):
        seen.append(minutes_per_session)
        return real(spark, sessions, minutes_per_session)

    monkeypatch.setattr(queries, "automation_events", asked)
    return seen


@pytest.mark.parametrize("name", ["m8_report", "m9_scores", "t4_suspicious", "t5_importance"])
def test_whole_forest(spark, forests, minutes, name):
    assert queries.QUERIES[name](spark, SF).count() > 0
    assert forests == [(300, 15)] and minutes == [30]


def test_day_flags_of_the_model(spark, forests):
    flags = queries.QUERIES["m10_day_flags"](spark, SF).collect()
    scores = queries.QUERIES["m9_scores"](spark, SF).collect()
    best, over = {}, {}
    for r in scores:
        day = (r.user, r.window_start.strftime("%Y-%m-%d"))
        best[day] = max(best.get(day, 0.0), r.probability)
        over[day] = over.get(day, 0) + (r.probability >= 0.8)
    assert {((r.user, r.day), r.score, r.nonhuman) for r in flags} == {(d, round(p, 6), over[d] >= 2) for d, p in best.items()}


def test_forests_read_events_once(spark):
    """What a forest is fitted, split and judged on is read from tables of its own, not made of the events each time."""
    t = queries.Tables(spark, SF)
    assert all("inputlens-labelled" in f for f in t.labelled().inputFiles())
    assert all("inputlens-features" in f for f in t.features().inputFiles()) and t.features() is t.features()
