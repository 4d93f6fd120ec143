"""Work that must not gather in one task."""

from __future__ import annotations

import pytest

from civicmill.functions.chronology import OUTCOMES
from civicmill.operators import civic_views as views

ENTITIES = [(i, ["person", "association", "business", "service"][i % 4], f"e{i}") for i in range(40)]
RELATIONS = [(i, 4 * (i % 10), 4 * (i % 7) + 1 + i % 3, ["élu_cm", "président", "maire", "gérant", "agent_communal"][i // 10 % 5], [None, "2001-05-01"][i % 2], [None, "2006-01-01", "2004"][i % 3]) for i in range(120)]
FLOWS = [(i, ["subvention", "bail", "marché"][i % 3], 2000 + i % 8, i * 10, 4 * (i % 6) + 2, 4 * (i % 8) + 1, i if i % 4 == 0 else None, "cm") for i in range(90)]
EVENTS = [(i, f"200{i % 8}-06-01") for i in range(0, 90, 8)]


@pytest.fixture(scope="module")
def frames(spark):
    make = spark.createDataFrame
    return (
        make(ENTITIES, "id long, type string, name string"), make(RELATIONS, "id long, from_id long, to_id long, relation_type string, since string, until string"),
        make(FLOWS, "id long, type string, year int, amount long, from_id long, to_id long, event_id long, source string"), make(EVENTS, "id long, date string"),
    )


def brute():
    kinds, days = {i: t for i, t, _ in ENTITIES}, dict(EVENTS)
    ends = {(a, b, kind, since, until) for _, x, y, kind, since, until in RELATIONS for a, b in ((x, y), (y, x))}
    elected = {(a, kind, since, until) for a, _, kind, since, until in ends if kind in views.ELECTIVE_OR_MAYOR and kinds[a] == "person"}
    leads = {(a, b, kind, since) for a, b, kind, since, _ in ends if kind in views.PRIVATE and kinds.get(b) in ("association", "business")}
    for person, elective, since, until in elected:
        for _, body, role, begun in [r for r in leads if r[0] == person]:
            paid = [f for f in FLOWS if f[1] in views.PUBLIC_MONEY and body in (f[4], f[5])]
            for f in paid or [(None,) * 8]:
                yield person, elective, since, until, body, role, begun, f[0], f[3], days.get(f[6])


def test_conflicts_are_placed_in_parts(spark, frames):
    df = views.conflicts(*frames, parts=12)
    key = lambda r: tuple(map(str, r))
    got = df.select("person_id", "elective_role", "mandate_start", "mandate_end", "entity_id", "entity_role", "role_start", "flow_id", "flow_amount", "flow_date")
    want = sorted(brute(), key=key)
    assert sorted(map(tuple, got.collect()), key=key) == want and any(r[9] for r in want) and any(r[7] is None for r in want)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(map(tuple, views.conflicts(*frames).collect()), key=key)
    assert {r["chronology"] for r in df.select("chronology").distinct().collect()} <= set(OUTCOMES)
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert len(shuffles) >= 4 and all(", 12), " in line for line in shuffles), shuffles


def test_money_without_an_act_meets_no_act(frames):
    lines = views.conflicts(*frames)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Filter" in line and "isnotnull(event_id#" in line for line in lines) and any("Filter" in line and "isnull(event_id#" in line for line in lines)


def test_cases_are_grouped_where_conflicts_are(frames):
    df = views.conflict_cases(views.conflicts(*frames, parts=12))
    want = {(r[0], r[4], r[7]) for r in brute()}
    got = df.collect()
    assert len(got) == len(want) and {(r["person_id"], r["entity_id"], r["flow_id"]) for r in got} == want
    shuffles = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert not any("flow_id#" in line.split("hashpartitioning(")[1].split(")")[0] for line in shuffles) and any(", 12), REPARTITION_BY_NUM" in line for line in shuffles)
