"""Clusters of incidents are those of the plain loop, and sets are not compared as a whole."""

import random

from auditloom.operators import risks as R


def plain(each, least):
    clusters = []
    for i, agents in enumerate(each):
        mine = set(agents)
        for held, members in clusters:
            if not (held | mine) or len(held & mine) / len(held | mine) > least:
                held |= mine
                members.append(i)
                break
        else:
            clusters.append((set(mine), [i]))
    return clusters


def test_clusters_against_the_plain_loop():
    rng = random.Random(7)
    for least in (0.0, 0.3, 0.6):
        for agents in (6, 40):
            each = [[f"a{rng.randrange(agents)}" for _ in range(rng.randrange(6))] for _ in range(120)]
            assert R._clusters(each, least) == plain(each, least)


def test_groups_of_a_task_stay_apart(spark):
    rows = [(f"r{k:02}", "t", "s", "", ["a", "b"] if k % 2 else [f"x{k}"], 0.1 * (k % 10), "CD" if k % 3 else "HS", "a") for k in range(20)]
    got = R.incidents(spark.createDataFrame(rows, "risk_id string, risk_type string, source_domain string, target_domain string, agents array<string>, severity double, scenario string, blame_agent string")).collect()
    one = {r.incident_id: r for r in got}
    assert len(got) == 11 and one["r01"].risks == 10 and one["r01"].agents == ["a", "b"] and one["r01"].alert_level == "critical" and one["r01"].scenario == "CD" and one["r01"].blamed == ["a"]
