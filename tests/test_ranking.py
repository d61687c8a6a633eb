import random

from tidemark.operators.ranking import competition_rank


def test_skewed_groups_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        group = "hot" if i % 3 else rng.choice(["a", "b", None])
        value = rng.choice([0.0, 0.0, rng.random(), round(rng.random(), 2), None])
        rows.append((i, group, "m", value))
    df = spark.createDataFrame(rows, "id int, region string, metric string, v double")
    got = {r.id: r for r in competition_rank(df, ["region", "metric"], "v", "rank", "size", 8).collect()}
    assert len(got) == len(rows)
    for i, group, _, value in rows:
        if value is None:
            assert got[i]["rank"] is None
            continue
        peers = [v for _, g, _, v in rows if g == group and v is not None]
        assert got[i]["rank"] == 1 + sum(v > value for v in peers)
        assert got[i]["size"] == len(peers)
