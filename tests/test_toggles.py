"""Toggles with a capacity against brute force."""

import datetime
import json
import random

from fieldbook.operators import toggles
from fieldbook.plans import workflow


def replayed(events, most, evict):
    state = {}
    for _, _, user, item in sorted(events):
        old = state.get(user, [])
        if item in old:
            state[user] = [x for x in old if x != item]
        elif evict:
            state[user] = [item, *old][:most]
        elif len(old) < most:
            state[user] = [item, *old]
    return {u: s for u, s in state.items() if s}


def test_toggles_against_brute_force(spark, tmp_path):
    rnd = random.Random(2)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=rnd.randrange(2000))
    events = [(at(), i, rnd.choice([1, 1, 1, 2, 3]), rnd.randrange(200)) for i in range(3000)]
    spark.createDataFrame([(i, t, u, json.dumps({"k": k})) for t, i, u, k in events] + [(9999, events[0][0], 1, None)],
                          "event_id long, ts timestamp_ntz, user_id long, props string").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got = {r["user_id"]: r["saved"] for r in workflow.toggle_state(spark, str(tmp_path)).collect()}
    want = replayed(events, 50, True)
    assert got == {u: ",".join(map(str, s)) for u, s in want.items()} and max(map(len, want.values())) == 50
    got = {r["user_id"]: r["compared"] for r in workflow.compare_state(spark, str(tmp_path)).collect()}
    assert got == {u: ",".join(map(str, s[::-1])) for u, s in replayed(events, 3, False).items()}
    empty = spark.createDataFrame([], "u long, i long, n long")
    assert toggles.replay(empty, "u", "i", ["n"], 3, True).count() == 0
