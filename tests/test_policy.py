"""Rules beyond the number that compiles to one expression, against plain Python."""

import numpy as np
import pytest

from mediagrove.operators import policy


def best(rules, obs):
    found = []
    for rule, *own, mode in rules:
        if all(o in ("", v) for o, v in zip(own, obs[1:], strict=True)):
            found.append((-sum(w for o, w in zip(own, (1, 2, 4, 8), strict=True) if o), rule, mode))
    return (min(found)[2], min(found)[1]) if found else ("default", -1)


@pytest.mark.parametrize("n", [0, 5, policy.MOST_RULES, policy.MOST_RULES + 60])
@pytest.mark.parametrize("general", [True, False])
def test_rules(spark, n, general):
    rng = np.random.default_rng(n)
    pick = lambda name, k: "" if rng.random() < 0.5 else f"{name}{rng.integers(0, k)}"
    rules = [(k, pick("r", 9), pick("s", 9), pick("o", 9), pick("h", 9), f"m{k % 4}") for k in range(n)]
    rules = [r for r in rules if general or any(r[1:5])]
    obs = [(k, f"r{rng.integers(0, 9)}", f"s{rng.integers(0, 9)}", f"o{rng.integers(0, 9)}", f"h{rng.integers(0, 9)}") for k in range(150)]
    df = spark.createDataFrame(obs, "seq int, root_id string, system string, role string, sha256 string")
    table = spark.createDataFrame(rules, "rule int, source string, system string, role string, sha256 string, mode string")
    got = {r.seq: (r.mode, r.matched_rule) for r in policy.resolve(df, table, "default").select("seq", "mode", "matched_rule").collect()}
    assert got == {o[0]: best(rules, o) for o in obs}
