import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from postlark.llm import queries, repair


def every_way(turns):
    """Cheapest audit and roles by trying all edit sequences (two insertions between turns at most)."""
    inserts = [seq for n in range(3) for seq in itertools.product("ua", repeat=n)]
    best = None
    for gaps in itertools.product(inserts, repeat=len(turns) + 1):
        for edits in itertools.product("DKua", repeat=len(turns)):
            if any(t.must_go and e != "D" for t, e in zip(turns, edits, strict=True)):
                continue
            roles, audit, cost = "", "", 0
            for k, gap in enumerate(gaps):
                roles, audit, cost = roles + "".join(gap), audit + "I" * len(gap), cost + 3 * len(gap)
                if k < len(turns):
                    e = edits[k]
                    audit += e if e in "DK" else "R"
                    roles += {"D": "", "K": turns[k].initial or "?"}.get(e, e)
                    cost += {"D": 4, "K": 0}.get(e, 3) + (3 if turns[k].truncated and e != "D" else 0)
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, roles)
    return best


def test_edits_match_all_ways_of_editing():
    rng = random.Random(4)
    for k in range(70):
        n = 3 if k < 12 else rng.randrange(3)
        turns = [repair.Turn(rng.choice("suaut"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]
        cost, audit, roles = every_way(turns)
        assert repair.cheapest_edits(turns) == (cost, audit), turns
        rows = [({"s": "system", "u": "user", "a": "assistant", "t": "tool"}[t.initial], "x") for t in turns]
        assert "".join(r["role"][0] for r in repair.apply_edits(rows, audit)) == roles


def recursive(turns):
    """Cheapest audit by a recursion over (turn, state) that knows nothing of layers."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {(len(turns), s, 0): ((0, "") if s in ("", "a") else (10**9, "")) for s in ("", "s", "u", "a")}
    for i in range(len(turns), -1, -1):
        for inserted in range(4):
            for s in ("", "s", "u", "a"):
                ways = [best[i, s, 0]] if i == len(turns) and inserted == 0 else []
                if inserted:
                    ways = [best[i, s, inserted - 1]]
                    follows = "a" if s == "u" else "u"
                    c, rest = best[i, follows, inserted - 1]
                    ways.append((c + 3, "I" + rest))
                elif i < len(turns):
                    t, extra = turns[i], 3 * turns[i].truncated
                    c, rest = best[i + 1, s, 3]
                    ways.append((c + 4, "D" + rest))
                    if not t.must_go:
                        if (q := step.get((s, t.initial))):
                            c, rest = best[i + 1, q, 3]
                            ways.append((c + extra, "K" + rest))
                        c, rest = best[i + 1, "a" if s == "u" else "u", 3]
                        ways.append((c + 3 + extra, "R" + rest))
                best[i, s, inserted] = min(ways)
    return best[0, "", 3]


@pytest.mark.parametrize("seed", range(4))
def test_long_conversations_match_a_recursion(seed):
    rng = random.Random(seed)
    for _ in range(100):
        weights = [rng.random() for _ in range(4)]
        turns = [repair.Turn(rng.choices("suat", weights)[0], rng.random() < weights[0], rng.random() < weights[1]) for _ in range(rng.randrange(60))]
        assert repair.cheapest_edits(turns) == recursive(turns)


def test_a_very_long_conversation():
    turns = [repair.Turn("sua"[k % 3], k % 7 == 0, k % 5 == 0) for k in range(50_000)]
    cost, audit = repair.cheapest_edits(turns)
    assert cost > 50_000 and len(audit) >= 50_000


def test_faults_gaps_and_ties(spark):
    rows = [
        (1, None, "system", "Be kind."), (1, 0, "user", "Hi!"), (1, 3, "user", "Hi!"), (1, 4, "assistant", "cut off"), (1, 6, "tool", " \n"), (1, 6, None, None),
        (2, 5, "user", "b?"), (2, 5, "user", "a?"), (None, 1, "user", "alone."), (3, None, "", "No role."),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit("own")).withColumn("id", F.lit(0)).repartition(3)
    got = {r.conv_id: r for r in repair.repair_conversations(turns).collect()}
    assert set(got) == {1, 2, None, 3}
    one = got[1]
    assert (one.gaps, one.blank, one.duplicate, one.truncated, one.illegal, one.cost, one.audit) == (3, 2, 1, 1, 3, 15, "KKDKDD")
    assert [tuple(r) for r in one.repaired] == [("system", "Be kind."), ("user", "Hi!"), ("assistant", "cut off")]
    assert (got[2].cost, got[2].audit, [r.text for r in got[2].repaired]) == (3, "KR", ["a?", "b?"])
    assert (got[None].audit, got[3].audit, got[3].gaps) == ("KI", "D", 0)
    assert repair.repair_conversations(turns.limit(0)).count() == 0


def test_query_returns_every_conversation(spark, tmp_path):
    rows = [(c, t, r, x) for c in range(200) for t, (r, x) in enumerate([("user", "A question?"), ("assistant", "An answer. " * 3)][: 1 + c % 2])]
    rows += [(None, 0, "user", "No id.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op13_repair_conversations(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(200), None}
    import hashlib
    import zlib
    checked = 0
    for c in range(200):
        out = []
        for _, t, r, x in (row for row in rows if row[0] == c):
            kind = zlib.crc32(f"{c}:{t}".encode()) % 20
            x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
            out += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
        want = repair.examine(out)
        kept = "\n".join(f"{p['role']}:{p['text']}" for p in want["repaired"])
        assert (got[c].gaps, got[c].illegal, got[c].cost, got[c].audit) == (want["gaps"], want["illegal"], want["cost"], want["audit"])
        assert got[c].repaired_sha256 == hashlib.sha256(kept.encode()).hexdigest()
        checked += not out
    assert checked  # some lose all their turns
