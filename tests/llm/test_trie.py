import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from postlark.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    convs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
    nodes = defaultdict(set)
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            nodes[s[:d]].add(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * len(WORD.findall(p[-1][1])) if p else 0
    ends = {p: ",".join(str(c) for c in sorted(m) if rebuilt[c] == p) for p, m in nodes.items()}
    return Counter((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends[p].encode()).hexdigest()) for p, m in nodes.items())


def run(spark, rows, **options):
    given = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit("own"), "bucket": F.lit("own"), "seq_key": F.lit(1)}).repartition(3)
    out = trie.prefix_trie(trie.encoded(trie.lend_openings(trie.ordered_turns(given))), **options)
    return Counter(tuple(r[c] for c in COLUMNS) for r in out.collect())


def conversations():
    rng = random.Random(9)
    texts = ["one two", "three", "", "four  five\tsix", " ", "ä ö ü"]
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(300) for t in range(rng.randrange(1, 9))]
    rows += [(c, t, "user", "the very common beginning") if t < 4 else (c, t, "user", f"{c % 40} {t}") for c in range(300, 600) for t in range(7)]
    rows += [(c, t, "user", "a copy") for c in range(600, 800) for t in range(5)]
    rows += [(c, t, "user", f"chain {t}") for c in range(800, 820) for t in range(c - 799)]  # each goes on from the last
    return rows


def test_nodes_match_brute_force_in_one_and_in_many_rounds(spark):
    rows = conversations()
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, local_ids=120) == want


def test_nulls_repeated_rows_and_ties(spark):
    rows = [
        (7, None, "user", "first"), (7, 0, None, None), (7, 0, None, None), (7, 2, "assistant", "x" * 100_000 + " end"), (None, 0, "user", "no conversation"),
        (20, 5, "user", "b"), (20, 5, "user", "a"), (21, 0, "user", "lost"), (-3, 0, "user", "below zero"), (-20, 0, "system", "base"),
    ]
    assert run(spark, rows) == brute(rows)
    assert not run(spark, [])


def test_a_conversation_can_lose_all_turns(spark):
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)
    assert run(spark, [(alone, 0, "user", "gone")]) == Counter([(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())])
