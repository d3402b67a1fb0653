from itertools import combinations

import numpy as np
import pytest

from postlark.llm import decontaminate

VOCABULARY = [f"w{i}" for i in range(400)]


def prose(rng, n):
    return [VOCABULARY[i] for i in rng.integers(0, len(VOCABULARY), n)]


def best_overlap(words, item):
    """(start, words, equal words) of the best overlap by the rule alone: every alignment, every stretch between equal words."""
    best = None
    for shift in range(-len(item) + 1, len(words)):
        low, high = max(0, shift), min(len(words), shift + len(item))
        equal = [i for i in range(low, high) if words[i] == item[i - shift]]
        for x in range(len(equal)):
            for y in range(x, len(equal)):
                n, same = equal[y] - equal[x] + 1, y - x + 1
                if same >= min(10, len(item)) and 5 * same >= 4 * n:
                    key = (same, -equal[x], -n)
                    if best is None or key > best[0]:
                        best = key, (equal[x], n, same)
    return best and best[1]


def brute(docs, items):
    out = set()
    for d, text in docs:
        for i, item in items:
            if text and item and len(item.split()) >= 5 and (hit := best_overlap(text.lower().split(), item.lower().split())):
                out.add((d, i, *hit))
    return out


def test_planted_passages_and_clean_text(spark):
    rng = np.random.default_rng(5)
    items = [(i, " ".join(prose(rng, int(rng.integers(20, 60))))) for i in range(30)]
    rows, want = [], set()
    for d in range(120):
        words = prose(rng, 300)
        if d % 3 == 0:
            item, passage = items[d % 30][0], items[d % 30][1].split()
            for k in range(0, len(passage), 7):  # one word in seven is another
                if d % 2:
                    passage[k] = "other"
            words[100:100] = passage
            want.add((d, item))
        rows.append((d, ", ".join(words).upper() if d % 5 == 0 else " ".join(words), "keep"))
    docs = spark.createDataFrame([*rows, (500, None, "x"), (501, "", "x"), (0, rows[0][1], "keep")], "doc_id long, text string, k1 string")
    benchmark = spark.createDataFrame([*items, (77, None), (78, ""), (79, "w1 w2"), (None, "w1 w2 w3 w4 w5 w6")], "item_id long, text string")
    out = decontaminate.contaminated(docs, benchmark)
    assert {(r.doc_id, r.item_id) for r in out.collect()} == want
    several = decontaminate.with_hits(docs, benchmark, part_rows=1).collect()
    assert {(r.doc_id, h.item_id) for r in several for h in r.hits} == want and len(several) == 123 and all(r.k1 in "keepx" for r in several)
    assert decontaminate.contaminated(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), benchmark).count() == 0


@pytest.mark.parametrize("part_rows", [20_000, 2])
def test_equals_brute_force_over_all_alignments(spark, part_rows):
    rng = np.random.default_rng(8)
    items = [(i, " ".join(prose(rng, int(n)))) for i, n in enumerate([4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 16, 20, 25, 30, 40])]
    items += [(20, items[12][1]), (12, items[13][1]), (21, "again " * 30)]  # a copy, an id with two texts, one word only
    docs = []
    for d in range(150):
        words = items[d % len(items)][1].split()
        a = int(rng.integers(0, max(1, len(words) - 11)))
        part = words[a:a + int(rng.integers(8, 40))]
        for k in rng.choice(len(part), int(rng.integers(0, len(part) // 4 + 1)), replace=False):
            part[k] = "zz"
        where = int(rng.integers(0, 3))  # also at the very beginning and end
        docs.append((d, " ".join((prose(rng, 30) if where else []) + part + (prose(rng, 30) if where < 2 else []))))
    docs += [(200, docs[12][1]), (None, docs[13][1]), (201, " ".join(prose(rng, 30_000) + items[13][1].split())), (202, None), (203, "")]
    texts = docs[:152] + [docs[-1]]
    want = brute(texts, items)
    best = {}
    for row in want:  # of texts with one id the better counts
        if row[:2] not in best or (row[4], -row[2]) > (best[row[:2]][4], -best[row[:2]][2]):
            best[row[:2]] = row
    assert len(best) > 60 and len(best) < 150
    found = decontaminate.with_hits(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), part_rows=part_rows).collect()
    got = {(r.doc_id, h.item_id): (r.doc_id, h.item_id, h.start, h.n_words, h.n_same) for r in found for h in r.hits if r.doc_id != 201}
    assert len(found) == len(docs)
    assert {k: (*v[:3], v[4]) for k, v in got.items()} == {k: (*v[:3], v[4]) for k, v in best.items()}
    assert any(r.doc_id == 201 and any(h.item_id == 13 and h.start >= 29_990 for h in r.hits) for r in found)


def test_every_overlap_has_a_seed():
    # All ways to substitute words of an overlap of up to 29 words, whose ends are equal words.  Longer ones hold 15 words with at most
    # three substituted or (40 to 44 words) 20 with at most four, at any place: if each of q stretches of 15 words had four, of n words
    # 4 * q <= n / 5 were substituted, so that the rest had 5 * q words or more, which are under 15; and 40 to 44 words have two of 20.
    def seedless(n, places):
        return [s for s in places if not any(all(b == "0" or p + k not in s for k, b in enumerate(m)) for m in decontaminate.MASKS for p in range(n - len(m) + 1))]

    for n in range(10, 30):
        for k in range(n // 5 + 1):
            if n - k >= 10:
                assert seedless(n, map(set, combinations(range(1, n - 1), k))) == []
    assert seedless(15, map(set, combinations(range(15), 3))) == []
    assert seedless(20, map(set, combinations(range(20), 4))) == []


def test_short_item_is_found_whole(spark):
    docs = spark.createDataFrame([(1, "x alpha Beta gamma, delta eps y"), (2, "alpha beta gamma delta y")], "doc_id long, text string")
    out = decontaminate.contaminated(docs, spark.createDataFrame([(1, "alpha beta gamma delta eps")], "item_id long, text string"))
    assert [tuple(r) for r in out.collect()] == [(1, 1, 1, 5, 5)]
