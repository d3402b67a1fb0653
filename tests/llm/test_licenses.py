import re

import pytest

from postlark.llm import licenses


def brute_base(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)
    places, labels = [], set()
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


TEXTS = [None, "", "MIT License", "the mit-license, mit\nlicense; xmit license mit licenses", "CC BY CC BY cc  by", "Über GNU General-Public (License) ünd Apache License", "ÉMIT LICENSE mit licenseé",
         "gnu general public", "a" * 100_000 + " apache license " + "mit license " * 3000, "K mit license K"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_matches_brute_force(text):
    assert licenses.scan(text)[:5] == brute_base(text)


def test_fuzzy_matches_and_spans():
    text = "é Released undr the MIT Lisense."
    found = licenses.scan(text)
    assert found[4] == "" and found[5] == "mit" and 0.8 < found[6] < 1
    (label, start, end, edits), = found[7]
    assert (label, text[start:end].lower(), edits) == ("mit", "released undr the mit lisense", 2)
    assert licenses.scan("GNU Leser General Public License v3")[5] == "lgpl"
    twice = licenses.scan("released under the mit license " * 2 + "x " * 40 + "releasd under the mit license")
    assert [m[3] for m in twice[7]] == [0, 0, 1]
    assert licenses.scan("nothing here, all night reversed")[5] == ""


@pytest.mark.parametrize("text, span, label", [
    ("é # All rights\n# reserved.", "All rights\n# reserved", "proprietary"), ("All   rights    reserved.", "All   rights    reserved", "proprietary"), ("// Mozilla Public\n// License", "Mozilla Public\n// License", "mpl"),
    ("# Released under\n# the MIT license", "Released under\n# the MIT license", "mit"), ("    * Permission is hereby granted,\n     * free of charge", "Permission is hereby granted,\n     * free of charge", "mit")])
def test_wrapped_and_indented_notices(text, span, label):
    (found, start, end, edits), = licenses.scan(text)[7]
    assert (found, text[start:end], edits) == (label, span, 0)


@pytest.mark.parametrize("notice", licenses.NOTICES)
def test_pigeonhole_finds_every_close_variant(notice):
    edits = len(notice) // licenses.CHARS_PER_EDIT
    for shift in range(0, len(notice) - 1, 3):
        changed = list(notice)
        for k in range(edits):
            changed[(shift + 7 * k) % len(notice)] = "~"[:0] if k % 2 else "q"
        text = "xx yy " + "".join(changed) + " zz"
        assert licenses.NOTICES[notice] in licenses.scan(text)[5].split(","), text


def test_table(spark):
    docs = spark.createDataFrame([(1, "MIT License", 0.5), (1, "MIT License", 0.5), (None, None, None)], "doc_id long, text string, score double")
    rows = licenses.scan_licenses(docs).select("doc_id", "score", "license.*").drop("matches").collect()
    assert len(rows) == 3 and {r.labels for r in rows} == {"mit", ""}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
