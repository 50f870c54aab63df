"""Licences with any number of other words between, short notices by alignment, results against brute force."""

from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from routeloom.llm import licenses

MIT = licenses.words(licenses.TEMPLATES["MIT"])


@pytest.mark.parametrize("fillers", [0, 8, 9, 12, 200])
def test_any_number_of_other_words_between(fillers):
    text = [b"start"] * 50 + [x for w in MIT for x in (w, *[b"foo"] * fillers)] + [b"end"] * 50
    found = licenses.best(text, MIT, 0.8)
    assert len(found) == len(MIT) and [j for _, j in found] == list(range(len(MIT)))
    assert all(text[i] == MIT[j] for i, j in found)


def test_span_is_a_parameter():
    template = [b"t%d" % i for i in range(24)]
    text = [x for w in template for x in (w, *[b"t0"] * 30)]  # a word of the template's own between, 30 times
    assert licenses.best(text[:1] + [w for w in text[1:] if w != b"t0"], template, 0.8, 1)
    assert not licenses.best(text, template, 0.8, 4)
    assert len(licenses.best(text, template, 0.8, None)) == 24


def test_a_better_place_in_a_window_that_has_one():
    template = [b"t%d" % i for i in range(40)]
    worse = [w for i, w in enumerate(template) if i % 6]
    text = [*worse, b"x", *template]
    assert len(licenses.best(text, template, 0.8)) == 40


def brute_near(text, template, between):
    m = len(template)
    for at in combinations(range(len(text)), m):
        if at[-1] - at[0] < m + between and [text[i] for i in at] == template:
            return True
    return False


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d", b"x", b"y"]), max_size=12))
def test_short_templates_against_brute_force(text):
    template = [b"a", b"b", b"c", b"d"]
    got = licenses.near(text, template, 2)
    if got:
        assert [text[i] for i, _ in got] == template and got[-1][0] - got[0][0] < 6 and brute_near(text, template, 2)
    if brute_near(text, template, 0):  # without words between, copies beside it hide nothing
        assert got
    if text.count(b"a") == text.count(b"b") == text.count(b"c") == text.count(b"d") == 1:
        assert bool(got) == brute_near(text, template, 2)


def test_scan_of_short_and_spread_notices(spark):
    rows = {
        1: ("It is released under the permissive MIT License today.", "MIT line"),
        2: ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0 line"),
        3: ("GNU Lesser General Public License, version 3", "LGPL-3.0 line"),
        4: ("released under one two three the MIT License", None),
        5: ("GNU General Public License, version 2 or 3", "GPL-2.0 line"),
        6: (" ".join(x for w in MIT for x in (w.decode(), *["filler"] * 25)), "MIT"),
        7: (None, None),
        8: ("", None),
    }
    docs = spark.createDataFrame([(i, t, "a", 1) for i, (t, _) in rows.items()], "doc_id long, text string, license string, words int")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert {i: r["license"] for i, r in got.items()} == {i: k for i, (_, k) in rows.items()}
    assert got[1]["end_word"] - got[1]["start_word"] == 6 and got[1]["coverage"] == 1.0
    assert licenses.scan(docs, between=0).where("doc_id = 1 and license is null").count() == 1


def test_every_template_finds_itself():
    for k, t in licenses.TEMPLATES.items():
        w = licenses.words(t)
        found = licenses.near([b"zz", *w, *w], w, 0) if len(w) < licenses.SHORT else licenses.best(w, w, 1.0)
        assert len(found) == len(w), k
