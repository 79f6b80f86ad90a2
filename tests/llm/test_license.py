import re

from tests.llm import fixtures
from tagweave.llm import license_scan as ls

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in ls.BASE:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


CASES = [
    "Licensed under CC BY-NC 4.0.", "mit license mit license MIT\n License", "the GNU  General-Public license and Apache License, cc BY", "summit license",
    "gnu general publik license here", "Released under teh MIT Licens", "apache licence version 2.0", "nothing to see", "ccby", "mit", "é mit license",
    "Permission is hereby granted, free of charge, to any persen obtaining a copy", "all rigths reserved",
]


def test_base_matches_brute_force():
    wanted = ls.notices()
    for t in CASES + fixtures.texts():
        assert ls.scan(t, wanted)[:5] == slow(t)


def edits(a, b):
    """Least edits between a and b."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def matches(n, words):
    """(edits, first, end) of all windows of whole words that are the notice within its edits and have its telling words."""
    out = []
    for i in range(len(words)):
        for j in range(i + 1, len(words) + 1):
            window = " ".join(words[i:j])
            if len(window) > len(n.text) + n.edits:
                break
            if len(window) < len(n.text) - n.edits:
                continue
            own = words[i:j] + [a + b for a, b in zip(words[i:j], words[i + 1 : j])]
            if all(any(edits(w, t) <= max(1, len(t) // 3) for w in own) for t in n.text.split() if t not in ls.FUNCTION_WORDS):
                if (e := edits(n.text, window)) <= n.edits:
                    out.append((e, i, j))
    return out


def test_fuzzy_matches_edit_distance():
    """A notice is found exactly where the edit distance of whole words allows it, whatever the seeds."""
    wanted = ls.notices()
    import random

    r = random.Random(4)
    for n in wanted:
        for _ in range(5):
            s = list(n.text)
            for _ in range(r.randint(0, n.edits + 2)):
                k = r.randrange(len(s))
                s[k : k + 1] = r.choice([[], [s[k], "x"], ["y"], [" "], [s[k], " "]])
            words = WORD.findall("some words " + "".join(s) + " and more")
            want = matches(n, words)
            found = ls.fuzzy_spans(" ".join(words).encode(), [n])
            assert bool(found) == bool(want), words
            assert min((x[3] for x in found), default=None) == min((x[0] for x in want), default=None)


def test_words_that_tell_notices_apart_are_not_edited_away():
    wanted = ls.notices()
    for text, labels in [
        ("GNU Lesser General Public License v3", "lgpl"), ("GNU Affero General Public License", "agpl"), ("The general public license of the city", ""),
        ("Library General Public License", ""), ("gnu library general public license", "lgpl"), ("the gnu general public licence", "gpl"), ("gnus general public license", "gpl"),
        ("the common public license and the mozila public license", "cpl,mpl"), ("Eclipse Distribution License", "edl"), ("wit license", ""), ("european union public license", "eupl"),
        ("the boast software license", "bsl-1.0"), ("our open hardware license", ""), ("ungnu generally public licenses", ""),
    ]:
        assert ls.scan(text, wanted)[5] == labels, text


def test_many_seeds_take_little():
    import time

    wanted = ls.notices()
    text = " ".join(f"public licen{i % 7} general{i}" for i in range(20_000))
    began = time.process_time()
    ls.scan(text, wanted)
    assert time.process_time() - began < 6


def test_labels():
    wanted = ls.notices()
    got = {t: ls.scan(t, wanted) for t in CASES}
    assert got["gnu general publik license here"][4:7][:2] == ("", "gpl")
    assert got["Released under teh MIT Licens"][5] == "mit"
    assert got["apache licence version 2.0"][4:6] == ("", "apache")
    assert got["nothing to see"][3:7] == (None, "", "", 0.0)
    assert got["all rigths reserved"][5] == "all-rights-reserved"
    assert got["Licensed under CC BY-NC 4.0."][4:7] == ("cc-by", "cc-by", 1.0)
    assert got["Licensed under CC BY-NC 4.0."][7][0][:4] == ("cc-by", 0, 4, 0)
    spans = got["gnu general publik license here"][7]
    assert spans == [("gpl", 0, 4, 1, "gnu general publik license")]


def test_table(spark):
    docs = fixtures.docs(spark)
    got = ls.scan_licenses(docs).collect()
    assert sorted([tuple(r)[:6] for r in got], key=str) == sorted([(r[0], *slow(r[1])) for r in fixtures.rows()], key=str)
    assert ls.scan_licenses(fixtures.empty(spark)).collect() == []


def test_places_are_found_in_proportion():
    import time

    def took(n):
        began = time.process_time()
        got = ls.scan("mit license " * n, ls.notices())
        assert got[:4] == (2 * n, n, 0, 2 * n - 2)
        return time.process_time() - began

    small, large = took(10_000), took(80_000)
    assert large < 20 * small + 0.5


def test_every_notice_within_its_edits_is_labelled():
    """Labels against all windows of whole words; spans name the words they cover."""
    import random

    r, wanted = random.Random(7), ls.notices()
    for t in fixtures.texts(9, 10):
        for n in r.sample(wanted, 3):
            s = list(n.text)
            for _ in range(r.randint(0, n.edits + 1)):
                s[r.randrange(len(s))] = r.choice(["", "q", " "])
            t = (t or "") + " " + "".join(s) + " " + r.choice(["", n.text])
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))[-60:]
        every = [(n.label, i, j, 1 - e / len(n.text)) for n in wanted for e, i, j in matches(n, words)]
        got = ls.scan(" ".join(words), wanted)
        labels = set(filter(None, got[5].split(",")))
        assert labels - set(filter(None, got[4].split(","))) <= {x[0] for x in every}
        # a label that is missing only matched inside a better match of another one
        for label, i, j, like in every:
            assert label in labels or any(o != label and a <= i and z >= j and l >= like for o, a, z, l in every), (label, words[i:j])
        for label, first, end, e, text in got[7]:
            assert text == " ".join(words[first:end])


def test_a_match_after_another_is_kept():
    twice = "all rights reserved all rights reserved. all rights reserve"
    assert [s[1:4] for s in ls.scan(twice, ls.notices())[7] if s[0] == "all-rights-reserved"] == [(0, 3, 0), (3, 6, 0), (6, 9, 1)]
