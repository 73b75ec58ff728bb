import random

from auditloom.llm import license_scan
from auditloom.llm.license_scan import TEMPLATES, Scanner, SuffixAutomaton
from tests.llm.cases import docs, plain, prose


def brute_matches(words, seqs, least):
    """Matches by trying every substring: at each end the longest suffix that is in a sequence, kept if the next word doesn't lengthen it."""
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    longest = [next((n for n in range(i, 0, -1) if tuple(words[i - n : i]) in subs), 0) for i in range(len(words) + 1)]
    out = []
    for i in range(1, len(words) + 1):
        n = longest[i]
        if n >= least and (i == len(words) or longest[i + 1] != n + 1):
            out.append((i - n, i))
    return out


def test_automaton_against_every_substring():
    rng = random.Random(2)
    for _ in range(150):
        seqs = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(3)]
        words = [rng.choice("abcd") for _ in range(30)]
        sam = SuffixAutomaton(seqs)
        got = sam.matches(words, 2)
        assert [(s, e) for s, e, _ in got] == brute_matches(words, seqs, 2)
        for s, e, v in got:
            want = {(k, i + e - s) for k, q in enumerate(seqs) for i in range(len(q)) if q[i : i + e - s] == words[s:e]}
            assert set(sam.ends[v]) == want


def test_every_template_is_found_in_prose():
    scanner = Scanner()
    for name, template in TEMPLATES.items():
        before, after = prose(1, 30), prose(2, 30)
        text = f"{before} {template} {after}"
        got = scanner.spans(text)
        assert len(got) == 1 and got[0][2] == name and got[0][4] == 1.0, (name, got)
        assert text[got[0][0] : got[0][1]].split()[0] == template.split()[0]


def test_edited_text_is_chained_and_short_matches_are_not_reported():
    words = TEMPLATES["MIT-text"].split()
    for k in range(10, len(words), 25):
        words[k] = "EDITED"
    got = Scanner().spans(" ".join(words))
    assert [x[2] for x in got] == ["MIT-text"] and 0.85 < got[0][4] < 1
    assert Scanner().spans("the rights to use the software without any of it, and permission is not given") == []
    assert Scanner().spans(prose(3, 5000)) == []


def test_other_versions_and_variants_are_not_taken_for_a_template():
    names = lambda text: [x[2] for x in Scanner().spans(text)]
    assert names("This work is licensed under the GNU General Public License, version 2") == ["GPL-2.0"]
    for text in ("Licensed under the Apache License, Version 1.1", "licensed under CC BY-ND 4.0", "Licensed under the ISC License"):
        assert names(text) == [], text
    header = TEMPLATES["Apache-2.0-header"].replace("language", "EDITED")
    assert names(header) == ["Apache-2.0-header"]  # not cut to the line that is complete inside it
    long = {"a": " ".join("abcdefghijklmnopqrst"), "b": " ".join("cdefghijklmnz")}
    assert [x[2] for x in Scanner(long).spans("a b c d e f g h i j k l m n z")] == ["b"]


def test_all_cases(spark):
    assert license_scan.scan(docs(spark)).count() == 0
    data = [(1, prose(1, 20_000) + " " + TEMPLATES["ISC"]), (1, TEMPLATES["ISC"]), (None, TEMPLATES["ISC"]), (2, None), (3, "")]
    got = license_scan.scan(plain(spark, data)).collect()
    assert sorted((r.doc_id or 0, r.license) for r in got) == [(0, "ISC"), (1, "ISC"), (1, "ISC")]
    assert license_scan.scan(docs(spark, [])).count() == 0


def _words(name):
    return TEMPLATES[name].split()


def test_long_templates_are_chained_over_edits():
    mit = _words("MIT-text")
    edited = mit[:40] + ["kindly"] * 5 + mit[40:90] + mit[94:]  # five words put in, four left out
    text = f"preface words here {' '.join(edited)} and code"
    (s, e, name, covered, share), = [x for x in Scanner().spans(text) if x[2] == "MIT-text"]
    n = len(Scanner().seqs[Scanner().names.index("MIT-text")])
    assert text[s:e].startswith("Permission is hereby granted") and text[s:e].endswith("SOFTWARE") and n - 6 <= covered < n and share > 0.9


def test_pieces_too_far_apart_are_not_one_span():
    mit, far = _words("MIT-text"), ["word"] * 60
    thirds = [mit[:55], mit[55:110], mit[110:]]
    text = " ".join([*thirds[0], *far, *thirds[1], *far, *thirds[2]])
    assert not [x for x in Scanner().spans(text) if x[2] == "MIT-text"]


def test_every_full_template_is_found_whole_and_alone():
    for name in ("BSD-2-Clause", "Zlib", "BSL-1.0", "MIT-text", "MPL-2.0", "GPL-3.0-or-later", "Apache-2.0-header"):
        text = "x y z " + " ".join(_words(name)) + " the end"
        got = Scanner().spans(text)
        assert [(x[2], x[4]) for x in got] == [(name, 1.0)], name


def test_equal_cover_goes_to_the_first_name():
    scanner = Scanner({"b": "one two three four five six", "a": "one two three four five six"})
    assert [x[2] for x in scanner.spans("zero one two three four five six seven")] == ["a"]
