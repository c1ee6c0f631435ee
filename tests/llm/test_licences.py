import random
import re

from pagemill.llm import licences as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_places(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = WORD.findall(lowered)
    places = []
    for phrase, label in L.PHRASES.items():
        parts = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), sorted(places)


def test_matching_statistics_equal_brute_force():
    draw = random.Random(3)
    for _ in range(60):
        sequences = [[draw.choice("abc") for _ in range(draw.randint(1, 9))] for _ in range(draw.randint(1, 4))]
        automaton = L.Automaton(sequences)
        text = [draw.choice("abcd") for _ in range(40)]
        parts = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        got = {at: (state, n) for at, state, n in automaton.statistics(text)}
        for at in range(len(text)):
            want = max((n for n in range(at + 2) if n == 0 or tuple(text[at + 1 - n : at + 1]) in parts), default=0)
            assert got.get(at, (0, 0))[1] == want
            if want:
                state, n = got[at]
                ends = {k for k, s in enumerate(sequences) if len(s) <= n and text[at + 1 - len(s) : at + 1] == s}
                assert {k for k, size in automaton.whole[state] if size <= n} == ends


def test_base_places_equal_plain_search():
    draw = random.Random(5)
    words = "under the mit license apache version 2 cc by nc Under MIT, x (the) 2.0 é".split()
    scanner = L.Scanner()
    for _ in range(300):
        text = draw.choice([" ", "\n"]).join(draw.choice(words) for _ in range(draw.randint(0, 40)))
        found = scanner.scan(text)
        assert (found["n_words"], found["base"]) == plain_places(text)


def test_covered_spans():
    scanner = L.Scanner()
    text = "Foo bar. This work is licensed under the GNU General Public License, version 3. More."
    spans = scanner.scan(text)["spans"]
    assert [s[0] for s in spans] == ["gpl-3"] and spans[0][3] > 0.9
    changed = L.TEMPLATES["mit"][0].replace("free of charge,", "at no cost and with no fee,")
    assert [s[0] for s in scanner.scan("x " + changed)["spans"]] == ["mit"]
    assert [s[0] for s in scanner.scan("Licensed under CC BY-NC 4.0")["spans"]] == ["cc-by-nc"]
    assert scanner.scan("this software and the documentation of the work")["spans"] == []


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "under the MIT license " * 30_000, "c"), (None, "cc by nc", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted(L.scan_licences(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [(r["doc_id"], r["n_words"], len(r["base_starts"])) for r in got] == [
        (1, 0, 0),
        (2, 0, 0),
        (2, 0, 0),
        (3, 120_000, 30_000),
        (None, 3, 1),
    ]
    assert L.scan_licences(docs.limit(0)).count() == 0


def test_whole_licences_and_later_parts():
    from pagemill.llm import licence_texts as T

    scanner = L.Scanner()
    for label, texts in L.WHOLE.items():
        found = scanner.scan("Copyright x y z. " + texts[0])
        best = max(found["spans"], key=lambda s: s[2] - s[1])
        assert best[0] == label and best[2] == found["n_words"] and best[3] > 0.99, (label, found["spans"])
    warranty = T.clauses(T.MIT)[-1]
    spans = scanner.scan("foo " + warranty)["spans"]
    assert [s[0] for s in spans] == ["mit"] and spans[0][1:3] == (1, 1 + len(L.words(warranty))) and 0.3 < spans[0][3] < 0.6
    conditions = " ".join(T.clauses(T.BSD_3)[1:4])
    assert {s[0] for s in scanner.scan(conditions)["spans"]} == {"bsd"}
    opening = scanner.scan(L.TEMPLATES["mit"][0])["spans"]
    assert [s[0] for s in opening] == ["mit"] and opening[0][3] < 0.3
    for label in ("lgpl-3", "lgpl-2.1", "agpl-3", "epl-2", "cc0"):
        assert [s[0] for s in scanner.scan("x " + L.TEMPLATES[label][0])["spans"]] == [label]
    notice = L.TEMPLATES["gpl-3"][0] + ", or (at your option) any later version."
    assert [(s[0], s[3]) for s in scanner.scan("x " + notice)["spans"]] == [("gpl-3", 1.0)]


def test_mere_mentions_give_no_label():
    scanner = L.Scanner()
    for text in (
        "for details see the GNU General Public License",
        "licensed under the apache license",
        "we read the Eclipse Public License version carefully",
        "all rights reserved no part of it",
        "a comparison of the Mozilla Public License and the BSD license with the MIT license",
        "the GNU Lesser General Public License is older than the GNU Affero General Public License",
        "the Creative Commons Attribution International License in its many versions",
        "the public domain and CC0 and the Unlicense",
        "software foundation, redistribution and use of the apache license, version 1.1",
    ):
        assert scanner.scan(text)["spans"] == [], text
    for text, label in (
        ("released under the terms of the MIT license", "mit"),
        ("distributed under the BSD license.", "bsd"),
        ("available under the terms of the Apache License, Version 2.0", "apache-2"),
        ("published under CC BY-SA 4.0", "cc-by-sa"),
        (L.TEMPLATES["gpl-2"][0], "gpl-2"),
        (L.TEMPLATES["gpl-3"][0], "gpl-3"),
    ):
        assert [s[0] for s in scanner.scan("x y " + text)["spans"]] == [label], text


def test_edited_whole_licences_keep_their_label():
    draw = random.Random(6)
    scanner = L.Scanner()
    for label, texts in L.WHOLE.items():
        found = L.words(texts[0])
        remark = [f"note{k}" for k in range(15)]
        third, half = len(found) // 3, len(found) // 2
        at = draw.randrange(third, half)
        repeats = found[:third] + found[third - 6 : third] + found[third:half] + found[half - 6 : half] + found[half:]
        for edited in (
            found[:third] + remark + found[third : 2 * third] + remark + found[2 * third :],
            repeats,
            found[:at] + found[at + len(found) // 5 :],
        ):
            spans = scanner.scan(" ".join(edited))["spans"]
            assert {s[0] for s in spans} == {label}, (label, spans)


def plain_chain(sequence, text, gap, missing, least_match):
    """Words of the heaviest chain, over all common stretches that no longer one contains."""
    ends = []
    automaton = L.Automaton([sequence])
    before = None
    for at, _, matched in automaton.statistics(text):
        if before and not (before[0] == at - 1 and matched == before[1] + 1) and before[1] >= least_match:
            ends.append(before)
        before = (at, matched)
    if before and before[1] >= least_match:
        ends.append(before)
    spots = []
    for at, m in ends:
        words = text[at - m + 1 : at + 1]
        spots += [(at - m + 1, p, m) for p in range(len(sequence) - m + 1) if sequence[p : p + m] == words]
    best = {}
    for k, (start, place, m) in enumerate(spots):
        follows = [
            best[j] for j, (s, p, n) in enumerate(spots[:k])
            if s + n <= start and p + n <= place and start - s - n <= gap and place - p - n <= missing
        ]
        best[k] = m + max(follows, default=0)
    return max(best.values(), default=0)


def test_chains_equal_plain_dynamic_programming():
    draw = random.Random(9)
    for _ in range(300):
        sequence = [draw.choice("abcdef") for _ in range(draw.randrange(13, 40))]
        text = []
        for _ in range(draw.randrange(1, 7)):
            a = draw.randrange(len(sequence))
            text += sequence[a : a + draw.randrange(3, 15)] + [draw.choice("abcxyz") for _ in range(draw.randrange(0, 6))]
        layer = L.Layer({"x": (" ".join(sequence),)}, gap=5, missing=9, covered=0.0)
        reached = []
        closed = layer.chains(layer.matches(text, reached))
        want = plain_chain(sequence, text, 5, 9, L.LEAST_MATCH)
        assert max((-c[0] for c in closed), default=0) == want, (sequence, text)
