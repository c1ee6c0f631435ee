import random
import re
import time

from pagemill.llm import pii


def luhn(digits):
    numbers = [int(d) for d in digits]
    for i in range(len(numbers) - 2, -1, -2):
        numbers[i] = numbers[i] * 2 - 9 * (numbers[i] > 4)
    return sum(numbers) % 10 == 0


def plain_base(text):
    """The base kinds by the plain expressions."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(s, pii.KINDS[k], e) for s, k, e in sorted(out)]


def test_base_spans_equal_the_plain_expressions():
    draw = random.Random(11)
    for _ in range(6000):
        text = "".join(draw.choices("a1@.+- %4(x\n2é0@.", k=draw.randint(0, 40)))
        assert [(s, pii.KINDS[k], e) for s, k, e in pii.base_spans(text)] == plain_base(text), text
    text = "mail a.b@c.d.e, 10.0.0.255 or 300.1.1.1, 4539 1488 0343 6467, +1 (988) 555-2485 x@y@z.org 1.2.3.4.5.6.7.8"
    assert {k for _, k, _ in plain_base(text)} == {"email", "ip", "card", "phone"}
    assert [(s, pii.KINDS[k], e) for s, k, e in pii.base_spans(text)] == plain_base(text)


def test_long_runs_are_linear():
    start = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "a@" * 200_000, "1 " * 200_000):
        pii.occurrences(text)
    assert time.time() - start < 20


def corpus(spark):
    draw = random.Random(2)
    rows = []
    for i in range(60):
        rows.append((i, f"text {draw.choice('abc')} contact me at u{i}@mail.example.com now", i))
    rows += [(100 + i, f"please contact me at handle-{70_000 + i} now", None) for i in range(5)]
    rows += [(200 + i, f"build number {81_000 + i}-rc of the year", 0) for i in range(30)]
    rows += [(300, None, None), (301, "", 1), (301, "", 1), (None, "me at x@y.org", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long")


def test_patterns_discover_unseen_identifiers(spark):
    docs = corpus(spark)
    accepted = pii.learn_patterns(docs)
    found = pii.find_personal_data(docs, accepted).collect()
    assert len(found) == docs.count()
    spans = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in found}
    assert all(spans[100 + i] == ["id"] for i in range(5))
    assert all(spans[200 + i] == [] for i in range(30))
    assert all(spans[i] == ["email"] for i in range(60))
    assert spans[300] == spans[301] == [] and spans[None] == ["email"]


def test_redaction(spark):
    docs = corpus(spark)
    clean = {r["doc_id"]: r for r in pii.redact_documents(docs, pii.learn_patterns(docs)).collect()}
    assert "[EMAIL]" in clean[3]["text"] and "@" not in clean[3]["text"]
    assert clean[3]["n_chars"] == len(clean[3]["text"])
    assert clean[101]["text"] == "please contact me at [ID] now"
    assert clean[205]["text"] == "build number 81005-rc of the year"
    assert clean[300]["text"] is None and clean[301]["text"] == ""


def test_empty_table(spark):
    docs = corpus(spark).limit(0)
    assert pii.learn_patterns(docs) == []
    assert pii.find_personal_data(docs, []).count() == 0


def test_rare_patterns_are_accepted_beside_any_number_of_others(spark, monkeypatch):
    many = spark.range(600_000).selectExpr("1L pattern", "id + 100 instance", "true seed")
    rare = spark.createDataFrame([(0, i, i < 5) for i in range(6)], "pattern long, instance long, seed boolean")
    monkeypatch.setattr(pii, "pattern_graph", lambda docs: many.unionByName(rare))
    assert pii.learn_patterns(None) == [0, 1]


def test_joined_patterns_give_the_same(spark, monkeypatch):
    docs = corpus(spark)
    accepted = pii.accepted_patterns(docs)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] if "text" in r else r["spans"])
    found = [sorted(f(docs, accepted).collect(), key=key) for f in (pii.find_personal_data, pii.redact_documents)]
    monkeypatch.setattr(pii, "SHARED", 0)
    joined = [sorted(f(docs, accepted).collect(), key=key) for f in (pii.find_personal_data, pii.redact_documents)]
    assert joined == found
    assert any(s["kind"] == "id" for r in joined[0] for s in r["spans"])
