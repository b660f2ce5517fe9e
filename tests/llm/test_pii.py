import re

from hypothesis import given, settings
from hypothesis import strategies as st

from listwarden.llm import pii


def _luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    """Base spans by the patterns as stated."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and _luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [f"{kind}:{m.start()}:{m.end()}" for kind, rule, ok in rules for m in re.finditer(rule, text) if ok(m[0])]


TEXTS = [
    None, "", "mail a.b@c.de, x@y@z.com and a@b.c+d@e.f.g @x.y", "😀 ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 001.2.3.255", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 4111111111111111",
    "call +49 (30) 123.456-7 or +1 2 or +1234567890123456", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 DE89370400440532013001",
    "my ssn is 123-45-6789", "part 123-45-6789", "9" * 50_000, "1 " * 50_000, "a" * 100_000 + "@", "a.b@c" + ".d" * 30_000, "1." * 30_000, "+1 " * 20_000, "a@b.c " * 2_000,
]


def test_base_spans_equal_the_stated_patterns(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate([*TEXTS, TEXTS[2]])], "doc_id long, text string, spans string, kind int")
    got = {r.doc_id: r for r in pii.detect(docs).collect()}
    for k, text in enumerate([*TEXTS, TEXTS[2]]):
        base = [f"{s.kind}:{s.start}:{s.end}" for s in got[k].found if s.kind in pii.BASE]
        assert base == plain(text or ""), k
        assert [got[k][f"n_{kind}"] for kind in pii.BASE] == [sum(s.startswith(kind) for s in base) for kind in pii.BASE]
    added = [[s.kind for s in got[k].found if s.kind not in pii.BASE] for k in (6, 7, 8)]
    assert added == [["iban", "iban"], ["ssn"], []]
    near, plain_score = got[4].found[0].score, pii.KINDS["card"][2]
    assert near > plain_score


def test_random_texts(spark):
    found = []

    @settings(max_examples=400, deadline=None, database=None)
    @given(st.text(alphabet="a.@+-1925 (é", max_size=40))
    def draw(text):
        found.append(text)

    draw()
    docs = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    for r in pii.detect(docs).collect():
        assert [f"{s.kind}:{s.start}:{s.end}" for s in r.found if s.kind in pii.BASE] == plain(found[r.doc_id]), found[r.doc_id]


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é a@b.co, +49 30 1234567!", "k"), (2, None, "k")], "doc_id long, text string, found string")
    got = pii.redact(docs)
    assert got.columns == docs.columns and [r.text for r in got.orderBy("doc_id").collect()] == ["é <email>, <phone>!", None]


def test_empty_table(spark):
    assert pii.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0
