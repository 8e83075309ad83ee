import re

import pytest

from samplemill.llm import pii

KEY = b"k"


def kinds(text):
    return [(k, text.encode()[a:b].decode()) for k, a, b, _ in pii.mentions(text.encode())]


@pytest.mark.parametrize(
    "text,found",
    [
        ("re thonnd hein.19@mail5.example.com ining", [("email", "hein.19@mail5.example.com")]),
        ("x eauê.46@mail8.example.com.", [("email", "eauê.46@mail8.example.com")]),
        ("AN!! 233.233.171.252!! B", [("ip", "233.233.171.252")]),
        ("at 152.143.123.131###\nA 1.2.3.4.5 v1.2.3.4", [("ip", "152.143.123.131")]),
        ("den +1 (521) 555-2373 in. +49 30 1234567", [("phone", "+1 (521) 555-2373"), ("phone", "+49 30 1234567")]),
        ("te 4149601755386017 st", [("card", "4149601755386017")]),
        ('token = "11acdfb36bb72224148e6160f674b4be45601bff" an', [("secret", "11acdfb36bb72224148e6160f674b4be45601bff")]),
        ("Mrs. Anna Schmidt met Herr Größe", [("person", "Anna Schmidt"), ("person", "Größe")]),
        ("ssn 123-45-6789 iban DE89 3704 0044 0532 0130 00.", [("ssn", "123-45-6789"), ("iban", "DE89 3704 0044 0532 0130 00")]),
        ("a@b @c d@ 12 nothing 2023-01-02", []),
    ],
)
def test_mentions(text, found):
    assert kinds(text) == found


def test_permutation_and_check_digits():
    for n in (1, 2, 10, 97, 1000):
        assert sorted(pii.permute(KEY, "t", i, n) for i in range(n)) == list(range(n))
    card = "4111111111111111"
    out = pii.surrogate(KEY, "card", card)
    assert pii._luhn(out[:-1] + "0") == int(out[-1]) and out[0] == "4" and out != card
    iban = pii.surrogate(KEY, "iban", "DE89370400440532013000")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert pii.write("phone", "+1 (521) 555-2373", pii.surrogate(KEY, "phone", "+15215552373")).translate(str.maketrans("0123456789", "0" * 10)) == "+0 (000) 000-0000"
    assert pii.surrogate(KEY, "person", "f:anna schmidt").split()[0] in pii.NAMES["latin"]["f"]
    assert re.fullmatch(r"[а-яё]+ [а-яё]+", pii.surrogate(KEY, "person", "m:иван петров").lower())


def test_documents_keep_distinctness_and_coreference(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    forward, back = {}, {}
    rows = pii.replace(docs, KEY).collect()
    assert len(rows) == len(before)
    n = 0
    for r in rows:
        old = pii.mentions(before[r.doc_id].encode())
        assert len(old) == r.n_entities
        raw = before[r.doc_id].encode()
        rest, at = [], 0
        for (kind, a, b, gender), e in zip(old, r.entities, strict=True):
            surface = raw[a:b].decode()
            norm = pii.normal(kind, surface, gender)
            value = pii.normal(kind, e.surrogate, gender)
            assert forward.setdefault((kind, norm), value) == value and back.setdefault((kind, value), norm) == norm and value != norm
            assert surface not in r.text
            rest += [raw[at:a], e.surrogate.encode()]
            at, n = b, n + 1
        assert b"".join([*rest, raw[at:]]).decode() == r.text
    assert n > 50 and not {v for _, v in back} & {v for _, v in forward}


def test_collisions_are_resolved(spark, monkeypatch):
    rows = [(i, f"mail a{i % 3}.{i:02d}@x.org and 12{i:02d}-{i:02d}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.detect(docs)
    out = pii.assign(found, KEY).collect()
    assert len({r.surrogate for r in out}) == len(out) == 40


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "x " * 100000 + "a.b@c.de", 3), (3, "x " * 100000 + "a.b@c.de", 3), (None, "+1 (521) 555-2373", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    out = pii.replace(docs, KEY, keep=("kind",)).collect()
    assert sorted((r.kind, r.n_entities) for r in out) == [(1, 0), (2, 0), (3, 1), (3, 1), (4, 1)]
    assert pii.replace(docs.limit(0), KEY).count() == 0


def test_a_person_keeps_one_name(spark):
    texts = {1: "Mr Smith came. Later Smith called, and SMITH left.", 2: "Mr John Smith and Mrs Jane Smith", 3: "Dr Anna Berg wrote", 4: "Frau Anna Berg schrieb, Anna lachte", 5: "contact: Anna Berg", 6: "Smith and Anna stand here untitled", 7: "Herr Karl Anna Berg"}
    docs = spark.createDataFrame([(i, t, 9, "x") for i, t in texts.items()], "doc_id long, text string, entities int, n_entities string")
    rows = {r[0]: r for r in pii.replace(docs.toDF("doc_id", "text", "a", "b"), KEY, keep=("a", "b")).collect()}
    out = {i: r.text for i, r in rows.items()}
    smith = re.fullmatch(r"Mr (\w+) came\. Later (\w+) called, and (\w+) left\.", out[1]).groups()
    assert smith[0] == smith[1] and smith[2] == smith[0].upper() and smith[0] != "Smith"
    john, s1, jane, s2 = re.fullmatch(r"Mr (\w+) (\w+) and Mrs (\w+) (\w+)", out[2]).groups()
    assert s1 == s2 == smith[0] and john != jane and john in pii.NAMES["latin"]["m"] and jane in pii.NAMES["latin"]["f"]
    anna, berg = re.fullmatch(r"Dr (\w+) (\w+) wrote", out[3]).groups()
    assert out[4] == f"Frau {anna} {berg} schrieb, {anna} lachte" and out[5] == f"contact: {anna} {berg}" and anna in pii.NAMES["latin"]["f"]
    assert out[6] == texts[6] and out[7].split()[2:] == [anna, berg]
    assert [(e.kind, e.start, e.end, e.surrogate) for e in rows[4].entities] == [("person", 5, 14, f"{anna} {berg}"), ("person", 24, 28, anna)] and rows[1].n_entities == 3


def test_given_names_stay_distinct(spark):
    docs = spark.createDataFrame([(i, f"Mr {chr(65 + i % 26)}{'abcdefgh'[i // 26]}x Bolt met Ms {chr(65 + i % 26)}{'abcdefgh'[i // 26]}y Bolt") for i in range(60)], "doc_id long, text string")
    out = [r.text.split() for r in pii.replace(docs, KEY).collect()]
    assert len({t[1] for t in out} | {t[5] for t in out}) == 120 and len({w for t in out for w in (t[2], t[6])}) == 1


def test_many_mentions_take_linear_time():
    text = b" ".join(b"a%d@x.org" % i for i in range(20_000))
    assert len(pii.mentions(text)) == 20_000
