import time

import pytest

from veldra.llm import pii

GIVEN, SUR = ("enka", "ola", "oshi"), ("apuro", "adi", "otrum")
LEXICON = [(a + b, "given") for a in ("Tar", "Vel", "Kir") for b in GIVEN] + [(a + b, "surname") for a in ("Verr", "Pell", "Old") for b in SUR] + [("Orind", "place"), (None, "given")]


@pytest.fixture(scope="module")
def names():
    return pii.NameParts(LEXICON)


@pytest.mark.parametrize(
    "text,want",
    [
        ("Spoke with Mr Zubenka Gammapuro (", ["Zubenka Gammapuro"]), ("cc K. GAMMOTRUM\n", ["K. GAMMOTRUM"]), ("Name: Zubola\nDOB", ["Zubola"]), ("zubenka gammadi ji", ["zubenka gammadi"]), ("Gammapuro, Zuboshi says", ["Gammapuro, Zuboshi"]),
        ("Tarenka H. Gammapuro x", ["Tarenka H. Gammapuro"]), ("a lone Gammapuro here", []), ("Mr Gammapuro Street", []), ("तारओशी वेराडी ने", ["तारओशी वेराडी"]),
    ],
)
def test_parts_with_a_known_ending(names, text, want):
    assert [text[a:b] for a, b, k in pii.find(text, names) if k == "person"] == want


def test_addresses_of_any_length(names):
    far = "near the old " + "very " * 60 + "big tank"
    for text in (f"H.No. 12, 3rd Road, {far}, Orind 848554", "Flat 4, A Road (behind the tank, by Orind School), Orind - 848 554"):
        assert [("At " + text + ". Next")[a:b] for a, b, k in pii.find("At " + text + ". Next", names)] == [text]
    assert pii.find("H.No. 12, 3rd Road. Another sentence has 848554", names) == []


def test_equal_values_are_linked():
    k = b"k"
    phones = [pii.pseudonym(x, "phone", k) for x in ("+91 98765 43210", "09876543210", "98765 43210", "0091 98765-43210")]
    assert len({"".join(c for c in p if c.isdigit())[-10:] for p in phones}) == 1 and phones[0].startswith("+91 ") and phones[1][0] == "0" and "98765" not in phones[2]
    same = lambda kind, *v: len({pii.pseudonym(x, kind, k) for x in v}) == 1
    assert same("email", "a_b [at] post [dot] x [dot] test", "A_b@post.x.test") and not same("email", "ab@post.x.test", "a_b@post.x.test")
    assert same("person", "PELLAPURO, TAROLA", "Tarola Pellapuro") and same("address", "H.No. 1, A Road 848 554", "h no 1 a road 848554")
    assert len(pii.pseudonym("Tarola", "person", k)) == 32


def test_large_lexicon_is_learned_in_linear_time():
    parts = [c + v + d for c in "bcdfghjklmnp" for v in "aeiou" for d in "lmnrst"]
    rows = [(a + b, "given") for a in parts for b in parts[:25]]
    t = time.time()
    names = pii.NameParts(rows)
    assert len(rows) >= 8000 and time.time() - t < 10 and names.of(rows[0][0]) == "given"


def test_scan(spark):
    docs = spark.createDataFrame([(1, "Mr Tarola Oldadi, tel 204.555.0135 since 29/02/2024"), (2, None), (3, "")], "doc_id BIGINT, text STRING")
    lexicon = spark.createDataFrame(LEXICON, "token STRING, kind STRING")
    got = {(r.kind, r.mention): r.pseudonym for r in pii.scan_documents(docs, lexicon, b"k", dates=True).collect()}
    assert set(got) == {("person", "Tarola Oldadi"), ("phone", "204.555.0135"), ("date", "29/02/2024")}
    redacted = {r.doc_id: r.text for r in pii.redact_documents(docs, lexicon, b"k", dates=True).collect()}
    assert redacted[1] == f"Mr [PERSON:{got['person', 'Tarola Oldadi']}], tel [PHONE:{got['phone', '204.555.0135']}] since [DATE:{got['date', '29/02/2024']}]"
    for bad in (lambda: pii.redact_documents(docs, lexicon, b""), lambda: pii.scan_documents(docs, lexicon, dates=True)):
        with pytest.raises(ValueError):
            bad()
