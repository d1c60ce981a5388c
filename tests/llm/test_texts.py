import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veldra.llm import mixing, pii, tokens
from veldra.storage import Scratch

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library_s(reference, text):
    enc = tokens.encoder(tokens.vocabulary_folder())
    assert enc.encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_long_texts_and_special_strings(reference):
    enc = tokens.encoder(tokens.vocabulary_folder())
    for text in ("ab" * 4000, "<|endoftext|> a", " \n\n \t x", "नमस्ते दुनिया " * 200, "1234567890" * 300, "aaaaaaaab" * 500):
        assert enc.encode(text) == reference.encode(text, add_special_tokens=False).ids


def test_documents(spark, reference):
    docs = spark.createDataFrame([(1, "Hello world", 1), (2, "", 1), (3, None, 1), (1, "Hello world", 1), (None, " ", 1)], "doc_id BIGINT, text STRING, ids INT")
    got = [(r.doc_id, list(r.ids)) for r in tokens.encode_documents(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, reference.encode("Hello world").ids), (2, []), (3, []), (1, reference.encode("Hello world").ids), (None, reference.encode(" ").ids)], key=str)
    got = {r.doc_id: list(r.ids) for r in tokens.encode_documents(docs, null_ids=(50256,), empty_ids=(50256, 50256)).collect()}
    assert got[3] == [50256] and got[2] == [50256, 50256]
    assert tokens.encode_documents(docs.limit(0)).count() == 0


def test_raking_meets_the_margins():
    cells = [("a", "en", "x", 900.0), ("a", "hi", "x", 100.0), ("b", "en", "x", 50.0), ("b", "hi", "y", 50.0), ("c", "en", "y", 0.0), ("d", "en", "y", 70.0)]
    fit = mixing.rake(cells, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 3, "c": 2})
    got = {s: sum(fit.weights[k] * n for *k_, n in cells for k in [tuple(k_)] if k in fit.weights and k[0] == s) for s in "ab"}
    assert abs(got["a"] / got["b"] - 0.5 / 0.4) < 1e-6 and all(w <= 3 + 1e-9 for w in fit.weights.values())
    assert mixing.rake([], {}, {}).weights == {} and mixing.rake(cells, {"z": 1.0}, {"z": 1}).total == 0


def test_mixture(spark):
    rows = [(i, "Label box number %d is fine" % i, "en", "Big-Source") for i in range(400)] + [(1000 + i, "टिकट %d" % i, "hi", "small source ") for i in range(60)] + [(2000, None, None, None), (2001, "x", None, "unlisted"), (2002, "", "en", "BIG_SOURCE")]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING")
    targets = spark.createDataFrame([("big_source", 0.6, 1), ("small_source", 0.3, 2), ("absent", 0.1, 4)], "source STRING, target_share DOUBLE, max_repeats INT")
    sample, report = mixing.draw(docs, targets, Scratch(spark, "t"))
    r = {x.source: x for x in report.collect()}
    assert abs(r["big_source"].actual_share - 2 / 3) < 0.02 and abs(r["small_source"].actual_share - 1 / 3) < 0.02 and r["absent"].drawn_tokens == 0
    assert r["small_source"].most_copies <= 2 and r["big_source"].most_copies == 1
    assert sample.where("copies > 2 or doc_id >= 2000").count() == 0
    again, _ = mixing.draw(docs.repartition(5), targets, Scratch(spark, "t"))
    assert again.exceptAll(sample).count() == 0
    sample, report = mixing.draw(docs.limit(0), targets, Scratch(spark, "t"))
    assert sample.count() == 0 and {x.drawn_tokens for x in report.collect()} == {0}
    sample, report = mixing.draw(docs, targets.limit(0), Scratch(spark, "t"))
    assert sample.count() == report.count() == 0


LEXICON = [(a + b, "given") for a in ("Tar", "Vel", "Kir") for b in ("enka", "ola", "oshi")] + [(a + b, "surname") for a in ("Verr", "Pell", "Old") for b in ("apuro", "adi", "otrum")] + [("Orind", "place"), (None, "given")]


@pytest.fixture(scope="module")
def names():
    return pii.NameParts(LEXICON)


@pytest.mark.parametrize(
    "text,want",
    [
        ("cc kiru.verr+x@mail.a-b.example. Next", [("email", "kiru.verr+x@mail.a-b.example")]), ("to a_b [at] post [dot] x [dot] test!", [("email", "a_b [at] post [dot] x [dot] test")]), ("a1 @ b.test pe", [("email", "a1 @ b.test")]),
        ("about v8@2x assets, @tray_bot", []), ("call (+91) 528 421 3673, or +1 (204) 555-0131.", [("phone", "(+91) 528 421 3673"), ("phone", "+1 (204) 555-0131")]), ("(+915312592495);", [("phone", "+915312592495")]),
        ("tel ०५०६४२ ०३५४१", [("phone", "०५०६४२ ०३५४१")]), ("Help 5533983675\nRows 3", [("phone", "5533983675")]), ("at epoch 1724052581. row 1730566383 of the trace", []), ("Job a-1 wrote 810299399441 bytes", []),
        ("No. 9707-1607-5344, 3292 1305 6314", [("id_number", "9707-1607-5344"), ("id_number", "3292 1305 6314")]), ("XXXX XXXX 3172 1234567890123456789", []), ("Nurnber: 2806 3654 6687\n1063 x", [("id_number", "2806 3654 6687")]), ("1234 5678 9012 3456", []), ("Rig serial SVGPJ1836S", []), ("Format hint: AAAPA0000A", []),
        ("rjmpv4682l and QX08 20183152005; ZK-08-1995-1568249", [("id_number", "rjmpv4682l"), ("id_number", "QX08 20183152005"), ("id_number", "ZK-08-1995-1568249")]),
        ("at H.No. 169/4, A Road, near Orind Tank,\nX - 848554.", [("address", "H.No. 169/4, A Road, near Orind Tank,\nX - 848554")]), ("Unit 2, Dock Lane Annex. Ghar ka pata 152 Shevon Galli, V 420209 hai", [("address", "152 Shevon Galli, V 420209")]),
        ("Mr Tarenka B. Oldadi-Verrapuro (", [("person", "Tarenka B. Oldadi-Verrapuro")]), ("S/O K. PELLADI\n", [("person", "K. PELLADI")]), ("name reads Veloshi Oldotrum. A stamp", [("person", "Veloshi Oldotrum")]),
        ("PELLAPURO, TAROLA x", [("person", "PELLAPURO, TAROLA")]), ("(kirola kiroshi oldadi, E-3/7, Orind Colony, V 599 372)", [("person", "kirola kiroshi oldadi"), ("address", "E-3/7, Orind Colony, V 599 372")]), ("near Orind Street", []), ("", []),
    ],
)
def test_mentions(names, text, want):
    assert [(k, text[a:b]) for a, b, k in pii.find(text, names)] == want


def test_pseudonyms_keep_format_and_link_equal_values():
    k = b"k"
    a, b = pii.pseudonym("9707-1607-5344", "id_number", k), pii.pseudonym("9707 1607 5344", "id_number", k)
    assert a.replace("-", "") == b.replace(" ", "") != "970716075344" and a[4] == "-" and a != pii.pseudonym("9707-1607-5344", "id_number", b"other")
    assert pii.pseudonym("abcpk1234f", "id_number", k).upper() == pii.pseudonym("ABCPK1234F", "id_number", k)
    assert pii.pseudonym("+९१ ५०", "phone", k)[0] == "+" and "०" <= pii.pseudonym("+९१ ५०", "phone", k)[1] <= "९"
    f = pii.Feistel(k, "t", 1000)
    assert sorted(map(f.permute, range(1000))) == list(range(1000)) and all(f.inverse(f.permute(x)) == x for x in range(1000))
    d = pii.pseudonym_date("29/02/2024", k)
    assert d != "29/02/2024" and datetime.datetime.strptime(d, "%d/%m/%Y") and pii.pseudonym_date("31/02/2024", k) is None


def test_redacted_documents(spark):
    docs = spark.createDataFrame([(1, "Mr Tarola Oldadi, tel 204.555.0135, é ok 1-2-1999"), (2, None), (3, ""), (4, "x" * 200_000 + " Tarola Oldadi")], "doc_id BIGINT, text STRING")
    lexicon = spark.createDataFrame(LEXICON, "token STRING, kind STRING")
    r = {x.doc_id: x.text for x in pii.redact_documents(docs, lexicon, b"k").collect()}
    assert r[1].startswith("Mr [PERSON:") and "204.555.0135" not in r[1] and r[1].endswith(", é ok 1-2-1999") and r[2] is None and r[3] == "" and r[4].startswith("x" * 1000)
    got = {(x.doc_id, x.kind, x.mention) for x in pii.find_mentions(docs, lexicon).collect()}
    assert got == {(1, "person", "Tarola Oldadi"), (1, "phone", "204.555.0135"), (4, "person", "Tarola Oldadi")}
    assert pii.find_mentions(docs.limit(0), lexicon).count() == 0 and pii.find_mentions(docs, lexicon.limit(0)).count() == 1
