import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import pii


def kinds(text):
    return {(s.kind, text[s.start : s.end]) for s in pii.form_spans(text)}


FOUND = [
    ("Write to jo.doe+x@mail.example now", "email", "jo.doe+x@mail.example"),
    ("jo [at] mail [dot] example.", "email", "jo [at] mail [dot] example"),
    ("jo (at) team.mail.test,", "email", "jo (at) team.mail.test"),
    ("mail jo at mail dot example please", "email", "jo at mail dot example"),
    ("Call (303) 555-0146.", "phone", "(303) 555-0146"),
    ("Call 1-800-555-0119 ext. 12", "phone", "1-800-555-0119 ext. 12"),
    ("+49 (0)30 23125-127", "phone", "+49 (0)30 23125-127"),
    ("ruf 030/23125844 an", "phone", "030/23125844"),
    ("01 99 00 05 96", "phone", "01 99 00 05 96"),
    ("SSN 939-36-4623.", "id_number", "939-36-4623"),
    ("National Insurance no. QQ 14 59 04 C into", "id_number", "QQ 14 59 04 C"),
    ("Personalausweis LZ00Y9406.", "id_number", "LZ00Y9406"),
    ("numéro de sécurité sociale 9 99 53 99 793 754 79 et", "id_number", "9 99 53 99 793 754 79"),
    ("at Flat 8, 28 Millrace Road, Xtown", "street_address", "Flat 8, 28 Millrace Road"),
    ("Lindkampstraße 74, 00264", "street_address", "Lindkampstraße 74"),
    ("82 rue des Tisserands, 00624", "street_address", "82 rue des Tisserands"),
    ("92 OLDGATE STREET, then", "street_address", "92 OLDGATE STREET"),
]
NOTHING = [
    "git@39: not an address, just a label.", "pkg@1.29.2 for now", "@dataclass stays", "Build 20255305.94 beats build 20255306.94.", "uuid 00000000-0000-4000-8000-000000012122", "Run 2025-03-06 14:22:10 with 1,204,24 rows",
    "See chunk 17 of 517, offset 10017-20017.", "Ratio 3.1415980, seed 4280007", "Lane 3 of the pipeline and room 51 are empty.", "Harbour Street is only a dataset name.", "  3  Harbour Street is", "During 12 runs", "the passport was lost", "",
]


@pytest.mark.parametrize("text,kind,value", FOUND)
def test_forms(text, kind, value):
    assert kinds(text) == {(kind, value)}


@pytest.mark.parametrize("text", NOTHING)
def test_no_forms(text):
    assert kinds(text) == set()


@given(st.text("0123456789", min_size=2, max_size=20))
def test_permutation_is_undone(digits):
    out = pii.permuted_digits(digits)
    assert len(out) == len(digits) and out.isdigit() and pii.restored_digits(out) == digits


def test_permutation_is_one_to_one():
    assert len({pii.permuted_digits(f"{i:03d}") for i in range(1000)}) == 1000
    assert pii.permuted_digits("123456", b"a") != pii.permuted_digits("123456", b"b")


def test_placeholders():
    text = "Call (303) 555-0146 or (303) 555-0146, DNI 00000000-T; x"
    out = pii.redacted(text, pii.form_spans(text))
    a, b = [p.split("]")[0] for p in out.split("[PHONE ")[1:]]
    assert a == b and a != "(303) 555-0146" and len(a) == len("(303) 555-0146")
    assert out.startswith("Call [PHONE (") and out.endswith("; x")
    ident = out.split("[ID_NUMBER ")[1].split("]")[0]
    assert pii._DNI_LETTERS[int(ident[:8]) % 23] == ident[9]


def test_names_are_learned(spark):
    texts = [(f"r{i}", f"I met Amber Veldring and then Jorund Tamsik. The garden was {w}.") for i, w in enumerate(["wet"] * 6)]
    texts += [("u1", "I met Zoltan Veldring."), ("u2", "I met Zoltan Tamsik."), ("u3", "TAMSIK, JORUND signed"), ("u4", "Herr Veldring left."), ("u5", "Amber asked. The garden"), ("u6", "the Jorund protocol"), ("u8", "Jorund A. van der Tamsik"), ("n", None), ("e", "")]
    df = spark.createDataFrame([("drawers", *t) for t in texts], "record_table string, record_id string, content string")
    given_names = spark.createDataFrame([("Amber",), ("Jorund",), (None,)], "given_name string")
    got = {r.record_id for r in pii._confirmed(pii.scan(df), given_names).collect()}
    assert got == {f"r{i}" for i in range(6)} | {"u1", "u2", "u3", "u8"}


def test_empty_and_redaction(spark, sf):
    df = spark.createDataFrame([], "record_table string, record_id string, content string")
    assert pii.scan(df).filter("pii_type is not null").count() == 0
    out = pii.p3_redacted(spark, sf)
    plain = pii.record_texts(spark, sf).dropDuplicates()
    assert out.count() == plain.count()
    assert out.filter(F.col("content").contains("[EMAIL ")).count() > 0
