import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from loomspan.llm import pii
from loomspan.llm import pseudonyms as p

KEY = b"a key of the tests"


@pytest.mark.parametrize("n", [2, 3, 97, 1000])
def test_a_permutation_and_its_inverse(n):
    out = [p.permuted(i, n, KEY) for i in range(n)]
    assert sorted(out) == list(range(n)) and [p.permuted(i, n, KEY, back=True) for i in out] == list(range(n))
    assert n < 97 or out != [p.permuted(i, n, b"other") for i in range(n)]


def test_spellings_of_one_number_are_linked():
    digits = lambda v: re.sub(r"\D", "", p.phone_number(v, KEY))
    assert len({digits(v)[-10:] for v in ["+1 481 203 9922", "(481) 203-9922", "1-481-203-9922", "481.203.9922"]}) == 1
    assert len({digits(v).lstrip("0")[-10:] for v in ["+49 (0)30 23125127", "030/23125127", "0049 30 23125127"]}) == 1


@given(st.from_regex(r"[2-9]\d\d[2-9]\d{6}", fullmatch=True))
def test_numbers_stay_valid(number):
    number = "".join(str(int(c)) for c in number)
    out = p.phone_number(f"+1 ({number[:3]}) {number[3:6]}-{number[6:]}", KEY)
    assert re.fullmatch(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", out)


def test_check_characters_are_right():
    for i in range(200):
        dni = p._dni(f"{i * 48_271 % 10**8:08d}A")
        assert p._dni(p.identity_number(dni, KEY)) == p.identity_number(dni, KEY) != dni
        tax = p._tax_id(f"{10**9 + i * 69_621:010d}0")
        assert p._tax_id(p.identity_number(tax, KEY)) == p.identity_number(tax, KEY)
        nir = p._nir(f"1{i % 100:02d}{i % 12 + 1:02d}{i * 7919 % 10**8:08d}00")
        out = p.identity_number(nir, KEY)
        assert p._nir(out) == out and 1 <= int(out[3:5]) <= 12 and out[0] in "12"
        card = p._luhn(f"4{i * 65_537:014d}0")
        assert p._luhn(p.payment_card(card, KEY)) == p.payment_card(card, KEY)
        account = p._iban(f"DE00{i:018d}")
        assert p._iban(p.iban(account, KEY)) == p.iban(account, KEY)
        ssn = p.identity_number(f"{i + 1:03d}-{i % 99 + 1:02d}-{i + 1:04d}", KEY)
        assert p._ssn(ssn.replace("-", ""))
    assert p.payment_card("4111 1111 1111 1112", KEY) is None and p.iban("DE88 3704 0044 0532 0130 00", KEY) is None and p.date("31.02.1985", KEY) is None


def test_no_letter_or_digit_is_kept_by_rule():
    outs = [p.identity_number(f"{a}{b} 12 34 56 {c}", KEY) for a in "ABQ" for b in "QRS" for c in "ABCD"]
    assert len(set(outs)) == len(outs) and all(re.fullmatch(r"[A-Z]{2} \d\d \d\d \d\d [A-D]", x) for x in outs)
    assert len({x[:2] for x in outs}) > 20
    a, b = p.identity_number("LZ00Y9406", KEY), p.identity_number("LZ 00Y-9406", KEY)
    assert a == re.sub(r"[ -]", "", b)


def test_dates_are_days():
    days = {p.date(f"{1950 + i % 60}-{i % 12 + 1:02d}-{i % 28 + 1:02d}", KEY) for i in range(400)}
    assert all(re.fullmatch(r"(19|20)\d\d-[01]\d-[0-3]\d", d) for d in days)
    iso, dotted = p.date("1985-02-28", KEY), p.date("28.02.1985", KEY)
    assert iso.split("-") == dotted.split(".")[::-1]


def test_disguised_addresses():
    for text in ["mail john dot doe at example dot com now", "mail john.doe (at) example ( dot ) com now", "mail john.doe [ at ] example.com now"]:
        out = pii.redacted(text, pii.form_spans(text), KEY)
        assert re.fullmatch(r"mail \[EMAIL [0-9a-f]{8}\] now", out)
    tags = {pii.pseudonym(v, "email", KEY) for v in ["jo@mail.example", "jo [at] mail [dot] example", "JO (at) mail.example", "jo at mail dot example"]}
    assert len(tags) == 1


def test_more_kinds_on_demand():
    text = "born on 1985-02-28, card 4111 1111 1111 1111, account DE89 3704 0044 0532 0130 00."
    assert [s.kind for s in pii.form_spans(text, True)] == ["birth_date", "payment_card", "iban"]
    assert not {"birth_date", "payment_card", "iban"} & {s.kind for s in pii.form_spans(text)}


def test_the_key_is_the_sessions(spark, sf):
    spark.conf.set(pii.KEY_SETTING, "one")
    try:
        assert pii.key_of(spark) == b"one"
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert pii.key_of(spark) == pii.KEY
    a, b = ({r.record_id: r.content for r in pii.p3_redacted(spark, sf, key=k).collect()} for k in (b"x", b"y"))
    assert a.keys() == b.keys() and a != b
