"""Spans of personal data beyond the base kinds."""

import pytest

from binomia.llm.pii import IBAN_LENGTHS, KINDS, Finder, _iban

LONG = "Donaudampfschifffahrtsgesellschaftskapitänswitwenvereinigungsvorsitzende"


def found(text, kind):
    return [text[start:end] for start, k, end in Finder().spans(text) if KINDS[k] == kind]


def number(country, spaced=False):
    """A valid account number: the check digits follow from the rest."""
    rest = "".join(str(k % 10) for k in range(1, IBAN_LENGTHS[country] - 3))
    plain = next(c for n in range(2, 99) if _iban(c := f"{country}{n:02d}{rest}"))
    return " ".join(plain[k : k + 4] for k in range(0, len(plain), 4)) if spaced else plain


@pytest.mark.parametrize("country", sorted(IBAN_LENGTHS))
def test_account_numbers_end_where_the_country_says(country):
    for value in (number(country), number(country, True)):
        for text in (value, f"pay {value} CODE", f"({value}), X", f"{value} 12"):
            assert found(text, "iban") == [value]
        assert found(value + "7", "iban") == found("A" + value, "iban") == found(value[:-1], "iban") == []
        wrong = value[:-1] + str((int(value[-1]) + 1) % 10)
        assert found(wrong, "iban") == []


def test_cues_in_any_case():
    for cue in ("passWord", "PASSWORD", "Api_Key", "aPIkEY"):
        assert found(f"İ {cue}: hunter22 end", "secret") == ["hunter22"]
    assert found("My AcCoUnT number is 12345678.", "account") == ["12345678"]
    assert found("akia" + "A" * 16, "secret") == [] and found("AKIA" + "A" * 16, "secret") == ["AKIA" + "A" * 16]


def test_addresses_of_any_length():
    for text in ("12 Main Street", f"12b {LONG} Road", f"7 {LONG} {LONG} {LONG} {LONG} AVENUE", "99999 O'Neil St. Mary Road"):
        assert found(f"at {text}, x", "street") == [text]
    assert found("Hauptstrasse 12a, x", "street") == ["Hauptstrasse 12a"]
    assert found(f"{LONG}straße  7", "street") == [f"{LONG}straße  7"]
    for text in ("123456 Main Street", "12 main street", "a12 Main Street", "12 A B C D E Street", "Street", ""):
        assert found(text, "street") == []
