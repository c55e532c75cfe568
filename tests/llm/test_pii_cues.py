import pytest

from tidegraph.llm import pii

SPELLINGS = [
    "Social Security 123-45-6789", "social security number: 123-45-6789", "Social Security No. 123-45-6789", "SSN is 123-45-6789",
    "sSn (number) - 123-45-6789", "SSN:            123-45-6789", "SOCIAL SECURITY NUMBER IS: \"123-45-6789\"", "É İ SSN code 123-45-6789",
]


@pytest.mark.parametrize("text", SPELLINGS)
def test_ssn_spellings(text):
    found = [(text[a:b], pii.KINDS[k]) for a, k, b in pii.spans(text, pii.automaton())]
    assert ("123-45-6789", "ssn") in found
    assert "123-45-6789" not in pii.redacted(text, pii.spans(text, pii.automaton()))


@pytest.mark.parametrize("text", ["IBAN number GB82 WEST 1234 5698 7654 32", "Iban code is: GB82WEST12345698765432", "iBAN No. NO93 8601 1117 947", "iban NO9386011117947", "IBAN is IS14 0159 2600 7654 5510 7303 39"])
def test_iban_spellings(text):
    assert [text[a:b][:4] for a, k, b in pii.spans(text, pii.automaton()) if pii.KINDS[k] == "iban"] in (["GB82"], ["NO93"], ["IS14"])


@pytest.mark.parametrize("text", ["SSN unknown 123-45-6789", "ssn nothing 123-45-6789", "IBAN number GB83 WEST 1234 5698 7654 32", "SSN number 000-12-3456", "ssn " + "number " * 30000, "ssn" + " " * 200000])
def test_what_is_no_number_of_a_cue(text):
    assert not [k for _, k, _ in pii.spans(text, pii.automaton()) if pii.KINDS[k] in ("iban", "ssn")]
