"""Numbers of any kind in lists on one line: none is lost where a long run of digits would be cut."""

import pytest

from tidegauge.llm import pii

CARDS = ["7536784127813050", "4845168114407329", "4111 1111 1111 1111", "5500 0000 0000 0004", "3782-822463-10005"]
PHONES = ["555-123-4567", "555-123-4568", "(555) 123-4569", "555.123.4570"]
IPS = ["10.20.30.40", "192.168.100.200", "1.1.1.1"]
SSNS = ["123-45-6789", "123-45-6790", "123-45-6791", "123-45-6792"]


@pytest.mark.parametrize("kind, numbers", [("card", CARDS), ("card", CARDS[:2]), ("card", CARDS[2:4]), ("phone", PHONES), ("phone", PHONES[:2] * 9), ("ip", IPS), ("ssn", SSNS)])
def test_every_number_of_a_list_is_found(kind, numbers):
    for between in (" ", "  ", " - "):
        text = between.join(numbers)
        assert [(k, text[x:y]) for x, y, k, _ in pii.find(text)] == [(kind, n) for n in numbers]
        for pad in range(40):  # wherever the run begins
            assert len(pii.find("1 " * pad + text)) == len(numbers)


def test_lists_are_replaced_whole(spark):
    lines = [" ".join(CARDS), " ".join(PHONES), " ".join(SSNS)]
    out = pii.pseudonymise(spark.createDataFrame(enumerate(lines), "doc_id long, text string"), b"key").orderBy("doc_id").collect()
    assert [r["surrogated"]["n_entities"] for r in out] == [5, 4, 4]
    assert not any(n in r["surrogated"]["text"] for r in out for n in CARDS + PHONES + SSNS)
