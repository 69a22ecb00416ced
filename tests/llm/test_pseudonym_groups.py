"""Cards and account numbers beside other groups of digits and letters."""

import pytest

from tillwise.llm import pseudonyms

CARD, SPACED = "4111111111111111", "4111 1111 1111 1111"


def there(text, back=False):
    p = pseudonyms.Permuter(b"k", back)
    return pseudonyms.replaced(text, pseudonyms.find(text, p))


@pytest.mark.parametrize("text", ["{} 12/27", "{} 123", "order 12 {}", "2024-01-02 {}", "1 2 3 4 5 {}", "{} 5500 0000 0000 0004", "{}, 1"])
def test_cards_beside_other_groups(text):
    new = there(text.format(SPACED))
    assert there(CARD) in new.replace(" ", "") and SPACED not in new
    assert there(new, back=True) == text.format(SPACED)


@pytest.mark.parametrize("iban", ["BE68 5390 0754 7034", "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"])
@pytest.mark.parametrize("text", ["{} EUR", "{} BIC", "pay {} 12", "{}", "AB13 {}"])
def test_ibans_beside_other_tokens(iban, text):
    new = there(text.format(iban))
    assert new == text.format(there(iban)) and there(iban) != iban
    assert there(new, back=True) == text.format(iban)


def test_long_cards_turn_back():
    for k in range(200):
        body = f"{6 * 10**17 + k * 7919:018}"
        card = body + pseudonyms.luhn_digit(body)
        text = f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:16]} {card[16:]}"
        assert there(text) != text and there(there(text), back=True) == text
