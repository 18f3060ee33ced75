"""Spelled digits with other separators than spaces."""

import pytest

from coppice.llm import pii

CARD = "four one one one one one one one one one one one one one one one"
PHONE = "plus four nine two two three four five six seven eight nine"


@pytest.mark.parametrize("mark", ["-", ",", ", "])
@pytest.mark.parametrize("digits", [CARD, PHONE])
def test_separators(mark, digits):
    found = digits.replace(" ", mark).replace("plus" + mark, "plus ")
    text = f"call {found}. ok"
    assert [text[a:b] for spans in pii.find(text)[1].values() for a, b in spans] == [found]
