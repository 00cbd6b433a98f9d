"""Garbled signs that stand alone, and capitals that aren't garbled."""

import pytest

from lanternspan.llm import encodings


@pytest.mark.parametrize("line", ["Zimdavekbase®, Gallepoldock", "2010 – 2014", "one · two"])
@pytest.mark.parametrize("chain", ["utf-8>cp1252", "utf-8>latin-1"])
def test_garbled_signs_between_plain_words_return(line, chain):
    assert encodings.restore(encodings.garble(line, chain))[0] == line


@pytest.mark.parametrize("line", ["РНОКПП 0005103203", "2010 – 2014", "В\xa02010 році", "В\xa02010", "Zimdavekbase®, x"])
def test_good_lines_stay(line):
    assert encodings.restore(line) == (line, [], False)
