"""A span reaches over any number of candidate positions."""

import string

import pytest

from foliospark.llm.sentences import split


@pytest.mark.parametrize("n", [3, 15, 26, 260])
def test_many_initials_in_a_bracket_end_no_sentence(n):
    initials = " ".join(f"{string.ascii_uppercase[i % 26]}." for i in range(n))
    first = f"The authors ({initials} Harrow) wrote all of it."
    assert split(f"{first} The rest is lost.") == [len(first), len(first) + 18]
