"""Finding F4 of round 3: guess costs of long values."""

import math

import pytest

from evraklab.llm import secrets


def test_guess_cost_of_long_values():
    """Beyond 200 characters too, a run may end where the next one begins."""
    letter = math.log10(26)
    for ones, pairs in ((20, 15), (119, 77), (400, 900)):
        cost = (letter + math.log10(ones)) + (2 * letter + math.log10(pairs)) + math.log10(2)
        assert secrets.guess_cost("x" * ones + "xy" * pairs) == pytest.approx(cost)
    value = "x" * 119 + "xy" * 77
    assert secrets.guess_cost(value) < secrets.MIN_GUESSES
    assert secrets.spans_of(f"auth: {value}") == []
