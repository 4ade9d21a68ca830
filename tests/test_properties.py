from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.operators.markers import chi_square_tail


@settings(max_examples=200, deadline=None)
@given(st.floats(0, 2000), st.floats(0, 50), st.integers(1, 40))
def test_tail_is_a_falling_probability(x, more, dof):
    a, b = chi_square_tail(x, dof), chi_square_tail(x + more, dof)
    assert 0 <= b <= a + 1e-12 <= 1 + 1e-9
