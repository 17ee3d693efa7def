import random

from hypothesis import given, settings
from hypothesis import strategies as st
import pytest

from emend.operators import edits

WORDS = st.lists(st.sampled_from("a b the The THE cat cats in to into well known well-known Walk walked x-y x y s go goes".split()), min_size=1, max_size=7)
VERBS = {("go", "goes"): "VB_VBZ", ("walked", "Walk"): "VBD_VB"}


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS, st.sampled_from([None, VERBS]), st.sampled_from([1, 20, 1 << 24]))
def test_both_ways_give_the_same_spans(tokens, words, verbs, held):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(edits, "FEW_CELLS", 1000)
        m.setattr(edits, "MOST_STARTS", held)
        assert edits._spans_by_letters(tokens, words, verbs) == edits.spans(tokens, words, verbs)


def test_a_deletion_does_not_shift_a_large_block():
    rng = random.Random(3)
    words = [rng.choice("alpha beta gamma delta omega sigma kappa zeta".split()) for _ in range(300)]
    words[5:7] = ["alpha", "omega"]
    found = edits.spans(words, words[:6] + words[7:])
    assert [n for n, (a, b) in enumerate(found) if a == b] == [6] and all(b - a == 1 for n, (a, b) in enumerate(found) if n != 6)
    items = edits.align(" ".join(words), " ".join(words[:6] + words[7:]))
    assert sum(tags != ["$KEEP"] for _, tags in items) <= 1
