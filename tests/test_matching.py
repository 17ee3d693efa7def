from difflib import SequenceMatcher

from hypothesis import given, settings
from hypothesis import strategies as st

from emend.functions import matching
from emend.operators import cleanup, hints

LETTERS = st.text("abc", max_size=40)


@settings(max_examples=500, deadline=None)
@given(LETTERS, LETTERS, st.integers(0, 40), st.integers(0, 40))
def test_longest_match_is_difflibs(a, b, i, j):
    i, j = min(i, len(a)), min(j, len(b))
    want = SequenceMatcher(None, a, b, autojunk=False).find_longest_match(i, len(a), j, len(b))
    assert matching.longest(a, b, i, len(a), j, len(b)) == tuple(want)


def test_blocks_of_long_sequences_are_difflibs():
    words = [f"w{i * i % 8}{i % 3}" for i in range(700)]
    changed = [w + "x" if i % 50 == 6 else w for i, w in enumerate(words) if i % 90]
    for a, b in ((words, changed), ("".join(words), "".join(changed))):
        assert matching.Matcher(a, b).get_matching_blocks() == SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()


def test_likeness_is_of_letters_at_every_length():
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta"] * 63
    changed = [*words[:6], "other", *words[7:]]
    a, b = "".join(words), "".join(changed)
    assert len(a) > 2000
    assert cleanup.likeness(" ".join(words), " ".join(changed)) == SequenceMatcher(None, a, b, autojunk=False).ratio() > 0.99
    distinct = [f"word{i}" for i in range(400)]
    spoilt = [w[:-1] + "q" if i % 3 == 0 else w for i, w in enumerate(distinct)]
    assert cleanup.likeness(" ".join(distinct), " ".join(spoilt)) == SequenceMatcher(None, "".join(distinct), "".join(spoilt), autojunk=False).ratio() > 0.9


def test_span_of_a_long_text_is_the_change_alone():
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "zeta"]
    source = [words[i * i * i % 7] if i % 5 else words[7] for i in range(600)]
    target = [*source[:6], "other", *source[7:]]
    assert hints.span(" ".join(source), " ".join(target)) == f"{source[6]} -> other"
