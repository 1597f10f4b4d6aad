"""Words that are encoded together get the ids that each has on its own."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeaudit.llm import pieces
from lakeaudit.llm.pieces import default_path, encode_flat, tokenizer

PATH = default_path()
WORDS = st.one_of(
    st.sampled_from([" a", " the", "\nIn", "\t\t(x)", " é", " naïve", " 1,000", " don't", "<|endoftext|>", " <|endof", "text|>", "  b", "x", " ", "\n", " 中", "a ", " ---", "!"]),
    st.text(alphabet=st.sampled_from(list("ab \n\t.,'!<|>1é 　́中\x1c\x85")), min_size=1, max_size=6),
)


@settings(max_examples=150, deadline=None)
@given(st.lists(WORDS, max_size=40))
def test_joined_words_have_their_own_ids(words):
    flat, counts = encode_flat(PATH, words)
    want = [tokenizer(PATH).encode(w, add_special_tokens=False).ids for w in words]
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == want if words else not len(flat)


def test_words_of_texts_are_encoded_in_few_calls(monkeypatch):
    own, seen = tokenizer(PATH), []

    class Watched:
        def __getattr__(self, name):
            return getattr(own, name)

        def encode_batch(self, texts, **options):
            seen.extend(texts)
            return own.encode_batch(texts, **options)

    monkeypatch.setattr(pieces, "tokenizer", lambda path: Watched())
    words = [f" word{i}" for i in range(5_000)]
    counts = encode_flat(PATH, words)[1]
    assert len(seen) <= 5_000 / 100 and counts.min() > 0 and len(counts) == 5_000
