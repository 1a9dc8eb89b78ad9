from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm.tokens import Encoder, tokenizer_path

ENCODER = Encoder(tokenizer_path())
PLAIN = Tokenizer.from_file(tokenizer_path())
_WORD = st.sampled_from(["the", "Word", "it's", "don't.", "x,", "éa", "ñ.", "12", "3.5", "日本", "<|endoftext|>", "", " ", "́", "a b", "'ll", "$$$"])
_GAP = st.sampled_from([" ", "  ", "\n", " \n", "\n\n", "\n ", "\t", "\r\n", " \t "])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(_WORD, _GAP), max_size=12), st.integers(1, 50))
def test_ids_are_those_of_the_library(parts, cuts):
    text = "".join(w + g for w, g in parts)
    e = ENCODER
    e._limit = cuts
    e._clear()
    plain = PLAIN.encode(text, add_special_tokens=False).ids
    for _ in range(2):  # cold and warm
        got = e.encode(text)
        assert [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)] == plain


def test_many_texts_keep_their_order():
    e = Encoder(tokenizer_path())
    texts = ["one two", None, "", "two one\nthree", "x" * 200]
    assert list(e.encode_many(texts)) == [e.encode(t) for t in texts]
    assert e.encode(None) == b""
