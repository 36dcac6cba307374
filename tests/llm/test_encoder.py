"""The encoder does its work on arrays, and its ids are the library's."""

import random
import sys

import numpy as np

from folioflow.llm import encoding

ODD = ["Hello,", "a,  b", "a,\nb", "a.\n\nb.", "dog's, x", "dog',s x'", ", a", "a\ue001, b c", "\ue001, a", "a \ue001, b", "\ue000a b", "ab_, c_", "é,. ü!", "x ,y", "a,\t b,", "a,\xa0b, c", "12, 3.", "漢字, 仮名。", "a,", " a, ", "", None, "\n,a,", "a \n, b"] + [t.replace("@", c) for t in ("@, a", "a@, b", "a @, b", "@", "a, @a,") for c in ("\ue000", "\ue001", "\u2028", "\u3000")]


def library(e, texts):
    return [np.array(x.ids, e.dtype).tobytes() for x in e.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_marks_after_words_and_mixed_pieces_equal_the_library():
    rng = random.Random(5)
    parts = ["word", "Word", "é", "ß", "ı", "ǅ", "漢", "7", " ", " ", " ", " ", "  ", "\n", "\t", "\xa0", " ", "\x85", ",", ".", "'", "'s", "_", "%%%", "\ue000", "\ue001", "<|endoftext|>", "\0", "🙂"]
    parts += ["\ue000", "\ue001", "\u2028", "\u3000"]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    e = encoding.Encoder(encoding.default_path())
    want = library(e, texts)
    for _ in range(2):
        assert [t for t, x, w in zip(texts, e.many(texts), want, strict=True) if x != w] == []
    assert e.many([]) == []


def test_pieces_that_are_new_take_no_python_call_each():
    rng = random.Random(3)
    words = list({"".join(rng.choice("abdefgiklmnorstu") for _ in range(rng.randint(5, 9))) for _ in range(20_000)})
    ends = ["", "", ",", ".", "%%%"]
    texts = [" ".join(w + rng.choice(ends) for w in words[i : i + 50]) + "\n" + words[i] for i in range(0, len(words), 50)]
    e = encoding.Encoder(encoding.default_path())
    calls = 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(seen)
    try:
        got = e.many(texts)
    finally:
        sys.setprofile(None)
    assert calls < len(words) / 10, calls
    assert got == library(e, texts)
