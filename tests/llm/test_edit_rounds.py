"""Edits of many texts are encoded together, with the counts that each text edited on its own has."""

import random
import sys

import pytest

from folioflow.llm import encoding, token_counts


def case(seed=4, n=300):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdefgiklmnorstu") for _ in range(rng.randint(3, 9)))
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 5, 200]))) for _ in range(n)]
    cut = lambda t: sorted((rng.randrange(len(t) + 3), rng.randrange(len(t) + 60)))
    edits = [rng.choice([None, [], [None], [dict(zip(("start", "end"), cut(t)), text=rng.choice([None, "", word(), f"{word()} " * 90])) for _ in range(rng.choice([1, 4, 9]))]]) for t in texts]
    return texts, edits


@pytest.mark.parametrize("at_a_time", [token_counts.ENCODED, 700])
def test_edits_in_rounds_equal_edits_one_by_one(monkeypatch, at_a_time):
    monkeypatch.setattr(token_counts, "ENCODED", at_a_time)
    e = encoding.encoder(encoding.default_path())
    texts, edits = case()
    trees = [token_counts.TokenTree(t, e) for t in texts]
    token_counts.edit_all(e, trees, edits)
    for t, todo, tree in zip(texts, edits, trees, strict=True):
        alone, now = token_counts.TokenTree(t, e), t
        for x in todo or []:
            a, b, new = [(x or {}).get(k) for k in ("start", "end", "text")]
            alone.edit(a, b, new)
            now = now[: a or 0] + (new or "") + now[b or 0 :]
        assert (tree.whole(), tree.n_tokens, tree.encoded) == (now, alone.n_tokens, alone.encoded)
        assert tree.n_tokens == len(e.tokenizer.encode(tree.whole(), add_special_tokens=False).ids)


def test_the_library_is_called_for_batches_and_not_for_each_edit():
    e = encoding.encoder(encoding.default_path())
    texts, _ = case(5)
    trees = [token_counts.TokenTree(t, e) for t in texts]
    calls = 0

    def seen(frame, event, arg):
        nonlocal calls
        calls += event == "c_call" and arg.__name__ == "encode_batch_fast"

    sys.setprofile(seen)
    try:
        token_counts.edit_all(e, trees, [[{"start": 3, "end": 5, "text": "new "}, {"start": 90, "end": 95, "text": ""}] for _ in texts])
    finally:
        sys.setprofile(None)
    assert calls < 20, calls


def test_more_rows_than_trees_are_held_at_a_time(spark):
    rows = token_counts.ROWS + 300
    df = spark.createDataFrame([(i, f"word {i} of a text", [(5, 6, "x")]) for i in range(rows)], "doc_id long, text string, edits array<struct<start:int,end:int,text:string>>").coalesce(1)
    got = token_counts.edited_counts(df, texts=True).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(i, f"word x{str(i)[1:]} of a text") for i in range(rows)]
