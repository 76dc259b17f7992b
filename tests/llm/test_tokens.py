"""Token counts against the library itself."""

import random

import pytest

from tidepool.llm.queries import tokenizer_path
from tidepool.llm.tokens import BatchCounter, PieceCounter, count_tokens

PIECES = ["a", "b", "e", "th", "the ", " ", "  ", "\n", "\t", "é", "ß", "€", "日", "本", "😀", "▁", "\x00", "\x7f", "1", "2", "</s>", "<s>", "<unk>", "<0x0A>", "́",
          "\r", "...", "==", "----", "\xa0", "ing", "A", ".", ",", "'s", "ा", "न", "ы"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path())


def test_random_texts_as_the_library_counts(library):
    counter, rng = PieceCounter(tokenizer_path()), random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 500, "😀" * 300]
    assert [counter.count(t) for t in texts] == [len(library.encode(t)) for t in texts]


def test_batches_as_the_library_counts(library, monkeypatch):
    from tidepool.llm import tokens
    monkeypatch.setattr(tokens, "CACHE_UNITS", 300)
    monkeypatch.setattr(tokens, "BATCH_UNITS", 50)
    counter, rng = BatchCounter(tokenizer_path()), random.Random(5)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 500, "😀" * 300, "", " ", "  a  b ", "x" * 63 + " " + "x" * 64 + " " + "x" * 65, "end of it.", "the end", "the end"]
    made = [n for at in range(0, len(texts), 100) for n in counter.counts(texts[at:at + 100])]
    assert made == [len(library.encode(t)) for t in texts]
    assert counter.counts([None, "the end", ""]) == [0, len(library.encode("the end")), 0] and counter.counts([]) == []
    monkeypatch.setattr(counter.single, "merge_count", None)  # words of known characters are merged side by side
    assert counter.counts(["never seen beforehand"]) == [len(library.encode("never seen beforehand"))]


def test_cache_starts_anew(library, monkeypatch):
    from tidepool.llm import tokens
    monkeypatch.setattr(tokens, "CACHE_UNITS", 5)
    counter = PieceCounter(tokenizer_path())
    text = " ".join(f"word{k}s and" for k in range(50))
    assert counter.count(text) == len(library.encode(text)) and len(counter.known) <= 5


def test_frame_with_nulls_empties_repeats_and_clashing_names(spark, library):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (None, "é\n", None), (5, "word " * 5000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = count_tokens(df, tokenizer_path()).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t)) if t else 0) for i, t, _ in rows]
    assert [(r.doc_id, r.n_bytes, r.n_tokens) for r in out] == want
    assert [r.over_limit for r in out] == [n > 4096 for _, _, n in want]
    assert count_tokens(df.limit(0), tokenizer_path()).count() == 0
