import random

import pytest

from lectern.llm import token_counts
from lectern.llm.queries import vocabulary
from tests.llm.helpers import EDGES, LONG, table

MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def merges():
    return token_counts.Merges(token_counts.vocabulary_ranks(MODEL))


def test_against_the_library(merges, library):
    r = random.Random(8)
    alphabet = "aaaeeiinnrst   ▁ the <s>0x1\n\t\x00é漢字の한ﬁ𝒳​\xa0.,-"
    for _ in range(3000):
        text = "".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 2, 5, 20, 60, 300])))
        assert merges.count(text) == len(library.encode(text)), repr(text)
    for text in ("<s>hello</s><unk><0x41>", "▁▁ a ▁", "�", "  leading", "trailing   ", "🙂🙂 é"):
        assert merges.count(text) == len(library.encode(text)), repr(text)


def test_very_long_words_and_runs(merges, library):
    for text in ("a" * 50_000, "ab" * 30_000, " " * 40_001, "the" * 20_000, "0123456789" * 5_000, "x\n" * 20_000, LONG):
        assert merges.count(text) == len(library.encode(text))


def test_slices_are_cut_before_spaces(merges, library, monkeypatch):
    monkeypatch.setattr(token_counts, "STEP_CHARS", 7)
    r = random.Random(1)
    for _ in range(500):
        text = "".join(r.choice("ab   ▁\n") for _ in range(r.randrange(80)))
        assert merges.count(text) == len(library.encode(text)), repr(text)


def test_memory_of_words_is_bounded(merges, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 10)
    text = " ".join(f"word{i}" for i in range(200))
    expected = merges.count(text)
    small = token_counts.Merges(merges.ranks)
    assert small.count(text) == expected and len(small) <= 10


def test_lowest_rank_first_and_leftmost_of_equals():
    """A vocabulary where greedy longest pieces would count otherwise."""
    small = token_counts.Merges({c: 99 for c in "abc "} | {"bc": 1, "ab": 2, "aa": 3, "abc": 4})
    assert small.merged("abc") == 1 and small.merged("abcab") == 2 and small.merged("aaa") == 2
    assert token_counts.Merges({c: 9 for c in "abc "} | {"bc": 1, "ab": 2}).merged("abc") == 2
    assert token_counts.Merges({"a": 0, " ": 1}).count("a é") == 5  # a space before, é as two bytes


def test_edges(spark, library):
    out = token_counts.count(table(spark, EDGES), MODEL, most_tokens=3)
    got = sorted(repr(tuple(r)) for r in out.collect())
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert got == sorted(repr((r[0], len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 3)) for r in EDGES)
    assert token_counts.count(table(spark, []), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="byte-pair"):
        token_counts.vocabulary_ranks(str(tmp_path / "m"))
