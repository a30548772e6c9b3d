"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A random string compresses badly under a byte-level BPE vocabulary: it has few characters per token, while words,
names and identifiers have many. Long unbroken strings are measured so, after known digests (by length and alphabet), UUIDs and numbers
are set aside. Letters alone may be a word of a language that the vocabulary knows little: they must also have far fewer characters per token than
the words of their own text.

Defined results: null and empty texts have no spans; offsets are code points; repeated rows are scanned alike; very long
texts are scanned whole in time linear in their length, but for the logarithm of their spans; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections import Counter

from pyspark.sql import DataFrame

from lectern.llm.spans import Span, Taken, scan

COUNTED = ("assign", "access", "hex")
KINDS = (*COUNTED, "random")
#: Strings this long or longer are measured.
LEAST_LENGTH = 16
#: Characters that go to the tokenizer at once; it takes more than linear time for one very long word.
TOKENIZED = 2048
#: A string with at most this many characters per token looks random: random strings with digits have 1.3 to 1.7 on average, random letters 1.4 to 1.7.
MOST_PER_TOKEN = 2.1
#: Letters alone look random only with at most this share of the characters per token that the other words of their text have.
MOST_OF_WORDS = 0.7

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_STRING = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_LENGTH},}}")
_WORD = re.compile(r"(?<![^\W\d_])[^\W\d_]{4,15}(?![^\W\d_])")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_HEX_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
#: Hexadecimal lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
_DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
#: Split pattern of the byte-level vocabulary (a fixed value of its format).
_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.lru_cache(maxsize=2)
def encoding(vocabulary: str):  # noqa: ANN201
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def identifier(string: str) -> bool:
    """A known digest, a UUID, a number or date (fewer than 4 letters), or a string of which one character is a third."""
    if _UUID.fullmatch(string) or (_HEX_DIGEST.fullmatch(string) and len(string) in _DIGEST_LENGTHS):
        return True
    return sum(map(str.isalpha, string)) < 4 or max(Counter(string).values()) * 3 > len(string)


def tokens_of(string: str, vocabulary: str) -> int:
    return sum(len(encoding(vocabulary).encode_ordinary(string[at : at + TOKENIZED])) for at in range(0, len(string), TOKENIZED))


def words_per_token(text: str, vocabulary: str) -> float:
    """Characters per token over all words of 4 to 15 letters of a text; without any, as many as make no difference."""
    words = [m[0] for m in _WORD.finditer(text)]
    tokens = sum(map(len, encoding(vocabulary).encode_ordinary_batch([" ".join(words[at : at + 500]) for at in range(0, len(words), 500)], num_threads=1)))
    return sum(map(len, words)) / tokens if tokens else MOST_PER_TOKEN / MOST_OF_WORDS


def random_strings(text: str, vocabulary: str, base: list[Span]) -> list[Span]:
    found, taken, usual = [], Taken(base), None
    for m in _STRING.finditer(text):
        if taken.overlaps(m.start(), m.end()) or identifier(m[0]):
            continue
        tokens = tokens_of(m[0], vocabulary)
        if len(m[0]) > MOST_PER_TOKEN * tokens:
            continue
        if m[0].isalpha():
            usual = usual or words_per_token(text, vocabulary)
            if len(m[0]) > MOST_OF_WORDS * usual * tokens:
                continue
        found.append(("random", m.start(), m.end()))
    return found


def find(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_spans. vocabulary: a tiktoken ranks file."""

    def finder(texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        bases = [base_spans(t) for t in texts]
        return [(base, random_strings(t, vocabulary, base)) for t, base in zip(texts, bases, strict=True)]

    return scan(docs, id_col, text_col, COUNTED, KINDS, finder)
