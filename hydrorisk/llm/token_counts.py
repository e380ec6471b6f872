"""Token counts from pieces per distinct pre-token and pre-token frequencies per document."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrorisk.llm.common import whole_text

# Distinct pre-tokens that a task remembers; beyond it the memory is emptied, counts stay the same.
MEMORY = 500_000

# Characters whose classes, lower and composed forms are the same in every edition of Unicode:
# Latin letters, ASCII and common punctuation. Texts of these alone are split here, by patterns
# spelled out for them; the library splits all others.
SETTLED = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7e\xa1-\u012f\u0132-\u0233\u2010-\u2027\u2030-\u205e]*")
LETTERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af"
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"

# Split rule of the byte-level tokenizer: fixed by its file format.
BYTE_LEVEL = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
)


def portions(texts: Iterable[str], most_chars: int = 1 << 20) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters together; a longer text is one portion."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


@lru_cache(maxsize=8)
def load_tokenizer(file: str):
    """A tokenizer by path, or by name among the public tokenizers' files; once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if not os.path.isabs(file):
        import public_tokenizers

        file = public_tokenizers.path(file)
    return Tokenizer.from_file(file)


def added_tokens(tokenizer) -> dict[str, int]:
    """Special strings that the library takes out of a raw text, with their ids."""
    return {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}


class PieceCounter:
    """Pieces of a pre-token, counted once for each distinct one that the task meets."""

    def __init__(self, file: str, memory: int = MEMORY):
        self.tokenizer = load_tokenizer(file)
        self.added = sorted(added_tokens(self.tokenizer), key=len, reverse=True)
        self.split = re.compile("|".join(map(re.escape, self.added))) if self.added else None
        self.pieces: dict[str, int] = {}
        self.memory = memory

    def pre_tokens(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return BYTE_LEVEL.findall(text)
        cuts = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [text[start:end] for _, (start, end) in cuts]

    def frequencies(self, text: str) -> tuple[int, Counter]:
        """Special strings in a text, and how often each pre-token stands between them."""
        if self.split is None or not any(a in text for a in self.added):
            return 0, Counter(self.pre_tokens(text))
        parts = self.split.split(text)
        return len(parts) - 1, Counter(p for part in parts for p in self.pre_tokens(part))

    def learn(self, tokens: Iterable[str]) -> None:
        """Know every one of ``tokens``; the memory is emptied first if it has grown too large."""
        if len(self.pieces) > self.memory:
            self.pieces.clear()
        new = list({t for t in tokens if t not in self.pieces})
        encodings = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.pieces.update(zip(new, map(len, encodings), strict=True))

    def counts(self, texts: Iterable[str]) -> list[int]:
        result = []
        for portion in portions(texts):
            found = [self.frequencies(text) for text in portion]
            self.learn(t for _, frequencies in found for t in frequencies)
            pieces = self.pieces
            result += [
                special + sum(map(mul, map(pieces.__getitem__, f), f.values()))
                for special, f in found
            ]
        return result


def token_counts(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
    memory: int = MEMORY,
) -> DataFrame:
    """Per row: ``id_col``, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Counts are those of the library for a byte-level ``tokenizer`` file, without begin or
    end tokens; special strings inside a text count as one token each, its default. Each
    task splits its texts into pre-tokens, has the pieces of every distinct pre-token
    counted once, and sums pieces times frequency per document; no ids are kept. NULL
    and empty texts have 0 bytes and 0 tokens. Rows stay as they are: repeated rows and
    NULL ids come out one by one, an empty table gives no rows. Other columns are not
    read. No shuffle: distinct pre-tokens of a corpus are too many to send around.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(tokenizer, memory)
        for batch in batches:
            numbers = counter.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_bytes"), pa.array(numbers, pa.int64())],
                ["id", "n_bytes", "n_tokens"],
            )

    text = whole_text(text_col)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.octet_length(text).cast("bigint").alias("n_bytes"),
        text.alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.select(
        F.col("id").alias(id_col),
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )
