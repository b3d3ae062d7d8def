"""Token counts of whole texts under a public tokenizer, by a whole-token shortcut.

For a tokenizer that drops white space, the tokens of a text are those of its
words one by one: nothing in its normaliser, its splitting or its merges reaches
across an ASCII space. So a task counts the tokens of each distinct word once.

Before the job it is proved which vocabulary strings the merges leave as one
token. Inside it, a word's pre-tokens that are such strings count one each
without any merging; only the others go through the merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a task remembers with their counts, and the longest word it remembers.
REMEMBERED, LONGEST = 1 << 19, 64
#: A long text is cut at white space into parts of about so many bytes.
PART = 1 << 20

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_whole long"


def whole_tokens(definition: str) -> frozenset[str]:
    """The pre-tokens that the merges of the tokenizer leave as one token, proved one by one.

    Each string of the vocabulary that can end a word is split and merged by the
    tokenizer's own model; it belongs here if exactly one token comes out. The
    strings are in the tokenizer's byte alphabet, as its splitting puts them out.
    """
    from tokenizers import Tokenizer

    suffix = json.loads(definition)["model"].get("end_of_word_suffix") or ""
    tokenizer = Tokenizer.from_str(definition)
    model = tokenizer.model
    ends = (token.removesuffix(suffix) for token in tokenizer.get_vocab() if token.endswith(suffix))
    return frozenset(piece for piece in ends if piece and len(model.tokenize(piece)) == 1)


def drops_white_space(definition: str) -> bool:
    """Whether white space only parts words and leaves no trace in them."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(definition)

    def parts(text: str) -> list[str]:
        if tokenizer.normalizer is not None:
            text = tokenizer.normalizer.normalize_str(text)
        return [piece for piece, _ in tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    return parts("ab") * 2 == parts("ab \t\n\r\x0b\x0c ab") == parts(" ab ab\n")


class _WordCounts(dict):
    """Tokens of a word, and how many of its pre-tokens were whole; found on first use."""

    def __init__(self, definition: str, whole: frozenset[str]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        # A new model object for each use of the property: hold one.
        self.model = self.tokenizer.model
        self.normalise = (
            self.tokenizer.normalizer.normalize_str if self.tokenizer.normalizer else str
        )
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = whole

    def __missing__(self, word: bytes) -> tuple[int, int]:
        text = word.decode("utf-8", "replace")
        normal = self.normalise(text)
        if any(a in text or a in normal for a in self.added):
            found = (len(self.tokenizer.encode(text, add_special_tokens=False).ids), 0)
        else:
            pieces = [piece for piece, _ in self.split(normal)]
            rest = [piece for piece in pieces if piece not in self.whole]
            n_whole = len(pieces) - len(rest)
            found = (n_whole + sum(len(self.model.tokenize(piece)) for piece in rest), n_whole)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a part of it at a time; a word is never cut."""
    at = 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            cut = max(text.rfind(space, at, end) for space in (b" ", b"\n", b"\t"))
            if cut <= at:  # no space in a whole part: look on for the next one
                after = [p for s in (b" ", b"\n", b"\t") if (p := text.find(s, end)) >= 0]
                cut = min(after, default=len(text))
            end = cut
        yield text[at:end].split()
        at = max(end, at + 1)


def token_counts(documents: DataFrame, definition: str | Path, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit, n_whole`` of every row's whole text.

    ``definition`` names a file of the ``tokenizers`` library, read by the driver
    alone, or is its content. ``n_tokens`` is the length of the library's encoding
    without added tokens, ``n_whole`` the part that needed no merging, and
    ``over_limit`` says whether there are more than ``limit`` tokens.

    One pass, no shuffle; a task holds the words that it has met last, a long
    text goes through in parts. A null or empty text has 0 bytes and tokens; a
    null ``doc_id`` stays null; repeated rows are counted each; there are no ties;
    other columns, whatever their names, are not read; no rows give none. Strings
    of special tokens inside a text are what the library makes of them.
    """
    if isinstance(definition, Path) or not definition.lstrip().startswith("{"):
        definition = Path(definition).read_text(encoding="utf-8")
    if not drops_white_space(definition):
        raise ValueError("the shortcut by words needs a tokenizer that drops white space")
    # As large as the vocabulary, whatever the data.
    sent = documents.sparkSession.sparkContext.broadcast((definition, whole_tokens(definition)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _WordCounts(*sent.value)
        for batch in batches:
            n_bytes, n_tokens, n_whole = [], [], []
            for value in batch.column("text"):
                text = value.as_buffer()
                text = text.to_pybytes() if text is not None else b""
                tokens = whole = 0
                for words in _parts(text):
                    for one, of_it in map(known.__getitem__, words):
                        tokens += one
                        whole += of_it
                n_bytes.append(len(text))
                n_tokens.append(tokens)
                n_whole.append(whole)
            counts = pa.array(n_tokens, pa.int64())
            columns = [
                batch.column("doc_id"),
                pa.array(n_bytes, pa.int64()),
                counts,
                pa.array([n > limit for n in n_tokens], pa.bool_()),
                pa.array(n_whole, pa.int64()),
            ]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_whole"]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(count, SCHEMA)
