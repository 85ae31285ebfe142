"""Encoding of texts with a public byte-level BPE vocabulary by dynamic programming over prefixes.

For every prefix of a text there is exactly one token with which its encoding can
end.  It is found from the tokens stored for shorter prefixes: a token fits after
prefix ``j`` if it and the token stored for ``j`` stay as they are when their bytes
are merged together.  Walking the stored tokens back from the end gives the
encoding.  The table answers for every prefix, so text may be appended, and after
an edit only what follows the edited place is computed again.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how texts are split before merging, as published with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"
MEMO = 200_000  # words remembered by a worker; beyond it the memo starts anew


def vocabulary_path(name: str = VOCABULARY, folder: str | None = None) -> str:
    """The vocabulary's file: in ``folder``, in $TIDEMARK_TOKENIZERS, or where the package of public tokenizers lies."""
    folder = folder or os.environ.get("TIDEMARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


class PrefixTable:
    """The last token of every prefix of one byte string."""

    __slots__ = ("bpe", "data", "last")

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", array("i")
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the string; what is stored for its prefixes stays true."""
        self.data += more
        data, last, ranks, fits = self.data, self.last, self.bpe.ranks, self.bpe.fits
        longest = self.bpe.longest
        for i in range(len(last) + 1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                token = ranks.get(data[j:i])
                if token is not None and fits(last[j - 1] if j else -1, token):
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def replace(self, start: int, end: int, by: bytes) -> None:
        """Put ``by`` in place of bytes ``start`` to ``end``; prefixes up to ``start`` are kept."""
        tail = self.data[end:]
        self.data, self.last = self.data[:start], self.last[:start]
        self.append(by + tail)

    def tokens(self, upto: int | None = None) -> list[int]:
        """Encoding of the first ``upto`` bytes, of all by default."""
        at, out = len(self.data) if upto is None else upto, []
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.bpe.bytes_of[token])
        return out[::-1]


class Bpe:
    """A vocabulary of ranked byte strings, and encoding by prefix tables."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {rank: piece for piece, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.split = regex.compile(pattern).findall
        self._pairs: dict[tuple[int, int], bool] = {}
        self._memo: dict[str, array] = {}

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, "rb") as f:
            return cls.of(f.read())

    @classmethod
    def of(cls, content: bytes) -> Bpe:
        """The vocabulary in the content of its file."""
        return cls({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, content.splitlines())})

    def merged(self, data: bytes) -> list[int]:
        """Encoding by merging the best-ranked neighbours until none is left; only used on two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, before: int, token: int) -> bool:
        """Whether ``token`` after ``before`` (-1: at the start) stays apart when both are merged."""
        known = self._pairs.get((before, token))
        if known is None:
            if len(self._pairs) > 4 * MEMO:
                self._pairs.clear()
            head = b"" if before < 0 else self.bytes_of[before]
            want = [token] if before < 0 else [before, token]
            known = self._pairs[before, token] = self.merged(head + self.bytes_of[token]) == want
        return known

    def word(self, word: str) -> array:
        """Tokens of one piece of the split."""
        found = self._memo.get(word)
        if found is None:
            data = word.encode("utf-8", "replace")
            whole = self.ranks.get(data)
            found = array("i", [whole] if whole is not None else PrefixTable(self, data).tokens())
            if len(word) <= 64:
                if len(self._memo) >= MEMO:
                    self._memo.clear()
                self._memo[word] = found
        return found

    def encode(self, text: str | None) -> array:
        """Token ids of a text, without special tokens; none for an empty or null text."""
        out = array("i")
        if text:
            get, word, extend = self._memo.get, self.word, out.extend
            for piece in self.split(text):
                extend(get(piece) or word(piece))
        return out


class TextEncoder:
    """The encoding of a text that is edited: words before and after the edited ones are kept."""

    def __init__(self, bpe: Bpe, text: str = ""):
        self.bpe, self.text = bpe, text
        self.words = bpe.split(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, by: str) -> None:
        """Replace characters ``start`` to ``end``.

        The split looks two characters ahead at most, and where it begins anew at
        the start of an old word it goes on as before.
        """
        kept, at = 0, 0
        while kept < len(self.words) and at + len(self.words[kept]) < start - 2:
            at += len(self.words[kept])
            kept += 1
        kept, at = (kept - 1, at - len(self.words[kept - 1])) if kept else (0, 0)
        self.text = self.text[:start] + by + self.text[end:]
        self.words[kept:] = self.bpe.split(self.text[at:])

    def tokens(self) -> list[int]:
        return [t for w in self.words for t in self.bpe.word(w)]


_LOADED: dict[str, Bpe] = {}


def loaded(path: str, content: bytes) -> Bpe:
    """One vocabulary a worker and path."""
    if path not in _LOADED:
        _LOADED[path] = Bpe.of(content)
    return _LOADED[path]


def _shipped(docs: DataFrame, path: str) -> Broadcast:
    """The vocabulary's file, read once by the driver and sent with the job; it is under a megabyte."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, ids``: token ids of every text; an empty list for an empty and for a null text.

    One row for each input row, whole texts, no shuffle: texts pass through Python
    in Arrow batches and leave as one flat array of ids a batch.
    """
    path = path or vocabulary_path()
    shipped = _shipped(docs, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, shipped.value)
        for batch in batches:
            # a batch may hold very long texts, so its rows leave in parts
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                flat, ends = array("i"), array("i", [0])
                for value in part.column(1):
                    flat.extend(bpe.encode(value.as_py()))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["doc_id", "ids"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, ids array<int>")


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``doc_id, n_tokens`` of every text, zero for an empty and for a null one."""
    path = path or vocabulary_path()
    shipped = _shipped(docs, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, shipped.value)
        for batch in batches:
            counts = [len(bpe.encode(v.as_py())) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_tokens long")
