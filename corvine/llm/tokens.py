"""Byte-pair encoding of a corpus with a public vocabulary."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corvine.session import ship_package

#: Folder of the vocabulary files; a parameter of every operator that reads one.
TOKENIZER_DIR = os.environ.get("CORVINE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pattern that cuts a text into pieces before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded pieces that one worker remembers.
MEMORY = 500_000


class PrefixEncoder:
    """Encoding by the last token of every prefix.

    Of the tokens that end at byte i exactly one is the last token of the encoding of the first i
    bytes: the one that stands validly behind the last token of what precedes it. ``last[i]``
    holds it, so an encoding is read from the end backwards, an append only extends the table and
    an edit only refills it from the first changed byte on.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._known: dict[str, list[int]] = {}
        self._cut = regex.compile(PATTERN).findall

    @classmethod
    def from_file(cls, data: bytes) -> PrefixEncoder:
        """From the text of a rank file: base64 token and rank a line."""
        return cls({base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)})

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; the token itself twice if it is one byte; None if no merging ever yields it."""
        if token not in self._halves:
            parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            while len(parts) > 2:
                merged = [self.ranks.get(self.bytes_of[a] + self.bytes_of[b], token) for a, b in zip(parts, parts[1:])]
                lowest = min(merged)
                if lowest >= token:
                    break
                at = merged.index(lowest)
                parts[at : at + 2] = [lowest]
            self._halves[token] = (parts[0], parts[-1]) if len(parts) <= 2 else None
        return self._halves[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens are encoded as just these two.

        The merges that made them are undone from the last one back, each time looking at the two
        pieces that meet at the seam: if they could have merged before the merge just undone,
        the encoder would have done so. Of equal merges the left one comes first.
        """
        key = (left, right)
        found = self._fits.get(key)
        if found is None:
            found = self._fits[key] = self._seam_holds(left, right)
        return found

    def _seam_holds(self, left: int, right: int) -> bool:
        before = None  # merges of a rank below this one came earlier
        while True:
            joint = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joint is not None and (before is None or joint < before):
                return False
            left_made, right_made = len(self.bytes_of[left]) > 1, len(self.bytes_of[right]) > 1
            if not left_made and not right_made:
                return True
            if left_made and (not right_made or left > right):
                before, left = left, self.halves(left)[1]
            else:
                before, right = right + 1, self.halves(right)[0]

    def extend(self, data: bytes, last: list[int]) -> None:
        """Fill ``last`` (one entry a byte already encoded) up to the end of ``data``."""
        ranks, fits = self.ranks, self.fits
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(data[start:end])
                if token is not None and self.halves(token) is not None and (start == 0 or fits(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte without a token")

    def read(self, last: list[int]) -> list[int]:
        """The token ids from a filled table."""
        found, end = [], len(last)
        while end:
            found.append(last[end - 1])
            end -= len(self.bytes_of[found[-1]])
        return found[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None and self.halves(whole) is not None:
            return [whole]
        last: list[int] = []
        self.extend(data, last)
        return self.read(last)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; null and empty texts have none, and the strings of special tokens are ordinary text."""
        if not text:
            return []
        known, found = self._known, []
        for piece in self._cut(text):
            ids = known.get(piece)
            if ids is None:
                if len(known) >= MEMORY:
                    known.clear()
                ids = self.encode_piece(piece)
                if len(piece) <= 64:
                    known[piece] = ids
            found += ids
        return found

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", errors="replace")


class Encoding:
    """The encoding of one text that can be appended to and edited.

    Text is cut into pieces first. A change reaches back two pieces before the first changed
    character at most (an apostrophe and its letters may join) and forward until the old cuts are met again; within
    the piece that was changed the table is kept up to the first changed byte.
    """

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder = encoder
        self.pieces: list[tuple[str, list[int]]] = []
        self._add(text)

    def _table(self, piece: str, kept: list[int]) -> list[int]:
        last = list(kept)
        self.encoder.extend(piece.encode("utf-8"), last)
        return last

    def _add(self, text: str, old: tuple[str, list[int]] | None = None) -> None:
        for piece in self.encoder._cut(text):
            kept: list[int] = []
            if old is not None:
                a, b = piece.encode("utf-8"), old[0].encode("utf-8")
                same = len(os.path.commonprefix([a, b]))
                kept, old = old[1][:same], None
            self.pieces.append((piece, self._table(piece, kept)))

    def append(self, more: str) -> None:
        tail = self.pieces[-2:]
        del self.pieces[-2:]
        self._add("".join(p for p, _ in tail) + more, tail[0] if tail else None)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in the place of the characters from ``start`` to ``end``."""
        at, first = 0, 0
        while first < len(self.pieces) and at + len(self.pieces[first][0]) < start:
            at += len(self.pieces[first][0])
            first += 1
        for _ in range(2):
            if first:
                first -= 1
                at -= len(self.pieces[first][0])
        after, stop = at, first
        while stop < len(self.pieces) and after < end:
            after += len(self.pieces[stop][0])
            stop += 1
        old = self.pieces[first:]
        head = "".join(p for p, _ in old[: stop - first])
        changed = head[: start - at] + new + head[end - at :]
        rest = old[stop - first :]
        del self.pieces[first:]
        # the pieces behind the change are cut anew together with it until a cut falls on an old one
        while True:
            cut = self.encoder._cut(changed + "".join(p for p, _ in rest[:3]))
            if len(rest) <= 3 or [p for p in cut[-2:]] == [p for p, _ in rest[1:3]]:
                keep = rest[3:]
                text = "".join(cut)
                self._add(text, old[0] if old else None)
                self.pieces += keep
                return
            changed, rest = changed + rest[0][0], rest[1:]

    @property
    def text(self) -> str:
        return "".join(p for p, _ in self.pieces)

    @property
    def ids(self) -> list[int]:
        return [i for _, last in self.pieces for i in self.encoder.read(last)]


def _vocabulary(spark, tokenizer: str, folder: str):
    """The rank file, sent once to each executor (public vocabularies are a few MB)."""
    with open(os.path.join(folder, f"{tokenizer}.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_ENCODERS: dict[int, PrefixEncoder] = {}


def _encoder(data: bytes) -> PrefixEncoder:
    """One encoder a worker and vocabulary."""
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder.from_file(data)
    return _ENCODERS[key]


def encode_texts(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``ids`` (array of int) of every row. Null, empty: an empty list. Repeated rows are kept; only the two columns are read."""
    spark = df.sparkSession
    ship_package(spark)
    vocabulary = _vocabulary(spark, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            ids, ends = [], [0]
            for value in batch.column(1).to_pylist():
                ids += encoder.encode(value)
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    schema = T.StructType([df.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """``key`` and ``n_tokens`` of every row; 0 for null and empty texts."""
    spark = df.sparkSession
    ship_package(spark)
    vocabulary = _vocabulary(spark, tokenizer, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            sizes = pa.array([len(encoder.encode(value)) for value in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes], names=[key, "n_tokens"])

    schema = T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType())])
    return df.select(key, text).mapInArrow(run, schema)
