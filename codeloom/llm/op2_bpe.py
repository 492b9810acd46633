"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A sequence of tokens is the BPE encoding of its bytes exactly when each two neighbours are: merging their joined bytes
gives the two tokens again. So the encoding of a text's prefix ends in one token, the longest suffix token that may
follow the encoding of what is before it, and storing that token for each prefix length gives an encoding in time linear
in the length. Appending continues from the last prefix; an edit restarts at the edit and leaves all prefixes before it.

Texts are taken whole; null counts as empty and has no ids. Rows are mapped one by one, so repeated rows, ties and an
empty table need no case of their own, and other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, read

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Chunks of a text that a worker remembers: two generations of so many, the older one dropped when the younger is full.
REMEMBERED, LONGEST_REMEMBERED = 300_000, 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f) if rank}


class Vocabulary:
    """Tokens, and which may follow which."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: The lengths of tokens of three or more bytes by their last three, longest first, and 2: other lengths need no look-up.
        lengths: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 2:
                lengths.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {end: (*sorted(n, reverse=True), 2) for end, n in lengths.items()}
        self.follows: dict[tuple[int, int], bool] = {}
        self.stands: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """BPE by its definition, lowest rank first and leftmost first: for the few bytes of one or two tokens."""
        get, none = self.ranks.get, sys.maxsize
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs and (rank := min(pairs)) < none:
            at = pairs.index(rank)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
        return [self.ranks[p] for p in parts]

    def may_stand(self, token: int) -> bool:
        ok = self.stands.get(token)
        if ok is None:
            ok = self.stands[token] = self.merged(self.tokens[token]) == [token]
        return ok

    def may_follow(self, left: int, right: int) -> bool:
        ok = self.follows.get((left, right))
        if ok is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            ok = self.follows[left, right] = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        return ok


class PrefixEncoder:
    """The last token of the encoding of each prefix of data; grows by append, and edits keep what is before them."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend()

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]; prefixes up to start stay as they are."""
        self.data = self.data[:start] + new + self.data[end:]
        del self.last[start + 1 :]
        self._extend()

    def _extend(self) -> None:
        v, data, last = self.v, self.data, self.last
        get, lengths, follows = v.ranks.get, v.lengths.get, v.follows.get
        for end in range(len(last), len(data) + 1):
            found = -1
            for n in lengths(data[end - 3 : end], (2,)) if end > 2 else (end,):
                if n <= end and (token := get(data[end - n : end])) is not None:
                    before = last[end - n]
                    if before < 0:
                        ok = v.may_stand(token)
                    elif (ok := follows((before, token))) is None:
                        ok = v.may_follow(before, token)
                    if ok:
                        found = token
                        break
            last.append(get(data[end - 1 : end]) if found < 0 else found)  # no longer token: the byte alone

    def ids(self, end: int | None = None) -> list[int]:
        """Ids of the first `end` bytes: walk back from the last token."""
        end, out = len(self.data) if end is None else end, []
        while end > 0:
            out.append(self.last[end])
            end -= len(self.v.tokens[self.last[end]])
        return out[::-1]


class Codec:
    """Encodes texts by pieces of public_tokenizers.PATTERN, and decodes ids.

    A space between two other characters that are no white space always starts a piece, so a text is cut there and the
    chunks are encoded one by one; frequent chunks are remembered."""

    def __init__(self, path: str, pattern: str):
        self.v = Vocabulary(load_ranks(path))
        white = r"\p{White_Space}"
        self.pieces = regex.compile(pattern.replace(r"[^\s", "[^" + white).replace(r"\s", white).replace(r"\S", r"\P{White_Space}"))
        self.cut = regex.compile(rf"(?<=\P{{White_Space}}) (?=\P{{White_Space}})")
        self.rare = regex.compile(r"[^\P{White_Space} \n]")  # white space other than space and newline
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: Pieces likewise: a new chunk is mostly a word that another chunk has with other marks.
        self.young_pieces: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Packed ids of each piece. Sorted, so that a piece is an edit of the one before and shares its prefixes."""
        out, known, encoder = {}, self.v.ranks, PrefixEncoder(self.v)
        pack = lambda ids: struct.pack(f"<{len(ids)}I", *ids)
        for data, p in sorted((p.encode(), p) for p in pieces):
            if (whole := known.get(data)) is not None:
                out[p] = pack([whole])
                continue
            same = 0
            for a, b in zip(data, encoder.data, strict=False):
                if a != b:
                    break
                same += 1
            encoder.edit(same, len(encoder.data), data[same:])
            out[p] = pack(encoder.ids())
        return out

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " " or self.rare.search(text):
            first, *rest = self.cut.split(text)
        else:
            first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]] if rest else [first]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; what no text before had is encoded once for all."""
        cut = [self.chunks(t) for t in texts]
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        if len(self.young_pieces) > REMEMBERED:
            self.old_pieces, self.young_pieces = self.young_pieces, {}
        young, old = self.young, self.old
        new = {c: old.get(c) for c in set().union(*cut).difference(young)}
        split = {c: self.pieces.findall(c) for c, ids in new.items() if ids is None}
        ids = self.pieces_of({p for ps in split.values() for p in ps})
        new |= {c: b"".join([ids[p] for p in ps]) for c, ps in split.items()}
        young |= new
        out = [b"".join(map(young.__getitem__, chunks)) for chunks in cut]
        for c in new:
            if len(c) > LONGEST_REMEMBERED:
                del young[c]
        return out

    def pieces_of(self, pieces: set[str]) -> dict[str, bytes]:
        """Packed ids of each piece; those that no text before had are encoded."""
        young, old = self.young_pieces, self.old_pieces
        out = {p: young.get(p) or old.get(p) for p in pieces}
        out |= self.encode_pieces([p for p, ids in out.items() if ids is None])
        young |= {p: ids for p, ids in out.items() if len(p) <= LONGEST_REMEMBERED}
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def codec(name: str, pattern: str) -> Codec:
    """One codec a worker process, kept for its tasks."""
    return Codec(public_tokenizers.path(name), pattern)


def encode_documents(docs: DataFrame, name: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit), decoded (bytes): the operator's full output."""
    return _mapped(docs, name, pattern, False)


def _mapped(docs: DataFrame, name: str, pattern: str, hashes: bool) -> DataFrame:
    def make():
        c = codec(name, pattern)

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, first, second = [], [], []
            for ids in c.encode_all([text or "" for text in batch.column(1).to_pylist()]):
                back = c.decode(ids)
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest() if hashes else ids)
                second.append(hashlib.sha256(back).hexdigest() if hashes else back)
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if hashes else ["doc_id", "n_tokens", "ids", "decoded"]
            kind = pa.string() if hashes else pa.binary()
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(first, kind), pa.array(second, kind)], names)

        return f

    kind = dict(docs.dtypes)["doc_id"]
    tail = "ids_sha256 string, decoded_sha256 string" if hashes else "ids binary, decoded binary"
    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {kind}, n_tokens bigint, {tail}")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(read(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, True)
