"""Best-fit packing with a swap-based local search.

Documents become token ids and then pieces of at most `size` tokens; only longer documents are cut. Pieces go to groups
of bounded size by a hash of the row's number, so that no document, source or length makes a group large; each group is
packed best-fit decreasing, and then the emptiest bin gives its pieces to fuller ones, by moves, one-for-one and
two-for-one exchanges. Each step raises the sum of squared fills; the search ends when a round over all bins empties none
or no packing could have fewer. Groups are packed apart, so each may waste part of a bin beside what no packing could fill.

A null text is empty: its document is the closing id alone. Repeated rows are packed each; an empty table gives no rows;
texts are taken whole and other columns are not read. Rows with equal lengths are ordered by arrival, which changes
sequence numbers but not what a result has to satisfy.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, read, written

VOCABULARY, SIZE, END = "word_bpe_49k.json", 2048, 0
#: Pieces of a group: a group is packed in one task's memory.
GROUP = 16_384
#: Words that a worker remembers: two generations of so many.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 48


class Words:
    """Ids of texts by a tokenizer that drops white space, remembered by word.

    Texts of Latin letters and plain white space are split into words, which the tokenizer would not join; words that are
    not remembered are tokenized together, parted by a character that no such word has. All other texts go to the
    tokenizer as they are."""

    PART, TOGETHER, SIGNS = "\ue000", 200, ".,;:!?"
    PLAIN = bytes([9, 10, 13, *range(0x20, 0x7F), *range(0x80, 0xC0), *range(0xC2, 0xC6)])
    ODD = re.compile("[\x80-\xa0\xad]")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.of_words = Tokenizer.from_file(path), Tokenizer.from_file(path)
        # words have no white space and no letters that could be composed: of the normaliser's three steps one is left
        self.of_words.normalizer = normalizers.Lowercase()
        self.of_words.model._resize_cache(0)  # each word comes once
        part = self.direct(self.PART)
        self.part, self.part_length = int(np.frombuffer(part, "<u4")[0]), len(part) // 4
        self.signs = {x: self.direct(x) for x in self.SIGNS}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def together(self, words: list[str]) -> list[bytes]:
        out = []
        for k in range(0, len(words), self.TOGETHER):
            some = words[k : k + self.TOGETHER]
            joined = self.of_words.encode_batch_fast([f" {self.PART} ".join(some)], add_special_tokens=False)[0]
            ids = np.array(joined.ids, "<u4")
            at = np.flatnonzero(ids == self.part)
            if len(at) != len(some) - 1:
                out += map(self.direct, some)
                continue
            data, starts, ends = ids.tobytes(), [0, *(at + self.part_length).tolist()], [*at.tolist(), len(ids)]
            out += [data[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
        return out

    def tokenized(self, words: list[str]) -> dict[str, bytes]:
        """Ids of plain words. Case is dropped, and a sign behind letters is a token of its own: what is left is tokenized once."""
        stems = [w[:-1].lower() if w[-1] in self.signs and w[:-1].isalpha() else w.lower() for w in words]
        young, old = self.young, self.old
        ids = {s: young.get(s) or old.get(s) for s in stems}
        if unknown := [s for s, p in ids.items() if p is None]:
            ids |= zip(unknown, self.together(unknown), strict=True)
        return {w: ids[s] if len(w) == len(s) else ids[s] + self.signs[w[-1]] for w, s in zip(words, stems, strict=True)}

    def plain(self, text: str) -> bool:
        """Whether text has only characters of which words can be told apart by splitting: printing ASCII, tab, line
        ends, and Latin letters and signs from U+00A1 to U+017F without the soft hyphen and the dotted capital I."""
        data = text.encode()
        return not (data.translate(None, self.PLAIN) or "<|" in text or b"\xc2" in data and self.ODD.search(text) or "\u0130" in text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; words that no text before had are tokenized once for all of these."""
        cut = [t.split() if self.plain(t) else None for t in texts]
        young, old, new, gaps = self.young, self.old, {}, []
        found = [None if ws is None else list(map(young.get, ws)) for ws in cut]
        for ws, ps in zip(cut, found, strict=True):
            at = []  # places of unknown words alone: most words are known
            if ps and None in ps:
                k = -1
                for _ in range(ps.count(None)):
                    k = ps.index(None, k + 1)
                    at.append(k)
                    new[ws[k]] = None
            gaps.append(at)
        new = {w: old.get(w) for w in new}
        if unknown := [w for w, p in new.items() if p is None]:
            new |= self.tokenized(unknown)
        out = []
        for t, ws, ps, at in zip(texts, cut, found, gaps, strict=True):
            for k in at:
                ps[k] = new[ws[k]]
            out.append(self.direct(t) if ws is None else b"".join(ps))
        if len(young) + len(new) > REMEMBERED:
            self.old, self.young = young, {}
        self.young |= {w: p for w, p in new.items() if len(w) <= LONGEST_REMEMBERED}
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


@cache
def words(name: str) -> Words:
    """One a worker process, kept for its tasks."""
    return Words(public_tokenizers.path(name))


def pieces(docs: DataFrame, name: str = VOCABULARY, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each piece of each document."""

    def make():
        w, end = words(name), np.array([END], "<u4").tobytes()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(w.encode_all([text or "" for text in batch.column(1).to_pylist()])):
                ids += end
                for k, a in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[a : a + 4 * size]
                    row.append(i)
                    piece.append(k)
                    start.append(a // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

        return f

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), make, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of item numbers, longest items first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(size + 1)]  # bins by free space
    mask = 0  # a bit for each free space that some bin has
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = mask >> n
        if n and fits:
            space = n + (fits & -fits).bit_length() - 1
            b = room[space].pop()
            if not room[space]:
                mask &= ~(1 << space)
            bins[b].append(i)
        else:
            b, space = len(bins), size
            bins.append([i])
        left = space - n
        room[left].append(b)
        mask |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: list[int], size: int) -> list[list[int]]:
    """Raise the sum of squared fills until bins empty.

    drain: each bin in turn, emptiest first, gives its items to others, by moves, one-for-one and two-for-one exchanges.
    tighten: each bin, fullest first, takes a longer item for a shorter one from an emptier bin, so that free space gathers
    where drain can use it. Both only take tokens from an emptier into a fuller bin. Rounds of both end when a round empties no bin, or
    when no packing could have fewer bins.

    Exchanges are found by length: a bin has fewer than 64 lengths that differ, so all of its pairs have few sums, and one look at
    all items finds for each the largest sum that fits."""
    fill = [sum(lengths[i] for i in b) for b in bins]
    least, n_bins = -(-sum(fill) // size), sum(map(bool, bins))
    open_bins = [b for b in range(len(bins)) if fill[b] < size]
    if len(open_bins) < 2 or n_bins <= least:
        return bins
    item = np.array([i for b in open_bins for i in bins[b]])
    at = np.array([b for b in open_bins for _ in bins[b]])
    long = np.array([lengths[i] for i in item])
    gap = size - np.array(fill)
    place = {int(i): k for k, i in enumerate(item)}

    def put(k: int, b: int) -> None:
        bins[at[k]].remove(int(item[k]))
        gap[at[k]] += long[k]
        at[k] = b
        bins[b].append(int(item[k]))
        gap[b] -= long[k]

    def sums_of(mine: list[int]) -> tuple[np.ndarray, dict[int, tuple[int, ...]]]:
        """Sums of one or two of the items, in order, and items that have each sum: one where one does."""
        by: dict[int, list[int]] = {}
        for k in mine:
            by.setdefault(int(long[k]), []).append(k)
        groups: dict[int, tuple[int, ...]] = {}
        for x, ks in by.items():
            if len(ks) > 1:
                groups[2 * x] = (ks[0], ks[1])
        for (x, ks), (y, js) in combinations(by.items(), 2):
            groups[x + y] = (ks[0], js[0])
        groups |= {x: (ks[0],) for x, ks in by.items()}
        return np.array(sorted(groups)), groups

    def drain() -> int:
        nonlocal n_bins
        emptied, fixed = 0, np.zeros(len(bins), bool)
        while n_bins > least:
            rest = [b for b in open_bins if not fixed[b] and bins[b]]
            if len(rest) < 2:
                break
            victim = max(rest, key=lambda b: gap[b])
            while bins[victim]:
                mine = [place[i] for i in bins[victim]]
                spare = np.where((at != victim) & ~fixed[at], gap[at], -1)  # free space beside each item
                room = int(spare.max())
                movable = [k for k in mine if long[k] <= room]
                if movable:
                    k = max(movable, key=lambda k: long[k])
                    fits = np.flatnonzero(spare >= long[k])
                    put(k, at[fits[np.argmin(spare[fits])]])
                    continue
                sums, groups = sums_of(mine)
                best = np.searchsorted(sums, long + spare, "right") - 1
                gain = np.where((spare > 0) & (best >= 0), sums[best] - long, 0)
                j = int(np.argmax(gain))
                if gain[j] <= 0:
                    break
                b = at[j]
                group = groups[int(sums[best[j]])]
                put(j, victim)
                for k in group:
                    put(k, b)
            fixed[victim] = True
            if not bins[victim]:
                emptied, n_bins = emptied + 1, n_bins - 1
        return emptied

    def tighten() -> None:
        for b in sorted((b for b in open_bins if bins[b] and gap[b] > 0), key=lambda b: gap[b]):
            if gap[b] == 0:
                continue
            mine = {int(long[k]): k for k in (place[i] for i in bins[b])}
            own = np.array(sorted(mine))
            emptier = (at != b) & (gap[at] >= gap[b])
            # for each item elsewhere, the shortest item here that leaves room for it
            short = np.searchsorted(own, long - gap[b], "left")
            gain = np.where(emptier & (short < len(own)), long - own[np.minimum(short, len(own) - 1)], 0)
            j = int(np.argmax(gain))
            if gain[j] > 0:
                other = at[j]
                put(j, b)
                put(mine[int(own[short[j]])], other)

    drain()
    while n_bins > least:
        tighten()
        if not drain():
            break
    return [b for b in bins if b]


def pack(rows: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """rows (with a column length) with sequence_id and offset."""
    names = rows.columns
    tagged = rows.withColumn("tag", F.monotonically_increasing_id())
    n = max(1, -(-rows.count() // group))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got).sort_by("tag")
        lengths = table.column("length").to_pylist()
        bins = local_search(best_fit(lengths, size), lengths, size)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        base = TaskContext.get().partitionId() << 32
        for b, items in enumerate(bins):
            where = 0
            for i in items:
                sequence[i], offset[i] = base + b, where
                where += lengths[i]
        yield from pa.Table.from_arrays([*(table.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]).combine_chunks().to_batches()

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", sequence_id bigint, offset bigint"
    return tagged.repartition(n, F.xxhash64("tag")).mapInArrow(run, schema)


def packed(docs: DataFrame, name: str = VOCABULARY, size: int = SIZE) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces(docs, name, size), "pieces", keep=True), size)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
