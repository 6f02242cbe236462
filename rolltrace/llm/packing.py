"""Best-fit packing by hierarchical residual merging.

1. Texts become token ids plus an end id; longer ones than a sequence are cut into full
   pieces, the first of which may be shorter. This table of pieces is written once.
2. Each partition packs its pieces by best-fit decreasing, ``max_rows`` rows at a time. Full
   pieces and nearly full bins are emitted; bins with more than ``slack`` free tokens go on.
3. Those bins, each as one item, meet in ``fan_in`` times fewer partitions and are packed
   again, and so on up a tree. A level is as wide as ``max_rows`` rows per task asks for, so
   no task ever holds an unbounded number of them. Where the tree can't become narrower, bins
   meet others in a new deal, until a round closes or joins less than one in a hundred; the last level emits everything.

Every level is written to the shared folder, so a lost executor repeats one task of it.

Ids come from the tokenizers library alone. It splits a text into words and looks at one word at a
time; a blank between two plain characters (see ``_BETWEEN``) always begins a word. Texts are
cut there, and the library's ids of every stretch are remembered by the worker, up to a bound; those
not yet known are given to it many at a time.

Defined cases: null text is empty and is packed as its end id alone; null ids are carried; repeated
rows are packed each; an empty table gives an empty table; ties between bins of equal
room go to the newest; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialise, row_slices, text_of

CAPACITY, END_ID = 1024, 2
#: Free tokens up to which a bin counts as nearly full.
SLACK = 4
FAN_IN, MAX_ROWS = 8, 1_000_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
_PACKED = _PIECES + ", sequence_id long, offset long, done boolean"
#: A blank between two of these characters belongs to the word that follows, by any table of letters:
#: printable ASCII, and letters of Latin, Greek and Cyrillic.
_PLAIN = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f"
_BETWEEN = re.compile(f"(?<=[{_PLAIN}]) (?=[{_PLAIN}])")
#: A blank that is not between two of them.
_ODD = f"(?:\\A|[^{_PLAIN}]) | (?:\\z|[^{_PLAIN}])"
#: Stretches that a worker remembers in either of two generations, and the longest it remembers.
KEPT, KEPT_LENGTH = 600_000, 40
#: Rows and bytes of text (or one text) that are encoded at once.
ROWS, BYTES = 2000, 8_000_000
#: Stretches that go to the library as one text.
TOGETHER = 200
_SIMPLE = re.compile(f"[{_PLAIN}](?:[^ ]{{0,{KEPT_LENGTH - 2}}}[{_PLAIN}])?").fullmatch


class Ids:
    """Ids by the tokenizers file."""

    def __init__(self, json_path: str):
        # batches are small, and tasks share the cores already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        vocabulary = self.tokenizer.get_vocab()
        #: whether a token begins with a blank, which byte-level files write so
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[k for x, k in vocabulary.items() if x.startswith("\u0120")]] = True
        #: ids of what follows a blank, the blank's own included; what is not met for long goes with the older half
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _stretches(self, new: list[str]) -> dict[str, bytes]:
        """Learn the ids of stretches, each behind a blank, and return those of the ones too long to remember.
        Simple ones go to the library many in one text: only their first tokens begin with a blank, so
        these part the ids again."""
        is_simple = list(map(_SIMPLE, new))
        simple, rest = list(compress(new, is_simple)), [x for x, match in zip(new, is_simple) if not match]
        for k in range(0, len(simple), TOGETHER):
            some = simple[k : k + TOGETHER]
            ids = self._ids([f" {' '.join(some)}"])[0]
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(some) or at[0]:  # not a byte-level file
                rest += some
                continue
            raw, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            self.known.update((x, raw[i:j]) for x, i, j in zip(some, ends, ends[1:]))
        long = {}
        for x, ids in zip(rest, self._ids([f" {x}" for x in rest])):
            (self.known if len(x) <= KEPT_LENGTH else long)[x] = ids.tobytes()
        return long

    def _look_up(self, words: list[str]) -> list[bytes]:
        """The ids of every one of these different stretches."""
        if len(self.known) > KEPT:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        unmet = [x for x in words if x not in known]
        kept = {x: older[x] for x in unmet if x in older}
        known.update(kept)
        long = self._stretches([x for x in unmet if x not in kept])
        return [known[x] if x in known else long[x] for x in words] if long else list(map(known.__getitem__, words))

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        """The ids of every text."""
        if not len(texts):
            return []
        given = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(given, _ODD)
        usual = pc.split_pattern(given.filter(pc.invert(odd)), " ")
        other = pa.array([_BETWEEN.split(x) for x in given.filter(odd).to_pylist()], usual.type)
        cut = pa.concat_arrays([usual, other]).take(pa.array(np.argsort(np.argsort(odd.to_numpy(False), kind="stable"))))
        bounds = cut.offsets.to_numpy()
        stretches = cut.flatten()
        leads = np.zeros(len(stretches), bool)  # begins a text, so no blank stands before it
        leads[bounds[:-1]] = True
        coded = stretches.filter(pa.array(~leads)).dictionary_encode()
        ids = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        code = np.empty(len(stretches), np.int64)
        code[~leads] = coded.indices.to_numpy()
        code[leads] = np.arange(len(texts)) + len(ids)
        ids += [x.tobytes() for x in self._ids(stretches.filter(pa.array(leads)).to_pylist())]
        laid_out = pa.array(ids, pa.large_binary()).take(pa.array(code))
        ends = np.frombuffer(laid_out.buffers()[1], np.int64, len(code) + 1)[bounds] // 4
        return np.split(np.frombuffer(laid_out.buffers()[2], "<u4", ends[-1]), ends[1:-1])


@lru_cache(maxsize=2)
def _ids(json_path: str) -> Ids:
    return Ids(json_path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: full ones after a first that may be shorter."""
    first = n % capacity or capacity
    return [(0, first), *((k, capacity) for k in range(first, n, capacity))]


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, at most ROWS and BYTES (or one text) at a time."""
    for batch in row_slices(batches, ROWS):
        size = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(False).astype(np.int64))
        k = 0
        while k < batch.num_rows:
            full = int(np.searchsorted(size, (size[k - 1] if k else 0) + BYTES, "right"))
            yield batch.slice(k, max(full - k, 1))
            k = max(full, k + 1)


def pieces(docs: DataFrame, json_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _ids(json_path)
        for batch in bounded(batches):
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode(batch.column("text"))):
                ids = np.append(ids, np.array([end_id], "<u4")).astype("<u4")
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, _PIECES)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, and what each bin holds."""
    order = np.argsort(-sizes, kind="stable")
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, room_of = 0, []  # bit r of rooms: some bin has r free
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b = capacity, len(room_of)
            room_of.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = room_of[b] = room - size
        if left:
            with_room[left].append(b)
            rooms |= 1 << left
    return bins, offsets, capacity - np.array(room_of, np.int64)


def _level(df: DataFrame, level: int, last: bool, capacity: int, slack: int, max_rows: int) -> DataFrame:
    """Pack what each partition holds, ``max_rows`` rows at a time; from level 1 on rows arrive sorted by
    sequence_id, and those that share one move as one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 56) | (TaskContext.get().partitionId() << 36)
        held_back: list[pa.RecordBatch] = []
        rows = 0

        def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal base
            length = table.column("length").to_numpy()
            if level:
                _, item = np.unique(table.column("sequence_id").to_numpy(), return_inverse=True)
                inside = table.column("offset").to_numpy()
                sizes = np.bincount(item, weights=length).astype(np.int64)
            else:
                item, inside, sizes = np.arange(len(length)), np.zeros(len(length), np.int64), length
            bins, offsets, held = best_fit(sizes, capacity)
            where = bins[item]
            done = np.full(len(length), True) if last else (held >= capacity - slack)[where]
            cols = [*(table.column(c) for c in _NAMES), pa.array(base + where), pa.array(inside + offsets[item]), pa.array(done)]
            base += len(held)
            yield from pa.table(cols, names=[*_NAMES, "sequence_id", "offset", "done"]).to_batches(max_chunksize=50_000)

        for batch in batches:
            if not batch.num_rows:
                continue
            held_back.append(batch)
            rows += batch.num_rows
            if rows >= max_rows:
                table = pa.Table.from_batches(held_back)
                at = rows
                if level:  # the last item may go on in the next batch
                    ids = table.column("sequence_id").to_numpy()
                    at = int(np.searchsorted(ids, ids[-1]))
                if at:
                    yield from packed(table.slice(0, at))
                    held_back, rows = table.slice(at).to_batches(), rows - at
        if rows:
            yield from packed(pa.Table.from_batches(held_back))

    return df.mapInArrow(run, _PACKED)


def best_fit_packing(cut_pieces: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, fan_in: int = FAN_IN, max_rows: int = MAX_ROWS) -> DataFrame:
    """Places for the rows of :func:`pieces`: their columns, sequence_id and offset."""
    rows = materialise(cut_pieces, "pieces")
    width = rows.rdd.getNumPartitions()
    packed = materialise(_level(rows, 0, False, capacity, slack, max_rows), "packed-0")
    level, done, open_before = 0, [], None
    while True:
        done.append(packed.filter("done"))
        left = packed.filter("NOT done").drop("done")
        n, open_bins = left.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        least = max(-(-n // max_rows), 1)
        stuck = open_before is not None and width <= least and 100 * open_bins > 99 * open_before
        width, level, open_before = max(-(-width // fan_in), least), level + 1, open_bins
        last = least == width == 1 or stuck
        dealt = left.repartition(width, F.xxhash64("sequence_id", F.lit(level))).sortWithinPartitions("sequence_id")
        packed = materialise(_level(dealt, level, last, capacity, slack, max_rows), f"packed-{level}")
        if last:
            return reduce(DataFrame.unionByName, [*done, packed]).drop("done")


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """:func:`pieces` by the 50k byte-level file, then :func:`best_fit_packing`."""
    import public_tokenizers as p

    return best_fit_packing(pieces(docs, p.path("byte_bpe_50k.json")), **options)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
