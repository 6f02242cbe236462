"""N-gram Jaccard join with prefix trees, and the groups that its links make.

A text's set holds its distinct 4-word shingles as 64-bit hashes. Sets link when
100 * intersection >= 85 * union. Every link between different sets is found:

1. Equal sets (128-bit digests) form a class; only classes are joined, never their members.
2. The global order of shingles is frequent last: shingles that are frequent within blocks
   of the corpus are counted over all texts, the most frequent (a fixed number) are ordered
   by their counts, all others by hash. Any order is right; this one keeps passages that
   many texts share out of the prefixes.
3. Sets that link share a shingle among the first n - ceil(0.85 n) + 1 of each. These prefixes
   are grouped by shingle; length and position bounds leave the candidate pairs.
4. First round: in every group all members are paired with one centre only. Pairs are
   verified, links make components. Second round: in groups whose members are still in
   different components, every member outside the largest one is held against the members of
   other components with a length that allows a link, so no link between components is lost,
   while a group of thousands of near copies costs one pair per member.
5. Bit signatures bound each pair's overlap from above and drop what can't link. The rest is
   verified by a prefix tree: the sets that are paired with one text, frequent
   shingles first, are laid out in the depth-first order of their trie. The walk carries the
   overlap with the text at every depth, so a shared beginning is counted once, and a
   subtree is left when its overlap plus the remaining length can't reach the bound.
6. Components by alternating large-star and small-star steps on tables in the shared folder.

Words are hashed by a mixing step per eight bytes, long ones by keyed BLAKE2, with no structure by which words that repeat
a pattern would hash alike; a shingle's 64 bits are mixed from those of its words, so a pair of sets meets a false shingle in common with a chance of about n * n / 2^64.

Rows are told apart by class, never by doc_id: rows that share an id, or have none, are documents of their own.

Defined cases: a text of fewer than 4 words has its whole word sequence as its one
shingle; null, empty or blank text has the empty set, is linked with nothing and is its own
component; a null id can't name a component, so a row with one takes the smallest id that it
reaches, or null; rows repeated with one id are linked if their sets are equal or link, like any other rows; an empty table gives an
empty table; other columns, whatever their names, are ignored by the query and kept by :func:`drop_near_copies`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_hot_and_cold, documents, keyed, materialise, row_slices, text_of

WORDS, LOW, HIGH = 4, 85, 100
#: Shingles with an order of their own, counted in blocks of so many shingles from so many sets on.
ORDERED, BLOCK, LOCAL = 1 << 20, 4_000_000, 2
#: Sets that one trie holds; bits of the signatures, short and long, that bound an overlap from above.
TRIE, SHORT, BITS = 256, 1024, 4096
#: Sets of one shingle that one task takes; a more frequent shingle is dealt to several.
DEALT = 1024
#: Ratio of set sizes in a band of lengths; over 1 / 0.85, so that links span two bands at most.
BAND = 1.2

_U = np.uint64
_BASE, _K1, _K2 = _U(0x9E3779B97F4A7C55), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_SEED = _U(0xD6E8FEB86659FD93)
#: Words of more bytes than this are hashed by BLAKE2 one by one; masks of the first bytes of a lane.
LANES = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _K1
    x = (x ^ (x >> _U(27))) * _K2
    return x ^ (x >> _U(31))


def _word_hashes(text: str) -> np.ndarray:
    """64 bits of every word. Eight bytes at a time are mixed into a word's state by a step that is one-to-one in
    them and not linear; all words take the step together."""
    raw = text.encode().lower()  # bytes are lower-cased as ASCII
    own = np.frombuffer(raw, np.uint8)
    blank = np.concatenate(([True], _BLANK[own], [True]))
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    lanes = np.ndarray(len(raw) + 1, "<u8", raw + bytes(8), strides=(1,))
    state = _mix(size.astype(_U) * _K2 + _SEED)
    at = np.flatnonzero(size <= LANES)
    for k in range(0, LANES, 8):
        at = at[size[at] > k]
        if not len(at):
            break
        lane = lanes[start[at] + k] & _MASK[np.minimum(size[at] - k, 8)]
        state[at] = _mix((state[at] ^ lane) * _K1 + _BASE)
    for k in np.flatnonzero(size > LANES).tolist():
        word = raw[start[k] : start[k] + size[k]]
        state[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"words").digest(), "little")
    return state


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    word = _word_hashes(text)
    if not len(word):
        return np.empty(0, _U)
    n = min(WORDS, len(word))
    size = len(word) - n + 1
    out = word[:size]
    for k in range(1, n):
        out = _mix(out * _BASE + word[k : k + size])
    return np.unique(out)


def required(a: int, b: int) -> int:
    """Least intersection of sets of ``a`` and ``b`` that links them."""
    return -(-LOW * (a + b) // (LOW + HIGH))


def prefix_length(n: int) -> int:
    return n - (LOW * n + HIGH - 1) // HIGH + 1


def _digest(values: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(values.tobytes(), digest_size=16).digest(), np.int64).tolist())


def signature(values: np.ndarray, size: int = BITS) -> bytes:
    """A bit per hash class of the set's members."""
    bits = np.zeros(size, np.uint8)
    bits[(values % _U(size)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def _may_link(na, nb, sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """Whether signatures allow a link: every bit of one set that the other lacks is a member,
    at least, that the other lacks."""
    most = np.minimum(na - np.bitwise_count(sa & ~sb).sum(-1, dtype=np.int64), nb - np.bitwise_count(sb & ~sa).sum(-1, dtype=np.int64))
    return most * (LOW + HIGH) >= LOW * (na + nb)


class Order:
    """Global order of shingles: by count for the frequent ones, then by hash."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        at = np.argsort(hashes)
        self.hashes, self.counts = hashes[at], counts[at]

    def count(self, values: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(values), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, values), len(self.hashes) - 1)
        return np.where(self.hashes[at] == values, self.counts[at], 0)

    def first(self, values: np.ndarray, n: int) -> np.ndarray:
        """The first ``n`` of hash-sorted ``values``."""
        return values[np.argsort(self.count(values), kind="stable")[:n]]

    def frequent_first(self, values: np.ndarray) -> np.ndarray:
        return values[np.argsort(-self.count(values), kind="stable")]


def _texts(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """doc_id, mark (a hash of the text), text, and rid, the row's number where ``rid`` names one."""
    own = F.lit(None).cast("long") if rid is None else F.col(rid).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), own.alias("rid"))
    return rows.select("doc_id", F.xxhash64("text").alias("mark"), "text", "rid")


def _profiles(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """A row per text (doc_id, mark, rid, n, d1, d2, bits as longs), and a row per locally frequent shingle (hash, n)."""

    def frequent(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, counts = np.unique(np.concatenate(sets), return_counts=True)
        keep = counts >= LOCAL
        return values[keep], counts[keep]

    names = ["doc_id", "mark", "rid", "n", "d1", "d2", "bits", "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        seen: set[tuple[int, int]] = set()
        held = 0

        def counted() -> pa.RecordBatch:
            values, counts = frequent(sets)
            none = pa.nulls(len(values), pa.int64())
            bits = pa.nulls(len(values), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(counts, pa.int64()), none, none, bits, pa.array(values.view(np.int64))], names)

        for batch in row_slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                values = shingle_set(text)
                key = _digest(values)
                rows.append((len(values), *key, np.frombuffer(signature(values, SHORT), np.int64)))
                if len(values) and key not in seen:
                    seen.add(key)
                    sets.append(values)
                    held += len(values)
            n, d1, d2, bits = zip(*rows)
            cols = [batch.column(c) for c in ("doc_id", "mark", "rid")] + [pa.array(x, pa.int64()) for x in (n, d1, d2)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bits, pa.list_(pa.int64())), pa.nulls(len(rows), pa.int64())], names)
            if held >= BLOCK:
                yield counted()
                sets, seen, held = [], set(), 0
        if sets:
            yield counted()

    return _texts(docs, rid).mapInArrow(run, "doc_id long, mark long, rid long, n long, d1 long, d2 long, bits array<long>, hash long")


def _order(profiles: DataFrame) -> Order:
    top = profiles.filter("hash IS NOT NULL").groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(ORDERED)
    got = top.toArrow()
    return Order(got.column("hash").to_numpy().astype(np.int64).view(_U), got.column("n").to_numpy().astype(np.int64))


def _prefixes(docs: DataFrame, order) -> DataFrame:
    """token, d1, d2, n, pos, parts: the prefix of every set, once per partition; a token is
    dealt to ``parts`` tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = order.value, set()
        for batch in row_slices(batches):
            tokens, parts, rows, sizes = [], [], [], []
            for text in batch.column("text").to_pylist():
                values = shingle_set(text)
                key = _digest(values)
                if not len(values) or key in seen:
                    continue
                seen.add(key)
                some = own.first(values, prefix_length(len(values)))
                tokens.append(some)
                parts.append(own.count(some) // DEALT + 1)
                sizes.append(len(some))
                rows.append((*key, len(values)))
            if not rows:
                continue
            times = np.array(sizes)
            each = np.repeat(np.array(rows, np.int64), times, axis=0)
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            cols = [np.concatenate(tokens).view(np.int64), *(np.ascontiguousarray(each[:, k]) for k in range(3)), place.astype(np.int64), np.concatenate(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["token", "d1", "d2", "n", "pos", "parts"])

    return _texts(docs).select("text").mapInArrow(run, "token long, d1 long, d2 long, n long, pos long, parts long")


def _shared(entries: DataFrame) -> DataFrame:
    """The entries whose token occurs in two classes at least, once per class. Tokens that are
    dealt to several tasks pass as they are. Rows arrive sorted and are never gathered: all
    that is held between batches is the first row of the last token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, alone = None, None  # the row before; that of a token with one class so far
        for batch in row_slices(batches):
            if not batch.num_rows:
                continue
            if alone is not None:
                batch = pa.Table.from_batches([alone, batch]).combine_chunks().to_batches()[0]
            token, d1, d2, parts = (batch.column(c).to_numpy() for c in ("token", "d1", "d2", "parts"))
            goes_on = alone is None and before is not None and before[0] == token[0]
            new_token = np.concatenate(([not goes_on], token[1:] != token[:-1]))
            new = new_token | np.concatenate(([False], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])))
            new[0] = not (goes_on and before == (token[0], d1[0], d2[0]))
            group = np.cumsum(new_token) - new_token[0]
            several = (np.bincount(group, weights=new) > 1) | (np.bincount(group, weights=parts > 1) > 0)
            several[0] |= goes_on
            before = (token[-1], d1[-1], d2[-1])
            alone = None if several[-1] else batch.slice(int(np.searchsorted(group, group[-1])), 1)
            yield batch.filter(pa.array(new & several[group]))

    dealt = entries.repartition("token", F.pmod("d1", "parts")).sortWithinPartitions("token", "d1", "d2")
    return dealt.mapInArrow(run, entries.schema)


def _possible(a: str, b: str) -> Column:
    """Length and position bounds of a pair that shares a token."""
    na, nb, pa_, pb = (F.col(f"{t}.{c}") for c in ("n", "pos") for t in (a, b))
    return (
        (HIGH * F.least(na, nb) >= LOW * F.greatest(na, nb))
        & ((1 + F.least(na - 1 - pa_, nb - 1 - pb)) * (LOW + HIGH) >= LOW * (na + nb))
    )


def _centre_pairs(blocks: DataFrame) -> DataFrame:
    """(a, b): every member of a group with the group's centre, the member with the fewest rarer
    shingles: of the near copies of one text, that text."""
    centre = F.min_by(F.struct("node", "n", "pos"), F.struct("pos", "node")).alias("c")
    centres = blocks.groupBy("token").agg(centre, F.count(F.lit(1)).alias("size"))
    pairs = by_hot_and_cold(blocks.select("token", F.struct("node", "n", "pos").alias("x")), centres, ["token"], "size", blocks.count())
    pairs = pairs.filter((F.col("x.node") != F.col("c.node")) & _possible("x", "c"))
    return pairs.select(F.col("c.node").alias("a"), F.col("x.node").alias("b")).distinct()


def _signatures_allow(a: str, b: str) -> Column:
    """As :func:`_may_link`, of short signatures."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    words = [(F.get(f"{a}.bits", k), F.get(f"{b}.bits", k)) for k in range(SHORT // 64)]
    lacks = lambda pairs: reduce(lambda x, y: x + y, (F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in pairs))
    most = F.least(na - lacks(words), nb - lacks((y, x) for x, y in words))
    return most * (LOW + HIGH) >= LOW * (na + nb)


def _open_pairs(blocks: DataFrame, components: DataFrame, bits: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of a group whose components differ and whose bounds and short
    signatures allow a link.

    Of two members in different components one, at least, is outside the group's largest
    component. Only those probe the group, so near copies cost nothing among each other. Groups
    are parted by length: sets that link are in the same or neighbouring bands."""
    placed = materialise(blocks.join(components, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "jaccard-placed")
    by_comp = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("own"))
    groups = by_comp.groupBy("token").agg(F.sum("own").alias("size"), F.max_by("comp", F.struct("own", "comp")).alias("largest"), F.count(F.lit(1)).alias("comps"))
    split = materialise(groups.filter("comps > 1").drop("comps"), "jaccard-groups")
    band = F.floor(F.log(F.col("n")) / math.log(BAND)).cast("int")
    rows = by_hot_and_cold(placed, split, ["token"], "size", placed.count()).join(bits, ["node", "n"])
    # a group of more than DEALT sets is held against its probes in several tasks
    parts = (F.col("size") / DEALT).cast("long") + 1
    rows = rows.select("token", "node", "n", "pos", "comp", "largest", "bits", band.alias("band"), parts.alias("parts"))
    rows = materialise(rows, "jaccard-split")
    probes = rows.filter("comp <> largest").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    probes = probes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    held = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    once = (F.col("y.comp") == F.col("x.largest")) | (F.col("x.node") < F.col("y.node"))
    fits = (F.col("x.comp") != F.col("y.comp")) & once & _possible("x", "y") & _signatures_allow("x", "y")
    on = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.part") == F.col("y.part"))
    pairs = probes.alias("x").join(held.alias("y"), on & fits)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def walk(text: np.ndarray, others: list[np.ndarray]) -> list[int]:
    """Indices of those ``others`` that link with ``text``; all frequent shingles first.

    Sequences in lexicographic order are a trie in depth-first order: a set enters
    the tree where it leaves the one before it, at the depth of their common beginning."""
    probe = np.sort(text)
    found, before, overlap = [], np.empty(0, _U), np.zeros(1, np.int64)
    for k in sorted(range(len(others)), key=lambda k: others[k].astype(">u8").tobytes()):
        own = others[k]
        need = required(len(text), len(own))
        m = min(len(before), len(own))
        differ = np.flatnonzero(before[:m] != own[:m])
        depth = int(differ[0]) if len(differ) else m
        depth = min(depth, len(overlap) - 1)
        shared = int(overlap[depth])
        if shared + min(len(own) - depth, len(text) - shared) < need:
            # the subtree is left; what is known of the path stays for the sets that follow
            before, overlap = own[:depth], overlap[: depth + 1]
            continue
        rest = own[depth:]
        at = np.minimum(np.searchsorted(probe, rest), len(probe) - 1)
        overlap = np.concatenate((overlap[: depth + 1], shared + np.cumsum(probe[at] == rest)))
        before = own
        if int(overlap[-1]) >= need:
            found.append(k)
    return found


def _within_bounds(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose long signatures allow a link; ``part`` and ``node`` tell a set."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("part").alias(f"p{x}"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"s{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(na), -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b", "pa", "pb"]).filter(pa.array(_may_link(na, nb, sa, sb)))

    wanted = pairs.join(of("a"), ["a", "pa"]).join(of("b"), ["b", "pb"]).select("a", "b", "pa", "pb", "na", "nb", "sa", "sb")
    return wanted.mapInArrow(run, "a long, b long, pa int, pb int")


def _sets(nodes: DataFrame, docs: DataFrame, order) -> DataFrame:
    """node, part, n, bits, blob: the sets of ``nodes`` (node, d1, d2, rep), each from the text that represents it.

    A text that several rows have under one id comes from every task that holds one; ``part``, the
    task, tells these apart."""

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = order.value, TaskContext.get().partitionId(), set()
        for batch in row_slices(batches):
            rows = []
            for node, d1, d2, text in zip(*(batch.column(c).to_pylist() for c in ("node", "d1", "d2", "text"))):
                if node not in seen and _digest(values := shingle_set(text)) == (d1, d2):
                    seen.add(node)
                    rows.append((node, part, len(values), signature(values), own.frequent_first(values).tobytes()))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["node", "part", "n", "bits", "blob"])

    wanted = nodes.select("node", "d1", "d2", F.col("rep.doc_id").alias("rep_id"), F.col("rep.mark").alias("rep_mark"))
    same = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("mark") == F.col("rep_mark"))
    texts = _texts(docs).join(wanted, same).select("node", "d1", "d2", "text")
    return materialise(texts.mapInArrow(ordered, "node long, part int, n long, bits binary, blob binary"), "jaccard-sets")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, order) -> DataFrame:
    """Those of the (a, b) pairs that link."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    full = _sets(classes.join(nodes, "node"), docs, order)
    one = full.groupBy("node").agg(F.min("part").alias("part"))
    of = lambda x: one.select(F.col("node").alias(x), F.col("part").alias(f"p{x}"))
    pairs = materialise(_within_bounds(pairs.join(of("a"), "a").join(of("b"), "b"), full), "jaccard-within")
    sets = lambda x: full.select(F.col("node").alias(x), F.col("part").alias(f"p{x}"), "blob")
    spread = F.pmod(F.xxhash64("b"), F.lit(16))  # a centre of thousands of pairs is walked by several tasks
    wanted = pairs.withColumn("salt", spread)
    centres = wanted.select("a", "pa", "salt").distinct().join(sets("a"), ["a", "pa"]).select("a", "salt", "blob")
    rows = wanted.join(sets("b"), ["b", "pb"]).select("a", "salt", "b", "blob")
    rows = rows.unionByName(centres.withColumn("b", F.lit(None).cast("long"))).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, probe = None, None
        ids: list[int] = []
        others: list[np.ndarray] = []

        def links() -> pa.RecordBatch:
            good = [ids[k] for k in walk(probe, others)]
            ids.clear()
            others.clear()
            return pa.RecordBatch.from_arrays([pa.array([at] * len(good), pa.int64()), pa.array(good, pa.int64())], ["a", "b"])

        for batch in row_slices(batches):
            for a, b, blob in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "blob"))):
                if b is None:
                    if ids:
                        yield links()
                    at, probe = a, np.frombuffer(blob, _U)
                    continue
                if len(ids) >= TRIE:
                    yield links()
                ids.append(b)
                others.append(np.frombuffer(blob, _U))
        if ids:
            yield links()

    return rows.select("a", "b", "blob").mapInArrow(run, "a long, b long").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, comp (its smallest reachable node) for the nodes of (a, b) edges."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select("b", "a"))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lows = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")).select(F.col("a").alias("u"), "low")
        joined = both.join(lows, F.col("a") == F.col("u"))
        if large:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(lows.select("u", "low"))
        return out.filter("a <> b").distinct()

    state = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    edges, last = materialise(edges.filter("a <> b"), "edges"), None
    while True:
        edges = materialise(star(star(edges, True), False), "stars")
        now = edges.agg(state.alias("s")).first()[0]
        if now == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        last = now


def jaccard_groups(docs: DataFrame, rid: str | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, rid, kept per row of ``docs``, which needs doc_id and text. ``rid`` names
    a column that numbers the rows, if there is one; then ``kept`` tells one row of each component."""
    spark = docs.sparkSession
    profiles = materialise(_profiles(docs, rid), "jaccard-profiles")
    order = spark.sparkContext.broadcast(_order(profiles))
    rows = profiles.filter("hash IS NULL").select("doc_id", "mark", "rid", "n", "d1", "d2", "bits")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "rid")
    by_class = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min(first).alias("rep"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("size"))
    classes = materialise(by_class.withColumn("node", F.monotonically_increasing_id()), "jaccard-classes")
    names = classes.select("d1", "d2", "node")
    shared = materialise(_shared(_prefixes(docs, order)), "jaccard-shared")
    blocks = materialise(shared.join(names, ["d1", "d2"]).select("token", "node", "n", "pos"), "jaccard-blocks")
    pairs = materialise(_centre_pairs(blocks), "jaccard-pairs")
    links = materialise(_verified(pairs, classes, docs, order), "jaccard-links")
    again = _open_pairs(blocks, connected(links), classes.select("node", "n", "bits")).join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    again = materialise(again, "jaccard-open")
    if again.limit(1).count():
        links = links.union(_verified(again, classes, docs, order))
    own = classes.select("d1", "d2", "node", "rep", "size").join(connected(links), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lowest = own.groupBy("comp").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("classes"))
    named = by_hot_and_cold(own, lowest, ["comp"], "classes", classes.count()).select("d1", "d2", "size", "low")
    some = rows.filter("n > 0").select("doc_id", "rid", "n", "d1", "d2")
    placed = by_hot_and_cold(some, materialise(named, "jaccard-named"), ["d1", "d2"], "size", some.count())
    out = placed.select("doc_id", F.col("n").alias("n_shingles"), F.col("low.doc_id").alias("component_id"), "rid", (F.col("rid") == F.col("low.rid")).alias("kept"))
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "rid", F.lit(True).alias("kept"))
    return out.unionByName(alone)


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, the one of smallest id, and all rows without words; all its columns."""
    rows, rid = keyed(docs, "jaccard-docs")
    stays = jaccard_groups(rows, rid).filter("kept").select(F.col("rid").alias(rid))
    return rows.join(stays, rid, "left_semi").select(*(f"`{c}`" for c in docs.columns))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT r, hash(g) AS h, g FROM (
    SELECT r, list_slice(w, i + 1, i + {WORDS}) AS g
    FROM (SELECT r, w, unnest(range(CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - {WORDS - 1}, 1) END)) AS i FROM d))),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
numbered AS (SELECT r, dense_rank() OVER (ORDER BY h, g) AS s FROM grams),
shared AS (
  SELECT x.r AS a, y.r AS b, count(*) AS n
  FROM numbered x JOIN numbered y ON x.s = y.s AND x.r < y.r GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b
  WHERE {HIGH} * shared.n >= {LOW} * (p.n + q.n - shared.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a, b FROM edges
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
lowest AS (SELECT a, min(doc_id) AS low FROM reach JOIN d ON d.r = reach.b GROUP BY a)
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, low) AS BIGINT) AS component_id
FROM d LEFT JOIN sizes ON sizes.r = d.r LEFT JOIN lowest ON lowest.a = d.r"""
