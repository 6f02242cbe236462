"""Byte-level BPE encoding and decoding by recursive DuckDB queries.

Each partition splits its texts with the tokenizer's pattern and sends every word it has not
met yet to an in-process DuckDB. A word is a set of rows, one per token: its position, the
position of the next token, both ids, and the merged id that the merge table has for the two.
Every step of the recursion contracts, in all words at once, the occurrences of each word's
pair of minimum rank, from the left, and looks up only the pairs that this changed, until no
word has one left. The recursion is keyed by position, so a step replaces the rows of the one
before and memory is that of one state. Words go in chunks of bounded bytes.

Contracting all occurrences of the minimum at once gives what contracting the leftmost one again
and again does if every token of the vocabulary is encoded as itself: a pair that a contraction
makes then never has a lower rank. This is checked, by the same query, when the vocabulary is
loaded. Long words are parted where no token of the vocabulary that stands in the word reaches
across; no contraction can cross such a place.

A text's ids are those of its words in order. Decoding starts from these ids alone: rows of
(text, position, id) join the vocabulary, and an ordered aggregation gives the bytes.

Defined cases: null text is empty (no ids, digests of nothing); any text is encoded whole, in
memory linear in its length; null and repeated ids are carried and repeated rows come back
each; empty table, empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, row_slices, text_of

#: Bytes of words that one recursive query takes (one longer word goes alone), ids that one decoding
#: query takes, and bytes of words and their ids that a worker remembers between batches.
CHUNK, DECODED, KEPT = 400_000, 400_000, 120_000_000
#: Characters of texts whose words are held from learning to encoding; others are split again.
HELD = 3_000_000
#: Words from this length on are parted before they go to the recursion.
LONG = 64

_ENCODE = """
WITH RECURSIVE s(p, w, q, a, b, m) USING KEY (p) AS (
  SELECT p, w, q, a, b, merges.m FROM pairs LEFT JOIN merges ON merges.ab = (a::BIGINT << 20 | b)
  UNION ALL (
  WITH open AS (SELECT w, min(m) AS least FROM s WHERE m IS NOT NULL GROUP BY w),
  found AS (
    SELECT p, q, m, row_number() OVER (ORDER BY p) AS i, lag(q) OVER (ORDER BY p) AS before
    FROM s JOIN open ON open.w = s.w AND least = m),
  -- where occurrences overlap, every other one from the left is contracted
  placed AS (
    SELECT p, q, m, i - max(CASE WHEN before = p THEN 0 ELSE i END) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING) AS k FROM found),
  pick AS (SELECT p AS p0, q AS q0, m AS m0 FROM placed WHERE k % 2 = 0),
  now AS (
    SELECT coalesce(l.p0, s.p) AS p, s.w, s.q, coalesce(l.m0, s.a) AS a, coalesce(r.m0, s.b) AS b, s.m,
           l.p0 IS NOT NULL OR r.p0 IS NOT NULL AS changed
    FROM s JOIN open ON open.w = s.w LEFT JOIN pick l ON l.q0 = s.p LEFT JOIN pick r ON r.p0 = s.q
    WHERE s.a >= 0 AND s.p NOT IN (SELECT p0 FROM pick))
  SELECT p, w, q, a, b, CASE WHEN changed THEN merges.m ELSE now.m END
  FROM now LEFT JOIN merges ON merges.ab = (CASE WHEN changed AND b >= 0 THEN a::BIGINT << 20 | b END)
  UNION ALL SELECT q0, NULL, -1, -1, -1, NULL FROM pick))
SELECT w, a FROM s WHERE a >= 0 ORDER BY p
"""

_DECODE = """
SELECT d, unhex(string_agg(hex, '' ORDER BY p)) AS bytes FROM ids JOIN vocabulary ON vocabulary.id = ids.id GROUP BY d ORDER BY d
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_table(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """Every (left id, right id, merged id) that the ranks allow."""
    return [
        (ranks[tok[:k]], ranks[tok[k:]], rank)
        for tok, rank in ranks.items()
        for k in range(1, len(tok))
        if tok[:k] in ranks and tok[k:] in ranks
    ]


class Encoder:
    """Encodes and decodes; remembers words it has met, up to ``KEPT`` bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import duckdb
        import regex

        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[bytes, str]] = {}
        self.held = 0
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        merges = np.array(merge_table(ranks), np.int64).reshape(-1, 3)
        self.con = duckdb.connect()
        for setting in ("threads = 1", "memory_limit = '250MB'", "temp_directory = ''"):
            self.con.execute(f"SET {setting}")
        table = pa.table({"ab": merges[:, 0] << 20 | merges[:, 1], "m": merges[:, 2].astype(np.int32)})  # noqa: F841
        names = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [t.hex() for t in ranks]})  # noqa: F841
        self.con.execute("CREATE TABLE merges AS SELECT ab, m FROM \"table\"")
        self.con.execute("CREATE TABLE vocabulary AS SELECT id, hex FROM names")
        self.tokens = ahocorasick.Automaton()
        for token in ranks:
            if len(token) > 1:
                self.tokens.add_word(token.decode("latin-1"), len(token))
        if len(self.tokens):
            self.tokens.make_automaton()
        for (token, rank), ids in zip(ranks.items(), self.merged(list(ranks))):
            if ids.tolist() != [rank]:
                raise ValueError(f"token {rank} is not encoded as itself, so equal pairs can't be contracted together: {token!r}")

    def parts(self, raw: bytes) -> list[bytes]:
        """``raw``, parted where no token that stands in it reaches across."""
        if len(raw) < LONG or not len(self.tokens):
            return [raw]
        inside = bytearray(len(raw) + 1)
        for last, length in self.tokens.iter(raw.decode("latin-1")):
            for k in range(last - length + 2, last + 1):
                inside[k] = 1
        at = [0, *(k for k in range(1, len(raw)) if not inside[k]), len(raw)]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def merged(self, raw: list[bytes]) -> list[np.ndarray]:
        """The ids of every one of ``raw`` by the recursion, in chunks."""
        return [token[a:b] for token, at in self._chunks(raw) for a, b in zip(at, at[1:])]

    def _chunks(self, raw: list[bytes]) -> Iterator[tuple[np.ndarray, list[int]]]:
        """The ids of ``raw``, chunk by chunk, and where each of the chunk's begins, with the end."""
        some, size = [], 0
        for x in raw:
            if some and size + len(x) > CHUNK:
                yield self._query(some)
                some, size = [], 0
            some.append(x)
            size += len(x)
        if some:
            yield self._query(some)

    def _query(self, raw: list[bytes]) -> tuple[np.ndarray, list[int]]:
        length = np.array([len(x) for x in raw])
        end = np.cumsum(length)
        ids = self.single[np.frombuffer(b"".join(raw), np.uint8)]
        p = np.arange(len(ids), dtype=np.int32)
        q, after = p + np.int32(1), np.append(ids[1:], np.int32(-1))
        q[end - 1] = after[end - 1] = -1
        pairs = pa.table({"p": p, "w": np.repeat(np.arange(len(raw), dtype=np.int32), length), "q": q, "a": ids, "b": after})
        self.con.register("pairs", pairs)
        try:
            got = self.con.sql(_ENCODE).to_arrow_table()
        finally:
            self.con.unregister("pairs")
        word, token = got.column("w").to_numpy(), got.column("a").to_numpy()
        return token, np.searchsorted(word, np.arange(len(raw) + 1)).tolist()

    def learn(self, words: list[str]) -> None:
        """Put ``words``, all different, into ``known``: their ids as little-endian 32-bit numbers, and as decimals."""
        short, long = [], []
        for w in words:
            (short if len(raw := w.encode()) < LONG else long).append((w, raw))
        names = iter([w for w, _ in short])
        for token, at in self._chunks([raw for _, raw in short]):
            raw, shown = token.astype("<i4").tobytes(), list(map(str, token.tolist()))
            for a, b, w in zip(at, at[1:], names):
                self.known[w] = (raw[4 * a : 4 * b], ",".join(shown[a:b]))
                self.held += len(w)
            self.held += 149 * (len(at) - 1) + len(raw) + sum(map(len, shown)) + len(shown)
        cut = [self.parts(raw) for _, raw in long]
        distinct = list({x for parts in cut for x in parts})
        ids = dict(zip(distinct, (x.astype("<i4").tobytes() for x in self.merged(distinct))))
        for (w, _), parts in zip(long, cut):
            raw = b"".join([ids[x] for x in parts])
            shown = ",".join(map(str, np.frombuffer(raw, "<i4").tolist()))
            self.known[w] = (raw, shown)
            self.held += 150 + len(w) + len(raw) + len(shown)

    def forget(self, words: list[str]) -> None:
        """Of what is remembered only ``words`` stay, if it is too much."""
        if self.held > KEPT:
            self.known = {w: self.known[w] for w in words if w in self.known}
            self.held = sum(150 + len(w) + len(x) + len(y) for w, (x, y) in self.known.items())

    def encode(self, text: str, words: list[str] | None = None) -> tuple[np.ndarray, str]:
        """The ids of a text, whose ``words`` may be given, and the same joined by commas."""
        words = self.split(text) if words is None else words
        try:
            got = list(map(self.known.__getitem__, words))
        except KeyError:
            self.forget(words)
            self.learn(list({w for w in words if w not in self.known}))
            got = list(map(self.known.__getitem__, words))
        return np.frombuffer(b"".join([x for x, _ in got]), "<i4"), ",".join([y for _, y in got])

    def prepare(self, texts: list[str]) -> list[list[str] | None]:
        """Learn the new words of several texts together: one query serves many; the words of each text. Texts whose
        words are too many to be held at once get None, and those too many to be remembered are left to :meth:`encode`."""
        distinct, size, out = set(), 0, []
        for text in texts:
            words = self.split(text)
            distinct.update(words)
            size += len(text)
            out.append(words if size <= HELD else None)
            if size > KEPT // 10:
                break
        self.forget(list(distinct))
        if new := [w for w in distinct if w not in self.known]:
            self.learn(new)
        return out + [None] * (len(texts) - len(out))

    def decode(self, texts: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, bytes) of the stretches of id sequences, in order."""
        length = np.array([len(x) for x in texts], np.int64)
        ids, text = np.concatenate([*texts, np.empty(0, np.int32)]).astype(np.int32), np.repeat(np.arange(len(texts)), length)
        for k in range(0, len(ids), DECODED):
            some = slice(k, k + DECODED)
            self.con.register("ids", pa.table({"d": text[some], "p": np.arange(len(ids[some])), "id": ids[some]}))
            try:
                yield from self.con.execute(_DECODE).fetchall()
            finally:
                self.con.unregister("ids")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


def byte_bpe(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs``; with ``with_ids``
    also ids (comma-joined) and decoded (binary). ``path`` is the rank file on every executor."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in row_slices(batches):
            texts = batch.column("text").to_pylist()
            found = list(map(own.encode, texts, own.prepare(texts)))
            decoded, whole = [hashlib.sha256() for _ in texts], [[] for _ in texts]
            for k, stretch in own.decode([ids for ids, _ in found]):
                decoded[k].update(stretch)
                if with_ids:
                    whole[k].append(stretch)
            cols = [
                batch.column("doc_id"),
                pa.array([len(ids) for ids, _ in found], pa.int64()),
                pa.array([hashlib.sha256(shown.encode()).hexdigest() for _, shown in found], pa.string()),
                pa.array([x.hexdigest() for x in decoded], pa.string()),
            ]
            if with_ids:
                cols += [pa.array([shown for _, shown in found], pa.string()), pa.array([b"".join(x) for x in whole], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded binary" * with_ids
    return rows.mapInArrow(run, schema)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
