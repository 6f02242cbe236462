"""Substring dedup by hashing paragraphs, lines, sentences and winnowed windows.

Each text is cut into units: its paragraphs (between blank lines), its lines whatever their
length, and the sentences of ``min_words`` words or more of lines that have several.
Besides, winnowing picks windows of ``WINDOW`` words by a digest of the words there, so that
every passage of ``PASSAGE`` words shares one with its copies, wherever its borders and
its line breaks fall. A unit is normalised (lower case, words joined by single blanks) and
digested to 128 bits. Digests are grouped globally; the occurrence that ranks first by
(doc_id, digest of the text, row, start) stays and all others are removed, with offsets into the original text.

The grouping is a minimum per digest, which is combined before the shuffle, so a line
that a third of the texts share is one row per task there. Only digests that occur twice go
on to the join that finds the occurrences to remove; the most frequent ones join by broadcast
where their occurrences are, so none of them gathers in a task.

Units carry the number of the row they stand in, given once when they are written, and what is
removed goes by this number: rows that share an id, or have none, never share offsets.

Defined cases: null text has no units and nothing is removed; null ids rank last; a row that
occurs twice keeps its units in the first copy only, as does a text under two ids; overlapping spans (a
line and its sentences) merge; an empty table gives an empty table; other columns, whatever
their names, are ignored by the query and kept by :func:`remove_spans`.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_hot_and_cold, documents, free_name, keyed, materialise, row_slices, text_of

#: Floor for sentences inside a line; lines themselves have none.
MIN_WORDS = 3
#: Every passage of PASSAGE words holds a window of WINDOW words that its copies hold too.
PASSAGE, WINDOW = 50, 20

_PARAGRAPH = re.compile(r"[^\n]*\S[^\n]*(?:\n[^\n]*\S[^\n]*)*")
_LINE = re.compile(r"[^\n]+")
_WORD = re.compile(r"\S+")
_SENTENCE = re.compile(r"\S[^.!?]*(?:[.!?]+(?!\s)[^.!?]*)*[.!?]*")


def _spans(text: str, min_words: int) -> Iterator[tuple[int, int]]:
    """Paragraphs, lines and sentences, white space around them included; some come twice."""
    for paragraph in _PARAGRAPH.finditer(text):
        yield paragraph.span()
        for line in _LINE.finditer(text, *paragraph.span()):
            yield line.span()
            parts = [x.span() for x in _SENTENCE.finditer(text, *line.span())]
            yield from ((a, b) for a, b in parts if len(parts) > 1 and len(text[a:b].split()) >= min_words)


def _windows(text: str) -> Iterator[tuple[int, int]]:
    """Windows by winnowing: of those that start in a passage, the one whose first two words have the least digest."""
    places = [x.span() for x in _WORD.finditer(text)]
    if len(places) < PASSAGE:
        return
    sums = np.array([zlib.crc32(text[a:b].lower().encode("utf-8", "surrogatepass")) for a, b in places], np.uint64)
    pairs = ((sums[:-1] * np.uint64(31) + sums[1:]) * np.uint64(0x9E3779B97F4A7C15))[: len(places) - WINDOW + 1]
    starts = PASSAGE - WINDOW + 1
    # of equal ones the last, so that a word said on and on has windows all along
    least = np.lib.stride_tricks.sliding_window_view(pairs, starts)[:, ::-1].argmin(axis=1)
    for k in np.unique(np.arange(len(least)) + starts - 1 - least).tolist():
        yield places[k][0], places[k + WINDOW - 1][1]


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, digest) of a text's units, in code points."""
    spans, reach = set(), {}
    for a, b in (*_spans(text, min_words), *_windows(text)):
        own = text[a:b].rstrip()
        spans.add((a + len(own) - len(own.lstrip()), a + len(own)))
    for start, end in sorted(spans):
        digest = hashlib.blake2b(" ".join(text[start:end].lower().split()).encode(), digest_size=16).digest()
        # one that overlaps the last of its kind would take from the one that stays
        if start >= reach.get(digest, 0):
            reach[digest] = end
            yield start, end, digest


def unit_table(docs: DataFrame, min_words: int = MIN_WORDS, rid: str | None = None) -> DataFrame:
    """rid, doc_id, mark (a digest of the text), start, end, digest: every unit, and for every row of
    ``docs`` one more with start -1 and no digest. ``rid`` names a column that tells rows apart;
    without, rows are numbered here, and the table has to be written before it is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in row_slices(batches):
            rows = []
            numbers = range(row, row + batch.num_rows) if rid is None else batch.column("rid").to_pylist()
            row += batch.num_rows
            for number, doc_id, text in zip(numbers, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                mark = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)
                rows.append((number, doc_id, mark, -1, 0, None))
                rows += [(number, doc_id, mark, *unit) for unit in units(text, min_words)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["rid", "doc_id", "mark", "start", "end", "digest"])

    own = [] if rid is None else [F.col(rid).cast("long").alias("rid")]
    rows = docs.select(*own, F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "rid long, doc_id long, mark long, start int, end int, digest binary")


def repeated_spans(table: DataFrame) -> DataFrame:
    """Every occurrence but the first of every repeated unit of a written :func:`unit_table`: rid, start, end."""
    occurrences = table.filter("digest IS NOT NULL")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "rid", "start")
    first = occurrences.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = materialise(first, "repeated-units")
    total = occurrences.count()
    found = by_hot_and_cold(occurrences.drop("doc_id", "mark"), first, ["digest"], "n", total)
    # the first occurrence is told by its row and place
    return found.filter((F.col("rid") != F.col("first.rid")) | (F.col("start") != F.col("first.start"))).select("rid", "start", "end")


def merged(spans: DataFrame) -> DataFrame:
    """rid, and ``removed``: its disjoint (start, end) spans in order."""
    before = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    apart = F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int")
    upto = Window.partitionBy("rid").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = spans.withColumn("apart", apart).withColumn("run", F.sum("apart").over(upto))
    disjoint = runs.groupBy("rid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return disjoint.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("removed"))


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_removed, removed_chars, spans ("start:end,..." of the original text) per row."""
    table = materialise(unit_table(docs, min_words), "units")
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    shown = F.array_join(F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return table.filter("start < 0").select("rid", "doc_id").join(merged(repeated_spans(table)), "rid", "left").select(
        "doc_id",
        F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(size, F.lit(0).cast("long")).alias("removed_chars"),
        F.coalesce(shown, F.lit("")).alias("spans"),
    )


def remove_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without the repeated units in ``text``; all other columns as they were."""
    rows, rid = keyed(docs, "substring-dedup-docs")
    table = materialise(unit_table(rows, min_words, rid), "units")
    gone = free_name("gone", rows.columns)
    found = merged(repeated_spans(table)).select(F.col("rid").alias(rid), F.col("removed").alias(gone))
    joined = rows.join(found, rid, "left").select(*(f"`{c}`" for c in docs.columns), gone)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches):
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(texts[k])]
                    texts[k] = "".join([texts[k][a:b] for a, b in zip(edges[::2], edges[1::2])])
            left = batch.select(range(batch.num_columns - 1))
            yield left.set_column(at, left.schema.field(at), pa.array(texts, left.schema.field(at).type))

    return joined.mapInArrow(run, docs.schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))
