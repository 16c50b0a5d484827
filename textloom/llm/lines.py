"""Substring deduplication by hashing lines, paragraphs or parts of lines.

A text is cut into units: lines, which are cut further behind . ! ? , ; : (PART, the default), lines (LINE), or paragraphs between
blank lines (PARAGRAPH). A unit is normalised to the lower case of its words with single spaces between. What is compared is a passage:
from each unit on, as many whole units as it takes to have LENGTH words (a long line is a passage of one unit). Its 96-bit digest is
grouped over the whole corpus; the occurrence ranked first, by (doc_id, unit number), stays and every other is removed. Removed passages
of a document that overlap or touch are one span, reported with its units, its place in the original text, in characters, and
the occurrence that stays of the passage it begins with.

A passage that begins or ends inside a line, or inside a sentence, is found all the same if LENGTH words of whole units are in it; a
short stock line by itself is not a passage and leaves its document alone. As a match is always of LENGTH words, that doesn't change with the corpus's size.

A digest seen once leaves in the aggregation; what is joined back is only digests that repeat. A hot passage makes a skewed key of
that join, which AQE splits; it never is one task's list. Spans are put together within a document. Passages are made twice, as a table of them
would be as large as the texts.

Defined cases: an empty table gives no rows; null or empty texts, and texts of fewer than LENGTH words, have no passage; a text of any length is
taken whole; a row with a null doc_id keeps its text and doesn't count; rows repeated with one doc_id are the same occurrence and never
removed against each other; among equal passages (ties) of one document the one at the first unit stays; other columns are ignored
by repeats() and kept by without_repeats(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from textloom.llm.common import cut, private, renamed
from textloom.llm.textbytes import _WORDS_BASE, SOLID, U, mix, prefix, ranges, slices, words

PART, LINE, PARAGRAPH = "part", "line", "paragraph"
LENGTH = 30
PASSAGE = "h1 bigint, h2 int, doc_id bigint, unit int, last int, start int, stop int"

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?,;:"]] = True


def _passages(batches: Iterator[pa.RecordBatch], kind: str, length: int) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PASSAGE.split(", ")]
    for batch in batches:
        for part in slices(batch, "text"):
            text = part.column("text")
            low = words(text, SOLID, lower=True)  # digests
            raw = words(text, SOLID, lower=False)  # places; lowering may change byte lengths, not words
            n = len(raw.start)
            if not n:
                continue
            lines = np.concatenate([[0], np.cumsum(raw.data == 10)])
            begins = np.ones(n, bool)
            begins[1:] = (raw.doc[1:] != raw.doc[:-1]) | (lines[raw.start[1:]] - lines[raw.end[:-1]] > (kind == PARAGRAPH))
            if kind == PART:
                begins[1:] |= _ENDS[raw.data[raw.end[:-1] - 1]]
            a = np.flatnonzero(begins)  # first word of each unit
            b = np.append(a[1:], n)
            doc = raw.doc[a]
            unit = np.arange(len(a)) - np.searchsorted(a, raw.first[:-1])[doc]
            m = np.searchsorted(b, a + max(length, 1))  # the unit that completes the passage
            ok = m < len(a)
            ok[ok] = doc[m[ok]] == doc[ok]
            a, doc, unit, m = a[ok], doc[ok], unit[ok], m[ok]
            b, last = b[m], unit + m - np.flatnonzero(ok)
            h1 = ranges(prefix(low.hash, _WORDS_BASE), a, b, _WORDS_BASE)
            h2 = ranges(prefix(mix(low.hash ^ U(0xA5A5A5A5A5A5A5A5)), _WORDS_BASE), a, b, _WORDS_BASE)
            chars = np.concatenate([[0], np.cumsum((raw.data & 0xC0) != 0x80)])  # characters before each byte
            base = chars[raw.offs[:-1]][doc]
            ints = (unit, last, chars[raw.start[a]] - base, chars[raw.end[b - 1]] - base)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array((h2 >> U(32)).astype(np.uint32).view(np.int32)), part.column("doc_id").take(pa.array(doc)), *[pa.array(x.astype(np.int32)) for x in ints]], names)


def repeats(docs: DataFrame, kind: str = PART, length: int = LENGTH) -> DataFrame:
    """The removed spans: doc_id, unit and last_unit, start and stop (characters, from 0), keep_doc_id, keep_unit."""
    src = renamed(docs, doc_id="doc_id", text="text").where("doc_id is not null and text is not null")
    passages = src.mapInArrow(lambda it: _passages(it, kind, length), PASSAGE)
    first = passages.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "unit")).alias("keep"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "keep")
    removed = passages.join(first, ["h1", "h2"]).where("doc_id <> keep.doc_id or unit <> keep.unit").select("doc_id", "unit", "last", "start", "stop", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.unit").alias("keep_unit"))
    w = W.partitionBy("doc_id").orderBy("unit")
    new = F.when(F.col("unit") > 1 + F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1)), 1).otherwise(0)
    spans = removed.withColumn("new", new).withColumn("island", F.sum("new").over(w)).groupBy("doc_id", "island").agg(
        F.min("unit").alias("unit"), F.max("last").alias("last_unit"), F.min("start").alias("start"), F.max("stop").alias("stop"), F.min(F.struct("unit", "keep_doc_id", "keep_unit")).alias("keep")
    )
    return spans.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("unit", "last_unit", "start", "stop")], "keep.keep_doc_id", F.col("keep.keep_unit").cast("bigint").alias("keep_unit"))


def without_repeats(docs: DataFrame, kind: str = PART, length: int = LENGTH) -> DataFrame:
    """docs with the removed spans cut from text (white space around them stays); column kept_spans (replacing one of
    that name) has the original places of what stays."""
    at, mine, kept = (private(docs, c) for c in ("cut_id", "cuts", "kept"))
    cuts = cut(repeats(docs, kind, length).groupBy(F.col("doc_id").alias(at)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(mine)), "cuts")
    joined = docs.join(cuts, docs["doc_id"] == cuts[at], "left")
    size = F.length("text").cast("bigint")
    stops = F.concat(F.transform(mine, lambda c: c["start"]), F.array(size))
    begins = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(mine, lambda c: c["stop"]))
    spans = F.filter(F.zip_with(begins, stops, lambda a, b: F.struct(a.alias("start"), b.alias("stop"))), lambda s: s["start"] < s["stop"])
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("stop")))
    joined = joined.withColumn(kept, F.when(F.col(at).isNotNull(), spans).when(F.length("text") > 0, whole))
    text = F.when(F.col(at).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: F.substr("text", (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int"))), ""))
    return joined.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != "kept_spans"], F.col(kept).alias("kept_spans"))
