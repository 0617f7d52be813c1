"""Long spans that stand verbatim in more than one record.

Method: de Bruijn compaction over character tokens. A span of `least` characters
(code points) is an edge of the graph; records that share a span of at least that
length share an edge.

1. A sieve. Of every window of positions the smallest hash of a shorter k-mer is
   kept (minimizers): two records that share `least` characters keep the same k-mer
   at the same place, so k-mers kept in one text only rule out most of all text.
2. Edges. Around the k-mers kept in two texts all spans of `least` characters are
   hashed; those that stand in two texts are the repeated edges.
3. Compaction. An edge whose successor is one and the same wherever it stands, and
   is nobody else's successor, is joined to it; the end of a record or of repeated
   text counts as a successor of its own. A path without a branch is thereby walked
   whole by every record that enters it, so its first edge names it, and a running
   sum along each record's coordinates finds where the paths begin and end.
4. Coordinates. Each record's paths carry its own coordinates and the text of their
   first edge; the text, not the hash, is compared, so a collision of hashes cannot
   make a pair.

Equal texts are one class throughout. The form that grows with the records alone is
`span_members` (one row for each span and text that has it) with `members` (record and
text), or `connected`, one row a record; `pairs` is made from the first, and is as large
as the pairs are many. The jobs that find the spans run when the object is made.

Defined cases
* null texts and texts shorter than `least` share nothing;
* repeated rows of one id are one record; if their texts differ, each text counts;
* a span that stands twice in one record and nowhere else is not shared;
* equal texts of at least `least` characters share their whole length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.closure import components
from ..sources.scratch import Scratch

#: A shared span has at least so many characters.
LEAST = 80
#: Length of the sieve's k-mers; windows have LEAST - SIEVE + 1 positions.
SIEVE = 56

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n - 1, 0), base, np.uint64)]), dtype=np.uint64)


class SpanHasher:
    """Hashes of all spans of a given length of a text, from one prefix sum."""

    def __init__(self, text: str, powers: np.ndarray, inverse: np.ndarray):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.n, self.inverse = len(codes), inverse
        self.prefix = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes + np.uint64(1)) * powers[: self.n], dtype=np.uint64)])

    def spans(self, length: int, starts: np.ndarray | None = None) -> np.ndarray:
        if starts is None:
            starts = np.arange(self.n - length + 1)
        return _mix((self.prefix[starts + length] - self.prefix[starts]) * self.inverse[starts] + np.uint64(length))


def _window_minima(h: np.ndarray, w: int, valid: np.ndarray | None = None) -> np.ndarray:
    """Positions of the least values (all among equals) of every window of w values; only
    the windows that begin at a `valid` position count. A shorter array is one window."""
    n = len(h)
    if n <= w:
        return np.flatnonzero(h == h.min())
    # least values of the windows by doubling: of lengths 1, 2, 4, ... then two that overlap
    best, length = h, 1
    while length * 2 <= w:
        best = np.minimum(best[:-length], best[length:])
        length *= 2
    m = np.minimum(best[: n - w + 1], best[w - length : w - length + n - w + 1])
    begins = np.arange(n - w + 1) if valid is None else np.flatnonzero(valid[: n - w + 1])
    m = m[begins]
    # a position is kept if it is the least of one of the windows that hold it
    keep = np.zeros(n, bool)
    for j in range(w):
        at = begins + j
        keep[at[h[at] == m]] = True
    return np.flatnonzero(keep)


#: Characters that are hashed at once; a longer text is hashed by itself.
CHUNK_CHARS = 300_000


def _hashed(texts: DataFrame, least: int, sieve: int) -> DataFrame:
    """(cls, at, h): the kept k-mers of each text. Texts are laid end to end; windows that
    would run over the end of a text do not count."""
    w = least - sieve + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = inverse = np.zeros(0, np.uint64)

        def kept(ids: list[int], chunk: list[str]) -> pa.RecordBatch:
            nonlocal powers, inverse
            sizes = np.fromiter(map(len, chunk), np.int64, len(chunk))
            starts = np.cumsum(sizes) - sizes
            n = int(sizes.sum())
            if n + 1 > len(powers):
                powers, inverse = _powers(_R, n + 1), _powers(_INV, n + 1)
            h = SpanHasher("".join(chunk), powers, inverse).spans(sieve)
            valid = np.zeros(n + 1, np.int8)  # windows that lie within one text
            np.add.at(valid, starts, 1)
            np.add.at(valid, starts + sizes - least + 1, -1)
            at = _window_minima(h, w, np.cumsum(valid[:n]) > 0)
            of = np.searchsorted(starts, at, "right") - 1
            return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[of]), pa.array((at - starts[of]).astype(np.int32)), pa.array(h[at].view(np.int64))], ["cls", "at", "h"])

        for batch in batches:
            ids, chunk, size = [], [], 0
            for cls, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(cls)
                chunk.append(text)
                size += len(text)
                if size >= CHUNK_CHARS:
                    yield kept(ids, chunk)
                    ids, chunk, size = [], [], 0
            if chunk:
                yield kept(ids, chunk)

    return texts.select("cls", "text").mapInArrow(run, "cls bigint, at int, h bigint")


def _edges(texts: DataFrame, places: DataFrame, least: int, sieve: int) -> DataFrame:
    """(cls, at, h): all spans of `least` characters that hold a place (cls, at) of `sieve`."""
    near = places.groupBy("cls").agg(F.array_sort(F.collect_set("at")).alias("ats"))
    held = texts.select("cls", "text").join(near, "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, inverse = _powers(_R, 4096), _powers(_INV, 4096)
        for batch in batches:
            ids, starts_, hs, size = [], [], [], 0
            for cls, text, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text, at = text.as_py(), np.asarray(at.values.to_numpy(), np.int64)
                if len(text) + 1 > len(powers):
                    powers, inverse = _powers(_R, 2 * len(text)), _powers(_INV, 2 * len(text))
                top = len(text) - least
                change = np.zeros(len(text) + 2, np.int64)
                np.add.at(change, np.maximum(at - (least - sieve), 0), 1)
                np.add.at(change, np.minimum(at, top) + 1, -1)
                starts = np.flatnonzero(np.cumsum(change)[: top + 1] > 0)
                ids.append(np.full(len(starts), cls, np.int64))
                starts_.append(starts.astype(np.int32))
                hs.append(SpanHasher(text, powers, inverse).spans(least, starts).view(np.int64))
                size += len(starts)
                if size > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, starts_, hs)], ["cls", "at", "h"])
                    ids, starts_, hs, size = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, starts_, hs)], ["cls", "at", "h"])

    return held.mapInArrow(run, "cls bigint, at int, h bigint")


def _in_two(rows: DataFrame) -> DataFrame:
    """The rows whose hash stands in two classes: partial least and greatest per hash, then
    a join on the same key, which Spark splits where one hash is hot."""
    twice = rows.groupBy("h").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z").select("h")
    return rows.join(twice, "h", "left_semi")


class SharedSpans:
    """The shared spans of `records` (key, text), found once for several reports."""

    def __init__(self, records: DataFrame, key: str, text: str, least: int = LEAST, sieve: int | None = None):
        self.key, self.least = key, least
        sieve = sieve or (SIEVE if least == LEAST else max(1, least * 7 // 10))
        keep = self.scratch = Scratch(records.sparkSession)
        rows = records.where(F.col(key).isNotNull() & (F.length(text) >= least)).select(F.col(key).alias("rec"), F.col(text).alias("text"))
        # equal texts are one class; which of the equal texts is kept makes no difference
        one = rows.groupBy(F.sha2("text", 256).alias("sha")).agg(F.first("text").alias("text"))
        self.classes = keep.spill(one.withColumn("cls", F.monotonically_increasing_id()))
        self.members = keep.spill(rows.select("rec", F.sha2("text", 256).alias("sha")).distinct().join(self.classes.select("sha", "cls"), "sha").select("rec", "cls"))
        texts = self.classes.select("cls", "text")
        sieved = keep.spill(_hashed(texts, least, sieve))
        places = _in_two(sieved)
        edges = keep.spill(_edges(texts, places, least, sieve))
        keep.drop(sieved)
        self.edges = keep.spill(_in_two(edges))
        keep.drop(edges)
        self.paths = keep.spill(self._compacted(texts))

    def _compacted(self, texts: DataFrame) -> DataFrame:
        """(cls, at, n, head): the branchless paths that each text walks: first position,
        number of edges, and the text of the first edge."""
        along = Window.partitionBy("cls").orderBy("at")
        step = self.edges.select("cls", "at", "h", F.when(F.lead("at").over(along) == F.col("at") + 1, F.lead("h").over(along)).alias("next"), F.when(F.lag("at").over(along) == F.col("at") - 1, F.lag("h").over(along)).alias("prev"))
        step = self.scratch.spill(step)
        # a null neighbour is an end, a branch of its own: it differs from every hash
        one = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))
        marks = self.scratch.spill(step.groupBy("h").agg(one("next").alias("one_next"), one("prev").alias("one_prev")))
        by_prev = marks.select(F.col("h").alias("prev"), F.col("one_next").alias("prev_one_next"))
        # an edge without a predecessor begins a path and needs no join (nor null keys in one)
        first = step.where("prev is null").select("cls", "at", F.lit(1).alias("b"))
        rest = step.where("prev is not null").join(marks.select("h", "one_prev"), "h").join(by_prev, "prev")
        joined = first.unionByName(rest.select("cls", "at", F.when(F.col("one_prev") & F.col("prev_one_next"), 0).otherwise(1).alias("b")))
        numbered = joined.withColumn("path_no", F.sum("b").over(along))
        paths = numbered.groupBy("cls", "path_no").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("n"))
        return paths.join(texts, "cls").select("cls", "at", "n", F.col("text").substr(F.col("at") + 1, F.lit(self.least)).alias("head"))

    def span_members(self) -> DataFrame:
        """(span_cls, span_at, cls): one row for each shared span and text that has it; a span
        is named by its first place. N texts with one span are N rows."""
        first = self.paths.groupBy("head").agg(F.min(F.struct("cls", "at")).alias("span"))
        return self.paths.select("cls", "head").distinct().join(first, "head").select(F.col("span.cls").alias("span_cls"), F.col("span.at").alias("span_at"), "cls")

    def class_pairs(self) -> DataFrame:
        """(a, b): classes a < b that share a span. Within a span every pair is a result, so
        none is made that is not; a span is met once however long it is."""
        m = self.scratch.spill(self.span_members())
        a, b = m.alias("a"), m.alias("b")
        return a.join(b, (F.col("a.span_cls") == F.col("b.span_cls")) & (F.col("a.span_at") == F.col("b.span_at")) & (F.col("a.cls") < F.col("b.cls"))).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).distinct()

    def connected(self) -> DataFrame:
        """(key, class_id, n_records): of each record that shares a span with another, the
        least record with which shared spans connect it, and the number of those records."""
        first = self.members.groupBy("cls").agg(F.min("rec").alias("first"))
        rep = first.select(F.col("cls").alias("span_cls"), F.col("first").alias("b"))
        across = self.span_members().join(first, "cls").join(rep, "span_cls").select(F.col("first").alias("a"), "b")
        copies = self.members.join(first, "cls").select(F.col("rec").alias("a"), F.col("first").alias("b"))
        found = self.scratch.spill(components(across.unionByName(copies).where("a != b").distinct()))
        sizes = found.groupBy("comp").agg(F.count(F.lit(1)).alias("n_records"))
        return found.join(sizes, "comp").select(F.col("name").alias(self.key), F.col("comp").alias("class_id"), "n_records")

    def pairs(self, first: str, second: str) -> DataFrame:
        """(first, second): all pairs of different records that share a span, the smaller id
        first; members of classes are expanded here."""
        m, pairs = self.members, self.class_pairs()
        across = pairs.join(m.select(F.col("cls").alias("a"), F.col("rec").alias("x")), "a").join(m.select(F.col("cls").alias("b"), F.col("rec").alias("y")), "b").select("x", "y")
        copies = m.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls")
        twin = m.join(copies, "cls", "left_semi")
        within = twin.alias("p").join(twin.alias("q"), (F.col("p.cls") == F.col("q.cls")) & (F.col("p.rec") < F.col("q.rec"))).select(F.col("p.rec").alias("x"), F.col("q.rec").alias("y"))
        both = across.unionByName(within).where("x != y")
        return both.select(F.least("x", "y").alias(first), F.greatest("x", "y").alias(second)).distinct()

    def coverage(self) -> DataFrame:
        """(key, n_chars, shared_chars, shared_share): how much of each record's text also
        stands in another record. Of several texts of one record, the one shared most."""
        w = Window.partitionBy("cls").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        ends = self.paths.withColumn("stop", F.col("at") + F.col("n") + F.lit(self.least - 1)).withColumn("before", F.max("stop").over(w))
        covered = ends.groupBy("cls").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("at", F.coalesce("before", F.lit(0))))).alias("c"))
        copies = self.members.groupBy("cls").agg(F.count(F.lit(1)).alias("n_members"))
        per = self.classes.select("cls", F.length("text").alias("n_chars")).join(copies, "cls").join(covered, "cls", "left").select("cls", "n_chars", F.when(F.col("n_members") > 1, F.col("n_chars")).otherwise(F.coalesce("c", F.lit(0))).alias("shared_chars"))
        own = self.members.join(per, "cls").groupBy(F.col("rec").alias(self.key)).agg(F.max_by(F.struct("n_chars", "shared_chars"), F.struct("shared_chars", "n_chars")).alias("v"))
        return own.select(self.key, F.col("v.n_chars").cast("bigint").alias("n_chars"), F.col("v.shared_chars").cast("bigint").alias("shared_chars"), F.round(F.col("v.shared_chars") / F.col("v.n_chars"), 6).alias("shared_share"))
