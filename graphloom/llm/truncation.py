"""Texts that lost their end to a field limit or in transfer.

Method: the length of every text is recomputed as each storage layer would have
counted it (code points, UTF-8 bytes, UTF-16 units, JSON-escaped, entity-escaped,
with CRLF line ends, and without a leading label). Grouped by table, writer and
measure, a hidden limit shows as one length at which far more texts end than at
the lengths around it, most of them open. Then the endings are inspected: does
the structure a text began (JSON, a fenced block, a sentence, a labelled form)
come to its end?

What counts as an end is partly learned from all texts, by counting:
* words that stand before a full stop inside texts but hardly ever before one that ends
  a paragraph, a quotation or a text (`approx.`, `Fig.`) need more to follow;
* endings without a closing mark that many texts share (`after 600s`, `(char 31)`)
  are natural; one text under many ids, and texts as long as their writer's longest,
  make none so, and at a hidden limit no ending is natural;
* where most texts with the same opening label close with the same last line, one
  that lacks it is open.

A sign put after the cut (`...`, `<rest omitted>`, `[+12 chars]`, a last line in
brackets) is set aside and the text before it judged; before a bare ellipsis a sentence
counts as cut at a hidden limit only, since an author may end with one. What may
begin JSON (a bracket before a quote, a digit, a bracket) is content, no sign.
Endings, last words and last lines count whole, by their hashes. The jobs that learn
run while the DataFrame is built.

Defined cases: null and empty texts are no case; complete JSON is none whatever
its length; invalid JSON is none if its brackets close; a sentence that closes
exactly at a hidden limit of its writer counts as cut; a null writer is held
against all limits of its table; repeated rows of an id are one record.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import spill, spread

MEASURES = ("chars", "utf8", "utf16", "json", "json_unicode", "entities", "crlf", "unlabelled")

#: A length is a hidden limit if so many texts end at it, so many times the mean of the
#: lengths around it, and this share of them open.
LIMIT_TEXTS, LIMIT_TIMES, LIMIT_OPEN, LIMIT_AROUND = 6, 8.0, 0.5, 40
#: Of the measures that show one limit, those with this share of the sharpest one's texts stay.
LIMIT_SHARP = 0.75
#: An ending without a closing mark is natural from this share of a table's texts.
NATURAL_SHARE, NATURAL_TEXTS = 0.01, 5
#: So many of them must differ before their copies and writers count.
NATURAL_DIFFERENT = 2
#: A word needs more after its full stop if so many ends of its kind were to be expected among
#: its full stops, and beside one of them at most this share of those came; it must be this share of all words
#: before full stops, so that 1 / NEEDS_SHARE words are known at most.
NEEDS_ENDS, NEEDS_FEW, NEEDS_SHARE = 8, 0.02, 1e-4
#: A last line belongs to a label if so large a share of the label's texts have it.
SENTINEL_SHARE, SENTINEL_TEXTS = 0.6, 5

_END = ".!?…。！？؟।۔｡︒‼⁇⁈⁉"
_CLOSERS = "\"”’»›“‘')]}』」》）】*_`"
_NOTE = re.compile(r"\n\([^)\n]+\)\s*$")
_JSON_START = re.compile(r"(?:^|[\s:!`])(\{\s*[\"'}\n]|\{\s*$|\[\s*[{\"]|\[\s*$)")
_DOUBLE = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_BRACKET = re.compile(r'[{}\[\]"]')
_LABEL = re.compile(r"[a-z_]+:")
_LEAD = "([{\"“«'„‘"
_DIGITS = re.compile(r"\d+")


def _json_end(text: str, start: int) -> int:
    """Where the JSON-like value at `start` ends, or -1 if its brackets do not close."""
    try:
        return json.JSONDecoder().raw_decode(text, start)[1]
    except (ValueError, RecursionError):
        pass
    depth, at, n = 0, start, len(text)
    while at < n:
        m = _BRACKET.search(text, at)
        if m is None:
            return -1
        c, at = m.group(), m.end()
        if c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth <= 0:
                return at
        elif c == '"':
            s = _DOUBLE.match(text, m.start())
            if s is None:
                break
            at = s.end()
    # other quotes, or quotes left bare inside strings: the brackets alone must balance
    last = max(text.rfind("}"), text.rfind("]")) + 1
    if last <= start or any(text.count(a, start, last) != text.count(z, start, last) for a, z in ("{}", "[]")):
        return -1
    return last


def _prose(text: str) -> str:
    """`closed` or `open` by the last characters of a stretch of prose."""
    if text[-1:] in (" ", "\t") or text.endswith("\n\n"):
        return "open"
    t = text.rstrip()
    bare = t.rstrip(_CLOSERS)
    if bare and bare[-1] in _END:
        return "closed"
    return "open" if t else "closed"


def _sign_at(text: str) -> int:
    """Where a sign put after a cut begins at a text's end, with a blank before it, or -1."""
    t = text[:-1] if text.endswith("\n") else text
    t = t[:-1] if t.endswith("\n") else t
    if t.endswith("...") or t.endswith("…"):
        return len(t) - (3 if t.endswith("...") else 1)
    begin, last = -1, t[-1:]
    line = t.rfind("\n") + 1
    if last == "]" and (i := t.rfind("[", line)) > t.rfind("]", line, -1):
        inner = t[i + 1 : -1].lstrip()[:1]
        begin = -1 if inner and (inner in "\"{[" or inner.isdigit()) else i
    elif last == ">" and (i := t.rfind("<", line)) > t.rfind(">", line, -1):
        begin = i if i < len(t) - 2 else -1
    elif t.endswith("--"):
        begin = t.rfind("--", line, -3)
    return begin - 1 if begin > 0 and t[begin - 1].isspace() else begin


def _word_at_end(piece: str) -> str:
    """The last word of what stands before a full stop, without opening marks; numbers are one."""
    w = piece.rsplit(None, 1)
    w = w[-1].lstrip(_LEAD) if w else ""
    return "0" if w[:1].isdigit() else w


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def ending(text: str) -> tuple[str, bool, str, str, str]:
    """(state, whether a sign follows, the text before it, the shape of the ending, the word
    before a full stop that closes it). state: closed or open for a structure, prose_closed
    or prose_open for sentences, ellipsis for an open sentence before a bare ellipsis."""
    base, sign = text, ""
    if m := _NOTE.search(text):
        base = text[: m.start()]
    elif (i := _sign_at(text)) >= 0:
        base, sign = text[:i], text[i:].strip()
    state, tail = "", base
    if m := _JSON_START.search(base):
        end = _json_end(base, m.start(1))
        if end < 0:
            state = "open"
        else:
            tail = base[end:]
            if "```" in base[: m.start(1)]:
                state = "closed" if "```" in tail else "open"
                tail = tail.partition("```")[2]
            else:
                state = "closed"
            if state == "closed" and tail.strip() and _prose(tail.rstrip("\n")) == "open":
                state = "prose_open"
    elif base.lstrip().startswith("```"):
        state = "open"
    if state == "" and sign and sign[0] == "[" and sign[1:2].isupper():  # a reference such as [PMID:1] belongs to the text
        base, sign = text, ""
        tail = base
    if not state:
        state = "prose_" + _prose(base if base.endswith(" ") and not sign else base.rstrip("\n"))
        if state == "prose_open" and sign in ("...", "…"):
            state = "ellipsis"
    shape = _DIGITS.sub("0", " ".join(base.rsplit(None, 2)[-2:])) if state == "prose_open" else ""
    end = tail.rstrip()
    last_word = _word_at_end(end[:-1]) if state in ("closed", "prose_closed") and end.endswith(".") else ""
    return state, bool(sign), base, shape, last_word


def lengths(text: str) -> list[int]:
    """The length of a text under each of MEASURES."""
    n = len(text)
    ascii_ = text.isascii()
    utf8 = n if ascii_ else len(text.encode("utf-8", "replace"))
    utf16 = n if ascii_ else len(text.encode("utf-16-le", "replace")) // 2
    entities = n + 4 * text.count("&") + 3 * text.count("<") + 3 * text.count(">")
    label = text.find(": ")
    return [n, utf8, utf16, len(json.dumps(text)) - 2, len(json.dumps(text, ensure_ascii=False)) - 2, entities, n + text.count("\n") - text.count("\r\n"), n - label - 2 if label >= 0 else n]


_DDL = "record_table string, record_id bigint, writer string, state string, shape bigint, label string, last_line bigint, sizes array<int>, text_key bigint, last_word bigint, n_mid bigint, n_end bigint"
_COLS = [c.split()[0] for c in _DDL.split(", ")]
#: Words that a task counts before it passes them on.
FLUSH_WORDS = 200_000


def features(texts: DataFrame) -> DataFrame:
    """Of each row (record_table, record_id, writer, text) what its ending and lengths show;
    and rows without a table that count the words before full stops: n_mid where more
    follows after a blank, n_end at the end of a paragraph, a quotation or the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mid: Counter = Counter()
        ends: Counter = Counter()

        def counted(types: list[pa.DataType]) -> pa.RecordBatch:
            words = list(mid.keys() | ends.keys())
            own = [pa.array([_hash(w) for w in words], pa.int64()), pa.array([mid[w] for w in words], pa.int64()), pa.array([ends[w] for w in words], pa.int64())]
            mid.clear()
            ends.clear()
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(words), t) for t in types), *own], _COLS)

        types: list[pa.DataType] = []
        for b in batches:
            states, shapes, labels, lasts, sizes, keys, words = [], [], [], [], [], [], []
            for t in b.column(3):
                t = t.as_py()
                pieces = t.split(". ")
                pieces.pop()
                mid.update(map(_word_at_end, pieces))
                for sep in ('."', ".\n\n"):
                    pieces = t.split(sep)
                    pieces.pop()
                    ends.update(map(_word_at_end, pieces))
                if t.endswith("."):
                    ends[_word_at_end(t[:-1])] += 1
                state, _, base, shape, word = ending(t)
                label = _LABEL.match(t)
                last = base.rstrip().rpartition("\n")[2]
                states.append(state)
                shapes.append(_hash(shape) if shape else None)
                labels.append(label.group() if label else None)
                lasts.append(_hash(last) if label and last else None)
                sizes.append(lengths(base))
                keys.append(_hash(base) if state == "prose_open" else None)
                words.append(_hash(word) if word else None)
            n = len(states)
            out = [*(b.column(i) for i in range(3)), pa.array(states, pa.string()), pa.array(shapes, pa.int64()), pa.array(labels, pa.string()), pa.array(lasts, pa.int64()), pa.array(sizes, pa.list_(pa.int32())), pa.array(keys, pa.int64()), pa.array(words, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            types = [c.type for c in out[:9]]
            yield pa.RecordBatch.from_arrays(out, _COLS)
            if len(mid) + len(ends) > FLUSH_WORDS:
                yield counted(types)
        if mid or ends:
            yield counted(types)

    return spread(texts.select("record_table", "record_id", "writer", "text").where("text is not null and text != ''")).mapInArrow(run, _DDL)


def needing_more(found: DataFrame) -> DataFrame:
    """(last_word): the words that need more after their full stop, 1 / NEEDS_SHARE at most."""
    words = found.where("record_table is null").groupBy("last_word").agg(F.sum("n_mid").alias("n_mid"), F.sum("n_end").alias("n_end"))
    whole = words.agg(F.struct(F.sum("n_mid").alias("mid"), F.sum("n_end").alias("ends"))).scalar()
    ratio = F.greatest(F.lit(1.0), whole["mid"] / F.greatest(whole["ends"], F.lit(1)))  # full stops inside for each at an end
    few = (F.col("n_end") - 1) * ratio <= F.lit(NEEDS_FEW) * F.col("n_mid")
    return words.where((F.col("n_mid") >= F.lit(NEEDS_ENDS) * ratio) & (F.col("n_mid") >= F.lit(NEEDS_SHARE) * whole["mid"]) & few).select("last_word")


def _measured(rows: DataFrame, *cols: str) -> DataFrame:
    sized = rows.select(*cols, F.posexplode("sizes").alias("m", "size"))
    return sized.withColumn("measure", F.element_at(F.array(*[F.lit(m) for m in MEASURES]), F.col("m") + 1)).drop("m")


def limits(inspected: DataFrame) -> DataFrame:
    """(record_table, writer, measure, size, n, n_open): the hidden limits. A real limit
    shows under several measures; those under which it is blurred are left out. Texts with
    a natural ending are open here, but each such ending counts once for a length."""
    by = ["record_table", "writer", "measure"]
    texts = _measured(inspected, "record_table", "writer", "is_open", "natural_shape")
    per = texts.groupBy(*by, "size").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_open") | F.col("natural_shape").isNotNull()).alias("n_open"), (F.size(F.collect_set("natural_shape")) - F.count("natural_shape")).alias("less"))
    w = Window.partitionBy(*by).orderBy("size").rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
    around = per.withColumn("mean", (F.sum("n").over(w) - F.col("n")) / F.lit(2.0 * LIMIT_AROUND))
    counted, counted_open = F.col("n") + F.col("less"), F.col("n_open") + F.col("less")
    peaks = around.where((counted_open >= LIMIT_TEXTS) & (counted >= LIMIT_TIMES * F.col("mean")) & (counted_open >= LIMIT_OPEN * counted)).drop("mean")
    near = Window.partitionBy("record_table", "writer").orderBy("size").rangeBetween(-LIMIT_AROUND, LIMIT_AROUND)
    return peaks.withColumn("best", F.max(counted_open).over(near)).where(counted_open >= LIMIT_SHARP * F.col("best")).drop("best", "less")


class Truncation:
    """The cut records of `texts` (record_table, record_id, writer, text)."""

    def __init__(self, texts: DataFrame):
        seen = spill(features(texts), batch_rows=1000)
        found = seen.where("record_table is not null").drop("n_mid", "n_end")
        # few words need more: their table is broadcast, so that texts without such a word are not shuffled
        more = spill(needing_more(seen)).withColumn("more", F.lit(True))
        cols = found.columns
        found = found.join(F.broadcast(more), "last_word", "left").withColumn("state", F.when(F.col("more").isNotNull(), "open").otherwise(F.col("state"))).select(*cols)
        totals = found.groupBy("record_table").agg(F.count(F.lit(1)).alias("n_all"))
        # a writer's longest texts may have met its limit; copies of a text by one writer are one case
        most_sizes = F.array(*[F.max(F.col("sizes")[i]) for i in range(len(MEASURES))])
        longest = found.groupBy("record_table", F.col("writer").alias("of_writer")).agg(most_sizes.alias("longest")).withColumnRenamed("record_table", "of_table")
        prose = found.where("state = 'prose_open'").join(longest, (F.col("record_table") == F.col("of_table")) & F.col("writer").eqNullSafe(F.col("of_writer")))
        shorter = prose.where(~F.exists(F.zip_with("sizes", "longest", lambda a, b: a >= b), lambda x: x))
        cases = shorter.groupBy("record_table", "shape", "text_key", "writer").agg(F.count(F.lit(1)).alias("n"))
        shapes = cases.groupBy("record_table", "shape", "text_key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_cases")).groupBy("record_table", "shape").agg(F.sum("n").alias("n"), F.sum("n_cases").alias("n_cases"), F.count(F.lit(1)).alias("n_texts"))
        different = (F.col("n_cases") >= NATURAL_TEXTS) & (F.col("n_texts") >= NATURAL_DIFFERENT)
        natural = shapes.join(totals, "record_table").where(different & (F.col("n") >= NATURAL_SHARE * F.col("n_all"))).select("record_table", "shape", F.lit(True).alias("natural"))
        lines = found.where("label is not null").groupBy("record_table", "label", "last_line").agg(F.count(F.lit(1)).alias("n"))
        most = lines.groupBy("record_table", "label").agg(F.max_by("last_line", "n").alias("sentinel"), F.max("n").alias("top"), F.sum("n").alias("all"))
        sentinel = most.where(F.col("sentinel").isNotNull() & (F.col("top") >= SENTINEL_TEXTS) & (F.col("top") >= SENTINEL_SHARE * F.col("all"))).select("record_table", "label", "sentinel")
        is_open = F.when(F.col("sentinel").isNotNull(), ~F.col("last_line").eqNullSafe(F.col("sentinel"))).otherwise(F.col("state").isin("open", "ellipsis") | ((F.col("state") == "prose_open") & F.col("natural").isNull()))
        labelled = F.col("sentinel").isNotNull()
        # natural shapes are 1 / NATURAL_SHARE for a table at most; rows without a label stay out of the join on it
        shaped = found.join(F.broadcast(natural), ["record_table", "shape"], "left")
        joined = shaped.where("label is not null").join(sentinel, ["record_table", "label"], "left").unionByName(shaped.where("label is null").withColumn("sentinel", F.lit(None).cast("string")))
        exempt = ~labelled & (F.col("state") == "prose_open") & F.col("natural").isNotNull()
        in_doubt = exempt | (~labelled & F.col("state").isin("prose_closed", "ellipsis"))
        self.inspected = joined.select("record_table", "record_id", "writer", "sizes", is_open.alias("is_open"), in_doubt.alias("in_doubt"), F.when(exempt, F.col("shape")).alias("natural_shape"))
        self.limits = limits(self.inspected)

    def judged(self) -> DataFrame:
        """(record_table, record_id, writer, is_cut), one row for each row of the input."""
        # sentences that seem to close, naturally or by a mark, or close with an ellipsis, are held against limits
        doubt = _measured(self.inspected.where("in_doubt"), "record_table", "record_id", "writer")
        known = self.limits.select("record_table", "measure", "size", F.col("writer").alias("limit_writer"))
        at_limit = doubt.join(known, ["record_table", "measure", "size"]).where("writer is null or writer <=> limit_writer").select("record_table", "record_id", F.lit(True).alias("at_limit")).distinct()
        j = self.inspected.join(at_limit, ["record_table", "record_id"], "left")
        return j.select("record_table", "record_id", "writer", F.when(F.col("in_doubt"), F.col("at_limit").isNotNull()).otherwise(F.col("is_open")).alias("is_cut"))

    def cut(self) -> DataFrame:
        return self.judged().where("is_cut").select("record_table", "record_id").distinct()

    def shares(self) -> DataFrame:
        """(record_table, writer, n_records, n_cut, cut_share); a null writer is a writer."""
        one = self.judged().groupBy("record_table", "record_id").agg(F.max("writer").alias("writer"), F.bool_or("is_cut").alias("is_cut"))
        return one.groupBy("record_table", "writer").agg(F.count(F.lit(1)).alias("n_records"), F.count_if("is_cut").alias("n_cut")).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_records"), 6))
