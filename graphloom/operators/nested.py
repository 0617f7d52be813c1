"""Deeply nested JSON documents as related flat tables.

Method: vectorised structural indexing. The documents of a batch are laid end to
end in one byte buffer. Bitmaps of backslashes, quotes, brackets and delimiters
are computed over the whole buffer; the running parity of unescaped quotes tells
strings from structure, a prefix sum over brackets gives the nesting depth, and
one stable sort by depth puts every delimiter behind the bracket that holds it,
so that parents, member names and array positions follow from forward fills.
Python touches only whole containers, never single characters.

Defined cases
* null document, null entry id: no rows of the document; the id stays null.
* zlib data is recognised by its content; the `compressed` flag is not trusted.
* a document that is a JSON string holding JSON text is what it holds.
* a document that cannot be read whole (cut data, bad text, trailing text): nothing.
* a member name written twice in one object: both are emitted.
* repeated rows of an entry: nothing new (`elements` is distinct by its key).
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import spread

#: Bytes of JSON text that are indexed at once; a longer document is a chunk of its own.
CHUNK_BYTES = 2_000_000

DOC_FIELDS = ("request_json", "response_blob", "meta_json")


def read_document(raw: str | bytes | None) -> bytes | None:
    """The JSON text of a stored document in UTF-8, or None if it cannot be read whole."""
    if raw is None:
        return None
    try:
        if isinstance(raw, (bytes, bytearray, memoryview)):
            raw = bytes(raw)
            if raw[:1] == b"\x78" or raw[:2] == b"\x1f\x8b":
                inflate = zlib.decompressobj(47)
                data = inflate.decompress(raw) + inflate.flush()
                if not inflate.eof or inflate.unused_data.strip(b"\x00\r\n\t "):
                    return None
                raw = data
            text = raw.decode("utf-8-sig")
        else:
            text = raw.removeprefix("﻿")
        value = json.loads(text)
        while isinstance(value, str):
            text = value
            value = json.loads(text)
        return text.encode("utf-8") if isinstance(value, (dict, list)) else None
    except (ValueError, zlib.error, RecursionError):
        return None


def _string(raw: bytes) -> str:
    """What a JSON string says, given what stands between its quotes; half surrogates become `?`."""
    if b"\\" not in raw:
        return raw.decode("utf-8")
    return json.loads(b'"' + raw + b'"', strict=False).encode("utf-8", "replace").decode("utf-8")


def _said(text: str) -> str | None:
    """What a JSON scalar says: a string's content, null for JSON null, else its text."""
    if text[:1] == '"':
        return _string(text[1:-1].encode("utf-8"))
    return None if text == "null" else text


class StructuralIndex:
    """Containers of the valid JSON documents in `buf`, laid end to end.

    Per container, in document order: `at` and `end` (its bracket positions),
    `is_object`, `level` (0 at the top), `parent` (index or -1), `name_at`,
    `name_end` (the member name's span in the buffer, -1 in an array) and
    `place` (its position in an array).
    """

    def __init__(self, buf: bytes):
        b = np.frombuffer(buf, np.uint8)
        n = len(b)
        at = np.arange(n, dtype=np.int32)
        slash = b == 0x5C
        quote = b == 0x22
        if slash.any():  # a character is escaped if an odd run of backslashes ends before it
            plain = np.maximum.accumulate(np.where(slash, np.int32(-1), at))
            odd = ((at - plain) & 1).astype(bool) & slash
            quote[1:] &= ~odd[:-1]
        outside = (np.cumsum(quote, dtype=np.int32) & 1) == 0
        self.quotes = np.flatnonzero(quote).astype(np.int32)
        opens = ((b == 0x7B) | (b == 0x5B)) & outside
        closes = ((b == 0x7D) | (b == 0x5D)) & outside
        commas = (b == 0x2C) & outside
        colons = (b == 0x3A) & outside
        depth = np.cumsum(opens.astype(np.int8) - closes.astype(np.int8), dtype=np.int32)
        self.buf, self.b = buf, b
        self.at = np.flatnonzero(opens).astype(np.int32)
        self.is_object = b[self.at] == 0x7B
        self.level = depth[self.at] - 1
        m = len(self.at)

        # the closing bracket: in the order of depth, openings and closings alternate
        close_at = np.flatnonzero(closes).astype(np.int32)
        self.end = np.empty(m, np.int32)
        self.end[np.argsort(self.level, kind="stable")] = close_at[np.argsort(depth[close_at], kind="stable")]

        # tokens: a container's head, and what stands in it: children, commas, colons
        comma_at, colon_at = np.flatnonzero(commas).astype(np.int32), np.flatnonzero(colons).astype(np.int32)
        HEAD, CHILD, COMMA, COLON = 0, 1, 2, 3
        pos = np.concatenate([self.at, self.at, comma_at, colon_at])
        kind = np.concatenate([np.full(m, HEAD, np.int8), np.full(m, CHILD, np.int8), np.full(len(comma_at), COMMA, np.int8), np.full(len(colon_at), COLON, np.int8)])
        own = np.concatenate([np.arange(m, dtype=np.int32), np.arange(m, dtype=np.int32), np.full(len(comma_at) + len(colon_at), -1, np.int32)])
        level = np.concatenate([self.level, self.level - 1, depth[comma_at] - 1, depth[colon_at] - 1])
        order = np.lexsort((pos, level))
        pos, kind, own, level = pos[order], kind[order], own[order], level[order]
        row = np.arange(len(pos), dtype=np.int64)
        head_row = np.maximum.accumulate(np.where(kind == HEAD, row, -1)) if len(row) else row
        seen = np.cumsum(kind == COMMA)
        colon_row = np.maximum.accumulate(np.where(kind == COLON, row, -1)) if len(row) else row
        child = (kind == CHILD) & (level >= 0)
        c, h = own[child], head_row[child]
        self.parent = np.full(m, -1, np.int32)
        self.parent[c] = own[h]
        self.place = np.full(m, -1, np.int32)
        self.place[c] = seen[child] - seen[h]
        self.name_at = np.full(m, -1, np.int32)
        self.name_end = np.full(m, -1, np.int32)
        named = self.is_object[self.parent[c]] if len(c) else np.zeros(0, bool)
        if named.any():
            q = np.searchsorted(self.quotes, pos[colon_row[child][named]])
            self.name_at[c[named]] = self.quotes[q - 2] + 1
            self.name_end[c[named]] = self.quotes[q - 1]
            self.place[c[named]] = -1
        # scalar members of objects: colons not followed by a child in their container
        nxt = np.append(kind[1:], np.int8(HEAD))
        col = (kind == COLON) & ~((nxt == CHILD))
        self.scalar_owner = own[head_row[col]] if len(row) else np.zeros(0, np.int32)
        self.scalar_colon = pos[col]
        stop = np.append(pos[1:], np.int32(0))[col]
        same = np.append(head_row[1:], np.int64(-1))[col] == head_row[col] if len(row) else np.zeros(0, bool)
        self.scalar_stop = np.where(same, stop, self.end[self.scalar_owner]) if len(col) and col.any() else np.zeros(0, np.int32)
        # scalar elements of arrays: heads and commas of arrays not followed by a child in them
        lead = np.flatnonzero(((kind == HEAD) | (kind == COMMA)) & (nxt != CHILD))
        lead = lead[~self.is_object[own[head_row[lead]]]]
        self.elem_owner = own[head_row[lead]]
        self.elem_place = seen[lead] - seen[head_row[lead]]
        self.elem_at = pos[lead] + 1
        in_same = np.append(head_row[1:], np.int64(-1))[lead] == head_row[lead]
        self.elem_stop = np.where(in_same, np.append(pos[1:], np.int32(0))[lead], self.end[self.elem_owner])

    def paths(self) -> tuple[list[str], list[str]]:
        """Of each container: a slash and a name or position for each step from the top;
        and the name of the member that it is, or whose array (of arrays) it stands in."""
        out: list[str] = [""] * len(self.at)
        members: list[str] = [""] * len(self.at)
        buf, name_at, name_end = self.buf, self.name_at.tolist(), self.name_end.tolist()
        names: dict[bytes, str] = {}
        for i, (p, place) in enumerate(zip(self.parent.tolist(), self.place.tolist())):
            if p < 0:
                continue
            if place >= 0:
                out[i] = f"{out[p]}/{place}"
                members[i] = members[p]
            else:
                raw = buf[name_at[i] : name_end[i]]
                if (name := names.get(raw)) is None:
                    name = names[raw] = _string(raw)
                out[i] = f"{out[p]}/{name}"
                members[i] = name
        return out, members

    def scalars(self) -> dict[int, list[tuple[str, str, str | None]]]:
        """Of each object: its members that are neither object nor array: name, JSON text and
        what it says."""
        out: dict[int, list[tuple[str, str, str | None]]] = {}
        q = np.searchsorted(self.quotes, self.scalar_colon)
        starts, ends = (self.quotes[q - 2] + 1, self.quotes[q - 1]) if len(q) else (q, q)
        for o, a, z, colon, stop in zip(self.scalar_owner.tolist(), starts.tolist(), ends.tolist(), self.scalar_colon.tolist(), self.scalar_stop.tolist()):
            text = self.buf[colon + 1 : stop].decode("utf-8").strip()
            out.setdefault(o, []).append((_string(self.buf[a:z]), text, _said(text)))
        return out

    def elements(self) -> Iterator[tuple[int, int | None, str]]:
        """Of each array's elements that are neither object nor array: the array, the
        position and the JSON text; an empty array is given once, without a position."""
        for o, place, a, z in zip(self.elem_owner.tolist(), self.elem_place.tolist(), self.elem_at.tolist(), self.elem_stop.tolist()):
            text = self.buf[a:z].decode("utf-8").strip()
            yield (o, place, text) if text else (o, None, "[]")


def _chunks(batch: pa.RecordBatch, key: str, fields: tuple[str, ...]):
    """Chunks of readable documents: (buffer, key and field of each, start of each)."""
    ids = batch.column(key).to_pylist()
    buf, owners, starts, size = [], [], [], 0
    for field in fields:
        for i, value in zip(ids, batch.column(field)):
            doc = read_document(value.as_py())
            if doc is None:
                continue
            if size and size + len(doc) > CHUNK_BYTES:
                yield b"\n".join(buf), owners, starts
                buf, owners, starts, size = [], [], [], 0
            owners.append((i, field))
            starts.append(size)
            buf.append(doc)
            size += len(doc) + 1
    if buf:
        yield b"\n".join(buf), owners, starts


def elements(df: DataFrame, key: str = "entry_id", fields: tuple[str, ...] = DOC_FIELDS) -> DataFrame:
    """One row (`key`, doc_field, elem_path) for each JSON object that is an element of an array."""
    kind = df.schema[key].dataType.simpleString()

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, owners, starts in _chunks(batch, key, fields):
                ix = StructuralIndex(buf)
                if not len(ix.at):
                    continue
                hit = np.flatnonzero(ix.is_object & (ix.place >= 0))
                paths, _ = ix.paths()
                doc = np.searchsorted(np.array(starts), ix.at[hit], "right") - 1
                who = [owners[d] for d in doc.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w[0] for w in who], batch.schema.field(key).type), pa.array([w[1] for w in who], pa.string()), pa.array([paths[i] for i in hit.tolist()], pa.string())],
                    [key, "doc_field", "elem_path"],
                )

    return spread(df.select(key, *fields)).mapInArrow(shred, f"`{key}` {kind}, doc_field string, elem_path string").distinct()


def shredded(df: DataFrame, key: str = "entry_id", fields: tuple[str, ...] = DOC_FIELDS) -> DataFrame:
    """One row for each object of each document: its path, the path of the object or
    document that holds it, the member name of the array or object it stands in, its
    position and depth, its scalar members as JSON text and as what they say, and its holder: the name of
    the array it stands in, or of the object whose member it is. (key, doc_field,
    node_path) identifies a row, (key, doc_field, parent_path) its parent."""
    kind = df.schema[key].dataType.simpleString()

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, owners, starts in _chunks(batch, key, fields):
                ix = StructuralIndex(buf)
                (paths, members), scalars = ix.paths(), ix.scalars()
                docs = (np.searchsorted(np.array(starts), ix.at, "right") - 1).tolist()
                rows = []
                parent, place, level, is_object = ix.parent.tolist(), ix.place.tolist(), ix.level.tolist(), ix.is_object.tolist()
                for i, obj in enumerate(is_object):
                    if not obj:
                        continue
                    up = parent[i]
                    while up >= 0 and not is_object[up]:
                        up = parent[up]
                    if place[i] >= 0:
                        holder = members[i]
                    else:
                        holder = members[up] if up >= 0 and place[up] < 0 else None
                    rows.append((*owners[docs[i]], paths[i], None if parent[i] < 0 else paths[up] if up >= 0 else "", members[i], place[i] if place[i] >= 0 else None, level[i], scalars.get(i, []), holder))
                cols = list(zip(*rows)) if rows else [[]] * 9
                types = [batch.schema.field(key).type, pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.struct([("name", pa.string()), ("json", pa.string()), ("value", pa.string())])), pa.string()]
                names = [key, "doc_field", "node_path", "parent_path", "member", "place", "depth", "scalars", "holder"]
                values = [list(c) for c in cols[:7]] + [[[{"name": a, "json": b, "value": v} for a, b, v in x] for x in cols[7]], list(cols[8])]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names)

    out = spread(df.select(key, *fields)).mapInArrow(shred, f"`{key}` {kind}, doc_field string, node_path string, parent_path string, member string, place int, depth int, scalars array<struct<name:string,json:string,value:string>>, holder string")
    return out.dropDuplicates([key, "doc_field", "node_path"])


def array_values(df: DataFrame, key: str = "entry_id", fields: tuple[str, ...] = DOC_FIELDS) -> DataFrame:
    """One row for each array element that is neither object nor array: its path, the path
    of the object that holds its array (the document's, if none does), the member name of
    that array, its position and its JSON text. An empty array is one row with its own
    path, no position and the text []. (key, doc_field, parent_path) identifies the
    parent in `shredded`."""
    kind = df.schema[key].dataType.simpleString()

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for buf, owners, starts in _chunks(batch, key, fields):
                ix = StructuralIndex(buf)
                paths, members = ix.paths()
                docs = (np.searchsorted(np.array(starts), ix.at, "right") - 1).tolist()
                parent, is_object = ix.parent.tolist(), ix.is_object.tolist()
                cols: list[list] = [[], [], [], [], [], [], []]
                for i, place, text in ix.elements():
                    up = parent[i]
                    while up >= 0 and not is_object[up]:
                        up = parent[up]
                    row = (*owners[docs[i]], paths[i] if place is None else f"{paths[i]}/{place}", paths[up] if up >= 0 else "", members[i], place, text)
                    for c, v in zip(cols, row):
                        c.append(v)
                types = [batch.schema.field(key).type, pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [key, "doc_field", "elem_path", "parent_path", "member", "place", "json"])

    return spread(df.select(key, *fields)).mapInArrow(shred, f"`{key}` {kind}, doc_field string, elem_path string, parent_path string, member string, place int, json string").distinct()


def _said_by(name: str) -> Column:
    return F.try_element_at(F.filter("scalars", lambda s: s["name"] == F.lit(name)), F.lit(-1))["value"].alias(f"m_{name}")


def flat_table(objects: DataFrame, members: tuple[str, ...], columns: tuple[str, ...], key: str = "entry_id") -> DataFrame:
    """The objects that stand under one of the member names `members`, with `columns`
    pulled out of their scalars as text (null where absent or JSON null). A member that is
    an array or object is null here: `array_values` and `shredded` have its rows, tied by parent_path."""
    return objects.where(F.col("member").isin(*members)).select(key, "doc_field", "node_path", "parent_path", "member", "place", *map(_said_by, columns))


def held_table(objects: DataFrame, holder: str, single: str, columns: tuple[str, ...], key: str = "entry_id") -> DataFrame:
    """The objects that stand in an array or map named `holder` (in a map, `member` is their
    id), or as one member named `single`, with `columns` pulled out of their scalars as
    text (null where absent or JSON null) and all their scalars."""
    alone = (F.col("member") == single) & F.col("place").isNull()
    return objects.where((F.col("holder") == holder) | alone).select(key, "doc_field", "node_path", "parent_path", "member", "place", *map(_said_by, columns), "scalars")


def members(objects: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, doc_field, node_path, name, value): every scalar member of every object, as what
    it says; a member written twice keeps its last value."""
    each = objects.select(key, "doc_field", "node_path", F.posexplode("scalars").alias("at", "s"))
    return each.groupBy(key, "doc_field", "node_path", F.col("s.name").alias("name")).agg(F.max_by("s.value", "at").alias("value"))
