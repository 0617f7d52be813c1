"""Sentence units of texts in many languages and scripts.

Method: semi-Markov dynamic programming over whole spans. Blank lines, list items
and the ends of lines before them are certain boundaries. Between two of them every
end mark with its closing quotes and brackets, and in Thai every blank between Thai
words, is a possible boundary. A span from one possible boundary to another is
scored as a whole: its closing word, the opening word after it, the boundaries it
runs over, its length in words, and whether its quotes and brackets balance; the
best sequence of spans is found by dynamic programming over all of them: spans of up
to FLAT words one by one, longer ones, whose score falls evenly with their length,
by running maxima apart for each state of the quotes.

The words' scores are learned from all texts. Paragraphs begin and end at certain
boundaries, so the words there show what opens and closes a sentence: the closing
word `approx.` never ends a paragraph, so it closes no sentence; `etc.` does at
times. Openings are counted against candidates, each weighted by its closing word,
so that digits after `no.` do not speak against digits that open a sentence. Both
tables keep keys seen in at least KEEP_SHARE of all cases, at most 1 / KEEP_SHARE
for each kind and script, whatever the corpus; a word's estimate backs off to its
shape's the more, the rarer it is, and rarer words are scored by their shape alone.
Words count whole; of those over LONG characters hashes of the whole word and of
its whole shape are the keys.

Texts are read once: what the marks of their paragraphs show lies in a table of the
shared folder, from which counts and spans are made. The jobs that learn run while
the DataFrame is built.

Defined cases
* null, empty and blank texts have no unit; a text without a mark is one unit;
* a line is a list item if it begins with a bullet and a blank, or with a number and
  a full stop, where the line before it is blank, the number follows that of the item
  before, or it is 1 after a line that ends a sentence (a line may also break before
  `9. May`); a dash is a bullet after a blank line or another dash item only;
* a unit ends with its last character that is not white space; offsets count code points.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import spill, spread
from .spans import _INV, _R, _mix, _powers

#: A word is kept in a table from this share of all its script's texts and words at (possible) boundaries.
KEEP_SHARE = 1e-4
#: The estimate of its shape weighs as much as so many texts with a word.
BACK_OFF = 4.0
#: Words over so many characters are counted by hashes of the whole word.
LONG = 64
#: Spans of more words than this lose PER_WORD for each word beyond.
FLAT, PER_WORD = 60, 0.02
#: What a span loses whose quotes or brackets do not balance.
UNBALANCED = 5.0

#: An opening word speaks against a boundary as strongly as a closing word, but for one
#: only so much: a capital after an abbreviation is no sentence.
OPEN_MOST = 2.5

_MARKS = ".!?…。！？؟।॥۔｡．‼⁇⁈⁉"
_CLOSE = "\"'”’»›“‘)]}』」》）】〉〕"
_OPEN = "\"'“‘„«‹([{『「《（【〈¿¡‚”’»"
_BREAK = re.compile(r"(?:\r\n|\n|\r)")
_BULLET = re.compile(r"[^\S\r\n]*(?:[•‣◦▪●·*–—-][^\S\r\n]+|(\d+)\.(?=[^\S\r\n]))")
_CAND = re.compile(rf"(?:[{_MARKS}]+|(?<=[ऀ-ॿ] )\||(?<=[ऀ-ॿ])\|)[{re.escape(_CLOSE)}]*(?:[ \t\xa0\u2009\u202f]+[»›])?")
_THAI_GAP = re.compile(r"(?<=[ก-๛])\s+(?=[ก-๛])")
_THAI_SHORT = re.compile(r"[ก-๛]+\.")
_GAP = "ก "  # the closing key of a blank between Thai words
_THAI = re.compile(r"[\u0e01-\u0e5b]")
_DIGITS = re.compile(r"\d+")
_WIDE = re.compile(r"[\u2e80-\u9fff\uf900-\ufaff\uff66-\uff9d]")
_QUOTE_OPEN, _QUOTE_SHUT = "«「『《（([【〈“„", "»」』》）)]】〉”"


#: Scripts that are told apart, by their letters; the first that reaches MIXED of all letters counts.
_SCRIPTS = {
    "kana": re.compile(r"[\u3040-\u30ff]"),
    "han": re.compile(r"[\u2e80-\u2fdf\u3400-\u9fff\uf900-\ufaff]"),
    "thai": _THAI,
    "hangul": re.compile(r"[\u1100-\u11ff\u3130-\u318f\uac00-\ud7a3]"),
    "indic": re.compile(r"[\u0900-\u0dff]"),
    "arabic": re.compile(r"[\u0590-\u08ff]"),
    "cyrillic": re.compile(r"[\u0400-\u052f]"),
    "greek": re.compile(r"[\u0370-\u03ff]"),
}
_LETTER = re.compile(r"[^\W\d_]")
MIXED = 0.1


def script_of(text: str) -> str:
    """The script of a text: one other than Latin if a tenth of all letters is in it."""
    if text.isascii():
        return "latin"
    letters = 0
    for name, pattern in _SCRIPTS.items():
        if pattern.search(text):
            letters = letters or len(_LETTER.findall(text))
            if len(pattern.findall(text)) > MIXED * letters:
                return name
    return "latin"


def _kind(c: str) -> str:
    return "0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else "w" if c.isalpha() or ord(c) > 0x300 and c.isprintable() and c not in _MARKS + _CLOSE + _OPEN else c


@lru_cache(maxsize=200_000)
def _shape(word: str) -> str:
    """The kinds of a word's characters, repeated ones once; of a long word's key, its shape's part."""
    if word[1:2] == "\0":
        return word[:18]
    out = []
    for c in word:
        k = _kind(c)
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class _LongWords:
    """Keys of any words of a text over LONG characters, from prefix sums over all of it:
    a hash of the word's characters, digits alike, and one of its shape."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.n = len(codes)
        chars, of = np.unique(codes, return_inverse=True)
        chars = [chr(c) for c in chars.tolist()]
        self.kinds = np.array([ord(_kind(c)) for c in chars], np.uint64)[of]
        begins = np.r_[True, self.kinds[1:] != self.kinds[:-1]]
        self.run = np.cumsum(begins) - 1
        powers, self.inverse = _powers(_R, self.n + 1), _powers(_INV, self.n + 1)
        digit = self.kinds == ord("0")
        self.word_sums = self._sums(np.where(digit, self.kinds, codes.astype(np.uint64)), powers)
        self.shape_sums = self._sums(self.kinds[begins], powers)
        at = np.arange(self.n)
        space = np.array([c.isspace() for c in chars])[of]
        wide = np.array([bool(_WIDE.match(c)) for c in chars])[of]
        self.space_before = np.maximum.accumulate(np.where(space, at, -1))
        self.space_after, self.wide_after = (np.minimum.accumulate(np.where(x, at, self.n)[::-1])[::-1] for x in (space, wide))
        self.wide_before = np.maximum.accumulate(np.where(wide, at, -1))

    @staticmethod
    def _sums(values: np.ndarray, powers: np.ndarray) -> np.ndarray:
        return np.r_[np.zeros(1, np.uint64), np.cumsum(_mix(values + np.uint64(1)) * powers[: len(values)], dtype=np.uint64)]

    def _hash(self, sums: np.ndarray, a: int, z: int) -> int:
        return int(_mix((sums[z : z + 1] - sums[a : a + 1]) * self.inverse[a : a + 1] + np.uint64(z - a))[0])

    def key(self, a: int, z: int) -> str:
        if a >= z:
            return ""
        return f"{chr(int(self.kinds[a]))}\0{self._hash(self.shape_sums, int(self.run[a]), int(self.run[z - 1]) + 1):016x}{self._hash(self.word_sums, a, z):016x}"


def _last_wide(word: str) -> int:
    """Where the last character of a script without blanks stands before a word's last character, or -1."""
    k = len(word) - 2
    while k >= 0 and not (word[k] >= "\u2e80" and _WIDE.match(word[k])):
        k -= 1
    return k


def _composed(word: str) -> str:
    """Composed and decomposed letters count alike."""
    return word if word.isascii() else unicodedata.normalize("NFC", word)


class _Words:
    """The words around the marks of one text."""

    def __init__(self, text: str):
        self.text, self._long = text, None

    @property
    def long(self) -> _LongWords:
        self._long = self._long or _LongWords(self.text)
        return self._long

    def closing(self, start: int, mark_at: int, end: int) -> str:
        """The key of the word that ends at a mark, with the mark and what closes it."""
        text, z = self.text, mark_at
        if text[z - 1].isspace():
            while z > start and text[z - 1].isspace():
                z -= 1
        mark = text[mark_at] if end == mark_at + 1 else "".join(text[mark_at:end].split())
        least = max(start, z - LONG)
        word = text[least:z].rsplit(None, 1)[-1] if z > start else ""
        if not word.isascii() and (k := _last_wide(word)) > 0:
            word = word[k:]
        elif least > start and len(word) == LONG and not text[least - 1].isspace():
            a = max(start, int(self.long.space_before[z - 1]) + 1, int(self.long.wide_before[z - 2]))
            if z - a > LONG:
                while a < z and text[a] in _OPEN:
                    a += 1
                return self.long.key(a, z) + mark
        return _DIGITS.sub("0", _composed(word).lstrip(_OPEN)) + mark

    def opening(self, at: int, stop: int) -> str:
        """The key of the word that begins at or after `at`; its opening marks stand before it."""
        text, lead = self.text, ""
        while m := _FIRST.search(text, at, stop):
            at, z = m.span()
            if text[at] not in _OPEN:
                break
            lead = "“"
            while at < z and text[at] in _OPEN:
                at += 1
            if at < z:
                z = _FIRST.match(text, at, stop).end()
                break
        else:
            return lead
        word, tail = text[at:z], ""
        if not word.isascii() and (cut := _WIDE.search(word)):
            if not cut.start():
                return lead + word[:2]
            word, tail = word[: cut.start()], cut.group()
        elif z - at > LONG:
            z = min(stop, int(self.long.space_after[at]), int(self.long.wide_after[at]))
            tail = text[z] if z < stop and not text[z].isspace() else ""
            word = text[at:z] if z - at <= LONG else ""
        if word:
            return lead + _DIGITS.sub("0", _composed(word).rstrip(_TRAILING)) + tail
        while z > at and text[z - 1] in _TRAILING:
            z -= 1
        return lead + self.long.key(at, z) + tail


_FIRST = re.compile(rf"\S{{1,{LONG + 1}}}")
_TRAILING = ",;:.!?…)]}”\"»،؛"


def _case(opening: str) -> str:
    """Whether the word after a possible boundary begins with a small letter."""
    return "l" if opening.lstrip("“")[:1].islower() else "o"


@dataclass
class Paragraph:
    """A stretch between certain boundaries: its span, its script, its first word's key, the
    closing key at its end, and its possible boundaries: end of unit, start of the next
    word, closing key, opening key."""

    start: int
    end: int
    script: str
    marks: list[tuple[int, int, str, str]] = field(default_factory=list)
    first: str = ""
    final: str | None = None


def _number(digits: str) -> int:
    try:
        return int(digits)
    except ValueError:  # more digits than Python reads: a number that follows none
        return -1


def paragraphs(text: str) -> Iterator[Paragraph]:
    """The paragraphs and list items of a text with their possible boundaries."""
    begin, at, n = 0, 0, len(text)
    item_no, prev_blank, last_mark, last = 0, True, "", ""
    spans: list[tuple[int, int]] = []
    while at <= n:
        m = _BREAK.search(text, at)
        stop = m.start() if m else n
        blank = not text[at:stop].strip()
        if blank:
            if at > begin:
                spans.append((begin, at))
            begin = m.end() if m else n
        else:
            b = _BULLET.match(text, at, stop + 1 if m else n)
            if b:
                number = _number(b.group(1)) if b.group(1) else None
                mark = b.group().strip()
                if prev_blank or (number is None and (mark not in "–—" or mark == last_mark)) or (number is not None and (number == item_no + 1 and item_no or number == 1 and last in _MARKS + _CLOSE + ":")):
                    if at > begin:
                        spans.append((begin, at))
                    begin = at
                    item_no, last_mark = number or 0, mark
        prev_blank = blank
        last = text[at:stop].rstrip()[-1:]
        if not m:
            break
        at = m.end()
    if begin < n:
        spans.append((begin, n))
    words = _Words(text)
    for a, z in spans:
        while a < z and text[a].isspace():
            a += 1
        while z > a and text[z - 1].isspace():
            z -= 1
        if a < z:
            yield _with_marks(text, words, a, z)


def _with_marks(text: str, words: _Words, a: int, z: int) -> Paragraph:
    p = Paragraph(a, z, script_of(text[a:z]))
    body = a
    if b := _BULLET.match(text, a, z):
        body = b.end()
    p.first = words.opening(body, z)
    found: list[tuple[int, int, str]] = []
    for m in _CAND.finditer(text, body, z):
        end = m.end()
        if m.start() == body:
            continue
        if end == z:
            p.final = words.closing(body, m.start(), end)
            continue
        if p.script == "thai" and m.group() == "." and _THAI.match(text[m.start() - 1]):
            continue  # Thai ends no sentence with a full stop; it marks abbreviations
        nxt, last = text[end], text[end - 1]
        if nxt.isspace():
            start = end
            while start < z and text[start].isspace():
                start += 1
            if text[start] in ",;:" or (text[start] in _MARKS):
                continue
            # a straight quote after the blank that closes what is open stays with the unit
            found.append((end, start, words.closing(body, m.start(), end)))
        elif last in "。！？｡．।॥؟۔" or (last in _CLOSE and re.search("[。！？｡．।؟]", m.group())) or m.group().startswith("……"):
            if nxt not in "，、；：,;:.)）」』”’»!?！？。…":
                found.append((end, end, words.closing(body, m.start(), end)))
        elif text[m.start() - 1].isalnum() or text[m.start() - 1] in ")]%”\"»":
            before = text[m.start() - 1]
            if (nxt.isupper() and not before.isupper()) or (nxt.isalpha() and not nxt.isupper() and not nxt.islower()) or (nxt.isalpha() and before.isalpha() and ord(before) > 0x900 and not before.isupper() and not before.islower()) or (nxt in "“„«¿¡" and not before.isdigit()):
                found.append((end, end, words.closing(body, m.start(), end)))
    if p.script == "thai":
        for m in _THAI_GAP.finditer(text, body, z):
            if not _THAI_SHORT.match(text, m.end(), z):
                found.append((m.start(), m.end(), _GAP))
        found.sort()
    p.marks = [(end, start, key, "" if key == _GAP else words.opening(start, z)) for end, start, key in found]
    return p


_STRONG = re.compile(r"[!?。！？؟।｡]")


def _strong(key: str) -> bool:
    return bool(_STRONG.search(key[-2:])) and key[-1] not in _CLOSE


@lru_cache(maxsize=200_000)
def _mark_of(key: str) -> str:
    i = len(key)
    while i and key[i - 1] in _MARKS + _CLOSE + "|":
        i -= 1
    return key[i:]


@lru_cache(maxsize=200_000)
def _closing_shape(key: str) -> str:
    mark = _mark_of(key)
    return _shape(key[: len(key) - len(mark)]) + mark


def _opening_shape(key: str) -> str:
    return key[: key.startswith("“")] + _shape(key.lstrip("“"))


class Model:
    """Chances of a boundary by closing word (given the case of the next) and by opening
    word; of rarer words, by their shapes and marks."""

    def __init__(self, closing: dict, opening: dict):
        self.closing, self.opening = closing, opening
        self.shut_gains: dict = {}
        self.open_gains: dict = {}

    def p_close(self, script: str, key: str, case: str) -> float:
        if key == _GAP:
            return 0.97
        if (p := self.closing.get((script, "w", key + case))) is not None:
            return p
        for level, k in (("s", _closing_shape(key)), ("m", _mark_of(key))):
            if (p := self.closing.get((script, level, k + case))) is not None:
                return p
        return 0.95 if _strong(key) else 0.75

    def p_open(self, script: str, key: str) -> float:
        if (p := self.opening.get((script, "w", key))) is not None:
            return p
        return self.opening.get((script, "s", _opening_shape(key)), 0.5)


def _logit(p: float) -> float:
    p = min(max(p, 0.002), 0.998)
    return math.log(p / (1 - p))


_PAIRED = re.compile(f"[{re.escape(_QUOTE_OPEN + _QUOTE_SHUT)}\"]")


def _open_marks(paired: list[tuple[int, str]], places: list[int]) -> list[int]:
    """At each of the ascending places: twice how many of the quotes and brackets are open
    there, and one more if the number of straight quotes is odd."""
    out, depth, straight, k = [], 0, 0, 0
    for at, c in paired:
        if at >= places[-1]:
            break
        while places[k] <= at:
            out.append(2 * depth + straight)
            k += 1
        if c == '"':
            straight ^= 1
        elif c in _QUOTE_OPEN and not (c == "“" and depth):  # German closes with what English opens with
            depth += 1
        elif depth:
            depth -= 1
    out += [2 * depth + straight] * (len(places) - k)
    return out


def _length_score(words: int) -> float:
    """Of a span by its words: very short and very long ones are rare."""
    return (-2.0, -0.8, -0.2)[words - 1] if 1 <= words <= 3 else -PER_WORD * max(0, words - FLAT)


class _Deepest:
    """The greatest value put at a depth of at least d: a tree over the depths."""

    def __init__(self, depths: int):
        self.n = depths
        self.tree: list[tuple[float, int]] = [(-math.inf, 0)] * (depths + 1)

    def put(self, depth: int, value: float, at: int) -> None:
        i = self.n - depth
        while i <= self.n:
            if value >= self.tree[i][0]:
                self.tree[i] = (value, at)
            i += i & -i

    def best(self, depth: int) -> tuple[float, int]:
        i, out = max(0, self.n - depth), (-math.inf, 0)
        while i:
            if self.tree[i] > out:
                out = self.tree[i]
            i &= i - 1
        return out


def best_cuts(words: list[int], opened: list[int], shut: list[int], gains: list[float]) -> list[int]:
    """The bounds (by number, the last one included) that end the spans of the best sequence.
    Of each bound, the paragraph's start first: `words` before it, which grow from bound to
    bound, and the quotes open where a span begins and where one ends; gains of the inner ones."""
    n = len(words)
    best, back = [0.0] * n, [0] * n
    near = 0  # the first bound from which a span is not long
    far, far_at, deep = -math.inf, 0, None
    for j in range(1, n):
        depth, odd = shut[j] >> 1, shut[j] & 1
        while words[j] - words[near] > FLAT:  # from here on spans that begin there lose evenly
            deep = deep or [_Deepest(max(opened) // 2 + 1) for _ in "01"]
            value = best[near] + PER_WORD * words[near]
            if value >= far:
                far, far_at = value, near
            deep[opened[near] & 1].put(opened[near] >> 1, value, near)
            near += 1
        top, at = -math.inf, 0
        for i in range(j - 1, near - 1, -1):
            score = best[i] + _length_score(words[j] - words[i])
            if opened[i] >> 1 < depth or opened[i] & 1 != odd:
                score -= UNBALANCED
            if score > top:
                top, at = score, i
        if deep:
            lost = PER_WORD * (words[j] - FLAT)
            balanced, i = deep[odd].best(depth)
            if balanced - lost > top:
                top, at = balanced - lost, i
            if far - lost - UNBALANCED > top:
                top, at = far - lost - UNBALANCED, far_at
        best[j], back[j] = top + (gains[j - 1] if j < n - 1 else 0.0), at
    cut, j = [], n - 1
    while j:
        cut.append(j)
        j = back[j]
    return cut[::-1]


def _bounds(text: str, p: Paragraph) -> tuple[list[int], list[int], list[int]]:
    """(words, opened, shut) of `best_cuts` for a paragraph with marks."""
    bounds = [p.start, *(m[1] for m in p.marks), p.end]
    stops = [p.start, *(m[0] for m in p.marks), p.end]
    spaced = p.script not in ("han", "kana", "thai")
    words = [0]
    for a, z in zip(bounds, stops[1:]):
        words.append(words[-1] + (len(text[a:z].split()) if spaced else -(-(z - a) // 4)))
    paired = [(m.start(), m.group()) for m in _PAIRED.finditer(text, p.start, p.end)]
    return words, _open_marks(paired, bounds), _open_marks(paired, stops)


def _gains(model: Model, script: str, closing: list[str], opening: list[str]) -> list[float]:
    shuts, opens, out = model.shut_gains, model.open_gains, []
    for c, o in zip(closing, opening):
        if (gain := shuts.get(k := (script, c, _case(o)))) is None:
            gain = shuts[k] = _logit(model.p_close(*k))
        if c != _GAP:
            if (more := opens.get(k := (script, o))) is None:
                more = opens[k] = min(OPEN_MOST, _logit(model.p_open(*k)))
            gain += more
        out.append(gain)
    if len(shuts) + len(opens) > MEMO_KEYS:
        shuts.clear()
        opens.clear()
    return out


def segment(text: str, model: Model) -> list[int]:
    """The end offsets of the units of a text."""
    ends: list[int] = []
    for p in paragraphs(text):
        if not p.marks:
            ends.append(p.end)
            continue
        stops = [p.start, *(m[0] for m in p.marks), p.end]
        ends += [stops[j] for j in best_cuts(*_bounds(text, p), _gains(model, p.script, [m[2] for m in p.marks], [m[3] for m in p.marks]))]
    return ends


_COUNT = {"kind": pa.string(), "script": pa.string(), "level": pa.string(), "word": pa.string(), "n": pa.float64()}
_PLACE = {"p_end": pa.int64(), "stops": pa.list_(pa.int64()), "closing": pa.list_(pa.string()), "opening": pa.list_(pa.string()), "words": pa.list_(pa.int32()), "opened": pa.list_(pa.int32()), "shut": pa.list_(pa.int32())}
_COUNT_DDL = "kind string, script string, level string, word string, n double"
_PLACE_DDL = "p_end bigint, stops array<bigint>, closing array<string>, opening array<string>, words array<int>, opened array<int>, shut array<int>"


def _count_rows(counts: Counter) -> dict[str, pa.Array]:
    """Counts by (kind, script, word) as rows, with those of the words' shapes and marks and
    the totals of marks that always end a sentence."""
    whole: Counter = Counter()
    for (kind, s, k), n in counts.items():
        if kind in ("paragraphs", "case"):
            whole[kind, s, "", k] += n
            continue
        whole[kind, s, "w", k] += n
        if kind in ("start", "next", "seen_open"):
            whole[kind, s, "s", _opening_shape(k)] += n
            continue
        whole[kind, s, "s", _closing_shape(k)] += n
        whole[kind, s, "m", _mark_of(k)] += n
        if kind != "seen_close" and _strong(k):
            whole["strong_" + kind[:3], s, "", ""] += n
    keys = list(whole)
    cols = [*(pa.array([k[i] for k in keys], pa.string()) for i in range(4)), pa.array([float(whole[k]) for k in keys], pa.float64())]
    return dict(zip(_COUNT, cols))


def _counted(p: Paragraph, c: Counter, seen: set) -> None:
    """Adds what a paragraph's certain and possible boundaries show."""
    s = p.script
    c["paragraphs", s, ""] += 1
    c["case", s, _case(p.first)] += 1
    c["start", s, p.first] += 1
    seen.add(("seen_open", s, p.first))
    if p.final:
        c["end", s, p.final] += 1
        seen.add(("seen_close", s, p.final))
    for _, _, key, word in p.marks:
        if key != _GAP:
            c["midl" if word.lstrip("“")[:1].islower() else "mido", s, key] += 1
            seen.add(("seen_close", s, key))
            seen.add(("seen_open", s, word))


#: Gains that a task remembers.
MEMO_KEYS = 400_000
#: Counts of a task are passed on whenever it holds so many keys.
FLUSH_KEYS = 200_000


def places(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each paragraph (its end, its possible boundaries and what stands around
    them), and rows of counts, told apart by `kind`; every text is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            which: list[int] = []
            scripts, cols = [], {name: [] for name in _PLACE}
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                seen: set = set()
                for p in paragraphs(t):
                    _counted(p, counts, seen)
                    which.append(i)
                    scripts.append(p.script)
                    row = (p.end, [m[0] for m in p.marks], [m[2] for m in p.marks], [m[3] for m in p.marks], *_bounds(t, p)) if p.marks else (p.end, *[None] * 6)
                    for c, v in zip(cols.values(), row):
                        c.append(v)
                counts.update(seen)
            yield _batch(key, b.column(0).take(pa.array(which, pa.int64())), {"script": pa.array(scripts, pa.string())}, {n: pa.array(v, _PLACE[n]) for n, v in cols.items()})
            if len(counts) > FLUSH_KEYS:
                yield _batch(key, None, _count_rows(counts), {}, kind)
                counts = Counter()
        if counts:
            yield _batch(key, None, _count_rows(counts), {}, kind)

    ddl = f"`{key}` {docs.schema[key].dataType.simpleString()}, {_COUNT_DDL}, {_PLACE_DDL}"
    return spill(spread(docs.select(key, text)).mapInArrow(run, ddl), batch_rows=2000)


def _batch(key: str, ids: pa.Array | None, counts: dict, found: dict, kind: pa.DataType | None = None) -> pa.RecordBatch:
    n = len(ids) if ids is not None else len(counts["n"])
    cols = {name: counts.get(name, found.get(name)) for name in (*_COUNT, *_PLACE)}
    types = {**_COUNT, **_PLACE}
    return pa.RecordBatch.from_arrays([pa.nulls(n, kind) if ids is None else ids, *(pa.nulls(n, types[name]) if c is None else c for name, c in cols.items())], [key, *cols])


def _lists(column: pa.ListArray) -> Iterator[list]:
    """The lists of a column; null as the empty list."""
    at, flat = column.offsets.to_pylist(), column.values.to_pylist()
    return (flat[a:z] for a, z in zip(at, at[1:]))


def _kept(per: DataFrame, seen: str) -> DataFrame:
    """The keys that reach KEEP_SHARE of all that is seen in their script: at most
    1 / KEEP_SHARE keys of each come to the driver. What is kept depends on the number of
    texts with the key, so that no name of one long text is kept, and never on whether it
    was seen at a certain boundary."""
    own = per.where(F.col("kind") == seen).select("script", "level", "word", F.col("n").alias("seen"))
    whole = own.groupBy("script", "level").agg(F.sum("seen").alias("all"))
    return own.join(whole, ["script", "level"]).where(F.col("seen") >= F.col("all") * KEEP_SHARE).select("script", "level", "word")


def _collected(rows: DataFrame, kept: DataFrame) -> dict[tuple[str, str, str, str], float]:
    few = rows.join(kept, ["script", "level", "word"]).select("kind", "script", "level", "word", "n")
    return {(r["kind"], r["script"], r["level"], r["word"]): r["n"] for r in few.collect()}


def _share(n_certain: float, ratio: float, n_mid: float, prior: float) -> float:
    """Chance that a candidate is a boundary: certain boundaries seen, scaled by the number
    of boundaries inside paragraphs for each certain one, over candidates inside paragraphs."""
    return min(1.0, (n_certain * ratio + BACK_OFF * prior) / (n_mid + BACK_OFF))


def _rare_shapes(got: dict, shape) -> dict:
    """`got` with the counts of kept words taken out of their shapes: a shape stands for the
    words that are too rare to be kept."""
    out = dict(got)
    for (kind, s, level, k), n in got.items():
        if level == "w" and (kind, s, "s", shape(k)) in out:
            out[kind, s, "s", shape(k)] = max(0.0, out[kind, s, "s", shape(k)] - n)
    return out


def _closings(got: dict, totals: dict) -> dict[tuple[str, str, str], float]:
    scripts = {s for kind, s, _ in totals if kind == "paragraphs"}
    ratio = {s: max(0.2, totals.get(("strong_mid", s, ""), 0.0) / max(1.0, totals.get(("strong_end", s, ""), 0.0))) for s in scripts}
    cases = {(s, c): (totals.get(("case", s, c), 0.0) + 0.5) / (totals.get(("paragraphs", s, ""), 0.0) + 1.0) for s in scripts for c in "lo"}
    out: dict[tuple[str, str, str], float] = {}
    for level in ("m", "s", "w"):
        for s, k in sorted({(s, k) for kind, s, lv, k in got if lv == level and kind in ("end", "midl", "mido")}):
            for c in "lo":
                prior = out.get((s, "m", _mark_of(k) + c), 0.5)
                if level == "w":
                    prior = out.get((s, "s", _closing_shape(k) + c), prior)
                out[s, level, k + c] = _share(got.get(("end", s, level, k), 0.0), ratio[s] * cases[s, c], got.get(("mid" + c, s, level, k), 0.0), prior)
    return out


def _openings(got: dict) -> dict[tuple[str, str, str], float]:
    total: Counter = Counter()
    for (kind, s, lv, _), n in got.items():
        total[kind, s] += n
    out: dict[tuple[str, str, str], float] = {}
    for level in ("s", "w"):
        for s, k in sorted({(s, k) for kind, s, lv, k in got if lv == level}):
            r = max(0.2, total["next", s] / max(1.0, total["start", s]))
            prior = 0.5 if level == "s" else out.get((s, "s", _opening_shape(k)), 0.5)
            out[s, level, k] = _share(got.get(("start", s, level, k), 0.0), r, got.get(("next", s, level, k), 0.0), prior)
    return out


def fit(found: DataFrame) -> Model:
    """The model of a corpus, from its `places`: counts of certain and possible boundaries
    give the closings, and candidates weighted by them the openings."""
    per = spill(found.where("kind is not null").groupBy("kind", "script", "level", "word").agg(F.sum("n").alias("n")))
    totals = {(r["kind"], r["script"], r["word"]): r["n"] for r in per.where("level = ''").collect()}
    of_close, of_open = _kept(per, "seen_close"), spill(_kept(per, "seen_open"))
    got = _collected(per.where(F.col("kind").isin("end", "midl", "mido")), of_close)
    closing = _closings(_rare_shapes(got, _closing_shape), totals)
    partial = Model(closing, {})

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for s, keys, words in zip(b.column(0).to_pylist(), _lists(b.column(1)), _lists(b.column(2))):
                for key, word in zip(keys, words):
                    if key != _GAP:
                        counts["next", s, word] += partial.p_close(s, key, _case(word))
            if len(counts) > FLUSH_KEYS:
                yield pa.RecordBatch.from_pydict(_count_rows(counts))
                counts = Counter()
        if counts:
            yield pa.RecordBatch.from_pydict(_count_rows(counts))

    weighed = found.where("stops is not null").select("script", "closing", "opening").mapInArrow(weigh, _COUNT_DDL)
    follow = weighed.groupBy("kind", "script", "level", "word").agg(F.sum("n").alias("n"))
    got = _collected(per.where("kind = 'start'").unionByName(follow), of_open)
    return Model(closing, _openings(_rare_shapes(got, _opening_shape)))


def sentence_ends(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """(key, end_char): one row for each sentence unit of each text."""
    found = places(docs, key, text)
    model = model or fit(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, ends = [], []
            for i, (script, end, stops, closing, opening, *bounds) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), *(_lists(b.column(c)) for c in range(3, 9)))):
                if not stops:
                    which.append(i)
                    ends.append(end)
                    continue
                stops.append(end)
                cuts = best_cuts(*bounds, _gains(model, script, closing, opening))
                which += [i] * len(cuts)
                ends += [stops[j - 1] for j in cuts]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(ends, pa.int64())], [key, "end_char"])

    rows = found.where("kind is null").select(key, "script", *_PLACE)
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, end_char bigint")
