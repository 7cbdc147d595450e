"""Splitting oversized texts at natural boundaries (problem 2)."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetry.sources.tables import latest

LIMIT, OVERLAP = 2000, 200
_SPACES = re.compile(r"\s+")
_LINE = re.compile(r"[\n\r  \x85]")
_END = re.compile(r"[.!?…。！？:;][\"'”’»)\]]*$")
#: Boundaries from the strongest: a blank line, a sentence or line end, any white space.
KINDS = ("paragraph", "sentence", "space")
#: Characters of pieces in an Arrow batch that a task sends back.
BATCH_CHARS = 1 << 22


class Boundaries:
    """Where a text may be cut, by strength; a cut lies before or after a run of white space."""

    def __init__(self, text: str):
        self.text = text
        self.by_kind: tuple[list[int], ...] = ([], [], [])
        self.before: list[int] = []
        self.after: list[int] = []
        for m in _SPACES.finditer(text):
            a, b = m.span()
            self.before.append(a)
            self.after.append(b)
            lines = len(_LINE.findall(m[0].replace("\r\n", "\n"))) if b - a > 1 else bool(_LINE.match(m[0]))
            strength = 0 if lines > 1 else 1 if lines or _END.search(text, max(0, a - 8), a) else 2
            self.by_kind[strength].append(b)

    def nearest(self, places: list[int], low: int, high: int, to: int) -> int | None:
        """Of the places in [low, high] the one nearest to ``to``, of equally near ones the first."""
        i, j = bisect_left(places, low), bisect_right(places, high)
        if i >= j:
            return None
        k = bisect_left(places, to, i, j)
        return min((places[x] for x in (k - 1, k) if i <= x < j), key=lambda p: (abs(p - to), p))

    def cut(self, a: int, b: int, limit: int) -> tuple[int, str] | None:
        """The strongest boundary near the middle of [a, b), else one farther off, else a cut inside a run.

        None where [a, b) is within ``limit`` and no boundary leaves text on both sides.
        """
        middle, reach = (a + b) // 2, (b - a) // 4
        for kind, places in zip(KINDS, self.by_kind):
            if (at := self.nearest(places, max(a + 1, middle - reach), min(b - 1, middle + reach), middle)) is not None:
                return at, kind
        low, high = a + 1, b - 1
        if b - a <= limit:  # white space at the edges alone is no reason to cut
            first = bisect_right(self.before, a)
            low = self.after[first - 1] + 1 if first and self.after[first - 1] > a else low
            last = bisect_left(self.after, b)
            high = self.before[last] - 1 if last < len(self.before) and self.before[last] < b else high
        found = [x for x in (self.nearest(self.after, low, high, middle), self.nearest(self.before, low, high, middle)) if x is not None]
        if found:
            return min(found, key=lambda p: abs(p - middle)), "space"
        if b - a <= limit:
            return None
        i = bisect_right(self.before, middle) - 1
        return middle, "space" if i >= 0 and self.after[i] > middle else "hard"


def cores(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, str]], Boundaries | None]:
    """[start, end) of the parts that make up the text without gap or overlap, and what ends each.

    Recursive bisection: a part longer than ``limit - overlap`` is cut; one of up to ``limit``
    stays whole where no boundary lies inside it, so a run without white space is only cut
    (``hard``) if it alone exceeds ``limit``.
    """
    if len(text) <= limit:
        return [(0, len(text), "end")], None
    marks, done, todo = Boundaries(text), [], [(0, len(text), "end")]
    while todo:
        a, b, ends = todo.pop()
        found = marks.cut(a, b, limit) if b - a > limit - overlap else None
        if found is None:
            done.append((a, b, ends))
        else:
            todo += [(found[0], b, ends), (a, found[0], found[1])]
    return done, marks


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """(start, core_start, end, cut) of each piece: its core with up to ``overlap`` characters before it.

    The overlap begins at a boundary where there is one, and never makes a piece exceed ``limit``
    or reach back past the core before.
    """
    parts, marks = cores(text, limit, overlap)
    out = []
    for i, (a, b, ends) in enumerate(parts):
        start = a
        if i and overlap:
            low = max(a - overlap, b - limit, parts[i - 1][0])
            start = low
            if marks is not None and low < a:
                for places in marks.by_kind[1:]:
                    k = bisect_left(places, low)
                    if k < len(places) and places[k] < a:
                        start = places[k]
                        break
        out.append((start, a, b, ends))
    return out


def split_texts(docs: DataFrame, keys: list[str], text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """The pieces of every text: ``keys``, piece (from 0), n_pieces, start, core_start, end, cut, record_cut[, piece_text].

    Positions are in code points; the cores [core_start, end) joined give the text exactly, and
    pieces have at most ``limit`` characters. cut says what ends the piece: ``paragraph``,
    ``sentence``, ``space``, ``hard`` (inside a run of more than ``limit`` characters without
    white space) or ``end``; record_cut is ``hard`` if any cut of the record is, else ``soft``, and
    null for a text within the limit, which is one piece. A null text has no pieces, an empty
    one a single empty piece; repeated rows and null keys come out as often as they are. A map
    without shuffle; a long text is handled alone and sent on in bounded batches.
    """
    kinds = dict(docs.dtypes)
    names = ["piece", "n_pieces", "start", "core_start", "end", "cut", "record_cut"] + ["piece_text"] * with_text
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.string()] * with_text
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "piece int, n_pieces int, start bigint, core_start bigint, end bigint, cut string, record_cut string"]) + ", piece_text string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, owner, rows, held = b.column(len(keys)), [], [], 0

            def full() -> pa.RecordBatch:
                of = pa.array(owner, pa.int32())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types]
                return pa.RecordBatch.from_arrays([*(b.column(i).take(of) for i in range(len(keys))), *cols], names=[*keys, *names])

            for i, cell in enumerate(texts):
                text = cell.as_py()
                if text is None:
                    continue
                found = pieces_of(text, limit, overlap)
                record = None if len(found) == 1 else "hard" if any(p[3] == "hard" for p in found) else "soft"
                for k, (start, core, end, cut) in enumerate(found):
                    owner.append(i)
                    rows.append((k, len(found), start, core, end, cut, record, *([text[start:end]] if with_text else [])))
                    held += end - start
                    if held >= BATCH_CHARS:
                        yield full()
                        owner, rows, held = [], [], 0
            yield full()

    return docs.select(*keys, text_col).mapInArrow(run, schema)


def corpora(wikitext: DataFrame, bills: DataFrame, over: int = 0) -> DataFrame:
    """(corpus, doc_id, text): the latest text of each wikitext record and summary of each bill.

    With ``over``, texts of up to so many characters are emptied before the shuffle and dropped after.
    """

    def read(df: DataFrame, name: str, col: str) -> DataFrame:
        text = F.when(F.length(col) > over, F.col(col)) if over else F.col(col)
        rows = df.where("doc_id is not null").select(F.lit(name).alias("corpus"), "doc_id", text.alias("text"), "loaded_at")
        return latest(rows, ["doc_id"], ["corpus", "text"]).select("corpus", "doc_id", "text").where("text is not null")

    return read(wikitext, "wikitext", "text").unionByName(read(bills, "bills", "summary"))
