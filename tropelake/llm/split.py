"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundaries from the strongest to the weakest: whitespace after an end of sentence, whitespace after a lesser mark, a space.
STRENGTHS = (re.compile(r"(?<=[.!?])[ \t\n\r]+"), re.compile(r"(?<=[,;:\-])[ \t\n\r]+"), re.compile(r" "))
WORD = re.compile(r"(?<=[ \t\n\r])[^ \t\n\r]")


class Boundaries:
    """All boundaries of a text, found once; a boundary lies after its run of whitespace."""

    def __init__(self, text: str):
        self.runs = []
        for pattern in STRENGTHS:
            spans = [m.span() for m in pattern.finditer(text)]
            self.runs.append(([a for a, _ in spans], [b for _, b in spans]))
        self.words = [m.start() for m in WORD.finditer(text)]

    def snap(self, target: int, low: int, high: int, base: int = 0) -> int:
        """The boundary over ``low`` and up to ``high`` nearest to ``target``, of the strongest kind that has one.  Else ``target``.

        A run of whitespace over the edge counts up to it; its mark must stand at ``base`` or later.
        """
        for kind, (starts, ends) in enumerate(self.runs):
            i, j = max(bisect_right(ends, low), bisect_left(starts, base + (kind < 2))), bisect_left(starts, high)
            if i < j:
                k = min(bisect_left(ends, target, i, j), j - 1)
                return min((min(ends[x], high) for x in (k - 1, k) if x >= i), key=lambda e: (abs(e - target), e))
        return target

    def resume(self, end: int, overlap: int) -> int:
        """The first start of a word in the ``overlap`` characters before ``end``, else their first place."""
        i = bisect_right(self.words, end - overlap - 1)
        return self.words[i] if i < len(self.words) and self.words[i] < end else end - overlap


def full_pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Targets at the limit of each piece, snapped to the strongest boundary in it; a piece more as long as the last is over the limit."""
    at, size = Boundaries(text), len(text)
    pieces = [(0, size)]
    while size - pieces[-1][0] > limit:
        start = pieces[-1][0]
        end = at.snap(start + limit, start + overlap, start + limit, start)
        pieces[-1:] = [(start, end), (at.resume(end, overlap), size)]
    return pieces


def balanced_pieces(text: str, limit: int, overlap: int, slack: float = 0.2) -> list[tuple[int, int]]:
    """The fewest pieces, targets at equal lengths, each snapped to the strongest boundary within ``slack`` of a piece's length; a piece more whenever one gets over the limit.

    Where twice as many pieces don't do, as with a word longer than a piece, boundaries have to be nearer to the targets;
    with none near enough the targets themselves are taken, which always fit.
    """
    size = len(text)
    if size <= limit:
        return [(0, size)]
    at, fewest = Boundaries(text), -(-(size - overlap) // (limit - overlap))
    for share in (slack, slack / 2, slack / 4, 0):
        for count in range(fewest, 2 * fewest + 1):
            step = (size - overlap) / count
            near, ends = int(step * share), []
            for k in range(1, count):
                target = overlap + round(step * k)
                low = max(target - near - 1, ends[-1] + overlap if ends else overlap)
                ends.append(at.snap(target, low, min(target + near, size - 1)) if near else target)
            starts = [0, *(at.resume(e, overlap) if near else e - overlap for e in ends)]
            pieces = list(zip(starts, [*ends, size]))
            if all(0 < b - a <= limit for a, b in pieces) and all(a < c for a, c in zip(starts, starts[1:])):
                return pieces
    raise AssertionError("equal pieces fit")


def split_texts(df: DataFrame, ident: str, text: str, limit: int = 5000, overlap: int = 250, placement: str = "balanced", oversized_only: bool = True, with_text: bool = True) -> DataFrame:
    """Pieces of at most ``limit`` characters with about ``overlap`` characters in common: ``ident``, ``piece_no``, ``start_char``, ``end_char``, and ``piece`` unless not ``with_text``.

    ``placement`` sets the targets that are snapped to boundaries: "balanced" cuts into the fewest pieces of about
    equal length, "full" fills each piece as far as a boundary allows.  Characters are code points, offsets count
    from 0 and ends are exclusive; pieces together cover the whole text.  Texts are processed whole, where they
    are read, without a shuffle; each is decoded once.

    Null texts have no pieces.  Texts of at most ``limit`` characters give none, or themselves as one piece without
    ``oversized_only`` (an empty text then none).  A text without any boundary is cut at the targets.  A null
    identifier stays null.  Rows that occur repeatedly give repeated pieces: see ``distinct_pieces``.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be less than half the limit")
    cut = {"balanced": balanced_pieces, "full": full_pieces}[placement]
    id_type = df.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, number, start, end, piece, held = [], [], [], [], [], 0

            def out() -> pa.RecordBatch:
                columns = [batch.column("id").take(pa.array(which, pa.int64())), *[pa.array(x, pa.int32()) for x in (number, start, end)]]
                columns += [pa.array(piece, pa.string())] * with_text
                return pa.RecordBatch.from_arrays(columns, names=["id", "piece_no", "start_char", "end_char", "piece"][: len(columns)])

            for i, value in enumerate(batch.column("text")):
                whole = value.as_py()
                for k, (a, b) in enumerate(cut(whole, limit, overlap)):
                    which.append(i)
                    number.append(k + 1)
                    start.append(a)
                    end.append(b)
                    if with_text:
                        piece.append(whole[a:b])
                        held += b - a
                if held > 1 << 22:
                    yield out()
                    which, number, start, end, piece, held = [], [], [], [], [], 0
            yield out()

    size = F.char_length(F.col("text"))
    rows = df.select(F.col(f"`{ident}`").alias("id"), F.col(f"`{text}`").alias("text")).where(size > (limit if oversized_only else 0))
    pieces = rows.mapInArrow(run, f"id {id_type}, piece_no INT, start_char INT, end_char INT" + ", piece STRING" * with_text)
    return pieces.withColumnRenamed("id", ident)


def distinct_pieces(pieces: DataFrame, ident: str) -> DataFrame:
    """Places of the pieces, those of repeated rows once; texts stay out of the shuffle."""
    return pieces.select(ident, "piece_no", "start_char", "end_char").distinct()
