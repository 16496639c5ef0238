"""Characters with boxes to words, for many pages at once: arrays over the characters of a batch of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BOX = ("x0", "y0", "x1", "y1")
#: Fixed value: pages are worked on together up to about so many characters.
TOGETHER = 1 << 16


def _line_of(heights: list[tuple[float, float]]) -> list[int]:
    """The line, from 0, of each height (top, bottom): the first line whose first height overlaps it, else one of its own."""
    lines: list[tuple[float, float]] = []
    of = []
    for a, b in heights:
        for i, (c, d) in enumerate(lines):
            # One line: one holds the other, or they share more than half of either one's height.
            if (a <= c and d <= b) or (c <= a and b <= d):
                break
            shared = (b if b < d else d) - (a if a > c else c)
            if shared >= 0 and shared > 0.5 * min(b - a, d - c):
                break
        else:
            i = len(lines)
            lines.append((a, b))
        of.append(i)
    return of


def _lines(page: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """The line of each character, from 0 on each page. Characters of one height are decided once, in the order in which the heights come."""
    order = np.lexsort((y1, y0, page))
    p, a, b = page[order], y0[order], y1[order]
    new = np.r_[True, (p[1:] != p[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    first = order[new]
    come = np.argsort(first, kind="stable")
    ends = np.r_[np.flatnonzero(np.diff(page[first[come]])) + 1, len(first)].tolist()
    heights, of, start = list(zip(y0[first[come]].tolist(), y1[first[come]].tolist())), [], 0
    for end in ends:
        of += _line_of(heights[start:end])
        start = end
    line_of_height, out = np.empty(len(first), np.int64), np.empty(len(page), np.int64)
    line_of_height[come] = of
    out[order] = line_of_height[np.cumsum(new) - 1]
    return out


def _modes(line: np.ndarray, gap: np.ndarray, n_lines: int) -> np.ndarray:
    """The commonest gap of each line, overlaps counting as none, of equally common ones the first; nan if it has none."""
    at = np.flatnonzero(~np.isnan(gap))
    of, common, out = line[at], np.maximum(gap[at], 0.0) + 0.0, np.full(n_lines, np.nan)
    if not len(at):
        return out
    order = np.lexsort((common, of))
    of, common = of[order], common[order]
    starts = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (common[1:] != common[:-1])])
    counts = np.diff(np.r_[starts, len(of)])
    best = np.lexsort((order[starts], -counts, of[starts]))
    best = best[np.r_[True, np.diff(of[starts][best]) > 0]]
    out[of[starts][best]] = common[starts][best]
    return out


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values, nulls too, as equal numbers."""
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _joined(chars: pa.Array, order: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The characters in ``order``, joined from each of ``starts`` to the next."""
    text = chars.cast(pa.string()).take(pa.array(order))
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.ascontiguousarray(offsets[np.r_[starts, len(text)]])), text.buffers()[2])


def _words(pages: pa.RecordBatch, key: list[str]) -> pa.RecordBatch:
    """The words of pages with their characters; see ``forms.page_words``."""
    chars = pages["_chars"].flatten()
    kind = [f.name for f in chars.type]
    c = dict(zip(kind, chars.flatten()))
    x0, y0, x1, y1 = (c[k].to_numpy(zero_copy_only=False) for k in BOX)
    seq, page = c["seq"].to_numpy(zero_copy_only=False), np.repeat(np.arange(len(pages)), pc.list_value_length(pages["_chars"]).to_numpy())
    come = np.lexsort((y1, y0, seq, page))
    page, x0, y0, x1, y1 = (v[come] for v in (page, x0, y0, x1, y1))
    line_no = _lines(page, y0, y1)
    # From left to right, what has no place first.
    placed = lambda v: np.where(np.isnan(v), -np.inf, v)
    order = np.lexsort((y1, placed(x1), y0, placed(x0), line_no, page))
    page, line_no, x0, y0, x1, y1, order = (v[order] for v in (page, line_no, x0, y0, x1, y1, come))
    opens = np.r_[True, (page[1:] != page[:-1]) | (line_no[1:] != line_no[:-1])]
    line, first = np.cumsum(opens) - 1, np.flatnonzero(opens)
    gap = np.r_[np.nan, x0[1:] - x1[:-1]]
    gap[first] = np.nan
    font, size = (_codes(c[k])[order] for k in ("font", "size"))
    other = np.r_[False, (font[1:] != font[:-1]) | (size[1:] != size[:-1])]
    new = opens | other | (np.floor(gap) > _modes(line, gap, len(first))[line])
    starts = np.flatnonzero(new)
    word = np.cumsum(new) - 1
    # The lines of a page from top to bottom: what all of them down to each one are high, and how many they are.
    top, bottom, on = np.minimum.reduceat(y0, first), np.maximum.reduceat(y1, first), page[first]
    down = np.lexsort((line_no[first], bottom, top, on))
    begins = np.flatnonzero(np.r_[True, np.diff(on[down]) > 0])
    high = (bottom - top)[down]
    sums, n = np.cumsum(high), np.arange(len(high))
    page_at = np.repeat(begins, np.diff(np.r_[begins, len(high)]))
    below, rank = np.empty(len(high)), np.empty(len(high), np.int64)
    below[down], rank[down] = sums - np.r_[0.0, sums][page_at], n - page_at + 1
    of, at, on = line[starts], pa.array(order[starts]), pa.array(page[starts])
    number = lambda v: pa.array(v, pa.float64(), from_pandas=True)
    columns = {k: pages[k].take(on) for k in (*key, "page")}
    columns |= {"line": pa.array((line_no[starts] + 1).astype(np.int32)), "word_no": pa.array(word[starts] - word[first][of])}
    columns |= {"x0": number(np.fmin.reduceat(x0, starts)), "y0": pa.array(np.minimum.reduceat(y0, starts)), "x1": number(np.fmax.reduceat(x1, starts)), "y1": pa.array(np.maximum.reduceat(y1, starts))}
    columns |= {"word": _joined(c["char"], order, starts), "font": c["font"].take(at), "size": c["size"].take(at)}
    columns |= {"_high": pa.array((bottom - top)[of]), "_below": pa.array(below[of]), "_rank": pa.array(rank[of])}
    return pa.RecordBatch.from_pydict(columns)


def words_of_pages(key: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of pages (key, page, _chars) to batches of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch["_chars"]).to_numpy())
            starts = np.flatnonzero(np.r_[True, np.diff(ends // TOGETHER) > 0])[: len(ends)].tolist()
            for start, end in zip(starts, [*starts[1:], len(ends)]):
                yield _words(batch.slice(start, end - start), key)

    return run
