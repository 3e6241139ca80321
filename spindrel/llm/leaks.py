"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over folded five-word stretches of all held-out passages scans each page once, in reading order. From
each hit the passage is followed word by word in both directions: misread words by their edit distance, broken words over the ends
of lines, and lines of adverts or of other columns passed over.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from itertools import accumulate
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrel.llm.page_text import fold, segments

#: Words of a passage that make a leak, words of a stretch of the automaton, and letters that tell that a passage goes on behind
#: lines passed over: up to ``NEAR`` lines, and more lines than that, where chance has more places to read alike.
LEAK_WORDS, SEED_WORDS, SURE, NEAR, SURE_FAR = 16, 5, 9, 14, 20
#: Passages an automaton is built for: it is sent to every task, so a larger test set must come in several calls.
MOST_ITEMS = 50_000


class Passage:
    """A passage as folded words, forwards and backwards, with all items that have these words."""

    def __init__(self, words: tuple[str, ...]) -> None:
        self.items: list[int] = []
        self.words = words
        self.reversed = [w[::-1] for w in reversed(self.words)]


class LeakFinder:
    """The automaton and the check of what it hits."""

    def __init__(self, items: Sequence[tuple[int, str]], leak_words: int = LEAK_WORDS) -> None:
        same: dict[tuple[str, ...], Passage] = {}
        for i, t in items:
            words = tuple(w for w in (fold(x) for x in re.split(r"\s+", t or "")) if w)
            same.setdefault(words, Passage(words)).items.append(i)
        self.passages = list(same.values())
        self.leak_words = leak_words
        seeds: dict[str, list[tuple[int, int, int]]] = defaultdict(list)
        for k, p in enumerate(self.passages):
            for w in range(len(p.words) - SEED_WORDS + 1):
                seeds["".join(p.words[w : w + SEED_WORDS])].append((k, w, w + SEED_WORDS))
        self.automaton = ahocorasick.Automaton()
        for s, at in seeds.items():
            self.automaton.add_word(s, (len(s), at))
        if len(self.automaton):
            self.automaton.make_automaton()

    def scan(self, text: str | None, x0: np.ndarray | None = None, y0: np.ndarray | None = None) -> list[tuple[int, int, int, int]]:
        """``(item, words, start, end)`` of the passages that ``text`` leaks, from the first to behind the last of their letters in ``text``
        as delivered (or, where columns were delivered in another order, of the lines that hold them)."""
        if not text or not len(self.automaton):
            return []
        parts = segments(text, x0, y0)
        # The marks that break words fold to nothing, so folded lines can be joined as they are.
        folded = fold("\n".join([text[a:b] for a, b in parts])).split("\n")
        hits = list(self.automaton.iter("".join(folded)))
        if not hits:
            return []
        ends = list(accumulate(len(x) for x in folded))
        back: list[str] | None = None
        best: dict[int, tuple[int, int, int, int, int]] = {}
        done: dict[int, tuple[int, int, int]] = {}
        for last, (size, at) in hits:
            first = last + 1 - size
            for k, w, z in at:
                # A hit within what the passage was followed through already gives nothing new.
                until, lo, hi = done.get(k, (-1, 0, 0))
                if last <= until and lo <= w and z <= hi:
                    continue
                if back is None:
                    back = [x[::-1] for x in reversed(folded)]
                p = self.passages[k]
                n = bisect_right(ends, last)
                right, to_line, to = follow(folded, n, last + 1 - ends[n] + len(folded[n]), p.words, z)
                m = bisect_right(ends, first)
                left, from_line, before = follow(back, len(folded) - 1 - m, ends[m] - first, p.reversed, len(p.words) - w)
                found = z - w + right + left
                done[k] = (ends[to_line] - len(folded[to_line]) + to - 1, w - left, z + right)
                if found > best.get(k, (0,))[0]:
                    best[k] = (found, len(folded) - 1 - from_line, len(folded[len(folded) - 1 - from_line]) - before, to_line, to)
        out = []
        for k, (found, lo, first, hi, last) in best.items():
            if found >= self.leak_words:
                begin, _ = letter(text, *parts[lo], first)
                _, stop = letter(text, *parts[hi], last - 1)
                start, end = min(begin, *(a for a, _ in parts[lo + 1 : hi + 1]), stop), max(begin, *(b for _, b in parts[lo:hi]), stop)
                out += [(i, found, start, end) for i in self.passages[k].items]
        return out


def letter(text: str, a: int, b: int, k: int) -> tuple[int, int]:
    """Where in ``text`` the ``k``-th folded letter of ``text[a:b]`` begins and ends."""
    lo, hi = a + 1, b
    while lo < hi:  # the fold of a longer beginning is never shorter
        mid = (lo + hi) // 2
        if len(fold(text[a:mid])) > k:
            hi = mid
        else:
            lo = mid + 1
    end = lo
    while end < b and fold(text[end]) and len(fold(text[a : end + 1])) == k + 1:
        end += 1  # the second of a pair that reads like one letter
    return lo - 1, end


def follow(lines: list[str], n: int, at: int, words: Sequence[str], w: int) -> tuple[int, int, int]:
    """How many of ``words`` from the ``w``-th on go on at place ``at`` of line ``n``, with the line and place where they end. Words
    broken at a line's end are joined; lines that don't go on are passed over, however many; see ``SURE``."""
    start = w
    while w < len(words):
        word, line = words[w], lines[n]
        size = alike(line, at, word)
        if size is not None:
            at += size
            w += 1
            continue
        rest = line[at:]
        if len(rest) > len(word) + 1:
            # Too far from a line's end to be broken: a word badly misread, if the two behind it follow as they are.
            pair = "".join(words[w + 1 : w + 3])
            size = next((k for k in range(max(1, len(word) - 2), len(word) + 3) if pair and line.startswith(pair[: max(1, len(line) - at - k)], at + k)), None)
            if size is None or len(line) - at - size < 4 or alike(line[: at + size], at, word, max(1, len(word) // 2)) is None:
                break
            at += size
            w += 1
            continue
        for m in range(n + 1, len(lines)):
            both = rest + lines[m]
            size, v = 0, w
            while v < len(words) and size < len(rest) + SURE:
                more = alike(both, size, words[v])
                if more is None:
                    break
                size += more
                v += 1
            short = v == len(words) or size + len(words[v]) > len(both)
            sure = v > w and size > len(rest) and (size >= len(rest) + SURE or short and size >= min(len(both), SURE))
            if sure and (m <= n + NEAR or goes_on(rest, lines[m : m + 3], words, w)):
                n, at, w = m, size - len(rest), v
                break
        else:
            break
    return w - start, n, at


def goes_on(rest: str, lines: list[str], words: Sequence[str], w: int) -> bool:
    """Whether ``words`` from the ``w``-th on are in ``rest`` and ``SURE_FAR`` letters of the lines after it."""
    both, size = rest + "".join(lines), 0
    while w < len(words) and size < len(rest) + SURE_FAR:
        more = alike(both, size, words[w])
        if more is None:
            return False
        size, w = size + more, w + 1
    return size >= len(rest) + SURE_FAR


def alike(text: str, at: int, word: str, most: int | None = None) -> int | None:
    """Letters of ``text`` from ``at`` that read like ``word``: the same, or a few of them changed, missing or added (``most``; a
    letter in four, one in words of three to seven). None if it goes on with something else."""
    n = len(word)
    if text.startswith(word, at):
        return n
    if most is None:
        most = 0 if n < 3 else max(1, n // 4)
    if not most or len(text) - at < n - most:
        return None
    part = text[at : at + n + most]
    # Of ``most + 1`` pieces of the word one must stand unchanged near its place.
    piece = n // (most + 1)
    if piece and not any(word[i : i + piece] in part[max(0, i - most) : i + piece + most] for i in range(0, piece * (most + 1), piece)):
        return None
    row = list(range(len(part) + 1))
    for x, c in enumerate(word, 1):
        last, row[0] = row[0], x
        low = x
        for y, d in enumerate(part, 1):
            keep = row[y]
            v = last if c == d else 1 + min(last, keep, row[y - 1])
            row[y], last = v, keep
            if v < low:
                low = v
        if low > most:
            return None
    best = min(range(len(row)), key=lambda y: (row[y], abs(y - n)))
    return best if row[best] <= most else None


_finders: dict[tuple, LeakFinder] = {}


def finder_of(items: Sequence[tuple[int, str]], leak_words: int) -> LeakFinder:
    """The automaton, built once a process for the same test set."""
    key = (leak_words, len(items), hash(tuple(items)))
    if key not in _finders:
        _finders.clear()
        _finders[key] = LeakFinder(items, leak_words)
    return _finders[key]


def leaks(documents: DataFrame, items: DataFrame, leak_words: int = LEAK_WORDS) -> DataFrame:
    """``(doc_id, item_id, n_words, start_pos, end_pos)``: pages that hold ``leak_words`` or more consecutive words of a passage.

    One pass over ``documents (doc_id, text, lines)``, no shuffle; whole texts. Only the test set is sent to the tasks, after a
    check of its size. Null and empty texts and passages leak nothing; a page without layout is read as delivered; repeated pages
    come out as often as they come in; passages shorter than ``leak_words`` can't leak.
    """
    rows = items.where("item_id is not null and passage is not null").select("item_id", "passage").limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} passages; call with parts of the test set")
    passages = documents.sparkSession.sparkContext.broadcast([(r["item_id"], r["passage"]) for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = finder_of(passages.value, leak_words)
        for b in batches:
            out: list[tuple] = []
            for i, t, x, y in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), ints(b["x0"]), ints(b["y0"])):
                out += [(i, *r) for r in finder.scan(t, x, y)]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                names=["doc_id", "item_id", "n_words", "start_pos", "end_pos"],
            )

    return pages(documents).mapInArrow(run, "doc_id long, item_id long, n_words int, start_pos long, end_pos long")


def pages(documents: DataFrame) -> DataFrame:
    """What reading order needs of ``documents``: two numbers of each line's box."""
    return documents.where("text is not null and text <> ''").select("doc_id", "text", F.col("lines.x0").alias("x0"), F.col("lines.y0").alias("y0"))


def ints(column: pa.Array) -> list[np.ndarray | None]:
    """Lists of integers as arrays, null lists (and lists with nulls) as None."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    if column.values.null_count:
        return [None if x is None or None in x else np.array(x) for x in column.to_pylist()]
    return [values[a:z] if v else None for a, z, v in zip(offsets[:-1], offsets[1:], valid)]
