"""Substring dedup by level-wise doubling: windows of words that repeat are removed, all copies of them.

``repeats`` brings together the slices of text that can share a window; here their
windows climb the levels, from single words on: a window is looked at with twice the
length only if it repeats at the shorter one, and so do both of its halves; the climb
ends at the asked length or when no candidate survives.  Words are numbered by their
bytes and windows by the numbers of their halves, so a class holds equal words, not
equal hashes.

Defined results: null and empty texts have no words; texts shorter than the window
stay whole; words are compared as they are; equal rows (same doc_id and text) are
one document, whose windows count once; rows that share an id but not the text are
different documents.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame

from lexloom.llm.common import words_of
from lexloom.llm.repeats import Spec, repeated_windows

WINDOW = 35

_seen: dict[bytes, int] = {}


def word_hashes(text: str | None) -> np.ndarray:
    if len(_seen) > 500_000:
        _seen.clear()
    out = []
    for w in words_of(text):
        h = _seen.get(w)
        if h is None:
            h = _seen[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def word_cutter(text: str | None):
    words = words_of(text)
    return lambda lo, hi: b" ".join(words[lo:hi])


def level_lengths(n: int) -> list[int]:
    """1, then at most twice the length before, up to n."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out[::-1]


def doubling(words: np.ndarray, room: np.ndarray, weight: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, class) of the windows of lengths[-1] words that repeat.

    ``words`` are numbers from 0, ``room`` the words left in the slice from each place on, ``weight`` the copies of the slice.
    """
    live, ids = np.arange(len(words)), words
    for shorter, longer in zip([0, *lengths], lengths):
        if shorter:
            number = np.full(len(words), -1, np.int64)
            number[live] = ids
            live = live[room[live] >= longer]
            live = live[number[live + longer - shorter] >= 0]
            ids = number[live] * (ids.max(initial=0) + 1) + number[live + longer - shorter]
        ids = pd.factorize(ids)[0].astype(np.int64)
        again = np.bincount(ids, weights=weight[live])[ids] >= 2 if len(live) else np.zeros(0, bool)
        live, ids = live[again], ids[again]
        if not len(live):
            break
    return live, ids


def compare_levels(r, texts, n, combine):
    """The method as a ``judge`` of slices (see ``repeats.Spec``)."""
    # Words are numbered by their bytes, once for equal texts.
    distinct: dict[bytes, int] = {}
    of_text = np.fromiter((distinct.setdefault(t, len(distinct)) for t in texts), np.int64, len(texts))
    split = [t.split(b" ") for t in distinct]
    numbers = pd.factorize(np.array([w for row in split for w in row], dtype=object))[0].astype(np.int64)
    size = np.fromiter(map(len, split), np.int64, len(split))
    begin = (np.cumsum(size) - size)[of_text]
    size = size[of_text]
    own = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    place = np.arange(len(own)) - first[own]
    words = numbers[begin[own] + place]
    starts, of = doubling(words, size[own] - place, r["weight"][own], level_lengths(n))
    label = _wholes(size, first, starts, of, n) if combine else None
    starts = starts[r["weight"][own[starts]] == 1]  # copies met before were removed there
    which, at = own[starts], place[starts]
    new = np.flatnonzero(np.concatenate(([True], (which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)))) if len(which) else np.zeros(0, np.int64)
    end = np.concatenate((new[1:], [len(which)])) - 1 if len(new) else new
    return (which[new], at[new], at[end]), label


def _wholes(size, first, starts, of, n) -> np.ndarray:
    """A number per slice that equal slices share: they have one length and the classes of their first and last window."""
    number_of = np.full(int(size.sum()), -1, np.int64)
    number_of[starts] = of
    head, tail = number_of[first], number_of[first + size - n]
    alone = np.where((head < 0) | (tail < 0), np.arange(len(size)), -1)
    move = np.lexsort((alone, tail, head, size))
    change = np.zeros(len(move), bool)
    for c in (alone, tail, head, size):
        change[1:] |= c[move][1:] != c[move][:-1]
    label = np.empty(len(move), np.int64)
    label[move] = np.cumsum(change)
    return label


def _finish(text, starts, ends):
    words = words_of(text)
    gone = int((ends - starts).sum())
    if gone:
        keep, at = [], 0
        for a, b in zip(starts.tolist(), ends.tolist()):
            keep += words[at:a]
            at = b
        words_kept = keep + words[at:]
    else:
        words_kept = words
    return len(words), gone, words_kept


def substring_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per document row."""

    def finish(text, starts, ends):
        n, gone, kept = _finish(text, starts, ends)
        return n, gone, hashlib.sha256(b" ".join(kept)).hexdigest()

    return _repeats(docs, window, finish, "n_words long, n_removed long, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, text and the columns of ``carry``, per document row.

    The text stays itself where nothing goes, else it is the kept words joined by one space; null stays null.
    """

    def finish(text, starts, ends):
        n, gone, kept = _finish(text, starts, ends)
        return n, gone, b" ".join(kept).decode("utf-8", "surrogatepass") if gone else text

    return _repeats(docs, window, finish, "n_words long, n_removed long, text string", carry)


def _repeats(docs, window, finish, schema, carry=()):
    gram = max(1, -(-window // 4))
    return repeated_windows(docs, Spec(window, gram, word_hashes, word_cutter, compare_levels), finish, schema, carry)
