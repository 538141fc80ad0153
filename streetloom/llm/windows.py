"""Removing repeated runs of words: a count-min prefilter, then exact grouping of what it lets through.

A window is ``width`` consecutive words. First pass: each block of documents
sketches its windows' hashes; merged sketches overestimate how often each
occurs, so a window estimated once is unique. Second pass: windows estimated
repeated are grouped by 128 bits, two independent hashes of their words, to find the
first document of each. Third pass: a word goes if a window that covers it starts in a
smaller doc_id too.

Null or empty texts have no words. A null doc_id counts as smaller than all
others; rows that share a doc_id don't cover one another, so all of them keep
their words. Other columns are ignored, whatever they are called. A document is never
cut: a worker holds about thirty times the bytes of its longest text.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import Sketch, answers, blocked, dealt, earlier_elsewhere, entries_of, heads, key_set, ordered, pieces, repeated_keys, with_answers
from .shared import U64, range_hashes, run_hashes, table, words

#: Counters of the sketch: rows.
DEPTH = 2
#: Fewest bytes that a word and the space after it take on average; only the width of the sketch depends on it.
WORD_BYTES = 5
#: Entries that an owner groups at a time, about.
OWNER_KEYS = 2_000_000


class _Windows:
    """A piece's windows: first word and document of each, and hashes by seed."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        self.data, self.width = data, width
        self.start, self.end, self.doc = words(data, offsets)
        some = len(self.doc) >= width
        self.first = np.flatnonzero(self.doc[: len(self.doc) - width + 1] == self.doc[width - 1 :]) if some else np.zeros(0, np.int64)

    def hashes(self, seed: int) -> np.ndarray:
        return run_hashes(range_hashes(self.data, self.start, self.end, seed), self.width)[self.first] if len(self.first) else np.zeros(0, U64)


def dedup_windows(docs: DataFrame, width: int = 13, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space, UTF-8 bytes) of each document."""
    blocks, total = blocked(docs, text)
    sketch = Sketch(total // WORD_BYTES, DEPTH)
    owners = max(1, total // WORD_BYTES // OWNER_KEYS)

    def keys_of(t: pa.Table) -> np.ndarray:
        return np.concatenate([np.zeros(0, U64), *(_Windows(data, offsets, width).hashes(1) for data, offsets, _, _ in pieces(t))])

    def candidates(t: pa.Table, replies: pa.Table) -> pa.Table:
        """The windows estimated repeated: of each, the smallest doc_id in this block and the window's place there."""
        flagged = answers(replies)
        parts, before = [], 0
        for data, offsets, ids, _ in pieces(ordered(t)):
            w = _Windows(data, offsets, width)
            a = w.hashes(1)
            at = np.flatnonzero(sketch.repeated(a, flagged))
            if len(at):
                parts.append((a[at], w.hashes(2)[at], ids[w.doc[w.first[at]]], at + before))
            before += len(a)
        if not parts:
            return pa.table({"owner": pa.array([], pa.int32()), "block": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
        a, b, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, b, a))  # places follow doc_ids
        order = order[heads(a[order], b[order])]
        sent = list(dealt(entries_of(a[order], b[order], doc[order], at[order]), t.column("block")[0].as_py(), owners))
        return pa.table({n: pa.array(c, y) for n, c, y in zip(("owner", "block", "blob"), zip(*sent, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)})

    def remove(t: pa.Table, replies: pa.Table) -> pa.Table:
        t = ordered(t)
        held = [(data, offsets, ids, _Windows(data, offsets, width)) for data, offsets, ids, _ in pieces(t)]
        late = _late(held, key_set(replies).astype(np.int64))
        n_words, n_removed, kept, at = [], [], [], 0
        for data, offsets, _, w in held:
            bad = w.first[late[at : at + len(w.first)]]
            at += len(w.first)
            cover = np.zeros(len(w.doc) + 1, np.int32)
            cover[bad] += 1
            cover[bad + width] -= 1
            keep = np.cumsum(cover[:-1]) == 0
            cuts = np.searchsorted(w.doc, np.arange(len(offsets)))
            raw = data.tobytes()
            for k in range(len(offsets) - 1):
                mine = keep[cuts[k] : cuts[k + 1]]
                left = raw[offsets[k] : offsets[k + 1]].split()
                n_words.append(len(left))
                n_removed.append(len(mine) - int(mine.sum()))
                kept.append(b" ".join(compress(left, mine.tolist()) if n_removed[-1] else left))
        ids = pa.compute.if_else(t.column("has_id"), t.column("doc_id"), pa.scalar(None, pa.int64()))
        return pa.table({"doc_id": ids, "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.binary())})

    flags = repeated_keys(blocks, keys_of, sketch)
    sent = with_answers(blocks, flags, candidates, "owner int, block int, blob binary")
    return with_answers(blocks, earlier_elsewhere(sent), remove, "doc_id long, n_words long, n_removed long, kept binary")


def _late(held: list, told: np.ndarray) -> np.ndarray:
    """Which of a block's windows start in a smaller doc_id too: in this block, or as the owners told of the first window of a group."""
    a = np.concatenate([np.zeros(0, U64), *(w.hashes(1) for _, _, _, w in held)])
    docs = np.concatenate([np.zeros(0, np.int64), *(ids[w.doc[w.first]] for _, _, ids, w in held)])
    late = np.zeros(len(a), bool)
    late[told] = True
    order = np.argsort(a, kind="stable")
    again = ~heads(a[order])
    again[:-1] |= again[1:]
    at = np.sort(order[again])
    if len(at):
        b = np.concatenate([w.hashes(2) for _, _, _, w in held])[at]
        order = np.lexsort((at, b, a[at]))
        at, new = at[order], heads(a[at][order], b[order])
        lead = at[np.flatnonzero(new)[np.cumsum(new) - 1]]  # has the smallest doc_id
        late[at] = late[lead] | (docs[at] != docs[lead])
    return late


def op9_window_dedup(spark, sf_dir: str) -> DataFrame:
    """Remove the words that 13-word windows of smaller doc_ids cover; see the module for nulls, ties and repeated rows."""
    got = dedup_windows(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
