"""Removing repeated byte strings by prefix-free parsing.

A rolling hash over TRIGGER bytes picks a trigger in every string of ``width``
bytes: its smallest hash, leftmost on a tie. Triggers cut each document into
phrases that overlap by width - 1 bytes; every string of width bytes lies in
exactly one phrase, and equal strings hold the same trigger at the same place.
So a phrase whose trigger is unique in the corpus holds no repeat at all, and a
phrase that stands earlier as a whole repeats in all its strings. What is left
is the dictionary: the first occurrence of each distinct phrase with a repeated
trigger. Strings of a phrase that hold the trigger at nearly the same place share a
core of most of their bytes; only where other phrases have that core too can they
repeat. Each block sorts these suffixes of its part of the dictionary (prefix
doubling up to width bytes), so that equal strings are neighbours; the parse
gives their order in the corpus; and the groups of all blocks are combined by
128 bits, two independent hashes, of their first width bytes. Merging
the arrays themselves would need ranges of suffixes, and a passage that a third
of all documents share would fall into one range.

Null or empty texts have no bytes. A null doc_id counts as smaller than all
others. Rows that share a doc_id count as one document: a string at a smaller
start in any of them is earlier, equal starts are not. Other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ANSWER_SQL, Sketch, answers, blocked, dealt, earlier_elsewhere, entries_of, heads, key_set, merged, ordered, pieces, repeated_keys, with_answers
from .shared import ByteHashes, U64, dropped, mix, table, written

#: Bytes of a trigger. Shorter ones recur more often in unrelated text; longer ones lie further apart.
TRIGGER = ByteHashes.SPAN
#: The position's bits in a key of the sliding minimum.
PLACE = 30
OWNER_KEYS = 2_000_000
#: Rows of the sketches, and places of a trigger that one core stands for.
DEPTH, GROUP = 2, 18
#: Bytes of text in a block, on average; sorting suffixes takes about a hundred bytes of memory for each.
BLOCK_BYTES = 5 << 20
ROWS = "kind int, owner long, block int, blob binary, counts binary"


def _freeze(state) -> bytes:
    return zstandard.ZstdCompressor(1).compress(pickle.dumps(state, protocol=5))


def _thaw(blob: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def _rows(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("kind", "owner", "block", "blob", "counts"), cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)})


def _heads(t: pa.Table) -> np.ndarray:
    """Which rows of an ordered block differ from the row before; the others lose what that one loses."""
    ids, texts = t.column("doc_id").to_numpy(), t.column("text")
    head = np.ones(len(ids), bool)
    for k in np.flatnonzero(ids[1:] == ids[:-1]).tolist():
        head[k + 1] = texts[k].as_py() != texts[k + 1].as_py()
    return head


def phrases(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[ByteHashes, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the data, then for each phrase: trigger's place, first and last start of its strings)."""
    n = len(data)
    hashes = ByteHashes(data)
    if n < width:
        z = np.zeros(0, np.int64)
        return hashes, z, z, z
    low = hashes.spans >> U64(PLACE) << U64(PLACE)
    low |= np.arange(len(low), dtype=U64)
    span, have = width - TRIGGER + 1, 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    place = (low & U64((1 << PLACE) - 1)).astype(np.int64)
    inside = np.zeros(n - width + 1, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= width:
            inside[a : b - width + 1] = True
    starts = np.flatnonzero(inside)
    place = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = place[1:] != place[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return hashes, place[first], starts[first], starts[last]


def core_hashes(hashes: ByteHashes, place: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, which count) of what the strings of a phrase share, by groups of GROUP places of the trigger within them.

    low and high are the least and greatest place; [phrase, group] each.
    """
    span = width - TRIGGER
    groups = np.arange(0, span + 1, GROUP)
    there = (low[:, None] <= groups + GROUP - 1) & (high[:, None] >= groups)
    start = np.where(there, place[:, None] - groups, 0)
    end = np.where(there, place[:, None] + TRIGGER + np.maximum(0, span - groups - GROUP + 1), 0)
    return mix(hashes.of(start.ravel(), end.ravel()).reshape(start.shape) + groups.astype(U64), 21), there


def merged_spans(row: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of bytes, those of a row that touch made one, by row and start."""
    a, z = (row.astype(np.int64) << 40) + at, (row.astype(np.int64) << 40) + end
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order]) if len(order) else z
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > z[:-1]
    first = np.flatnonzero(new)
    low = (1 << 40) - 1
    return a[first] >> 40, a[first] & low, z[np.append(first[1:], len(a)) - 1] & low if len(a) else z


def suffix_ranks(data: np.ndarray, width: int) -> np.ndarray:
    """For each place with width bytes from there on: the rank of those bytes, by prefix doubling."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    rank, have = data.astype(U64), 1
    while have * 2 <= 8:  # up to eight bytes fit a number
        rank = rank[:-have] << U64(8 * have) | rank[have:]
        have *= 2
    while have < width:
        rank = np.unique(rank, return_inverse=True)[1].astype(U64)
        step = min(have, width - have)
        rank = rank[:-step] << U64(32) | rank[step:]
        have += step
    return np.unique(rank[:n], return_inverse=True)[1]


def dedup_substrings(docs: DataFrame, width: int = 100, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of each document."""
    if width < TRIGGER:
        raise ValueError(f"width must be {TRIGGER} or more")
    blocks, total = blocked(docs, text, BLOCK_BYTES)
    sketch = Sketch(total // 24, DEPTH)
    owners = max(1, total // 50 // OWNER_KEYS)

    def triggers(t: pa.Table) -> np.ndarray:
        out = [np.zeros(0, U64)]
        for data, offsets, _, _ in pieces(t):
            hashes, place, _, _ = phrases(data, offsets, width)
            out.append(hashes.spans[place])
        return np.concatenate(out)

    def parse(t: pa.Table, replies: pa.Table) -> pa.Table:
        """Phrases with repeated triggers: their hashes for the owners, and all about them for this block."""
        block, flagged = t.column("block")[0].as_py(), answers(replies)
        found, held = [], []
        t = ordered(t)
        for data, offsets, ids, row in pieces(t.filter(pa.array(_heads(t)))):
            hashes, place, first, last = phrases(data, offsets, width)
            trigger = hashes.spans[place]
            at = np.flatnonzero(sketch.repeated(trigger, flagged))
            if not len(at):
                continue
            trigger, first, end = trigger[at], first[at], last[at] + width
            doc = np.searchsorted(offsets, first, "right") - 1
            a, b = hashes.of(first, end), ByteHashes(data, 1).of(first, end)
            found.append((a, b, ids[doc], doc + row, first - offsets[doc], end - first, place[at] - first, first, np.full(len(at), len(held))))
            held.append(data)
        if not found:
            return _rows([])
        a, b, ids, row, at, size, trigger, start, piece = (np.concatenate(c) for c in zip(*found, strict=True))
        # of the phrases that stand several times in this block, the first may be first in the corpus
        order = np.lexsort((at, ids, b, a))
        head = heads(a[order], b[order])
        lead = order[head][np.cumsum(head) - 1]
        late = np.zeros(len(order), bool)
        late[order] = (ids[order] != ids[lead]) | (at[order] != at[lead])
        mine = np.flatnonzero(~late)
        mine = mine[np.lexsort((at[mine], row[mine]))]
        state = {"gone": merged_spans(row[late], at[late], at[late] + size[late]), "row": row[mine].astype(np.int32), "at": at[mine], "size": size[mine].astype(np.int32), "trigger": trigger[mine].astype(np.int16 if width < 1 << 14 else np.int32), "doc": ids[mine]}
        state["texts"] = [held[p][x : x + n].tobytes() for p, x, n in zip(piece[mine].tolist(), start[mine].tolist(), size[mine].tolist(), strict=True)]
        # a key may stand several times in a document; the owner hears of it once
        place = np.empty(len(order), np.int64)
        place[mine] = np.arange(len(mine))
        once = order[head]
        return _rows([(0, owner, block, blob, None) for owner, _, blob in dealt(entries_of(a[once], b[once], ids[once], place[once]), block, owners)] + [(1, 0, block, _freeze(state), None)])

    def cores(s: dict):
        """(hashes of the strings' data, start of each phrase in it, cores, which count) of a state's phrases."""
        data = np.frombuffer(b"".join(s["texts"]), np.uint8)
        start = np.cumsum(s["size"], dtype=np.int64) - s["size"]
        trigger = s["trigger"].astype(np.int64)
        hashes = ByteHashes(data)
        # the trigger's place in the phrase's first string is its greatest
        return start, *core_hashes(hashes, start + trigger, trigger - (s["size"] - width), trigger, width)

    def dictionary(t: pa.Table, replies: pa.Table) -> pa.Table:
        """First occurrences of phrases: a sketch of their cores; what is known to go already."""
        block, s = t.column("block")[0].as_py(), _thaw(t.column("blob")[0].as_py())
        late = np.zeros(len(s["row"]), bool)
        late[key_set(replies).astype(np.int64)] = True
        row, at, end = s.pop("gone")
        mine = ~late
        state = {"gone": merged_spans(np.append(row, s["row"][late]), np.append(at, s["at"][late]), np.append(end, s["at"][late] + s["size"][late]))}
        state |= {k: s[k][mine] for k in ("row", "at", "size", "trigger", "doc")} | {"texts": [x for x, z in zip(s["texts"], late.tolist(), strict=True) if not z]}
        _, keys, there = cores(state)
        return _rows([(0, owner, block, blob, counts) for owner, _, blob, counts in sketch.sparse(keys[there], block)] + [(1, 0, block, _freeze(state), None)])

    def suffixes(t: pa.Table, replies: pa.Table) -> pa.Table:
        """Sort those suffixes of the dictionary whose cores other phrases hold too; send one entry a group."""
        block, s = t.column("block")[0].as_py(), _thaw(t.column("blob")[0].as_py())
        start, keys, there = cores(s)
        there[there] = sketch.repeated(keys[there], answers(replies))
        phrase, group = np.nonzero(there)
        trigger, size = s["trigger"].astype(np.int64)[phrase], s["size"].astype(np.int64)[phrase]
        # a string at the phrase's place k has the trigger at its place trigger - k
        first = np.maximum(0, trigger - (group + 1) * GROUP + 1)
        last = np.minimum(size - width, trigger - group * GROUP)
        n = last - first + 1
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        phrase = np.repeat(phrase, n)
        if not len(k):
            return _rows([(1, 0, block, _freeze({"gone": s["gone"]}), None)])
        # only phrases with such strings are sorted
        used = np.unique(phrase)
        data = np.frombuffer(b"".join(s["texts"][i] for i in used.tolist()), np.uint8)
        start = np.zeros(len(s["size"]), np.int64)
        start[used] = np.cumsum(s["size"][used], dtype=np.int64) - s["size"][used]
        starts, rows, ats, docs = start[phrase] + k, s["row"][phrase].astype(np.int64), s["at"][phrase] + k, s["doc"][phrase]
        rank = suffix_ranks(data, width)[starts]
        order = np.lexsort((ats, docs, rank))
        head = heads(rank[order])
        lead = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        late = np.zeros(len(order), bool)
        late[order] = (docs[order] != docs[lead]) | (ats[order] != ats[lead])
        row, at, end = s["gone"]
        gone = merged_spans(np.append(row, rows[late]), np.append(at, ats[late]), np.append(end, ats[late] + width))
        one = order[head]
        a, b = (ByteHashes(data, seed).of(starts[one], starts[one] + width) for seed in (0, 1))
        entries = entries_of(a, b, docs[one], rows[one] << 40 | ats[one])
        return _rows([(0, owner, block, blob, None) for owner, _, blob in dealt(entries, block, owners)] + [(1, 0, block, _freeze({"gone": gone}), None)])

    def remove(t: pa.Table, replies: pa.Table) -> pa.Table:
        t = ordered(t)
        row = at = end = np.zeros(0, np.int64)
        mine = replies.filter(pa.compute.equal(replies.column("kind"), 1))
        if mine.num_rows:
            row, at, end = _thaw(mine.column("blob")[0].as_py())["gone"]
        told = key_set(replies.filter(pa.compute.equal(replies.column("kind"), 0))).astype(np.int64)
        places = told & ((1 << 40) - 1)
        row, at, end = merged_spans(np.append(row, told >> 40), np.append(at, places), np.append(end, places + width))
        like = np.cumsum(_heads(t)) - 1  # spans are of the rows that differ
        cuts = np.searchsorted(row, np.arange(t.num_rows + 1))
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for k, x in enumerate(t.column("text").cast(pa.large_binary()).to_pylist()):
            spans = 0
            n_bytes.append(len(x))
            a, z = cuts[like[k]], cuts[like[k] + 1]
            if z > a:
                cover = np.zeros(len(x) + 1, np.int32)
                np.add.at(cover, at[a:z], 1)
                np.add.at(cover, end[a:z], -1)
                keep = np.cumsum(cover[:-1]) == 0
                spans = int(np.count_nonzero(~keep[1:] & keep[:-1])) + int(not keep[0])
                x = np.frombuffer(x, np.uint8)[keep].tobytes()
            n_spans.append(spans)
            n_removed.append(n_bytes[-1] - len(x))
            kept.append(x)
        ids = pa.compute.if_else(t.column("has_id"), t.column("doc_id"), pa.scalar(None, pa.int64()))
        return pa.table({"doc_id": ids, "n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array(kept, pa.binary())})

    sent = lambda rows: rows.filter("kind = 0").select("owner", "block", "blob")
    states = lambda rows: rows.filter("kind = 1").select("block", "blob")
    parsed = written(with_answers(blocks, repeated_keys(blocks, triggers, sketch), parse, ROWS), "parse")
    firsts = written(with_answers(states(parsed), earlier_elsewhere(sent(parsed)), dictionary, ROWS), "dictionary")
    dropped(parsed)
    shared = firsts.filter("kind = 0").select("owner", "block", "blob", "counts").groupBy("owner").applyInArrow(merged, ANSWER_SQL)
    sorted_ = written(with_answers(states(firsts), shared, suffixes, ROWS), "suffixes")
    dropped(firsts)
    replies = earlier_elsewhere(sent(sorted_)).withColumn("kind", F.lit(0)).unionByName(states(sorted_).withColumn("kind", F.lit(1)))
    return with_answers(blocks, replies, remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Remove every byte that an earlier occurrence of a 100-byte string covers; see the module for nulls, ties and repeated rows."""
    got = dedup_substrings(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
