"""Secrets in texts, and who owns them.

Base kinds are fixed patterns. Beyond them every long run of key-like
characters that mixes letters and digits at high entropy is a candidate. All
candidates' hashes are counted by distinct owners and repositories (an owner's
distinct texts) over the whole corpus: what several owners hold is a widely
copied example, what one owner holds, in however many repositories, looks like
a live credential. Candidates of the second sort become spans of the kind
``owned``.

Null and empty texts hold nothing; a null owner counts as one more owner;
repeated rows are reported each and make one repository. Offsets are code points. A text is scanned as a
whole, however long. Other columns are passed on as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches, blank, prepare, table, text_buffer, written

KINDS = ("assign", "access", "hex", "owned")
#: Fixed patterns and least lengths: an assignment (its value), an access key id, a hexadecimal run.
ASSIGN, ASSIGN_LENGTH = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 12
ACCESS, ACCESS_LENGTH = re.compile(r"AKIA[A-Z0-9]+"), 18
HEX, HEX_LENGTH = re.compile(r"[0-9a-f]+"), 16
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: A candidate beyond the base kinds: length, and bits of entropy a character.
WIDE_LENGTH, WIDE_BITS = 20, 3.5
WIDE = re.compile(rf"[A-Za-z0-9+/_=-]{{{WIDE_LENGTH},}}")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[b for b in range(128) if re.fullmatch(chars, chr(b))]] = True
    return out


IN_HEX, IN_WIDE = _class("[0-9a-f]"), _class("[A-Za-z0-9+/_=-]")


def entropy(s: str) -> float:
    return -sum(s.count(c) / len(s) * log2(s.count(c) / len(s)) for c in set(s))


def _runs(data: np.ndarray, inside: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of at least so many bytes of a class; a run may cross documents, a superset of those within."""
    m = np.zeros(len(data) + 2, np.int8)
    m[1:-1] = inside[data]
    edge = np.diff(m)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return start[end - start >= least], end[end - start >= least]


def _likely(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents may hold a match: a vectorised search that misses none."""
    out = np.zeros(len(offsets), bool)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    for inside, least in ((IN_HEX, HEX_LENGTH), (IN_WIDE, WIDE_LENGTH)):
        start, end = _runs(data, inside, least)
        if inside is IN_WIDE:  # such a candidate has a digit
            some = digits[end] > digits[start]
            start, end = start[some], end[some]
        first, last = (np.searchsorted(offsets, x, "right") - 1 for x in (start, end - 1))
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            out[a : b + 1] = True
    raw = data.tobytes()
    low = raw.lower()
    for where, word in ((raw, b"AKIA"), *((low, w) for w in KEYWORDS)):
        at = where.find(word)
        while at >= 0:
            k = int(np.searchsorted(offsets, at, "right")) - 1
            out[k] = True
            at = where.find(word, int(offsets[k + 1]))  # one is enough
    return out[:-1]


def scan(text: str) -> list[tuple[int, int, int, int, str]]:
    """(start, kind, end, value's start, value) of the base matches, by start and kind, and of the other candidates."""
    base = [(m.start(), 0, m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LENGTH]
    base += [(m.start(), 1, m.end(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LENGTH]
    base += [(m.start(), 2, m.end(), m.group()) for m in HEX.finditer(text) if len(m.group()) >= HEX_LENGTH]
    base.sort()
    taken, end = [], -1
    for s, _, e, _ in base:
        if s < end:
            taken[-1] = (taken[-1][0], max(e, end))
        else:
            taken.append((s, e))
        end = taken[-1][1]
    at = 0
    for m in WIDE.finditer(text):
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        v = m.group()
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= WIDE_BITS:
            base.append((m.start(), 3, m.end(), v))
    return base


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64())])


#: Pieces that the rows of one value are dealt in where they meet its counts, so that a value in a third of all documents isn't one task's.
PIECES = 128


def ownership(values: DataFrame) -> DataFrame:
    """(hash, owners, repos) of values (owner, repo, hash): how many distinct owners hold a value, and in how many distinct repositories.

    A repository is one owner's text, so copies of it count once. Repositories are made distinct first, which
    spreads a value that many hold, and counted by owner before values meet; each step combines before it shuffles.
    """
    repos = values.select("hash", "owner", "repo").distinct()
    held = repos.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repos"))


def find_secrets(docs: DataFrame, owner: str = "source", id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, base (spans of base kinds), spans (all), and of the candidates: live and copied, how many there are of each.

    A span is (start, kind, end, hash of the value, owners, repos), the last two as ownership() counts them; a candidate with one owner is live.
    """
    prepare(docs.sparkSession)
    source = docs.select(F.col(id).alias("id"), F.xxhash64(owner).alias("owner"), F.xxhash64(blank(text)).alias("repo"), blank(text).alias("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4 << 20):
            col = b.column(3)
            data, offsets = text_buffer(col)
            spans: list[list] = [[]] * b.num_rows
            for k in np.flatnonzero(_likely(data, offsets)).tolist():
                spans[k] = [{"start": s, "kind": kind, "end": e, "hash": xxhash.xxh64_intdigest(v.encode()) - 2**63} for s, kind, e, v in scan(col[k].as_py())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(spans, pa.list_(SPAN))], ["id", "owner", "repo", "found"])

    span = "struct<start long, kind int, end long, hash long>"
    scanned = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, owner long, repo long, found array<{span}>")
    scanned = written(scanned.withColumn("row", F.monotonically_increasing_id()), "scanned")
    found = scanned.select("row", "owner", "repo", F.inline("found")).withColumn("piece", F.pmod(F.xxhash64("row"), F.lit(PIECES)))
    # a value's counts go to those of its pieces that exist: one for most values, PIECES for one that everybody holds
    counts = found.select("hash", "piece").distinct().join(ownership(found), "hash")
    met = found.join(written(counts, "ownership"), ["hash", "piece"])
    spans = met.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "hash", "owners", "repos"))).alias("all"))
    none = F.array().cast(spans.schema["all"].dataType)
    got = scanned.select("row", "id").join(spans, "row", "left").withColumn("all", F.coalesce("all", none))
    return got.select(
        "id",
        F.filter("all", lambda s: s["kind"] < 3).alias("base"),
        F.filter("all", lambda s: (s["kind"] < 3) | (s["owners"] == 1)).alias("spans"),
        F.size(F.filter("all", lambda s: s["owners"] == 1)).cast("long").alias("live"),
        F.size(F.filter("all", lambda s: s["owners"] > 1)).cast("long").alias("copied"),
        F.coalesce(F.array_max(F.transform("all", lambda s: s["owners"])), F.lit(0)).cast("long").alias("owners"),
        F.coalesce(F.array_max(F.transform("all", lambda s: s["repos"])), F.lit(0)).cast("long").alias("repos"),
    )


def named(spans: str):
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def cleaned(text: str, spans) -> str:
    """A text with each span (start, kind, end) replaced by its kind in brackets; one that overlaps the span before only moves its end."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, owner: str = "source", text: str = "text") -> DataFrame:
    """docs with every secret of find_secrets replaced by its kind in brackets; texts without any stay as they are, null ones too.

    Texts with base kinds only are settled where they are read; only those with other candidates meet the owners' counts.
    """
    prepare(docs.sparkSession)
    names, at = docs.columns, docs.columns.index(text)
    source = docs.select(*names, F.xxhash64(owner).alias("__owner"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 4 << 20, text):
            col = b.column(at)
            data, offsets = text_buffer(col.fill_null(""))
            values, spans, clean = [None] * b.num_rows, [None] * b.num_rows, {}
            for k in np.flatnonzero(_likely(data, offsets)).tolist():
                x = col[k].as_py()
                if found := scan(x):
                    marks = [(s, kind, e, xxhash.xxh64_intdigest(v.encode()) - 2**63) for s, kind, e, v in found]
                    values[k] = sorted({h for _, _, _, h in marks})
                    if any(kind == 3 for _, kind, _, _ in marks):
                        spans[k] = [dict(zip(("start", "kind", "end", "hash"), m, strict=True)) for m in marks]
                    else:
                        clean[k] = cleaned(x, [m[:3] for m in marks])
            if clean:
                col = pa.array([clean.get(k, x) for k, x in enumerate(col.to_pylist())], col.type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], col, *b.columns[at + 1 :], pa.array(values, pa.list_(pa.int64())), pa.array(spans, pa.list_(SPAN))], [*names, "__owner", "__values", "__spans"])

    extra = T.StructType.fromDDL("__values array<long>, __spans array<struct<start long, kind int, end long, hash long>>")
    scanned = written(source.mapInArrow(run, T.StructType([*source.schema.fields, *extra.fields])), "redacted")
    owned = scanned.filter("__values IS NOT NULL").select("__owner", F.explode("__values").alias("hash")).groupBy("hash").agg(F.min("__owner").alias("least"), F.max("__owner").alias("most"))
    open_ = written(scanned.filter("__spans IS NOT NULL").withColumn("__row", F.monotonically_increasing_id()), "candidates")
    asked = open_.select("__row", F.explode(F.array_distinct(F.filter("__spans", lambda s: s["kind"] == 3)["hash"])).alias("hash"))
    live = asked.join(owned.filter("least = most").select("hash"), "hash").groupBy("__row").agg(F.collect_set("hash").alias("__live"))
    some = open_.join(live, "__row", "left").select(*names, "__spans", "__live")

    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for x, spans, live in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (text, "__spans", "__live")), strict=True):
                live = set(live or ())
                out.append(cleaned(x, [(s["start"], s["kind"], s["end"]) for s in spans if s["kind"] < 3 or s["hash"] in live]))
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, b.column(at).type), *b.columns[at + 1 : len(names)]], names)

    return scanned.filter("__spans IS NULL").select(*names).unionByName(some.mapInArrow(settle, docs.schema))


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, with the owner-specific candidates among the spans; see the module for nulls and repeated rows."""
    got = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return got.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(named("base").cast("binary"), 256).alias("base_sha256"), named("spans").alias("spans"), F.col("live").alias("n_live"), F.col("copied").alias("n_copied"), F.col("owners").alias("max_owners"), F.col("repos").alias("max_repositories"))
