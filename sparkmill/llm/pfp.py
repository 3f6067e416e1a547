"""Removal of repeated strings by prefix-free parsing.

A rolling hash of GRAM bytes triggers phrases: every 50-byte window has one
trigger, its smallest hash (the leftmost of equals), and the windows that share a
trigger form a phrase, which overlaps the next one by 49 bytes.  Triggers depend
on the window alone, so equal windows of any two documents lie in phrases of
equal trigger.  The dictionary holds each distinct phrase once, with the
smallest document that has it; the parse of a document is its sequence of
phrases.

Only order up to 50 bytes decides a match, and the 49 bytes of overlap carry all
of the following parse that this depth needs.  So corpus order is taken in two
steps.  Dictionary order, (trigger, phrase), settles phrases that occur whole in
a smaller document: all their suffixes are repeats, and the parse carries that to
every occurrence.  Phrases whose trigger also occurs in other phrases are opened:
their suffixes, cut at 50 bytes, are brought into one order and neighbours
compared.  Orders are those of 64-bit hashes of the strings (any total order
groups equal strings), spread over buckets whose number grows with the bytes.

Numbers travel as packed arrays, one row for each batch and destination; a batch
sends each distinct phrase or suffix once, so a string common to very many
documents reaches its bucket once a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import ship, stage

LENGTH, GRAM = 50, 20
REACH = LENGTH - GRAM + 1  # rolling hashes in a window
#: Bytes of text worked on at a time; bytes of the corpus for each bucket and document group.
BATCH, SHARE = 3_000_000, 12_000_000
LEAST_PARTS = 61
#: Bytes of a phrase's hash that are sent beside 32 bits of its trigger's and the bucket.
TAG = 6
ROWS = "to bigint, kind string, blob binary"

_U = np.uint64
_M = [_U(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_BYTE = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _M[0]
    x = (x ^ (x >> _U(29))) * _M[1]
    return x ^ (x >> _U(32))


def parse(buf: np.ndarray, starts: np.ndarray):
    """Phrases of the documents ``buf[starts[i]:starts[i + 1]]``.

    (document, first window, last window, trigger hash, phrase hash), windows by
    their absolute start, and the hash of the window at every start.
    """
    n = len(buf)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(_U), none.astype(_U), none.astype(_U)
    h1 = _BYTE[buf]
    h2 = h1[:-1] * _M[0] + h1[1:]
    h4 = h2[:-2] * _M[1] + h2[2:]
    h8 = h4[:-4] * _M[2] + h4[4:]
    h16 = h8[:-8] * _M[3] + h8[8:]
    tail = {16: None, 20: h4, 24: h8}[GRAM]
    gram = _mix(h16 if tail is None else h16[:n - GRAM + 1] * _M[5] + tail[16:16 + n - GRAM + 1])
    del h1, h4, h8, tail
    h32 = h16[:-16] * _M[4] + h16[16:]
    m = n - LENGTH + 1
    window = _mix((h32[:m] * _M[5] + h16[32:32 + m]) * _M[2] + h2[48:48 + m])
    del h32, h2
    low, at, power = gram, np.arange(len(gram), dtype=np.int32), 1 << (REACH.bit_length() - 1)
    for step in (1 << k for k in range(REACH.bit_length() - 1)):  # smallest of a power of two, the leftmost of equals
        less = low[step:] < low[:-step]
        at = np.where(less, at[step:], at[:-step])
        low = np.where(less, low[step:], low[:-step])
    if rest := REACH - power:
        at = np.where(low[rest:] < low[:-rest], at[rest:], at[:-rest])
    doc = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    fit = np.flatnonzero(doc[:m] == doc[LENGTH - 1:])  # windows inside one document
    if not len(fit):
        return none, none, none, none.astype(_U), none.astype(_U), window
    trigger = at[fit]
    new = np.flatnonzero(np.r_[True, (np.diff(fit) != 1) | (np.diff(trigger) != 0)])
    first, last = fit[new], fit[np.r_[new[1:] - 1, len(fit) - 1]]
    phrase = _mix(window[first] * _M[3] + window[last] * _M[4] + (last - first).astype(_U))
    return doc[first].astype(np.int64), first, last, gram[trigger[new]], phrase, window


def _key(ids: np.ndarray, *hashes: np.ndarray) -> np.ndarray:
    """One number for (document, hashes)."""
    out = _mix(ids.astype(np.int64).view(_U) * _M[5] + _U(1))
    for h in hashes:
        out = _mix(out * _M[2] + h)
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays behind their number of bytes, compressed together."""
    parts = [a.tobytes() if isinstance(a, np.ndarray) else a for a in arrays]
    head = np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unpack(blob: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    k = int(np.frombuffer(raw[:8], np.int64)[0])
    at, out = 8 + 8 * k, []
    for n in np.frombuffer(raw[8:8 + 8 * k], np.int64):
        out.append(raw[at:at + int(n)])
        at += int(n)
    return out


def _keyed(h: np.ndarray, tag: np.ndarray, ids: np.ndarray, width: int):
    """What a packed row of (32-bit hash, ``width`` bytes of tag, id) holds: sorted by id, ids as differences."""
    order = np.argsort(ids, kind="stable")
    tags = np.ascontiguousarray(tag[order].view(np.uint8).reshape(-1, 8)[:, :width])
    return _pack(h[order] if len(h) else h, tags, np.diff(ids[order], prepend=0))


def _entries(blobs, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, tag, ids = [np.zeros(0, np.uint32)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
    for b in blobs:
        x, y, z = _unpack(b)
        wide = np.zeros((len(z) // 8, 8), np.uint8)
        wide[:, :width] = np.frombuffer(y, np.uint8).reshape(-1, width)
        h.append(np.frombuffer(x, np.uint32))
        tag.append(wide.view(_U)[:, 0])
        ids.append(np.cumsum(np.frombuffer(z, np.int64)))
    return np.concatenate(h).astype(_U), np.concatenate(tag), np.concatenate(ids)


def _split(to: np.ndarray):
    """(destination, positions) of each destination."""
    order = np.argsort(to, kind="stable")
    ends = np.flatnonzero(np.r_[np.diff(to[order]) != 0, True]) + 1 if len(to) else []
    at = 0
    for e in ends:
        yield int(to[order[at]]), order[at:e]
        at = e


def _batches(documents, limit: int = BATCH):
    """(ids, buffer, starts) of about ``limit`` bytes; a longer document is a batch of its own."""
    some, size = [], 0
    for i, t in documents:
        raw = t if isinstance(t, (bytes, memoryview)) else (t or "").encode()
        if some and size + len(raw) > limit:
            yield _joined(some)
            some, size = [], 0
        some.append((i, raw))
        size += len(raw)
    if some:
        yield _joined(some)


def _joined(some):
    return (np.array([i for i, _ in some], dtype=np.int64), np.frombuffer(b"".join(r for _, r in some), dtype=np.uint8),
            np.cumsum([0, *(len(r) for _, r in some)]))


def _rows(out) -> pa.RecordBatch:
    to, kind, blob = zip(*out, strict=True) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(kind, pa.string()), pa.array(blob, pa.binary())], ["to", "kind", "blob"])


def _frame(out) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["to", "kind", "blob"])


def _smallest(h: np.ndarray, tag: np.ndarray, ids: np.ndarray):
    """Order by (h, tag, id), and which entries of it are the first of their (h, tag)."""
    order = np.lexsort((ids, tag, h))
    first = np.r_[True, (np.diff(h[order]) != 0) | (np.diff(tag[order]) != 0)] if len(h) else np.zeros(0, bool)
    return order, first


def _documents(blobs):
    """Batches of the documents in packed rows."""
    def each():
        for b in blobs:
            ids, sizes, raw = _unpack(b)
            at = np.cumsum([0, *np.frombuffer(sizes, np.int64)]).tolist()
            for k, i in enumerate(np.frombuffer(ids, np.int64).tolist()):
                yield i, raw[at[k]:at[k + 1]]

    yield from _batches(each())


def _known(keys: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """Which keys are among the found ones."""
    if not found:
        return np.zeros(len(keys), bool)
    pool = np.unique(np.concatenate(found))
    at = np.minimum(np.searchsorted(pool, keys), len(pool) - 1)
    return pool[at] == keys if len(pool) else np.zeros(len(keys), bool)


def repeats(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """(doc_id, n_bytes, spans, kept_sha256) of (doc_id, text) rows.

    ``spans`` are the maximal runs of bytes covered by LENGTH-byte strings that also
    start in a document of smaller doc_id.  A null text is empty; texts shorter
    than LENGTH have no spans.  Null ids come after all others, ordered by their
    text's hash.  Rows of equal doc_id do not repeat each other.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = dict(docs.dtypes)["doc_id"]
    base = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.pmod(F.xxhash64("text"), F.lit(2**61)) + F.lit(2**62)).alias("id"), "text")
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(LEAST_PARTS, int(total // share) | 1)
    while any(parts % d == 0 for d in range(3, int(parts ** 0.5) + 1, 2)):  # a prime: ids in steps spread evenly
        parts += 2

    def first_pass(local: bool):
        def run(batches):
            for b in batches:
                out = []
                for ids, buf, starts in _batches(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    doc, _, _, h, p, _ = parse(buf, starts)
                    order, first = _smallest(h, p, ids[doc])
                    least = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else order
                    # a phrase that a smaller document of the batch has is settled here and not sent on
                    settled = order[ids[doc[order]] > ids[doc[order[least]]]]
                    if local:
                        owner = ids[doc[settled]]
                        keys = _key(owner, h[settled], p[settled])
                        out += [(g, "whole", _pack(keys[i])) for g, i in _split(owner % parts)]
                    else:
                        sent = order[first]
                        out += [(g, "phrase", _keyed((h[s] // _U(parts)).astype(np.uint32), p[s], ids[doc[s]], TAG))
                                for g, s in ((g, sent[i]) for g, i in _split((h[sent] % _U(parts)).astype(np.int64)))]
                yield _rows(out)
        return run

    def dictionary(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["to"].iloc[0])
        h, p, ids = _entries(pdf["blob"], TAG)
        order, first = _smallest(h, p, ids)
        h, p, ids = h[order], p[order], ids[order]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        whole = ids > ids[begin]
        # a trigger with several phrases, of several documents, is opened in all of them that are not settled
        head = np.r_[True, np.diff(h) != 0]
        group = np.cumsum(head) - 1
        heads = np.flatnonzero(head)
        low, high = np.minimum.reduceat(ids, heads), np.maximum.reduceat(ids, heads)
        phrases = np.add.reduceat(first.astype(np.int64), heads)
        opened = ~whole & ((phrases > 1) & (low < high))[group]
        out = []
        for name, some in (("whole", np.flatnonzero(whole)), ("open", np.flatnonzero(opened))):
            # what a document can compute of its own phrase: the sent part of the trigger hash, the bucket, the phrase
            keys = _key(ids[some], h[some], np.full(len(some), bucket, _U), p[some])
            out += [(g, name, _pack(keys[i])) for g, i in _split(ids[some] % parts)]
        return _frame(out)

    def pack_documents(batches):
        for b in batches:
            out = []
            for ids, buf, starts in _batches(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                for g, i in _split(ids % parts):
                    raw = b"".join(buf[starts[k]:starts[k + 1]].tobytes() for k in i)
                    out.append((g, "docs", _pack(ids[i], np.diff(starts)[i], raw)))
            yield _rows(out)

    def flags(pdf: pd.DataFrame, name: str) -> list[np.ndarray]:
        return [np.frombuffer(_unpack(b)[0], _U) for b in pdf["blob"][pdf["kind"] == name]]

    def own_keys(ids, doc, h, p):
        return _key(ids[doc], h // _U(parts) & _U(0xFFFFFFFF), h % _U(parts), p & _U((1 << 8 * TAG) - 1))

    def suffixes(first, last, some):
        """Window starts of the phrases ``some``, and the phrase of each."""
        n = last[some] - first[some] + 1
        at = np.repeat(first[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return at, np.repeat(some, n)

    def open_phrases(pdf: pd.DataFrame) -> pd.DataFrame:
        found, out = flags(pdf, "open"), []
        if found:
            for ids, buf, starts in _documents(pdf["blob"][pdf["kind"] == "docs"]):
                doc, first, last, h, p, window = parse(buf, starts)
                some = np.flatnonzero(_known(own_keys(ids, doc, h, p), found))
                at, phrase = suffixes(first, last, some)
                w, owner = window[at], ids[doc[phrase]]
                order, new = _smallest(w, np.zeros(len(w), np.int8), owner)
                least = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0)) if len(order) else order
                settled = order[owner[order] > owner[order[least]]]
                out += [(g, "suffix", _pack(_key(owner[settled[i]], w[settled[i]]))) for g, i in _split(owner[settled] % parts)]
                sent = order[new]
                out += [(g, "window", _keyed(np.zeros(0, np.uint32), w[sent[i]], owner[sent[i]], 8)) for g, i in _split((w[sent] % _U(parts)).astype(np.int64))]
        return _frame(out)

    def suffix_order(pdf: pd.DataFrame) -> pd.DataFrame:
        passed = pdf[pdf["kind"] == "suffix"]  # on their way to their documents
        _, w, ids = _entries(pdf["blob"][pdf["kind"] == "window"], 8)
        order, first = _smallest(w, np.zeros(len(w), np.int8), ids)
        begin = order[np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        again = order[ids[order] > ids[begin]]
        made = _frame([(g, "suffix", _pack(_key(ids[again[i]], w[again[i]]))) for g, i in _split(ids[again] % parts)])
        return pd.concat([passed[["to", "kind", "blob"]], made]) if len(passed) else made

    def remove(pdf: pd.DataFrame) -> pd.DataFrame:
        whole, opened, found = flags(pdf, "whole"), flags(pdf, "open"), flags(pdf, "suffix")
        out = []
        for ids, buf, starts in _documents(pdf["blob"][pdf["kind"] == "docs"]):
            doc, first, last, h, p, window = parse(buf, starts)
            edge = np.zeros(len(buf) + 1, np.int32)
            keys = own_keys(ids, doc, h, p)
            gone = np.flatnonzero(_known(keys, whole) | _known(_key(ids[doc], h, p), whole))
            np.add.at(edge, first[gone], 1)
            np.add.at(edge, last[gone] + LENGTH, -1)
            at, phrase = suffixes(first, last, np.flatnonzero(_known(keys, opened)))
            hit = at[_known(_key(ids[doc[phrase]], window[at]), found)] if len(at) else at
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + LENGTH, -1)
            covered = np.cumsum(edge[:-1]) > 0
            for i in range(len(ids)):
                a, b = starts[i], starts[i + 1]
                mask = covered[a:b]
                turns = np.flatnonzero(np.diff(np.r_[False, mask, False]))
                kept = hashlib.sha256(buf[a:b][~mask].tobytes()).hexdigest()
                out.append((int(ids[i]), int(b - a), [{"start": int(s), "end": int(e)} for s, e in turns.reshape(-1, 2)], kept))
        return pd.DataFrame(out, columns=["id", "n_bytes", "spans", "kept_sha256"])

    table_of = lambda df: df.groupBy("to")
    settled = base.mapInArrow(first_pass(True), ROWS)
    marks = stage(table_of(base.mapInArrow(first_pass(False), ROWS)).applyInPandas(dictionary, ROWS), "pfp-marks")
    texts = base.mapInArrow(pack_documents, ROWS)
    opened = marks.filter("kind = 'open'")
    windows = table_of(texts.unionByName(opened)).applyInPandas(open_phrases, ROWS)
    again = table_of(windows).applyInPandas(suffix_order, ROWS)
    everything = texts.unionByName(settled).unionByName(marks).unionByName(again)
    out = table_of(everything).applyInPandas(remove, "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")
    return out.select(F.when(F.col("id") < 2**62, F.col("id")).cast(kind).alias("doc_id"), "n_bytes", "spans", "kept_sha256")


def repeat_digest(documents: DataFrame) -> DataFrame:
    """The digest of the repeated-string query."""
    out = repeats(documents.select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")
