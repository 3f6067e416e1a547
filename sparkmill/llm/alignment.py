"""Cross-tokenizer alignment: tokens of two tokenizers linked where they end together, pairs counted by external spills.

Encoding.  Every text is encoded whole by a byte-level BPE (A, its text led by a
space) and a SentencePiece model (B, which adds the space).  Ends of both token
rows are running sums of token bytes; ends that both have cut the text into groups,
and the A and the B token that end there are a link.

Counting.  Links become (b, a, document) records.  A task holds SPILL_LINKS of them
at most, then sorts them side-major (b before a) and deals them by the low digits of
b into BUCKETS zstd runs: the *heads* (each pair and its links in this spill) and the
*postings* (which documents, how often).  Heads of a bucket are merged k ways with a
heap, FAN_IN runs at a time and in as many passes as it takes, which counts each
pair; since a side's pairs come out together, the last pass also yields the highest
count of each b.  The counts then stream along the postings, run by run, and give
each document its share of the bucket; the shares of a spill are summed into its
documents.

A pair that a third of all documents hold is one head per spill: postings stay with
their spill and are never gathered by pair.  Rows are keyed by (spill, place), so
repeated and null ids each keep their own row.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import ship, stage

#: Links a task holds before it spills, documents of a spill, low digits of b, runs merged at a time.
SPILL_LINKS, SPILL_DOCS, BUCKETS, FAN_IN = 3_000_000, 60_000, 64, 64
#: Bytes of text encoded at a time, entries of a run that a merge looks at together, spills whose postings meet in a task.
BATCH_BYTES, BLOCK, SPILLS_A_TASK = 2_000_000, 8192, 8
#: Letters, marks and digits between white space, as byte-level BPE splits a text.  Fixed value of the vocabulary's format.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs of white space from here on go to the other library: the faster one's pattern matcher has a bounded stack.
_LONG_SPACE = re.compile(r"\s{5000}")
SPACE = "▁"


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level BPE: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Sides:
    """Both tokenizers and the bytes of their tokens, built from the files' contents in each worker."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken

        vocabulary, alphabet = json.loads(a_json)["model"]["vocab"], byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items()}
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self._json, self._slow = a_json, None
        self.a = tiktoken.Encoding("a", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        # ids with the mark that follows them: inside a group, at its end
        written = [b"%d%s" % (i, mark) for i in range(len(self.a_bytes)) for mark in (b",", b"|")]
        written += [b"%d%s" % (i, mark) for i in range(len(self.b_bytes)) for mark in (b",", b";")]
        self.written = np.array(written, object)

    def encode_a(self, text: str) -> list[int]:
        if _LONG_SPACE.search(text) is None:
            return self.a.encode_ordinary(text)
        if self._slow is None:
            from tokenizers import Tokenizer

            self._slow = Tokenizer.from_str(self._json.decode())
            self._slow.encode_special_tokens = True
        return self._slow.encode(text, add_special_tokens=False).ids


class Batch:
    """Aligned tokens of some texts; texts without tokens (null, empty, or not given back by both sides) have none."""

    def __init__(self, sides: Sides, texts: list[str | None]):
        a_ids = [sides.encode_a(" " + t) if t else [] for t in texts]
        b_ids = sides.b.encode([t or "" for t in texts], num_threads=1)
        for k, t in enumerate(texts):
            whole = (" " + t).encode() if t else b""
            if not t or b"".join([sides.a_bytes[i] for i in a_ids[k]]) != whole or b"".join([sides.b_bytes[i] for i in b_ids[k]]) != whole:
                a_ids[k], b_ids[k] = [], []
        self.sides, n = sides, len(texts)
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, n) for x in (a_ids, b_ids))
        self.a, self.b = (np.fromiter((i for x in ids for i in x), np.int64, int(c.sum())) for ids, c in ((a_ids, self.n_a), (b_ids, self.n_b)))
        a_end, b_end = np.cumsum(sides.a_len[self.a]), np.cumsum(sides.b_len[self.b])
        at = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 1, bool)
        at[b_end] = True
        self.a_last = at[a_end]
        at[:] = False
        at[a_end] = True
        self.b_last = at[b_end]
        #: Of each link: its A token, its B token, its text.
        self.link_a, self.link_b = self.a[self.a_last], self.b[self.b_last]
        self.link_doc = np.repeat(np.arange(n), self.n_a)[self.a_last]
        self.n_groups = np.bincount(self.link_doc, minlength=n)

    def groups(self) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        a_group, b_group = (np.cumsum(x) - x for x in (self.a_last, self.b_last))
        a_from, b_from = (np.concatenate([[0], np.flatnonzero(x) + 1]) for x in (self.a_last, self.b_last))
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[np.arange(len(self.a)) + b_from[a_group]] = 2 * self.a + self.a_last
        order[np.arange(len(self.b)) + a_from[b_group + 1]] = 2 * (len(self.sides.a_bytes) + self.b) + self.b_last
        ends = np.cumsum(self.n_a + self.n_b)
        return [b"".join(self.sides.written[order[e - k: e]].tolist())[:-1] for e, k in zip(ends.tolist(), (self.n_a + self.n_b).tolist(), strict=True)]


def pack(x: np.ndarray) -> bytes:
    """A column of whole numbers, byte planes apart, zstd."""
    x = np.ascontiguousarray(x)
    return x.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return raw.reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def narrow(x: np.ndarray) -> np.ndarray:
    """The smallest unsigned kind that holds ``x``."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(narrow(np.diff(keys, prepend=0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).astype(np.int64))


def heap_merge(runs: Iterable[tuple[np.ndarray, np.ndarray]], block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, totals) in ascending order from sorted runs of (keys, counts).

    The heap holds the last key of each run's current block.  Up to the smallest of
    them no run can bring another key, so what all runs have until there is summed
    and handed on.
    """
    runs = [r for r in runs if len(r[0])]
    at, heap = [0] * len(runs), [(int(k[min(block, len(k)) - 1]), r) for r, (k, _) in enumerate(runs)]
    heapq.heapify(heap)
    while heap:
        bound, parts = heap[0][0], []
        for r, (keys, counts) in enumerate(runs):
            if at[r] < len(keys) and keys[at[r]] <= bound:
                upto = at[r] + int(np.searchsorted(keys[at[r]: at[r] + block], bound, "right"))
                parts.append((keys[at[r]:upto], counts[at[r]:upto]))
                at[r] = upto
        while heap and heap[0][0] <= bound:
            _, r = heapq.heappop(heap)
            keys = runs[r][0]
            if at[r] < len(keys):
                heapq.heappush(heap, (int(keys[min(at[r] + block, len(keys)) - 1]), r))
        keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        totals = np.zeros(len(keys), np.int64)
        np.add.at(totals, place, np.concatenate([c for _, c in parts]))
        yield keys, totals


def highest(totals: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Of each entry, the largest total among those of its side; sides stand together."""
    if not len(side):
        return totals
    first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    return np.repeat(np.maximum.reduceat(totals, first), np.diff(np.append(first, len(side))))


class Spill:
    """Links of up to SPILL_DOCS texts, written as one zstd run for each bucket."""

    def __init__(self, number: int, n_a: int):
        self.number, self.n_a, self.docs, self.links, self.parts = number, n_a, 0, 0, []

    def add(self, batch: Batch) -> None:
        self.parts.append((batch.link_b * self.n_a + batch.link_a, batch.link_doc + self.docs))
        self.links += len(batch.link_doc)
        self.docs += len(batch.n_a)

    def runs(self) -> Iterator[dict]:
        if not self.links:
            return
        pair, doc = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        record, times = np.unique(pair * self.docs + doc, return_counts=True)
        pair, doc = record // self.docs, record % self.docs
        bucket = pair // self.n_a % BUCKETS
        for k in np.flatnonzero(np.bincount(bucket, minlength=BUCKETS)).tolist():
            mine = bucket == k
            keys, first, docs = np.unique(pair[mine], return_index=True, return_counts=True)
            yield {"spill": self.number, "bucket": k, "n_docs": self.docs, "keys": pack_sorted(keys),
                   "counts": pack(narrow(np.add.reduceat(times[mine], first))), "holders": pack(narrow(docs)),
                   "docs": pack(narrow(doc[mine])), "times": pack(narrow(times[mine]))}


def _cuts(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive texts of about ``most`` characters together; a longer text stands alone."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t or "") > most:
            yield start, k
            start, held = k, 0
        held += len(t or "")
    if start < len(texts):
        yield start, len(texts)


RUN = "n_docs bigint, keys binary, counts binary, holders binary, docs binary, times binary"
#: Texts of a slice of an Arrow batch that become Python strings together.
SLICE = 256


def spill(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text", keep_groups: bool = False) -> DataFrame:
    """Encode every text; rows of kind ``bucket is null`` are documents, the others runs of their spill.  Written once."""
    spark = docs.sparkSession
    ship(spark)
    with open(a_file, "rb") as f, open(b_file, "rb") as g:  # vocabularies, a few MB
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    kind = docs.select(key).schema[0].dataType.simpleString()
    schema = (f"id {kind}, spill bigint, place bigint, n_a bigint, n_b bigint, n_groups bigint, groups string, groups_sha256 string, bucket int, {RUN}")

    def run(batches):
        sides, out = None, None
        number = TaskContext.get().partitionId() << 24

        def rows(found: list[dict]) -> pa.RecordBatch:
            names = [x.split(" ")[0] for x in RUN.split(", ")]
            return pa.record_batch({
                "id": pa.nulls(len(found), id_type), **{c: pa.nulls(len(found), pa.int64()) for c in ("place", "n_a", "n_b", "n_groups")},
                "groups": pa.nulls(len(found), pa.string()), "groups_sha256": pa.nulls(len(found), pa.string()),
                "spill": pa.array([x["spill"] for x in found], pa.int64()), "bucket": pa.array([x["bucket"] for x in found], pa.int32()),
                **{c: pa.array([x[c] for x in found], pa.int64() if c == "n_docs" else pa.binary()) for c in names}}).select(order)

        order = [x.split(" ")[0] for x in schema.replace(f"id {kind}", "id x", 1).split(", ")]
        for whole in batches:
            id_type = whole.schema.field(0).type
            sides = sides or Sides(*files.value)
            for s in range(0, whole.num_rows, SLICE):
                part = whole.slice(s, SLICE)
                texts = part.column(1).to_pylist()
                for lo, hi in _cuts(texts, BATCH_BYTES):
                    batch, n = Batch(sides, texts[lo:hi]), hi - lo
                    if out is None or out.links >= SPILL_LINKS or out.docs + n > SPILL_DOCS:
                        if out is not None:
                            yield rows(list(out.runs()))
                            number += 1
                        out = Spill(number, len(sides.a_bytes))
                    written = batch.groups()
                    yield pa.record_batch({
                        "id": part.column(0).slice(lo, n), "spill": pa.array([number] * n, pa.int64()), "place": pa.array(range(out.docs, out.docs + n), pa.int64()),
                        "n_a": pa.array(batch.n_a), "n_b": pa.array(batch.n_b), "n_groups": pa.array(batch.n_groups, pa.int64()),
                        "groups": pa.array([w.decode() for w in written], pa.string()) if keep_groups else pa.nulls(n, pa.string()),
                        "groups_sha256": pa.array([hashlib.sha256(w).hexdigest() if w else "" for w in written], pa.string()),
                        "bucket": pa.nulls(n, pa.int32()), "n_docs": pa.nulls(n, pa.int64()),
                        **{c: pa.nulls(n, pa.binary()) for c in ("keys", "counts", "holders", "docs", "times")}}).select(order)
                    out.add(batch)
        if out is not None:
            yield rows(list(out.runs()))

    return stage(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, schema), "align-spill")


def merged(runs: DataFrame, n_a: int) -> DataFrame:
    """(bucket, keys, counts, best): one merged run for each bucket, of all runs in as many passes as FAN_IN asks for."""
    heads = runs.select("bucket", F.col("spill").alias("slot"), "keys", "counts")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        found = list(heap_merge((unpack_sorted(k), unpack(c)) for k, c in zip(group["keys"], group["counts"], strict=True)))
        keys, totals = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        best = highest(totals, keys // n_a)
        return pd.DataFrame({"bucket": group["bucket"].iloc[:1].to_numpy(), "slot": group["slot"].iloc[:1].to_numpy(),
                             "keys": [pack_sorted(keys)], "counts": [pack(narrow(totals))], "best": [pack(narrow(best))]})

    schema = "bucket int, slot bigint, keys binary, counts binary, best binary"
    most = runs.groupBy("bucket").count().agg(F.max("count")).first()[0] or 0
    while most > FAN_IN:
        most = -(-most // max(2, FAN_IN // 2))
        heads = heads.groupBy("bucket", F.pmod(F.xxhash64("slot"), F.lit(most)).alias("slot")).applyInPandas(
            lambda key, group: merge(group).assign(slot=int(key[1])), schema).select("bucket", "slot", "keys", "counts")
        heads = stage(heads, "align-pass")
    return stage(heads.groupBy("bucket").applyInPandas(merge, schema).drop("slot"), "align-counts")


def contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(spill, best, total): of each run, what its bucket adds to each document of the spill, in order of the documents."""
    spills = runs.agg(F.countDistinct("spill")).first()[0]
    groups = max(1, -(-spills // SPILLS_A_TASK))
    sent = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    dealt = runs.select("spill", "bucket", *[c.split(" ")[0] for c in RUN.split(", ")]).withColumn("part", F.pmod(F.xxhash64("spill"), F.lit(groups)))

    def stream(postings: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(postings):
            all_keys, all_counts, all_best = unpack_sorted(side["keys"].iloc[0]), unpack(side["counts"].iloc[0]).astype(np.int64), unpack(side["best"].iloc[0])
        for r in postings.itertuples():
            at = np.searchsorted(all_keys, unpack_sorted(r.keys))
            holders, doc, times = unpack(r.holders), unpack(r.docs).astype(np.int64), unpack(r.times).astype(np.int64)
            total, best = np.zeros(r.n_docs, np.int64), np.zeros(r.n_docs, np.int64)
            np.add.at(total, doc, times * np.repeat(all_counts[at], holders))
            np.add.at(best, doc, times * np.repeat(all_counts[at] == all_best[at], holders))
            out.append((r.spill, pack(narrow(best)), pack(narrow(total))))
        return pd.DataFrame(out, columns=["spill", "best", "total"])

    return dealt.groupBy("bucket", "part").cogroup(sent.groupBy("bucket", "part")).applyInPandas(stream, "spill bigint, best binary, total binary")


def _finish(docs: pd.DataFrame, shares: pd.DataFrame) -> pd.DataFrame:
    """Documents of a spill with the sums of its runs' shares."""
    n = len(docs)
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for b, t in zip(shares["best"], shares["total"], strict=True):
        best += unpack(b).astype(np.int64)
        total += unpack(t).astype(np.int64)
    at = docs["place"].to_numpy()
    return docs.drop(columns=["spill", "place"]).assign(n_links=docs["n_groups"], n_best=best[at], count_sum=total[at])


def align(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text", keep_groups: bool = False) -> DataFrame:
    """Per row of ``docs``: id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum (and groups, if asked for).

    A pair's count is the number of links that hold it in all texts.  ``n_best`` are the
    links of the row whose count is the highest of their B id, ties included, and
    ``count_sum`` adds the counts of its links.  A text that is null, empty or not given
    back byte for byte by both tokenizers has no tokens: zeros and ''.  Every row is
    answered on its own, also where ids repeat or are null; other columns of any name
    are left aside.  An empty table gives no rows.  Texts are encoded whole, however long.
    The files are read on the driver and travel as a broadcast of their size.
    """
    written = spill(docs, a_file, b_file, key, text, keep_groups)
    runs = written.filter("bucket is not null")
    shares = contributions(runs, merged(runs, _side_size(a_file)))
    kind = written.schema["id"].dataType.simpleString()
    groups = ["groups"] if keep_groups else []
    found = written.filter("bucket is null").select("id", "spill", "place", "n_a", "n_b", "n_groups", *groups, "groups_sha256")
    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, {'groups string, ' if keep_groups else ''}groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint"
    return found.groupBy("spill").cogroup(shares.groupBy("spill")).applyInPandas(_finish, schema)


def pair_counts(docs: DataFrame, a_file: str, b_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, count, best boolean): how many links hold each pair of ids, and whether no pair of its B id has more.

    Nulls, empty tables and texts without tokens as in `align`; they add no pair.
    """
    n_a = _side_size(a_file)

    def rows(batches):
        for batch in batches:
            for keys, counts, best in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                keys, counts, best = unpack_sorted(keys), unpack(counts).astype(np.int64), unpack(best).astype(np.int64)
                yield pa.record_batch({"a": pa.array(keys % n_a), "b": pa.array(keys // n_a), "count": pa.array(counts), "best": pa.array(counts == best)})

    runs = spill(docs, a_file, b_file, key, text).filter("bucket is not null")
    return merged(runs, n_a).select("keys", "counts", "best").mapInArrow(rows, "a bigint, b bigint, count bigint, best boolean")


def _side_size(a_file: str) -> int:
    with open(a_file, "rb") as f:
        return max(json.load(f)["model"]["vocab"].values()) + 1


def align_documents(documents: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """The alignment query: the digest columns of `align`, one row per document; its docstring states the cases."""
    found = align(documents, a_file, b_file).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
