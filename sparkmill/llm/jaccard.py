"""Exact n-gram Jaccard join with a token-group matrix.

Documents are sets of word shingles.  Similar documents are first partitioned
into groups: sets of near size are cut by hash into the same parts, more of them than
two linking sets can differ in, so a link leaves parts equal; what stands in the rarer
parts are a set's signatures, and two sets that link share one (exact for any one order
of the parts).  A part holds about three shingles: texts that share single shingles, which
all do more the larger the corpus, do not meet, and groups stay about as large as the
families in them.  Documents that share a signature and are
joined by a chain of sizes without a wider step form one group, so no link crosses
groups.  Rarity comes from a sketch of fixed
size that counts all shingles of all documents; it only orders, so its collisions
cost time and never a link.  A group is stored in blocks with the union of the
block's shingles.  A query document opens a block only if its overlap with the
union reaches the share that a link needs; inside an opened block overlaps are
counted for members that share a signature with the query, are near it in size
and not yet connected with it.  A quarter of all hashes decides first which documents
are sent at all: what two sets share there and all that lies outside bound their overlap.  Blocks hold whole families where these are small,
and first meet the group's first block; then only documents outside the group's main
component query other blocks, and of these the ones that hold a document of another
component with one of their signatures.

Texts travel compressed, and a task makes the shingles of what it got: a text takes
less room than its set.  Equal sets are one class and are compared once.  No pairs inside a group are
written: a task returns links that span what it found connected.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import components, drop_staged, join_by_key, lean, lean_group, ship, sifted, stage
from sparkmill.llm.pfp import _BYTE, _M, _U, _batches, _entries, _keyed, _mix, _split

WORDS, PERCENT = 4, 85
#: Documents of a block.
BLOCK = 512
#: Up to so many sets share a shingle before a matrix product is cheaper than their pairs.
FEW = 24
#: Counters of the sketch: 2 ** SKETCH_BITS of them at every size of the corpus
#: (8 MB on the driver and in a worker), sent in pieces of PIECE.
SKETCH_BITS, PIECE = 21, 1 << 14
#: Bytes of the corpus for each bucket of signatures.
SHARE = 6_000_000
LEAST_PARTS = 61
#: Bytes of a signature that are sent beside its bucket: equal ones by chance make a group larger, no link is lost.
TAG = 5
#: Which documents open a block, and of which, is first bounded by one in SAMPLE of their shingles.
SAMPLE = 4
#: Sizes are told apart by 1 / LEVELS of their logarithm.
LEVELS = 64
#: Bytes of text of which a task holds the shingles at a time.
AT_ONCE = 1_000_000
#: Rows of an Arrow batch looked at together.
ROWS = 400
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def shingles(buf: np.ndarray, starts: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash) of the distinct shingles, sorted by both."""
    none = np.zeros(0, np.int64), np.zeros(0, _U)
    if not len(buf):
        return none
    buf = np.where((buf >= 65) & (buf <= 90), buf + 32, buf).astype(np.uint8)
    doc_at = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
    solid = ~_SPACE[buf]
    first = np.flatnonzero(solid & np.r_[True, ~solid[:-1] | (doc_at[1:] != doc_at[:-1])])
    if not len(first):
        return none
    doc = doc_at[first].astype(np.int64)
    letters = np.flatnonzero(solid)
    word = np.searchsorted(first, letters, side="right") - 1
    place = (letters - first[word]).astype(_U)
    mixed = _mix(_BYTE[buf[letters]] + place * _M[2])
    heads = np.flatnonzero(np.r_[True, np.diff(word) != 0])
    w = _mix(np.add.reduceat(mixed, heads) * _M[3] + np.diff(np.r_[heads, len(word)]).astype(_U))
    n = np.bincount(doc, minlength=len(starts) - 1)
    h = w.copy()
    whole = np.arange(len(w)) + words <= np.cumsum(n)[doc]
    for k in range(1, min(words, len(w))):
        h[:len(w) - k] = _mix(h[:len(w) - k] * _M[4] + w[k:])
    d, h = doc[whole], h[whole]
    short = np.flatnonzero((n > 0) & (n < words))
    if len(short):  # the whole sequence is the one shingle
        at = np.cumsum(n) - n
        some = [int(_fold(w[at[i]:at[i] + n[i]])) for i in short]
        d, h = np.r_[d, short], np.r_[h, np.array(some, dtype=_U)]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.r_[True, (np.diff(d) != 0) | (np.diff(h) != 0)]
    return d[new], h[new]


def _fold(w: np.ndarray) -> np.ndarray:
    h = w[:1] + _U(len(w))
    for x in w[1:]:
        h = _mix(h * _M[1] + x)
    return h[0]


def _place(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SKETCH_BITS)).astype(np.int64)


def size_steps(largest: int, percent: int) -> np.ndarray:
    """Smallest size of each step: linking sets are of one step or of two that follow each other."""
    first = [1]
    while first[-1] <= largest or len(first) < 3:
        first.append(100 * first[-1] // percent + 1)
    return np.array([*first, 100 * first[-1] // percent + 1])


def signatures(doc: np.ndarray, h: np.ndarray, n: np.ndarray, seen: np.ndarray, percent: int):
    """(signature, document), sorted by document: two linking sets share one at least.

    ``doc`` and ``h`` are sorted by both, ``n`` counts the shingles of each document.
    Linking sets of a and b shingles differ in d = (a + b) * (100 - percent) / (100 + percent) at
    most.  Within a step of sizes and the next one, all sets are cut by hash into the same m parts,
    m > d, so at least m - d parts are equal; a signature is the whole content of a part.
    Each set leaves out its m - d - 1 most common ones, d taken for itself and its largest possible
    partner: of the equal parts the rarest stays in both.  A part is rarer by one
    step for each shingle in it and for each halving of the least of its counts in ``seen``;
    empty parts come last, ties go by part.  Any such order is exact: this one leaves out passages
    of many documents and parts of a single shingle, which more and more texts share by chance.
    """
    size = size_steps(int(n.max(initial=1)), percent)
    own = np.searchsorted(size, np.maximum(n, 1), side="right") - 1
    differ = lambda total: total * (100 - percent) // (100 + percent)
    mixed, count = _mix(h), seen[_place(h)]
    sigs, docs = [], []
    for below in (0, 1):  # with sets of the own step and the next one; with those of the step before
        low = np.maximum(own - below, 0)
        top = size[low + 1] - 1
        most = differ(n + (top if below else 100 * n // percent))
        on = (n > 0) & ((own > 0) & (percent * n <= 100 * top) if below else True)
        worst = differ(top + size[low + 2] - 1)
        parts = np.where(worst > 0, 2 * worst + 2, 1)
        use = on[doc]
        d, x = doc[use], h[use]
        if not len(d):
            continue
        part = (((x >> _U(32)) * parts[d].astype(_U)) >> _U(32)).astype(np.int64)  # ascends with the hash
        heads = np.flatnonzero(np.r_[True, (np.diff(d) != 0) | (np.diff(part) != 0)])
        content, held = np.add.reduceat(mixed[use], heads), np.diff(np.r_[heads, len(d)])
        digits, power = np.frexp(np.minimum.reduceat(count[use], heads) + 1.0)  # a logarithm without rounding: the same on every machine
        rare = (8 * (power + 2 * digits + 16 - np.minimum(held, 16))).astype(np.int64)
        d, part = d[heads], part[heads]
        # a set that fills fewer parts than it needs also names empty ones, the first ones first
        filled = np.bincount(d, minlength=len(n))
        bare = np.flatnonzero(on & (filled <= most))
        if len(bare):
            ends = np.cumsum(filled)
            gaps = [np.setdiff1d(np.arange(parts[i]), part[ends[i] - filled[i]:ends[i]]) for i in bare]
            d, part = np.r_[d, np.repeat(bare, [len(g) for g in gaps])], np.r_[part, *gaps]
            content, rare = np.r_[content, np.zeros(len(d) - len(content), _U)], np.r_[rare, np.full(len(d) - len(rare), 1 << 16)]
            filled = np.bincount(d, minlength=len(n))
        order = np.argsort(d << 20 | rare, kind="stable")
        d = d[order]
        keep = np.arange(len(d)) - (np.cumsum(filled) - filled)[d] <= most[d]
        order, d = order[keep], d[keep]
        sigs.append(_mix(content[order] * _M[3] + (low[d].astype(_U) << _U(40)) + part[order].astype(_U)))
        docs.append(d)
    if not docs:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    d = np.concatenate(docs)
    order = np.argsort(d, kind="stable")
    return np.concatenate(sigs)[order], d[order]


def levels(n: np.ndarray) -> np.ndarray:
    """Sizes on a logarithmic scale, below 2 ** 16."""
    return (np.log(np.maximum(n, 1)) * LEVELS).astype(np.int64)


def gap(percent: int) -> int:
    """Levels of two linking sets differ by so much at most (with room for rounding)."""
    return math.ceil(LEVELS * math.log(100 / percent)) + 1


def chains(sig: np.ndarray, lo: np.ndarray, hi: np.ndarray, owner: np.ndarray, percent: int):
    """Order of the entries, the chain of each, and ((lo, hi, owner, first entry) of each chain).

    An entry holds levels from ``lo`` to ``hi`` without a step wider than the gap.
    Entries of one signature whose levels are joined without such a step are a chain.
    """
    order = np.lexsort((owner, lo, sig))
    if not len(order):
        return order, order, (order, order, order, order)
    rank = np.cumsum(np.r_[0, np.diff(sig[order]) != 0])
    reach = np.maximum.accumulate((rank << 20) + hi[order])  # the highest level so far of the same signature
    first = np.r_[True, (rank[1:] << 20) + lo[order][1:] > reach[:-1] + gap(percent)]
    heads = np.flatnonzero(first)
    last = np.r_[heads[1:], len(order)] - 1
    return order, np.cumsum(first) - 1, (lo[order][heads], reach[last] - (rank[last] << 20), owner[order][heads], order[heads])


def _met(order: np.ndarray, chain: np.ndarray, heads: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (first document of the chain, other document)."""
    a, b = heads[chain], owner[order]
    a, b = a[a != b], b[a != b]
    at = np.lexsort((b, a))
    a, b = a[at], b[at]
    new = np.r_[True, (np.diff(a) != 0) | (np.diff(b) != 0)][:len(a)]
    return a[new], b[new]


def _sets(blobs, words: int) -> list[np.ndarray]:
    """The shingles of each compressed text."""
    out: list = [np.zeros(0, _U)] * len(blobs)
    z = zstandard.ZstdDecompressor()
    for ids, buf, starts in _batches(((i, z.decompress(b)) for i, b in enumerate(blobs)), AT_ONCE):
        doc, h = shingles(buf, starts, words)
        cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
        for k, i in enumerate(ids):
            out[i] = h[cuts[k]:cuts[k + 1]]
    return out


def _overlaps(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Overlap of each pair in ``a`` (of i < j), or of each of ``a`` with each of ``b``."""
    sets = a + (b or [])
    tokens, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    width = len(a) if b is None else len(b)
    if b is not None:  # a shingle of one side alone adds to no overlap
        both = np.bincount(at[owner < len(a)], minlength=len(tokens)).astype(bool) & np.bincount(at[owner >= len(a)], minlength=len(tokens)).astype(bool)
        at, owner = at[both[at]], owner[both[at]]
    # a shingle of one set alone adds to no overlap; one of few sets adds pair by pair, the others by a matrix product
    overlap = np.zeros((len(a), width), np.float32)  # counts below 2 ** 24 are exact in single precision
    order = np.argsort(at, kind="stable")  # sets ascend within a shingle
    owner, held = owner[order], np.bincount(at, minlength=len(tokens))
    first = np.cumsum(held) - held
    for k in range(2, min(FEW, len(sets)) + 1):
        mine = owner[first[held == k][:, None] + np.arange(k)]
        for i in range(k - 1 if len(mine) else 0):
            left, right = np.repeat(mine[:, i], k - 1 - i), mine[:, i + 1:].ravel()
            if b is not None:
                across = (left < len(a)) & (right >= len(a))
                left, right = left[across], right[across] - len(a)
            if len(left):
                cell, n = np.unique(left * width + right, return_counts=True)
                overlap.ravel()[cell] += n
    used = np.flatnonzero(held > FEW)
    column = np.full(len(tokens), -1)
    column[used] = np.arange(len(used))
    col = np.repeat(column, held)
    keep = col >= 0
    row, col = owner[keep], col[keep]
    for low in range(0, len(used), 4096):
        lo, hi = np.searchsorted(col, [low, low + 4096])
        m = np.zeros((len(sets), min(4096, len(used) - low)), np.float32)
        m[row[lo:hi], col[lo:hi] - low] = 1
        overlap += m[:len(a)] @ (m[len(a):] if b is not None else m).T
    return overlap


def _links(a: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Positions (i, j), i < j, of linking sets by overlap counts."""
    sizes = np.array([len(s) for s in a])
    inside = np.rint(_overlaps(a, None)).astype(np.int64)
    ok = (100 * inside >= percent * (sizes[:, None] + sizes[None] - inside)) & (inside > 0)
    return list(zip(*(x.tolist() for x in np.nonzero(np.triu(ok, 1))), strict=True))


def _joining(queries, query_of, members, member_of, seen: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Positions (query, member) of links that connect components, enough of them.

    ``query_of`` and ``member_of`` name the components.  Candidates share a
    signature, are near in size and of different components; each is counted
    exactly unless links found so far connect the two.
    """
    def prefixes(sets):
        d, h = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        n = np.array([len(x) for x in sets])
        sig, d = signatures(d, h, n, seen, percent)
        return np.split(sig, np.cumsum(np.bincount(d, minlength=len(sets)))[:-1]), n

    (qp, qn), (mp, mn) = prefixes(queries), prefixes(members)
    near = 100 * np.minimum(qn[:, None], mn[None]) >= percent * np.maximum(qn[:, None], mn[None])
    near &= np.asarray(query_of)[:, None] != np.asarray(member_of)[None]
    near &= _overlaps(qp, mp) > 0
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
        a, b = find(query_of[i]), find(member_of[j])
        if a == b:
            continue
        small, large = sorted((queries[i], members[j]), key=len)
        at = np.searchsorted(large, small)
        inside = int((large[np.minimum(at, len(large) - 1)] == small).sum())
        if 100 * inside >= percent * (len(small) + len(large) - inside):
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _low(h: np.ndarray) -> np.ndarray:
    """32 bits of the hashes in the lowest 1 / SAMPLE; ``h`` ascends."""
    return np.unique((h[:np.searchsorted(h, _U(2 ** 64 // SAMPLE))] >> _U(30)).astype(np.uint32))


def _hopeful(queries, qn, query_of, members, mn, member_of, percent: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Whether each query, and each member, may link with a member, or query, of another component.

    ``queries`` and ``members`` are samples (`_low`) of sets of ``qn`` and ``mn`` shingles.  Two sets
    share what their samples share at most, and all that either one's sample leaves out (equal bits of
    different hashes included); a pair that stays below the overlap of a link this way is none.
    """
    some, any_ = np.zeros(len(queries), bool), np.zeros(len(members), bool)
    qu, mu = np.array([len(x) for x in queries]), np.array([len(x) for x in members])
    union = np.unique(np.concatenate(members))
    inside = np.array([int(np.isin(x, union, assume_unique=True).sum()) for x in queries])
    opened = np.flatnonzero(100 * (inside + qn - qu) >= percent * qn)
    for at in range(0, len(opened), block):
        k = opened[at:at + block]
        most = np.rint(_overlaps([queries[i] for i in k], members)).astype(np.int64) + np.minimum((qn - qu)[k][:, None], (mn - mu)[None])
        near = (100 + percent) * most >= percent * (qn[k][:, None] + mn[None])
        near &= 100 * np.minimum(qn[k][:, None], mn[None]) >= percent * np.maximum(qn[k][:, None], mn[None])
        near &= query_of[k][:, None] != member_of[None]
        some[k] |= near.any(axis=1)
        any_ |= near.any(axis=0)
    return some, any_


def _measured(rows: int, *columns) -> pa.RecordBatch:
    types = [pa.int64()] * 6 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.nulls(rows, t) if c is None else c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                      ["id", "n", "s1", "s2", "least", "piece", "seen"])


def _spanning(pairs, ids) -> list[tuple[int, int]]:
    """Enough of the pairs to keep what they connect."""
    root: dict[int, int] = {}

    def find(x):
        while root.get(x, x) != x:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    out = []
    for i, j in pairs:
        a, b = find(ids[i]), find(ids[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((ids[i], ids[j]))
    return out


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK, share: int = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows.

    Two documents link when 100 * |intersection| >= ``percent`` * |union| of their
    distinct shingles; fewer than ``words`` words are one shingle; null, empty and
    blank texts have none and link with nothing.  component_id is the smallest
    doc_id reachable by links.  Rows that repeat a doc_id with the same set are
    answered alike; different sets under one id are one node of the graph.  Rows of
    null id are answered with a null component and link nothing.
    """
    spark = docs.sparkSession
    ship(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text")
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_PARTS, int(total // share) | 1)

    def slices(batches):
        """Arrow batches cut small: only so many texts are Python strings at a time."""
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                yield b.slice(k, ROWS)

    def batches_of(b):
        yield from _batches(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), AT_ONCE)

    def measure(batches):
        seen = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in slices(batches):
            for ids, buf, starts in _batches(zip(range(b.num_rows), b.column(1).to_pylist(), strict=True), AT_ONCE):
                doc, h = shingles(buf, starts, words)
                n = np.bincount(doc, minlength=len(ids))
                s1, s2, least = np.zeros(len(ids), _U), np.zeros(len(ids), _U), np.zeros(len(ids), _U)
                heads = np.flatnonzero(np.r_[True, np.diff(doc) != 0]) if len(doc) else []
                if len(doc):
                    mixed = _mix(h)
                    s1[doc[heads]], s2[doc[heads]] = np.add.reduceat(mixed, heads), np.add.reduceat(_mix(h ^ _M[1]), heads)
                    least[doc[heads]] = np.minimum.reduceat(mixed, heads)
                    seen += np.bincount(_place(h), minlength=1 << SKETCH_BITS).astype(np.uint32)
                yield _measured(len(ids), b.column(0).slice(int(ids[0]), len(ids)), n, s1.view(np.int64), s2.view(np.int64), least.view(np.int64), None, None)
        filled = [k for k in range(len(seen) // PIECE) if seen[k * PIECE:][:PIECE].any()]
        yield _measured(len(filled), None, None, None, None, None, filled, [zstandard.compress(seen[k * PIECE:][:PIECE].tobytes()) for k in filled])

    def add(batches):
        """Counters of each piece, summed as they come."""
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zstandard.decompress(blob), np.uint32).astype(np.uint64)
        top = np.uint64(0xFFFFFFFF)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([np.minimum(x, top).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["piece", "seen"])

    measured = stage(base.mapInArrow(lean(measure), "id bigint, n bigint, s1 bigint, s2 bigint, least bigint, piece bigint, seen binary"), "jaccard-sets")
    sets = measured.filter("piece is null").select("id", "n", "s1", "s2", "least")
    pieces = measured.filter("piece is not null").select("piece", "seen").repartition(64, "piece").mapInArrow(add, "piece bigint, seen binary")
    seen = np.zeros(1 << SKETCH_BITS, np.uint32)
    for piece, blob in pieces.collect():  # at most 2 ** SKETCH_BITS counters in all
        seen[piece * PIECE:][:PIECE] = np.frombuffer(blob, np.uint32)
    sketch = spark.sparkContext.broadcast(seen)
    classes = sets.filter("n > 0 and id is not null").groupBy(F.struct("n", "s1", "s2").alias("set")).agg(
        F.min("id").alias("first"), F.min("least").alias("least"), F.count(F.lit(1)).alias("rows"))
    classes = stage(classes, "jaccard-classes")

    def sign(batches):
        for b in slices(batches):
            to, blob, low, high = [], [], [], []
            for ids, buf, starts in batches_of(b.filter(b.column(0).is_valid())):
                doc, h = shingles(buf, starts, words)
                n = np.bincount(doc, minlength=len(ids))
                sig, d = signatures(doc, h, n, sketch.value, percent)
                owner, level = ids[d], levels(n)[d]
                order, chain, (lo, hi, head, at) = chains(sig, level, level, owner, percent)
                one, other = _met(order, chain, head, owner)  # met inside the batch
                for g, i in _split((sig[at] % _U(buckets)).astype(np.int64)):
                    to.append(g), blob.append(_keyed((lo[i] << 16 | hi[i]).astype(np.uint32), sig[at[i]], head[i], TAG)), low.append(None), high.append(None)
                to += (one % buckets).tolist()
                blob += [None] * len(one)
                low += one.tolist()
                high += other.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(blob, pa.binary()), pa.array(low, pa.int64()), pa.array(high, pa.int64())],
                                             ["to", "blob", "a", "b"])

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        span, sig, ids = _entries(pdf["blob"].dropna(), TAG)
        span = span.astype(np.int64)
        order, chain, (_, _, head, _) = chains(sig, span >> 16, span & 0xFFFF, ids, percent)
        one, other = _met(order, chain, head, ids)
        known = pdf[pdf["blob"].isna()]
        return pd.DataFrame({"a": np.r_[one, known["a"].astype(np.int64)], "b": np.r_[other, known["b"].astype(np.int64)]})

    signed = base.mapInArrow(lean(sign), "to bigint, blob binary, a bigint, b bigint")
    near = signed.groupBy("to").applyInPandas(lean_group(meet), "a bigint, b bigint")
    groups = components(near)
    # members of a group: one document of each class
    members = groups.join(classes.select(F.col("first").alias("node"), "least"), "node").select(F.col("node").alias("id"), F.col("component").alias("grp"), "least")
    members = stage(members, "jaccard-members")
    counts = members.groupBy("grp").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    counts = stage(counts, "jaccard-groups")
    placed = join_by_key(members, counts.withColumn("blocks", F.ceil(F.col("rows") / block)), "grp", "rows", F.col("id")).filter("blocks is not null")
    # a block takes whole families (sets of one minimum hash); families of over half a block are spread
    placed = placed.withColumn("family", F.struct("grp", "least"))
    wide = placed.filter("blocks > 1").groupBy("family").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > block // 2)
    placed = join_by_key(placed, stage(wide.withColumn("wide", F.lit(True)), "jaccard-wide"), "family", "rows", F.col("id"))
    placed = placed.withColumn("blk", F.pmod(F.when(F.col("wide"), F.xxhash64("id")).otherwise(F.xxhash64("least")), F.col("blocks"))).withColumn("wide", F.col("wide").isNotNull()).drop("family", "least")
    placed = stage(placed, "jaccard-placed")

    def press(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([z.compress(t.as_py().encode()) for t in b.column(1)], pa.binary())], ["id", "blob"])

    # only texts of groups of several sets are pressed and shuffled
    pressed = sifted(base.filter("id is not null and text is not null"), placed.select("id"), "id").filter("_may").select("id", "text").mapInArrow(lean(press), "id bigint, blob binary")
    stored = stage(pressed.join(placed, "id").select("id", "grp", "blk", "blocks", "wide", "blob"), "jaccard-blocks")
    kinds = "a bigint, b bigint"

    def own_block(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, g in pdf.groupby(["grp", "at"]):
            g = g.drop_duplicates(["id", "blob"])
            if len(g) > 1:
                out += _spanning(_links(_sets(g["blob"].tolist(), words), percent), g["id"].tolist())
        return pd.DataFrame(out, columns=["a", "b"])

    # what the first block holds of spread families stands in every block; small groups share a task
    every = F.explode(F.when(F.col("wide") & (F.col("blk") == 0), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).otherwise(F.array("blk")))
    shared = stored.withColumn("at", every)
    n_bins = max(1, int((members.count()) // 300))
    shared = shared.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("grp"), F.lit(n_bins))).otherwise(-1 - F.pmod(F.xxhash64("grp", "at"), F.lit(1 << 40))))
    found = stage(shared.groupBy("bin").applyInPandas(lean_group(own_block), kinds), "jaccard-links")

    large = stored.filter("blocks > 1").select("id", "grp", "blk").distinct()
    if not large.isEmpty():
        part = components(found)
        named = large.join(part.withColumnsRenamed({"node": "id"}), "id", "left").withColumn("component", F.coalesce("component", "id"))
        named = stage(named, "jaccard-named")
        top = named.groupBy("grp", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(
            F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("rows"), F.max("n").alias("joined"))
        # groups that are one component already are done; of the others, documents outside the main one ask
        top = stage(top.filter("joined < rows").drop("joined"), "jaccard-main")
        rest = join_by_key(named, top, "grp", "rows", F.col("id")).filter("main is not null").select("grp", "id", "blk", "component", (F.col("component") != F.col("main")).alias("outside"))

        def prefixes(batches):
            for b in batches:
                z = zstandard.ZstdDecompressor()
                for at, buf, starts in _batches(((i, z.decompress(x.as_py())) for i, x in enumerate(b.column(5))), AT_ONCE):
                    doc, h = shingles(buf, starts, words)
                    sig, d = signatures(doc, h, np.bincount(doc, minlength=len(at)), sketch.value, percent)
                    n = np.bincount(doc, minlength=len(at))
                    low = [_low(x).tobytes() for x in np.split(h, np.cumsum(n)[:-1])]
                    rows, names = pa.array(np.r_[at[d], at], pa.int64()), ["grp", "id", "blk", "component", "outside", "sig", "n", "low"]
                    yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(5)), pa.array([*sig.view(np.int64).tolist(), *[None] * len(at)], pa.int64()),
                                                      pa.array([None] * len(sig) + n.tolist(), pa.int64()), pa.array([None] * len(sig) + low, pa.binary())], names)

        signed = rest.join(stored.filter("blocks > 1").select("id", "blob"), "id").select("grp", "id", "blk", "component", "outside", "blob")
        signed = stage(signed.mapInArrow(lean(prefixes), "grp bigint, id bigint, blk bigint, component bigint, outside boolean, sig bigint, n bigint, low binary"), "jaccard-prefixes")
        prefixed, lows = signed, signed.filter("sig is null").select("id", "n", "low")
        signed = prefixed.filter("sig is not null").drop("n", "low")
        # the blocks that hold a document of another component with the same signature
        met = signed.groupBy("grp", "sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.array_sort(F.collect_set("blk")).alias("blks"), F.count(F.lit(1)).alias("rows"))
        met = stage(met.filter("lo < hi").select(F.struct("grp", "sig").alias("key"), "blks", "rows"), "jaccard-met")
        shared = sifted(signed.withColumn("key", F.struct("grp", "sig")), met, "key").filter("_may").drop("_may", "grp", "sig")
        hits = join_by_key(shared, met, "key", "rows", F.col("id")).filter("blks is not null").withColumn("grp", F.col("key.grp"))
        hits = stage(hits.select("grp", "id", "blk", "component", "outside", "blks").distinct(), "jaccard-hits")
        asks = hits.filter("outside").withColumn("at", F.explode("blks")).filter("at <> blk").select("grp", "at", "id", "component").distinct()
        asks = stage(asks, "jaccard-asks")
        chunks = asks.groupBy("grp", "at").agg(F.ceil(F.count(F.lit(1)) / (8 * block)).alias("chunks"))
        chunks = stage(chunks, "jaccard-chunks")
        every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))
        sent = asks.join(chunks, ["grp", "at"]).select("id", "grp", "at", "component", F.pmod(F.xxhash64("id"), F.col("chunks")).alias("chunk"), F.lit(True).alias("asks"))
        sent = sent.unionByName(hits.select("id", "grp", F.col("blk").alias("at"), "component").distinct().join(chunks, ["grp", "at"]).select("id", "grp", "at", "component", every.alias("chunk"), F.lit(False).alias("asks")))

        def sift_block(pdf: pd.DataFrame) -> pd.DataFrame:
            some, group = (x.drop_duplicates(["id", "low"]) for x in (pdf[pdf["asks"]], pdf[~pdf["asks"]]))
            if len(group) and len(some):
                of = [([np.frombuffer(b, np.uint32) for b in x["low"]], x["n"].to_numpy(), x["component"].to_numpy()) for x in (some, group)]
                one, other = _hopeful(*of[0], *of[1], percent)
                pdf = pd.concat([some[one], group[other]]).drop_duplicates(["id", "asks"])
            else:
                pdf = pdf[:0]
            return pdf[["id", "grp", "at", "component", "chunk", "asks"]]

        kept = "id bigint, grp bigint, at bigint, component bigint, chunk bigint, asks boolean"
        sent = sent.join(lows, "id").groupBy("grp", "at", "chunk").applyInPandas(lean_group(sift_block), kept)
        sent = stage(sent, "jaccard-sent")
        texts = sifted(stored.filter("blocks > 1").select("id", "blob"), sent, "id").filter("_may").drop("_may")

        def open_block(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            some, group = (x.drop_duplicates(["id", "blob"]) for x in (pdf[pdf["asks"]], pdf[~pdf["asks"]]))
            if len(group) and len(some):
                members_, ids = _sets(group["blob"].tolist(), words), group["id"].tolist()
                union = np.unique(np.concatenate(members_))
                queries = _sets(some["blob"].tolist(), words)
                names = some["id"].tolist()
                # a link needs |q & s| >= percent/100 * |q | s| >= percent/100 * |q|, and q & s lies in the union
                bound = [100 * int(np.isin(q, union, assume_unique=True).sum()) >= percent * len(q) for q in queries]
                opened = [i for i, ok in enumerate(bound) if ok]
                parts, own = some["component"].tolist(), group["component"].tolist()
                for i in range(0, len(opened), BLOCK):
                    part = opened[i:i + BLOCK]
                    pairs = _joining([queries[k] for k in part], [parts[k] for k in part], members_, own, sketch.value, percent)
                    out += [(names[part[x]], ids[y]) for x, y in pairs]
            return pd.DataFrame(out, columns=["a", "b"])

        later = sent.join(texts, "id").groupBy("grp", "at", "chunk").applyInPandas(lean_group(open_block), kinds)
        found = found.unionByName(stage(later, "jaccard-later"))
        drop_staged(named, top, prefixed, met, hits, asks, chunks, sent)
    drop_staged(stored, members, counts, placed)

    # one id under several sets is one node: the class of each of its sets is tied to it, and its rows without words are answered alike
    filled = sets.filter("id is not null").select("id", "n", F.struct("n", "s1", "s2").alias("set"))
    shared = filled.groupBy("id").agg(F.min("set").alias("lo"), F.max("set").alias("hi"), F.count(F.lit(1)).alias("rows"),
                                      F.count_if(F.col("n") == 0).alias("blank")).filter("lo <> hi")
    shared = stage(shared.select("id", "rows", "blank", F.lit(True).alias("shared")), "jaccard-shared")
    repeats = not shared.isEmpty()
    if repeats:
        several = join_by_key(filled.filter("n > 0"), shared.drop("blank"), "id", "rows", F.xxhash64("set")).filter("shared")
        several = stage(several.select("id", "set").distinct(), "jaccard-several")
        firsts = several.groupBy("set").agg(F.count(F.lit(1)).alias("ids")).join(classes.select("set", "first"), "set")
        tied = join_by_key(several, stage(firsts, "jaccard-firsts"), "set", "ids", F.col("id"))
        found = found.unionByName(tied.select(F.col("first").alias("a"), F.col("id").alias("b")))

    linked = components(found)
    answered = classes.join(linked.withColumnRenamed("node", "first"), "first", "left").withColumn("component_id", F.coalesce("component", "first")).select("set", "component_id", "rows")
    out = sets.withColumn("set", F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.struct("n", "s1", "s2")))
    out = join_by_key(out, stage(answered, "jaccard-answers"), "set", "rows", F.col("id"))
    if repeats:
        blank = shared.filter("blank > 0").select("id", "blank").join(linked.withColumnRenamed("node", "id"), "id")
        empty = join_by_key(out.filter("n = 0"), stage(blank, "jaccard-blank"), "id", "blank", F.monotonically_increasing_id())
        out = out.filter("n > 0").unionByName(empty.withColumn("component_id", F.col("component")).drop("component"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """The result of the Jaccard query: shingles of four words, similarity of 85 % or more."""
    return join(documents.select("doc_id", "text"))
