"""Jaccard components against brute force."""

import random
import re

import numpy as np
import pytest

from sparkmill.llm import jaccard as J
from sparkmill.llm.common import sifted


def sets(rows, words=4):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append((i, {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()))
    return out


def brute(rows, words=4, percent=85):
    data, root = sets(rows, words), {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(data):
        for j, b in data[:k]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in data), key=str)


def corpus(seed, n=120):
    r = random.Random(seed)
    word = lambda: r.choice(["thon", "é", "ing", "the", "of", "x"]) + str(r.randrange(40))
    rows, line = [], "a very common line stands here for all to see and share"
    for f in range(n // 6):
        text = [word() for _ in range(r.choice([1, 3, 4, 5, 8, 12, 20, 40, 90, 200]))]
        for c in range(6):
            t = list(text)
            for _ in range(r.randrange(0, 1 + len(t) // 25 + (c > 3))):
                t[r.randrange(len(t))] = word()
            rows.append((f * 10 + c, (line + "\n" if f % 3 == 0 else "") + "  ".join(t)))
    rows += [(9000, None), (9001, ""), (9002, " \n\t"), (9003, "One two"), (9004, "one\x0btwo"), (9005, "one two three"), (None, "one two"), (9006, rows[0][1].upper())]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, id int, grp string").repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    assert sorted((tuple(r) for r in J.near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_many_blocks(spark):
    """A family whose members link in chains, dealt over many blocks."""
    r = random.Random(3)
    text, rows = [f"w{k}" for k in range(120)], []
    for i in range(90):
        rows.append((i * 2, " ".join(text)))
        text[r.randrange(120)] = f"new{i}"
    r.shuffle(rows)
    got = J.join(frame(spark, rows).select("doc_id", "text"), block=8).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows)


def test_two_linking_sets_share_a_signature():
    r = np.random.default_rng(0)
    seen = r.integers(0, 4, 1 << J.SKETCH_BITS).astype(np.uint32)
    for _ in range(400):
        n = int(r.integers(1, 400))
        a = r.integers(1, 2**63, n, dtype=np.uint64)
        b = a.copy()
        cut = int(r.integers(0, max(1, int(0.17 * n)) + 1))
        b = b[cut:] if r.random() < 0.5 else np.r_[b[cut // 2:], r.integers(1, 2**63, cut // 2, dtype=np.uint64)]
        inside = len(np.intersect1d(a, b))
        if not len(b) or 100 * inside < 85 * len(np.union1d(a, b)):
            continue
        doc, h = np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[np.sort(a), np.sort(b)]
        sig, d = J.signatures(doc, h, np.array([len(a), len(b)]), seen, 85)
        assert set(sig[d == 0].tolist()) & set(sig[d == 1].tolist())


def entries(sets, seen, percent=85):
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    return J.signatures(doc, np.concatenate(sets), np.array([len(x) for x in sets]), seen, percent)


def test_sets_that_share_single_shingles_do_not_meet():
    """Every set shares a tenth with the next one; a sketch that tells no shingle from another, as on a large corpus."""
    r = np.random.default_rng(11)
    pool = r.integers(1, 2**64, 40 * 270 + 30, dtype=np.uint64)
    sets = [np.unique(pool[k * 270:k * 270 + 300]) for k in range(40)]
    seen = np.full(1 << J.SKETCH_BITS, 60, np.uint32)
    sig, d = entries(sets, seen)
    assert len(np.unique(sig)) == len(sig)
    near = np.unique(np.r_[sets[0][15:], r.integers(1, 2**64, 10, dtype=np.uint64)])  # a real link still meets
    sig, d = entries([*sets, near], seen)
    both = set(sig[d == 40].tolist())
    assert [k for k in range(40) if both & set(sig[d == k].tolist())] == [0]


def test_sets_that_share_a_common_passage_do_not_meet():
    r = np.random.default_rng(12)
    passage = r.integers(1, 2**64, 200, dtype=np.uint64)
    sets = [np.unique(np.r_[passage, r.integers(1, 2**64, 300, dtype=np.uint64)]) for _ in range(30)]
    seen = np.full(1 << J.SKETCH_BITS, 60, np.uint32)
    seen[J._place(passage)] = 3000
    sig, d = entries(sets, seen)
    assert len(np.unique(sig)) == len(sig)


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_linking_sets_of_any_size_share_a_signature(percent):
    """Sets of a few shingles as well, whose shingles may all fall into few parts, and sets at the very threshold."""
    r = np.random.default_rng(percent)
    seen = r.integers(0, 3, 1 << J.SKETCH_BITS).astype(np.uint32)
    linked = 0
    for k in range(1500):
        a = np.unique(r.integers(1, 2 ** (64 if k % 3 else 61), int(r.integers(1, 60)), dtype=np.uint64))
        spare = len(a) * (100 - percent) // 100
        gone = int(r.integers(0, spare + 1))
        b = np.unique(np.r_[r.permutation(a)[gone:], r.integers(1, 2**64, int(r.integers(0, spare - gone + 1)), dtype=np.uint64)])
        if len(b) and 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
            sig, d = entries([a, b], seen, percent)
            linked += 1
            assert set(sig[d == 0].tolist()) & set(sig[d == 1].tolist())
    assert linked > 500


def test_empty(spark):
    assert J.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in J.near_duplicates(frame(spark, [(1, None)])).collect()] == [(1, 0, 1)]


def test_chains_hold_all_pairs_of_near_size():
    """Entries dealt over batches and chained in two steps, as in the join."""
    r = np.random.default_rng(5)
    gap = J.gap(85)
    for _ in range(50):
        sig = r.integers(0, 4, 200).astype(np.uint64)
        level, owner = r.integers(0, 400, 200), np.arange(200)
        batch = r.integers(0, 5, 200)
        edges, sent = [], []
        for k in range(5):
            some = np.flatnonzero(batch == k)
            order, chain, (lo, hi, head, at) = J.chains(sig[some], level[some], level[some], owner[some], 85)
            edges += zip(*J._met(order, chain, head, owner[some]), strict=True)
            sent.append((sig[some][at], lo, hi, head))
        s, lo, hi, ids = (np.concatenate(x) for x in zip(*sent, strict=True))
        order, chain, (_, _, head, _) = J.chains(s, lo, hi, ids, 85)
        edges += zip(*J._met(order, chain, head, ids), strict=True)
        root = {i: i for i in range(200)}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            root[find(int(a))] = find(int(b))
        for i in range(200):
            for j in np.flatnonzero((sig == sig[i]) & (abs(level - level[i]) <= gap)):
                assert find(i) == find(int(j))


def test_levels_of_linking_sizes():
    n = np.arange(1, 5000)
    for m in (1, 2, 7, 100, 4999):
        near = n[(100 * np.minimum(n, m) >= 85 * np.maximum(n, m))]
        assert (abs(J.levels(near) - J.levels(np.array([m]))) <= J.gap(85)).all()


def test_one_id_with_two_sets(spark):
    rows = [(1, "a b c d e f"), (1, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u"), (4, "p q r s t v"), (5, "p q r s t u")]
    assert sorted((tuple(r) for r in J.near_duplicates(frame(spark, rows)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_joining_connects_what_all_links_connect(seed):
    r = np.random.default_rng(seed)
    bases = [np.sort(r.choice(1 << 40, int(r.integers(20, 90)), replace=False)) for _ in range(6)]
    sets = [np.unique(np.r_[r.permutation(b)[:len(b) - r.integers(0, 9)], r.integers(1, 1 << 40, r.integers(0, 5))]).astype(np.uint64) << np.uint64(23) for b in bases for _ in range(12)]
    q, m = list(range(0, 72, 2)), list(range(1, 72, 2))
    seen = r.integers(0, 4, 1 << J.SKETCH_BITS).astype(np.uint32)
    got = J._joining([sets[i] for i in q], q, [sets[j] for j in m], m, seen, 85)

    def parts(pairs):
        root = list(range(72))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    links = [(i, j) for i in q for j in m if 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j]))]
    assert links and parts((q[i], m[j]) for i, j in got) == parts(links)


def test_a_shared_id_that_is_not_the_smallest(spark):
    a, b, c = "a b c d e f", "p q r s t u", "k l m n o p"
    rows = [(3, a), (7, a), (7, b), (5, b), (9, b), (9, c), (8, c), (2, "x y z w v u"), (None, c), (7, None)]
    got = sorted((tuple(r) for r in J.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 3, 3), (7, 3, 3), (7, 3, 3), (5, 3, 3), (9, 3, 3), (9, 3, 3), (8, 3, 3), (2, 3, 2), (None, 3, None), (7, 0, 3)], key=str)


def test_components_of_a_hub_are_joined_in_pieces(spark, monkeypatch):
    from sparkmill.llm import common

    pieces, join = [], common.join_by_key

    def spy(left, right, key, n, spread, total=None):
        pieces.append(right.agg({n: "max"}).first()[0])
        return join(left, right, key, n, spread, total)

    monkeypatch.setattr(common, "join_by_key", spy)
    star, tail = [(1, k) for k in range(2, 3002)], [(3001, 4000), (4000, 5000), (7000, 6000)]
    edges = spark.createDataFrame(star + tail, "a bigint, b bigint")
    got = {tuple(r) for r in common.components(edges).collect()}
    assert got == {(k, 1) for k in [*range(1, 3002), 4000, 5000]} | {(6000, 6000), (7000, 6000)}
    assert max(pieces) >= 3000  # the hub's links went through the salted join


def test_samples_send_what_may_link_and_little_else():
    r = np.random.default_rng(5)
    hashes = lambda n: r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
    shared = hashes(200)  # a passage of all documents, far below the similarity of a link
    own = [hashes(500) for _ in range(24)]
    sets = [np.unique(np.r_[shared, x]) for x in own]
    near = [np.unique(np.r_[x[:len(x) - 30], hashes(10)]) for x in sets[:4]]  # 670 of 710 shared
    far = [np.unique(np.r_[shared, hashes(500)]) for _ in range(20)]
    q, m = sets, near + far
    low = lambda some: [J._low(x) for x in some]
    size = lambda some: np.array([len(x) for x in some])
    one, other = J._hopeful(low(q), size(q), np.arange(24), low(m), size(m), np.arange(24, 48), 85, block=5)
    assert np.flatnonzero(one).tolist() == [0, 1, 2, 3] and np.flatnonzero(other).tolist() == [0, 1, 2, 3]
    one, other = J._hopeful(low(q), size(q), np.arange(24), low(m), size(m), np.r_[0:4, 24:44], 85)  # connected already
    assert not one.any() and not other.any()


def test_sieve_keeps_every_key_it_was_given(spark):
    rows = spark.range(3000).selectExpr("if(id % 50 = 0, null, id) as k", "id as v").unionByName(spark.range(10).selectExpr("id as k", "-id as v"))
    got = sifted(rows, spark.range(0, 3000, 30).selectExpr("id as k"), "k")
    assert got.columns == ["k", "v", "_may"] and got.count() == 3010
    assert got.filter("k % 30 = 0 and not _may").isEmpty() and got.filter("_may").count() < 250
    assert sifted(rows, rows.filter("false"), "k").filter("_may").isEmpty()
