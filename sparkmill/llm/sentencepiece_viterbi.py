"""SentencePiece encoding and decoding: batched numpy Viterbi over the lattice of pieces.

A text is cut into words at spaces (exact when no piece holds a space mark after
another character; a model that breaks this is encoded text by text).  The
distinct words of a batch that have equal length advance together, one position
at a time: hashes of all substrings probe the sorted hashes of the pieces, the
best edge into each position is a vectorised maximum, and its length is the back
pointer.

Unigram models maximise the sum of piece scores.  Merge (BPE) models are no
best-path problem by their scores; there an edge is admitted only if the piece
before it and the edge's piece stay as they are when their characters are merged
by rank.  Merging is local in this sense: a sequence of pieces is the encoding of
a word exactly if every piece and every two neighbours encode to themselves.  So
exactly one edge is admitted at each position, and the maximum finds it.  The
ids equal those of the public library for both model types.

The model file is read on the driver and travels in the tasks (a vocabulary,
bounded); executors need no copy of the file.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkmill.llm.common import ship

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNIGRAM, BPE = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
#: Characters of text that a task encodes at a time, cells of the lattice held at a time, words remembered.
BATCH_CHARS, CELLS, KEPT_WORDS = 3_000_000, 250_000, 300_000
#: Pairs of pieces are remembered in 2 ** PAIR_BITS slots, a new pair taking the place of the old one.
PAIR_BITS = 21
#: Words longer than this are walked one by one, their lattice still probed at once.
LONG = 64
_MULT = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Model:
    kind: int
    pieces: list[str]
    scores: np.ndarray
    types: list[int]
    dummy_prefix: bool
    known: dict = field(default_factory=dict)
    #: Words remembered from batch to batch.
    most: int = KEPT_WORDS

    def __post_init__(self):
        self.known = {p: i for i, p in enumerate(self.pieces) if self.types[i] in (_NORMAL, _USER)}
        self.bytes_ = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.types[i] == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes_.items()}
        self.unknown = next((i for i, t in enumerate(self.types) if t == _UNKNOWN), 0)
        self.widest = max(map(len, self.known), default=1)
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.known)
        self.unknown_score = float(min((self.scores[i] for i in self.known.values()), default=0.0)) - 10.0
        self.keys, self.ids = [], []
        for n in range(1, self.widest + 1):
            some = [p for p in self.known if len(p) == n and (self.kind != BPE or merge(self, p) == [p])]
            codes = np.array([[ord(c) for c in p] for p in some], dtype=np.uint64).reshape(len(some), n)
            h = _hash(codes, n)[:, 0] if some else np.zeros(0, np.uint64)
            if len(np.unique(h)) != len(h):
                raise ValueError("two pieces share a hash")
            order = np.argsort(h)
            self.keys.append(h[order])
            self.ids.append(np.array([self.known[p] for p in some], dtype=np.int32)[order] if some else np.zeros(0, np.int32))
        if self.kind == BPE:
            self._halve()
        self.lattice_words: dict[str, bytes] = {}
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.raw = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() if t in (_NORMAL, _USER) else None
                    for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True))]

    def _halve(self) -> None:
        """Ranks of the merges, the two halves each piece is last merged from, and which two pieces merge.

        A piece is ``plain`` if ranks rise on the way to it and no other piece has its rank; a character is.
        """
        n, known, joins = len(self.pieces), self.known, {}
        some = sorted((i for i in known.values() if len(self.pieces[i]) > 1), key=lambda i: len(self.pieces[i]))
        self.rank = np.full(n, -1, np.int64)  # a character is there from the start
        _, rank, times = np.unique(-self.scores[some], return_inverse=True, return_counts=True)
        self.rank[some] = rank
        self.left, self.right, self.plain = np.full(n, -1, np.int64), np.full(n, -1, np.int64), self.rank < 0
        for i, r, alone in zip(some, rank.tolist(), (times == 1)[rank].tolist(), strict=True):
            p = self.pieces[i]
            for k in range(1, len(p)):
                if (x := known.get(p[:k])) is not None and (y := known.get(p[k:])) is not None:
                    joins[x * n + y] = r
            halves = [known.get(x, -1) for x in merge(self, p, 2)]
            if len(halves) == 2 and min(halves) >= 0:
                self.left[i], self.right[i] = halves
                self.plain[i] = alone and self.plain[halves].all() and self.rank[halves].max() < r
        self.joins = np.array(sorted(joins) or [-1], dtype=np.int64)
        self.join_rank = np.array([joins.get(k, 0) for k in self.joins.tolist()], dtype=np.int64)


def load(path: str = MODEL) -> Model:
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if proto.trainer_spec.model_type not in (UNIGRAM, BPE) or spec.precompiled_charsmap or spec.remove_extra_whitespaces or \
            any(p.type in (_USER, _UNUSED) for p in proto.pieces):
        raise ValueError("only unigram and merge models without normalisation rules, user-defined and unused pieces are supported")
    return Model(proto.trainer_spec.model_type, [p.piece for p in proto.pieces], np.array([p.score for p in proto.pieces], dtype=np.float32),
                 [p.type for p in proto.pieces], spec.add_dummy_prefix)


def _hash(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all substrings of ``n`` characters of each row."""
    w = codes.shape[1] - n + 1
    h = np.zeros((len(codes), max(w, 0)), np.uint64)
    for k in range(n):
        h = (h ^ codes[:, k:k + w]) * _MULT
        h ^= h >> np.uint64(29)
    return h


def merge(model: Model, word: str, least: int = 1) -> list[str]:
    """Merging by rank, to ``least`` parts: the neighbours whose piece has the highest score merge first, the leftmost of equals."""
    parts = list(word)
    while len(parts) > least:
        best, at = None, -1
        for i, pair in enumerate(zip(parts, parts[1:])):
            k = model.known.get(pair[0] + pair[1])
            if k is not None and (best is None or model.scores[k] > best):
                best, at = model.scores[k], i
        if at < 0:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


def _apart(model: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the characters of two pieces, each its own encoding, merge to these two: last merges are undone one by one.

    The pieces that touch at the border stood side by side until the later of them was merged
    further.  If their own merge has a lower rank than that, it came first (at equal rank the left one).
    """
    a, b = left.astype(np.int64), right.astype(np.int64)
    out, p = np.ones(len(a), bool), model.pieces
    for i in np.flatnonzero(~(model.plain[a] & model.plain[b])).tolist():  # runs of spaces
        out[i] = merge(model, p[a[i]] + p[b[i]]) == [p[a[i]], p[b[i]]]
    live = np.flatnonzero(model.plain[a] & model.plain[b])
    a, b, limit = a[live], b[live], np.full(len(live), len(p))
    while len(live):
        key = a * len(p) + b
        at = np.minimum(np.searchsorted(model.joins, key), len(model.joins) - 1)
        joined = (model.joins[at] == key) & (model.join_rank[at] < limit)
        out[live[joined]] = False
        go = ~joined & ((model.rank[a] >= 0) | (model.rank[b] >= 0))
        a, b, live = a[go], b[go], live[go]
        ra, rb = model.rank[a], model.rank[b]
        first = ra > rb
        limit = np.where(first, ra, rb + 1)
        a, b = np.where(first, model.right[a], a), np.where(first, b, model.left[b])
    return out


def _stay_apart(model: Model, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether each two neighbouring pieces encode to themselves; unknown characters (-1) touch nothing."""
    out = np.ones(len(left), bool)
    real = np.flatnonzero((left >= 0) & (right >= 0))
    if not len(real):
        return out
    key = left[real].astype(np.int64) * len(model.pieces) + right[real]
    slot = ((key.astype(np.uint64) * _MULT) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
    keys, vals = model.pairs
    got = vals[slot]
    if (missed := np.flatnonzero(keys[slot] != key)).size:
        new, back = np.unique(key[missed], return_inverse=True)
        got[missed] = _apart(model, *np.divmod(new, len(model.pieces)))[back]
        keys[slot[missed]], vals[slot[missed]] = key[missed], got[missed]  # of several keys in a slot the last stays
    out[real] = got
    return out


def _probe(model: Model, codes: np.ndarray) -> np.ndarray:
    """(words, starts, lengths) piece ids, -1 where a substring is no piece."""
    k, n = codes.shape
    found = np.full((k, n, min(model.widest, n)), -1, np.int32)
    for size in range(1, found.shape[2] + 1):
        keys, ids = model.keys[size - 1], model.ids[size - 1]
        if len(keys):
            h = _hash(codes, size)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found[:, :n - size + 1, size - 1] = np.where(keys[at] == h, ids[at], -1)
    return found


def _advance(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids (-1 - code point for an unknown character) of words of equal length, one after the other, and how many each has."""
    n = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), n)
    found = _probe(model, codes.astype(np.uint64))
    k, widest = len(words), found.shape[2]
    rows = np.arange(k)
    last = np.full((k, n + 1), -1, np.int32)  # piece that ends here
    step = np.zeros((k, n + 1), np.int32)  # its length: the back pointer
    best = np.full((k, n + 1), -np.inf, np.float32)
    best[:, 0] = 0
    for i in range(1, n + 1):
        m = min(widest, i)
        size = np.arange(1, m + 1)
        ids = found[:, i - size, size - 1]
        if model.kind == UNIGRAM:
            score = np.where(ids >= 0, model.scores[ids], -np.inf)
            score[:, 0] = np.where(ids[:, 0] >= 0, score[:, 0], model.unknown_score)
            total = best[:, i - size] + score
        else:
            ok = ids >= 0
            w, c = np.nonzero(ok)
            left = np.where(i - size[c] > 0, last[w, i - size[c]], -1)
            ok[w, c] = _stay_apart(model, left, ids[w, c])
            total = np.where(ok, np.float32(0), np.float32(-np.inf))
            alone = ids[:, 0] < 0  # an unknown character merges with nothing
            total[alone, 0] = np.maximum(total[alone, 0], -1.0)
        pick = m - 1 - np.argmax(total[:, ::-1], axis=1)  # the earliest start among equals
        step[:, i], best[:, i], last[:, i] = size[pick], total[rows, pick], ids[rows, pick]
    last = np.where(last[:, 1:] >= 0, last[:, 1:], -1 - codes.astype(np.int64))
    # back from the ends of all words, filling rows from the right
    ids, at, live = np.zeros((k, n), np.int64), np.full(k, n), rows
    used = np.zeros(k, np.int64)
    for column in range(n - 1, -1, -1):
        ids[live, column] = last[live, at[live] - 1]
        at[live] -= step[live, at[live]]
        used[live] += 1
        live = live[at[live] > 0]
        if not len(live):
            break
    return ids[np.arange(n) >= n - used[:, None]], used


def _walk(model: Model, word: str) -> list[int]:
    """A long word: probed at once in pieces of bounded size, walked position by position."""
    n, piece = len(word), 4096
    last, step, best = [-1] * (n + 1), [0] * (n + 1), [0.0] + [-np.inf] * n
    apart: dict[tuple[int, int], bool] = {}
    for start in range(0, n, piece):
        part = word[start:start + piece + model.widest - 1]
        found = _probe(model, np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)[None])[0]
        for j in range(start, min(start + piece, n)):  # edges out of j; all edges into j are done
            ids = found[j - start]
            for s in np.flatnonzero(ids >= 0).tolist() or [0]:
                t, i = int(ids[s]), j + s + 1
                if model.kind == UNIGRAM:
                    total = best[j] + (model.scores[t] if t >= 0 else model.unknown_score)
                    if total > best[i]:
                        best[i], step[i], last[i] = total, s + 1, t
                else:
                    pair = (last[j] if j else -1, t)
                    if min(pair) >= 0 and pair not in apart:
                        apart[pair] = merge(model, model.pieces[pair[0]] + model.pieces[t]) == [model.pieces[pair[0]], model.pieces[t]]
                    if apart.get(pair, True):
                        step[i], last[i] = s + 1, t
            if model.kind == UNIGRAM and ids[0] < 0 and best[j] + model.unknown_score > best[j + 1]:
                best[j + 1], step[j + 1], last[j + 1] = best[j] + model.unknown_score, 1, -1
            if model.kind == BPE and ids[0] < 0 and not step[j + 1]:
                step[j + 1], last[j + 1] = 1, -1
    i, ids = n, []
    while i > 0:
        ids.append(last[i] if last[i] >= 0 else -1 - ord(word[i - 1]))
        i -= step[i]
    return ids[::-1]


def _finish(model: Model, ids: list[int]) -> bytes:
    """The ids as packed 32-bit integers; unknown characters as their UTF-8 bytes, or as one unknown piece a run."""
    if min(ids, default=0) >= 0:
        return array("i", ids).tobytes()
    out: list[int] = []
    for i in ids:
        if i >= 0:
            out.append(i)
        elif model.bytes_:
            out += [model.bytes_[b] for b in chr(-1 - i).encode()]
        elif not out or out[-1] != model.unknown:
            out.append(model.unknown)
    return array("i", out).tobytes()


_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def encode_batch(model: Model, texts: list[str | None]) -> list[np.ndarray | None]:
    """Piece ids of each text; null for null, none for the empty text."""
    cut = []
    for t in texts:
        t = (SPACE if model.dummy_prefix else "") + t.replace(" ", SPACE) if t else ""
        cut.append(_WORD.findall(t) if model.splits else [t] if t else [])
    kept = model.lattice_words
    if len(kept) > model.most:
        kept.clear()
    by_length: dict[int, list[str]] = {}
    for w in {w for words in cut for w in words if w not in kept}:
        by_length.setdefault(len(w), []).append(w)
    for n, words in by_length.items():
        if n > LONG:
            for w in words:
                kept[w] = _finish(model, _walk(model, w))
            continue
        size = max(1, CELLS // n)
        for i in range(0, len(words), size):
            some = words[i:i + size]
            ids, used = _advance(model, some)
            ends = np.cumsum(used).tolist()
            if ids.min() >= 0:
                raw = ids.astype(np.int32).tobytes()
                kept.update((w, raw[4 * a:4 * b]) for w, a, b in zip(some, [0, *ends], ends))
            else:
                ids = ids.tolist()
                kept.update((w, _finish(model, ids[a:b])) for w, a, b in zip(some, [0, *ends], ends))
    out: list[np.ndarray | None] = []
    for t, words in zip(texts, cut, strict=True):
        ids = np.frombuffer(b"".join([kept[w] for w in words]), dtype=np.int32)
        out.append(None if t is None else _join_unknown(model, ids))
    return out


def _join_unknown(model: Model, ids: np.ndarray) -> np.ndarray:
    """Runs of unknown pieces become one where a model has no byte pieces."""
    if model.bytes_ or len(ids) < 2:
        return ids
    return ids[np.r_[True, (ids[1:] != model.unknown) | (ids[:-1] != model.unknown)]]


def decode_ids(model: Model, ids) -> str | None:
    """The text of piece ids: bytes joined to characters (each invalid byte as U+FFFD), the first space dropped."""
    if ids is None:
        return None
    ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
    try:
        text = b"".join([model.raw[i] for i in ids]).decode()
    except (UnicodeDecodeError, TypeError):  # broken bytes, or pieces that stand for no text
        text = _decode_broken(model, ids)
    lead = next((i for i in ids if model.types[i] != _CONTROL), None)
    return text[1:] if model.dummy_prefix and lead is not None and model.pieces[lead].startswith(SPACE) else text


def _decode_broken(model: Model, ids: list[int]) -> str:
    parts, raw = [], bytearray()

    def flush():
        while raw:
            try:
                parts.append(raw.decode())
                raw.clear()
            except UnicodeDecodeError as e:
                parts.append(raw[:e.start].decode() + "\ufffd")
                del raw[:e.start + 1]

    for i in ids:
        if i in model.byte_of:
            raw.append(model.byte_of[i])
            continue
        flush()
        parts.append(" \u2047 " if model.types[i] == _UNKNOWN else (model.raw[i] or b"").decode())
    flush()
    return "".join(parts)


_MODELS: dict[str, Model] = {}


def _model(state: tuple) -> Model:
    """One model, with its memories, per Python worker."""
    key = f"{state[0]} {len(state[1])} {hash(tuple(state[1]))} {hash(state[2].tobytes())}"
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(*state)
    return _MODELS[key]


def forget() -> bool:
    """Free the worker's model with the words and pairs it remembers (whether there was one); the next task builds it anew."""
    had = bool(_MODELS)
    _MODELS.clear()
    return had


def _groups(texts):
    """Slices of about BATCH_CHARS characters."""
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BATCH_CHARS:
            yield texts[at:i + 1]
            at, chars = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def encode(docs: DataFrame, path: str = MODEL, column: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array<int>, null for a null text, empty for an empty one).

    A column named ``ids`` is replaced; all others are kept.  Whole texts are encoded.
    """
    ship(docs.sparkSession)
    m = load(path)
    state = (m.kind, m.pieces, m.scores, m.types, m.dummy_prefix)
    docs = docs.drop("ids")

    def run(batches):
        model = None
        for b in batches:
            model = model or _model(state)
            at = b.schema.get_field_index(column)
            done = 0
            for texts in _groups(b.column(at).to_pylist()):
                ids = pa.array(encode_batch(model, texts), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.slice(done, len(texts)).columns, ids], [*b.schema.names, "ids"])
                done += len(texts)

    return docs.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in docs.dtypes) + ", ids array<int>")


def decode(rows: DataFrame, path: str = MODEL, column: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``column``; null for null.  An id outside the vocabulary is an error."""
    ship(rows.sparkSession)
    m = load(path)
    state = (m.kind, m.pieces, m.scores, m.types, m.dummy_prefix)
    rows = rows.drop(into)

    def run(batches):
        model = None
        for b in batches:
            model = model or _model(state)
            at = b.schema.get_field_index(column)
            for i in range(0, max(b.num_rows, 1), 500):
                part = b.slice(i, 500)
                text = [decode_ids(model, ids) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], [*b.schema.names, into])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + f", `{into}` string")


def token_rows(documents: DataFrame, path: str = MODEL, kept_words: int = KEPT_WORDS) -> DataFrame:
    """The result of the tokens query: ids of each whole text, their number, and whether decoding gives the text back.

    The space mark itself decodes to a space, as in the public library.  A null
    text has null ids and no tokens, and comes back as null.  Rows are answered one by one,
    also where ids repeat or are null; an empty table gives no rows.  A worker remembers
    ``kept_words`` words at most, which takes memory and saves time.
    """
    ship(documents.sparkSession)
    m = load(path)
    state = (m.kind, m.pieces, m.scores, m.types, m.dummy_prefix)

    def run(batches):
        model = None
        for b in batches:
            model = model or _model(state)
            model.most = kept_words
            done = 0
            for texts in _groups(b.column(1).to_pylist()):
                ids = encode_batch(model, texts)
                same = [decode_ids(model, i) == (t if t is None else t.replace(SPACE, " ")) for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(done, len(texts)), pa.array([0 if i is None else len(i) for i in ids], pa.int64()),
                     pa.array(ids, pa.list_(pa.int32())), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"])
                done += len(texts)

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids array<int>, round_trip boolean")
