"""Phrase collocations by prefix-free parsing.

Parse.  Texts are split into pieces and words; within a piece the words whose hash
ends in zeros (or, without one, every MAX_OWN words) begin a new chunk.  A chunk
carries the next words of its piece, one fewer than the longest phrase has, so chunks
overlap and every phrase lies whole in the chunk in which it begins.  Equal chunks of a
language are one entry of the dictionary, with its number of occurrences as weight.

Count.  Phrases are counted inside the distinct chunks only, with the chunk's weight;
a phrase that begins among the overlapping words belongs to the next chunk, so each is
counted once.  Lengths are counted one after the other, each twice: first by 64-bit
hash, eight bytes a phrase, then as strings, for the hashes that reach the least count
only.  A phrase can only reach it if both phrases one word shorter do; others are
not even hashed out.  What reached it is kept as bits of a filter of FILTER_BITS, a fixed
size: shared bits and equal hashes only let phrases through that the count of
strings then refuses, so every count is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm.common import ship, stage

#: One word in TRIGGER begins a chunk; a chunk has MAX_OWN words of its own at most.
TRIGGER, MAX_OWN = 16, 64
#: Bits of the filter, a power of two; bytes of text or chunks that a task parses together.
FILTER_BITS, PARSE_BYTES = 1 << 27, 6_000_000
#: Pieces a language is dealt into before its phrases are ranked.
RANK_PIECES = 64
#: Classes of bytes: 0 word, 1 blank, 2 end of a piece; and A-Z in lower case.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a string or binary column; nulls are empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of a column of texts: distinct words, the id of each occurrence, its row, and whether it begins a piece."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        data, offsets = _bytes_of(texts)
        kind = _CLASS[data]
        word = kind == 0
        row_begins = np.zeros(len(data) + 1, bool)
        row_begins[offsets] = True
        row_begins = row_begins[: len(data)]
        before = np.concatenate([[False], word[:-1]])
        after = np.concatenate([word[1:], [False]])
        row_ends = np.concatenate([row_begins[1:], [True]])
        first = np.flatnonzero(word & (~before | row_begins))
        last = np.flatnonzero(word & (~after | row_ends))
        size = last - first + 1
        letters = _LOWER[data[word]] if lower else data[word]
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        column = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters))])
        coded = column.dictionary_encode()
        self.distinct, self.ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        self.row = np.searchsorted(offsets, first, "right") - 1
        pieces = np.cumsum(kind == 2)
        self.begins = np.ones(len(first), bool)
        if len(first):
            self.begins[1:] = (np.diff(pieces[first]) > 0) | (np.diff(self.row) > 0)

    def hashes(self) -> np.ndarray:
        return np.fromiter((xxhash.xxh64_intdigest(w) for w in self.distinct.to_pylist()), np.uint64, len(self.distinct))


def join_words(words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Strings of the words ``ids``, cut at ``ends``, joined by a space."""
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), words.take(pa.array(ids)).cast(pa.binary()))
    return pc.binary_join(lists, b" ")


def _positions(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each start, as many as size says."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)


def cut_chunks(words: Words, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, own words, words in all) of each chunk; all but the last ``most - 1`` words of a piece have followers."""
    n = len(words.ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    trigger = words.begins | (words.hashes() % np.uint64(TRIGGER) == 0)[words.ids]
    start = np.flatnonzero(trigger)
    place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
    start = np.flatnonzero(place % MAX_OWN == 0)
    own = np.diff(np.append(start, n))
    piece = np.flatnonzero(words.begins)
    piece_end = np.append(piece[1:], n)[np.searchsorted(piece, start, "right") - 1]
    return start, own, np.minimum(start + own + most - 1, piece_end) - start


def parse(docs: DataFrame, most: int = 3, lang: str = "lang", text: str = "text") -> DataFrame:
    """The dictionary: (lang, chunk, own, n) of the distinct chunks of all texts.  Written once.

    ``own`` words begin phrases here, the others are the overlap; n counts occurrences.
    """
    ship(docs.sparkSession)

    def chunks(langs: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        words = Words(texts)
        start, own, size = cut_chunks(words, most)
        ids = words.ids[_positions(start, size)]
        found = pa.table({"lang": langs.take(pa.array(words.row[start])), "chunk": join_words(words.distinct, ids, np.cumsum(size)), "own": pa.array(own)})
        found = found.group_by(["lang", "chunk", "own"]).aggregate([([], "count_all")])
        return pa.record_batch([found["lang"].combine_chunks().cast(pa.string()), found["chunk"].combine_chunks().cast(pa.binary()),
                                found["own"].combine_chunks().cast(pa.int32()), found["count_all"].combine_chunks()], ["lang", "chunk", "own", "n"])

    def run(batches):
        for langs, texts in _together(batches, 1, PARSE_BYTES):
            yield chunks(langs, texts)

    read = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).filter("text is not null and text != ''")
    found = read.mapInArrow(run, "lang string, chunk binary, own int, n bigint")
    return stage(found.groupBy("lang", "chunk", "own").agg(F.sum("n").alias("n")), "colloc-dictionary")


def _together(batches, column: int, most: int) -> Iterator[list[pa.Array]]:
    """Columns of consecutive rows whose ``column`` holds about ``most`` bytes; a longer value stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for whole in batches:
        at, ends = 0, np.cumsum(np.diff(_bytes_of(whole.column(column))[1]))
        while at < whole.num_rows:
            done = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, done + most - size, "right"))) if size < most else at
            if upto > at:
                held.append(whole.slice(at, upto - at))
                size, at = size + int(ends[upto - 1]) - done, upto
            if size >= most or at < whole.num_rows:
                yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(len(held[0].schema))]
                held, size = [], 0
    if held:
        yield [pa.concat_arrays([b.column(k) for b in held]) for k in range(len(held[0].schema))]


def _mix(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """Hash of a phrase's words followed by one more; whole numbers wrap."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + then
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Phrases:
    """The phrases of ``length`` words that begin among the own words of chunks: first word, language and hash of each."""

    def __init__(self, langs: pa.Array, chunks: pa.Array, own: np.ndarray, length: int):
        self.words, coded = Words(chunks, lower=False), langs.dictionary_encode()
        self.langs, self.lang_of, self.length = coded.dictionary, coded.indices.to_numpy().astype(np.int64), length
        size = np.bincount(self.words.row, minlength=len(own))
        place = np.arange(len(self.words.ids)) - np.repeat(np.cumsum(size) - size, size)
        self.at = np.flatnonzero((place < own[self.words.row]) & (place + length <= size[self.words.row]))
        self.hashes = self.words.hashes()
        self.seed = np.fromiter((xxhash.xxh64_intdigest(x.encode()) for x in self.langs.to_pylist()), np.uint64, len(self.langs))

    def hash(self, shift: int, size: int) -> np.ndarray:
        """Of each phrase, the hash of its language and of ``size`` words from its ``shift``-th on."""
        value = self.seed[self.lang_of[self.words.row[self.at]]]
        for k in range(size):
            value = _mix(value, self.hashes[self.words.ids[self.at + shift + k]])
        return value

    def keep(self, known: np.ndarray, shift: int, size: int) -> None:
        """Only phrases with the bit of these words set stay."""
        bit = (self.hash(shift, size) & np.uint64(32 * len(known) - 1)).astype(np.int64)
        self.at = self.at[(known[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1) == 1]


def hash_counts(dictionary: DataFrame, length: int, shorter: bytes | None) -> DataFrame:
    """(h, f) of the phrases of ``length`` words whose parts one word shorter pass ``shorter``, by hash."""
    sent = None if shorter is None else dictionary.sparkSession.sparkContext.broadcast(shorter)

    def run(batches):
        for langs, chunks, own, n in _together(batches, 1, PARSE_BYTES):
            found = Phrases(langs, chunks, own.to_numpy().astype(np.int64), length)
            for shift in (0, 1) if sent is not None else ():
                found.keep(np.frombuffer(sent.value, np.uint32), shift, length - 1)
            value, back = np.unique(found.hash(0, length), return_inverse=True)
            total = np.zeros(len(value), np.int64)
            np.add.at(total, back, n.to_numpy()[found.words.row[found.at]])
            yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(total)], ["h", "f"])

    return dictionary.select("lang", "chunk", "own", "n").mapInArrow(run, "h bigint, f bigint").groupBy("h").agg(F.sum("f").alias("f"))


def hash_filter(hashes: DataFrame) -> bytes:
    """FILTER_BITS bits, one set for each ``h``: of fixed size, whatever the rows."""
    bit = F.col("h").bitwiseAND(F.lit(FILTER_BITS - 1))
    one = F.expr(f"shiftleft(1L, cast((h & {FILTER_BITS - 1}L) & 31 as int))")
    rows = hashes.select(F.shiftright(bit, 5).alias("place"), one.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[rows["place"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return out.tobytes()


def count_phrases(dictionary: DataFrame, length: int, possible: bytes | None) -> DataFrame:
    """(lang, phrase, f, words) of the phrases of ``length`` words that pass ``possible``, counted as strings in the distinct chunks by weight."""
    sent = None if possible is None else dictionary.sparkSession.sparkContext.broadcast(possible)

    def run(batches):
        for langs, chunks, own, n in _together(batches, 1, PARSE_BYTES):
            found = Phrases(langs, chunks, own.to_numpy().astype(np.int64), length)
            if sent is not None:
                found.keep(np.frombuffer(sent.value, np.uint32), 0, length)
            words, at = found.words, found.at
            code, first = found.lang_of[words.row[at]], np.arange(len(at))
            for k in range(length):
                _, first, code = np.unique(code * len(words.distinct) + words.ids[at + k], return_index=True, return_inverse=True)
            total = np.zeros(len(first), np.int64)
            np.add.at(total, code, n.to_numpy()[words.row[at]])
            begin = at[first]
            phrase = join_words(words.distinct, words.ids[_positions(begin, np.full(len(begin), length))], np.arange(1, len(begin) + 1) * length)
            yield pa.record_batch([found.langs.take(pa.array(found.lang_of[words.row[begin]])).cast(pa.string()), phrase.cast(pa.binary()), pa.array(total)],
                                  ["lang", "phrase", "f"])

    found = dictionary.select("lang", "chunk", "own", "n").mapInArrow(run, "lang string, phrase binary, f bigint")
    return found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).withColumn("words", F.lit(length))


def candidates(docs: DataFrame, most: int = 3, least: int = 10, share: int = 50, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of the phrases that stay, unranked.

    Candidates have 2 to ``most`` words and a >= ``least`` occurrences in a language.
    Of the cuts of a candidate the one of the smallest score counts, then the shortest
    first part.  A candidate goes if a longer candidate holds its words in a row with
    100 * f(longer) >= share * a.
    """
    dictionary = parse(docs, most, lang, text)
    every = stage(count_phrases(dictionary, 1, None), "colloc-words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    levels = [every.filter(F.col("f") >= least)]
    # the words that reach the least count, read as a dictionary of one-word chunks
    words = levels[0].select("lang", F.col("phrase").alias("chunk"), F.lit(1).alias("own"), F.col("f").alias("n"))
    shorter = hash_filter(hash_counts(words, 1, None))
    for length in range(2, most + 1):
        shorter = hash_filter(hash_counts(dictionary, length, shorter).filter(F.col("f") >= least))
        levels.append(stage(count_phrases(dictionary, length, shorter).filter(F.col("f") >= least), f"colloc-{length}"))
    counts = levels[0]
    for level in levels[1:]:
        counts = counts.unionByName(level)
    counts = counts.withColumn("phrase", F.col("phrase").cast("string"))
    phrases = counts.filter("words > 1")
    # every part of a candidate that a cut makes, and every shorter phrase inside it
    words = F.split("phrase", " ", -1)
    part = lambda first, size: F.array_join(F.slice("w", first, size), " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), part(F.lit(1), k).alias("left"), part(k + 1, F.col("words") - k).alias("right")))
    cut = phrases.withColumn("w", words).withColumn("cut", F.explode(cuts)).select(
        "lang", "phrase", "words", F.col("f").alias("a"), "cut.*")
    known = counts.select(F.col("lang").alias("of"), F.col("phrase").alias("part"), F.col("f"))
    cut = cut.join(known, (F.col("lang") == F.col("of")) & (F.col("left") == F.col("part"))).drop("of", "part").withColumnRenamed("f", "l")
    cut = cut.join(known, (F.col("lang") == F.col("of")) & (F.col("right") == F.col("part"))).drop("of", "part").withColumnRenamed("f", "r")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r")}
    cut = cut.withColumn("million", F.lit(1000000).cast("decimal(7,0)")).withColumns({f"wide_{c}": x for c, x in wide.items()})
    cut = cut.withColumn("score", F.expr("(million * (wide_a * wide_a)) div (wide_l * wide_r)").cast("bigint"))
    lowest = cut.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # longer candidates cover shorter ones
    size = F.sequence(F.lit(2), F.col("words") - 1)
    inside = F.flatten(F.transform(size, lambda s: F.transform(F.sequence(F.lit(1), F.col("words") - s + 1), lambda first: part(first, s))))
    covered = phrases.filter("words > 2").withColumn("w", words).select("lang", F.explode(F.array_distinct(inside)).alias("phrase"), "f")
    covered = covered.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = lowest.join(covered, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * share))
    return kept.join(totals, "lang").select("lang", "phrase", "words", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, top: int = 2000, most: int = 3, least: int = 10, share: int = 50, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language by score, a and phrase.

    Words are runs of other than space and tab inside pieces, A-Z lowered; a null lang
    is ``und``; null, empty and wordless texts add nothing, repeated rows count each
    time.  Ties of score and a go to the smaller phrase in UTF-8 byte order, so ranks are
    gapless and unique.  Other columns of any name are left aside; an empty table gives
    no rows.  A language is ranked in RANK_PIECES pieces first, of which only the best
    ``top`` meet.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    dealt = candidates(docs, most, least, share, lang, text).withColumn("piece", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PIECES)))
    few = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "piece").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in SQL (128-bit products, so counts up to about 10 ** 16 are exact there).
SQL = r"""WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM p),
grams AS (
  SELECT lang, 1 AS words, unnest(ws) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w WHERE len(ws) >= 2
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) FROM w WHERE len(ws) >= 3),
f AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang),
c AS (SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE words > 1 AND f >= 10),
cuts AS (SELECT lang, phrase, a, k, array_to_string(s[1:k], ' ') AS x, array_to_string(s[k + 1:words], ' ') AS y FROM c, range(1, 3) AS r(k) WHERE k < words),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([array_to_string(s[1:2], ' '), array_to_string(s[2:3], ' ')]) AS part FROM c WHERE words = 3)
  GROUP BY lang, part),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside ON inside.lang = lowest.lang AND part = phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000"""
