"""CSV records of files that are read by many tasks each, quoted line breaks included.

A line break ends a record only outside quotes, and whether a byte range begins
inside quotes depends on everything before it.  Three passes, none of which orders
or gathers a file:

1. Each range says how it ends if it begins outside quotes and how if it begins inside
   (two candidate starts; a stray quote in an unquoted cell is text, so this is the
   state of a reader and not only the parity of quotes).
2. The ranges of a file, a few numbers each, are combined in order: every range learns
   whether it begins inside quotes, and in which range that record began.
3. Each range cuts its records.  Records that cross ranges come out as fragments,
   at most one at either end of a range; only these are shuffled and joined.

Cells are read as by Python's ``csv``: doubled quotes, text after a closing quote
kept, blank lines left out, an open quote at the end of a file ends there (before the
file's last line break).
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_QUOTED = re.compile(r'(?:[^"]|"")*')
#: Rows of an Arrow batch that become Python strings together.
SLICE = 4096
RECORDS = "file string, block bigint, pos bigint, cells array<string>, bad boolean, began bigint, text string"


def ends_inside(line: str, inside: bool) -> tuple[bool, bool]:
    """(whether the reader is inside quotes after ``line`` and its break, whether the record it began inside of has ended)."""
    if '"' not in line:
        return inside, False
    at, began_inside = 0, inside
    while True:
        if inside:
            at = _QUOTED.match(line, at).end()
            if at == len(line):
                return True, False
            at += 1  # past the closing quote; what follows up to a comma is text
            inside = False
        elif line[at: at + 1] == '"':
            at, inside = at + 1, True
            continue
        at = line.find(",", at)
        if at < 0:
            return False, began_inside
        at += 1


def parse_record(text: str) -> list[str] | None:
    """Cells of one record; None where a carriage return stands in an unquoted cell."""
    if '"' not in text and "\r" not in text[:-1]:
        text = text.removesuffix("\r")
        return text.split(",") if text else []
    csv.field_size_limit(2**31 - 1)
    try:
        return next(csv.reader([text]), [])
    except csv.Error:
        return None


def _summaries(batches) -> Iterator[pa.RecordBatch]:
    """(fkey, block, ends inside if begun outside, if begun inside, whether the latter's record ended) of each range."""
    now, state, done = None, [False, True, False], []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, blocks = (batch.column(k).to_numpy() for k in (0, 1))
        change = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (blocks[1:] != blocks[:-1])]))
        for lo, hi in zip(change.tolist(), [*change[1:].tolist(), batch.num_rows], strict=True):
            key = (int(keys[lo]), int(blocks[lo]))
            if key != now:
                if now is not None:
                    done.append((*now, *state))
                now, state = key, [False, True, False]
            for s in range(lo, hi, SLICE):
                for line in batch.column(2).slice(s, min(SLICE, hi - s)).drop_null().to_pylist():
                    state[0] = ends_inside(line, state[0])[0]
                    state[1], closed = ends_inside(line, state[1])
                    state[2] = state[2] or closed or not state[1]
    if now is not None:
        done.append((*now, *state))
    columns = list(zip(*done, strict=True)) or [[]] * 5
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["fkey", "block", "out", "into", "ended"])


def _combine(ranges: pd.DataFrame) -> pd.DataFrame:
    """Ranges of one file that begin inside quotes, and the range where that record began."""
    inside, began, found = False, 0, []
    for r in ranges.sort_values("block").itertuples():
        if inside:
            found.append((r.fkey, r.block, began))
            if r.into and r.ended:
                began = r.block
            inside = r.into
        elif r.out:
            inside, began = True, r.block
    return pd.DataFrame(found, columns=["fkey", "block", "began"]).astype("int64")


class _Range:
    """Records of one range, line by line."""

    def __init__(self, file: str, block: int, began: int | None):
        self.file, self.block, self.began, self.pos = file, block, began, 0
        self.inside, self.held = began is not None, []

    def add(self, line: str, out: list[tuple]) -> None:
        was = self.inside
        self.inside, closed = ends_inside(line, was)
        if was and not closed and self.inside:
            self.held.append(line)
            return
        if was:  # the open record ends in this line, or ended in it and another began: cells go on until the break
            self.held.append(line)
            if not self.inside:
                self._record("\n".join(self.held), out)
            return
        self.held = [line]
        if not self.inside:
            self._record(line, out)

    def _record(self, text: str, out: list[tuple]) -> None:
        self.held = []
        if self.began is not None:
            out.append((self.file, self.block, -1, None, None, self.began, text))
            self.began = None
            return
        cells = parse_record(text)
        if cells != []:
            out.append((self.file, self.block, self.pos, cells, cells is None, None, text if cells is None else None))
        self.pos += 1

    def end(self, out: list[tuple]) -> None:
        if self.held:
            began, pos = (self.block, self.pos) if self.began is None else (self.began, -1)
            out.append((self.file, self.block, pos, None, None, began, "\n".join(self.held)))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 7
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "block", "pos", "cells", "bad", "began", "text"])


def _cut(batches) -> Iterator[pa.RecordBatch]:
    now, key = None, None
    for batch in batches:
        for s in range(0, batch.num_rows, SLICE):
            part, out = batch.slice(s, SLICE), []
            for file, block, began, line in zip(*(part.column(k).to_pylist() for k in range(4)), strict=True):
                if (file, block) != key:
                    if now is not None:
                        now.end(out)
                    key, now = (file, block), _Range(file, block, began)
                now.add(line, out)
            yield _batch(out)
    if now is not None:
        out = []
        now.end(out)
        yield _batch(out)


def _parse(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            cells = parse_record(r["text"])
            if cells != []:
                rows.append((r["file"], r["block"], r["pos"], cells, cells is None, None, r["text"] if cells is None else None))
        yield _batch(rows)


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, block, pos, cells, bad, text) of the records of ``lines`` (line, ord as from ``read_lines``), header records included.

    (file, block, pos) sorts in file order; pos 0 of block 0 is a file's first record.
    ``bad`` records (``text`` holds them whole, ``cells`` is null) have a carriage return in an
    unquoted cell.  The table broadcast has at most one row of three numbers for each
    range read, and only for ranges that begin inside quotes.
    """
    keyed = lines.select(F.col("ord.file").alias("file"), F.col("ord.block").alias("block"), "line")
    fkey = F.xxhash64("file")
    quotes = F.when(F.instr("line", '"') > 0, F.col("line"))
    summaries = keyed.select(fkey.alias("fkey"), "block", quotes.alias("line")).mapInArrow(
        _summaries, "fkey bigint, block bigint, out boolean, into boolean, ended boolean")
    starts = summaries.groupBy("fkey").applyInPandas(_combine, "fkey bigint, block bigint, began bigint")
    placed = keyed.withColumn("fkey", fkey).join(F.broadcast(starts), ["fkey", "block"], "left")
    cut = placed.select("file", "block", "began", "line").mapInArrow(_cut, RECORDS)
    whole = cut.filter("began is null")
    joined = (cut.filter("began is not null").groupBy("file", F.col("began").alias("block"))
              .agg(F.max("pos").alias("pos"), F.array_sort(F.collect_list(F.struct(F.col("block").alias("b"), "text"))).alias("parts"))
              .select("file", "block", "pos", F.array_join(F.col("parts.text"), "\n").alias("text")).mapInArrow(_parse, RECORDS))
    return whole.unionByName(joined).drop("began")
