"""Substring deduplication: matching statistics from compressed FM-indexes, one for each shard.

A window is ``size`` consecutive words. Every window is filed under its minimizer, the least hash of its ``GRAM``
word runs: equal windows have equal minimizers, so each window's copies meet in one shard and no document has to be
searched for in every index. Consecutive windows whose minimizer stands at the same place form a run.

1. Runs are counted by minimizer (combined before the shuffle); a minimizer seen once proves its windows unique.
2. Runs with repeated minimizers are cut out of their documents as segments. Segments equal in all bytes collapse
   to their first place in each task before the shuffle, which makes a task's large groups of copies one row;
   minimizers with more than ``hot`` runs are dealt window by window instead, under the window's own hash.
3. A shard holds whole minimizers, cut into indexes of a bounded number of words. The first place of each
   minimizer is indexed, and its other segments are streamed against the index by backward search over the wavelet
   matrix: a window whose matching statistic reaches ``size`` repeats an earlier place; a segment whose match ends too
   early for any window is given up. Segments with windows that nothing matched go on to an index of the next places,
   twice as many of each minimizer, until none is left; of equal windows inside one index the least place is the
   first. Words are compared as bytes, never by hash.
4. Intervals to remove are a document's repeated runs without its firsts.

Each step is written to the shared folder. No index, segment list or position reaches the driver.

Defined results: null and empty texts have no words; ids are whole numbers; rows alike in id and text count as one
document, rows that share only the id are ordered by their hash; null ids come last; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowlake.llm import textnp
from sparrowlake.llm.common import drop, join_counted, row_key, small_batches, whole_id, written
from sparrowlake.llm.fm_index import FMIndex

SIZE, GRAM, RUN, HOT, INDEX_WORDS = 20, 6, 64, 4096, 150_000  # RUN: more than the windows that can share a minimizer's place
#: Bytes of segments that a task holds to collapse copies.
HELD = 32_000_000
#: Segments of one long text that are taken out of numpy at once.
PARTS = 100_000
LAST = (1 << 63) - 1
_BLANK = bytes(32 if chr(i) in " \t\n\x0b\x0c\r" else i for i in range(256))


def _least(g: np.ndarray, width: int) -> np.ndarray:
    """Where the (leftmost) least of each ``width`` consecutive numbers stands."""

    def lesser(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(g[b] < g[a], b, a)

    n, have, at = len(g) - width + 1, 1, np.arange(len(g))
    while have * 2 <= width:
        at = lesser(at[:-have], at[have:])
        have *= 2
    return lesser(at[:n], at[width - have : width - have + n]) if width > have else at[:n]


def _runs(rows: DataFrame, size: int) -> DataFrame:
    """v (minimizer), key, pos (start * 64 + windows - 1) of each run of windows."""
    gram = min(GRAM, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seps = textnp.separators()
        for batch in batches:
            keys = np.array(batch.column("key").to_pylist(), dtype=object)
            for block in textnp.blocks(batch.column("text"), seps):
                counts = np.diff(block.first) - size + 1
                own = np.flatnonzero(counts > 0)
                if not len(own):
                    continue
                g = textnp.grams(block.hashes(), gram)
                least = _least(g, size - gram + 1)
                n = counts[own]
                begin = np.cumsum(n) - n
                local = np.arange(int(n.sum())) - np.repeat(begin, n)
                at = least[np.repeat(block.first[own], n) + local]
                cut = np.r_[True, at[1:] != at[:-1]]  # at its place: a text that repeats itself has its minimizer twice
                cut[begin] = True
                starts = np.flatnonzero(cut)
                lens = np.diff(np.r_[starts, len(at)])
                v = g[at]
                yield pa.RecordBatch.from_arrays([pa.array(v[starts].view(np.int64)), pa.array(np.repeat(keys[block.row + own], n)[starts], pa.binary()), pa.array(local[starts] * RUN + lens - 1)], ["v", "key", "pos"])

    return rows.select("key", "text").mapInArrow(run, "v long, key binary, pos long")


def _spread(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of each range, one range after another."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list begins and ends (two columns; null is empty) in the values, and the values."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    bounds = np.stack([offsets[:-1], offsets[1:]], axis=1)
    bounds[column.is_null().to_numpy(zero_copy_only=False)] = 0
    return bounds, column.values


def _of_rows(bounds: np.ndarray, block: textnp.Block) -> tuple[np.ndarray, np.ndarray]:
    """The values of the lists of a block's rows, and the row (in the block) of each."""
    own = bounds[block.row : block.row + block.rows]
    n = own[:, 1] - own[:, 0]
    return _spread(own[:, 0], n), np.repeat(np.arange(block.rows), n)


def _segments(rows: DataFrame, size: int) -> DataFrame:
    """v, seg (bytes of the run's words), and its first place in this task: id, key, start; rows have hits: array of (v, pos, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seps = textnp.separators()
        firsts: dict[tuple[int, bytes], tuple[int, bytes, int]] = {}
        weight = 0

        def collapsed() -> pa.RecordBatch:
            v, seg = zip(*firsts, strict=True) if firsts else ((), ())
            own, key, start = zip(*firsts.values(), strict=True) if firsts else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(seg, pa.binary()), pa.array(own, pa.int64()), pa.array(key, pa.binary()), pa.array(start, pa.int64())], ["v", "seg", "id", "key", "start"])

        for batch in batches:
            ids, keys = batch.column("id").to_numpy().tolist(), batch.column("key").to_pylist()
            bounds, hits = _lists(batch.column("hits"))
            names, positions, hots = (hits.field(c).to_numpy(zero_copy_only=False) for c in ("v", "pos", "hot"))
            for block in textnp.blocks(batch.column("text"), seps):
                data = block.data.tobytes().translate(_BLANK)
                some, row = _of_rows(bounds, block)
                v, (s, n), hot = names[some], np.divmod(positions[some], RUN), hots[some]
                a, m = block.first[row] + s, n + 1
                if hot.any():
                    own, a, each = np.repeat(row[hot], m[hot]), np.r_[a[~hot], _spread(a[hot], m[hot])], m[~hot]
                    wide = textnp.grams(block.hashes(), size)[a[len(each) :]].view(np.int64)
                    v, row, m = np.r_[v[~hot], wide], np.r_[row[~hot], own], np.r_[each, np.ones(len(own), dtype=np.int64)]
                parts = v, row + block.row, a - block.first[row], block.starts[a], block.ends[a + m + size - 2]
                for lo in range(0, len(a), PARTS):
                    for name, i, at, begin, end in zip(*(x[lo : lo + PARTS].tolist() for x in parts), strict=True):
                        seg, place = data[begin:end], (ids[i], keys[i], at)
                        before = firsts.get((name, seg))
                        if before is None:
                            weight += len(seg) + 100
                        if before is None or place < before:
                            firsts[name, seg] = place
                        if weight > HELD:
                            yield collapsed()
                            firsts.clear()
                            weight = 0
        yield collapsed()

    return rows.select("id", "key", "text", "hits").mapInArrow(run, "v long, seg binary, id long, key binary, start long")


def _joined(block: textnp.Block, words: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some of a block's words, with a space after those where ``blank`` is 1, and where each begins (and the end)."""
    starts, ends = block.starts[words], block.ends[words]
    step = np.zeros(len(block.data) + 1, dtype=np.int8)
    step[starts] = 1
    step[ends] -= 1  # a word of the next text may begin there
    room = np.r_[0, np.cumsum(ends - starts + blank)]
    inside = np.ones(int(room[-1]), dtype=bool)
    inside[room[1:][blank > 0] - 1] = False
    out = np.full(len(inside), 32, dtype=np.uint8)
    out[inside] = block.data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    return out, room


def index_firsts(segs: list[bytes], places: list[tuple[int, bytes, int]], v: np.ndarray, size: int) -> list[np.ndarray]:
    """For each segment a mask of its windows that stand at no earlier place in any of the segments.

    Segments are sorted by minimizer ``v``, then by place (id, key, start).
    """
    # parted by a blank, so that a segment's words are its own
    offsets = np.cumsum([0, *(len(s) + 1 for s in segs)])
    block = textnp.Block(np.frombuffer(b" ".join([*segs, b""]), dtype=np.uint8), offsets, 0, textnp.separators())
    lens = np.diff(block.first)
    text, room = _joined(block, np.arange(len(block.starts)), np.zeros(len(block.starts), dtype=np.int64))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(room) - 1, [None, pa.py_buffer(room), pa.py_buffer(text)])
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
    begin = np.cumsum(lens) - lens
    order = np.empty(len(segs), dtype=np.int64)
    order[sorted(range(len(segs)), key=places.__getitem__)] = np.arange(len(segs))
    # windows of one document's segments follow each other, so a place is a segment's order, then the offset
    rank = np.repeat((order << 32) - begin, lens) + np.arange(len(codes))
    n = lens - size + 1
    first, unmet = np.zeros(len(codes), dtype=bool), np.zeros(len(codes), dtype=bool)  # by where a window begins
    unmet[_spread(begin, n)] = True
    pending, take = np.arange(len(segs)), 1
    while len(pending):
        names = v[pending]
        since = np.maximum.accumulate(np.where(np.r_[True, names[1:] != names[:-1]], np.arange(len(pending)), 0))
        indexed = np.arange(len(pending)) - since < take  # the first places of each minimizer that are left
        own, streamed = pending[indexed], pending[~indexed]
        source, room = _spread(begin[own], lens[own]), lens[own] + 1
        target = _spread(np.cumsum(room) - room, lens[own])
        text, ranks = np.zeros(int(room.sum()), dtype=np.int64), np.full(int(room.sum()), LAST)
        text[target], ranks[target] = codes[source], rank[source]
        index = FMIndex(text, size, ranks)
        first[source] |= unmet[source] & (index.least_by_place[target] == rank[source])
        unmet[source] = False
        del index.least_by_place
        if len(streamed):
            at = _spread(begin[streamed], lens[streamed])
            lengths, _ = index.matching_statistics(codes[at], lens[streamed], size, size)
            unmet[at[lengths >= size]] = False  # repeats of an indexed place, which is an earlier one
            starts = np.cumsum(lens[streamed]) - lens[streamed]
            streamed = streamed[np.logical_or.reduceat(unmet[at], starts)]
        pending, take = streamed, take * 2
    return [first[b : b + k] for b, k in zip(begin, n, strict=True)]


def _firsts(segments: DataFrame, size: int, index_words: int) -> DataFrame:
    """key, start, mask: of each segment the windows that are firsts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, tuple[int, bytes, int]]] = []
        known: set[bytes] = set()  # segments of the current minimizer
        words, last = 0, None

        def solved() -> pa.RecordBatch:
            masks = index_firsts([x[1] for x in held], [x[2] for x in held], np.array([x[0] for x in held], dtype=np.int64), size)
            n = np.array([len(m) for m in masks])
            begin = np.cumsum(n) - n
            bits = np.add.reduceat(np.concatenate(masks).astype(np.uint64) << _spread(np.zeros(len(n), dtype=np.int64), n).astype(np.uint64), begin).view(np.int64)
            some = np.flatnonzero(bits)
            places = [held[i][2] for i in some.tolist()]
            return pa.RecordBatch.from_arrays([pa.array([p[1] for p in places], pa.binary()), pa.array([p[2] for p in places], pa.int64()), pa.array(bits[some])], ["key", "start", "mask"])

        for batch in batches:  # sorted by v and place: an index is closed between two minimizers, and of equal segments the first stays
            names, ids, starts = (batch.column(c).to_numpy().tolist() for c in ("v", "id", "start"))
            for v, seg, own, key, start in zip(names, batch.column("seg").to_pylist(), ids, batch.column("key").to_pylist(), starts, strict=True):
                if v != last:
                    if words >= index_words:
                        yield solved()
                        held, words = [], 0
                    known, last = set(), v
                if seg not in known:
                    known.add(seg)
                    held.append((v, seg, (own, key, start)))
                    words += len(seg) // 6
        if held:
            yield solved()

    return segments.repartition("v").sortWithinPartitions("v", "id", "key", "start").mapInArrow(run, "key binary, start long, mask long")


def _kept(rows: DataFrame, size: int) -> DataFrame:
    """id, n_words, n_removed, text (kept words joined by a space), spans (from, to of removed words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seps = textnp.separators()
        kind = pa.struct([("from", pa.int64()), ("to", pa.int64())])
        for batch in batches:
            runs, pos = _lists(batch.column("pos"))
            pos = pos.to_numpy(zero_copy_only=False)
            bounds, firsts = _lists(batch.column("firsts"))
            begins, masks = (firsts.field(c).to_numpy(zero_copy_only=False) for c in ("start", "mask"))
            for block in textnp.blocks(batch.column("text"), seps):
                first = block.first
                windows = np.zeros(len(block.starts), dtype=bool)  # by where a window begins
                some, row = _of_rows(runs, block)
                s, n = np.divmod(pos[some], RUN)
                windows[_spread(first[row] + s, n + 1)] = True
                some, row = _of_rows(bounds, block)
                bits = np.unpackbits(masks[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                which, bit = np.nonzero(bits)
                windows[(first[row] + begins[some])[which] + bit] = False
                at = np.flatnonzero(windows)
                step = np.zeros(len(windows) + 1, dtype=np.int32)
                step[at] += 1
                step[at + size] -= 1
                covered = np.cumsum(step[:-1]) > 0
                head = np.zeros(len(windows) + 1, dtype=bool)  # a text begins here
                head[first] = True
                begin = np.flatnonzero(covered & (head[:-1] | ~np.r_[False, covered[:-1]]))
                end = np.flatnonzero(covered & (head[1:] | ~np.r_[covered[1:], False])) + 1
                spans = np.searchsorted(begin, first)
                own = np.repeat(first[:-1], np.diff(spans))
                gone = pa.StructArray.from_arrays([pa.array(begin - own), pa.array(end - own)], fields=list(kind))
                stay = np.flatnonzero(~covered)
                kept = np.searchsorted(stay, first)
                blank = np.ones(len(stay), dtype=np.int64)
                blank[kept[1:][np.diff(kept) > 0] - 1] = 0  # none after a text's last word
                out, room = _joined(block, stay, blank)
                text = pa.StringArray.from_buffers(block.rows, pa.py_buffer(room[kept].astype(np.int32)), pa.py_buffer(out))
                n_words = np.diff(first)
                arrays = [batch.column("own_id").slice(block.row, block.rows), pa.array(n_words), pa.array(n_words - np.diff(kept)), text, pa.ListArray.from_arrays(spans.astype(np.int32), gone)]
                yield pa.RecordBatch.from_arrays(arrays, ["id", "n_words", "n_removed", "text", "spans"])

    return rows.select("own_id", "text", "pos", "firsts").mapInArrow(run, "id long, n_words long, n_removed long, text string, spans array<struct<from: long, to: long>>")


def _repeated(rows: DataFrame, size: int, hot: int) -> DataFrame:
    """key, hits: each document's runs whose minimizers are not unique."""
    runs = written(_runs(rows, size), "substring-runs")
    counts = written(runs.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "substring-counts")
    found = join_counted(runs, counts, "v", "c")
    hits = written(found.groupBy("key").agg(F.collect_set(F.struct("v", "pos", (F.col("c") > hot).alias("hot"))).alias("hits")), "substring-hits")
    drop(runs, counts)
    return hits


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, hot: int = HOT, index_words: int = INDEX_WORDS) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed, the text that is kept and the spans of words that go."""
    spark = docs.sparkSession
    if not 0 < size <= RUN:
        raise ValueError(f"size must be from 1 to {RUN}")
    own = whole_id(docs, id_col)
    rows = docs.select(own.alias("own_id"), F.coalesce(own, F.lit(LAST)).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    with small_batches(spark):
        hits = _repeated(rows, size, hot)
        firsts = written(_firsts(_segments(rows.join(hits, "key"), size), size, index_words), "substring-firsts")
    firsts = firsts.groupBy("key").agg(F.collect_set(F.struct("start", "mask")).alias("firsts"))
    out = _kept(rows.join(hits.select("key", F.col("hits.pos").alias("pos")), "key", "left").join(firsts, "key", "left"), size)
    return out.withColumnRenamed("id", id_col)
