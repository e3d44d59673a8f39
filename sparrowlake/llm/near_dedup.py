"""Near-duplicate detection: a chosen-path set similarity join over word shingles.

Rows with equal shingle sets are one class from the start, so copies never meet one by one. The classes are then
joined:

* Every tree files a class under one minwise token of its set (another hash function for each tree). Nodes with
  more than ``node_limit`` members branch: each member goes on under two further minwise tokens, so that a pair of
  similarity s stays together in 2s children on average; leaves are compared exhaustively by sketches of ``SKETCH``
  minwise tokens. Independent trees are repeated to the target recall: a pair of similarity s is missed by all
  roots with probability (1 - s) ** trees. A pair that meets in several nodes is compared in the least of them only.
* A leaf puts forward a spanning forest of the pairs whose sketches agree well enough (4.5 standard deviations
  below the threshold), never all pairs. Put-forward pairs are confirmed on full sets. Where a leaf had some
  rejected, its members that sketches still allow to be linked across components come together once more with their
  texts, and every such pair is decided on full sets inside the node; only links that join two parts come out.
* A node over ``node_limit`` of which one child keeps more than half holds texts alike in many tokens: branching
  would copy its members and hardly part them. It is dealt into blocks instead. Blocks put forward forests of pairs
  that sketches find alike, and each member of the node is compared with ``PIVOTS`` members that agree best with a
  sample of the node (the original that many edited copies go back to, above all). Then the node is tiled, so that
  every pair of members which these links left in different components meets in a tile and is decided there as above.

Components are found by distributed star contraction; no links, fingerprints or components reach the driver.

Links are confirmed on whole sets of shingles; a shingle is known by a seeded 64-bit hash of its words' bytes.

Defined results: A-Z are lower-cased; null, empty and blank texts have no shingles and no links; fewer words than
a shingle make one shingle of the whole sequence; ids are whole numbers; rows are documents, so rows that share an id
but differ in text may be in different components, and rows alike in both are in the same one; rows with a null id
are never linked; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlake.llm import textnp
from sparrowlake.llm.common import drop, join_counted, small_batches, whole_id, written
from sparrowlake.llm.components import connected_components

SKETCH, SHINGLE, TREES, NODE_LIMIT, BRANCHES = 256, 5, 10, 2000, 2
#: Of a large node: members that stand for it, members that all others are compared with, and pairs with one of these that share a copy of its text.
SAMPLED, PIVOTS, SALT = 64, 8, 500
_RNG = np.random.default_rng(77)
_A32 = _RNG.integers(1, 1 << 32, SKETCH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_A64 = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_SIGN = -(1 << 63)


def _fingerprint(s: np.ndarray, trees: int) -> tuple[bytes, bytes, list[int]]:
    """Of a set: digest, sketch, one token hash for each tree."""
    low = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(s), 4096):
        np.minimum(least, (low[i : i + 4096, None] * _A32).min(axis=0), out=least)
    keys = [int((s * _A64[t]).min().view(np.int64)) for t in range(trees)]
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest(), (least & np.uint32(0xFF)).astype(np.uint8).tobytes(), keys


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and th, which tells the texts of one id apart."""
    return docs.select(whole_id(docs, id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def _base(rows: DataFrame, shingle: int, trees: int) -> DataFrame:
    """id, th, n (size of the set), digest, sketch, tokens (one for each tree); nulls where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seps, fold = textnp.separators(), textnp.lower_ascii()
        for batch in batches:
            for block in textnp.blocks(batch.column("text"), seps, fold):
                n, digest, sketch, tokens = [], [], [], []
                for s in textnp.shingle_sets(block, shingle):
                    d, k, t = _fingerprint(s, trees) if len(s) else (None, None, None)
                    n.append(len(s)), digest.append(d), sketch.append(k), tokens.append(t)
                own = [batch.column(c).slice(block.row, block.rows) for c in ("id", "th")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))], ["id", "th", "n", "digest", "sketch", "tokens"])

    return rows.mapInArrow(run, "id long, th long, n long, digest binary, sketch binary, tokens array<long>")


def _class_key(rep: Column, digest: Column) -> Column:
    """A class's name: its least id in bytes that sort as the numbers do, then its digest. The least name of a component begins with its least id."""
    return F.concat(F.unhex(F.lpad(F.hex(rep.bitwiseXOR(F.lit(_SIGN))), 16, "0")), digest)


def _key_id(key: Column) -> Column:
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))


def _nodes(reps: DataFrame, node_limit: int, max_depth: int | None) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Of all trees: leaves (node, id), large nodes that do not get smaller (node, id, c), and the tables these are read from."""
    level = reps.select("id", F.posexplode("tokens").alias("tree", "token")).select(F.xxhash64("tree", "token").alias("node"), "id")
    leaves, large, held, depth = [], [], [], 0
    while True:
        sizes = written(level.groupBy("node").agg(F.count("*").alias("c")).where("c > 1"), "near-sizes")
        here = written(join_counted(level, sizes, "node", "c"), "near-level")
        drop(sizes)
        held.append(here)
        leaves.append(here.where(F.col("c") <= node_limit).select("node", "id"))
        big = here.where(F.col("c") > node_limit).select("node", "id", "c")
        if big.isEmpty():
            break
        if depth == max_depth:
            large.append(big)
            break
        token = F.expr(f"substring(sketch, cast(pmod(xxhash64(node, b), {SKETCH}) as int) + 1, 1)")  # the node chooses which
        places = F.array(*[F.lit(b) for b in range(BRANCHES)])
        sketched = big.join(reps.select("id", "sketch"), "id").select("node", "c", "id", "sketch", F.explode(places).alias("b"))
        children = written(sketched.select(F.col("node").alias("parent"), "c", "b", F.xxhash64("node", "b", token).alias("node"), "id"), "near-children")
        kept = children.groupBy("parent", "c", "node").agg(F.count("*").alias("kept")).where("2 * kept > c")
        whole = written(kept.groupBy("parent").agg(F.max("c").alias("whole")), "near-whole")
        judged = join_counted(children, whole, "parent", "whole", "left")
        large.append(judged.where("whole is not null and b = 0").select(F.col("parent").alias("node"), "id", "c"))
        level = judged.where("whole is null").select("node", "id")
        held += [children, whole]
        depth += 1
    return reduce(DataFrame.union, leaves), reduce(DataFrame.union, large) if large else None, held


def _dealt(large: DataFrame, node_limit: int) -> DataFrame:
    """(node, id, block, blocks): members of large nodes dealt into blocks."""
    m = F.ceil(F.col("c") / node_limit)
    return large.select("node", "id", "c", m.alias("blocks"), F.xxhash64("node", F.pmod(F.xxhash64("id", "node"), m)).alias("block"))


def _everywhere(some: DataFrame) -> DataFrame:
    """Some members (with node and blocks) in each block of their node."""
    blocks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda i: F.xxhash64("node", i))
    return some.withColumn("block", F.explode(blocks))


def _tiles(large: DataFrame, node_limit: int) -> DataFrame:
    """(node, id, comp, side, of) of tiles in which all pairs of a node's members (with comp) from different components meet; ``of`` is the node.

    The node's largest component is dealt into blocks, and the rest of the members into others. Tiles are the pairs
    of a block of either kind, or of two blocks of the rest. Members of one side (0 or 1) need no comparison; side
    2 is compared in itself.
    """
    counts = large.groupBy("node", "comp").agg(F.count("*").alias("k"))
    sizes = counts.groupBy("node").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("k").alias("c")).where("c > most.k")
    dealing = sizes.select("node", "c", F.col("most.comp").alias("main"), F.ceil(F.col("most.k") / node_limit).alias("own"), F.ceil((F.col("c") - F.col("most.k")) / node_limit).alias("rest"))
    dealing = written(dealing, "near-dealing")
    rows = join_counted(large, dealing, "node", "c").withColumn("h", F.xxhash64("id", "node"))
    x, y = F.col("x"), F.col("y")
    main = rows.where("comp = main").withColumn("x", F.pmod("h", "own")).withColumn("y", F.explode(F.expr("sequence(0L, rest - 1)")))
    rest = rows.where("comp != main").withColumn("y", F.pmod("h", "rest"))
    met = rest.withColumn("x", F.explode(F.expr("sequence(0L, own - 1)")))
    among = rest.withColumn("x", F.explode(F.expr("sequence(0L, rest - 1)")))
    side = F.when(x == y, 2).when(x < y, 0).otherwise(1)
    parts = [
        main.select(F.xxhash64("node", F.lit(0), x, y).alias("tile"), "id", "comp", F.lit(0).alias("side"), "node"),
        met.select(F.xxhash64("node", F.lit(0), x, y).alias("tile"), "id", "comp", F.lit(1).alias("side"), "node"),
        among.select(F.xxhash64("node", F.lit(1), F.least(x, y), F.greatest(x, y)).alias("tile"), "id", "comp", side.alias("side"), "node"),
    ]
    return reduce(DataFrame.union, parts).select(F.col("tile").alias("node"), "id", "comp", F.col("side").cast("long").alias("side"), F.col("node").alias("of"))


class Group:
    """The rows of one node: ids, sizes, sketches, and which pairs already met in a lesser node."""

    def __init__(self, t: dict, a: int, b: int, node: int):
        self.ids, self.n, self.sketches = t["id"][a:b], t["n"][a:b], t["sketch"][a:b]
        self.bits = None
        if "nodes" in t:
            offsets, flat = t["nodes"]
            own = flat[offsets[a] : offsets[b]]
            row = np.repeat(np.arange(b - a), np.diff(offsets[a : b + 1]))
            _, name, count = np.unique(own, return_inverse=True, return_counts=True)
            use = (count[name] > 1) & (own < node)
            if use.any():
                _, bit = np.unique(name[use], return_inverse=True)
                self.bits = np.zeros((b - a, bit.max() // 64 + 1), dtype=np.uint64)
                np.bitwise_or.at(self.bits, (row[use], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))

    def agreeing(self, x: int, among: np.ndarray, least: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Which members ``among`` have a size and sketch that allow a link with x and have not met it before, and how well the sketches agree."""
        n = self.n[among]
        ok = np.minimum(n, self.n[x]) >= ratio * np.maximum(n, self.n[x])
        if self.bits is not None:
            ok &= ~(self.bits[among] & self.bits[x]).any(axis=1)
        near = among[ok]
        same = _agreement(self.sketches[near], self.sketches[x])
        enough = same >= least * SKETCH
        return near[enough], same[enough]


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many bytes of the sketches are equal: counted eight lanes at a time."""
    return (a == b).view(np.uint64).sum(axis=1).view(np.uint8).reshape(-1, 8).sum(axis=1, dtype=np.int64)


def _forest(g: Group, least: float, ratio: float) -> list[tuple[bytes, bytes]]:
    """Pairs that would join all members which sketches allow to be joined."""
    label = np.arange(len(g.ids))
    out: list[tuple[bytes, bytes]] = []
    for x in range(1, len(g.ids)):
        near, same = g.agreeing(x, np.arange(x), least, ratio)
        if len(near):
            near = near[np.argsort(-same, kind="stable")]  # of each part the member that agrees best
            parts, first = np.unique(label[near], return_index=True)
            for part, p in zip(parts, near[first], strict=True):
                out.append((g.ids[x], g.ids[p]))
                label[label == part] = label[x]
    return out


def _apart(g: Group, comp: np.ndarray, side: np.ndarray, least: float, ratio: float) -> np.ndarray:
    """Members that sketches allow to be linked with a member of another component, on the other side where there are sides."""
    out = np.zeros(len(g.ids), dtype=bool)
    within = side[0] == 2
    few, many = (np.arange(len(side)), None) if within else sorted((np.flatnonzero(side == 0), np.flatnonzero(side == 1)), key=len)
    for x in few:
        others = few[:x] if within else many
        others = others[comp[others] != comp[x]]
        near, _ = g.agreeing(x, others, least, ratio)
        if len(near):
            out[near] = out[x] = True
    return out


def _exact(ids: list[bytes], comp: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links between members of different components, decided on their full sets; each link joins two parts."""
    _, label = np.unique(comp, return_inverse=True)
    main = label == np.bincount(label).argmax()
    order = np.argsort(~main, kind="stable")  # the largest component first: within it there is nothing to decide
    ids, sets, label = [ids[i] for i in order], [sets[i] for i in order], label[order]
    sizes = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(int(flat.max()) + 1, dtype=np.int32)
    out: list[tuple[bytes, bytes]] = []
    for x in range(int(main.sum()), len(ids)):
        own = flat[begin[x] : begin[x] + sizes[x]]
        mark[own] = 1
        both = np.add.reduceat(mark[flat[: begin[x]]], begin[:x])
        mark[own] = 0
        for p in np.flatnonzero((100 * both >= percent * (sizes[:x] + sizes[x] - both)) & (label[:x] != label[x])):
            if label[p] != label[x]:
                out.append((ids[x], ids[p]))
                label[label == label[p]] = label[x]
    return out


def _by_node(members: DataFrame, solve: Callable[[dict, int, int, int], list[tuple]], schema: str, order: str = "id") -> DataFrame:
    """``solve`` on the rows of each node; rows of one node are in one task, which holds one node at a time."""
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    names, types = zip(*((x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")), strict=True)

    def columns(t: pa.Table) -> dict:
        out: dict = {}
        for name in t.column_names:
            c = t.column(name).combine_chunks()
            if name == "sketch":
                out[name] = np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
            elif name == "nodes":
                out[name] = c.offsets.to_numpy(), c.values.to_numpy()
            elif name == "comp":
                out[name] = np.array(c.to_pylist(), dtype=object)
            else:
                out[name] = c.to_numpy() if pa.types.is_integer(c.type) else c if pa.types.is_large_string(c.type) or pa.types.is_string(c.type) else c.to_pylist()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(tables: list[pa.Table]) -> pa.RecordBatch:
            t = columns(pa.concat_tables(tables))
            node = t["node"]
            cuts = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
            out = [row for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 1 for row in solve(t, a, b, int(node[a]))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(types)], list(names))

        held: list[pa.Table] = []  # a batch's last node may go on in the next
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            node = t.column("node").to_numpy()
            if held and node[0] != held[-1].column("node")[-1].as_py():
                yield solved(held)
                held = []
            cut = int(np.flatnonzero(np.r_[True, node[1:] != node[:-1]])[-1])
            if cut:
                yield solved([*held, t.slice(0, cut)])
                held = []
            held.append(t.slice(cut))
        if held:
            yield solved(held)

    return members.repartition("node").sortWithinPartitions("node", order).mapInArrow(run, schema)


def _propose(members: DataFrame, least: float, ratio: float) -> DataFrame:
    """(node, a, b): pairs from the members (node, id, n, sketch, nodes) of each leaf."""
    return _by_node(members, lambda t, a, b, node: [(node, *p) for p in _forest(Group(t, a, b, node), least, ratio)], "node long, a binary, b binary")


def _survey(members: DataFrame, ratio: float) -> DataFrame:
    """Of the blocks of large nodes (node: the block; of, id, n, sketch, stands): pairs (a, b) that sketches find alike, and with null b how well each member (a) agrees with those that stand for the node."""

    def solve(t: dict, a: int, b: int, node: int) -> list[tuple]:
        stands = t["stands"][a:b] == 1
        sample, own = t["sketch"][a:b][stands], np.flatnonzero(~stands) + a
        part = {c: t[c][own] if isinstance(t[c], np.ndarray) else [t[c][i] for i in own] for c in ("id", "n", "sketch")}
        agreed = sum((_agreement(part["sketch"], s) for s in sample), start=np.zeros(len(own)))
        scores = [(int(t["of"][a]), i, None, float(v)) for i, v in zip(part["id"], agreed, strict=True)]
        return scores + [(int(t["of"][a]), x, y, None) for x, y in _forest(Group(part, 0, len(own), node), ratio, ratio)]

    return _by_node(members, solve, "of long, a binary, b binary, score double")


def _meet_pivots(members: DataFrame, least: float, ratio: float) -> DataFrame:
    """(a, b): for each member of a block the two pivots (stands) whose sketches agree best with its own, if they may be linked."""

    def solve(t: dict, a: int, b: int, node: int) -> list[tuple]:
        g = Group({k: t[k] for k in ("id", "n", "sketch")}, a, b, node)
        pivots = np.flatnonzero(t["stands"][a:b] == 1)
        own = np.flatnonzero(t["stands"][a:b] == 0)
        agreed = np.zeros((len(pivots), len(g.ids)), dtype=np.int64)
        for i, p in enumerate(pivots):
            near, same = g.agreeing(int(p), own, least, ratio)
            agreed[i, near] = same
        out = []
        for i in np.argsort(-agreed, axis=0, kind="stable")[:2]:
            for x in own:
                if agreed[i[x], x] and g.ids[x] != g.ids[pivots[i[x]]]:
                    out.append((g.ids[x], g.ids[pivots[i[x]]]))
        return out

    return _by_node(members, solve, "a binary, b binary")


def _hard(members: DataFrame, least: float, ratio: float) -> DataFrame:
    """(node, id, comp) of members (with comp, side, and of, the node whose pairs are at stake) that may be linked across components."""

    def solve(t: dict, a: int, b: int, node: int) -> list[tuple]:
        comp = t["comp"][a:b]
        if (comp == comp[0]).all():
            return []
        _, comp_no = np.unique(comp.astype("O"), return_inverse=True)
        g = Group(t, a, b, int(t["of"][a]))
        return [(node, g.ids[i], comp[i]) for i in np.flatnonzero(_apart(g, comp_no, t["side"][a:b], least, ratio))]

    return _by_node(members, solve, "node long, id binary, comp binary")


def _decide(hard: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) among hard members, on their full sets."""

    def solve(t: dict, a: int, b: int, node: int) -> list[tuple]:
        sets = [s for block in textnp.blocks(t["text"].slice(a, b - a), textnp.separators(), textnp.lower_ascii()) for s in textnp.shingle_sets(block, shingle)]
        return _exact(t["id"][a:b], t["comp"][a:b], sets, percent)

    return _by_node(hard.join(texts, "id").select("node", "id", "comp", "text"), solve, "a binary, b binary").distinct()


def _confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) with whether they are alike on their full sets (ok). The text of a frequent b is copied for every SALT of its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seps, fold = textnp.separators(), textnp.lower_ascii()

        def sets(col: pa.Array) -> Iterator[np.ndarray]:
            for block in textnp.blocks(col, seps, fold):
                yield from textnp.shingle_sets(block, shingle)

        for batch in batches:
            if batch.num_rows:
                bs = np.array(batch.column("b").to_pylist(), dtype=object)
                fresh = np.flatnonzero(np.r_[True, bs[1:] != bs[:-1]])  # sorted by b: its set is made once
                kept = sets(batch.column("text_b").take(pa.array(fresh)))
                right: np.ndarray = np.zeros(0, np.uint64)
                ok, begin = [], set(fresh.tolist())
                for i, left in enumerate(sets(batch.column("text_a"))):
                    if i in begin:
                        right = next(kept)
                    both = len(np.intersect1d(left, right, assume_unique=True))
                    ok.append(100 * both >= percent * (len(left) + len(right) - both))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    counts = written(pairs.groupBy("b").agg(F.count("*").alias("c")), "near-counts")
    salts = F.ceil(F.col("c") / SALT)
    left = join_counted(pairs, counts, "b", "c").withColumn("salt", F.pmod(F.xxhash64("a"), salts)).join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(counts, "b").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    both = left.join(right.select("b", "salt", "text_b").hint("merge"), ["b", "salt"])
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary, ok boolean")


def near_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    shingle: int = SHINGLE,
    trees: int = TREES,
    node_limit: int = NODE_LIMIT,
    max_depth: int | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id (least id reachable), kept, text_hash (xxhash64 of the text)."""
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col)
    with small_batches(spark):
        base = written(_base(rows, shingle, trees), "near-base")
    full = base.where("digest is not null and id is not null")
    firsts = [F.first(c).alias(c) for c in ("n", "sketch", "tokens")]
    classes = full.groupBy("digest").agg(F.min(F.struct("id", "th")).alias("rep"), F.count("*").alias("copies"), *firsts)
    reps = written(classes.select(_class_key(F.col("rep.id"), F.col("digest")).alias("id"), "digest", F.col("rep.id").alias("rep"), "rep.th", "copies", "n", "sketch", "tokens"), "near-reps")

    s = percent / 100
    least = s - 4.5 * math.sqrt(s * (1 - s) / SKETCH)
    leaves, large, held = _nodes(reps, node_limit, max_depth)
    meets = leaves if large is None else leaves.union(large.select("node", "id"))
    # who meets whom; a pair is compared in the least node in which both are
    cards = written(meets.groupBy("id").agg(F.collect_set("node").alias("nodes")).where("size(nodes) > 0").join(reps.select("id", "n", "sketch"), "id"), "near-cards")
    found = _propose(leaves.join(cards, "id"), least, s)
    with small_batches(spark, 5000):
        proposed = written(found, "near-proposed")
    pairs = proposed.select("a", "b")
    if large is not None:
        # one node for each member: the largest, which most of a group's members share
        home = large.groupBy("id").agg(F.max(F.struct("c", "node")).alias("h")).select("id", "h.c", "h.node")
        dealt = written(_dealt(home, node_limit).join(cards.drop("nodes"), "id"), "near-dealt")
        kinds = ("id", "n", "sketch", "stands", F.col("block").alias("node"), F.col("node").alias("of"))
        sample = dealt.where(F.pmod(F.xxhash64("node", "id", F.lit(1)), F.ceil(F.col("c") / SAMPLED)) == 0)
        own = dealt.withColumn("stands", F.lit(0).cast("long")).select(*kinds)
        surveyed = written(_survey(own.union(_everywhere(sample.drop("block")).withColumn("stands", F.lit(1).cast("long")).select(*kinds)), s), "near-surveyed")
        best = surveyed.where("b is null").groupBy("of", F.pmod(F.xxhash64("a"), F.lit(PIVOTS)).alias("slot")).agg(F.max(F.struct("score", "a")).alias("best"))
        pivots = best.select(F.col("best.a").alias("id"), F.col("of").alias("node")).join(dealt.drop("block"), ["id", "node"])
        met = _meet_pivots(own.union(_everywhere(pivots).withColumn("stands", F.lit(1).cast("long")).select(*kinds)), least, s)
        pairs = pairs.union(surveyed.where("b is not null").select("a", "b")).union(met)
    with small_batches(spark, 5000):
        pairs = written(pairs.distinct(), "near-pairs")
    if large is not None:
        drop(dealt, surveyed)
    named = reps.select("id", "rep", "th")

    def texts_of(ids: DataFrame, tag: str) -> DataFrame:
        # a shuffle at every size: the ids that met grow with the input
        wanted = ids.join(named, "id").select(F.col("id").alias("key"), F.col("rep").alias("id"), "th")
        return written(rows.join(wanted.hint("merge"), ["id", "th"]).groupBy("key").agg(F.max("text").alias("text")).withColumnRenamed("key", "id"), tag)

    met_ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = texts_of(met_ids, "near-texts")
    with small_batches(spark, 256):
        checked = written(_confirm(pairs, texts, shingle, percent), "near-checked")
    confirmed = checked.where("ok").select(F.col("a").alias("u"), F.col("b").alias("v"))
    comps = connected_components(confirmed, "near-parts")
    rejected = checked.where("not ok").select("a", "b")
    open_leaves = not rejected.isEmpty()  # where a leaf's forest holds, nothing that sketches allow is apart in it
    if open_leaves or large is not None:

        def parted(df: DataFrame) -> DataFrame:
            return df.join(comps.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")

        open_nodes, dealing = [], None
        if open_leaves:
            nodes = proposed.join(rejected, ["a", "b"]).select("node").distinct()
            own = parted(leaves.join(nodes, "node", "left_semi"))
            open_nodes.append(own.select("node", "id", "comp", F.lit(2).cast("long").alias("side"), F.col("node").alias("of")))
        if large is not None:
            open_nodes.append(_tiles(written(parted(large.select("node", "id")), "near-parted"), node_limit))
        with small_batches(spark, 5000):
            hard = written(_hard(reduce(DataFrame.union, open_nodes).join(cards, "id"), least, s), "near-hard")
        # a member of a tile may not have met anyone yet
        late = hard.select("id").distinct().join(met_ids, "id", "left_anti")
        if not late.isEmpty():
            texts = texts.union(texts_of(late, "near-late"))
        with small_batches(spark, 256):
            decided = written(_decide(hard, texts, shingle, percent), "near-decided")
        if not decided.isEmpty():
            comps = connected_components(confirmed.union(decided.select("a", "b")), "near-components")
    found = written(reps.select("digest", "copies", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("digest", "copies", _key_id(F.coalesce("component", "id")).alias("component_id")), "near-found")
    drop(proposed, pairs, cards, reps, *held)
    small = base.select("id", "th", "n", "digest")
    out = join_counted(small.where("digest is not null and id is not null"), found, "digest", "copies")
    bare = small.where("digest is null or id is null").select("id", "th", "n", F.col("id").alias("component_id"))
    out = out.select("id", "th", "n", "component_id").union(bare)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"), F.col("th").alias("text_hash"))
