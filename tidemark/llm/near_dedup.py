"""MinHash near-duplicate groups by a chosen-path set similarity join.

A document is the set of its distinct word shingles. Two documents are linked if
``100 * |A & B| >= 75 * |A | B|`` (parameter ``percent``). The join works on a sketch of
``COORDS`` minwise tokens per document:

1. Documents with the same set form a class; only its smallest id goes on.
2. In each of ``trees`` independent trees a node deals its members to children by the minwise
   tokens at one or two coordinates that the node's path selects (4/3 on average, so a pair at
   the threshold keeps one common child per node on average).
3. A node of at most ``LEAF`` members is compared exhaustively on the sketches; a larger node
   branches again: up to ``NODE`` members inside one task, beyond that as rows of a DataFrame.
   In a large node, members that agree with its leader on nearly all coordinates are compared
   with the leader and leave. When parts are joined (4.), they leave only after they have been compared
   with all members of the node that carry another label. Nodes that are still large at
   ``DEPTH`` are compared in blocks, so nothing is dropped.
4. Links are confirmed on the full sets, recomputed from the whole texts. First a forest of
   pairs that the sketches are sure of, per node; once its links are merged, every pair that
   may be linked and whose ends are still apart. Of the second kind a large group may have many, so
   no pairs are written: the texts come to the node, and only links that join parts go out.
5. Links are merged to components by star contraction on DataFrames.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BLANK_SEPARATED, Scratch, Words, mix, text_chunks

#: Minwise tokens in a sketch.
COORDS = 128
#: Largest node that is compared exhaustively, and largest that one task branches.
LEAF, NODE = 256, 4096
#: Levels after which nodes that are still large are compared in blocks.
DEPTH = 24
#: Standard errors under the threshold down to which a sketch estimate is still confirmed.
SLACK = 3.5
#: Ids up to which a set of ids is broadcast to filter the texts; more are joined.
FEW_IDS = 2_000_000
#: Share of coordinates on which a member must agree with the leader to leave a large node.
FOLLOW = 0.95
#: Shingles of one node's texts up to which they are confirmed in one task; more are dealt to pairs of blocks.
WEIGHT = 2_000_000
#: Ids under this are nodes that are compared in blocks at once (of other nodes, 1 in 16 million).
WHOLE = 1 << 40

_MULT = mix(np.arange(1, 9, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_XOR32 = (mix(np.arange(1, COORDS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_MUL32 = (mix(np.arange(1001, COORDS + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its ``width``-word shingles.

    A text of fewer words has one shingle, the whole sequence; a text without words has none.
    """
    for at, to, low, offsets in text_chunks(column):
        w = Words(low, offsets, BLANK_SEPARATED)
        n = len(w.hash)
        m = max(0, n - width + 1)  # texts read together may have fewer words than one shingle
        rolled = np.zeros(m, dtype=np.uint64)
        for k in range(width):
            rolled += mix(w.hash[k : k + m] * _MULT[k % 8] + np.uint64(k))
        rolled = mix(rolled)
        for i in range(to - at):
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi > lo:
                part = w.hash[lo:hi]
                yield mix(np.array([np.bitwise_xor.reduce(mix(part + np.arange(1, hi - lo + 1, dtype=np.uint64) * _MULT[7])) + np.uint64(hi - lo)], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)


def _selected(node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, coordinates) that nodes select: one each, and for a third of them another."""
    pick = mix(node ^ np.uint64(0x5851F42D4C957F2D))
    first = (pick % np.uint64(COORDS)).astype(np.int64)
    two = np.flatnonzero(mix(pick + np.uint64(77)) % np.uint64(3) == 0)
    second = (first[two] + 1 + (mix(pick[two] + np.uint64(1)) % np.uint64(COORDS - 1)).astype(np.int64)) % COORDS
    return [(np.arange(len(node)), first), (two, second)]


def _child(node: np.ndarray, coord: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(node + coord.astype(np.uint64) * _MULT[1]) + token.astype(np.uint64) * _MULT[2])


def _root_picks(trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Root nodes and the coordinates they select."""
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64) * _MULT[4])
    picked = _selected(roots)
    return np.concatenate([roots[w] for w, _ in picked]), np.concatenate([c for _, c in picked])


def sketch_of(shingles: np.ndarray, roots: np.ndarray, coords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``COORDS`` minwise tokens of a set, two bytes each, and its children of the roots, dealt by
    whole tokens, so that different tokens don't meet however many documents there are."""
    best = np.full(COORDS, 0xFFFFFFFF, dtype=np.uint32)
    value, token = np.full(len(coords), 0xFFFFFFFF, dtype=np.uint32), np.zeros(len(coords), dtype=np.uint64)
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(small), 4096):
        part = (small[k : k + 4096, None] ^ _XOR32) * _MUL32
        np.minimum(best, part.min(axis=0), out=best)
        at = part[:, coords].argmin(axis=0)
        low = part[at, coords]
        token = np.where(low < value, shingles[k + at], token)
        value = np.minimum(low, value)
    return ((best * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16), _child(roots, coords, token)


def _sketches(width: int, trees: int):
    def run(batches):
        roots, coords = _root_picks(trees)
        for batch in batches:
            size, key, sketch, nodes = [], [], [], []
            for s in shingle_sets(batch.column("_text"), width):
                size.append(len(s))
                if len(s):
                    sums = (int(mix(s).sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s ^ _MULT[3]))))
                    key.append(sums[0].to_bytes(8, "big") + sums[1].to_bytes(8, "big"))
                    tokens, children = sketch_of(s, roots, coords)
                    sketch.append(tokens.tobytes())
                    nodes.append(children.view(np.int64))
                else:
                    key.append(None)
                    sketch.append(None)
                    nodes.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sketch, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                ["_id", "n_shingles", "set_key", "sketch", "nodes"],
            )

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a non-null binary column of equal lengths, as a matrix of minwise tokens."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]].view(np.uint16).reshape(n, COORDS)


def _children(node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and child nodes of rows that stand in the given nodes."""
    picked = _selected(node)
    rows = np.concatenate([w for w, _ in picked])
    return rows, np.concatenate([_child(node[w], c, sketch[w, c]) for w, c in picked])


def _bounds(percent: int) -> tuple[float, float, float]:
    """Coordinates that must agree: for a pair that may be linked, for a sure one, and between a leader and
    what may be linked with one of its followers, as those differ from it on few coordinates."""
    share = percent / 100
    err = (share * (1 - share) / COORDS) ** 0.5
    low = (share - SLACK * err) * COORDS
    return low, (share + err) * COORDS, low - (1 - FOLLOW) * COORDS


def _branch_again(percent: int):
    """Large nodes: followers of the leader give a pair and leave, the rest go to the children. What may be linked
    with a follower goes ``beside`` the node, too."""
    near_low = _bounds(percent)[2]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sketch, lead = _matrix(batch.column("sketch")), _matrix(batch.column("lead_sketch"))
            ids, leader, parent = batch.column("rep"), batch.column("leader"), batch.column("node")
            agree = (sketch == lead).sum(axis=1)
            follows = (agree >= FOLLOW * COORDS) & np.array(ids.to_numpy() != leader.to_numpy())
            stay = np.flatnonzero(~follows)
            rows, node = _children(parent.to_numpy().view(np.uint64)[stay], sketch[stay])
            for at, child, first, other in (
                (np.flatnonzero(follows), None, leader, parent),
                (np.flatnonzero((agree >= near_low) & ~follows), None, None, parent),
                (stay[rows], pa.array(node.view(np.int64)), None, None),
            ):
                null = pa.nulls(len(at), pa.int64())
                taken = [null if x is None else x.take(pa.array(at)) for x in (ids, first, other)]
                yield pa.RecordBatch.from_arrays([null if child is None else child, *taken], ["node", "rep", "leader", "beside"])

    return run


def _forest(n: int, links: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of row numbers that span what the matrix of links joins."""
    root = np.arange(n)
    out = []
    for a in range(n):
        near = np.flatnonzero(links[a])
        near = near[root[near] != root[a]]
        if len(near):
            _, first = np.unique(root[near], return_index=True)
            for b in near[first]:
                if root[b] != root[a]:
                    out.append((a, int(b)))
                    root[root == root[b]] = root[a]
    return out


def _compare(percent: int, step: str, width: int = 0):
    """Members of one node stand together, in order. By ``step``: ``sure`` gives (a, b) of a forest of sure
    pairs per node; ``apart`` gives (a: node, b: member) of members that may be linked with one of another label;
    ``confirm`` gives (a, b) of links that join labels, by full sets of the column ``text``."""
    low, high, near_low = _bounds(percent)
    apart, leaf = step != "sure", LEAF

    def exhaustive(ids, size, label, sketch):
        n = len(ids)
        agree = np.empty((n, n), dtype=np.int16)
        for k in range(0, n, 32):
            agree[k : k + 32] = (sketch[k : k + 32, None, :] == sketch[None, :, :]).sum(axis=2)
        fits = 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
        likely = (agree >= (low if apart else high)) & fits
        np.fill_diagonal(likely, False)
        if apart:
            return np.argwhere(np.triu(likely & (label[:, None] != label[None, :])))
        return np.array(_forest(n, likely), dtype=np.int64).reshape(-1, 2) if likely.any() else np.zeros((0, 2), dtype=np.int64)

    def between(left, right, size, label, sketch):
        """(x, x) of the row numbers on both sides that may be linked with one of another label on the other side."""
        some, any_ = np.zeros(len(left), dtype=bool), np.zeros(len(right), dtype=bool)
        for k in range(0, len(left), 16):
            x = left[k : k + 16, None]
            likely = (label[x] != label[right]) & (100 * np.minimum(size[x], size[right]) >= percent * np.maximum(size[x], size[right]))
            likely &= (sketch[x] == sketch[right]).sum(axis=2) >= low
            some[k : k + 16] = likely.any(axis=1)
            any_ |= likely.any(axis=0)
        member = np.concatenate([left[some], right[any_]])
        return np.stack([member, member], axis=1)

    def node_pairs(node, ids, size, label, sketch):
        """Pairs of row numbers of one node, which branches here until its parts are small. What ``apart`` has
        found is compared in blocks by ``confirm``, as fewer members branch differently."""
        found, work = [], [(np.uint64(node), np.arange(len(ids)), DEPTH if step == "confirm" or node < WHOLE else 0)]
        while work:
            path, rows, depth = work.pop()
            if len(rows) < 2 or apart and (label[rows] == label[rows[0]]).all():
                continue
            if len(rows) <= leaf:
                found.append(rows[exhaustive(ids[rows], size[rows], label[rows], sketch[rows])])
                continue
            if depth >= DEPTH:  # what doesn't split, in pairs of blocks
                blocks = np.array_split(rows[np.argsort(label[rows], kind="stable")], -(-2 * len(rows) // leaf))
                for x in range(len(blocks)):
                    for y in range(x + 1, len(blocks)):
                        work.append((path, np.concatenate([blocks[x], blocks[y]]), depth))
                continue
            lead = rows[int(np.argmin(mix(ids[rows].astype(np.uint64) + path)))]
            agree = (sketch[rows] == sketch[lead]).sum(axis=1)
            close = agree >= FOLLOW * COORDS
            if apart:
                left, right = rows[close], rows[agree >= near_low]
                if (label[left] == label[lead]).all():
                    right = right[label[right] != label[lead]]
                found.append(between(left, right, size, label, sketch))
            else:
                others = rows[close & (rows != lead)]
                found.append(np.stack([np.full(len(others), lead), others], axis=1))
            stay = rows[~close | (rows == lead)]
            which, child = _children(np.full(len(stay), path), sketch[stay])
            order = np.argsort(child, kind="stable")
            edges = np.flatnonzero(np.diff(child[order])) + 1
            for part in np.split(order, edges):
                if len(part) > 1:
                    work.append((child[part[0]], stay[which[part]], depth + 1))
        return np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)

    def confirmed(ids, size, label, text, pairs):
        """Links among the pairs that join labels not joined before."""
        sets: dict[int, np.ndarray] = {}
        root = {x: x for x in set(label.tolist())}

        def top(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def of(i):
            if i not in sets:
                sets[i] = next(shingle_sets(pa.array([text[i]], pa.large_string()), width))
            return sets[i]

        out = []
        for a, b in np.unique(np.sort(pairs, axis=1), axis=0).tolist():
            x, y = top(int(label[a])), top(int(label[b]))
            if x == y:
                continue
            both = len(np.intersect1d(of(a), of(b), assume_unique=True))
            if 100 * both >= percent * (int(size[a]) + int(size[b]) - both):
                root[x] = y
                out.append((a, b))
        return np.array(out, dtype=np.int64).reshape(-1, 2)

    def flush(node, ids, size, label, sketch, text, bounds, out):
        two = np.flatnonzero(np.diff(bounds) == 2)  # most nodes; all at once
        if len(two) and step != "confirm":
            a = bounds[two]
            agree = (sketch[a] == sketch[a + 1]).sum(axis=1)
            small, large = np.minimum(size[a], size[a + 1]), np.maximum(size[a], size[a + 1])
            good = (agree >= (low if apart else high)) & (100 * small >= percent * large)
            if apart:
                good &= label[a] != label[a + 1]
            a = a[good]
            if apart:
                out += [np.stack([node[a].view(np.int64), ids[a]], axis=1), np.stack([node[a].view(np.int64), ids[a + 1]], axis=1)]
            else:
                out.append(np.sort(np.stack([ids[a], ids[a + 1]], axis=1), axis=1))
        for k in np.flatnonzero(np.diff(bounds) > (1 if step == "confirm" else 2)):
            lo, hi = bounds[k], bounds[k + 1]
            found = node_pairs(node[lo], ids[lo:hi], size[lo:hi], label[lo:hi], sketch[lo:hi])
            if step == "confirm" and len(found):
                found = confirmed(ids[lo:hi], size[lo:hi], label[lo:hi], text[lo:hi], found)
            if not len(found):
                continue
            if step == "apart":
                member = ids[lo:hi][np.unique(found)]
                out.append(np.stack([np.full(len(member), node[lo : lo + 1].view(np.int64)[0]), member], axis=1))
            else:
                out.append(np.sort(ids[lo:hi][found], axis=1))

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "rep", "n_shingles", "label")] + [_matrix(batch.column("sketch"))]
            new.append(batch.column("text").to_numpy(zero_copy_only=False) if step == "confirm" else new[1])
            held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
            edges = np.flatnonzero(np.diff(held[0])) + 1
            if not len(edges):
                continue
            upto = int(edges[-1])
            yield from emit([x[:upto] for x in held], np.concatenate([[0], edges]))
            held = [x[upto:] for x in held]
        if held is not None and len(held[0]):
            edges = np.flatnonzero(np.diff(held[0])) + 1
            yield from emit(held, np.concatenate([[0], edges, [len(held[0])]]))

    def emit(rows, bounds):
        out: list[np.ndarray] = []
        flush(rows[0].view(np.uint64), *rows[1:], bounds, out)
        if out:
            pairs = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _confirm(width: int, percent: int):
    def run(batches):
        for batch in batches:
            keep, last = [], (None, None)
            for a, b, sa, sb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ta"), batch.column("tb"), strict=True):
                one = last[1] if last[0] == a else next(shingle_sets(pa.array([sa.as_py()], pa.large_string()), width))
                last = (a, one)
                two = next(shingle_sets(pa.array([sb.as_py()], pa.large_string()), width))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append((a, b) if 100 * both >= percent * (len(one) + len(two) - both) else None)
            good = [x for x in keep if x]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in good], pa.int64()), pa.array([x[1] for x in good], pa.int64())], ["a", "b"])

    return run


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, label): the smallest id reachable over ``edges`` (a, b), for ids that have an edge.

    Alternating large-star and small-star contraction; each round is written to the shared
    folder. A hub's neighbours meet only in ``min``, never in one list: each is relinked by an
    equi-join, which Spark splits where skewed.
    """
    cur = scratch.save(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    k = 0
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        # every neighbour larger than the centre is linked to the centre's smallest neighbour
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b")
        low = large.groupBy(F.col("b").alias("c")).agg(F.min("a").alias("m"))
        # of a centre's smaller neighbours, all but the smallest are linked to it, and so is the centre
        small = large.select(F.col("b").alias("c"), F.col("a").alias("x")).join(low, "c")
        small = small.where("x <> m").select(F.col("m").alias("a"), F.col("x").alias("b")).unionByName(low.select(F.col("m").alias("a"), F.col("c").alias("b")))
        new = scratch.save(small.where("a <> b").distinct(), f"{name}-{k + 1}")
        # done when all edges go from a smallest id, which is no larger end, and each larger end has one
        state = new.agg(F.count("*").alias("n"), F.countDistinct("b").alias("ends")).first()
        open_ = new.select("a").distinct().join(new.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        scratch.drop(f"{name}-{k}")
        cur, k = new, k + 1
        if not open_ and state["n"] == state["ends"]:
            break
    return cur.select(F.col("b").alias("id"), F.col("a").alias("label")).unionByName(cur.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, trees: int = 12) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id``, ``kept``.

    Null or blank text: no shingles, linked with nothing, its own component. Rows with the same
    id are one document of several texts: links of any of them count, and every row is
    returned. A null id is never linked and keeps a null component; it is kept. Ids may be of any type that has an order;
    those that are no integers are numbered first. Columns other
    than the two named are ignored, whatever their names. An empty table gives no rows.
    """
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        return _numbered(docs, id_col, text_col, width, percent, trees)
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    src = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    sketched = scratch.save(src.mapInArrow(_sketches(width, trees), "_id long, n_shingles long, set_key binary, sketch binary, nodes array<long>"), "sketches")

    usable = sketched.where("set_key is not null and _id is not null")
    classes = usable.groupBy("set_key").agg(F.min(F.struct("_id", "n_shingles", "sketch", "nodes")).alias("m"))
    reps = scratch.save(classes.select("set_key", F.col("m._id").alias("rep"), "m.n_shingles", "m.sketch", "m.nodes"), "reps")

    nodes, pairs, beside = _tree_nodes(reps, percent, scratch)
    zero = nodes.withColumn("label", F.lit(0).cast("long"))
    first = scratch.save(_compared(zero, reps, percent, "sure").unionByName(pairs).distinct(), "pairs-1")
    links = _links(first, src, width, percent)
    # several classes of one id are one document
    several = usable.groupBy("_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("_id")
    same_id = usable.select("_id", "set_key").join(several, "_id", "left_semi").join(reps.select("set_key", "rep"), "set_key").select(F.col("rep").alias("a"), F.col("_id").alias("b")).where("a <> b")
    one = scratch.save(links.unionByName(same_id), "links-1")
    labels = scratch.save(components(spark, one, scratch, "parts-1"), "labels-1")

    labelled = nodes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("node", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = labelled.groupBy("node").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("node")
    labelled = labelled.join(mixed, "node", "left_semi")
    if beside is not None:
        labelled = labelled.unionByName(_beside_nodes(beside, labels, scratch))
    open_ = scratch.save(_compared(labelled, reps, percent, "apart").select(F.col("a").alias("node"), F.col("b").alias("rep")), "open")
    texts = _texts(src, open_.select(F.col("rep").alias("_id")).distinct())
    again = _by_weight(labelled.join(open_, ["node", "rep"], "left_semi"), reps)
    more = scratch.save(_compared(again, reps, percent, "confirm", width, texts).distinct(), "links-2")
    if not more.isEmpty():
        labels = scratch.save(components(spark, one.unionByName(more), scratch, "parts-2"), "labels-2")

    named = reps.select("set_key", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("label", "rep").alias("component_id"))
    out = sketched.select("_id", "n_shingles", "set_key").join(named, "set_key", "left")
    component = F.coalesce(F.when(F.col("_id").isNotNull(), F.col("component_id")), F.col("_id"))
    return out.select(F.col("_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("_id"), F.lit(True)).alias("kept"))


def _numbered(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, trees: int) -> DataFrame:
    """The same for ids of another type: each distinct id gets a number, written once, and a component the least of its ids."""
    scratch = Scratch(docs.sparkSession, "near-ids")
    names = docs.select(F.col(id_col).alias("name")).where("name is not null").distinct()
    names = scratch.save(names.select("name", F.monotonically_increasing_id().alias("_id")), "names")
    rows = docs.select(F.col(id_col).alias("name"), F.col(text_col).alias("text")).join(names, "name", "left")
    groups = near_duplicates(rows.select("_id", "text"), "_id", "text", width, percent, trees)
    named = scratch.save(groups.select("_id", "n_shingles", "component_id").join(names, "_id", "left"), "named")
    least = named.where("name is not null").groupBy("component_id").agg(F.min("name").alias("least"))
    out = named.join(least, "component_id", "left")
    return out.select(F.col("name").alias(id_col), "n_shingles", F.col("least").alias("component_id"), F.coalesce(F.col("least") == F.col("name"), F.lit(True)).alias("kept"))


def _by_weight(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, rep, label) with the nodes of many long texts cut to blocks, and a node for each pair of blocks."""
    heavy = nodes.join(reps.select("rep", "n_shingles"), "rep").groupBy("node").agg(F.sum("n_shingles").alias("w")).where(F.col("w") > WEIGHT)
    dealt = nodes.join(heavy, "node").withColumn("k", F.ceil(F.col("w") * 2 / WEIGHT)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    pairs = dealt.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep", "label")
    return nodes.join(heavy.select("node"), "node", "left_anti").unionByName(pairs)


def _tree_nodes(reps: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(node, rep) of all nodes to compare, the (a, b) pairs of leaders and followers, and (node, rep, follows)
    of the followers and what may be linked with them."""
    cur = reps.select("rep", F.explode("nodes").alias("node"))
    done, beside, pairs = [], [], [reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).limit(0)]
    for depth in range(DEPTH):
        cur = scratch.save(cur, f"level-{depth}")
        sizes = cur.groupBy("node").agg(F.count("*").alias("n"), F.min_by("rep", F.xxhash64("node", "rep")).alias("leader")).where("n > 1")
        sized = scratch.save(cur.join(sizes, "node"), f"sized-{depth}")
        scratch.drop(f"level-{depth}")
        done.append(sized.where(F.col("n") <= NODE).select("node", "rep"))
        large = sized.where(F.col("n") > NODE)
        if large.isEmpty():
            break
        grown = large.join(reps.select("rep", "sketch"), "rep").join(reps.select(F.col("rep").alias("leader"), F.col("sketch").alias("lead_sketch")), "leader")
        grown = scratch.save(grown.select("node", "rep", "leader", "sketch", "lead_sketch").mapInArrow(_branch_again(percent), "node long, rep long, leader long, beside long"), f"grown-{depth}")
        beside.append(grown.where("beside is not null").select(F.col("beside").alias("node"), "rep", F.col("leader").isNotNull().alias("follows")))
        pairs.append(grown.where("leader is not null").select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")))
        cur = grown.where("node is not null").select("node", "rep")
    else:
        done.append(_blocks(cur))
    nodes, links = done[0], pairs[0]
    for x in done[1:]:
        nodes = nodes.unionByName(x)
    for x in pairs[1:]:
        links = links.unionByName(x)
    return nodes, links.distinct(), reduce(DataFrame.unionByName, beside) if beside else None


def _beside_nodes(beside: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, rep, label): the followers that left large nodes, in blocks, each with a block of those members of
    another label that may be linked with one. Members of the only label of a node's followers are left out."""
    named = beside.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("node", "rep", "follows", F.coalesce("label", "rep").alias("label"))
    of_follower = F.when(F.col("follows"), F.col("label"))
    span = named.groupBy("node").agg(F.min(of_follower).alias("lo"), F.max(of_follower).alias("hi")).where("lo is not null")
    sided = named.join(span, "node").withColumn("other", F.expr("label <> lo or not follows and lo <> hi")).where("follows or other")
    sided = scratch.save(sided.select("node", "rep", "label", "follows", "other"), "beside")
    sizes = sided.groupBy("node").agg(*(F.ceil(F.count_if(c) * 2 / NODE).alias(f"n_{c}") for c in ("follows", "other"))).where("n_follows > 0 and n_other > 0")
    dealt = sided.join(sizes, "node")
    sides = []
    for mine, theirs in (("follows", "other"), ("other", "follows")):
        block = {mine: F.pmod(F.xxhash64("rep"), F.col(f"n_{mine}")), theirs: F.col("at")}
        every = dealt.where(mine).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{theirs}") - 1)))
        sides.append(every.select(F.xxhash64("node", block["follows"], block["other"]).bitwiseAND(F.lit(WHOLE - 1)).alias("node"), "rep", "label"))
    return scratch.save(sides[0].unionByName(sides[1]).distinct(), "beside-nodes")


def _blocks(cur: DataFrame) -> DataFrame:
    """Large nodes cut to blocks, and a node for each pair of blocks: the exact way for what no branching splits."""
    sizes = cur.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
    k = F.ceil(F.col("n") * 2 / NODE)
    dealt = cur.join(sizes, "node").withColumn("k", k).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("k")))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    return other.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "rep")


def _compared(nodes: DataFrame, reps: DataFrame, percent: int, step: str, width: int = 0, texts: DataFrame | None = None) -> DataFrame:
    rows = nodes.join(reps.select("rep", "n_shingles", "sketch"), "rep")
    if texts is not None:
        rows = rows.join(texts.select(F.col("_id").alias("rep"), F.col("_text").alias("text")), "rep")
    rows = rows.repartition("node").sortWithinPartitions("node", "rep").select("node", "rep", "n_shingles", "label", "sketch", *(["text"] if texts is not None else []))
    return rows.mapInArrow(_compare(percent, step, width), "a long, b long")


def _texts(src: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``src`` with one of the ids: filtered where they are read while the ids are few."""
    few = ids.count() <= FEW_IDS
    return src.where("_id is not null").join(F.broadcast(ids) if few else ids, "_id", "left_semi")


def _links(pairs: DataFrame, src: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs that are linked by their full sets."""
    need = pairs.select(F.col("a").alias("_id")).unionByName(pairs.select(F.col("b").alias("_id"))).distinct()
    texts = _texts(src, need)
    left = pairs.join(texts.select(F.col("_id").alias("a"), F.col("_text").alias("ta")), "a")
    full = left.join(texts.select(F.col("_id").alias("b"), F.col("_text").alias("tb")), "b")
    return full.select("a", "b", "ta", "tb").mapInArrow(_confirm(width, percent), "a long, b long")
