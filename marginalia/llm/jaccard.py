"""Operator 5. N-gram Jaccard join over a count-vector R-tree."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, discard, release, written
from .shingles import U, shingle_set, shingle_sets

#: Words in a shingle; the least similarity in percent.
K, PERCENT = 4, 85
#: Groups that shingles are hashed into; points in a leaf of the tree; rows of a cell that one tree holds, about; leaders in a cell; pairs of
#: a point that go on from a cell at first.
GROUPS, LEAF, CELL_ROWS, LEADERS, AT_ONCE = 256, 32, 2048, 64, 2
MANY = 255
#: Counters of the sketch of shingles, in parts of so many; a counter that is above FREQUENT, and the mean thrice, stands for frequent shingles.
COUNTERS, PART, FREQUENT = 1 << 20, 1 << 14, 200
#: Pairs of a point that go on in each round after the first; None: all that are left.
ROUNDS = (4, 32, None)
#: Parity bits of a set, at least.
LEAST_BITS = 512

SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.LongType()), T.StructField("vec", T.BinaryType()), T.StructField("odd", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])
PAIR = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b")])
PAIR_AT = T.StructType([T.StructField(c, T.LongType()) for c in ("a", "b", "doc_a", "doc_b")])


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The smallest intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -((-percent * (n + m)) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Two sets that are similar enough share one of so many smallest members of the one with n."""
    return n - -(-percent * n // 100) + 1


def class_of(own: np.ndarray) -> int:
    return int(np.int64(U(xxhash.xxh3_64_intdigest(own.tobytes()))))


def count_vector(own: np.ndarray) -> np.ndarray:
    """How many members fall into each group; the largest number stands for itself and all above it."""
    return np.minimum(np.bincount((own >> U(17)).astype(np.int64) % GROUPS, minlength=GROUPS), MANY).astype(np.uint8)


def parity(own: np.ndarray) -> np.ndarray:
    """Parity bits by hash, as bytes, half as many as members at least: two sets differ in as many members at least as in bits."""
    bits = max(LEAST_BITS, 1 << (len(own) - 1).bit_length() if len(own) else 0)
    return np.packbits((np.bincount((own >> U(13)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def differing(x: np.ndarray, y: np.ndarray) -> int:
    """In how many members at least two sets with these parity bits differ. The longer of two is folded: a bit's place is its hash modulo
    their number."""
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    return int(np.bitwise_count(np.bitwise_xor.reduce(x.reshape(-1, len(y)), 0) ^ y).sum(dtype=np.int64))


def prefix(own: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    """A set's keys: its first members in an order that is the same for all sets: frequent ones last, by level, then by hash."""
    level = levels[(own & U(COUNTERS - 1)).astype(np.int64)]
    frequent = level > 0
    if frequent.any():
        late = own[frequent]
        own = np.concatenate([own[~frequent], late[np.argsort(level[frequent], kind="stable")]])
    return own[: prefix_length(len(own), percent)] if len(own) else own


def _tally(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for own in shingle_sets(batch.column("text").to_pylist(), k):
                np.add.at(total, (own & U(COUNTERS - 1)).astype(np.int64), 1)
        parts = total.reshape(-1, PART).astype(np.uint32 if total.max() < 1 << 32 else np.int64)
        at = np.flatnonzero(total.reshape(-1, PART).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array([parts[p].tobytes() for p in at], pa.binary())], ["part", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each part that this task has: its counts in all."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            own = counts.as_py()
            counted = np.frombuffer(own, np.uint32 if len(own) == 4 * PART else np.int64)
            total[part] = total.get(part, 0) + counted.astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([*total], pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "counts"])


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """For each of COUNTERS hash buckets 0, or how many bits its number of shingles over all documents has where that is above FREQUENT
    and thrice the mean. A sketch of fixed size. Frequent shingles go last in the order of keys; any order gives the same result, but
    with frequent ones last a passage that many documents share makes few large cells."""
    counts = docs.select("text").mapInArrow(_tally(k), "part long, counts binary").repartition("part").mapInArrow(_summed, "part long, counts binary")
    total = np.zeros((COUNTERS // PART, PART), np.int64)
    for part, own in counts.collect():  # 8 bytes for each counter at most
        total[part] = np.frombuffer(own, np.int64)
    flat = total.ravel()
    return np.where(flat > max(FREQUENT, 3 * int(flat.mean())), np.frexp(flat.astype(np.float64))[1], 0).astype(np.uint8)


def _describe(k: int, percent: int, levels: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, vec, odd, keys = [], [], [], [], [np.empty(0, np.int64)]
            for own in shingle_sets(batch.column("text").to_pylist(), k):
                n.append(len(own))
                cls.append(class_of(own))
                vec.append(count_vector(own).tobytes())
                odd.append(parity(own).tobytes())
                keys.append(prefix(own, levels.value, percent).view(np.int64))
            ends = np.cumsum([len(x) for x in keys]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(vec, pa.binary()), pa.array(odd, pa.binary()), lists], SETS.names)

    return run


class CountTree:
    """An R-tree over count vectors, bulk-loaded: points sorted by their sum, cut into slabs, each sorted by its widest coordinate and
    cut into leaves. Of each leaf it knows the largest coordinate in each group and the least and largest sum.

    The overlap of two sets is at most the sum of the smaller of their counts in each group, and of a set with any in a leaf at most
    the sum of the smaller of its counts and the leaf's largest."""

    def __init__(self, vec: np.ndarray, n: np.ndarray) -> None:
        order = np.argsort(n, kind="stable")
        slab = LEAF * max(1, round((len(n) / LEAF) ** 0.5))
        parts = []
        for s in range(0, len(n), slab):
            part = order[s : s + slab]
            widest = int(np.argmax(vec[part].astype(np.int64).var(0)))
            parts.append(part[np.argsort(vec[part, widest], kind="stable")])
        self.order = np.concatenate(parts)
        self.vec, self.n = vec, n
        starts = np.arange(0, len(n), LEAF)
        v, m = vec[self.order], n[self.order]
        self.most = np.maximum.reduceat(v, starts)
        self.least_n, self.most_n = np.minimum.reduceat(m, starts), np.maximum.reduceat(m, starts)

    def near(self, vec: np.ndarray, n: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a given point's place and a place in the tree that may be similar enough, ordered by the given one; the rest can't be,
        by size or by bound. Leaves are tried first, then the points of those left."""
        step = max(1, (1 << 20) // self.most.size)
        for s in range(0, len(n), step):
            v, m = vec[s : s + step], n[s : s + step, None]
            may = np.minimum(self.most, v[:, None]).sum(2) >= least_overlap(m, np.maximum(self.least_n, -(-percent * m // 100)), percent)
            may &= (100 * self.most_n >= percent * m) & (100 * m >= percent * self.least_n)
            i, leaf = np.nonzero(may)
            for t in range(0, len(i), 256):
                inside = leaf[t : t + 256, None] * LEAF + np.arange(LEAF)
                who = np.repeat(i[t : t + 256], LEAF)[inside.ravel() < len(self.order)] + s
                at = self.order[inside.ravel()[inside.ravel() < len(self.order)]]
                size, other = n[who], self.n[at]
                good = np.flatnonzero((100 * size >= percent * other) & (100 * other >= percent * size))
                good = good[np.minimum(self.vec[at[good]], vec[who[good]]).sum(1) >= least_overlap(size[good], other[good], percent)]
                yield who[good], at[good]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The cells of a partition that is sorted by cell: their columns, cls, doc_id, comp, own (0 for a guest), n, vec."""
    rest: pa.Table | None = None

    def cut(t: pa.Table, last: bool) -> Iterator[dict[str, np.ndarray] | pa.Table]:
        cell = t.column("cell").to_numpy()
        ends = np.flatnonzero(np.concatenate([cell[1:] != cell[:-1], [True]])) + 1
        col = {c: t.column(c).to_numpy() for c in ("cls", "comp", "n", "own", "doc_id")}
        vec = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.uint8).reshape(-1, GROUPS).astype(np.int32)
        vec[vec == MANY] = 1 << 20
        start = 0
        for end in ends if last else ends[:-1]:
            if end - start > 1:
                yield {c: x[start:end] for c, x in col.items()} | {"vec": vec[start:end]}
            start = end
        yield t.slice(start)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None and rest.num_rows else t
        for x in cut(t, False):
            if isinstance(x, dict):
                yield x
            else:
                rest = x
    if rest is not None and rest.num_rows:
        for x in cut(rest, True):
            if isinstance(x, dict):
                yield x


def _emit(pairs: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs of classes and their documents, the class that goes to more others first, distinct within some tens of thousands."""
    held, size = [], 0
    for p in pairs:
        held.append(p)
        size += len(p)
        if size > 50_000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _batch(held: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.concatenate(held), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(p[:, k]) for k in range(4)], PAIR_AT.names)


def similar_places(cell: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Of pairs of places in a cell, whether sizes and summed smaller counts let them be similar."""
    n, vec = cell["n"], cell["vec"]
    good = (100 * n[i] >= percent * n[j]) & (100 * n[j] >= percent * n[i])
    at = np.flatnonzero(good)
    for s in range(0, len(at), 4096):
        x, y = i[at[s : s + 4096]], j[at[s : s + 4096]]
        good[at[s : s + 4096]] = np.minimum(vec[x], vec[y]).sum(1) >= least_overlap(n[x], n[y], percent)
    return good


def paired(cell: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.stack([cell["cls"][i], cell["cls"][j], cell["doc_id"][i], cell["doc_id"][j]], 1)


def _stars(percent: int) -> Callable:
    """In each cell, in an order that is the same in all cells, pairs of a point and points before it. A cell of up to LEADERS points is
    gone through: each point goes with the first AT_ONCE points before it that may be similar, and a pair of it with itself says that
    there are more. In a larger cell a point near a leader goes with the first such leader, and any other becomes a leader, up to
    LEADERS; all else of it is left to the rounds that follow."""

    def pairs(cell: dict[str, np.ndarray]) -> np.ndarray:
        order = np.argsort(cell["cls"].view(U) * U(0x9E3779B97F4A7C15), kind="stable")
        m = len(order)
        if m <= LEADERS:
            v, size = cell["vec"][order], cell["n"][order]
            j, i = (np.concatenate(x) for x in zip(*CountTree(v, size).near(v, size, percent), (np.empty(0, np.int64),) * 2, strict=True))
            by = np.lexsort((i, j))[(i < j)[np.lexsort((i, j))]]
            j, i = j[by], i[by]
            rank = np.arange(len(j)) - np.searchsorted(j, j)
            more = np.unique(j[rank >= AT_ONCE])
            return paired(cell, order[np.concatenate([i[rank < AT_ONCE], more])], order[np.concatenate([j[rank < AT_ONCE], more])])
        lead, out = np.array([order[0]]), []
        for p in order[1:]:
            good = np.flatnonzero(similar_places(cell, lead, np.full(len(lead), p), percent))
            if len(good):
                out.append((lead[good[0]], p))
            elif len(lead) < LEADERS:
                lead = np.append(lead, p)
        out = np.array(out, np.int64).reshape(-1, 2)
        return paired(cell, out[:, 0], out[:, 1])

    return lambda batches: _emit(pairs(cell) for cell in _cells(batches))


def _near(percent: int, most: int | None) -> Callable:
    """In each cell, pairs of points of different components that can't be ruled out: of each guest the `most` with the highest bounds,
    or all. A pair of the point with itself says that there are more."""

    def pairs(cell: dict[str, np.ndarray]) -> Iterator[np.ndarray]:
        n, vec, cls, comp, own = (cell[c] for c in ("n", "vec", "cls", "comp", "own"))
        home, guests = np.flatnonzero(own == 1), np.flatnonzero(own == 0)
        if not len(home) or not len(guests) or (comp == comp[0]).all():
            return
        tree = CountTree(vec[home], n[home])
        found = [(guests[who], home[at]) for who, at in tree.near(vec[guests], n[guests], percent)]
        who, at = (np.concatenate(x) for x in zip(*found, (np.empty(0, np.int64),) * 2, strict=True))
        who, at = who[comp[who] != comp[at]], at[comp[who] != comp[at]]
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]])) if len(who) else who
        for i, near in zip(who[first].tolist(), np.split(at, first[1:]), strict=True) if len(who) else ():
            if most is not None and len(near) > most:
                bound = np.minimum(vec[near], vec[i]).sum(1) / (n[i] + n[near])
                near = near[np.argsort(-bound, kind="stable")[:most]]
                yield paired(cell, np.array([i]), np.array([i]))
            if len(near):
                first, own = cls[near] < cls[i], np.full(len(near), i)
                yield paired(cell, np.where(first, near, own), np.where(first, own, near))

    return lambda batches: _emit(p for cell in _cells(batches) for p in pairs(cell))


def _verify(k: int, percent: int) -> Callable:
    """Of rows (a, b, text_a, text_b), sorted by a, the pairs whose whole sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead: tuple[int | None, str | None, np.ndarray] = (None, None, np.empty(0, U))
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, q in enumerate(shingle_sets(batch.column("text_b").to_pylist(), k)):
                text = batch.column("text_a")[i].as_py()
                if lead[:2] != (a[i], text):
                    lead = (a[i], text, shingle_set(text, k))
                p = lead[2]
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                # an id that several rows share may have brought another row's text
                keep.append(100 * same >= percent * (len(p) + len(q) - same) and class_of(q) == b[i] and class_of(p) == a[i])
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _may_hold(percent: int) -> Callable:
    """Of rows with sizes n_a, n_b and parities odd_a, odd_b, those that may be similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            most = n + m - 2 * least_overlap(n, m, percent)
            odd = [[np.frombuffer(x.as_buffer(), np.uint8) for x in batch.column(c)] for c in ("odd_a", "odd_b")]
            keep = [differing(x, y) <= d for x, y, d in zip(*odd, most.tolist(), strict=True)]
            yield batch.select(PAIR_AT.names).filter(pa.array(keep, pa.bool_()))

    return run


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that each node of the links (a, b) reaches.

    In rounds: each takes the smallest label around a node, then the label of that label, until none changes; rounds are written, nothing
    is gathered."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp")).withColumnRenamed("a", "node"), "labels")
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("least"))
        new = labels.join(around.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "least").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("on"))
        new = written(new.join(jump, "comp", "left").select("node", "was", F.least("comp", "on").alias("comp")), "labels")
        changed = new.where("was <> comp").limit(1).count()
        discard(labels)
        labels = new.select("node", "comp")
        if not changed:
            return labels


def united(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, comp) after further links: only components and nodes that these join get new ones."""
    old = lambda c: labels.select(F.col("node").alias(c), F.col("comp").alias(f"comp_{c}"))
    between = links.join(old("a"), "a", "left").join(old("b"), "b", "left").select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b")).where("a <> b").distinct()
    new = components(between)
    moved = labels.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("on")), "comp", "left").select("node", F.coalesce("on", "comp").alias("comp"))
    return written(moved.unionByName(new.join(labels, "node", "left_anti")), "labels")


def _blocks() -> Column:
    return F.ceil(F.col("size") / CELL_ROWS).cast("long")


def asking_cells(members: DataFrame, asking: DataFrame, all_large: bool) -> DataFrame:
    """Cells with points that ask, in blocks of about CELL_ROWS: the cell's points at home (own = 1), and as guests (own = 0) those that
    ask, which visit every block. Classes given ask in all their cells; with all_large, in cells of more than LEADERS points so do all
    outside the largest component."""
    points = members.join(asking.select("cls", F.lit(True).alias("given")), "cls", "left").withColumn("asks", F.coalesce("given", F.lit(False)))
    if all_large:
        large = points.where(F.col("size") > min(LEADERS, CELL_ROWS)).groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
        large = large.groupBy("key").agg(F.max(F.struct("c", "comp"))["comp"].alias("largest"))
        points = points.join(large, "key", "left").withColumn("asks", F.col("asks") | F.coalesce(F.col("comp") != F.col("largest"), F.lit(False)))
    n_out = points.where("asks").groupBy("key").agg(F.ceil(F.count(F.lit(1)) / CELL_ROWS).alias("n_out"))
    points = points.select("key", "size", "cls", "comp", "asks").join(n_out, "key")
    visits = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    place = lambda seed, n: F.pmod(F.xxhash64("cls", F.lit(seed)), n).cast("int")
    own = points.select("*", visits(F.col("n_out")).alias("j")).withColumn("i", place(1, _blocks())).withColumn("own", F.lit(1))
    guests = points.where("asks").select("*", visits(_blocks()).alias("i")).withColumn("j", place(2, F.col("n_out"))).withColumn("own", F.lit(0))
    return own.unionByName(guests.select(*own.columns)).select(F.xxhash64("key", "i", "j").alias("cell"), "cls", "comp", "own")


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """id, n_shingles, component_id: the smallest id that a document reaches by links between documents whose sets of k-word shingles
    have a Jaccard similarity of percent / 100 at least.

    1. Documents with equal sets are one class; only classes go on (a group of copies costs a row).
    2. A set's first members, as many as the prefix theorem asks for, are its keys; similar sets share one. The order is by hash, with
       frequent keys last. Classes that share a key are a cell; of cells with the same classes one stays.
    3. In a cell the classes are points: counts of shingles by hash group. An R-tree bounds overlaps by the summed smaller counts and
       leaves pairs that may be similar. First each point goes with a leader near it, or a few points; pairs that parity bits don't rule
       out are verified on the whole sets, and verified links make components. Points with more pairs across components, and those of large cells, then give them,
       the likeliest first, until none is left. A pair within a component would add nothing, so no link that matters is lost.
    Cells beyond CELL_ROWS are cut into blocks by digest; the blocks' leaders meet in a round of their own, and points outside a cell's
    largest component visit every block, so no task holds a whole cell.

    Null or wordless text has no shingles and its own id as component. Rows with a null id link nothing and get a null component.
    Repeated rows are copies. An empty table gives no rows; further columns are ignored; texts of any length are read whole. Sets,
    shingles and words are compared by 64-bit hashes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    levels = spark.sparkContext.broadcast(frequency_levels(docs, k))
    rows = written(docs.mapInArrow(_describe(k, percent, levels), SETS), "jaccard-rows")
    full = rows.where("n > 0 and doc_id is not null")
    classes = full.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.any_value("n").alias("n"), F.any_value("vec").alias("vec"), F.any_value("odd").alias("odd"), F.any_value("keys").alias("keys"))
    classes = written(classes, "jaccard-classes")
    sizes = written(rows.select("doc_id", "n", "cls"), "jaccard-sizes")
    discard(rows)
    release(spark)

    by = Window.partitionBy("key")
    keys = classes.select("cls", F.explode("keys").alias("key")).withColumn("size", F.count(F.lit(1)).over(by)).withColumn("who", F.bit_xor(F.xxhash64("cls")).over(by))
    keys = written(keys.where("size > 1"), "jaccard-keys")
    release(spark)
    cells = keys.groupBy("size", "who").agg(F.min("key").alias("key")).select("key")
    members = written(keys.join(cells, "key", "left_semi").select("key", "cls", "size"), "jaccard-cells")
    points = written(classes.select("cls", "doc_id", "n", "vec"), "jaccard-points")
    parities = written(classes.select("cls", "n", "odd"), "jaccard-parities")
    heads = written(classes.select("cls", "doc_id"), "jaccard-heads")
    for used in (keys, classes):
        discard(used)
    texts = docs.where("doc_id is not null")
    release(spark)

    def dealt(cells: DataFrame) -> DataFrame:
        """Count vectors join last, so that all before is narrow."""
        return cells.join(points, "cls").select("cell", "cls", "doc_id", "comp", "n", "own", "vec").repartition("cell").sortWithinPartitions("cell")

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that parities let through go on; texts and pairs meet by document; then all of a leader's pairs go where its text is."""
        side = lambda c: parities.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("odd").alias(f"odd_{c}"))
        pairs = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_may_hold(percent), PAIR_AT), "jaccard-likely")
        leaders = texts.join(pairs.select("a", F.col("doc_a").alias("doc_id")).distinct(), "doc_id").select("a", F.col("text").alias("text_a"))
        others = texts.join(pairs.select("a", "b", F.col("doc_b").alias("doc_id")), "doc_id").select("a", "b", F.col("text").alias("text_b"))
        out = written(others.join(leaders, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, percent), PAIR).distinct(), "jaccard-links")
        discard(pairs)
        release(spark)
        return out

    def labelled(labels: DataFrame) -> DataFrame:
        return members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))

    own = members.select(F.xxhash64("key", F.pmod(F.xxhash64("cls", F.lit(1)), _blocks()).cast("int")).alias("cell"), "cls", F.col("cls").alias("comp"), F.lit(1).alias("own"))
    pairs = written(dealt(own).mapInArrow(_stars(percent), PAIR_AT).distinct(), "jaccard-pairs")
    labels = components(verified(pairs.where("a <> b")))
    if members.where(F.col("size") > CELL_ROWS).limit(1).count():  # one point of each component in each cell that was cut
        ones = labelled(labels).where(F.col("size") > CELL_ROWS).groupBy("key", "comp").agg(F.min("cls").alias("cls")).select(F.xxhash64("key").alias("cell"), "cls", "comp", F.lit(1).alias("own"))
        more = written(dealt(ones).mapInArrow(_stars(percent), PAIR_AT).distinct(), "jaccard-pairs")
        labels = united(labels, verified(more.where("a <> b")))
    for nth, most in enumerate(ROUNDS):
        asking = pairs.where("a = b").select(F.col("a").alias("cls")).distinct()
        cells = asking_cells(labelled(labels), asking, nth == 0)
        pairs = written(dealt(cells).mapInArrow(_near(percent, most), PAIR_AT).distinct(), "jaccard-pairs")
        if not pairs.limit(1).count():
            break
        labels = united(labels, verified(pairs.where("a <> b")))
        if not pairs.where("a = b").limit(1).count():
            break

    comps = heads.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = comps.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    comps = comps.join(least, "comp").select("cls", "component_id")
    linked = sizes.where("n > 0 and doc_id is not null").join(comps, "cls").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sizes.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumnRenamed("doc_id", id_col)
