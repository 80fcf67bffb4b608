"""MinHash near-duplicate detection with tensored banding.

A document is its set of five-word shingles. ``COLLECTIONS`` small hash collections of
``ROWS`` minhashes each are combined in pairs, so that COLLECTIONS * ROWS minhashes make
COLLECTIONS * (COLLECTIONS - 1) / 2 tables whose keys hold 2 * ROWS minhashes. Candidates are
verified on their full shingle sets, and verified links are merged into components.

Identical sets form one class and are searched once. Buckets (equal keys) aren't expanded into pairs.
First every class is compared with three leaders of its bucket, and links are merged into components. A
bucket that still mixes components is settled exactly: what lies outside its largest component meets
all its classes in cells of bounded size, in which common shingles are counted for all pairs at once; a
cell returns no more than a spanning forest of the links between components. So every candidate
pair of different components is decided on full sets, whatever its bucket's size, and none is written out.

Full sets are larger than texts, so they travel only where a link is possible. A set's sketch marks its shingles
in at least four bits for each; bits that only one of two sketches has bound the common shingles from above.
What this bound excludes is no link, so leaving it out loses none. Cells are screened by sketches first: one of no more possible
links than classes returns them as pairs, which are told apart over all cells and verified once; the others send their sets.
Likewise a table of marks, of bounded size, holds back most of the texts and sets that no join wants.

No key meets all its rows in one task: large buckets and groups of one text are broadcast to their rows (fewer than a thousand of
each), and a leader's set is sent once for every ``LEADER_ROWS`` classes that it meets.

Defined results: a null or wordless text has an empty set and is linked with nothing; a shorter text
than five words is one shingle; repeated rows are one class; null ids come last in "smallest
doc_id". Sets hold 51-bit shingle hashes. A true link at the threshold is missed with
probability under 0.001 (no two collections agree), links of higher similarity far less often. Empty
tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.components import connected_components
from quantloom.llm.frames import discard, join_groups, materialize, one_row_each, slices, text_bytes
from quantloom.llm.words import LOWER, SPACE, hash_words, mix, roll, runs_in_rows

SHINGLE = 5
PERCENT = 75
COLLECTIONS = 12
ROWS = 2
#: Classes of a cell's side, and their shingles, about. They bound a task's memory; larger buckets have more cells.
CELL_CLASSES = 1024
CELL_SHINGLES = 2_000_000
#: Classes that a task compares with one copy of their leader, about.
LEADER_ROWS = 256
#: Marks that tell which texts or sets are wanted are broadcast as words of 64 bits: so many bits at most.
MARK_BITS = 1 << 25
#: Rows that a task of cells returns at a time, about.
RETURN_ROWS = 4096

_PRIME = np.random.default_rng(77).integers(1, 2**62, COLLECTIONS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.random.default_rng(78).integers(1, 2**63, COLLECTIONS * ROWS, dtype=np.uint64)
#: A bucket's leaders are its least and greatest class ids, and the least one under this mask.
MASK = 0x2545F4914F6CDD1D
_ROW_BITS = 13


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all rows (at most 8192), sorted in each row, and the n + 1 row offsets."""
    words, rows = hash_words(LOWER[data], at, SPACE)
    n = len(rows) - 1
    begin, row = runs_in_rows(rows, width)
    rolled = roll(words, width)[begin] if len(begin) else np.empty(0, np.uint64)
    count = np.diff(rows)
    short = np.flatnonzero((count > 0) & (count < width))
    whole = np.empty(len(short), np.uint64)
    for k in range(1, width):
        pick = count[short] == k
        if pick.any():
            first = rows[short[pick]]
            value = np.full(len(first), k, np.uint64)
            for j in range(k):
                value = mix(value * np.uint64(31) + words[first + j])
            whole[pick] = value
    hashes, row = np.concatenate((rolled, whole)), np.concatenate((row, short)).astype(np.uint64)
    tagged = np.sort(row << np.uint64(64 - _ROW_BITS) | hashes >> np.uint64(_ROW_BITS))
    if len(tagged):
        tagged = tagged[np.append(True, tagged[1:] != tagged[:-1])]
    bounds = np.searchsorted(tagged, np.arange(n, dtype=np.uint64) << np.uint64(64 - _ROW_BITS))
    return tagged & np.uint64(2 ** (64 - _ROW_BITS) - 1), np.append(bounds, len(tagged))


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "text"):
            for begin in range(0, piece.num_rows, 1 << _ROW_BITS):
                yield piece.slice(begin, 1 << _ROW_BITS)


_SIGNED = "doc_id long, text_key long, n_shingles long, cls long, check long, " + ", ".join(f"u{i} long" for i in range(COLLECTIONS))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SIGNED.split(", ")]
    for piece in _rows_of(batches):
        sets, bounds = shingle_sets(*text_bytes(piece.column("text")))
        size = np.diff(bounds)
        full = np.flatnonzero(size)
        head = bounds[:-1][full]
        n = piece.num_rows
        out = np.zeros((len(names) - 3, n), np.uint64)
        if len(full):
            out[0, full] = np.add.reduceat(mix(sets), head)
            out[1, full] = np.add.reduceat(mix(sets ^ np.uint64(0x5DEECE66D)), head)
            least = np.empty((len(_PRIME), len(full)), np.uint64)
            for i, (a, b) in enumerate(zip(_PRIME, _SHIFT, strict=True)):
                least[i] = np.minimum.reduceat(sets * a + b, head)
            for i in range(COLLECTIONS):
                value = least[i * ROWS]
                for j in range(1, ROWS):
                    value = mix(value) + least[i * ROWS + j]
                out[2 + i, full] = mix(value)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("text_key"), pa.array(size, pa.int64()), *(pa.array(x.view(np.int64)) for x in out)], names=names)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """A set's shingles as marks in a power of two bits, at least 64 and four for each shingle."""
    bits = max(64, 1 << (4 * len(shingles) - 1).bit_length())
    marks = np.zeros(bits, bool)
    marks[shingles & np.uint64(bits - 1)] = True
    return np.packbits(marks, bitorder="little").view(np.uint64)


def fold(sketches: np.ndarray, words: int) -> np.ndarray:
    """Sketches (rows) of more words as those that the same sets have in ``words`` words."""
    while sketches.shape[-1] > words:
        sketches = sketches[..., : sketches.shape[-1] // 2] | sketches[..., sketches.shape[-1] // 2 :]
    return sketches


def may_be_linked(one: np.ndarray, n: int, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """False for those of ``others`` (sketches of sets of ``sizes``) that are surely not linked with the set of ``n`` of sketch ``one``."""
    words = min(one.shape[-1], others.shape[-1])
    one, others = fold(one, words), fold(others, words)
    common = np.minimum(n - np.bitwise_count(one & ~others).sum(axis=1, dtype=np.int64), sizes - np.bitwise_count(others & ~one).sum(axis=1, dtype=np.int64))
    return 100 * common >= percent * (n + sizes - common)


def _class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shingle sets of classes' texts, as packed 64-bit integers, and their sketches."""
    for piece in _rows_of(batches):
        sets, bounds = shingle_sets(*text_bytes(piece.column("text")))
        own = [sets[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        columns = [pa.array([x.tobytes() for x in own], pa.binary()), pa.array([sketch(x).tobytes() for x in own], pa.binary())]
        yield pa.RecordBatch.from_arrays([piece.column("cls"), pa.array(np.diff(bounds), pa.int64()), *columns], names=["cls", "size", "shingles", "sketch"])


def _set(packed: pa.Scalar) -> np.ndarray:
    return np.frombuffer(packed.as_buffer(), np.uint64)


def _maybe_linked(percent: int):
    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column("own_a"), batch.column("size_a").to_pylist(), batch.column("own_b"), batch.column("size_b").to_pylist())
            keep = [bool(may_be_linked(_set(x), m, _set(y)[None], np.array([n]), percent)[0]) for x, m, y, n in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return screen


def _linked(percent: int, one: str = "a", two: str = "b"):
    """Of the pairs a, b those that are linked, as their columns ``one`` and ``two``."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for batch in batches:
            keep = []
            for a, set_a, set_b in zip(batch.column("a").to_pylist(), batch.column("set_a"), batch.column("set_b"), strict=True):
                if a != last:
                    last, left = a, _set(set_a)
                right = _set(set_b)
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column(one), batch.column(two)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return verify


def common_shingles(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """How many shingles each of the sets ``rows`` has in common with each other set of ``columns`` (not with itself).

    A shingle of few pairs adds one to each of them; those of many pairs are multiplied as 0/1 matrices.
    """
    size = np.array([len(x) for x in sets])
    _, item, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), size)
    shared = count[item] > 1
    item, owner = item[shared], owner[shared]
    place = np.full((2, len(sets)), -1)
    place[0, rows], place[1, columns] = np.arange(len(rows)), np.arange(len(columns))
    n = len(count)
    degree = [np.bincount(item[place[i, owner] >= 0], minlength=n) for i in (0, 1)]
    product = degree[0] * degree[1]
    out = np.zeros(len(rows) * len(columns), np.int64)
    few = (product > 0) & (product < out.size / 128)
    sides = []
    for i in (0, 1):
        on = (place[i, owner] >= 0) & few[item]
        order = np.argsort(item[on], kind="stable")
        sides.append((place[i, owner[on]][order], np.append(0, np.cumsum(np.bincount(item[on], minlength=n)))))
    wanted = np.flatnonzero(few)
    begin = 0
    while begin < len(wanted):  # so many pairs at a time
        end = begin + max(1, int(np.searchsorted(np.cumsum(product[wanted[begin:]]), 4_000_000, side="right")))
        own = wanted[begin:end]
        total = product[own]
        head = np.repeat(np.cumsum(total) - total, total)
        k = np.arange(int(total.sum())) - head
        which = np.repeat(own, total)
        i, j = np.divmod(k, degree[1][which])
        out += np.bincount(sides[0][0][sides[0][1][which] + i] * len(columns) + sides[1][0][sides[1][1][which] + j], minlength=out.size)
        begin = end
    out = out.reshape(len(rows), len(columns))
    many = np.flatnonzero(product >= out.size / 128) if out.size else []
    for begin in range(0, len(many), 2048):
        number = np.full(n, -1)
        number[many[begin : begin + 2048]] = np.arange(len(many[begin : begin + 2048]))
        matrices = []
        for i, length in ((0, len(rows)), (1, len(columns))):
            on = (place[i, owner] >= 0) & (number[item] >= 0)
            m = np.zeros((length, min(2048, len(many) - begin)), np.float32)
            m[place[i, owner[on]], number[item[on]]] = 1
            matrices.append(m)
        out += (matrices[0] @ matrices[1].T).astype(np.int64)
    return out


def forest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of the links ``a`` to ``b`` (numbers into ``root``), so many that join the same components, as pairs of roots."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while x in up:
            x = up[x]
        return x

    out = []
    for x, y in zip(root[a].tolist(), root[b].tolist(), strict=True):
        s, t = top(x), top(y)
        if s != t:
            up[max(s, t)] = min(s, t)
            out.append((x, y))
    return out


def _each_cell(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[int, list[tuple]]]:
    """Each cell and its rows (tuples of ``names``, the last one packed) of batches that are sorted by ``cell``."""
    cell, rows = None, []
    for batch in batches:
        columns = [batch.column(x).to_pylist() for x in names[:-1]]
        for own, packed, *row in zip(batch.column("cell").to_pylist(), batch.column(names[-1]), *columns, strict=True):
            if own != cell:
                if rows:
                    yield cell, rows
                cell, rows = own, []
            rows.append((*row, _set(packed)))
    if rows:
        yield cell, rows


def possible_links(root: np.ndarray, side: np.ndarray, size: np.ndarray, sketches: list[np.ndarray], percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which classes of a cell may be linked with one of the other side and another component, and these pairs.

    No pairs, if there are more than classes.
    """
    keep, pairs, number = np.zeros(len(root), bool), [], 0
    words = np.array([len(x) for x in sketches])
    alike = [np.flatnonzero((side != 0) & (words == w)) for w in np.unique(words[side != 0])]
    columns = [(k, np.stack([sketches[i] for i in k])) for k in alike]
    for i in np.flatnonzero(side != 1):
        for k, others in columns:
            pick = (root[k] != root[i]) & (100 * np.minimum(size[k], size[i]) >= percent * np.maximum(size[k], size[i]))
            if side[i] == 2:
                pick &= (side[k] != 2) | (k > i)
            if pick.any():
                near = k[pick][may_be_linked(sketches[i], size[i], others[pick], size[k[pick]], percent)]
                keep[near] = True
                keep[i] |= len(near) > 0
                number += len(near)
                pairs += ((int(i), int(j)) for j in near) if number <= len(root) else ()
    return keep, pairs if number <= len(root) else []


_POSSIBLE = "cell long, cls long, root long, side int, other long, other_root long"


def _possible(percent: int):
    """Cells (sorted by ``cell``) as possible links between their classes (``cls`` is that of more links there), or else as the classes that have any."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in _POSSIBLE.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int32() if name == "side" else pa.int64()) for i, name in enumerate(names)], names=names)

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for cell, rows in _each_cell(batches, "cls", "root", "side", "size", "sketch"):
            cls, root, side, size, own = zip(*rows, strict=True)
            keep, pairs = possible_links(np.array(root, np.int64), np.array(side), np.array(size, np.int64), list(own), percent)
            if pairs:
                links = np.bincount(np.ravel(pairs), minlength=len(rows)).tolist()
                ordered = (sorted(pair, key=lambda i: (-links[i], cls[i])) for pair in pairs)
                out += [(None, cls[i], root[i], None, cls[j], root[j]) for i, j in ordered]
            else:
                out += [(cell, cls[i], root[i], side[i], None, None) for i in np.flatnonzero(keep)]
            if len(out) >= RETURN_ROWS:
                yield batch(out)
                out = []
        yield batch(out)

    return screen


def _settle(percent: int):
    """Cells (sorted by ``cell``) -> links between their components, as pairs of roots."""

    def links(root: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
        rows, columns = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        if not len(rows) or not len(columns):
            return []
        size = np.array([len(x) for x in sets])
        common = common_shingles(sets, rows, columns)
        near = 100 * common >= percent * (size[rows][:, None] + size[columns] - common)
        a, b = np.nonzero(near & (root[rows][:, None] != root[columns]))
        return forest(root, rows[a], columns[b])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for _, rows in _each_cell(batches, "root", "side", "shingles"):
            root, side, sets = zip(*rows, strict=True)
            out += links(np.array(root, np.int64), np.array(side), list(sets))
            if len(out) >= RETURN_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return settle


def _cells(mixed: DataFrame, cell_classes: int, cell_shingles: int, total: int) -> DataFrame:
    """The rows (key, cls, n, root) of buckets that hold several components, dealt to cells: cell, cls, root, side.

    A bucket's cells are a grid: classes outside its largest component are dealt to its rows (side 0), all classes to
    its columns (side 1; side 2 is both), so that each of the former meets each of the latter in one cell.
    """
    by_root = mixed.groupBy("key", "root").agg(F.count("*").alias("m"), F.sum("n").alias("s"))
    grid = (
        by_root.groupBy("key").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.max_by("s", F.struct("m", "root")).alias("main_s"), F.max("m").alias("main_m"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count("*").alias("parts"))
        .where("parts > 1")
        .select(F.col("key").alias("grid_key"), "main", F.col("m").alias("grid_m"), *(F.expr(f"greatest(ceil(({m}) / {cell_classes}), ceil(({s}) / {cell_shingles}))").alias(n) for n, m, s in (("height", "m - main_m", "s - main_s"), ("width", "m", "s"))))
    )
    own = join_groups(mixed, grid, F.col("key") == F.col("grid_key"), "grid_m", total).withColumns({"i": F.expr("pmod(xxhash64(cls, 1), height)"), "j": F.expr("pmod(xxhash64(cls, 2), width)"), "small": F.expr("root <> main")})
    columns = "transform(sequence(0L, height - 1), x -> struct(x AS i, j, if(small and x = i, 2, 1) AS side))"
    rows = "if(small, transform(filter(sequence(0L, width - 1), x -> x <> j), x -> struct(i, x AS j, 0 AS side)), array())"
    dealt = own.select("key", "cls", "root", F.explode(F.expr(f"concat({columns}, {rows})")).alias("at"))
    return dealt.select(F.xxhash64("key", "at.i", "at.j").alias("cell"), "cls", "root", F.col("at.side").alias("side"))


def _marked(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """The ``rows`` whose key (names of columns) is among the keys of ``wanted``, and few others, by marks of bounded size."""
    at = F.expr(f"pmod(xxhash64({wanted_key}), {MARK_BITS})").alias("at")
    marks = wanted.select(at).groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("marks"))
    own = rows.withColumn("__at", F.expr(f"pmod(xxhash64({key}), {MARK_BITS})"))
    hit = F.expr("__at div 64 = word AND shiftrightunsigned(marks, int(__at % 64)) % 2 <> 0")
    return own.join(F.broadcast(marks), hit, "left_semi").drop("__at")


def _met(pairs: DataFrame, values: DataFrame, number: int) -> DataFrame:
    """``number`` pairs (a, b and others) of classes with both classes' ``values`` (cls and others), that get the endings _a and _b.

    What stands first in many pairs is sent once for every LEADER_ROWS of them.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_ROWS).alias("parts"))
    spread = join_groups(pairs, materialize(parts.select(F.col("a").alias("leader"), "parts", (F.col("parts") * LEADER_ROWS).alias("m"))), F.col("a") == F.col("leader"), "m", number)
    spread = spread.select(*pairs.columns, F.expr("pmod(xxhash64(b), parts)").alias("part"))
    one, two = (_marked(values, "cls", pairs, x).select(F.col("cls").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in values.columns if c != "cls")) for x in "ab")
    copies = one.join(parts.where("parts > 1"), "a", "left").withColumn("part", F.explode(F.expr("sequence(0L, coalesce(parts, 1L) - 1)"))).drop("parts")
    return spread.join(two, "b").join(copies, ["a", "part"])


def near_groups(documents: DataFrame, percent: int = PERCENT, cell_classes: int = CELL_CLASSES, cell_shingles: int = CELL_SHINGLES) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id, component (null for an empty set) and kept of every row of ``documents`` (doc_id, text)."""
    docs = documents.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    signed = materialize(docs.mapInArrow(_sign, _SIGNED))
    total = signed.count()
    own = [f"u{i}" for i in range(COLLECTIONS)]
    at = F.min(F.struct("doc_id", "text_key"))
    classes = materialize(
        signed.where("n_shingles > 0").groupBy("cls", "check", "n_shingles").agg(F.min("doc_id").alias("least_id"), at.alias("at"), F.count("*").alias("rows"), *(F.min(c).alias(c) for c in own))
    )
    tables = F.array(*(F.xxhash64(F.lit(t), a, b) for t, (a, b) in enumerate(combinations(own, 2))))
    keys = classes.select("cls", F.col("n_shingles").alias("n"), F.explode(tables).alias("key"))
    number = classes.count()
    pairs = len(own) * (len(own) - 1) // 2 * number
    # Most keys are of one class; what they would lead stays out of the exchange.
    shared = materialize(keys.groupBy(F.col("key").alias("bucket")).agg(F.count("*").alias("m")).where("m > 1"))
    held = materialize(join_groups(keys, shared, F.col("key") == F.col("bucket"), "m", pairs).select("key", "cls", "n"))
    masked = F.struct(F.col("cls").bitwiseXOR(F.lit(MASK)), "cls", "n")
    leaders = (
        held.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("cls", "n")).alias("x"), F.max(F.struct("cls", "n")).alias("y"), F.min(masked).alias("z"))
        .select(F.col("key").alias("bucket"), "m", F.array_distinct(F.array("x", "y", F.struct("z.cls", "z.n"))).alias("leaders"))
    )
    met = join_groups(held, materialize(leaders), F.col("key") == F.col("bucket"), "m", held.count())
    members = materialize(met.select("key", "cls", "n", "leaders", (F.col("m") > F.size("leaders") + 1).alias("open")))
    discard(shared, held)

    # The text of one row of each class; a class's rows of that id and text may be many.
    chosen = classes.join(members.select("cls").distinct(), "cls", "left_semi").select("cls", "rows", F.col("at.doc_id").alias("p_id"), F.col("at.text_key").alias("p_key"))
    chosen = materialize(chosen)
    found = join_groups(_marked(docs, "doc_id, text_key", chosen, "p_id, p_key"), chosen, F.col("doc_id").eqNullSafe(F.col("p_id")) & (F.col("text_key") == F.col("p_key")), "rows", total)
    texts = found.select("cls", "text").dropDuplicates(["cls"])
    sets = materialize(texts.mapInArrow(_class_sets, "cls long, size long, shingles binary, sketch binary"))

    meets = members.select("cls", "n", F.explode("leaders").alias("l")).where(f"cls <> l.cls and 100 * least(n, l.n) >= {percent} * greatest(n, l.n)")
    stars = materialize(meets.select(F.col("l.cls").alias("a"), F.col("cls").alias("b")).distinct())
    sketches, full = sets.select("cls", "size", F.col("sketch").alias("own")), sets.select("cls", F.col("shingles").alias("set"))
    near = materialize(_met(stars, sketches, stars.count()).select("a", "b", "own_a", "size_a", "own_b", "size_b").mapInArrow(_maybe_linked(percent), "a long, b long"))
    links = materialize(_met(near, full, near.count()).select("a", "b", "set_a", "set_b").mapInArrow(_linked(percent), "a long, b long"))
    roots = connected_components(links)

    # A bucket of no more classes than its leaders and one has had all its pairs compared.
    placed = members.where("open").select("key", "cls", "n").join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    cells = _cells(materialize(placed), cell_classes, cell_shingles, pairs).join(sets.select("cls", "size", "sketch"), "cls")
    possible = materialize(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_possible(percent), _POSSIBLE))
    few = possible.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b"), F.col("root").alias("root_a"), F.col("other_root").alias("root_b"))
    few = materialize(few.distinct())
    joined = materialize(_met(few, full, few.count()).select("a", "set_a", "set_b", "root_a", "root_b").mapInArrow(_linked(percent, "root_a", "root_b"), "a long, b long"))
    many = possible.where("other IS NULL").select("cell", "cls", "root", "side")
    many = _marked(sets.select("cls", "shingles"), "cls", many, "cls").join(many, "cls")
    settled = materialize(many.repartition("cell").sortWithinPartitions("cell").select("cell", "root", "side", "shingles").mapInArrow(_settle(percent), "a long, b long"))
    discard(members, sets)
    last = connected_components(joined.unionByName(settled))

    whole = classes.groupBy("cls").agg(F.min("least_id").alias("least_id"), F.sum("rows").alias("rows")).join(roots.withColumnRenamed("node", "cls"), "cls", "left")
    whole = materialize(whole.select("cls", "least_id", "rows", F.coalesce("root", "cls").alias("first")))
    firsts = whole.groupBy("first").agg(F.min("least_id").alias("least_id"), F.count("*").alias("m")).join(last.withColumnRenamed("node", "first"), "first", "left")
    firsts = materialize(firsts.select(F.col("first").alias("start"), "least_id", "m", F.coalesce("root", "first").alias("component")))
    least = firsts.groupBy(F.col("component").alias("own")).agg(F.min("least_id").alias("component_id"), F.count("*").alias("starts"))
    placed = join_groups(firsts.select("start", "m", "component"), materialize(least), F.col("component") == F.col("own"), "starts", number)
    named = join_groups(whole.select("cls", "rows", "first"), materialize(placed.select("start", "m", "component", "component_id")), F.col("first") == F.col("start"), "m", number)
    named = named.select(F.col("cls").alias("named"), "rows", "component_id", "component")
    linked = join_groups(signed.where("n_shingles > 0"), materialize(named), F.col("cls") == F.col("named"), "rows", total).select("doc_id", "text_key", "n_shingles", "component_id", "component")
    empty = signed.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component"))
    return linked.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``documents`` (and every empty set), with their columns as they were."""
    return one_row_each(documents, materialize(near_groups(documents, percent).select("doc_id", "text_key", "kept", F.col("component").alias("grp"))))
