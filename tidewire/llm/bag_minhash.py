"""Near-duplicates by weighted MinHash signatures of shingle counts, bands and exact checks.

A text is a bag of runs of SHINGLE words. Each shingle with each unit of its count drives a
Poisson process of points in time, and each point falls on one of REGISTERS registers; a register
keeps its earliest point. Units of weight are grouped in blocks that double, (0,1], (1,2], (2,4],
..., one process a block with the block's width as its rate; of the last block, points on units
beyond the count are thinned out. So a count costs the logarithm of its size, and two texts
agree in a register with the probability of their weighted Jaccard similarity. A process stops
when its time is past the last of the text's registers.

Texts that share a band of ROWS registers are candidates. Equal texts are one node from
the start. In groups of up to SMALL nodes all pairs are checked. In larger ones two pivots are
checked against all others first, and what hangs together then is a class. The nodes outside a group's largest
class are then held against all of the group's nodes of other classes, in blocks of BLOCK by BLOCK nodes
inside the tasks, which write links only. So no link between classes is lost, and what is
written grows in proportion to a group, not with its square. Pairs are sorted out by the sizes of
the bags and by the registers that agree, and the rest by the exact overlap of their bags.

Defined results: null texts count as empty; texts without words are only like equal texts;
texts of fewer than SHINGLE words are one shingle; a class is known by its smallest id (null if it has none);
equal rows are in one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm import words
from tidewire.llm.bitmaps import bitmap
from tidewire.llm.components import components
from tidewire.llm.tables import checked_broadcast
from tidewire.operators.lineage import stored

SHINGLE = 5
SIMILAR = 0.8
REGISTERS = 128
ROWS = 4
BANDS = REGISTERS // ROWS
#: Least part of agreeing registers with which a pair is checked exactly: six standard
#: deviations below SIMILAR.
LEAST_AGREEING = 0.59
SMALL = 16
PIVOTS = 2
SALTS = 32
BLOCK = 1024
BITMAP_BITS = 26
U64 = np.uint64


def bags(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the texts (sorted in each), how often each occurs, and its text."""
    h, bounds = words.hashes(texts, words.ALNUM, by_character=True)
    shingle, _, text = words.runs(h, bounds, SHINGLE)
    count = np.diff(bounds)
    for k in range(1, SHINGLE):
        short = np.flatnonzero(count == k)
        if len(short):
            value = np.zeros(len(short), U64)
            for i in range(k):
                value = value * U64(words.BASE) + h[bounds[short] + i]
            shingle = np.concatenate([shingle, words.mixed(value)])
            text = np.concatenate([text, short])
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingle[1:] != shingle[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return shingle[first], np.diff(np.concatenate([first, [len(order)]])), text[first]


def registers(shingle: np.ndarray, weight: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """The times of the registers' earliest points, a row for each text (infinite for empty bags)."""
    out = np.full((texts, REGISTERS), np.inf)
    flat = out.reshape(-1)
    streams = [(shingle, text, np.ones(len(text)), weight, np.zeros(len(text), np.int64))]
    block = 1
    while (more := weight > (1 << (block - 1))).any():
        shingle, text, weight = shingle[more], text[more], weight[more]
        width = 1 << (block - 1)
        seed = words.mixed(shingle + U64(block * 0x632BE59BD9B4E019 % (1 << 64)))
        streams.append((seed, text, np.full(len(text), float(width)), weight, np.full(len(text), width)))
        block += 1
    seed, owner, rate, limit, low = (np.concatenate(x) for x in zip(*streams, strict=True))
    time = np.zeros(len(seed))
    drawn = 0
    while len(seed):
        some = int(np.clip(20_000 // len(seed), 1, 64))
        draws = words.mixed(seed[:, None] + (np.arange(drawn + 1, drawn + some + 1).astype(U64) * U64(0xD1B54A32D192ED03)))
        gaps = -np.log(((draws >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate[:, None]
        gaps[:, 0] += time
        times = np.cumsum(gaps, axis=1)
        other = words.mixed(draws ^ U64(0xA0761D6478BD642F))
        place = owner[:, None] * REGISTERS + (other & U64(REGISTERS - 1)).astype(np.int64)
        # The unit of weight on which a point falls; the first blocks have but one.
        unit = low[:, None] + 1 + ((other >> U64(32)).astype(np.float64) * 2.0**-32 * rate[:, None]).astype(np.int64)
        inside = (unit <= limit[:, None]) & (times < out.max(axis=1)[owner][:, None])
        np.minimum.at(flat, place[inside], times[inside])
        time = times[:, -1]
        drawn += some
        going = time < out.max(axis=1)[owner]
        seed, owner, rate, limit, low, time = (x[going] for x in (seed, owner, rate, limit, low, time))
    return out


def signatures(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each text BANDS numbers with ROWS registers of 16 bits each, and the size of its bag."""
    shingle, weight, text = bags(texts)
    times = registers(shingle, weight, text, len(texts))
    short = (words.mixed(times.view(U64)) >> U64(48)).astype(np.uint16)
    return short.reshape(len(texts), -1).view(np.int64), np.bincount(text, weights=weight, minlength=len(texts)).astype(np.int64)


def _bytes_and_node(docs: DataFrame) -> DataFrame:
    return words.small_batches(docs).select("node", F.col("text").cast("string").cast("binary").alias("text"))


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes | None]]]:
    """Nodes and texts of a batch, about a megabyte at a time, each node once."""
    lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for start, end in words.parts(lengths):
        yield batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start).to_pylist()


def signed(docs: DataFrame) -> DataFrame:
    """Rows (node, size, bands) for the distinct texts of ``docs`` (node, text) that have words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for nodes, texts in _pieces(batch):
                bands, size = signatures(texts)
                full = np.flatnonzero(size)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(bands[full].reshape(-1)), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [nodes.take(pa.array(full)), pa.array(size[full]), lists.cast(pa.list_(pa.int64()))],
                    names=["node", "size", "bands"],
                )

    made = _bytes_and_node(docs).mapInArrow(run, "node long, size long, bands array<long>")
    # Copies within a task meet before they are shuffled.
    return made.dropDuplicates(["node"])


def packed_bag(shingle: np.ndarray, weight: np.ndarray) -> bytes:
    """A bag as bytes: 40 bits of each distinct shingle in order, then the counts if one is over 1."""
    kept = shingle.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()
    counts = weight.astype(np.uint32).tobytes() if weight.max(initial=1) > 1 else b""
    return len(shingle).to_bytes(4, "little") + kept + counts


def unpacked_bag(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    wide = np.zeros((n, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(data, np.uint8, 5 * n, 4).reshape(n, 5)
    rest = data[4 + 5 * n :]
    return wide.reshape(-1).view(U64), np.frombuffer(rest, np.uint32) if rest else np.ones(n, np.uint32)


def overlap(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two packed bags."""
    (ka, wa), (kb, wb) = unpacked_bag(a), unpacked_bag(b)
    keys, counts = np.concatenate([ka, kb]), np.concatenate([wa, wb]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    both = keys[1:] == keys[:-1]
    common = int(np.minimum(counts[1:], counts[:-1])[both].sum())
    return common / max(1, int(counts.sum()) - common)


def bagged(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (node, bag) for (at least) ``nodes``, from the whole texts of ``docs`` (node, text)."""
    wanted = bitmap(nodes.select("node"), BITMAP_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            hit = np.flatnonzero(wanted.has(batch.column(0).to_numpy(zero_copy_only=False)))
            for nodes, texts in _pieces(batch.take(pa.array(hit))):
                shingle, weight, text = bags(texts)
                edges = np.searchsorted(text, np.arange(len(texts) + 1))
                rows = []
                for node, a, b in zip(nodes.to_pylist(), edges, edges[1:], strict=False):
                    if node not in seen and b > a:
                        seen.add(node)
                        rows.append((node, packed_bag(shingle[a:b], weight[a:b])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                    names=["node", "bag"],
                )

    return _bytes_and_node(docs).mapInArrow(run, "node long, bag binary").dropDuplicates(["node"])


def agreeing(pairs: DataFrame) -> DataFrame:
    """Of rows (a, b, salt, size_a, size_b, bands_a, bands_b) the (a, b, salt) that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [
                batch.column(i).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(batch.num_rows, -1)
                for i in (3, 4)
            ]
            good = np.flatnonzero((sides[0] == sides[1]).mean(axis=1) >= LEAST_AGREEING) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([c.take(pa.array(good, pa.int64())) for c in batch.columns[:3]], names=["a", "b", "salt"])

    # A bag can't overlap another one by SIMILAR if it is smaller than that part of it.
    near = F.least("size_a", "size_b") >= F.lit(SIMILAR) * F.greatest("size_a", "size_b")
    return pairs.filter(near).select("a", "b", "salt", "bands_a", "bands_b").mapInArrow(run, "a long, b long, salt int")


def verified(pairs: DataFrame, bag: DataFrame) -> DataFrame:
    """The links (a, b, similarity) among ``pairs`` (a, b, salt).

    Side b of a large group's pairs is one of few pivots: its bag is copied to as many salts as its pairs have.
    """
    sides = pairs.select("b", "salt").distinct().join(bag.withColumnsRenamed({"node": "b", "bag": "bag_b"}), "b")
    both = pairs.join(bag.withColumnsRenamed({"node": "a", "bag": "bag_a"}), "a").join(sides, ["b", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = [overlap(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.float64())], names=["a", "b", "similarity"])

    checked = both.select("a", "b", "bag_a", "bag_b").mapInArrow(run, "a long, b long, similarity double")
    return checked.filter(F.col("similarity") >= SIMILAR)


def _with_bands(pairs: DataFrame, sign: DataFrame, side: str) -> DataFrame:
    return pairs.join(sign.withColumnsRenamed({"node": side, "size": f"size_{side}", "bands": f"bands_{side}"}), side)


def _pivot_pairs(members: DataFrame, sign: DataFrame) -> DataFrame:
    """Pairs (a, b, salt, size_a, bands_a, size_b, bands_b) of each group's pivots with its nodes."""
    slot = F.pmod(F.xxhash64("node"), F.lit(PIVOTS))
    pivots = members.groupBy("band", "key", slot.alias("slot")).agg(F.min("node").alias("b"))
    pairs = (
        members.withColumnRenamed("node", "a")
        .join(_with_bands(pivots, sign, "b"), ["band", "key"])
        .filter(F.col("a") != F.col("b"))
        .withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int"))
        .select("a", "b", "salt", "size_b", "bands_b")
        .dropDuplicates(["a", "b"])
    )
    return _with_bands(pairs, sign, "a")


def _blocked(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (band, key, left, right, outside, node, root): the blocks of groups with several classes.

    ``outside`` rows are the nodes outside the group's largest class, in the left block; the others
    are all of its nodes, in the right block.
    """
    now = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = (
        now.groupBy("band", "key", "root")
        .count()
        .groupBy("band", "key")
        .agg(F.max(F.struct("count", "root")).alias("top"), F.sum("count").alias("n"))
        .filter(F.col("n") > F.col("top.count"))
        .select(
            "band",
            "key",
            F.col("top.root").alias("largest"),
            F.ceil((F.col("n") - F.col("top.count")) / F.lit(BLOCK)).alias("lefts"),
            F.ceil(F.col("n") / F.lit(BLOCK)).alias("rights"),
        )
    )
    opened = now.join(groups, ["band", "key"])
    place = F.xxhash64("node")
    blocks = ("band", "key", "left", "right", "outside", "node", "root")
    every = opened.withColumns({
        "left": F.explode(F.sequence(F.lit(0).cast("long"), F.col("lefts") - F.lit(1))),
        "right": F.pmod(place, F.col("rights")),
        "outside": F.lit(False),
    })
    outside = opened.filter(F.col("root") != F.col("largest")).withColumns({
        "left": F.pmod(place, F.col("lefts")),
        "right": F.explode(F.sequence(F.lit(0).cast("long"), F.col("rights") - F.lit(1))),
        "outside": F.lit(True),
    })
    return every.select(*blocks).union(outside.select(*blocks))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _links_between(table: pa.Table) -> pa.Table:
    """Links (a, b, similarity) that join classes of one pair of blocks."""
    band = table.column("band")[0].as_py()
    is_left = _column(table, "outside").astype(bool)
    node, root, size = (_column(table, c) for c in ("node", "root", "size"))
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
    fields = bands.view(np.uint16).reshape(len(node), REGISTERS)
    bag = table.column("bag")
    left, right = np.flatnonzero(is_left), np.flatnonzero(~is_left)
    outside = np.isin(node[right], node[left])
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while x in parent:
            x = parent[x]
        return x

    found = []
    for u in left:
        part = (fields[right] == fields[u]).mean(axis=1)
        near = (part >= LEAST_AGREEING) & (root[right] != root[u])
        near &= np.minimum(size[right], size[u]) >= SIMILAR * np.maximum(size[right], size[u])
        near &= ~outside | (node[right] > node[u])  # two nodes outside meet once
        at = np.flatnonzero(near)
        # A pair is looked at in the first band that it shares.
        at = at[(bands[right[at]] == bands[u]).argmax(axis=1) == band]
        for x in right[at[np.argsort(-part[at], kind="stable")]]:
            one, two = top(int(root[u])), top(int(root[x]))
            if one != two and (value := overlap(bag[int(u)].as_py(), bag[int(x)].as_py())) >= SIMILAR:
                parent[max(one, two)] = min(one, two)
                found.append((int(node[u]), int(node[x]), value))
    a, b, value = zip(*found, strict=True) if found else ((), (), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "similarity": pa.array(value, pa.float64())})


def links(docs: DataFrame) -> DataFrame:
    """Rows (node, root): the class of every node of ``docs`` (node, text) that is like another text."""
    sign = stored(signed(docs), "signatures")
    keyed = sign.select("node", F.posexplode("bands").alias("band", "key"))
    groups = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    members = stored(keyed.join(groups, ["band", "key"]), "members")

    small = members.filter(F.col("n") <= SMALL).groupBy("band", "key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    paired = (
        small.select(F.posexplode("nodes").alias("at", "a"), "nodes")
        .select("a", F.explode(F.expr("slice(nodes, at + 2, size(nodes))")).alias("b"))
        .distinct()
        .withColumn("salt", F.lit(0))
    )
    large = members.filter(F.col("n") > SMALL).drop("n")
    near = stored(
        agreeing(_with_bands(_with_bands(paired, sign, "a"), sign, "b"))
        .union(agreeing(_pivot_pairs(large, sign)))
        .dropDuplicates(["a", "b"]),
        "pairs",
    )
    nodes = near.select(F.col("a").alias("node")).union(near.select("b")).union(large.select("node")).distinct()
    bag = stored(bagged(docs, nodes), "bags")
    found = stored(verified(near, bag), "links")
    roots = components(found)

    blocks = _blocked(large, roots).join(sign.join(bag, "node"), "node")
    between = stored(
        blocks.groupBy("band", "key", "left", "right").applyInArrow(_links_between, "a long, b long, similarity double"),
        "links",
    )
    return roots if between.isEmpty() else components(found.union(between))


def node(text: Column) -> Column:
    """The number of a text; equal texts have equal ones."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (node, class_id, class_node, class_size) for every node that has copies or similar texts."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), node(F.col(text)).alias("node"))
    roots = links(rows)
    copies = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    several = stored(
        copies.join(roots, "node", "left")
        .filter((F.col("copies") > 1) | F.col("root").isNotNull())
        .withColumn("root", F.coalesce("root", "node")),
        "copies",
    )
    # Of a class, the smallest id comes first, then the smallest node; nodes without an id come last.
    order = F.struct(F.col("first").isNull(), "first", "node")
    heads = several.groupBy("root").agg(F.min(order).alias("head"), F.sum("copies").alias("class_size"))
    return several.join(heads, "root").select(
        "node", F.col("head.first").alias("class_id"), F.col("head.node").alias("class_node"), "class_size"
    )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, class_id, class_size), one for each document."""
    found = checked_broadcast(classes(docs, key, text), "classes")
    rows = docs.select(F.col(key).alias("doc_id"), node(F.col(text)).alias("node"))
    alone = F.col("class_node").isNull()
    return rows.join(found, "node", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
    )


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each class: that with the smallest id, of equal ones any."""
    found = checked_broadcast(classes(docs, key, text).withColumnRenamed("node", "_node"), "classes")
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("_id"), node(F.col(text)).alias("_own"))
    joined = rows.join(found, F.col("_own") == F.col("_node"), "left")
    alone = joined.filter(F.col("_node").isNull()).select("row.*")
    heads = joined.filter(F.col("_own") == F.col("class_node")).filter(F.col("_id").eqNullSafe(F.col("class_id")))
    return alone.unionByName(heads.dropDuplicates(["_own"]).select("row.*"))
