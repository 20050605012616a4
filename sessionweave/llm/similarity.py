"""Near copies by the share of common shingles: SimHash fingerprints choose candidates, which are then verified exactly.

Two texts are near copies if their sets of five-word shingles have a Jaccard similarity of 0.8 or more. The fingerprints of such texts
can differ in many bits, too many for popcounts to choose by. So besides its whole fingerprint, which the segment-popcount grid
of `simhash` joins at two bits or fewer, a text has the fingerprints of `SAMPLES` samples of `SAMPLED` shingles, the least under as many
orders. Texts of similarity s have equal fingerprints in one sample or more with a chance of 1 - (1 - s^5)^24, that is 0.9999 at
0.8 and more above. Each candidate pair's similarity is computed from the whole shingle sets.

Texts with one fingerprint in common form a cell. Copies (equal words) are folded into one text first. Two rounds follow:

1. Each text of a cell is compared with the cell's head, the first one in a random order that is the same for all cells. That joins
   nearly all near copies, at one candidate per text and cell however full a cell is.
2. Cells that then hold several groups are looked at once more, for candidates between groups only. In a cell of up to `DENSE_CELL`
   texts all of them are taken. The texts of fuller cells, blocks by their cells' largest groups, are joined by their deviations: the shingles
   that a text has besides those that over half of the block has, and those that it lacks of them. Two texts differ in as many shingles as
   both deviate by, less twice what their deviations have in common. So w, a text's deviations less its share of what a link allows, decides: the
   text of least w is linked to all whose w it makes up for, without a comparison; others link only if their deviations have half the sum of
   their w in common, so that they meet by one of the rarest. That is exact. Copies with changes of their own share few deviations, however many they are.

A candidate passes if sketches allow the similarity. A sketch cuts the range of hashes into 512 bins and has three bits a bin: whether the text
has a hash there, and the last two bits of the least one. Of the N bins that either of two texts has, those with equal least hashes are a sample of
their common shingles, taken without replacement; how many they are is told by the last bits, which unequal hashes share by chance one time in four. Both
deviations are known, and four of them are allowed, so a pair at 0.8 fails with a chance of about 3e-5; for texts of few shingles the
sample is nearly the whole set. Pairs that pass are verified on the whole sets. The second round tests sketches where candidates meet, so that those
that fail are neither shuffled nor written.

Texts don't move with their fingerprints: a row is known by its place in the stored table (Parquet file and row), by which the few texts that have to
be verified are fetched and the rows that go are left out. Lists of such rows are broadcast up to `SENT` rows, beyond that joined by
a shuffle. Tables that aren't read from files are written once.

Nulls and edge cases: a null text counts as empty; texts without words are copies of each other; texts of fewer than five words have
one shingle, the whole sequence; null and repeated ids play no part, as groups are of texts; columns are carried under any name but that of the id and
the text; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Table, as_bytes, shuffled, slices, source_of, with_few
from .components import connected_components
from .simhash import fingerprints_of_hashes, links, shingle_hashes

SAMPLES = 24
SAMPLED = 5
#: Texts of a cell beyond which the second round goes by prefixes.
DENSE_CELL = 64
#: Longs of each of the three parts of a sketch, 64 bins each.
SKETCH = 8
#: Rows of a list that is broadcast, of some 80 bytes each.
SENT = 500_000
#: Candidates of one text that one task verifies.
_PARTNERS = 1024
#: Odd factors, one for each order of the shingles' hashes.
_ORDERS = np.array([xxhash.xxh64_intdigest(bytes([k]), 7) | 1 for k in range(SAMPLES)], np.uint64)
#: Hashes ordered at once; bounds the memory that a very long text takes.
_STEP = 1 << 20


def samples_of(hashes: np.ndarray) -> np.ndarray:
    """A (SAMPLES, SAMPLED) array of a text's distinct shingle hashes; a text of fewer shingles repeats them."""
    if len(hashes) <= SAMPLED:
        return np.tile(np.resize(hashes, SAMPLED), (SAMPLES, 1))
    step = max(1, _STEP // len(hashes))
    found = [np.argpartition(hashes * _ORDERS[k : k + step, None], SAMPLED - 1, axis=1)[:, :SAMPLED] for k in range(0, SAMPLES, step)]
    return hashes[np.concatenate(found)]


def sketch_of(hashes: np.ndarray) -> np.ndarray:
    """SKETCH longs of occupied bins, twice as many of the last bits there, and the number of hashes, of distinct hashes in order."""
    bins = (hashes >> np.uint64(64 - 6 - (SKETCH.bit_length() - 1))).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    bits = np.zeros((3, 64 * SKETCH), np.uint8)
    bits[0, bins[first]] = 1
    for k in (0, 1):
        bits[1 + k, bins[first]] = hashes[first] >> np.uint64(k) & np.uint64(1)
    return np.append(np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel(), len(hashes))


def prints(source: DataFrame, words: int) -> DataFrame:
    """(i, file, at, copy, h, shingles, fp, samples, sketch) of rows (i, t, file, at): `copy` is a digest of the words, `h` one of the text,
    `shingles` the number of distinct ones."""
    rows = source.select("i", "t", "file", "at")
    own = T.StructType([*(rows.schema[c] for c in ("i", "file", "at")), T.StructField("copy", T.BinaryType()), T.StructField("h", T.LongType()), T.StructField("shingles", T.IntegerType()), T.StructField("fp", T.LongType()), T.StructField("samples", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            texts = as_bytes(part.column(1))
            hashes = [np.array(shingle_hashes(t, words), np.uint64) for t in texts]
            sets = [np.unique(h) for h in hashes]
            full = [k for k, s in enumerate(sets) if len(s)]
            sampled = iter(fingerprints_of_hashes([r for k in full for r in samples_of(sets[k])]).view(np.int64).reshape(-1, SAMPLES).tolist())
            columns = [
                *(part.column(k) for k in (0, 2, 3)),
                pa.array([xxhash.xxh3_128_digest(b" ".join(t.lower().split())) for t in texts], pa.binary()),
                pa.array(np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array(fingerprints_of_hashes(hashes).view(np.int64)),
                pa.array([next(sampled) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                pa.array([sketch_of(s) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=own.names)

    return rows.mapInArrow(run, own)


def placed(source: DataFrame) -> DataFrame:
    """Rows with the file and place that they are stored at. Raises AnalysisException if they aren't read from files."""
    return source.select("*", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))


def fetched(source: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """Rows of the source joined with rows (file, at, ...) by their place."""
    return with_few(source, rows, ["file", "at"], how, SENT)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, found): the hashes of each text's distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            sets = [np.unique(np.array(shingle_hashes(t, words), np.uint64)).view(np.int64) for t in as_bytes(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "found"])

    return texts.select("node", "t").mapInArrow(run, "node long, found array<long>")


def similar_sketches(a: str, b: str, least: float) -> F.Column:
    """Whether both sketches allow that similarity."""
    at = lambda c, part: [F.get(c, part * SKETCH + k) for k in range(SKETCH)]
    total = lambda parts: reduce(lambda x, y: x + y, map(F.bit_count, parts)).cast("double")
    two = lambda f, part: [f(x, y) for x, y in zip(at(a, part), at(b, part), strict=True)]
    common, apart = two(lambda x, y: x.bitwiseAND(y), 0), two(lambda x, y: x.bitwiseXOR(y), 1)
    unlike = [o.bitwiseAND(x.bitwiseOR(y)) for o, x, y in zip(common, apart, two(lambda x, y: x.bitwiseXOR(y), 2), strict=True)]
    both, either = total(common), total(two(lambda x, y: x.bitwiseOR(y), 0))
    equal = (3 * both - 4 * total(unlike)) / 3
    whole = (F.get(a, 3 * SKETCH) + F.get(b, 3 * SKETCH)) / F.lit(1 + least)  # shingles of both, if they are just so similar
    spread = F.lit(least * (1 - least)) * either * F.greatest(F.lit(0.0), 1 - either / whole) + F.greatest(F.lit(0.0), both - F.lit(least) * either) / 3
    return equal >= F.lit(least) * either - 4 * F.sqrt(spread) - 1


def with_end(pairs: DataFrame, end: str, values: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b, ...) with the value (node, value) of one end; those of an end in many pairs are spread over tasks."""
    parts = pairs.groupBy(end).agg(F.expr(f"cast(ceil(count(*) / {_PARTNERS}) as int)").alias("parts"))
    named = shuffled(values.select(F.col("node").alias(end), F.col(value).alias(f"{end}_{value}"))).join(parts, end)
    spread = named.select(end, f"{end}_{value}", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = "b" if end == "a" else "a"
    return shuffled(shuffled(pairs).join(parts, end).withColumn("part", F.pmod(F.hash(other), "parts").cast("int")).drop("parts")).join(spread, [end, "part"]).drop("part")


def ordered(x: str, y: str) -> list[F.Column]:
    """A pair as (a, b), a being the first in a random order of all texts."""
    first = F.xxhash64(x) < F.xxhash64(y)
    return [F.when(first, F.col(x)).otherwise(F.col(y)).alias("a"), F.when(first, F.col(y)).otherwise(F.col(x)).alias("b")]


def verified(candidates: DataFrame, nodes: DataFrame, source: DataFrame, words: int, similarity: float) -> Table:
    """The candidates (a, b) whose shingle sets have that similarity; sets are made of the texts in candidates that pass by sketches."""
    pairs = Table(candidates.distinct(), "candidates")
    compared = with_end(with_end(pairs.df, "a", nodes, "sketch"), "b", nodes, "sketch")
    passed = Table(compared.where(similar_sketches("a_sketch", "b_sketch", similarity)).select("a", "b"), "passed")
    ends = passed.df.select(F.col("a").alias("node")).union(passed.df.select("b")).distinct()
    sets = Table(shingle_sets(fetched(source, shuffled(nodes).join(ends, "node").select("node", "file", "at")), words), "sets")
    common = F.size(F.array_intersect("a_found", "b_found"))
    either = F.size("a_found") + F.size("b_found") - common
    both = with_end(with_end(passed.df, "a", sets.df, "found"), "b", sets.df, "found")
    out = Table(both.where(common >= F.lit(similarity - 1e-9) * either).select("a", "b"), "verified")
    for t in (pairs, passed, sets):
        t.drop()
    return out


def near_sizes(similarity: float) -> F.Column:
    """Whether the numbers of shingles a_shingles and b_shingles allow that similarity."""
    return F.least("a_shingles", "b_shingles") >= F.lit(similarity - 1e-9) * F.greatest("a_shingles", "b_shingles")


def largest_group(cells: DataFrame) -> DataFrame:
    """(cell, most) of the cells (cell, group, ...) with several groups: the one with the most texts."""
    by_group = cells.groupBy("cell", "group").agg(F.count("*").alias("n"))
    return by_group.groupBy("cell").agg(F.max_by("group", F.struct("n", "group")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")


def pairs_apart(cells: DataFrame, similarity: float, *more: F.Column) -> DataFrame:
    """Candidates (a, b) of different groups of cells (cell, node, shingles, group, sketch, ...): all that numbers of shingles, `more` and sketches allow."""
    named = shuffled(cells).join(largest_group(cells), "cell")
    left, right = (named.select("cell", "most", *(F.col(c).alias(f"{n}_{c}") for c in cells.columns if c != "cell")) for n in "ab")
    once = (F.col("b_group") == F.col("most")) | (F.col("a_node") < F.col("b_node"))
    allowed = [F.col("a_group") != F.col("b_group"), once, near_sizes(similarity), *more, similar_sketches("a_sketch", "b_sketch", similarity)]
    met = shuffled(left.where("a_group <> most")).join(right.drop("most"), "cell").where(reduce(lambda x, y: x & y, allowed))
    return met.select(*ordered("a_node", "b_node"))


def deviations(texts: DataFrame, sets: DataFrame, similarity: float) -> Table:
    """(block, node, shingles, group, off, w) of texts (block, node, shingles, group): what a text has besides the shingles that over half of its
    block's texts have, and what it lacks of them, as one set; `w` is its size less the share of the text's shingles that a link allows."""
    held = shuffled(texts).join(sets, "node")
    counts = held.select("block", F.explode("found").alias("x")).groupBy("block", "x").agg(F.count("*").alias("n"))
    usual = Table(counts.join(texts.groupBy("block").agg(F.count("*").alias("all")), "block").where("2 * n > all").select("block", "x"), "usual")
    few = usual.df.limit(SENT + 1).count() <= SENT
    arrays = usual.df.groupBy("block").agg(F.collect_list("x").alias("usual"))
    both = held.join(F.broadcast(arrays) if few else shuffled(arrays), "block", "left").withColumn("usual", F.coalesce("usual", F.expr("cast(array() as array<long>)")))
    off = F.concat(F.array_except("found", "usual"), F.array_except("usual", "found"))
    share = (1 - similarity + 1e-9) / (1 + similarity - 1e-9)
    out = Table(both.select("block", "node", "shingles", "group", off.alias("off")).withColumn("w", F.size("off") - F.lit(share) * F.col("shingles")), "deviations")
    usual.drop()
    return out


def linked_by_hubs(apart: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of a block's texts with its hub, the text of least w, that follow from w alone; and the texts with the groups that these
    links make, `within` the hub's or not, and `other`, the least w that a partner in another group can have."""
    hubs = apart.groupBy("block").agg(F.min(F.struct("w", F.xxhash64("node").alias("h"), "node", "group")).alias("hub"))
    named = with_few(apart, hubs, ["block"], "inner", SENT).withColumn("near", F.col("w") + F.col("hub.w") <= 0)
    links = named.where("near and node <> hub.node").select(F.col("node").alias("a"), F.col("hub.node").alias("b"))
    joined = named.groupBy("block", "group").agg(F.expr("bool_or(near or group = hub.group)").alias("within"), F.min("w").alias("least"))
    beyond = joined.groupBy("block").agg(F.min(F.when(~F.col("within"), F.col("least"))).alias("beyond"))
    regrouped = with_few(with_few(named, joined.drop("least"), ["block", "group"], "inner", SENT), beyond, ["block"], "inner", SENT)
    own = F.when(F.col("within"), F.col("hub.group")).otherwise(F.col("group"))
    other = F.when(F.col("within"), F.col("beyond")).otherwise(F.col("hub.w"))
    return links, regrouped.select("block", "node", "shingles", own.alias("group"), "off", "w", "within", other.alias("other")).where("beyond is not null")


def cells_of_deviations(texts: DataFrame) -> Table:
    """(cell, node, shingles, group, w, v): the deviations by which texts of different groups can meet, the rarest first. Two texts whose deviations
    have i in common differ in as many shingles as both have deviations, less 2 i; so they link if 2 i reaches the sum of their w. i is no more than
    the deviations that a text shares with any other, so neither text's w exceeds the other's `v`."""
    entries = texts.select("block", "node", F.explode("off").alias("x")).withColumn("cell", F.xxhash64("block", "x")).drop("x")
    frequent = entries.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    own = Window.partitionBy("block", "node")
    placed = shuffled(entries).join(frequent, "cell").withColumns({"place": F.row_number().over(own.orderBy("n", "cell")), "common": F.count("*").over(own)})
    needed = F.greatest(F.lit(1), F.ceil((F.col("w") + F.col("other")) / 2 - 1e-6))
    whole = shuffled(placed).join(texts.drop("off"), ["block", "node"]).withColumn("v", 2 * F.col("common") - F.col("w") + 1e-6)
    met = Table(whole.where(F.col("place") <= F.col("common") - needed + 1), "met")
    best = met.df.groupBy("block").agg(F.max("v").alias("best"))
    out = Table(with_few(met.df, best, ["block"], "inner", SENT).where("within or w <= best").select("cell", "node", "shingles", "group", "w", "v"), "cells")
    met.drop()
    return out


def groups(copies: DataFrame, source: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, group) of written copies (node, file, at, shingles, fp, samples, sketch): `group` is the least node that links of that
    similarity reach."""
    scratch: list[Table] = []

    def stays(table: Table) -> DataFrame:
        scratch.append(table)
        return table.df

    def kept(df: DataFrame, name: str) -> DataFrame:
        return stays(Table(df, name))

    nodes = copies.where("shingles > 0")
    entries = nodes.select("node", "shingles", F.explode(F.array_distinct(F.array_append("samples", F.col("fp")))).alias("cell"))
    head = F.min(F.struct(F.xxhash64("node").alias("h"), "node", "shingles"))
    sizes = entries.groupBy("cell").agg(F.count("*").alias("count"), head.alias("head")).where("count > 1")
    cells = kept(shuffled(entries).join(sizes, "cell").select("cell", "node", "shingles", "count", F.col("head.node").alias("a_node"), F.col("head.shingles").alias("a_shingles")), "cells")
    firsts = cells.withColumn("b_shingles", F.col("shingles")).where(near_sizes(similarity) & (F.col("node") != F.col("a_node"))).select(*ordered("a_node", "node"))
    distinct = kept(nodes.groupBy("fp").agg(F.min("node").alias("rep")), "distinct")
    near = links(distinct).select(*ordered("a", "b"))
    found = stays(verified(firsts.union(near), nodes, source, words, similarity))
    known = connected_components(found)
    grouped = shuffled(cells.select("cell", "node", "shingles", "count")).join(known, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")
    several = grouped.groupBy("cell").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("cell")
    mixed = kept(shuffled(grouped).join(several, "cell"), "mixed")
    sketches = nodes.select("node", "sketch")
    apart = [pairs_apart(shuffled(mixed.where(F.col("count") <= DENSE_CELL).drop("count")).join(sketches, "node"), similarity)]
    full = mixed.where(F.col("count") > DENSE_CELL)
    if not full.isEmpty():
        dense = kept(shuffled(full).join(largest_group(full), "cell").select(F.col("most").alias("block"), "node", "shingles", "group").distinct(), "dense")
        sets = kept(shingle_sets(fetched(source, shuffled(nodes).join(dense, "node", "left_semi").select("node", "file", "at")), words), "dense_sets")
        by_hubs, texts = linked_by_hubs(stays(deviations(dense, sets, similarity)))
        met = stays(cells_of_deviations(kept(texts, "regrouped")))
        fits = (F.col("a_w") <= F.col("b_v")) & (F.col("b_w") <= F.col("a_v"))
        apart.append(pairs_apart(shuffled(met).join(sketches, "node"), similarity, fits))
        found = found.union(kept(by_hubs, "hubs"))
    more = stays(verified(reduce(DataFrame.union, apart), nodes, source, words, similarity))
    reached = connected_components(found.union(more))
    for t in scratch:
        t.drop()
    return shuffled(copies.select("node")).join(reached, "node", "left").select("node", F.coalesce("component", "node").alias("group"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, carry: Sequence[str] = ()) -> DataFrame:
    """(id, text) and the columns to carry, of one row of each group of near copies: the one with the least id (nulls last), then hash
    of the text; of equal rows any one."""
    first, ids, carried = source_of(docs, id_col, text_col, carry, [text_col])
    try:
        source = placed(first)
        made = Table(prints(source, words), "prints")
        unique = made.df.groupBy("file", "at").count().where("count > 1").isEmpty()
    except AnalysisException:
        unique = False
    if not unique:
        source = placed(Table(first, "documents").df)
        made = Table(prints(source, words), "prints")
    order = F.struct(F.col("i").isNull().alias("unnamed"), "i", "h", "file", "at")
    rest = [F.first(c).alias(c) for c in ("shingles", "fp", "samples", "sketch")]
    folded = made.df.groupBy("copy").agg(F.min(order).alias("least"), *rest)
    copies = Table(folded.select(F.monotonically_increasing_id().alias("node"), "least", "least.file", "least.at", "shingles", "fp", "samples", "sketch"), "copies")
    named = groups(copies.df, source, words, similarity)
    stay = Table(shuffled(copies.df).join(named, "node").groupBy("group").agg(F.min("least").alias("least")).select("least.file", "least.at"), "stay")
    gone = shuffled(made.df.select("file", "at")).join(stay.df, ["file", "at"], "left_anti")
    few = gone.limit(SENT + 1).count() <= SENT
    left = fetched(source, Table(gone, "gone").df, "left_anti") if few else fetched(source, stay.df, "left_semi")
    made.drop()
    copies.drop()
    return left.select(*ids, F.col("t").alias(text_col), *carried)
