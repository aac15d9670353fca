"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Documents whose five-word shingle sets have a Jaccard similarity of at least
`SIMILARITY` are linked; a class is a connected component, named by its least
doc_id. A text of one to four words is one shingle; texts without words are
classes of their own.

1. One narrow pass makes a digest of each text's words and the band keys of its
   ProbMinHash signature. Equal digests are one node, by an aggregation that
   combines on the map side, so large groups of copies vanish here.
2. Nodes that share a band key form a bucket. Each is verified against the
   bucket's least node (a star, not all pairs), and the links' components found.
3. Buckets that then lie in one component hold nothing unknown. In the others,
   all nodes of different components are compared, in tiles of two blocks of
   bounded rows and bytes (`dealt_blocks`), and only links are emitted. No bucket,
   partner or candidate is capped.
4. Components of all links, joined back to all documents; classes of the texts
   with most copies are broadcast (`HOT_SHARE` texts at most).

Signatures estimate the probability Jaccard of weights between 1 and
`probminhash.HEAVIEST` (a shingle that repeats weighs more), verification computes
the sets' similarity, so the former is at least the latter / HEAVIEST. With 48
bands of 7 registers two texts at set similarity 0.8 share a bucket with
probability 0.99999 if no shingle repeats, and 0.9996 at the worst weights; at 0.5
with 0.31.

Rows are classed by their text; null texts are empty; null doc_ids get a null
class; where rows repeat a doc_id with different texts, each row has its own
text's class, and texts whose least doc_id is the same count as one document, so
their classes are one (`keep_one` keeps each of these texts once); an empty table
gives an empty result; further columns are ignored (and kept by `keep_one`).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotline.llm import common, probminhash
from shotline.llm.components import components

SIMILARITY = 0.8
BANDS, ROWS = 48, 7
#: Texts that at least one row in so many holds (at most so many texts) get their class by broadcast.
HOT_SHARE = 1_000
#: Members of one block of a bucket, and bytes of their shingles (8 each).
BLOCK_ROWS = 256
BLOCK_BYTES = 8 << 20


def _row() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, row, content, n, keys): hash of the text, digest of the words, number of distinct shingles, band keys (none without words)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = batch.column("text").to_pylist()
        sets = [probminhash.weighted(t) for t in found]
        keys = probminhash.bands(probminhash.signatures(sets, bands * rows), rows).view(np.int64)
        content = [xxhash.xxh3_128_digest(" ".join(t.split()).encode()) for t in found]
        sizes = [len(h) for h, _ in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("row"), pa.array(content, pa.binary()), pa.array(sizes, pa.int64()), pa.array([k if n else None for k, n in zip(keys, sizes, strict=True)], pa.list_(pa.int64()))],
            ["doc_id", "row", "content", "n", "keys"],
        )

    return common.over_batches(common.texts(docs, _row().alias("row")), run, "doc_id long, row long, content binary, n long, keys array<long>")


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The (a, b) of `pairs` whose texts' shingle sets are similar enough."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    found = common.checkpointed(common.marked(docs, ids))
    one = found.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    other = found.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    joined = pairs.join(one, "b").join(other, "a").select("a", "b", "text_a", "text_b")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        on, last, kept = [], None, None
        for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            if x != last:
                last, kept = x, np.unique(probminhash.shingles(x))
            on.append(probminhash.jaccard(kept, np.unique(probminhash.shingles(y))) >= similarity)
        return batch.select(["a", "b"]).filter(pa.array(on, pa.bool_()))

    return common.over_batches(joined, run, "a long, b long").distinct()


def _within(members: list[tuple[int, int, bool, bytes]], similarity: float):
    """Links between members (node, component, side, shingles) of different components; both sides if there are two blocks."""
    nodes = np.array([m[0] for m in members])
    part = np.array([m[1] for m in members])
    second = np.array([m[2] for m in members])
    sets = [np.frombuffer(m[3], np.uint64) for m in members]
    sizes = np.array([len(s) for s in sets], float)
    crossed = second.any()
    for i in range(len(members)):
        if crossed and second[i]:
            continue
        later = np.arange(len(members)) > i if not crossed else second
        near = later & (part != part[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
        for j in np.flatnonzero(near):
            if probminhash.jaccard(sets[i], sets[j]) >= similarity:
                yield (int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j])))


def dealt_blocks(members: DataFrame) -> DataFrame:
    """(key, node, part, i, j, side): each member in every tile (i, j) of two blocks of its bucket that it is compared in.

    Only buckets of several components are dealt. The bucket's largest component has blocks of its own, the other members
    further ones, `BLOCK_ROWS` members and `BLOCK_BYTES` of shingles each at most (about: members are hashed to blocks).
    Two blocks of the largest component hold nothing unknown and have no tile, so a bucket of one large component and few
    others costs about its members. `side`: whether the member's block is the tile's second.
    """
    per = members.groupBy("key", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"))
    both = per.groupBy("key").agg(F.max(F.struct("rows", "part", "shingles")).alias("major"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"), F.count("*").alias("parts"))
    blocks = lambda rows, n: F.greatest(F.ceil(rows / BLOCK_ROWS), F.ceil(n * 8 / BLOCK_BYTES)).cast("int")
    sizes = both.where("parts > 1").select(
        "key", F.col("major.part").alias("major"), blocks(F.col("major.rows"), F.col("major.shingles")).alias("majors"),
        blocks(F.col("rows") - F.col("major.rows"), F.col("shingles") - F.col("major.shingles")).alias("others"),
    )
    is_major = F.col("part") == F.col("major")
    own = F.when(is_major, F.pmod(F.xxhash64("node"), F.col("majors"))).otherwise(F.col("majors") + F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    dealt = members.join(sizes, "key").withColumn("own", own)
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.when(is_major, F.col("majors")).otherwise(F.lit(0)), F.col("majors") + F.col("others") - 1)))
    return dealt.select("key", "node", "part", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).alias("side"))


def across(members: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links between nodes of different components in one bucket: `members` has (key, node, part, n)."""
    dealt = common.checkpointed(dealt_blocks(members))
    found = common.marked(docs, dealt.select(F.col("node").alias("doc_id")))

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [np.unique(probminhash.shingles(t)).tobytes() for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["node", "shingles"])

    spark = docs.sparkSession
    rows = dealt.join(common.over_batches(found, sets, "node long, shingles binary"), "node")
    rows = rows.repartition(common.partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")

    def run(batches):
        at, held = None, []
        for batch in batches:
            out = []
            for key, i, j, *member in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "node", "part", "side", "shingles")), strict=True):
                if (key, i, j) != at:
                    out += _within(held, similarity)
                    at, held = (key, i, j), []
                held.append(tuple(member))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
        last = list(_within(held, similarity))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in last], pa.int64()), pa.array([b for _, b in last], pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def classed(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, row, content, class_id) of every row."""
    every = common.checkpointed(signed(docs, bands, rows))
    known = every.where("doc_id is not null and n > 0")
    units = known.groupBy("content").agg(F.min(F.struct("doc_id", "n", "keys")).alias("u"), F.count("*").alias("copies"))
    units = common.checkpointed(units.select("content", F.col("u.doc_id").alias("node"), F.col("u.n").alias("n"), F.col("u.keys").alias("keys"), "copies"))
    spread = units.select(F.explode("keys").alias("key"), "node", "n")
    buckets = spread.groupBy("key").agg(F.count("*").alias("size"), F.min("node").alias("centre")).where("size > 1")
    members = common.checkpointed(spread.join(buckets, "key").select("key", "node", "n", "centre"))
    pairs = common.checkpointed(members.where("centre < node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    links = common.checkpointed(verified(pairs, docs, similarity))
    labels = components(links)
    parted = members.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("part"))
    more = common.checkpointed(across(parted, docs, similarity))
    labels = components(links.union(more))
    of = units.select("content", "node", "copies").join(labels, "node", "left").select("content", F.coalesce("label", "node").alias("class"), "copies")
    of = common.checkpointed(of)
    # Large groups of copies don't meet in a task: contents of so many copies are HOT_SHARE at most, whatever the table.
    rows_named = units.agg(F.sum("copies")).first()[0] or 0
    hot = of.where(F.col("copies") * HOT_SHARE >= rows_named).select("content", F.col("class").alias("hot"))
    found = every.select("doc_id", "row", "n", "content").join(F.broadcast(hot), "content", "left")
    rest = found.where("hot is null and n > 0 and doc_id is not null").join(of.select("content", "class"), "content", "left")
    named = ["doc_id", "row", "n", "content"]
    out = rest.select(*named, "class").union(found.where("hot is not null or n = 0 or doc_id is null").select(*named, F.col("hot").alias("class")))
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("class")), "doc_id"))
    return out.select("doc_id", "row", "content", class_id.alias("class_id"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, class_id) of every row."""
    return classed(docs, similarity, bands, rows).select("doc_id", "class_id")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Each class's first document, with its own columns; rows without doc_id stay.

    If that document's doc_id has several texts of different words, each stays once.
    """
    found = classed(docs, similarity).where("doc_id = class_id")
    keepers = found.groupBy("doc_id", "content").agg(F.min("row").alias("row")).select("doc_id", "row")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("row"), whole.alias("whole"))
    kept = named.join(keepers, ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    return kept.select("whole.*").unionByName(docs.where("doc_id is null"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return classes(common.table(spark, sf_dir, "documents"))
