"""SimHash near-duplicates, candidates by the pigeonring principle.

The 64 bits of a fingerprint form a ring of four segments. If two fingerprints differ in at most three bits in all, then some segment
starts a chain in which every prefix of l segments differs in at most l * 3 / 4 bits: none in the first segment, at most one in the first
two, at most two in three, three in all. So a pair meets under a key of two neighbouring segments (32 bits), either equal in both or
with one bit of the second flipped. One side of a pair has that bit unset; it alone looks the other up, with that bit set, and so each
fingerprint writes 4 index rows and 36 probe rows on average. The longer prefixes of the chain prune before the full Hamming distance.

Equal fingerprints collapse to one row before any of this. A key under which more than HOT fingerprints meet is not joined: its rows are
cut into blocks, and pairs of blocks are compared by whole matrices, of which only a spanning forest comes back. No key is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photarium.llm.common import cut, drop, release, row_ids, small_batches, store, tidied
from photarium.llm.components import connected_components

BITS = 64
SEGMENT = 16
MOST = 3
SHINGLE = 3
SEED = 42
#: Fingerprints under one key above which blocks are compared instead of joined, and rows in a block.
HOT = 2048
BLOCK = 2048


#: Shingles hashed at once: long texts go in pieces, as objects and bits take many times the room of the text.
PIECE = 255 << 6


def shingle_digests(text: str | None, shingle: int) -> Iterator[bytes]:
    """XXH64 of a text's word shingles, eight bytes each, PIECE of them at a time; of all words together where they are fewer; else none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if 0 < len(words) < shingle:
        yield xxhash.xxh64_digest(b" ".join(words), SEED)
    for at in range(0, len(words) - shingle + 1, PIECE):
        part = words[at : at + PIECE + shingle - 1]
        yield b"".join([xxhash.xxh64_digest(x, SEED) for x in map(b" ".join, zip(*(part[k:] for k in range(shingle))))])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text: majority bits of the XXH64 of its word shingles; zero without words."""
    counts, total = np.zeros(BITS, np.int64), 0
    for digests in shingle_digests(text, shingle):
        hashes = np.frombuffer(digests, np.uint8).reshape(-1, 8)
        counts += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > total).tobytes(), "big")


def fingerprint_of(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return tidied(pd.Series(np.fromiter((fingerprint(x, shingle) for x in texts), np.uint64, len(texts)).view(np.int64)) for texts in batches)

    return of(text)


def _segment(k: int):
    return F.shiftrightunsigned("fp", BITS - SEGMENT * (k % 4 + 1)).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _key(start: int, first, second):
    return F.lit(start << 32).cast("long").bitwiseOR(F.shiftleft(first, SEGMENT)).bitwiseOR(second)


def index_keys(fps: DataFrame) -> DataFrame:
    keys = F.array(*[_key(k, _segment(k), _segment(k + 1)) for k in range(4)])
    return fps.select("fp", F.explode(keys).alias("key"))


def probe_keys(fps: DataFrame) -> DataFrame:
    """Keys with one unset bit of the second segment set."""
    flips = []
    for k in range(4):
        for bit in range(SEGMENT):
            unset = _segment(k + 1).bitwiseAND(F.lit(1 << bit).cast("long")) == 0
            flips.append(F.when(unset, _key(k, _segment(k), _segment(k + 1).bitwiseOR(F.lit(1 << bit).cast("long")))))
    return fps.select("fp", F.explode(F.filter(F.array(*flips), lambda x: x.isNotNull())).alias("key"))


def _chain_fits(a, b, key):
    """The chain from the key's segment on: three segments within two bits, all four within three."""
    diff = F.expr(f"{a} ^ {b}")
    start = F.shiftright(key, 32)
    fourth = F.element_at(F.array(*[F.lit(np.uint64(0xFFFF << (BITS - SEGMENT * ((k + 3) % 4 + 1))).astype(np.int64).item()).cast("long") for k in range(4)]), (start + 1).cast("int"))
    return (F.bit_count(diff.bitwiseAND(F.bitwise_not(fourth))) <= 2) & (F.bit_count(diff) <= MOST)


def link(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, fps(fp), whose components are those of all links of at most MOST bits."""
    index, probes = index_keys(fps), probe_keys(fps)
    hot = cut(index.groupBy("key").count().where(F.col("count") > HOT).select("key", F.col("count").alias("n")))
    usual = index
    some_hot = hot.limit(1).count() > 0
    if some_hot:
        usual = index.join(hot, "key", "left_anti")
    other = usual.select(F.col("fp").alias("other"), "key")
    looked_up = usual.withColumn("exact", F.lit(True)).unionByName(probes.withColumn("exact", F.lit(False)))
    found = looked_up.join(other, "key").where((~F.col("exact") | (F.col("fp") < F.col("other"))) & _chain_fits("fp", "other", F.col("key")))
    edges = found.select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()
    if some_hot:
        members = index.unionByName(probes).join(hot, "key").distinct()
        edges = edges.union(_tiles(members))
    return edges


def _tiles(members: DataFrame) -> DataFrame:
    """members(key, fp, n): compare all fingerprints under a hot key, block against block."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    placed = members.select("key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    tiled = placed.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")

    def forest(tile: pd.DataFrame) -> pd.DataFrame:
        fps = tile["fp"].to_numpy().view(np.uint64)
        label = np.arange(len(fps))
        while True:
            new = label.copy()
            for at in range(0, len(fps), 512):
                near = np.bitwise_count(fps[at : at + 512, None] ^ fps[None, :]) <= MOST
                new[at : at + 512] = np.where(near, label[None, :], len(fps)).min(axis=1)
            new = new[new]
            if (new == label).all():
                break
            label = new
        out = pd.DataFrame({"a": fps.view(np.int64), "b": fps[label].view(np.int64)})
        return out[out["a"] != out["b"]]

    return tiled.groupBy("key", "i", "j").applyInPandas(forest, "a long, b long")


# near copies at a given similarity

#: Words of 64 bits in a wide fingerprint, which are the segments of its ring; bits of a band, bands in a word.
WIDE = 24
BAND = 20
BANDS = 3
#: Segments of a chain behind a band that must keep to their budgets before all bits are compared.
CHAIN = 2
#: Members of a band up to which all are compared by their chains.
HOT_WIDE = 1024

_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).copy().view(np.uint64).ravel()


def wide_fingerprint(text: str | None, shingle: int) -> np.ndarray:
    """WIDE words: majority bits of as many independent mixes of the shingles' XXH64; zero without words."""
    counts, total = np.zeros(WIDE * BITS, np.int64), 0
    turn = (np.arange(WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for digests in shingle_digests(text, shingle):
        hashes = np.frombuffer(digests, ">u8").astype(np.uint64)
        total += len(hashes)
        for at in range(0, len(hashes), 255):  # eight counters of a byte each in a word
            x = hashes[at : at + 255, None] * turn
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
            counts += _LANES[x.view(np.uint8)].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return np.packbits(2 * counts > total).view(np.uint64)


def _share(similarity: float) -> float:
    """Share of bits that differ between fingerprints of shingle sets of that Jaccard similarity, on average."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def budget(similarity: float, segments: int, deviations: float) -> int:
    """Bits in which so many segments may differ: their share of the whole, and standard deviations above it."""
    bits, p = segments * BITS, _share(similarity)
    return int(bits * p + deviations * np.sqrt(bits * p * (1 - p)))


def most_bits(similarity: float) -> int:
    """Differing bits of two wide fingerprints of that similarity, and two standard deviations."""
    return budget(similarity, WIDE, 2)


def chain_budgets(similarity: float) -> list[int]:
    """Differing bits of the first, the first two, ... segments of a chain, and four standard deviations each."""
    return [budget(similarity, k + 1, 4) for k in range(CHAIN)]


def _wide(words) -> np.ndarray:
    return np.array(list(words), np.int64).reshape(len(words), WIDE).view(np.uint64)


def _banded(wide: DataFrame) -> DataFrame:
    """(fp, key, c0, c1, ...): each band of each word, with the words behind it on the ring."""
    each = wide.select("fp", "words", F.explode(F.sequence(F.lit(0), F.lit(WIDE * BANDS - 1))).alias("k"))
    word = lambda step: F.get("words", ((F.col("k") / BANDS).cast("int") + step) % WIDE)
    bits = F.expr(f"shiftrightunsigned(words[int(k / {BANDS})], (k % {BANDS}) * {BAND})").bitwiseAND(F.lit((1 << BAND) - 1).cast("long"))
    return each.select("fp", F.shiftleft(F.col("k").cast("long"), BAND).bitwiseOR(bits).alias("key"), *[word(j + 1).alias(f"c{j}") for j in range(CHAIN)])


def _live(batches: Iterator[pa.RecordBatch], budgets: list[int], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp, c0, c1, ...) in order of key to (key, fp, least) of those with a partner under their key to which the chain leads:
    the cumulative differences stay within every budget. least: the smallest of the partners and the row itself."""

    def rows(own: dict[str, np.ndarray]) -> pa.RecordBatch:
        key, fp = own["key"], own["fp"]
        least, alive, at, step = fp.copy(), np.zeros(len(fp), bool), np.arange(len(fp)), 1
        while True:
            at = at[at + step < len(fp)]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            i, total = at, 0
            for c, most in zip(names, budgets):
                total = total + np.bitwise_count(own[c][i] ^ own[c][i + step]).astype(np.int64)
                keep = total <= most
                i, total = i[keep], total[keep]
            alive[i] = alive[i + step] = True
            np.minimum.at(least, i, fp[i + step])
            np.minimum.at(least, i + step, fp[i])
            step += 1
        return pa.RecordBatch.from_arrays([pa.array(x[alive]) for x in (key, fp, least)], names=["key", "fp", "least"])

    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "fp", *names)}
        held = new if held is None else {c: np.concatenate([held[c], x]) for c, x in new.items()}
        if len(held["key"]):
            whole = int(np.searchsorted(held["key"], held["key"][-1]))  # the last key may go on in the next batch
            yield rows({c: x[:whole] for c, x in held.items()})
            held = {c: x[whole:] for c, x in held.items()}
    if held is not None:
        yield rows(held)


def _within(pairs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose fingerprints, known(fp, words), differ in at most that many bits."""
    sides = [known.select(F.col("fp").alias(name), F.col("words").alias(f"_{name}")) for name in ("a", "b")]
    both = pairs.distinct().join(sides[0], "a").join(sides[1], "b")
    apart = F.aggregate(F.zip_with("_a", "_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    return both.where(apart <= most).select("a", "b")


def _sparse(edges: DataFrame) -> DataFrame:
    """Edges (a, b), of which a comes from few, with the same components: b is linked to its smallest a, and that to b's other ones."""
    stars = edges.groupBy("b").agg(F.min("a").alias("m"), F.collect_set("a").alias("others"))
    own = stars.select(F.col("m").alias("a"), "b")
    return own.union(stars.select("m", F.explode("others").alias("b")).where("m != b").distinct())


def _compared(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (clump, fp, words) in order of clump to edges (a, b): each member with the smallest one that links within the clump lead to."""

    def edges(clump: np.ndarray, fp: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        at, step, pairs = np.arange(len(fp)), 1, []
        while True:
            at = at[at + step < len(fp)]
            at = at[clump[at] == clump[at + step]]
            if not len(at):
                break
            near = at[np.bitwise_count(x[at] ^ x[at + step]).sum(axis=1, dtype=np.int64) <= most]
            pairs.append((near, near + step))
            step += 1
        i, j = (np.concatenate([np.zeros(0, np.int64), *v]) for v in zip(*pairs)) if pairs else (at, at)
        order = np.argsort(fp, kind="stable")
        place = np.empty(len(fp), np.int64)
        place[order] = np.arange(len(fp))  # labels are places in the order of fp, so the smallest label is the smallest fp
        i, j, label = place[i], place[j], np.arange(len(fp))
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = new[new]
            if (new == label).all():
                break
            label = new
        fp = fp[order]
        moved = label != np.arange(len(fp))
        return pa.RecordBatch.from_arrays([pa.array(fp[label[moved]]), pa.array(fp[moved])], names=["a", "b"])

    clump, fp, x = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, WIDE), np.uint64)
    for batch in batches:
        if not len(batch):
            continue
        words = batch.column("words").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WIDE)
        clump, fp = (np.concatenate([held, batch.column(c).to_numpy(zero_copy_only=False)]) for c, held in (("clump", clump), ("fp", fp)))
        x = np.concatenate([x, words])
        whole = int(np.searchsorted(clump, clump[-1]))  # the last clump may go on in the next batch
        if whole >= BLOCK:
            yield edges(clump[:whole], fp[:whole], x[:whole])
            clump, fp, x = clump[whole:], fp[whole:], x[whole:]
    if len(fp):
        yield edges(clump, fp, x)


def wide_links(wide: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of wide(fp, words), whose components are those of all pairs that share a band, keep to the chain's budgets behind it
    and are within the bits of that similarity, and of all other pairs within these bits that meet on the way.

    At a similarity of 0.8 a seventh of all bits differ, so no segment of a useful width is sure to be equal, as pigeonring would have it.
    Bands stand in for the chain's first segment: a pair shares one of the 72 with a probability of 0.94 at 0.8, 0.99 at 0.85. From the
    band on, the cumulative differences of the following segments must stay within their budgets; that leaves hardly any of the
    strangers that a band also holds, more of them in a larger corpus.

    What chains connect is a clump. All members of a clump are compared by all bits: together in clumps of up to BLOCK members; in larger
    ones each member first meets the smallest one that its chains lead to, which connects copies, and then those that are not connected
    meet block against block. Bands of more than HOT_WIDE members are not run through, but count as connected.
    """
    most, known = most_bits(similarity), wide.select("fp", "words")
    banded, names, budgets = _banded(wide), [f"c{j}" for j in range(CHAIN)], chain_budgets(similarity)
    hot = cut(banded.groupBy("key").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where(F.col("n") > HOT_WIDE).select("key", "least"))
    some_hot = hot.limit(1).count() > 0
    usual = banded.join(hot, "key", "left_anti") if some_hot else banded
    ordered = usual.repartition("key").sortWithinPartitions("key").select("key", "fp", *names)
    found = ordered.mapInArrow(lambda it: tidied(_live(it, budgets, names)), "key long, fp long, least long").select("least", "fp")
    if some_hot:
        found = found.union(banded.select("key", "fp").join(hot, "key").select("least", "fp"))
    chained = store(found.where("least < fp").select(F.col("least").alias("a"), F.col("fp").alias("b")).distinct(), "simhash-chains")
    release(wide.sparkSession)
    clumps = cut(connected_components(_sparse(chained)))
    sizes = clumps.groupBy("root").agg(F.count("*").alias("size"))
    placed = cut(clumps.join(sizes, "root").select(F.col("root").alias("clump"), F.col("node").alias("fp"), "size"))
    small = placed.where(F.col("size") <= BLOCK).join(known, "fp").select("clump", "fp", "words").repartition("clump").sortWithinPartitions("clump", "fp")
    edges = small.mapInArrow(lambda it: tidied(_compared(it, most)), "a long, b long")
    large = placed.where(F.col("size") > BLOCK)
    if large.limit(1).count():
        pairs = chained.join(large.select(F.col("fp").alias("a"), "clump"), "a").select("a", "b")
        roots = cut(connected_components(_sparse(_within(pairs, known, most))).withColumnRenamed("node", "fp"))
        rooted = large.join(roots, "fp", "left").select(F.col("clump").alias("key"), "fp", F.coalesce("root", "fp").alias("root"))
        edges = edges.union(roots.select(F.col("root").alias("a"), F.col("fp").alias("b")).where("a != b")).union(_wide_tiles(cut(rooted), known, most))
    edges = cut(edges)
    drop(chained)
    return edges


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of each of x and each of y."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for k in range(WIDE):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def _wide_tiles(members: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """members(key, fp, root), known(fp, words): edges between members of a key with different roots.

    Members with a key's most common root, its body, need not meet each other: their blocks meet those of the rest, and the rest meets itself.
    """
    parts = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("body"), F.sum("n").alias("n")).where("n > body.n")
    sizes = sizes.select("key", F.col("body.root").alias("body"), *[F.ceil(x / BLOCK).cast("int").alias(name) for name, x in (("bodies", F.col("body.n")), ("rests", F.col("n") - F.col("body.n")))])
    sized = members.join(sizes, "key")
    in_body = F.col("root") == F.col("body")
    own = F.pmod(F.xxhash64("fp"), F.when(in_body, F.col("bodies")).otherwise(F.col("rests"))).cast("int")
    placed = sized.select("key", "fp", "root", in_body.alias("in_body"), own.alias("own"), "bodies", "rests")
    # blocks of a key's body have negative numbers
    body = placed.where("in_body").select("key", "fp", "root", (-1 - F.col("own")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("rests") - 1)).alias("j"))
    others = F.sequence(-F.col("bodies"), F.col("rests") - 1)
    rest = placed.where("not in_body").select("key", "fp", "root", "own", F.explode(others).alias("other"))
    rest = rest.select("key", "fp", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def forest(tile: pd.DataFrame) -> pd.DataFrame:
        fps, roots, x = tile["fp"].to_numpy(), tile["root"].to_numpy(), _wide(tile["words"])
        near = []
        for at in range(0, len(x), 256):
            i, j = np.nonzero((_apart(x[at : at + 256], x) <= most) & (roots[at : at + 256, None] != roots[None, :]))
            # of a row's links one to each root is enough
            found = pd.DataFrame({"i": i + at, "j": j, "root": roots[j]}).drop_duplicates(["i", "root"])
            near.append(pd.DataFrame({"a": fps[found["i"]], "b": fps[found["j"]], "r": roots[found["i"]], "q": found["root"].to_numpy()}))
        every = pd.concat(near)
        return every[every["a"] < every["b"]].drop_duplicates(["r", "q"])[["a", "b"]] if len(every) else pd.DataFrame({"a": fps[:0], "b": fps[:0]})

    tiled = body.union(rest).join(known, "fp")
    return tiled.groupBy("key", "i", "j").applyInPandas(forest, "a long, b long").distinct()


def _rooted_wide(docs: DataFrame, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return tidied(pd.Series([wide_fingerprint(x, shingle).view(np.int64) for x in texts], dtype=object) for texts in batches)

    made = small_batches(docs).select("doc_id", *row_ids(), of("text").alias("words"))
    rows = store(made.withColumn("fp", F.xxhash64("words")), "simhash-wide")
    wide = store(rows.groupBy("fp").agg(F.first("words").alias("words")), "simhash-wide-distinct")
    roots = cut(connected_components(wide_links(wide, similarity)))
    fps = cut(wide.select("fp").join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root")))
    drop(wide)
    return rows, fps


# operators


def _rooted(docs: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """Stored (doc_id, rid, rid2, fp) of every row, and (fp, root) of every distinct fingerprint: root is the same within a component."""
    rows = store(small_batches(docs).select("doc_id", *row_ids(), fingerprint_of(F.col("text"), shingle).alias("fp")), "simhash")
    fps = cut(rows.select("fp").distinct())
    roots = cut(connected_components(link(fps)))
    return rows, fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def components(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id) for every row: component_id is the smallest doc_id reachable by links of at most MOST bits.

    Null and empty texts have fingerprint zero and link like any other; equal texts have equal fingerprints; rows without doc_id take
    part but name no component (null if no row of theirs has an id); an empty table gives no rows; other columns are not read.
    """
    rows, rooted = _rooted(docs, shingle)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = least.join(rooted, "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, shingle: int = 5, similarity: float | None = 0.8) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays, rows without one last.

    Links are those of wide fingerprints at that Jaccard similarity of the shingles; similarity=None takes the 64-bit links of
    components(). Of rows equal in doc_id and text one stays; texts without words count as copies of each other. All columns of docs are
    kept, whatever their names.
    """
    rows, rooted = _rooted_wide(docs, shingle, similarity) if similarity is not None else _rooted(docs, shingle)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "rid2"))
    by_fp = rows.groupBy("fp").agg(first.alias("first")).join(rooted, "fp")
    keep = store(by_fp.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rid").alias("rid"), F.col("first.rid2").alias("rid2")), "simhash-kept")
    drop(rows)
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_ids()).join(keep, ["rid", "rid2"], "left_semi")
    one = kept.withColumn("_n", F.row_number().over(Window.partitionBy("rid", "rid2").orderBy("rid"))).where("_n = 1")
    return one.select("row.*")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
