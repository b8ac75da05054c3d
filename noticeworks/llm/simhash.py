"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits is cut into 32 segments of two bits; the bits set in each (0, 1 or 2) are its coordinates.  The
Manhattan distance of two such points never exceeds the number of differing bits, so it is a lower bound.  Within
distance 3 one half of the 32 coordinates differs by 1 at most: the grid join puts each fingerprint into the cell of either half and into
the cells one step up along each coordinate, which finds every pair with both orders covered once.  The bound over all
coordinates and then the differing bits themselves are checked; components of the links follow.  A cell that holds many fingerprints is split by the bits of its
other half: of five pieces two are equal within three differing bits, of eight pieces five are, so its members meet in subcells of equal pieces and
are never all compared with one another.

Equal fingerprints are one node from the start, so a group of copies never yields pairs.

`similar` is for looser copies, those of a shingle similarity of 0.8 or more.  The grid join ties those whose fingerprints are within its distance; most differ in
ten bits or so and are out of its reach.  For them it also finds neighbourhoods by bands of MinHash over the same shingle hashes, ties each neighbourhood by the least Hamming distances
of the fingerprints, and verifies every tie by the exact similarity of the shingle sets.  A neighbourhood of very many texts is tied in parts
that share some of its texts, so it takes several tasks.  Ties only order the work: in every neighbourhood that they
leave in more than one component, all pairs across components are then compared exactly, in lots of bounded size that meet each other, so no
two texts that share a band are left uncompared.

Cases: a null or empty text has fingerprint 0 and is linked like any other; very long texts are hashed whole, in blocks; repeated rows share their component; an empty
table gives an empty result; extra columns are ignored by the query and kept by the stage of the pipeline.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from noticeworks.llm import common
from noticeworks.llm.components import components

SEED = 42
#: Shingles hashed at once; bounds the memory of a very long text.
BLOCK = 1 << 16
#: Coordinates of one half, and the mask of a two-bit segment.
HALF = 16


def shingles(text: str, width: int):
    """Word shingles of the whole text as bytes, repeats included; fewer words give the whole sequence."""
    words = text.encode().lower().split()
    if not words:
        return iter(())
    if len(words) < width:
        return iter((b" ".join(words),))
    return map(b" ".join, zip(*(words[k:] for k in range(width))))


def shingle_digests(text: str | None, width: int) -> bytes:
    """Hashes of all shingles, eight bytes each, the highest first."""
    return b"".join(map(xxhash.xxh64_digest, shingles(text or "", width), repeat(SEED)))


def fingerprint(text: str | None, width: int = 3) -> int:
    """Bit k is set if it is set in over half of the shingle hashes; a signed 64-bit value."""
    return majority(shingle_digests(text, width))


def majority(digests: bytes) -> int:
    n = len(digests) // 8
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    hashes = np.frombuffer(digests, dtype=np.uint8).reshape(n, 8)
    for at in range(0, n, BLOCK):
        bits = np.unpackbits(hashes[at : at + BLOCK], axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprint_column(text: Column, width: int = 3) -> Column:
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return hashed(text)


def segment_counts(fp: Column) -> Column:
    """The 32 coordinates, two bits each: the popcount of every two-bit segment."""
    low = F.lit(0x5555555555555555)
    high, odd = fp.bitwiseAND(F.shiftrightunsigned(fp, 1)).bitwiseAND(low), fp.bitwiseXOR(F.shiftrightunsigned(fp, 1)).bitwiseAND(low)
    return odd.bitwiseOR(F.shiftleft(high, 1))


def manhattan(x: Column, y: Column) -> Column:
    """Distance of two embedded fingerprints: per coordinate |x-y| is 0, 1 or 2."""
    low = F.lit(0x5555555555555555)
    x1, x2 = x.bitwiseAND(low), F.shiftrightunsigned(x, 1).bitwiseAND(low)
    y1, y2 = y.bitwiseAND(low), F.shiftrightunsigned(y, 1).bitwiseAND(low)
    one, two = x1.bitwiseXOR(y1), x2.bitwiseXOR(y2)
    # 00/01/10 against each other: they differ in the low bit by one, in the high bit alone by two, in both (01 and 10) by one.
    return F.bit_count(one) + 2 * F.bit_count(two.bitwiseAND(F.bitwise_not(one)))


def _cells(points: DataFrame) -> DataFrame:
    """fp, e (its coordinates), cell and own (whether it is the fingerprint's own cell): for either half, its own cell and one step up."""
    steps = F.array(*[F.lit(step).cast("long") for step in (0, *(1 << (2 * k) for k in range(HALF)))])

    def of(half: int) -> Column:
        part = F.shiftrightunsigned("e", 32 * half).bitwiseAND(0xFFFFFFFF)
        # A coordinate of two has no step up.
        legal = F.filter(steps, lambda s: (s == 0) | (part.bitwiseAND(F.shiftleft(s, 1)) == 0))
        return F.transform(legal, lambda s: F.struct((part + s).bitwiseOR(F.lit(half << 32)).alias("cell"), (s == 0).alias("own")))

    return points.select("fp", "e", F.inline(F.concat(of(0), of(1))))


#: Cells of more fingerprints than the first number are split by the second of pieces of their other half.
SPLITS = ((64, 5), (8192, 8))


def _subcells(fp: Column, cell: Column, pieces: Column) -> Column:
    """Subcells of a fingerprint in a cell: one for each choice of pieces of the other half of which, within 3 differing bits, some are equal; 0 in a small cell."""
    other = F.when(cell < F.lit(1 << 32), F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(0xFFFFFFFF))

    def keys(n: int) -> Column:
        cuts = [32 * k // n for k in range(n + 1)]
        masks = [sum((1 << cuts[k + 1]) - (1 << cuts[k]) for k in chosen) for chosen in combinations(range(n), n - 3)]
        return F.array(*[F.xxhash64(F.lit(f"{n}.{i}"), other.bitwiseAND(F.lit(mask))) for i, mask in enumerate(masks)])

    whole = F.array(F.lit(0).cast("long"))
    for _, n in SPLITS:
        whole = F.when(pieces == n, keys(n)).otherwise(whole)
    return whole


def links(fingerprints: DataFrame, most: int = 3) -> DataFrame:
    """Pairs u, v of distinct fingerprints (column fp) that differ in at most 3 bits."""
    if most != 3:
        raise ValueError("the grid is laid out for distances up to 3")
    points = fingerprints.withColumn("e", segment_counts(F.col("fp")))
    cells = _cells(points)
    pieces = F.lit(None).cast("int")
    for n, k in SPLITS:
        pieces = F.when(F.col("n") > n, F.lit(k)).otherwise(pieces)
    crowded = cells.where("own").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > SPLITS[0][0]).select("cell", pieces.alias("pieces"))
    crowded = common.written(crowded, "crowded-cells")
    cells = cells.join(common.maybe_broadcast(crowded, crowded.count()), "cell", "left")
    cells = cells.select("cell", "fp", "e", "own", F.explode(_subcells(F.col("fp"), F.col("cell"), F.coalesce("pieces", F.lit(0)))).alias("subcell"))
    own = cells.where("own").select("cell", "subcell", F.col("fp").alias("v"), F.col("e").alias("ve"))
    met = cells.select("cell", "subcell", F.col("fp").alias("u"), F.col("e").alias("ue"), "own").join(own, ["cell", "subcell"])
    met = met.where((F.col("u") != F.col("v")) & (~F.col("own") | (F.col("u") < F.col("v"))))
    met = met.where(manhattan(F.col("ue"), F.col("ve")) <= most)
    return met.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most).select("u", "v")


def near_duplicates(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every document."""
    common.small_batches(docs.sparkSession)
    hashed = common.written(docs.select(F.col("doc_id").cast("long"), fingerprint_column(F.col("text"), width).alias("fp")), "fingerprints")
    least = common.written(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    found = components(links(least.select("fp")))
    return spread(hashed.withColumnRenamed("fp", "node"), least.withColumnRenamed("fp", "node"), found).withColumnRenamed("node", "fp")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


#: Bands of `similar`: 16 of 4 minima, so that a pair at 0.8 is missed with a probability of 0.0002 and one at 0.85 of 0.000005.
BANDS, ROWS = 16, 4
#: 64 hash functions of any number of shingles: a * h + b with a odd.
MULTIPLIERS, SHIFTS = (np.array([xxhash.xxh64_intdigest(f"{part}{k}", SEED) for k in range(BANDS * ROWS)], dtype=np.uint64) for part in "ab")
MULTIPLIERS |= np.uint64(1)
#: Hashes put through all functions at once; bounds the memory of a very long text.
SKETCHED = 1 << 12
#: Members of a neighbourhood that are compared with one another at once, and how many of them the next lot sees again.
LOT, OVERLAP = 1024, 128
#: Neighbourhoods of which all ties are looked at, and the nearest that each member of a larger one is tied to.
FEW_MEMBERS, NEAREST = 16, 4
#: Ties of each text that are verified first.
TIES = 8
#: Bytes of shingle sets in a lot of texts that are compared across components.
LOT_OCTETS = 16_000_000
SKETCH = "fp long, bands array<long>"
TIE = "u long, v long, bits int"


def band_keys(digests: bytes) -> list[int]:
    """Keys of the bands: each combines four minima of the distinct hashes, by the same functions for texts of any length."""
    hashes = np.frombuffer(digests, dtype=">u8").astype(np.uint64)
    minima = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), SKETCHED):
        np.minimum(minima, (hashes[at : at + SKETCHED, None] * MULTIPLIERS + SHIFTS).min(axis=0), out=minima)
    minima = minima.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = (key ^ minima[:, k]) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(32)
    return key.view(np.int64).tolist()


def nearest_ties(ids: np.ndarray, fps: np.ndarray) -> list[tuple[int, int, int]]:
    """Ties within one lot: all of a few members, else a tree of least distances and each one's nearest."""
    n = len(ids)
    out: set[tuple[int, int, int]] = set()

    def tie(a: int, b: int, bits: int) -> None:
        if ids[a] != ids[b]:
            out.add((max(int(ids[a]), int(ids[b])), min(int(ids[a]), int(ids[b])), bits))

    if n <= FEW_MEMBERS:
        for a in range(n):
            for b in range(a):
                tie(a, b, int(fps[a] ^ fps[b]).bit_count())
        return list(out)
    best, parent, inside = np.full(n, 255, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    at = 0
    for _ in range(n):
        inside[at] = True
        far = np.bitwise_count(fps ^ fps[at]).astype(np.int64)
        far[at] = 255
        for b in np.argpartition(far, NEAREST)[:NEAREST]:
            tie(at, int(b), int(far[b]))
        closer = ~inside & (far < best)
        best[closer], parent[closer] = far[closer], at
        at = int(np.where(inside, 256, best).argmin())
        if not inside[at]:
            tie(at, int(parent[at]), int(best[at]))
    return list(out)


def _ties_of_bands(batches):
    """Ties of runs of equal keys in rows sorted by key: a long run goes through lots that overlap."""
    rest = pd.DataFrame({"key": [], "node": [], "fp": []}).astype("int64")
    for batch in batches:
        rest = pd.concat([rest, batch], ignore_index=True)
        last = rest["key"].iloc[-1]
        whole, rest = rest[rest["key"] != last], rest[rest["key"] == last]
        yield _ties(whole)
        while len(rest) >= LOT:
            yield _ties(rest.iloc[:LOT])
            rest = rest.iloc[LOT - OVERLAP :]
    yield _ties(rest)


def _ties(rows: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple[int, int, int]] = []
    if len(rows):
        key, node, fp = rows["key"].to_numpy(), rows["node"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
        for a, b in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            for at in range(a, b, LOT - OVERLAP):
                out.extend(nearest_ties(node[at : min(b, at + LOT)], fp[at : min(b, at + LOT)]))
                if at + LOT >= b:
                    break
    return pd.DataFrame(out, columns=["u", "v", "bits"]).astype({"u": "int64", "v": "int64", "bits": "int32"})


def links_across(rows: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links u, v that join components of one pair of lots: each row of the left side against all of the right one.

    Rows have node, component, side, main (whether the component is the neighbourhood's largest), band, bands and set.  Left rows are none of the main
    component.  Of two rows that are both left somewhere, the one with the larger node looks for the other; pairs that share an earlier band were met there.
    """
    out: list[tuple[int, int]] = []
    left, right = rows[rows["side"] == "left"], rows[rows["side"] == "right"]
    if len(left) and len(right):
        parent: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := parent.get(c, c)) != c:
                c = up
            return c

        sets = [np.frombuffer(x, dtype="<u4") for x in right["set"]]
        sizes = np.array([len(x) for x in sets])
        shingle, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(shingle, kind="stable")
        shingle, owner = shingle[order], owner[order]
        node, main, within = right["node"].to_numpy(), right["main"].to_numpy(), right["component"].to_numpy().copy()
        band, bands = int(rows["band"].iloc[0]), np.array(right["bands"].tolist(), dtype=np.int64)
        for a, c, mine, x in zip(left["node"].tolist(), left["component"].tolist(), left["bands"], left["set"], strict=True):
            c, x = root(c), np.frombuffer(x, dtype="<u4")
            open_to = (within != c) & (main | (node < a)) & (np.minimum(sizes, len(x)) >= similarity * np.maximum(sizes, len(x)))
            if band:
                open_to &= ~(bands[:, :band] == np.asarray(mine)[:band]).any(axis=1)
            if not open_to.any():
                continue
            first, last = np.searchsorted(shingle, x), np.searchsorted(shingle, x, side="right")
            n = last - first
            at = np.repeat(last - np.cumsum(n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            union = sizes + len(x) - both
            for b in np.flatnonzero(open_to & np.where(union > 0, both / np.maximum(1, union) >= similarity, True)).tolist():
                if within[b] != c:
                    out.append((a, int(node[b])))
                    parent[int(within[b])] = c
                    within[within == within[b]] = c
    return pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def text_hash(text: Column) -> Column:
    """The hash that names a text; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def similar(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, node (the hash of its text), component and component_id (the smallest doc_id reachable) of every document, linked by shingle similarity."""
    common.small_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))

    @F.pandas_udf(SKETCH)
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            digests = shingle_digests(t, width)
            rows.append((majority(digests), band_keys(digests) if digests else [0]))
        return pd.DataFrame(rows, columns=["fp", "bands"])

    @F.pandas_udf("binary")
    def shingle_set(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(np.frombuffer(shingle_digests(t, width), dtype="<u4")[::2]).tobytes() for t in texts], dtype="object")

    @F.pandas_udf("double")
    def jaccard(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = np.frombuffer(a, dtype="<u4"), np.frombuffer(b, dtype="<u4")
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(both / max(1, len(a) + len(b) - both) if len(a) + len(b) else 1.0)
        return pd.Series(out, dtype="float64")

    rows = docs.select(F.col("doc_id").cast("long"), text_hash(F.col("text")).alias("node"), text.alias("text"))
    sketches = rows.select("doc_id", "node", sketched("text").alias("s"))
    sketches = common.written(sketches.select("doc_id", "node", "s.fp", "s.bands"), "sketches")
    texts = sketches.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    texts = common.written(texts, "texts")
    keys = _parts_of_bands(texts.select(F.explode("bands").alias("key"), "node", "fp"))
    n = common.partitions_of(docs.sparkSession)
    ties = keys.repartition(n, "key").sortWithinPartitions("key", "fp").mapInPandas(_ties_of_bands, TIE)
    ties = common.written(ties.unionByName(_ties_of_grid(texts)).distinct(), "ties")
    # The nearest ties of either end are verified first; of the rest, those whose ends are still apart follow.
    ends = ties.select("u", "v", "bits", F.explode(F.array("u", "v")).alias("end"))
    near = F.row_number().over(W.partitionBy("end").orderBy("bits", "u", "v"))
    ranked = common.written(ends.withColumn("place", near).groupBy("u", "v").agg(F.min("place").alias("place")), "ranked-ties")
    nodes = ranked.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    first = sketches.groupBy("node").agg(F.min("doc_id").alias("first")).join(nodes, "node").withColumnRenamed("node", "first_node")
    chosen = rows.join(first, (F.col("node") == F.col("first_node")) & F.col("doc_id").eqNullSafe(F.col("first")), "left_semi").dropDuplicates(["node"])
    sets = common.written(chosen.select("node", shingle_set("text").alias("set")), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        met = pairs.join(sets.select(F.col("node").alias("u"), F.col("set").alias("us")), "u").join(sets.select(F.col("node").alias("v"), F.col("set").alias("vs")), "v")
        return common.written(met.withColumn("j", jaccard("us", "vs")).where(F.col("j") >= similarity).select("u", "v"), "links")

    found = components(verified(ranked.where(F.col("place") <= TIES).select("u", "v")))
    sides = [found.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in")) for end in ("u", "v")]
    rest = ranked.where(F.col("place") > TIES).join(sides[0], "u", "left").join(sides[1], "v", "left")
    more = verified(rest.where(F.coalesce("u_in", "u") != F.coalesce("v_in", "v")).select("u", "v"))
    if more.take(1):
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))
    across = common.written(_links_of_open_bands(texts, sets, found, similarity), "links-across")
    if across.take(1):
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(across))
    return spread(sketches.select("doc_id", "node"), texts.select("node", "least"), found)


def _ties_of_grid(texts: DataFrame) -> DataFrame:
    """Ties u, v, bits of the grid join: between one text of each of two fingerprints within its distance, and from every other text of a fingerprint to that one."""
    points = common.written(texts.groupBy("fp").agg(F.min("node").alias("point")), "grid-points")
    ends = [points.select(F.col("fp").alias(end), F.col("point").alias(f"{end}_point")) for end in ("u", "v")]
    between = links(points.select("fp")).join(ends[0], "u").join(ends[1], "v")
    bits = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))).cast("int")
    between = between.select(F.greatest("u_point", "v_point").alias("u"), F.least("u_point", "v_point").alias("v"), bits.alias("bits"))
    equal = common.join_hot(texts.select("node", "fp"), points, ["fp"]).where(F.col("node") != F.col("point"))
    return between.unionByName(equal.select(F.col("node").alias("u"), F.col("point").alias("v"), F.lit(0).alias("bits")))


def _parts_of_bands(keys: DataFrame) -> DataFrame:
    """key, node, fp with keys of their own for the parts of a band of more than HOT_ROWS texts; some OVERLAP of its texts are in every part and tie the parts to one another."""
    crowded = keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > common.HOT_ROWS)
    crowded = common.written(crowded, "crowded-bands")
    keys = keys.join(common.maybe_broadcast(crowded, crowded.count()), "key", "left")
    parts = F.ceil(F.coalesce("n", F.lit(1)) / common.HOT_ROWS).cast("int")
    everywhere = F.pmod(F.xxhash64("node", "key"), F.col("n")) < OVERLAP
    part = F.when(everywhere, F.sequence(F.lit(1), parts)).otherwise(F.array(F.pmod(F.xxhash64("node"), parts).cast("int") + 1))
    split = keys.select("key", "node", "fp", "n", F.explode(part).alias("part"))
    return split.select(F.when(F.col("n").isNull(), F.col("key")).otherwise(F.xxhash64("key", "part")).alias("key"), "node", "fp")


def _links_of_open_bands(texts: DataFrame, sets: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Links across the components of every neighbourhood of more than FEW_MEMBERS texts that the ties have left in more than one component."""
    known = sets.select("node", F.octet_length("set").alias("octets")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    members = texts.select("node", "bands", F.posexplode("bands").alias("band", "key")).join(known, "node")
    members = common.written(members, "members")
    groups = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("octets").alias("octets"))
    wide = groups.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("parts"), F.sum("octets").alias("octets"), F.max(F.struct("n", "octets", "component")).alias("main"))
    lots = lambda n, octets: F.ceil(F.greatest(n / LOT, octets / LOT_OCTETS)).cast("int")
    others = lots(F.col("n") - F.col("main.n"), F.col("octets") - F.col("main.octets"))
    wide = wide.where((F.col("n") > FEW_MEMBERS) & (F.col("parts") > 1))
    # A lone text without shingles has no octets; it still takes one lot.
    wide = wide.select("key", F.col("main.component").alias("main_component"), F.greatest(lots(F.col("n"), F.col("octets")), F.lit(1)).alias("lots"), F.greatest(others, F.lit(1)).alias("left_lots"))
    wide = common.written(wide, "open-bands")
    rows = members.join(common.maybe_broadcast(wide, wide.count()), "key").withColumn("main", F.col("component") == F.col("main_component"))
    here = lambda n: F.pmod(F.xxhash64("node", "key"), F.col(n)).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "node", "component", "main", "band", "bands"]
    left = rows.where(~F.col("main")).select(*columns, F.lit("left").alias("side"), here("left_lots").alias("i"), to("lots").alias("j"))
    right = rows.select(*columns, F.lit("right").alias("side"), to("left_lots").alias("i"), here("lots").alias("j"))
    met = left.unionByName(right).join(sets, "node")
    return met.groupBy("key", "i", "j").applyInPandas(lambda group: links_across(group, similarity), "u long, v long").distinct()


def spread(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (doc_id, node) with the smallest doc_id of the component of their node; nodes have their own smallest in `least`."""
    grouped = common.written(nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "grouped")
    smallest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = common.join_hot(grouped, smallest, ["component"]).select("node", "component", "component_id")
    return common.join_hot(rows, of_node, ["node"]).select("doc_id", "node", "component", "component_id")
