"""SimHash near-duplicates through deletion-variant signatures.

With at most k differing bits a 64-bit fingerprint is cut into k // 2 + 1 segments, fewer than the k + 1 that equal
segments would need, because one segment then differs by at most one bit. Each different fingerprint is indexed once
for each segment and bit of it with that bit deleted (64 rows whatever k is), and fingerprints that share such a row
are compared in full. Copies are folded before the index, so it only sees different fingerprints. Where many share a
row, the bits outside the segment are cut into segments in turn and indexed in the same way, within the group.

Few differing bits of 64 mean nearly equal shingle sets only. For a bound on the similarity of the sets (similar,
keep_similar) many short independent SimHashes are indexed by deletion variants, as many as find a pair at the bound
with the wanted probability, and the pairs found are held against the bound with their whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, cut, fresh, no_clash

BITS = 64
#: Variant groups up to this size are joined pair by pair inside Spark; larger ones are indexed again by further bits.
PAIRED = 32
#: Bits left to tell members of a group apart from which on it is compared in blocks: it has few members by then.
FEW_BITS = 8
#: Fingerprints a block holds when such a group is compared.
BLOCK = 512
#: Share of the pairs at the least similarity itself that similar() finds; more of those above it.
RECALL = 0.99
#: Bits of 64 in which a pair found through a short SimHash may differ to be compared in full; at similarity 0.8 about
#: 10 differ, in two unrelated texts 32.
CHECK_BITS = 22
#: Rows of the index of short SimHashes that a task sorts.
SORTED = 1 << 20
#: Parities of a set that are compared before the sets themselves; fewer only let more pairs through.
MOST_MARKS = 1 << 13


def shingle_hashes(text: str, words: int):
    """XXH64 (seed 42) of each shingle of a text, with repeats: an array of unsigned numbers."""
    import numpy as np
    import xxhash

    cut_words = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not cut_words:
        return np.zeros(0, dtype=np.uint64)
    joined, n = b" ".join(cut_words), len(cut_words)
    ends = np.cumsum(np.fromiter(map(len, cut_words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    take, digest = min(words, n), xxhash.xxh64_intdigest
    spans = zip(starts[: n - take + 1].tolist(), ends[take - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], 42) for a, b in spans], dtype=np.uint64)


def simhash_of(text: str, words: int) -> int:
    """The 64-bit fingerprint of one text as an unsigned number."""
    import numpy as np

    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return 0
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded working memory for very long texts
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, words: int = 5, text_col: str = "text", out_col: str = "fp") -> DataFrame:
    """df without text_col and with out_col: the SimHash (long, the unsigned number's bits) of each whole text.

    Words are runs of anything but ASCII white space, A-Z lower-cased; shingles of `words` words with repeats, fewer
    words make one shingle, none (null and blank texts) give 0. A bit is set if it is set in over half of the
    shingles' XXH64 hashes (seed 42). A column out_col in df is an error (ValueError).
    """
    import pyarrow as pa

    no_clash([c for c in df.columns if c != text_col], out_col)
    others = [c for c in df.columns if c != text_col]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            made = [simhash_of(t, words) for block in blocks(x.as_py() for x in column) for t in block]
            values = pa.array(np.array(made, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), values], names=[*others, out_col])

    return df.mapInArrow(work, T.StructType([*(df.schema[c] for c in others), T.StructField(out_col, T.LongType())]))


def _segments(bits: list[int], max_bits: int) -> list[list[int]]:
    """`bits` in max_bits // 2 + 1 runs of about equal length, of which one differs by at most one bit."""
    n = max_bits // 2 + 1
    edges = [len(bits) * i // n for i in range(n + 1)]
    return [bits[low:high] for low, high in zip(edges, edges[1:], strict=False)]


def _variants(fp: Column, group: Column, sides: Column, must: Column, depth: int, bits: list[int], paths: list[list[int]], max_bits: int) -> tuple[Column, list[list[int]]]:
    """(array<struct<group, path, sides, must>>, paths with the new ones): for each of `bits` its segment with that bit deleted.

    group names the segment, the bit and what is left of the segment, within the group so far (by a hash: groups that
    fall together cost comparisons only). path numbers the entry of paths that has the bits outside the segments so far.
    Two fingerprints with an equal segment meet when its first bit is deleted; so where another bit is deleted only
    those matter that differ in it: the bit at `depth` of sides is the deleted bit, that of must says that it matters.
    """
    out, paths = [], list(paths)
    for segment in _segments(bits, max_bits):
        mask = sum(1 << b for b in segment)
        for bit in segment:
            held = mask & ~(1 << bit)
            rest = fp.bitwiseAND(F.lit(held - (1 << BITS) if held >> (BITS - 1) else held))
            side = F.shiftrightunsigned(fp, bit).bitwiseAND(F.lit(1)).cast("int")
            out.append(F.struct(
                F.xxhash64(group, F.lit(bit), F.lit(len(segment)), rest).alias("group"), F.lit(len(paths)).alias("path"),
                sides.bitwiseOR(F.shiftleft(side, depth)).alias("sides"), must.bitwiseOR(F.lit(0 if bit == segment[0] else 1 << depth)).alias("must"),
            ))
        paths.append([b for b in bits if b not in segment])
    return F.array(*out), paths


def _differ(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _shared(index: DataFrame) -> DataFrame:
    """The rows of index, and n, whose group has n > 1 members that differ in all the bits that matter; written.

    index (fp, group, path, sides, must) is exchanged once.
    """
    parts, mine = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), Window.partitionBy("group")
    counted = index.repartition(parts, "group").select("*", F.count("*").over(mine).alias("n"), F.bit_or("sides").over(mine).alias("any"), F.bit_and("sides").over(mine).alias("all"))
    return cut(counted.where("n > 1 and ((any ^ all) & must) = must").drop("any", "all"))


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """(src, dst) pairs of different values of fps.fp, src < dst, that join up everything within max_bits.

    Groups of two to PAIRED fingerprints give each link of theirs. A larger group is indexed again by the bits outside
    its segment, which leaves half of the bits (for max_bits 2 and 3) each time, until the groups are small or only
    FEW_BITS are left; then, with at most some thousand members, it is compared block by block and gives a spanning
    forest of its links, so that nothing that is reachable through links is lost.
    """
    # A written table of fingerprints is small and read by few tasks; each row gives 64, so it is dealt out first.
    fps = fps.select("fp").repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    zero = F.lit(0)
    first, paths = _variants(F.col("fp"), zero.cast("long"), zero, zero, 0, list(range(BITS)), [], max_bits)
    held = _shared(fps.select("fp", F.explode(first).alias("v")).select("fp", "v.*"))
    found, done, depth = None, 0, 0
    while True:
        some = held.where(f"n <= {PAIRED}")
        a, b = some.select("group", "must", F.col("fp").alias("src"), F.col("sides").alias("one")), some.select("group", F.col("fp").alias("dst"), F.col("sides").alias("other"))
        pairs = a.join(b, "group").where("src < dst and ((one ^ other) & must) = must").where(_differ(F.col("src"), F.col("dst")) <= max_bits).select("src", "dst")
        found = pairs if found is None else found.unionByName(pairs)
        large = held.where(f"n > {PAIRED}")
        again, last = [], []
        for path in range(done, len(paths)):
            (again if len(paths[path]) > FEW_BITS else last).append(path)
        done = len(paths)
        if last:
            found = found.unionByName(_blocks(large.where(F.col("path").isin(last)), max_bits))
        large = large.where(F.col("path").isin(again)) if again else large.where("false")
        if not again or large.isEmpty():
            return cut(found.distinct())
        variants, depth = F.lit(None), depth + 1
        for path in again:
            made, paths = _variants(F.col("fp"), F.col("group"), F.col("sides"), F.col("must"), depth, paths[path], paths, max_bits)
            variants = F.when(F.col("path") == path, made).otherwise(variants)
        held = _shared(large.select("fp", F.explode(variants).alias("v")).select("fp", "v.*"))


def _blocks(large: DataFrame, max_bits: int) -> DataFrame:
    """(src, dst) of groups (group, fp, n), compared block by block: every pair of blocks in a task of its own."""
    # A member goes to every pair of blocks that holds its own block; blocks are by hash, about BLOCK members each.
    count = F.ceil(F.col("n") / BLOCK).cast("long")
    dealt = large.withColumn("count", count).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("count"))).select(
        "group", "fp", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("other")
    ).select("group", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    return dealt.groupBy("group", "i", "j").applyInPandas(_forest(max_bits), "src long, dst long")


def _forest(max_bits: int):
    """Spanning forest of the links between two blocks (or within one)."""

    def work(frame):
        import numpy as np
        import pandas as pd

        fps = frame["fp"].to_numpy().view(np.uint64)
        parent = np.arange(len(fps))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out = []
        for a in range(len(fps) - 1):
            far = np.bitwise_count(fps[a + 1 :] ^ fps[a])
            for b in np.nonzero(far <= max_bits)[0] + a + 1:
                x, y = root(a), root(int(b))
                if x != y:
                    parent[y] = x
                    out.append((a, b))
        values = fps.view(np.int64)
        return pd.DataFrame([(min(values[a], values[b]), max(values[a], values[b])) for a, b in out], columns=["src", "dst"], dtype="int64")

    return work


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (src, dst) is joined up with.

    Alternates large-star and small-star steps (each joins the neighbours of a node to their smallest), which takes
    about log n rounds; each round is a written table. Nothing but a count comes to the driver.
    """
    now = cut(edges.select("src", "dst").where("src <> dst").distinct())
    last = None
    for _ in range(rounds):
        both = now.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionByName(now.select(F.col("dst").alias("u"), F.col("src").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.where("v > u").join(least, "u").select(F.col("m").alias("src"), F.col("v").alias("dst")).where("src <> dst").distinct())
        down = large.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.where("v <> m").select(F.col("m").alias("src"), F.col("v").alias("dst")).unionByName(joined.select(F.col("m").alias("src"), F.col("u").alias("dst")))
        now = cut(small.distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == last:
            break
        last = state
    else:
        raise RuntimeError(f"the components are not final after {rounds} rounds")
    nodes = now.select(F.col("dst").alias("node"), F.col("src").alias("root"))
    return nodes.unionByName(now.select(F.col("src").alias("node"), F.col("src").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def near_duplicates(df: DataFrame, words: int = 5, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp long, fingerprint string, component_id) of each row: documents whose SimHashes are linked.

    component_id is the smallest id_col reachable through links of at most max_bits differing bits, itself included;
    a document without partners is its own. Blank and null texts have fingerprint 0 and are linked like any other.
    A null id is never the smallest unless a component has no other; repeated rows stay, each with its component.
    Further columns of df, whatever their names, do not matter; id_col by the name of an output is an error (ValueError).
    """
    no_clash([id_col], "fp", "fingerprint", "component_id")
    docs = cut(fingerprints(df.select(id_col, text_col), words, text_col))
    first = cut(docs.groupBy("fp").agg(F.min(id_col).alias("low")))
    found = components(links(first.select("fp"), max_bits))
    least = found.join(first, found["node"] == first["fp"]).groupBy("root").agg(F.min("low").alias("low"))
    whole = cut(found.join(least, "root").select(F.col("node").alias("fp"), "low"))
    own = cut(first.join(whole.select("fp", F.col("low").alias("joined")), "fp", "left").select("fp", F.coalesce("joined", "low").alias("component_id")))
    return docs.join(own, "fp").select(id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _plan(n: int, least: float) -> tuple[int, int]:
    """(tables, bits): how many short SimHashes of how many bits find pairs of similarity `least` among n texts.

    A bit differs with the probability of the angle between the sets over pi. bits (even) grows with log n, so that a
    text meets one or two unrelated texts in a table; tables is the least number that gives RECALL with one bit off.
    """
    import math

    bits = 2 * math.ceil((math.log2(max(n, 2)) + 4) / 2)
    differs = math.acos(2 * least / (1 + least)) / math.pi
    found = (1 - differs) ** bits + bits * differs * (1 - differs) ** (bits - 1)
    return (1 if found >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - found))), bits


def _short_simhashes(hashes, tables: int, bits: int):
    """(a 64-bit SimHash, `tables` more of `bits` bits) of a set of shingle hashes, as signed numbers."""
    import numpy as np

    wide = 1 + -(-tables * bits // BITS)
    salts = (np.arange(wide, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(wide * BITS, dtype=np.int64)
    for at in range(0, len(hashes), 255):  # bounded working memory, and sums that fit a byte
        x = hashes[at : at + 255, None] + salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        total += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    ones = 2 * total > len(hashes)
    check = np.packbits(ones[:BITS]).view(np.int64)[0]
    return check, ones[BITS : BITS + tables * bits].reshape(tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _sets(df: DataFrame, id_col: str, text_col: str, words: int, out: str, values):
    """(id_col, whole long, *out) of each row: `whole` is the digest of the set of shingles, values(set) the rest."""
    import pyarrow as pa

    schema = T.StructType([df.schema[id_col], T.StructField("whole", T.LongType()), *T.StructType.fromDDL(out)])
    arrow = {T.LongType(): pa.int64(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}
    kinds = [arrow[f.dataType] for f in schema.fields[1:]]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            at = 0
            for block in blocks(x.as_py() for x in batch.column(1)):
                made = []
                for text in block:
                    own = np.unique(shingle_hashes(text, words))
                    whole = np.array([xxhash.xxh64_intdigest(own.tobytes(), 7)], dtype=np.uint64).view(np.int64)[0]
                    made.append((whole, *values(own)))
                columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(block)), *columns], names=schema.names)
                at += len(block)

    return df.select(id_col, text_col).mapInArrow(work, schema)


def _keys(bits: int, key):
    """`key` with each bit of its other half deleted in turn, as (bit, keys).

    A key is made of table, half, the bits of that half and the bits of the other half. Equal halves lie in one
    partition; the other half may differ by one bit, so the keys are sorted once for each of its bits, deleted.
    """
    for bit in range(bits // 2):
        yield bit, key & ~(1 << bit)


def _near(check, a, b):
    import numpy as np

    return np.bitwise_count((check[a] ^ check[b]).view(np.uint64)) <= CHECK_BITS


class _Met:
    """The pairs of documents that meet in one task, each once, however often their rows meet."""

    def __init__(self, whole):
        import numpy as np

        self.names, self.at, self.doc = np.unique(whole, return_index=True, return_inverse=True)
        self.codes = np.zeros(0, dtype=np.int64)

    def add(self, found) -> None:
        """found: (rows, rows) that meet."""
        import numpy as np

        if found and sum(len(a) for a, _ in found):
            a, b = (self.doc[np.concatenate(c)] for c in zip(*found, strict=True))
            self.codes = np.union1d(self.codes, np.minimum(a, b) * len(self.names) + np.maximum(a, b))

    def batch(self, kept=None):
        """(src, dst) of the pairs; kept(a, b): which of those of the rows a and b."""
        import numpy as np
        import pyarrow as pa

        a, b = np.divmod(self.codes, len(self.names))
        if kept is not None and len(a):
            these = kept(self.at[a], self.at[b])
            a, b = a[these], b[these]
        return pa.RecordBatch.from_arrays([pa.array(self.names[a]), pa.array(self.names[b])], names=["src", "dst"])


def _closest(check, a, b):
    """Which of the pairs of rows (a, b) are, for one of their two rows, the nearest one or the one with the row that has most pairs.

    At most two a row, at least one.
    """
    import numpy as np

    one, other, far = np.concatenate([a, b]), np.concatenate([b, a]), np.tile(np.bitwise_count((check[a] ^ check[b]).view(np.uint64)).astype(np.int64), 2)
    fewer, kept = -np.bincount(one)[other], np.zeros(len(a), dtype=bool)
    for order in (np.lexsort((fewer, far, one)), np.lexsort((far, fewer, one))):
        kept[order[np.flatnonzero(np.diff(one[order], prepend=-1))] % len(a)] = True
    return kept


def _stars(bits: int):
    """Pairs of one partition's rows (key, check, whole) that meet in a deletion variant and are near in `check`.

    Of the rows that meet, the most central is paired with those near it, of the others the most central again, and so
    on, so that each row has about one pair in each variant. Of these the task gives each pair once, and each document
    its closest ones (_closest): every document that meets a near one has a pair, and two at most are its own.
    """
    import pyarrow as pa

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        batches = list(batches)
        if not sum(len(b) for b in batches):
            return
        rows = pa.Table.from_batches(batches)
        key, check, whole = (rows.column(c).to_numpy() for c in ("key", "check", "whole"))
        pairs = _Met(whole)
        for _, masked in _keys(bits, key):
            order = np.argsort(masked, kind="stable")
            masked = masked[order]
            begins = np.concatenate([[True], masked[1:] != masked[:-1]])
            alone = begins & np.concatenate([begins[1:], [True]])
            order, masked, begins = order[~alone], masked[~alone], begins[~alone]
            if not len(order):
                continue
            order = order[np.lexsort((whole[order], _eccentric(check[order], begins), masked))]
            found, all_rows, all_masked = [], order, masked
            while len(order) > 1:
                begins = np.concatenate([[True], masked[1:] != masked[:-1]])
                lead = order[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
                taken = ~begins & _near(check, lead, order)
                found.append((lead[taken], order[taken]))
                rest = ~begins & ~taken
                order, masked = order[rest], masked[rest]
            # Rows without a star may be near one that an earlier star took: one such pair each keeps them in the search.
            starred = np.zeros(len(key), dtype=bool)
            for a, b in found:
                starred[a] = starred[b] = True
            for side in (1, -1):
                at, step = np.flatnonzero(~starred[all_rows]), 0
                while len(at):
                    step += side
                    at = at[(at + step >= 0) & (at + step < len(all_rows))]
                    at = at[all_masked[at] == all_masked[at + step]]
                    met = _near(check, all_rows[at], all_rows[at + step])
                    found.append((all_rows[at[met]], all_rows[at[met] + step]))
                    at = at[~met]
            pairs.add(found)
        yield pairs.batch(lambda a, b: _closest(check, a, b))

    return work


def _apart(bits: int, least: float, nearest: bool):
    """Pairs of one partition's rows (key, check, whole, size, marks, root) of different roots that meet as in _stars().

    Only pairs that size and marks let reach `least`, each once a task; nearest: of those the nearest one of each document.
    """
    import pyarrow as pa

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        batches = list(batches)
        if not sum(len(b) for b in batches):
            return
        rows = pa.Table.from_batches(batches)
        key, check, whole, root = (rows.column(c).to_numpy() for c in ("key", "check", "whole", "root"))
        second, pairs = (key >> bits) & 1, _Met(whole)
        best, mate = np.full(len(pairs.names), np.inf), np.zeros(len(pairs.names), dtype=np.int64)
        differ = _differences(rows.column("size").to_numpy(), rows.column("marks").combine_chunks(), least)
        for bit, masked in _keys(bits, key):
            # Rows of one root lie together; each row meets those of its group that come after the rows of its root.
            order = np.lexsort((root, masked))
            masked, own = masked[order], root[order]
            begins = np.concatenate([[True], (masked[1:] != masked[:-1]) | (own[1:] != own[:-1])])
            other = np.append(np.flatnonzero(begins)[1:], len(order))[np.cumsum(begins) - 1]
            at, found = np.arange(len(order)), []
            while True:
                inside = other < len(order)
                at, other = at[inside], other[inside]
                same = masked[at] == masked[other]
                at, other = at[same], other[same]
                if not len(at):
                    break
                a, b = order[at], order[other]
                # Equal codes meet in each half and bit: they are taken at the first one only.
                met = _near(check, a, b) & ((key[a] != key[b]) | ((second[a] == 0) & (bit == 0)))
                far = differ(a[met], b[met])
                met[met] = far < np.inf
                a, b, far = a[met], b[met], far[far < np.inf]
                if nearest:
                    for i, j in ((pairs.doc[a], b), (pairs.doc[b], a)):
                        np.minimum.at(best, i, far)
                        mate[i[far == best[i]]] = j[far == best[i]]
                else:
                    found.append((a, b))
                other = other + 1
            pairs.add(found)
        if nearest:
            pairs.add([(pairs.at[best < np.inf], mate[best < np.inf])])
        yield pairs.batch()

    return work


def _marks(own):
    """The parity, for each residue of the hashes of a set, of how many there are: two bits or more an element, up to MOST_MARKS.

    Two sets differ by at least as many elements as parities; halves laid over each other (xor) are the parities of
    half as many residues.
    """
    import numpy as np

    width = min(MOST_MARKS, max(64, 1 << (2 * len(own) - 1).bit_length() if len(own) else 0))
    odd = np.bincount((own % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _differences(size, marks, least: float):
    """A function of pairs of rows: the least share of the elements of both sets in which they differ, by size and marks.

    Infinite where it is so large that their similarity is under `least`: such a pair cannot be one of the wanted.
    """
    import numpy as np

    flat, lengths = marks.flatten().to_numpy(), marks.value_lengths().to_numpy().astype(np.int64)
    starts, made = np.cumsum(lengths) - lengths, {}

    def at_width(width: int):
        """(marks of the rows that have as many words or more, in `width` words; the place of each row in them)."""
        if width not in made:
            place = np.cumsum(lengths >= width) - 1
            words = np.zeros((int((lengths >= width).sum()), width), dtype=np.int64)
            for whole in np.unique(lengths[lengths >= width]).tolist():
                rows = np.flatnonzero(lengths == whole)
                for part in np.array_split(rows, 1 + len(rows) * whole // (1 << 20)):
                    taken = flat[starts[part][:, None] + np.arange(whole)]
                    words[place[part]] = np.bitwise_xor.reduce(taken.reshape(len(part), whole // width, width), axis=1)
            made[width] = words, place
        return made[width]

    def differ(a, b):
        both = (size[a] + size[b]).astype(np.float64)
        # A similarity of s means that the sets share s / (1 + s) of their elements, taken together.
        most = both * (1 - least) / (1 + least) + 1e-6
        least_far, width = np.abs(size[a] - size[b]).astype(np.float64), np.minimum(lengths[a], lengths[b])
        for w in np.unique(width[least_far <= most]).tolist():
            words, place = at_width(w)
            these = np.flatnonzero((width == w) & (least_far <= most))
            for part in np.array_split(these, 1 + len(these) * w // (1 << 20)):  # bounded working memory
                odd = np.bitwise_count((words[place[a[part]]] ^ words[place[b[part]]]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                least_far[part] = np.maximum(least_far[part], odd)
        return np.where(least_far <= most, least_far / np.maximum(both, 1), np.inf)

    return differ


def _eccentric(check, begins):
    """By how many bits each row of groups (which begin where begins is) differs from what most of its group have."""
    import numpy as np

    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, len(check)))
    ones = np.add.reduceat(np.unpackbits(check.view(np.uint8).reshape(-1, 8), axis=1), starts, axis=0, dtype=np.int32)
    most = np.packbits(2 * ones > sizes[:, None], axis=1).view(np.int64).ravel()
    return np.bitwise_count((check ^ np.repeat(most, sizes)).view(np.uint64))


def _verified(df: DataFrame, docs: DataFrame, pairs: DataFrame, words: int, least: float, id_col: str, text_col: str) -> DataFrame:
    """The pairs (src, dst) of which the sets of shingles have a Jaccard similarity of `least` or more."""
    wanted = pairs.select(F.col("src").alias("whole")).unionByName(pairs.select(F.col("dst").alias("whole"))).distinct()
    holders = docs.join(wanted, "whole", "left_semi").groupBy("whole").agg(F.min(id_col).alias("_id")).select("_id").distinct()
    texts = df.join(holders, df[id_col].eqNullSafe(holders["_id"]), "left_semi")
    sets = cut(_sets(texts, id_col, text_col, words, "own array<long>", lambda own: (own.view("int64"),)).groupBy("whole").agg(F.first("own").alias("own")))
    a, b = sets.select(F.col("whole").alias("src"), F.col("own").alias("a")), sets.select(F.col("whole").alias("dst"), F.col("own").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "src").join(b, "dst").where(shared >= F.lit(least) * (F.size("a") + F.size("b") - shared) - 1e-9).select("src", "dst")


def similar(df: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, whole, component_id) of each row: documents linked by a Jaccard similarity of `least` or more.

    The similarity is that of the sets of shingles (words as in fingerprints()), and every link is verified with the
    whole sets; RECALL says how many of the pairs are found. whole is the digest of the set: equal sets are one. First
    each document is compared with the most central of those that it meets (copies of one text differ less from it than
    from each other), in each task with its closest ones; the links of these stars leave few components, and every
    document that meets a near one goes on. Documents of different components that meet are compared, all of them,
    by parities of their sets (_marks), which rule out nearly all pairs under `least` and none above it, inside the
    task where they meet; only the pairs that are left become rows and are verified.
    Further columns of df do not matter; id_col by the name of an output is an error (ValueError).
    """
    no_clash([id_col], "whole", "component_id")
    n = df.count()
    tables, bits = _plan(n, least)
    half = bits // 2

    def short(own):
        check, codes = _short_simhashes(own, tables, bits)
        return check, codes, len(own), _marks(own)

    docs = cut(_sets(df, id_col, text_col, words, "check long, codes array<long>, size long, marks array<long>", short))
    first = docs.groupBy("whole").agg(F.first("check").alias("check"), F.first("codes").alias("codes"))
    mask = (1 << half) - 1
    # A place in an array is an int, which tables and bits of a million documents exceed.
    table = lambda t, second: (t.cast("long") * 2 + second) * (1 << bits)
    both = lambda code, t: F.array(table(t, 0) + code, table(t, 1) + code.bitwiseAND(F.lit(mask)) * (1 << half) + F.shiftright(code, half))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * tables * 2 // SORTED)

    def met(rows: DataFrame, parts: int, work) -> DataFrame:
        index = rows.select(F.explode(F.flatten(F.transform("codes", both))).alias("key"), *(c for c in rows.columns if c != "codes"))
        return cut(index.repartition(parts, F.shiftright("key", half)).mapInArrow(work, "src long, dst long").where("src <> dst").distinct())

    ends = lambda pairs: pairs.select(F.col("src").alias("whole")).unionByName(pairs.select(F.col("dst").alias("whole"))).distinct()
    tried = star = met(first, parts, _stars(bits))
    linked = components(_verified(df, docs, star, words, least, id_col, text_col))
    # Only texts that have met another one go on.
    apart = cut(docs.join(ends(star), "whole", "left_semi").groupBy("whole").agg(*(F.first(c).alias(c) for c in ("check", "codes", "size", "marks"))))
    held = apart.agg(F.sum(F.size("marks") + 4).alias("n")).first()["n"] or 0
    parts = max(parts, held * tables * 2 // (4 * SORTED))
    # The nearest of each first: what they join up is not taken pair by pair. Every text of a pair is in one of these.
    for nearest in (True, False):
        rooted = apart.join(linked.withColumnRenamed("node", "whole"), "whole", "left").withColumn("root", F.coalesce("root", "whole"))
        pairs = met(rooted, parts, _apart(bits, least, nearest))
        if pairs.isEmpty():
            break
        found = cut(_verified(df, docs, pairs.join(tried, ["src", "dst"], "left_anti"), words, least, id_col, text_col))
        if not found.isEmpty():
            linked = components(linked.select(F.col("root").alias("src"), F.col("node").alias("dst")).unionByName(found))
        apart, tried = apart.join(ends(pairs), "whole", "left_semi"), tried.unionByName(pairs)
    low = cut(docs.groupBy("whole").agg(F.min(id_col).alias("low")).join(linked.withColumnRenamed("node", "whole"), "whole", "left").select("whole", F.coalesce("root", "whole").alias("root"), "low"))
    own = low.join(low.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("whole", "component_id")
    return cut(docs.select(id_col, "whole").join(own, "whole").select(id_col, "whole", "component_id"))


def keep_similar(df: DataFrame, words: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that represent their component of similar(), as in keep_one()."""
    return _representatives(df, similar(df, words, least, id_col, text_col), id_col, text_col)


def keep_one(df: DataFrame, words: int = 5, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that represent their near-duplicate component: one each, that of the smallest id.

    Of repeated rows of that id one stays. Rows of null id stay only if their component has no other id. All columns
    of df stay, whatever their names.
    """
    return _representatives(df, near_duplicates(df, words, max_bits, id_col, text_col), id_col, text_col)


def _representatives(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    keep, twice, place = fresh(df, "keep", "twice", "place")
    kept_ids = found.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias(keep)).distinct()
    kept = df.join(kept_ids, df[id_col].eqNullSafe(kept_ids[keep]), "left_semi")
    times = df.groupBy(F.col(id_col).alias(twice)).agg(F.count("*").alias("times")).where("times > 1").select(twice)
    repeated = kept.join(times, kept[id_col].eqNullSafe(times[twice]), "left_semi")
    single = kept.join(times, kept[id_col].eqNullSafe(times[twice]), "left_anti")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(text_col))
    return single.unionByName(repeated.withColumn(place, rank).where(F.col(place) == 1).drop(place))
