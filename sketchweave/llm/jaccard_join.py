"""Exact n-gram Jaccard join by a token-group matrix.

1. Every text is a set of shingles; rows with equal sets are one class, which
   stands in all that follows once.
2. Blocks of texts ask the hash buckets in how many blocks each shingle occurs
   (``exchange``).  A set links with another one only if it shares most of its
   shingles, so a class with too few shared ones leaves the join here: texts
   that nothing resembles cost no more than this round.
3. The other classes are partitioned into groups of similar ones (by two minimum
   hashes of their shared shingles, which relatives have in common).  The matrix
   stores, per shingle, the groups whose union holds it.  Of each class, only
   the shingles that a partner must share some of enter: a prefix in one global
   order, rare ones first, longer by the number of entries that linked sets are
   then sure to share.  Group pairs that share too few entries have no link.
4. Groups are held in blocks of members.  Each group's leader (the class with
   the fewest shingles of its own) visits the blocks of its group and of related
   groups, and the members of a block are compared with each other.  That joins
   most of a family of copies at a cost in proportion to its members.
5. Of the remaining group pairs the smaller visits the larger, but no class
   visits a block all of whose members it is connected with already.  A visitor
   is first held against the block's shingle union, which bounds its overlap
   with every member, and only blocks that it can still reach the similarity in
   are opened and compared exactly.

Links are followed to components; each block returns a spanning forest of its
links, so no link between components is lost and copies are never expanded into
pairs.  Shingles are 64-bit hashes of words, in the text lower-cased from A to Z.

Defined results: null and empty texts, and texts of separators only, have an
empty set and are linked with nothing; a text of fewer words than a shingle has
one shingle, its whole word sequence; rows repeated with their id are equal
sets and link; rows with a null id link like others, but a component is named
by its smallest id that isn't null (null if it has none); an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytehash
from .bytehash import mix
from .common import Scratch, pick, shuffle_width
from .components import components
from .exchange import TextBlocks, bucket_cuts, replies, unpacked
from .ragged import positions, slices, utf8

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[32, *range(9, 14)]] = True
#: Bytes of text handled at a time, and of a block of the exchange.
SLICE, BLOCK = 4 << 20, 4 << 20
#: One entry more that linked sets must share for so many tokens of the smaller set.
SHARE = 16
#: Most members, tokens and visitors of an opened block, on average.
MEMBERS, TOKENS, VISITORS = 512, 2_000_000, 1024
SALT = np.array([0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word."""
    word = np.append(~SEPARATOR[raw], False)
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    edges = offsets[1:-1]
    first[edges] = word[edges]
    last[edges[edges > 0] - 1] = word[edges[edges > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    prefix = bytehash.prefixes(raw, bytehash.FOLDED)
    return mix(bytehash.ranges(prefix, starts, ends)), np.searchsorted(offsets, starts, side="right") - 1


def sets_of(raw: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    words, of = word_hashes(raw, offsets)
    counts = np.bincount(of, minlength=len(offsets) - 1)
    odd = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    padded = np.append(words, np.zeros(width, np.uint64))
    value = np.zeros(len(words), np.uint64)
    for j in range(width):
        value += padded[j : j + len(words)] * odd[j]
    ends = np.cumsum(counts)
    value = mix(value)
    out = []
    for n, end in zip(counts.tolist(), ends.tolist()):
        if n >= width:
            x = np.sort(value[end - n : end - width + 1])
            out.append(x[np.append(True, x[1:] != x[:-1])])
        elif n:
            out.append(mix((words[end - n : end] * odd[:n]).sum(keepdims=True) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, width: int):
    """(row number, sorted distinct shingle hashes) of every text."""
    for a, b in slices(texts, SLICE):
        raw, offsets = utf8(texts.slice(a, b - a))
        yield from zip(range(a, b), sets_of(raw, offsets, width))


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens that a set of n has in common with any set of at least that similarity."""
    return (percent * n + 99) // 100


def shared_entries(n: np.ndarray) -> np.ndarray:
    """Matrix entries that a set of n asks two linked sets to share; the prefix is longer by as many."""
    return 1 + n // SHARE


class Sets:
    """The shingle sets of a block of texts, equal ones once, and the block's distinct tokens."""

    def __init__(self, row, width: int):
        self.ids, self.null, sizes, raw = unpacked(row)
        self.sets = sets_of(raw, np.append(0, np.cumsum(sizes)), width)
        number: dict[tuple[int, int], int] = {}
        self.digests = [(int(mix(x ^ SALT[0]).sum()), int(mix(x ^ SALT[1]).sum())) if len(x) else (0, 0) for x in self.sets]
        # The rows that stand for their class in this block.
        self.leads = [i for i, (x, d) in enumerate(zip(self.sets, self.digests)) if len(x) and number.setdefault(d, i) == i]
        each = [self.sets[i] for i in self.leads] or [np.zeros(0, np.uint64)]
        self.tokens, of, self.seen = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        self.places = np.split(of.ravel(), np.cumsum([len(x) for x in each])[:-1])


def fingerprint(tokens: np.ndarray) -> np.ndarray:
    """32 bits of a token beside those that name its bucket.  Two tokens with one fingerprint only count as shared."""
    return ((tokens >> np.uint64(16)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def block_counts(blobs: list[bytes]) -> list[tuple[int, bytes]]:
    """For every fingerprint of every block: 0 if no other block has it, else a quarter-octave level of the number of blocks."""
    sizes = [len(b) // 4 for b in blobs]
    _, of, n = np.unique(np.frombuffer(b"".join(blobs), np.uint32), return_inverse=True, return_counts=True)
    level = np.where(n > 1, np.minimum(255, 4 * np.log2(n)), 0).astype(np.uint8)[of.ravel()]
    return [(len(x), x.tobytes()) for x in np.split(level, np.cumsum(sizes)[:-1])]


def group_of(tokens: np.ndarray) -> int:
    """Two minimum hashes in one number."""
    a, b = mix(tokens ^ SALT[2]).min(keepdims=True), mix(tokens ^ SALT[3]).min(keepdims=True)
    return int(mix(a * np.uint64(3) + b).view(np.int64)[0])


def described(docs: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """Per row: row number, id, n, set digest (d1, d2).  The first row of a class in a block also
    has, if the class may have links: group g, own (tokens that no other class has), tokens and prefix as bytes."""
    blocks = TextBlocks(docs, BLOCK, scratch)
    buckets = blocks.width

    def messages(row):
        tokens = Sets(row, width).tokens
        return [fingerprint(tokens[a:b]).tobytes() for a, b in bucket_cuts(tokens, buckets)]

    blocks.ask(messages, block_counts)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Sets(row, width)
                level = np.frombuffer(b"".join(r["data"] for r in replies(row, 0)), np.uint8)
                shared = (level > 0) | (s.seen > 1)
                rank = level.astype(np.int64)
                m = len(s.sets)
                g, own, tokens, prefix = [None] * m, [None] * m, [None] * m, [None] * m
                for i, at in zip(s.leads, s.places):
                    x, common = s.sets[i], shared[at]
                    n, some = len(x), int(common.sum())
                    if some < least_overlap(n, percent):
                        continue
                    # Rare tokens first, ties by hash; what no other class has is in the prefix but never matches.
                    order = np.argsort(rank[at], kind="stable")[: n - int(least_overlap(n, percent)) + int(shared_entries(n))]
                    g[i], own[i], tokens[i], prefix[i] = group_of(x[common]), n - some, x.tobytes(), x[order][common[order]].tobytes()
                long = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["first"] + np.arange(m)),
                        pa.array(s.ids, pa.int64(), mask=s.null),
                        pa.array([len(x) for x in s.sets], pa.int64()),
                        long([d % (1 << 64) for d, _ in s.digests]),
                        long([d % (1 << 64) for _, d in s.digests]),
                        pa.array(g, pa.int64()),
                        pa.array(own, pa.int64()),
                        pa.array(tokens, pa.binary()),
                        pa.array(prefix, pa.binary()),
                    ],
                    names=["row", "id", "n", "d1", "d2", "g", "own", "tokens", "prefix"],
                )

    return scratch.table(blocks.rows.mapInArrow(run, "row long, id long, n long, d1 long, d2 long, g long, own long, tokens binary, prefix binary"), "sets")


ENTRY = [("t", np.uint64), ("g", np.int64), ("lo", np.uint32), ("hi", np.uint32)]


def group_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of groups that share enough matrix entries and have members of compatible sizes: g1 < g2.

    The entries travel as packed arrays, one per token bucket and batch of rows;
    a pair comes out of a bucket once, with the number of entries shared there.
    """
    buckets = shuffle_width(classes.sparkSession)

    def spread(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            counts = np.diff(offsets) // 8
            entries = np.empty(int(counts.sum()), ENTRY)
            entries["t"], entries["g"] = np.frombuffer(raw.tobytes(), np.uint64), np.repeat(batch.column(0).to_numpy(), counts)
            entries["lo"] = entries["hi"] = np.repeat(batch.column(1).to_numpy(), counts)
            entries = merged(entries)
            out = [(i, entries[a:b].tobytes()) for i, (a, b) in enumerate(bucket_cuts(entries["t"], buckets)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "entries"])

    def match(batches):
        e = merged(np.frombuffer(b"".join(x for batch in batches for x in batch.column(1).to_pylist()), ENTRY))
        begin = np.flatnonzero(np.append(True, e["t"][1:] != e["t"][:-1])) if len(e) else np.zeros(0, np.int64)
        count = np.diff(np.append(begin, len(e)))
        begin, count = begin[count > 1], count[count > 1]
        left = positions(begin, count)
        of = np.repeat(np.arange(len(begin)), count)
        rest = begin[of] + count[of] - 1 - left
        seen, shared, least = np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for a in range(0, len(left), 20_000):
            x = np.repeat(left[a : a + 20_000], rest[a : a + 20_000])
            y = positions(left[a : a + 20_000] + 1, rest[a : a + 20_000])
            ok = (percent * e["lo"][x].astype(np.int64) <= 100 * e["hi"][y].astype(np.int64)) & (percent * e["lo"][y].astype(np.int64) <= 100 * e["hi"][x].astype(np.int64))
            found = np.stack([e["g"][x[ok]], e["g"][y[ok]]], axis=1)
            low = np.minimum(e["lo"][x[ok]], e["lo"][y[ok]]).astype(np.int64)
            seen, shared, least = counted(np.vstack([seen, found]), np.append(shared, np.ones(len(found), np.int64)), np.append(least, low))
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen.min(axis=1)), pa.array(seen.max(axis=1)), pa.array(shared), pa.array(least)], names=["g1", "g2", "shared", "least"])

    blobs = classes.select("g", "n", "prefix").mapInArrow(spread, "bucket int, entries binary")
    found = blobs.repartitionById(buckets, F.col("bucket")).mapInArrow(match, "g1 long, g2 long, shared long, least long")
    found = found.groupBy("g1", "g2").agg(F.sum("shared").alias("shared"), F.min("least").alias("least"))
    return found.where(F.col("shared") >= 1 + F.floor(F.col("least") / SHARE)).select("g1", "g2")


def counted(pairs: np.ndarray, shared: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each pair: sum of the shared entries, smallest size."""
    if not len(pairs):
        return pairs, shared, least
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    begin = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]).any(axis=1)))
    return pairs[begin], np.add.reduceat(shared[order], begin), np.minimum.reduceat(least[order], begin)


def merged(e: np.ndarray) -> np.ndarray:
    """Entries sorted by token and group, one for each, with the range of sizes."""
    if not len(e):
        return e.copy()
    e = e[np.lexsort((e["g"], e["t"]))]
    begin = np.flatnonzero(np.append(True, (e["t"][1:] != e["t"][:-1]) | (e["g"][1:] != e["g"][:-1])))
    out = e[begin].copy()
    out["lo"], out["hi"] = np.minimum.reduceat(e["lo"], begin), np.maximum.reduceat(e["hi"], begin)
    return out


class Forest:
    """Union-find; ``join`` says whether two nodes were apart."""

    def __init__(self):
        self.parent = {}

    def root(self, x):
        while (p := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[p]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


class OpenBlock:
    """Members of a block: (id, sorted tokens), their token union, and the owners of every token of it."""

    def __init__(self, members: list, percent: int):
        self.ids, self.percent, self.forest = [i for i, _ in members], percent, Forest()
        self.sizes = np.array([len(t) for _, t in members])
        every = np.concatenate([t for _, t in members])
        owner = np.repeat(np.arange(len(members)), self.sizes)
        order = np.argsort(every, kind="stable")
        every, self.owner = every[order], owner[order]
        self.union, self.begin = np.unique(every, return_index=True)
        self.count = np.diff(np.append(self.begin, len(every)))

    def visit(self, vid: int, tokens: np.ndarray) -> list[tuple[int, int]]:
        """Links of a visitor that connect what was apart."""
        n, sizes, percent = len(tokens), self.sizes, self.percent
        reach = (percent * n <= 100 * sizes) & (percent * sizes <= 100 * n)
        if not reach.any():
            return []
        at = np.minimum(np.searchsorted(self.union, tokens), len(self.union) - 1)
        at = at[self.union[at] == tokens]
        # Overlap with the union bounds that with every member: 100 o >= p (n + m - o).
        if len(at) < -(-percent * (n + int(sizes[reach].min())) // (100 + percent)):
            return []
        common = np.bincount(self.owner[positions(self.begin[at], self.count[at])], minlength=len(sizes))
        linked = reach & (100 * common >= percent * (n + sizes - common))
        return [(vid, self.ids[i]) for i in np.flatnonzero(linked) if self.ids[i] != vid and self.forest.join(vid, self.ids[i])]


def open_block(members: list, visitors: list, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between visitors and members; both are (id, sorted tokens)."""
    block = OpenBlock(members, percent)
    return [e for vid, tokens in visitors for e in block.visit(vid, tokens)]


def opened(placed: DataFrame, key: list[str], percent: int) -> DataFrame:
    """placed: key columns, side (0 members, 1 members that also visit, 2 visitors), rep, tokens.
    Spanning edges (a, b) of every block; visitors stream past its members."""
    width = shuffle_width(placed.sparkSession)
    dealt = placed.select(*key, "side", "rep", "tokens").repartition(width, *key).sortWithinPartitions(*key, "side")

    def run(batches):
        now, members, home, block, found = None, [], [], None, []

        def enter():
            """The members are complete."""
            nonlocal block
            if block is None and members:
                block = OpenBlock(members, percent)
                for vid, tokens in home:
                    found.extend(block.visit(vid, tokens))

        emit = lambda: pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])
        for batch in batches:
            *keys, side, rep, tokens = [c.to_pylist() for c in batch.columns]
            for at, k, r, t in zip(zip(*keys), side, rep, tokens):
                if at != now:
                    enter()
                    now, members, home, block = at, [], [], None
                x = np.frombuffer(t, np.uint64)
                if k < 2:
                    members.append((r, x))
                    if k:
                        home.append((r, x))
                else:
                    enter()
                    if block is not None:
                        found.extend(block.visit(r, x))
            if len(found) > 10_000:
                yield emit()
                found.clear()
        enter()
        yield emit()

    return dealt.mapInArrow(run, "a long, b long")


def _every(n):
    return F.explode(F.sequence(F.lit(0), n - 1))


def _blocks(members, tokens):
    return F.greatest(F.ceil(members / F.lit(MEMBERS)), F.ceil(tokens / F.lit(TOKENS))).cast("int")


def _spot(n):
    return F.pmod(F.xxhash64("rep"), n).cast("int")


def leader_edges(classes: DataFrame, groups: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Edges inside every block of a group, and of leaders with the blocks of their and of related groups.

    groups: g, m, nb (blocks), leader.  Related groups matter where one of the two has several blocks; else
    every member of the smaller one visits the other anyway.
    """
    both = pairs.unionByName(pairs.select(F.col("g2").alias("g1"), F.col("g1").alias("g2")))
    far = both.join(groups.select(F.col("g").alias("g1"), F.col("nb").alias("nb1"), "leader"), "g1").join(groups.select(F.col("g").alias("g2"), "nb"), "g2")
    far = far.where("nb > 1 OR nb1 > 1").select(F.col("g2").alias("g"), "nb", "leader")
    calls = far.unionByName(groups.where("nb > 1").select("g", "nb", "leader")).select("g", _every(F.col("nb")).alias("block"), F.col("leader").alias("rep"))
    visitors = classes.select("rep", "tokens").join(calls, "rep").select("g", "block", F.lit(2).alias("side"), "rep", "tokens")
    visited = calls.select("g").distinct().withColumn("called", F.lit(True))
    here = classes.join(groups.select("g", "m", "nb"), "g").join(visited, "g", "left").where("m > 1 OR called")
    members = here.select("g", _spot(F.col("nb")).alias("block"), F.lit(1).alias("side"), "rep", "tokens")
    return opened(members.unionByName(visitors), ["g", "block"], percent)


def visitor_edges(classes: DataFrame, groups: DataFrame, pairs: DataFrame, found: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Edges of the remaining group pairs.  found: node, component of the edges so far.

    The members of a group that make up a large share of one component are a part
    of their own, the others are one mixed part; a class visits no part that it is
    connected with as a whole.
    """
    # Only groups of several blocks can have parts to skip.
    large = classes.join(groups.where("nb > 1").select("g"), "g", "left_semi").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    sizes = large.groupBy("g", "component").agg(F.count("*").alias("m")).where((F.col("m") >= MEMBERS) & F.col("component").isNotNull()).select("g", F.col("component").alias("part"))
    named = classes.drop("tokens", "prefix").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.join(sizes, (named["g"] == sizes["g"]) & (named["component"] == sizes["part"]), "left").select(named["rep"], named["g"], "n", "component", "part")
    named = scratch.table(named, "parts")
    parts = named.groupBy("g", "part").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"))
    parts = scratch.table(parts.select("g", "part", "m", _blocks(F.col("m"), F.col("tokens")).alias("nb")), "part-sizes")
    one, two = (parts.select(*[F.col(c).alias(f"{c}{k}") for c in parts.columns]) for k in (1, 2))
    inside = groups.where("nb > 1").select(F.col("g").alias("g1"), F.col("g").alias("g2"))
    apart = F.col("part1").isNull() | F.col("part2").isNull() | (F.col("part1") != F.col("part2"))
    # Within a group every pair of parts comes once, and a mixed part with itself.
    rank = lambda k: F.coalesce(F.col(f"part{k}"), F.lit(-1))
    once = (F.col("g1") != F.col("g2")) | (rank(1) <= rank(2))
    sized = pairs.unionByName(inside).join(one, "g1").join(two, "g2").where(apart & once)
    first = (F.col("m1") > F.col("m2")) | ((F.col("m1") == F.col("m2")) & (F.col("g1") < F.col("g2")))
    end = lambda c, k: F.when(first, F.col(f"{c}{k}")).otherwise(F.col(f"{c}{3 - k}"))
    visits = sized.select(end("g", 1).alias("home"), end("part", 1).alias("hpart"), end("g", 2).alias("g"), end("part", 2).alias("part"), F.least("m1", "m2").alias("v"))
    visits = scratch.table(visits, "visits")
    homes = visits.groupBy("home", "hpart").agg(F.sum("v").alias("visitors")).join(parts.select(F.col("g").alias("home"), F.col("part").alias("p"), "nb"), "home")
    homes = homes.where(F.col("hpart").eqNullSafe(F.col("p"))).select("home", "hpart", F.col("nb").alias("nh"), F.ceil(F.col("visitors") / F.lit(VISITORS)).cast("int").alias("nv"))
    homes = scratch.table(homes, "homes")
    spot = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    at_home = named.select("rep", F.col("g").alias("home"), F.col("part").alias("p")).join(homes, "home").where(F.col("hpart").eqNullSafe(F.col("p")))
    at_home = at_home.select("rep", "home", "hpart", spot("nh").alias("hb"), _every(F.col("nv")).alias("vb"), F.lit(0).alias("side"))
    calls = visits.join(homes.select(F.col("home").alias("h"), F.col("hpart").alias("hp"), "nh", "nv"), (F.col("home") == F.col("h")) & F.col("hpart").eqNullSafe(F.col("hp")))
    calls = calls.select(F.col("g").alias("vg"), F.col("part").alias("vpart"), "home", "hpart", "nh", "nv")
    connected = F.coalesce(F.col("component") == F.col("hpart"), F.lit(False))
    away = named.join(calls, (named["g"] == calls["vg"]) & named["part"].eqNullSafe(calls["vpart"]) & ~connected)
    away = away.select("rep", "home", "hpart", _every(F.col("nh")).alias("hb"), spot("nv").alias("vb"), F.lit(2).alias("side"))
    placed = classes.select("rep", "tokens").join(at_home.unionByName(away), "rep")
    return opened(placed, ["home", "hpart", "hb", "vb"], percent)


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable by links)."""
    scratch = Scratch(df.sparkSession, "jaccard")
    docs = pick(df, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    rows = described(docs, width, percent, scratch)
    names = scratch.table(rows.where("n > 0").groupBy("d1", "d2").agg(F.min("row").alias("rep"), F.min("id").alias("low")), "classes")
    able = rows.where("tokens IS NOT NULL").select(F.col("row").alias("rep"), "g", "n", "own", "tokens", "prefix")
    classes = scratch.table(able.join(names.select("rep"), "rep", "left_semi"), "linkable")
    # The leader has the smallest share of tokens of its own.
    leader = F.min_by("rep", F.struct(F.col("own") / F.col("n"), F.col("rep")))
    groups = classes.groupBy("g").agg(F.count("*").alias("m"), F.sum("n").alias("tokens"), leader.alias("leader"))
    groups = scratch.table(groups.select("g", "m", _blocks(F.col("m"), F.col("tokens")).alias("nb"), "leader"), "groups")
    pairs = scratch.table(group_pairs(classes, percent), "group-pairs")
    near = scratch.table(leader_edges(classes, groups, pairs, percent), "leader-links")
    far = visitor_edges(classes, groups, pairs, components(near, scratch), percent, scratch)
    edges = scratch.table(near.unionByName(far), "links")
    found = components(edges, scratch)
    tops = names.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "low", F.coalesce("component", "rep").alias("component"))
    # Written, so that the join reads plain shuffles and a large component can be split over tasks.
    lows = scratch.table(tops.groupBy("component").agg(F.min("low").alias("name")), "names")
    tops = tops.join(lows, "component").select("d1", "d2", "name")
    out = rows.select("id", "n", "d1", "d2").join(tops, ["d1", "d2"], "left")
    return scratch.result(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id")))
