"""Exact deduplication with a log-structured merge index of text digests.

Every scan task acts as one memtable: it flushes a run of (digest, id) rows
sorted by digest.  Runs stand in levels; when a level has FANOUT runs, compaction
merges them into one run of the next level that keeps one winner and a count per
digest.  A lookup merges what is left in all levels.  Digests that occur more
than once are hits, and are verified on bytes: a bit filter of the hits, of a
bounded size, is probed by every document where it is read, so only texts of
hits (and of the filter's rare false ones) are shuffled, combined on the map side
to one text per task and digest.  A digest with more than one text is split by
the texts themselves.

Only DataFrame functions are used.

Defined results: a null text counts as empty; a null id never wins against a
non-null one; rows repeated with one id are counted in ``group_size`` and share
the ``kept`` flag of their id; an empty table gives an empty result; columns of
the input other than the id and the text are ignored here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, fold_ascii, pick

#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Bits of a filter per digest, and the words of 64 bits that a filter has at most (8 MB, the bound of what is broadcast).
FILTER_BITS, FILTER_WORDS = 16, 1 << 20


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


class DigestFilter:
    """A bit per hashed digest: no digest of the set is missed, others pass rarely.

    Past FILTER_WORDS * 64 / FILTER_BITS digests more of the others pass, which costs shuffled bytes and no result.
    """

    def __init__(self, digests: DataFrame, n: int):
        self.words = 1 << max(4, min(FILTER_WORDS, n * FILTER_BITS // 64 + 1).bit_length() - 1)
        place = self._place("digest")
        placed = digests.select(place.alias("place"))
        bits = placed.groupBy(F.expr("place div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits"))
        # At most FILTER_WORDS rows in one row: an array in the order of the words.
        dense = digests.sparkSession.range(self.words).withColumnRenamed("id", "word").join(bits, "word", "left")
        row = F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"])
        self.table = dense.agg(row.alias("_words")).withColumn("_one", F.lit(1))

    def _place(self, digest: str) -> Column:
        return F.pmod(F.xxhash64(digest), F.lit(self.words * 64))

    def probe(self, df: DataFrame) -> DataFrame:
        """The rows of ``df`` whose digest may be in the set."""
        placed = df.withColumns({"_one": F.lit(1), "_place": self._place("digest")})
        held = placed.join(F.broadcast(self.table), "_one").where(F.expr("(shiftright(_words[cast(_place div 64 as int)], cast(_place % 64 as int)) & 1) = 1"))
        return held.select(*df.columns)


class DigestIndex:
    """Levels of sorted runs under one shared folder.

    ``flush`` adds a level-0 run per task, ``compact`` merges full levels (or all),
    ``winners`` looks up every digest's winner and count over all levels.
    """

    def __init__(self, scratch: Scratch, keep: str = "max", fanout: int = FANOUT):
        if keep not in ("min", "max"):
            raise ValueError("keep is 'min' or 'max'")
        self.scratch, self.keep, self.fanout = scratch, keep, fanout
        self.levels: list[list[str]] = [[]]

    @property
    def best(self):
        return F.max if self.keep == "max" else F.min

    def _write(self, df: DataFrame, level: int) -> str:
        while len(self.levels) <= level:
            self.levels.append([])
        path = self.scratch.new(f"level{level}")
        df.sortWithinPartitions("digest").write.parquet(path)
        self.levels[level].append(path)
        return path

    def flush(self, digests: DataFrame) -> DataFrame:
        """(id, digest) rows of one batch, one sorted run per task; returns a scan of them."""
        path = self._write(digests.select("id", "digest"), 0)
        return self.scratch.spark.read.schema(digests.select("id", "digest").schema).parquet(path)

    def _merged(self, runs: list[tuple[int, str]]) -> DataFrame:
        rows = None
        for level, path in runs:
            run = self.scratch.spark.read.parquet(path)
            if not level:
                run = run.select("digest", F.col("id").alias("winner"), F.lit(1).cast("long").alias("n"))
            rows = run if rows is None else rows.unionByName(run)
        return rows.groupBy("digest").agg(self.best("winner").alias("winner"), F.sum("n").alias("n"))

    def compact(self, whole: bool = False) -> None:
        """Merges every level that has ``fanout`` runs into a run of the next level; with ``whole``, all runs into one."""
        if whole:
            runs = [(k, p) for k, level in enumerate(self.levels) for p in level]
            if len(runs) > 1 or runs and not runs[0][0]:
                merged, self.levels = self._merged(runs), [[] for _ in self.levels]
                self._write(merged, max(k for k, _ in runs) + 1)
            return
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fanout:
                runs, self.levels[level] = self.levels[level], []
                self._write(self._merged([(level, p) for p in runs]), level + 1)
            level += 1

    def winners(self) -> DataFrame:
        """digest, winner, n over all levels."""
        runs = [(k, p) for k, level in enumerate(self.levels) for p in level]
        if len(runs) == 1 and runs[0][0]:
            return self.scratch.spark.read.parquet(runs[0][1])
        return self._merged(runs)


def clashing(docs: DataFrame, winners: DataFrame) -> DataFrame:
    """Digests that stand for more than one text: digest.  docs: digest, norm."""
    hits = winners.where("n > 1").select("digest")
    probed = DigestFilter(hits, hits.count()).probe(docs.select("digest", "norm"))
    texts = probed.groupBy("digest").agg(F.collect_set("norm").alias("texts"))
    return texts.where(F.size("texts") > 1).select("digest")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", digest=sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, digest.

    ``digest`` maps the normalised text column to a string; any function is
    safe, because hits are verified on bytes and split where texts differ.
    """
    scratch = Scratch(df.sparkSession, "exact")
    docs = pick(df, id=id_col, text=text_col).select("id", fold_ascii(F.col("text")).alias("norm")).withColumn("digest", digest(F.col("norm")))
    index = DigestIndex(scratch, keep)
    rows = index.flush(docs)
    index.compact(whole=True)
    winners = index.winners()
    clashes = scratch.table(clashing(docs, winners), "clashes")
    if clashes.isEmpty():
        keyed, key = rows, ["digest"]
    else:
        marked = docs.join(clashes.withColumn("clash", F.lit(True)), "digest", "left")
        keyed = scratch.table(marked.select("id", "digest", F.when(F.col("clash"), F.col("norm")).alias("variant")), "variants")
        keyed = keyed.withColumn("variant", F.coalesce(F.concat(F.lit("v"), "variant"), F.lit("")))
        key = ["digest", "variant"]
        winners = keyed.groupBy(*key).agg(index.best("id").alias("winner"), F.count("*").alias("n"))
    out = keyed.join(winners, key)
    out = out.select(
        F.col("id").alias(id_col),
        F.col("winner").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("id").eqNullSafe(F.col("winner")).alias("kept"),
        F.col("digest"),
    )
    return scratch.result(out)
