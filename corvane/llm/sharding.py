"""Sharding by balanced label propagation.

Documents with equal texts are linked; the hash of a document gives the shard
it starts in.  In each round every group that has no shard of its own yet asks
for the one, among those with room for all of it, that most of its documents
start in or, if there is none, for another by hash; a shard admits the largest
groups first, as far as its room goes, and one admitted stays.  Groups without
a shard use up no room, so none is in another's way.  Rounds end when no group
that is left fits anywhere.  The few groups that fill a good part of a shard
choose before the rounds, one after another.  Texts with more copies than a shard can take, and
the few groups that fit nowhere any more, are dealt by text and starting shard
into what room is left.  Last, every shard is brought to exactly its quota:
surplus documents, unlinked ones first and whole groups never, are dealt into
the shards that lack some.  All of it is joins and grouped aggregation; what is
ordered globally is ordered within hash buckets whose offsets come from a small
table of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.shared import drop_stage, stage

SHARDS = 16
#: Buckets by hash in which groups are admitted, at first; more when none of them fits.
FINE = 256
#: Groups over a shard's quota divided by this are placed one by one.
LARGE = 64
#: Rows are numbered in so many buckets by hash at least, at most, and rows in each.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_ROWS = 64, 1 << 14, 30_000


def text_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def text_crc(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def _numbered(rows: DataFrame, within: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` (with a column ``bucket``) numbered from 0 within ``within``,
    by bucket and then ``order``, without ever sorting a whole group at once."""
    counts = rows.groupBy(*within, "bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*within, "bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy(*within, "bucket").orderBy(*order)
    numbered = rows.withColumn("__own", F.row_number().over(own) - 1)
    return numbered.join(F.broadcast(starts), [*within, "bucket"]).withColumn(name, F.col("__start") + F.col("__own")).drop("__own", "__start")


def propagate(groups: DataFrame, room: list[int]) -> tuple[list[DataFrame], DataFrame]:
    """``groups`` (k, all, held: its (n, start) by starting shard) as those
    that a shard took in whole, (k, held, to) in parts, and those that do not
    fit anywhere, (k, all, held).  ``room`` has each shard's rows that are free
    and is brought up to date.
    """
    settled, left, n_left, fine, turn = [], groups, groups.count(), FINE, 0
    while n_left and max(room) > 0:
        rooms = F.array(*[F.lit(r).cast("long") for r in room])
        free = lambda s: F.element_at(rooms, s + 1)
        prefers = lambda s: F.pmod(F.xxhash64("k", s), F.lit(1 << 30))
        own = F.array_max(F.transform(F.filter("held", lambda x: free(x["start"]) >= F.col("all")), lambda x: F.struct(x["n"].alias("n"), prefers(x["start"]).alias("p"), x["start"].alias("to"))))["to"]
        # Others are drawn in proportion to their room; what does not fit there tries the shard with the most.
        point, drawn, upto = F.pmod(F.xxhash64(F.lit(turn), "k"), F.lit(sum(room))), F.lit(room.index(max(room))), sum(room)
        for s in reversed(range(len(room))):
            drawn, upto = F.when((point < upto) & (point >= upto - room[s]), F.lit(s)).otherwise(drawn), upto - room[s]
        other = F.when(free(drawn) >= F.col("all"), drawn).otherwise(F.lit(room.index(max(room))))
        asks = left.withColumn("to", F.coalesce(own, other)).withColumns({"level": F.floor(F.log2("all")).cast("int"), "fine": F.pmod(F.xxhash64("k", F.lit(turn)), F.lit(fine)).cast("int")})
        queue = asks.where(free(F.col("to")) >= F.col("all")).groupBy("to", "level", "fine").agg(F.sum("all").alias("n"))
        # A bucket that is too large for the room must not use it up: it is out before sums run.
        sums = Window.partitionBy("to").orderBy(F.desc("level"), "fine").rowsBetween(Window.unboundedPreceding, 0)
        admitted = queue.where(F.col("n") <= free(F.col("to"))).withColumn("upto", F.sum("n").over(sums)).where(F.col("upto") <= free(F.col("to"))).select("to", "level", "fine", F.lit(True).alias("ok"))
        goes = (free(F.col("to")) >= F.col("all")) & F.coalesce("ok", F.lit(False))
        after = stage(asks.join(admitted, ["to", "level", "fine"], "left").select("k", "all", "held", "to", goes.alias("went")), "shard-round")
        took = after.where("went").groupBy("to").agg(F.sum("all").alias("n"), F.count(F.lit(1)).alias("groups")).collect()
        turn += 1
        if took:
            for r in took:
                room[r.to] -= r.n
            n_left -= sum(r.groups for r in took)
            settled.append(after.where("went").select("k", "held", "to"))
            left = after.where("not went").select("k", "all", "held")
            continue
        drop_stage(groups.sparkSession, after)
        if fine >= n_left:
            break
        fine *= 16
    return settled, left


def fill_whole(groups: list, room: list[int]) -> tuple[list[tuple], list]:
    """(a, b, start, to, loose) for every starting shard of the ``groups``, few
    rows (k, all, held), that find room for all of them, and the other groups:
    one by one, largest first, where most of it starts."""
    out, rest = [], []
    for g in sorted(groups, key=lambda g: (-g["all"], g.k)):
        here = {h.start: h.n for h in g.held}
        to = max((s for s in range(len(room)) if room[s] >= g["all"]), key=lambda s: (here.get(s, 0), room[s], -s), default=None)
        if to is None:
            rest.append(g)
        else:
            room[to] -= g["all"]
            out += [(g.k.a, g.k.b, h.start, to, 0) for h in g.held]
    return out, rest


def fill_parts(groups: list, room: list[int]) -> list[tuple]:
    """(a, b, start, to, loose) for every starting shard of ``groups``, few
    rows (k, all, held) of groups that no shard can take whole: largest first,
    where there is room for it, by preference with others of its group.  What
    has no room stays where it starts."""
    out = []
    for g in sorted(groups, key=lambda g: (-g["all"], g.k)):
        here = [0] * len(room)
        for h in sorted(g.held, key=lambda h: (-h.n, h.start)):
            to = max((s for s in range(len(room)) if room[s] >= h.n), key=lambda s: (here[s], room[s], s == h.start, -s), default=h.start)
            room[to] -= h.n
            here[to] += h.n
            out.append((g.k.a, g.k.b, h.start, to, 1))
    return out


def shard(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs``.

    The shards' counts of rows differ by one at most; ``slot`` numbers a
    shard's rows from 0 without gaps.  Equal texts are linked (null texts are
    not, empty ones are).  Rows that repeat an id, or have none, are placed one
    by one; an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    key = F.when(F.col("t").isNotNull(), F.struct(F.xxhash64("t").alias("a"), F.xxhash64(F.lit(7), F.col("t")).alias("b")))
    rows = source.select("doc_id", text_size(F.col("t")).alias("size"), text_crc(F.col("t")).alias("text_crc32"), key.alias("k"))
    rows = rows.withColumns({"start": F.pmod(F.xxhash64(F.lit("start"), "doc_id", "k"), F.lit(shards)).cast("int"), "bucket": F.pmod(F.xxhash64(F.lit("bucket"), "doc_id", "k"), F.lit(MOST_BUCKETS)).cast("int")})
    rows = stage(rows, "shard-rows")
    total = rows.count()
    quota = total // shards
    buckets = max(LEAST_BUCKETS, min(MOST_BUCKETS, total // (shards * BUCKET_ROWS)))
    want = [quota + (1 if s < total % shards else 0) for s in range(shards)]
    # Groups of two and more, by text; unlinked documents stay out of the rounds.
    sums = rows.where(F.col("k").isNotNull()).groupBy("k", "start").agg(F.count(F.lit(1)).alias("n"))
    linked = stage(sums.groupBy("k").agg(F.sum("n").alias("all"), F.collect_list(F.struct("n", "start")).alias("held")).where(F.col("all") > 1), "shard-linked")
    room = list(want)
    large = F.col("all") * LARGE > max(want)
    # There are at most LARGE large groups to a shard; they go first, before smaller ones have taken a little of every room.
    whole, cut = fill_whole([g for g in linked.where(large).collect() if g["all"] <= max(want)], room)
    settled, left = propagate(linked.where(~large), room)
    # Each of those left is larger than any room, so there are few.
    cut += left.collect() + linked.where(F.col("all") > max(want)).collect()
    placed = spark.createDataFrame(whole + fill_parts(cut, room), "a long, b long, start int, to int, loose int").select(F.struct("a", "b").alias("k"), "start", "to", "loose")
    for part in settled:
        placed = placed.unionByName(part.select("k", F.explode("held").alias("h"), "to").select("k", F.col("h.start").alias("start"), "to", F.lit(0).alias("loose")))
    joined = rows.join(placed, ["k", "start"], "left")
    first = stage(joined.select("doc_id", "size", "text_crc32", "k", "bucket", F.coalesce("to", "start").alias("shard"), F.coalesce("loose", F.lit(2)).alias("loose")), "shard-placed")
    drop_stage(spark, rows)
    # A shard's whole groups come first, then parts of groups, so surplus is taken from the unlinked, then from parts.
    first = first.withColumn("bucket", F.col("loose") * buckets + F.col("bucket") % buckets)
    order = ["doc_id", "k", "size", "text_crc32"]
    counted = _numbered(first, ["shard"], order, "at")
    counts = {r.shard: r["count"] for r in first.groupBy("shard").count().collect()}
    surplus, lack, s0, l0 = F.lit(None).cast("long"), [], 0, 0
    for s in range(shards):
        n = counts.get(s, 0)
        if n > want[s]:
            surplus = F.when((F.col("shard") == s) & (F.col("at") >= want[s]), F.col("at") - (want[s] - s0)).otherwise(surplus)
            s0 += n - want[s]
        elif n < want[s]:
            lack.append((s, n, l0))
            l0 += want[s] - n
    to, slot = F.col("shard"), F.col("at")
    for s, n, begin in lack:
        end = begin + want[s] - n
        here = F.col("__over").between(begin, end - 1)
        to, slot = F.when(here, F.lit(s)).otherwise(to), F.when(here, F.col("__over") - begin + n).otherwise(slot)
    return counted.withColumn("__over", surplus).select("doc_id", "size", "text_crc32", to.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of ``documents``, by the law ``rows``;
    see ``shard`` for null, empty, long and repeated texts and ids."""
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
