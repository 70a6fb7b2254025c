"""Mixing sources to target weights with a low-discrepancy schedule.

Everything is DataFrame work: no Python runs on the executors.

1. Each document gets its size in words; sources are ranked by code point (null
   last) and weigh ``WEIGHTS`` in turn.  Their targets share ``BUDGET`` of all
   words by weight, and none exceeds ``REPEATS`` times its source (``targets``).
2. Each source's documents, in the order of a hash, form a stream of words that
   is cut into blocks of equal length (``pieces``).  The stream may be read more
   than once, so a source has ``ceil(target / block)`` blocks.
3. Slot ``i`` of the mix lies at the golden-ratio point ``frac(i * phi)``, which
   the cumulative weights map to a source; slots are ranked per source and rank
   ``k`` takes the source's block ``k`` (``schedule``).  Blocks of a source too
   small to be met by the points follow at the end.

Positions in a source and ranks of slots are running sums.  A window over a
source would put a source with a third of all rows into one task, so each sum
runs in two steps: within one of ``BUCKETS`` buckets, and over bucket totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrace.llm.common import WORD, materialise, plain, restored, salted_lookup, shuffle_partitions, table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEATS = 2
#: Words in a block.
BLOCK = 256
#: Buckets of the two-step running sums.
BUCKETS = 2048
#: 2**31 divided by the golden ratio, odd: i * GOLDEN mod 2**31 visits every point once in 2**31 slots.
GOLDEN, CIRCLE = 1327217885, 1 << 31
#: Cells in which points and source intervals meet, at least.
CELLS = 4096


def sizes(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``row, doc_id, source, origin, size``: the row's number (column ``row``, else as it is read), its source as a key that is never null, and the words of the whole text, 0 for a null text."""
    number = F.col(row) if row else F.monotonically_increasing_id()
    picked = docs.select(number.alias("row"), *[F.col(f"`{n}`") for n in ("doc_id", "source", "text")])
    return picked.select("row", "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("origin"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``source_no``, from 1 by code point, null last.

    Sources are dealt out by range and numbered there; what meets in one task is a
    count for each partition.
    """
    order = F.col("source").asc_nulls_last()
    at = materialise(sources.repartitionByRange(shuffle_partitions(sources.sparkSession), order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id()), "mix-sources")
    at = at.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    heads = at.groupBy("_part").count().select(F.col("_part").alias("_p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return at.join(F.broadcast(heads), F.col("_part") == F.col("_p")).withColumn("source_no", F.col("_before") + F.col("_at") + 1).drop("_at", "_part", "_p", "_before")


def targets(sized: DataFrame) -> DataFrame:
    """``source_no, source, origin, rows, source_size, target, words_wanted`` for each source.

    A source whose share exceeds ``REPEATS`` times its size stops there and the
    rest is shared anew: the level, a weight's worth of words, rises until no
    further source stops, which takes few rounds of sums over the sources.
    """
    by = sized.groupBy("origin").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("source_no") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = numbered(by).withColumns({"weight": weight.cast("double"), "cap": REPEATS * F.col("source_size").cast("double")})
    ranked = materialise(ranked, "mix-ranked")
    budget = BUDGET * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, higher = -1.0, 0.0
    while higher > level:
        level = higher
        stops = F.col("cap") <= level * F.col("weight")
        spent, open_ = ranked.agg(F.sum(F.when(stops, F.col("cap"))), F.sum(F.when(~stops, F.col("weight")))).first()
        higher = (budget - (spent or 0)) / open_ if open_ else level
    target = F.least(F.col("cap"), level * F.col("weight"))
    return ranked.select("source_no", "source", "origin", "rows", "source_size", target.alias("target"), F.floor(target).cast("long").alias("words_wanted"))


def _running(df: DataFrame, by: str, bucket: Column, order: list, value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before, per ``by``: buckets first, then the rows of a bucket."""
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy(by, "_bucket").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(F.col(by).alias("_by"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = W.partitionBy(by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        df.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
        .join(bases, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_bucket") == F.col("_b")))
        .withColumn(name, F.col("_base") + F.col("_within"))
        .drop("_by", "_b", "_bucket", "_base", "_within")
    )


def pieces(sized: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """``source_no, block, row, doc_id, start, words``: what of which document each block of a source's stream holds.

    ``start`` is the piece's first word in its document.  A document whose stream
    is read twice has pieces for each reading.
    """
    key = F.xxhash64(F.coalesce("doc_id", "row"), "size", F.lit(seed))
    placed = _running(sized.where("size > 0").drop("source", "target"), "source_no", F.pmod(key, F.lit(BUCKETS)).cast("int"), [key, F.col("doc_id"), F.col("size"), F.col("row")], "size", "at")
    read = placed.withColumn("reading", F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))).withColumn("at", F.col("at") + F.col("reading") * F.col("source_size"))
    read = read.withColumn("end", F.least(F.col("at") + F.col("size"), F.col("words_wanted"))).where("end > at")
    cut = read.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(end - 1) div {block}"))))
    first, last = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("end"), (F.col("block") + 1) * block)
    return cut.select("source_no", "block", "row", "doc_id", (first - F.col("at")).alias("start"), (last - first).alias("words"))


def schedule(goals: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot, source_no, block``: every block that a source owes, at one slot of the mix.

    Points and the sources' spans meet in cells, of which there are at least as many
    as sources: a cell holds the few spans that touch it.
    """
    spark = goals.sparkSession
    owed = F.ceil(F.col("words_wanted") / block)
    slots, sources, last, words = goals.agg(F.sum(owed), F.count("*"), F.max(F.when(F.col("words_wanted") > 0, F.col("source_no"))), F.sum("words_wanted")).first()
    slots = slots or 0
    count = max(CELLS, 1 << sources.bit_length())
    point = F.pmod((F.col("id") % CIRCLE) * GOLDEN, F.lit(CIRCLE))
    points = spark.range(slots).select(F.col("id").alias("slot"), (point / CIRCLE).alias("u")).withColumn("cell", F.floor(F.col("u") * count))
    wanted = goals.where("words_wanted > 0").select("source_no", "words_wanted", owed.alias("owed"), F.lit(0).alias("all"))
    summed = _running(wanted, "all", F.expr(f"cast(source_no div {-(-(sources or 1) // BUCKETS)} as int)"), [F.col("source_no")], "words_wanted", "before")
    hi = F.when(F.col("source_no") == F.lit(last), 1.5).otherwise((F.col("before") + F.col("words_wanted")) / F.lit(float(words or 1)))
    spans = summed.select("source_no", "owed", (F.col("before") / F.lit(float(words or 1))).alias("lo"), hi.alias("hi"))
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("lo") * count), F.least(F.floor(F.col("hi") * count), F.lit(count - 1)))))
    met = points.join(cells, (F.col("cell") == F.col("_cell")) & (F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "source_no", "owed", F.lit(1).alias("one"))
    ranked = _running(met, "source_no", F.expr(f"cast(slot div {max(1, -(-slots // BUCKETS))} as int)"), [F.col("slot")], "one", "block")
    hits = met.groupBy(F.col("source_no").alias("_n")).agg(F.count("*").alias("hits"))
    rest = (
        wanted.join(hits, F.col("_n") == F.col("source_no"), "left").withColumn("hits", F.coalesce("hits", F.lit(0))).where("owed > hits")
        .select((F.lit(slots) + F.col("source_no")).alias("slot"), "source_no", F.explode(F.sequence(F.col("hits"), F.col("owed") - 1)).alias("block"))
    )
    return ranked.where("block < owed").select("slot", "source_no", "block").unionByName(rest)


def prepare(docs: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sized rows with what their source is to give, and the sources with their targets.

    A row finds its source by a join in which common sources are salted.
    """
    sized = materialise(sizes(docs, row), "mix-sizes")
    goals = materialise(targets(sized), "mix-targets")
    return materialise(salted_lookup(sized, goals.drop("source"), "origin", "rows").drop("origin"), "mix-rows"), goals


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself: ``slot, source_no, block, row, doc_id, start, words``, one row for each piece of a document."""
    sized, goals = prepare(docs)
    return schedule(goals).join(pieces(sized, seed), ["source_no", "block"])


def taken(docs: DataFrame, seed: int = 0, row: str | None = None) -> DataFrame:
    """What the mix takes of each document.

    Columns: row (the column named so, else a number), doc_id, source, source_no, size, source_size, target, taken.  Null texts and
    texts without words have size 0 and nothing taken; a very long text is cut into
    blocks like others; a null source is a source of its own, the last; of repeated
    rows each is a document; other columns are ignored; an empty table gives an empty
    one.  Reruns agree, as every order is that of a hash of the document's id and size; rows of one
    source that share both are alike to the mix, and rows without an id go by their numbers.
    """
    sized, goals = prepare(docs, row)
    got = schedule(goals).join(pieces(sized, seed), ["source_no", "block"]).groupBy("row").agg(F.sum("words").alias("taken"))
    return sized.join(got, "row", "left").select("row", "doc_id", "source", "source_no", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: once or twice where it takes any of their words, else not at all.

    Texts without words and null texts go; columns besides ``doc_id``, ``text`` and
    ``source`` come through, whatever their names; an empty table gives an empty one.
    """
    rows, (doc_id, source, text) = plain(docs, "doc_id", "source", "text")
    held = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "mix-documents")
    named = held.select("row", F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    times = taken(named, row="row").where("taken > 0").select("row", F.ceil(F.col("taken") / F.col("size")).cast("int").alias("times"))
    return restored(held.join(times, "row").withColumn("reading", F.explode(F.array_repeat(F.lit(True), F.col("times")))), docs)
