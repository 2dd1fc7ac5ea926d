"""Mixing sources to target weights with fixed-length blocks of words.

Each source's words, in a fixed document order, are packed into blocks of
``block_words``. A source's target gives it a number of slots in the mix. Every
output shard's source counts are drawn (multinomial, given the sources' totals),
and slots are numbered by the counts. Slot r of a source reads block ``perm(r)``:
one pseudorandom permutation of the block numbers for each pass over the source.
Slots and documents meet in an equality join on (source, block), which spreads
even a source that holds most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import word_count, written

WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
BLOCK_WORDS = 128
#: Documents in one packing bucket, and slots made in one task's step.
BUCKET_DOCS = 20_000
CHUNK_SLOTS = 4_096
SHARD_SLOTS = 8_192


def packed(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, source, size, ``at`` (bucket, rank): the document's
    place, and ``offset``: words of its source before it.

    Order within a source: a hash bucket of the id, then doc_id, then the text's
    hash. Buckets keep a source with most of the rows from meeting in one task;
    offsets add the buckets' totals, a table of one row per source and bucket.
    """
    text = F.col("text")
    sized = docs.select(*keep, F.col("doc_id").alias("order id"), F.col("source"), word_count(text).alias("size"), F.xxhash64(text).alias("text hash"))
    sized = written(sized, "mix-sizes")
    buckets = max(1, -(-sized.count() // BUCKET_DOCS))
    bucketed = sized.withColumn("bucket", F.pmod(F.xxhash64("order id", "text hash"), F.lit(buckets)))
    totals = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("source", "bucket").orderBy("order id", "text hash")
    ranked = bucketed.withColumns({
        "rank": F.row_number().over(order),
        "within": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    s, t = ranked.alias("s"), starts.alias("t")
    placed = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s.bucket") == F.col("t.bucket")))
    at = F.struct(F.col("s.bucket"), F.col("s.rank"))
    return placed.select(*[F.col(f"s.`{c}`") for c in keep], "s.source", "s.size", "s.text hash", at.alias("at"), (F.col("t.start") + F.col("s.within")).alias("offset"))


def targets(places: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """source, source_size, target: one row per source.

    Weights repeat over the sources in code-point order, null last. The targets
    share all words by weight; a target above ``max_passes`` times its source's
    size stops there and the excess is shared again by weight. That fixed point
    is a water level: sources fill up in the order of size over weight, so
    running sums in that order give the level directly.
    """
    sizes = places.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = ordered.withColumn("weight", w.cast("double")).withColumn("most", F.col("source_size") * float(max_passes))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "nth")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "full": F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(everything),
    })
    rows = rows.withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    first_open = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "nth", "level"))
    rows = rows.withColumn("water", F.min(first_open).over(everything)["level"])
    target = F.least("most", F.coalesce(F.col("water") * F.col("weight"), F.col("most")))
    return rows.select("source", "source_size", target.alias("target"))


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps; 96 are enough for any two longs."""
    begin = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda x, _: F.struct(F.when(x["b"] == 0, x["a"]).otherwise(x["b"]).alias("a"), F.when(x["b"] == 0, x["b"]).otherwise(x["a"] % x["b"]).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(96)), begin, step, lambda x: x["a"])


def permutations(goals: DataFrame, max_passes: int = MAX_PASSES, seed: int = 7) -> DataFrame:
    """``goals`` (source, blocks, ...) with ``perms``: for each pass over a source
    the multiplier and the shift of its permutation r -> (multiplier r + shift)
    mod blocks. Multipliers are drawn by hash from 2 to blocks - 2, the first of
    them that has no divisor in common with blocks; fewer than 5 blocks are only
    shifted."""
    n = F.greatest(F.col("blocks"), F.lit(1).cast("long"))

    def perm(epoch: Column) -> Column:
        drawn = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: 2 + F.pmod(F.xxhash64(F.lit(seed), "source", epoch, k), F.greatest(n - 3, F.lit(1).cast("long"))))
        first = F.get(F.filter(drawn, lambda m: (n >= 5) & (_gcd(n, m) == 1)), 0)
        shift = F.pmod(F.xxhash64(F.lit(seed + 3), "source", epoch), n)
        return F.struct(F.coalesce(first, F.lit(1).cast("long")).alias("multiplier"), shift.alias("shift"))

    return goals.withColumn("perms", F.array(*[perm(F.lit(e)) for e in range(max_passes)]))


def shard_counts(goals: DataFrame, seed: int = 7) -> DataFrame:
    """source, shard, slots: the draw of every output shard's source counts.

    Each of a source's slots falls on a shard by hash, so a shard's counts are a
    multinomial draw with the sources' shares of all slots, given that every
    source's total is its target. ``goals``: source, slots, shards. Slots are
    drawn in chunks, so the source with most of them is spread over tasks.
    """
    chunk = goals.where("slots > 0").withColumn("from", F.explode(F.expr(f"sequence(0L, slots - 1, {CHUNK_SLOTS}L)"))).repartition("source", "from")
    drawn = chunk.withColumn("slot", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK_SLOTS, F.col("slots")) - 1)))
    shard = F.pmod(F.xxhash64(F.lit(seed + 1), "source", "slot"), F.col("shards"))
    return drawn.select("source", shard.alias("shard")).groupBy("source", "shard").agg(F.count(F.lit(1)).alias("slots"))


def planned(goals: DataFrame, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES, seed: int = 7) -> DataFrame:
    """source, blocks, slots, shards, perms: what the mix takes of each source."""
    n = F.ceil(F.col("source_size") / block_words)
    wanted = F.least(F.round(F.col("target") / block_words), n * max_passes).cast("long")
    goals = goals.select("source", n.cast("long").alias("blocks"), wanted.alias("slots"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shards = F.greatest(F.ceil(F.sum("slots").over(everything) / SHARD_SLOTS), F.lit(1))
    return written(permutations(goals.withColumn("shards", shards), max_passes, seed), "mix-plan")


def slots(goals: DataFrame, block_words: int = BLOCK_WORDS, max_passes: int = MAX_PASSES, seed: int = 7) -> DataFrame:
    """The mix: source, slot (number within the source), shard, place (order in
    the shard) and block (of the source) for every output slot.

    Slots are numbered within a source by shard, by the drawn counts; the r-th
    slot of a pass reads the block that the pass's permutation gives for r. All
    of it depends only on seed, source and slot, so reruns agree.
    """
    plan = planned(goals, block_words, max_passes, seed)
    counts = written(shard_counts(plan, seed), "mix-counts")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("offset", F.coalesce(F.sum("slots").over(before), F.lit(0)))
    p = plan.select(F.col("source").alias("plan source"), "blocks", "perms")
    rows = counts.join(p, F.col("source").eqNullSafe(F.col("plan source"))).repartition("source", "shard")
    made = rows.withColumn("slot", F.explode(F.sequence(F.col("offset"), F.col("offset") + F.col("slots") - 1)))
    wide = "decimal(38,0)"
    perm = F.get("perms", F.floor(F.col("slot") / F.col("blocks")).cast("int"))
    r = (F.col("slot") % F.col("blocks")).cast(wide)
    block = F.pmod(r * perm["multiplier"].cast(wide) + perm["shift"].cast(wide), F.col("blocks").cast(wide)).cast("long")
    return made.select("source", "slot", "shard", F.xxhash64(F.lit(seed + 2), "source", "slot").alias("place"), block.alias("block"))


def pieces(places: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``places`` cut at block ends: block, ``first`` and ``words`` (within the
    document). Documents without words have one row with a null block."""
    first, last = F.floor(F.col("offset") / block_words), F.floor((F.col("offset") + F.col("size") - 1) / block_words)
    rows = places.withColumn("block", F.explode_outer(F.when(F.col("size") > 0, F.sequence(first, last))))
    begin = F.greatest(F.col("offset"), F.col("block") * block_words)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block_words)
    return rows.withColumns({"first": begin - F.col("offset"), "words": end - begin})


def _taken_blocks(goals: DataFrame, block_words: int, max_passes: int, seed: int) -> DataFrame:
    """Each block that the mix reads, and where: the (shard, place) of its slots."""
    mix = slots(goals, block_words, max_passes, seed)
    at = F.array_sort(F.collect_list(F.struct("shard", "place")))  # max_passes at most
    return mix.groupBy(F.col("source").alias("mix source"), F.col("block").alias("mix block")).agg(at.alias("slots"))


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_shard: one row per row of
    ``docs``.

    ``taken`` are the words of the document that the mix reads, repeats counted;
    ``first_shard`` is the first output shard that has some of them, null if none
    has. Null texts have size 0 and nothing taken; a null source is a source of
    its own; repeated rows are separate documents; a very long text is spread
    over its blocks; other columns are ignored; an empty table gives an empty
    result. A source's taken words differ from its target by less than two blocks.
    """
    places = written(packed(docs), "mix-places")
    goals = written(targets(places, weights, max_passes), "mix-targets")
    blocks = _taken_blocks(goals, block_words, max_passes, seed)
    cut = pieces(places, block_words)
    # the optimiser sizes the slots by the few rows they are made from, so it is told to shuffle
    joined = cut.join(blocks.hint("merge"), F.col("source").eqNullSafe(F.col("mix source")) & (F.col("block") == F.col("mix block")), "left")
    taken = joined.groupBy("source", "at", "doc_id", "size").agg(
        F.coalesce(F.sum(F.col("words") * F.size("slots")), F.lit(0)).cast("long").alias("taken"), F.min(F.get("slots", 0)["shard"]).alias("first_shard")
    )
    g = goals.withColumnRenamed("source", "goal source")
    out = taken.join(g, F.col("source").eqNullSafe(F.col("goal source")))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "taken", "first_shard")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, seed: int = 7) -> DataFrame:
    """The mix as documents: the columns of ``docs``, one row for each time that
    words of a document are taken.

    The c-th row of a document holds its words in blocks taken c times or more,
    in order, with the white space before them; a document taken whole keeps its
    text as it is. Rows are dealt to the output shards, each sorted by the place
    of its first slot. ``n_chars``, where there is one, follows the text. Documents
    that the mix does not take, and documents without words, have no row; other
    rows are treated as by ``mixed``.
    """
    names = docs.columns
    places = written(packed(docs), "mix-places")
    goals = written(targets(places, weights, max_passes), "mix-targets")
    blocks = _taken_blocks(goals, block_words, max_passes, seed)
    cut = pieces(places, block_words)
    joined = cut.join(blocks.hint("merge"), F.col("source").eqNullSafe(F.col("mix source")) & (F.col("block") == F.col("mix block")))
    parts = joined.groupBy("source", "at", "doc_id", "text hash", "size").agg(F.array_sort(F.collect_list(F.struct("first", "words", "slots"))).alias("parts"))
    twin = Window.partitionBy("doc_id", "source", "text hash").orderBy("at")
    parts = parts.withColumn("twin", F.row_number().over(twin))
    parts = written(parts.select(F.col("source").alias("p source"), F.col("doc_id").alias("p id"), F.col("text hash").alias("p hash"), "twin", "size", "parts"), "mix-parts")
    twins = written(places.groupBy("doc_id", "source", "text hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "mix-twins")
    row = docs.select(F.struct(*names).alias("row"), F.xxhash64("text").alias("hash"))
    if twins.isEmpty():
        row = row.withColumn("nth", F.lit(1))
    else:
        own = Window.partitionBy("row.doc_id", "row.source", "hash").orderBy(F.xxhash64("row"))
        row = row.withColumn("nth", F.row_number().over(own))
    same = F.col("row.doc_id").eqNullSafe(F.col("p id")) & F.col("row.source").eqNullSafe(F.col("p source")) & (F.col("hash") == F.col("p hash")) & (F.col("nth") == F.col("twin"))
    taken = row.join(parts.hint("shuffle_hash"), same).select("row", "size", "parts", F.explode(F.sequence(F.lit(1), F.array_max(F.transform("parts", lambda x: F.size(x["slots"]))))).alias("copy"))
    taken = taken.withColumn("own", F.filter("parts", lambda x: F.size(x["slots"]) >= F.col("copy")))
    taken = taken.withColumn("slot", F.array_min(F.transform("own", lambda x: F.get(x["slots"], F.col("copy") - 1))))
    taken = taken.repartition("slot.shard").sortWithinPartitions("slot.shard", "slot.place")
    whole = F.aggregate("own", F.lit(0).cast("long"), lambda n, x: n + x["words"]) == F.col("size")
    each = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"), F.lit(0))
    taken = taken.withColumn("each", F.when(~whole, each))
    some = F.array_join(F.transform("own", lambda x: F.array_join(F.slice("each", (x["first"] + 1).cast("int"), x["words"].cast("int")), "")), "")
    taken = taken.withColumn("mixed text", F.when(F.col("each").isNull(), F.col("row.text")).otherwise(some))
    new = {"text": F.col("mixed text"), "n_chars": F.length("mixed text").cast("long")}
    return taken.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col(f"row.`{c}`") for c in names])
