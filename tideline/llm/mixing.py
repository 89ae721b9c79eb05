"""Mixing sources to target weights, in DataFrame operations only.

Every source is a stream of words: its documents in a fixed random order (by digest of id and size), cut into blocks of
``block_words``. A source's target is a quota of blocks, from the stream's start and round again for the repeats; the last
block is cut where the target is reached. A splitting tree deals the quotas to output shards: a node with a number of
blocks of each source gives its left half a multivariate hypergeometric draw, drawn source after source by inversion of
the exact weights around the mean, and the rest to the right. A leaf takes the next blocks of each source in shard order,
so shards are disjoint, and orders its pieces by digest.

All draws come from digests of the seed and the node, so reruns and retried tasks agree. What the driver sees is the
number of blocks. Sources with no words get nothing. Documents without words are in no block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, REPEATS = 1.5, 2
BLOCK_WORDS, SHARD_BLOCKS, BUCKET_ROWS = 65_536, 128, 50_000
SPREAD = 12


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """``source, rank, source_size, target`` of ``sources(source, source_size)``.

    Weights go round the sources by code point, null last, and split ``share`` of all words. A target stops at
    ``repeats`` times its source; the excess goes to the others by weight until none is above. That is the level at
    which the sources that reach their ceiling, in order of ceiling to weight, leave the rest below theirs.
    """
    ranked = Window.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(ranked) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    listed = sources.select("source", "source_size", rank.cast("long").alias("rank"), weight.alias("weight"))
    listed = listed.withColumn("ceiling", F.col("source_size") * F.lit(float(repeats)))
    by_level = Window.orderBy(F.col("ceiling") / F.col("weight"), "rank")
    through, after = by_level.rowsBetween(Window.unboundedPreceding, 0), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(everything) * share - (F.sum("ceiling").over(through) - F.col("ceiling"))
    levelled = listed.withColumn("level", left / F.sum("weight").over(after))
    reached = F.col("ceiling") / F.col("weight") <= F.col("level")
    levelled = levelled.withColumn("open_level", F.max(F.when(~reached, F.col("level"))).over(everything))
    target = F.when(reached, F.col("ceiling")).otherwise(F.least("ceiling", F.col("open_level") * F.col("weight")))
    return levelled.select("source", "rank", "source_size", target.alias("target"))


def lined_up(docs: DataFrame, size: str, seed: int = 0) -> DataFrame:
    """``doc_id, source, size, start``: where each document begins in its source's stream of words.

    ``docs`` has ``doc_id, source`` and the sizes. Streams are summed over ranges of the digest, of ``BUCKET_ROWS``
    documents each, and then within each range, so a source of any size is spread over many tasks.
    """
    total = docs.agg(F.count(F.lit(1))).first()[0]
    buckets = max(1, -(-total // BUCKET_ROWS))
    digest = F.md5(F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col(size).cast("string"), F.lit(str(seed))))
    spot = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    placed = docs.select("doc_id", "source", F.col(size).alias("size"), digest.alias("digest"))
    placed = placed.withColumn("bucket", F.shiftright(spot * buckets, 32))
    sums = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    own = Window.partitionBy("source", "bucket").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    within = placed.withColumn("within", F.sum("size").over(own) - F.col("size"))
    joined = within.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("doc_id", "source", "size", (F.col("before") + F.col("within")).alias("start"))


def hypergeometric(u: Column, marked: Column, others: Column, draws: Column) -> Column:
    """How many of ``draws`` blocks out of ``marked + others`` are marked, by inversion of ``u``.

    The weights follow from one another by their exact ratio, from ``SPREAD`` deviations below the mean to as many
    above; what lies beyond weighs less than a double can tell.
    """
    m, o, n = (x.cast("double") for x in (marked, others, draws))
    all_ = m + o
    mean = n * m / all_
    wide = SPREAD * F.sqrt(F.greatest(F.lit(0.0), mean * (o / all_) * (all_ - n) / F.greatest(F.lit(1.0), all_ - 1))) + SPREAD
    low = F.greatest(F.lit(0.0), n - o, F.floor(mean - wide)).cast("long")
    high = F.least(m, n, F.ceil(mean + wide)).cast("long")

    def next_weight(k: Column, weight: Column) -> Column:
        """Weight of ``k + 1`` from that of ``k``."""
        return weight * (m - k) * (n - k) / ((k + 1) * (o - n + k + 1))

    steps = F.sequence(low, F.greatest(low, high))
    start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        steps, start,
        lambda s, k: F.struct(next_weight(k, s["weight"]).alias("weight"), (s["sum"] + s["weight"]).alias("sum")),
        lambda s: s["sum"],
    )
    first = F.struct(F.lit(1.0).alias("weight"), (u * total).alias("left"), low.alias("at"), F.lit(False).alias("done"))

    def walk(s: Column, k: Column) -> Column:
        here = s["left"] < s["weight"]
        return F.when(s["done"], s).otherwise(
            F.struct(next_weight(k, s["weight"]).alias("weight"), (s["left"] - s["weight"]).alias("left"), k.alias("at"), here.alias("done"))
        )

    drawn = F.aggregate(steps, first, walk, lambda s: s["at"])
    return F.when(all_ <= 0, F.lit(0).cast("long")).otherwise(drawn)


def split_quotas(quotas: DataFrame, blocks: int, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """``shard, rank, quota`` of ``quotas(rank, quota)``: every shard but the last few has ``shard_blocks`` blocks.

    A node is its first shard, its number of shards and the quotas it has left; quotas of 0 are dropped on the way, so
    a leaf holds at most as many sources as blocks.
    """
    shards = max(1, -(-blocks // shard_blocks))
    has = F.sort_array(F.collect_list(F.struct("rank", "quota")))
    nodes = quotas.where("quota > 0").agg(has.alias("has")).select(
        F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("shards"), "has"
    )
    level = 1
    while level < shards:
        inner = F.floor((F.col("shards") + 1) / 2).cast("long")
        size = F.aggregate("has", F.lit(0).cast("long"), lambda s, x: s + x["quota"])
        taken = F.least(size, F.round(size * inner / F.col("shards")).cast("long"))

        def draw(state: Column, x: Column) -> Column:
            text = F.concat_ws("-", F.lit(str(seed)), F.col("shard"), F.col("shards"), x["rank"])
            u = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)
            got = hypergeometric(u, x["quota"], state["rest"] - x["quota"], state["draws"])
            return F.struct(
                (state["rest"] - x["quota"]).alias("rest"),
                (state["draws"] - got).alias("draws"),
                F.concat(state["got"], F.array(F.struct(x["rank"].alias("rank"), got.alias("quota")))).alias("got"),
            )

        none = F.array().cast("array<struct<rank:bigint,quota:bigint>>")
        zero = F.struct(F.col("size").alias("rest"), F.col("taken").alias("draws"), none.alias("got"))
        halves = nodes.withColumn("size", size).withColumn("taken", taken)
        halves = halves.withColumn("left", F.aggregate("has", zero, draw, lambda s: s["got"]))
        right = F.zip_with("has", "left", lambda x, y: F.struct(x["rank"].alias("rank"), (x["quota"] - y["quota"]).alias("quota")))

        def kept(of: Column) -> Column:
            return F.filter(of, lambda x: x["quota"] > 0)

        both = F.array(
            F.struct(F.col("shard"), inner.alias("shards"), kept(F.col("left")).alias("has")),
            F.struct((F.col("shard") + inner).alias("shard"), (F.col("shards") - inner).alias("shards"), kept(right).alias("has")),
        )
        whole = F.array(F.struct("shard", "shards", "has"))
        nodes = halves.select(F.inline(F.when(F.col("shards") > 1, both).otherwise(whole)))
        level *= 2
        nodes = materialize(nodes.repartition("shard"), "nodes") if level >= 16 else nodes
    return nodes.select("shard", F.inline("has"))


def plan_mix(lined: DataFrame, targets: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0) -> DataFrame:
    """``shard, rank, epoch, block, words``: the blocks each shard takes, and how many words of each."""
    want = F.round("target").cast("long")
    sized = targets.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    sized = sized.withColumn("want", want).withColumn("rounds", F.floor(F.col("want") / F.col("source_size")).cast("long"))
    sized = sized.withColumn("tail", F.col("want") - F.col("rounds") * F.col("source_size"))
    sized = sized.withColumn("quota", F.col("rounds") * F.col("blocks") + F.ceil(F.col("tail") / block_words).cast("long"))
    total = sized.agg(F.sum("quota")).first()[0] or 0
    dealt = split_quotas(sized.select("rank", "quota"), total, shard_blocks, seed)
    first = F.sum("quota").over(Window.partitionBy("rank").orderBy("shard")) - F.col("quota")
    dealt = dealt.withColumn("first", first).withColumn("place", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("quota") - 1)))
    placed = dealt.select("shard", "rank", "place").join(sized.select("rank", "source_size", "blocks", "rounds", "tail"), "rank")
    epoch, block = F.floor(F.col("place") / F.col("blocks")).cast("long"), F.col("place") % F.col("blocks")
    placed = placed.withColumn("epoch", epoch).withColumn("block", block)
    there = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    cut = F.greatest(F.lit(0).cast("long"), F.least(there, F.col("tail") - F.col("block") * block_words))
    words = F.when(F.col("epoch") < F.col("rounds"), there).otherwise(cut)
    return placed.select("shard", "rank", "epoch", "block", words.alias("words"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = 0,
        weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs(doc_id, source, size)`` as (sized documents, pieces).

    Sized documents have ``doc_id, source, size, source_size, target, rank, start``, one row per row. A piece is
    ``shard, position, rank, epoch, start, from_word, n_words``: words of the document at ``start`` of its source, in the
    place it has in the shard. Repeated rows and null ids are documents of their own; null is a source of its own.
    """
    lined = materialize(lined_up(docs, "size", seed), "lined")
    sizes = lined.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialize(source_targets(sizes, weights, share, repeats), "targets")
    named = targets.select(F.col("source").alias("s"), "rank", "source_size", "target")
    sized = lined.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = plan_mix(lined, targets, block_words, shard_blocks, seed)
    spans = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    parts = sized.where("size > 0").select("rank", "start", "size", F.explode(spans).alias("block"))
    met = parts.join(plan, ["rank", "block"])
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("words"))
    met = met.withColumn("from_word", low - F.col("start")).withColumn("n_words", high - low).where("n_words > 0")
    return sized, met.select("shard", "rank", "epoch", "start", "from_word", "n_words")


def in_order(pieces: DataFrame, seed: int = 0) -> DataFrame:
    """Pieces with their ``position`` in their shard, which holds a bounded number of words."""
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), "shard", "rank", "epoch", "start", "from_word"))
    own = Window.partitionBy("shard").orderBy(digest, "rank", "epoch", "start", "from_word")
    return pieces.withColumn("position", F.row_number().over(own))


def taken_words(sized: DataFrame, pieces: DataFrame) -> DataFrame:
    """Sized documents with ``taken``: the words that the mix takes of each, repeats counted."""
    sums = pieces.groupBy("rank", "start").agg(F.sum("n_words").alias("taken"))
    some = sized.where("size > 0").join(sums, ["rank", "start"], "left")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    none = sized.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken"))
    return some.select(*columns, F.coalesce("taken", F.lit(0).cast("long")).alias("taken")).unionByName(none)


def mixed_documents(docs: DataFrame, text: str = "text", seed: int = 0) -> DataFrame:
    """Whole rows of ``docs`` as often as the mix takes them, to the nearest time: never, once or twice.

    ``docs`` has ``doc_id, source`` and the text. Rows are told apart by id, source and size; where these repeat, the
    copies share what the mix takes of them, dealt by turns.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = docs.select(row, "doc_id", "source", word_count(F.col(f"`{text}`")).alias("size"))
    sized, pieces = mix(materialize(measured.select("doc_id", "source", "size"), "sizes"), seed=seed)
    times = taken_words(sized, pieces).where("size > 0").withColumn("times", F.round(F.col("taken") / F.col("size")).cast("long"))
    counts = times.groupBy("doc_id", "source", "size").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("rows"))
    counts = counts.where("times > 0").select(
        F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("n"), "times", "rows"
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("n"))
    joined = measured.join(counts, same)
    turns = Window.partitionBy("d", "s", "n").orderBy(F.xxhash64(f"row.`{text}`"))
    many = joined.where("rows > 1").withColumn("turn", F.row_number().over(turns))
    extra = F.when(F.col("turn") <= F.col("times") % F.col("rows"), 1).otherwise(0)
    many = many.withColumn("times", F.floor(F.col("times") / F.col("rows")).cast("long") + extra).where("times > 0")
    dealt = joined.where("rows = 1").select("row", "times").unionByName(many.select("row", "times"))
    repeated = dealt.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return repeated.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
