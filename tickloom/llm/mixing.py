"""Mixing sources to target weights.

The words of a source, document after document, are packed into blocks of fixed length. The mix is a row of slots, each for
one block, cut into output shards. In each shard a source gets the whole part of its expected number of slots, and the slots
left over are drawn from a multinomial over the fractional parts. A source's slots are numbered through the shards; slot i
takes the block at place i of a pseudorandom permutation of the source's blocks (a new one for each pass over them). Blocks
then meet their documents by a join on the block's index.

Everything is DataFrame functions, and deterministic. No window holds a whole source: positions come from sums per chunk of
documents and positions inside a chunk, with about as many chunks as documents in one. Tables with a row per source
are small; the list of sources (thousands at most) is one row of the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tickloom.llm.common import SPACES, WORD, stored

#: Words in a block.
BLOCK = 64
#: Output shards: at most so many, of at least so many slots.
SHARDS, SHARD_SLOTS = 4096, 4096
#: The mix holds this share of all words; a source is taken at most CAP times.
SHARE, CAP = 1.5, 2.0
#: Fixed values of the query contract: weights of the sources in order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Half rounds of the permutation, and steps by which a place beyond the blocks is led back.
HALF_ROUNDS, WALK = 6, 32


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+; 0 for null. Every word becomes one letter, then what is left of the white space goes."""
    marks = F.regexp_replace(text, WORD, "x")
    return F.coalesce(F.length(F.translate(marks, SPACES, "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, weight, and target: `share` of all words dealt by weight, none above `cap` times its source.

    Resharing the excess until no source is above its cap ends at target = min(cap x size, level x weight). The sources in
    order of cap x size / weight reach their caps in that order, so the level follows from running sums over them: a window
    over one row per source.
    """
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "rank")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    w = sources.withColumn("limit", F.col("source_size") * F.lit(cap))
    w = w.withColumns({
        "total": F.sum("source_size").over(every) * F.lit(share),
        "held": F.coalesce(F.sum("limit").over(upto), F.lit(0.0)),
        "open": F.sum("weight").over(onward),
    }).withColumn("level_here", (F.col("total") - F.col("held")) / F.col("open"))
    # the level is the first of these that its own source's cap does not undercut
    w = w.withColumn("level", F.max(F.when(F.col("level_here") * F.col("weight") <= F.col("limit"), F.col("level_here"))).over(every))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight")))
    return w.withColumn("target", target).drop("limit", "total", "held", "open", "level_here", "level")


def positioned(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds `begin`: the words of the document's source before it, in an order by a hash of key and size."""
    n = max(1, docs.count())
    chunks = max(1, math.isqrt(n))
    at = docs.withColumn("chunk", F.pmod(F.xxhash64(key, "size"), F.lit(chunks)))
    inside = Window.partitionBy("source", "chunk").orderBy(key, "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = at.groupBy("source", "chunk").agg(F.sum("size").alias("s")).select("source", "chunk", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("chunk_begin"))
    at = at.withColumn("here", F.sum("size").over(inside) - F.col("size"))
    same = at["source"].eqNullSafe(starts["source"]) & (at["chunk"] == starts["chunk"])
    return at.join(starts, same).select(*[at[c] for c in docs.columns], (F.col("chunk_begin") + F.col("here")).alias("begin"))


def permuted(source: Column, turn: Column, place: Column, n: Column) -> Column:
    """Place of a pseudorandom permutation of 0 .. n-1, keyed by the source and the pass: a Feistel network on pairs.

    Places are pairs of numbers below a and b, where a * b is n or little more: each half round adds a hash of one to the
    other. A place that comes out at n or beyond goes through again. At most a - 1 places lie there, so WALK steps are always
    enough up to some 1,000 blocks; beyond, each step fails with a chance under 1 in 32.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")
    key = F.xxhash64(source, turn)
    rounds = F.array(*[F.lit(k) for k in range(HALF_ROUNDS)])

    def half(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(key, k, s["r"]), a), a)
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(key, k, s["l"]), b), b)
        return F.struct(F.when(k % 2 == 0, left).otherwise(s["l"]).alias("l"), F.when(k % 2 == 1, right).otherwise(s["r"]).alias("r"))

    def step(x: Column) -> Column:
        low = F.pmod(x, a)
        pair = F.struct(low.alias("l"), ((x - low) / a).cast("long").alias("r"))
        return F.aggregate(rounds, pair, half, lambda s: s["l"] + s["r"] * a)

    walk = F.array(*[F.lit(k) for k in range(WALK)])
    onward = lambda y: F.when(y < n, y).otherwise(F.aggregate(walk, y, lambda x, _: F.when(x < n, x).otherwise(step(x))))
    return F.get(F.transform(F.array(step(place.cast("long"))), onward), F.lit(0))


def takes(sources: DataFrame, block: int = BLOCK, cap: float = CAP) -> DataFrame:
    """rank, block, times: how often the mix takes each block it takes.

    The slots come from one row by explode, so the optimizer takes this table for a small one: join it with a hint to merge.
    """
    s = sources.where(F.col("source_size") > 0).withColumn("blocks", F.ceil(F.col("source_size") / block))
    # a source's last block is shorter: the slots that its target needs at the mean length of its blocks
    s = s.withColumn("need", F.col("target") * F.col("blocks") / F.col("source_size"))
    plan = s.agg(F.sum("need").alias("need"), F.array_sort(F.collect_list(F.struct("rank", "need", "blocks"))).alias("sources"))  # one row
    slots = F.ceil(F.col("need"))
    per_shard = F.greatest(F.lit(SHARD_SLOTS), F.ceil(slots / SHARDS))
    shards = plan.where("need > 0").withColumns({"slots": slots, "per_shard": per_shard}).select(
        "sources", "need", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(slots / per_shard) - 1)).alias("shard"), "slots", "per_shard"
    ).withColumn("here", F.least(F.col("per_shard"), F.col("slots") - F.col("shard") * F.col("per_shard")))
    # expected slots of each source in the shard; fractional parts summed up for the draw
    expected = F.transform("sources", lambda x: x["need"] / F.col("need") * F.col("here"))
    shards = shards.withColumn("whole", F.transform(expected, lambda e: F.floor(e + 1e-9))).withColumn("part", F.transform(expected, lambda e: F.greatest(F.lit(0.0), e - F.floor(e + 1e-9))))
    left = F.col("here") - F.aggregate("whole", F.lit(0).cast("long"), lambda a, x: a + x)
    shards = shards.withColumn("left", F.greatest(F.lit(0).cast("long"), left)).withColumn("mass", F.aggregate("part", F.lit(0.0), lambda a, x: a + x))
    running = F.aggregate("part", F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0.0)))))
    shards = shards.withColumn("running", running)
    draws = F.transform(
        F.when(F.col("left") > 0, F.sequence(F.lit(1).cast("long"), F.col("left"))).otherwise(F.array().cast("array<bigint>")),
        lambda j: F.least(F.size("sources") - 1, F.size(F.filter("running", lambda c: c <= F.pmod(F.xxhash64(F.col("shard"), j), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("mass")))),
    )
    shards = shards.withColumn("draws", draws)
    counts = shards.select("shard", F.posexplode(F.arrays_zip("sources", "whole")).alias("k", "x"), "draws").select(
        "shard", F.col("x.sources.rank").alias("rank"), F.col("x.sources.blocks").alias("blocks"),
        (F.col("x.whole") + F.size(F.filter("draws", lambda d: d == F.col("k")))).alias("n"),
    )
    before = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("n", F.least(F.col("n"), F.floor(F.col("blocks") * F.lit(cap)) - F.col("start")))
    # the few rows of counts are dealt out before they become slots, so that no source's slots are made in one task
    dealt = counts.where("n > 0").repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rank", "shard")
    slot = dealt.select("rank", "blocks", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("slot"))
    turn, place = F.floor(F.col("slot") / F.col("blocks")), F.pmod("slot", "blocks")
    return slot.select("rank", permuted(F.col("rank"), turn, place, F.col("blocks")).alias("block")).groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))


def ranked(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, rank (by code point, null last) and weight of each source."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("rank", F.row_number().over(order) - 1)
    return w.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")))


def prepared(docs: DataFrame, key: str, carry: tuple[str, ...], what: str) -> tuple[DataFrame, DataFrame]:
    """Documents with size, begin, rank, source_size, target; the table of sources with targets."""
    sized = docs.select(F.col(key).alias("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"), *carry)
    at = stored(positioned(sized), what)
    sources = stored(targets(ranked(at)), what + "-sources")
    return at.join(sources, at["source"].eqNullSafe(sources["source"])).drop(sources["source"]), sources


def mix(docs: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes of the document, repeats counted).

    Nulls: a null text has size 0, a null source is a source of its own and the last, a null id is an id. Documents of size
    0 are taken 0 times; repeated rows are documents of their own. No documents, no rows. Other columns are not carried.
    """
    at, sources = prepared(docs, key, (), "mix")
    taken = takes(sources, block)
    spans = at.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))))
    overlap = F.least(F.col("begin") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("begin"), F.col("block") * block)
    met = spans.withColumn("overlap", overlap).join(taken.hint("merge"), ["rank", "block"], "left")
    # a document of some size is known by its source and first word
    out = met.groupBy("rank", "begin").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")],
        F.sum(F.coalesce(F.col("overlap") * F.col("times"), F.lit(0))).alias("taken"),
    ).drop("rank", "begin")
    empty = at.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return out.unionByName(empty)


def mixed_documents(docs: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """The columns of docs for the documents of which the mix takes something: `text` holds the taken words, each block as
    often as taken, and n_chars (where docs has it) its length. Documents of which nothing is taken go."""
    columns = docs.columns
    rest = [c for c in columns if c not in ("text", "n_chars", "source")]
    packed = docs.select("text", "source", F.col(key).alias("_key"), F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_row"))
    # each row gets a number when it is written; places are found without the texts, which are dealt once, to meet what is taken
    rows = stored(packed.withColumn("size", word_count(F.col("text"))).withColumn("_at", F.monotonically_increasing_id()), "mixed")
    sized = rows.select("_at", F.col("_key").alias("doc_id"), "source", "size")
    at = stored(positioned(sized), "mixed-places")
    sources = stored(targets(ranked(at)), "mixed-sources")
    taken = takes(sources, block)
    at = at.where("size > 0").join(sources.select(F.col("source").alias("_s"), "rank"), F.col("source").eqNullSafe(F.col("_s")))
    spans = at.select("_at", "rank", "begin", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))).alias("block"))
    used = spans.join(taken.hint("merge"), ["rank", "block"]).groupBy("_at").agg(F.first("begin").alias("begin"), F.array_sort(F.collect_list(F.struct("block", "times"))).alias("used"))
    words = F.split(F.trim(F.regexp_replace("text", f"[{SPACES}]+", " ")), " ")
    first = lambda b: F.greatest(F.col("begin"), b * block) - F.col("begin")
    last = lambda b: F.least(F.col("begin") + F.col("size"), (b + 1) * block) - F.col("begin")
    piece = lambda w, u: F.flatten(F.array_repeat(F.slice(w, (first(u["block"]) + 1).cast("int"), (last(u["block"]) - first(u["block"])).cast("int")), u["times"].cast("int")))
    # the words are bound to a variable: as a column they would be split again for each block
    text = F.element_at(F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("used", lambda u: piece(w, u))), " ")), 1)
    out = rows.where("size > 0").join(used.hint("merge"), "_at").withColumn("_text", text)
    made = {c: F.col(f"_row.`{c}`") for c in rest} | {"text": F.col("_text"), "source": F.col("source")} | ({"n_chars": F.length("_text").cast("long")} if "n_chars" in columns else {})
    return out.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c == "n_chars" and isinstance(docs.schema[c].dataType, T.NumericType) else made[c].alias(c) for c in columns])
