"""Benchmark decontamination by SimHash of item-sized windows, all of it column expressions and joins.

Words are runs of letters and digits, lower case. An item and a window of a text are multisets of 5-word shingles; they match
if the sum of the lesser counts is at least ``percent`` per cent of the sum of the greater ones. Items of n shingles form the
length class n; windows of n shingles are compared with all of that class.

1. Gate: positions of texts whose shingle is one of some item of a class. A match shares at least percent * n / 100 positions
   with its item, so only windows that hold so many of the class's positions are fingerprinted, and none that could match is
   left out, whatever the order of its parts. The gate does not say which item a window may match. A long text is dealt out in
   chunks of starts.
2. Windows get a 64-bit SimHash of their shingles that are known to the class (others only add noise), items of all theirs. The
   bits of a window's shingles are counted by running sums as it slides (see ``dense_windows``).
3. Search: a multi-index over the items. The bits are cut into ``blocks`` blocks; two fingerprints within the radius agree in
   some block but for radius // blocks bits (pigeonhole). Each item is entered under every block value within that distance,
   so one equi-join on (class, block, value) finds all items within the radius of a window, and no pair is found twice.
4. The exact similarity of the shingle multisets decides.

At a radius of 14 bits a pair just at 80 per cent is found with a chance of about 0.997 (the distance is about 6.9 bits with a
deviation of 2.5), and pairs above it more surely; see ``tests/llm`` and the README for recall against exact search.

Joins with benchmark tables are left to Spark, which broadcasts them by their size in bytes as written.

Defined results: null and empty texts and items match nothing; items shorter than a shingle but of ``min_words`` words are one
shingle of all their words; items of fewer words say too little inside a text and match only texts of just these words; windows
lie within the text, and a text shorter than an item is one window; items are told apart by id and words, so items that share
an id, or have none, each count by themselves; results depend on a text, not on its id, so ids may be null, repeated and of
any type; repeated rows give one row; texts of any length are read whole; empty tables give an empty result; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, written
from .quality import gram_hashes, let

BITS = 64


def words_of(text: Column) -> Column:
    """Hashes of the words of a text."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def mark_of(text: Column) -> Column:
    """What tells texts apart: a 128-bit digest."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def simhash(grams: Column) -> Column:
    """The 64-bit SimHash of an array of 64-bit hashes; bit b is set if it is set in more than half of them.

    Two counters of 32 bits share a long, so 32 sums do for 64 bits.
    """
    lanes = F.lit((1 << 32) + 1)
    shifted = lambda v, k: F.call_function("shiftleft", v.cast("long"), k)

    def both(acc: Column, k: Column) -> Column:
        total = F.aggregate(grams, F.lit(0).cast("long"), lambda n, h: n + F.call_function("shiftrightunsigned", h, k).bitwiseAND(lanes))
        low = lambda s: shifted(s.bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.size(grams), k)
        high = lambda s: shifted(F.shiftrightunsigned(s, 32) * 2 > F.size(grams), k + 32)
        return let(total, lambda s: acc.bitwiseOR(low(s)).bitwiseOR(high(s)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), both)


def block_widths(blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    widths = [BITS // blocks + (k < BITS % blocks) for k in range(blocks)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def block_value(mark: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(mark, at).bitwiseAND(F.lit((1 << width) - 1))


def near_values(width: int, errors: int) -> list[int]:
    """All masks of a block with at most so many bits set."""
    return [sum(1 << b for b in c) for e in range(errors + 1) for c in combinations(range(width), e)]


def multi_index(items: DataFrame, finger: str, blocks: int, errors: int) -> DataFrame:
    """Each row under (block, value) for every value that differs from its own by at most ``errors`` bits."""

    def entries(k: int, at: int, width: int) -> Column:
        masks = F.array(*[F.lit(m).cast("long") for m in near_values(width, errors)])
        return F.transform(masks, lambda m: F.struct(F.lit(k).alias("block"), block_value(F.col(finger), at, width).bitwiseXOR(m).alias("value")))

    entered = F.concat(*[entries(k, at, w) for k, (at, w) in enumerate(block_widths(blocks))])
    return items.select("*", F.explode(entered).alias("e")).select("*", "e.block", "e.value").drop("e")


def first_near_block(a: Column, b: Column, blocks: int, errors: int) -> Column:
    """The first block in which two fingerprints differ by at most ``errors`` bits."""
    x = a.bitwiseXOR(b)
    return F.coalesce(*[F.when(F.bit_count(block_value(x, at, w)) <= errors, F.lit(k)) for k, (at, w) in enumerate(block_widths(blocks))])


def shared_weight(a: Column, b: Column) -> Column:
    """Sum of the lesser counts of two arrays as multisets."""
    count = lambda x, g: F.size(F.filter(x, lambda y: y == g))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    both = F.array_intersect(a, b)
    return F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda n, g: n + F.least(count(a, g), count(b, g))))


#: Counters of bits in a long: bit k and every LANE-th bit above it; each holds counts below 2 ** LANE.
LANE = 22


def tallies(h: Column) -> list[Column]:
    """The bits of a 64-bit hash as LANE longs of counters that can be summed."""
    lanes = F.lit(sum(1 << b for b in range(0, BITS, LANE)))
    return [F.shiftrightunsigned(h, k).bitwiseAND(lanes) for k in range(LANE)]


def from_tallies(sums: list[Column], n: Column) -> Column:
    """The SimHash of n hashes whose tallies have these sums."""
    one = lambda b: F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")
    out = F.lit(0).cast("long")
    for b in range(BITS):
        count = F.shiftrightunsigned(sums[b % LANE], LANE * (b // LANE)).bitwiseAND(F.lit((1 << LANE) - 1))
        out = out.bitwiseOR(F.when(count * 2 > n, one(b)).otherwise(F.lit(0).cast("long")))
    return out


def least_hits(n: Column, size: Column, percent: int) -> Column:
    """How many positions a window that matches an item of n shingles shares with it at least, in a text of so many shingles.

    shared * 100 >= (window + n - shared) * percent bounds them from below.
    """
    return F.greatest(F.lit(1), F.ceil((F.least(n, size) + n) * percent / (100 + percent)).cast("int"))


def chunked_hits(found: DataFrame, percent: int) -> DataFrame:
    """(mark, n, chunk, size, hits): the hits (pos, gram) of the windows that start in a chunk, where these are enough for one.

    Chunks have 2 n starts, so a hit is in two of them at most and an array is bounded by the item's size, however long the text.
    """
    width = F.col("n") * 2
    chunk = lambda p: F.floor(p / width).cast("int")
    each = found.withColumn("chunk", F.explode(F.sequence(chunk(F.greatest(F.lit(0), F.col("pos") - F.col("n") + 1)), chunk(F.col("pos")))))
    g = each.groupBy("mark", "n", "chunk").agg(F.max("size").alias("size"), F.sort_array(F.collect_set(F.struct("pos", "gram"))).alias("hits"))
    return g.where(F.size("hits") >= least_hits(F.col("n"), F.col("size"), percent))


def dense_windows(chunks: DataFrame, percent: int) -> DataFrame:
    """(mark, n, chunk, size, start, gone, held, finger): windows that hold enough hits, ``held`` of them after the first ``gone``.

    A hit enters the window that first reaches it and leaves with the one that starts behind it. Running sums over these events
    give each window's counts of bits, so the work is in proportion to the hits, whatever the item's size. Windows between two
    events hold the same hits; the first of them stands for all, as it would be the one reported.
    """
    first = F.col("chunk") * F.col("n") * 2
    hit = F.posexplode("hits").alias("i", "hit")
    rows = chunks.select("mark", "n", "chunk", "size", hit).select("mark", "n", "chunk", "size", F.col("hit.pos").alias("pos"), F.col("hit.gram").alias("gram"))
    enter = F.struct(F.greatest(F.col("pos") - F.col("n") + 1, first).alias("start"), F.lit(1).alias("sign"))
    leave = F.struct((F.col("pos") + 1).alias("start"), F.lit(-1).alias("sign"))
    events = rows.select("mark", "n", "chunk", "size", "gram", F.explode(F.array(enter, leave)).alias("e")).select("mark", "n", "chunk", "size", "gram", "e.start", "e.sign")
    w = Window.partitionBy("mark", "n", "chunk").orderBy("start")
    sums = [F.sum(t * F.col("sign")).over(w).alias(f"t{k}") for k, t in enumerate(tallies(F.col("gram")))]
    gone = F.sum(F.when(F.col("sign") < 0, 1).otherwise(0)).over(w).cast("int").alias("gone")
    run = events.select("mark", "n", "chunk", "size", "start", *sums, gone, F.sum("sign").over(w).cast("int").alias("held"), F.lead("start").over(w).alias("next"))
    last = F.least(F.greatest(F.lit(0), F.col("size") - F.col("n")), first + F.col("n") * 2 - 1)
    whole = F.col("next").isNull() | (F.col("next") > F.col("start"))  # of the events at one start the last has all
    run = run.where(whole & (F.col("held") >= least_hits(F.col("n"), F.col("size"), percent)) & (F.col("start") <= last))
    return run.select("mark", "n", "chunk", "size", "start", "gone", "held", from_tallies([F.col(f"t{k}") for k in range(LANE)], F.col("held")).alias("finger"))


def _matches(texts: DataFrame, items: DataFrame, shingle: int, percent: int, radius: int, blocks: int, temps: list) -> DataFrame:
    """(mark, item_id, start, shared, total) of matching windows; items: (item, item_id, n, grams)."""
    errors = radius // blocks
    wanted = written(items.select("n", F.explode("grams").alias("gram")).distinct())
    marked = items.withColumn("item_finger", simhash(F.col("grams")))
    index = written(multi_index(marked.select("item", F.col("n").alias("class"), "item_finger"), "item_finger", blocks, errors))
    grams = texts.select("mark", gram_hashes(words_of(F.col("text")), shingle).alias("g"))
    found = grams.select("mark", F.size("g").alias("size"), F.posexplode("g").alias("pos", "gram")).join(wanted, "gram")
    chunks = written(chunked_hits(found, percent))
    temps += [wanted, index, chunks]
    windows = dense_windows(chunks, percent)
    keys = F.array(*[F.struct(F.lit(k).alias("block"), block_value(F.col("finger"), at, w).alias("value")) for k, (at, w) in enumerate(block_widths(blocks))])
    probes = windows.select("*", F.explode(keys).alias("p")).select("*", "p.block", "p.value").drop("p")
    near = probes.join(index.withColumnRenamed("class", "n"), ["n", "block", "value"]).where(
        (F.bit_count(F.col("finger").bitwiseXOR(F.col("item_finger"))) <= radius) & (F.col("block") == first_near_block(F.col("finger"), F.col("item_finger"), blocks, errors))
    )
    known = near.select("mark", "n", "chunk", "size", "start", "gone", "held", "item").join(chunks.select("mark", "n", "chunk", "hits"), ["mark", "n", "chunk"])
    known = known.select("mark", "n", "size", "start", "item", F.slice("hits", F.col("gone") + 1, F.col("held"))["gram"].alias("known")).join(items.select("item", "item_id", "grams"), "item")
    scored = known.select("mark", "item_id", "start", (F.least("n", "size") + F.col("n")).alias("both"), shared_weight(F.col("known"), F.col("grams")).alias("shared"))
    return scored.select("mark", "item_id", "start", "shared", (F.col("both") - F.col("shared")).alias("total")).where(F.col("shared") * 100 >= F.col("total") * percent)


def leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80, radius: int = 14, blocks: int = 5, min_words: int = 4, temps: list | None = None) -> DataFrame:
    """Per leaking text and item: mark, item_id, start_word, shared, total, similarity; the best window, the first of equals.

    Tables written on the way are added to ``temps``; they can be released when the result has been written.
    """
    temps = [] if temps is None else temps
    texts = docs.select(mark_of(F.col("text")).alias("mark"), "text")
    items = written(benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0).distinct().select(F.monotonically_increasing_id().alias("item"), "item_id", "words"))
    temps.append(items)
    short = items.where(F.size("words") < min_words).select("item_id", F.col("words").alias("w"))
    size = F.size("w")
    out = texts.select("mark", words_of(F.col("text")).alias("w")).where((size > 0) & (size < min_words)).join(short, "w").select("mark", "item_id", F.lit(0).alias("start"), F.lit(1).alias("shared"), F.lit(1).alias("total"))
    for n in range(min(min_words, shingle), shingle + 1):
        these = items.where(F.size("words") >= n if n == shingle else F.size("words") == n)
        if n < shingle and not these.take(1):
            continue
        grams = gram_hashes(F.col("words"), n)
        out = out.union(_matches(texts, these.select("item", "item_id", grams.alias("grams")).withColumn("n", F.size("grams")), n, percent, radius, blocks, temps))
    best = F.max(F.struct((F.col("shared") / F.col("total")).alias("similarity"), (-F.col("start")).alias("at"), "shared", "total")).alias("best")
    return out.groupBy("mark", "item_id").agg(best).select("mark", "item_id", (-F.col("best.at")).cast("long").alias("start_word"), F.col("best.shared").cast("long").alias("shared"), F.col("best.total").cast("long").alias("total"), F.col("best.similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The leaks (see ``leaks``) of each different (doc_id, text), with its doc_id."""
    temps: list[DataFrame] = []
    found = written(leaks(docs, benchmark, temps=temps, **kw))
    release(*temps)
    rows = docs.select("doc_id", mark_of(F.col("text")).alias("mark")).join(found, "mark").distinct()
    return rows.select("doc_id", "mark", "item_id", "start_word", "shared", "total", "similarity")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The rows, all columns, whose text leaks no item."""
    temps: list[DataFrame] = []
    bad = written(leaks(docs, benchmark, temps=temps, **kw).select("mark").distinct())
    release(*temps)
    return docs.alias("d").join(bad.alias("x"), mark_of(F.col("d.text")) == F.col("x.mark"), "left_anti")
