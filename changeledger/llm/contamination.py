"""Benchmark decontamination by a prefix-filtered join of shingles and an exact check of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeledger.llm.common import unused, lowered, settle

#: Words of a window and of a shingle; an item of fewer words is one window (and one shingle) of its length.
WINDOW, SHINGLE = 10, 5
#: Most distinct benchmark shingles that are broadcast, about 100 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 500_000
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def words_of(text: Column) -> Column:
    """Lower-cased words of a whole text; NULL has none."""
    return F.regexp_extract_all(lowered(text), F.lit(WORD), F.lit(0))


def windows_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, length, window (its words joined by blanks) for each different window of an item."""
    words, n = F.col("words"), F.size("words")
    listed = (benchmark.select(F.col(item_id).alias("item_id"), words_of(F.col(text)).alias("words")).filter(n > 0)
              .withColumn("length", F.least(n, F.lit(WINDOW)))
              .withColumn("start", F.explode(F.sequence(F.lit(1), n - F.col("length") + 1))))
    return listed.select("item_id", "length", F.array_join(F.slice(words, F.col("start"), F.col("length")), " ").alias("window")).distinct()


def shingles_of(windows: DataFrame) -> DataFrame:
    """window, length, offset, shingle, size: the shingles of each different window, at all their places."""
    words = F.split("window", " ")
    size = F.least(F.col("length"), F.lit(SHINGLE))
    return (windows.select("window", "length").distinct().withColumn("size", size)
            .withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("length") - F.col("size"))))
            .withColumn("shingle", F.array_join(F.slice(words, F.col("offset") + 1, F.col("size")), " ")))


def _numbered(shingles: DataFrame) -> tuple[DataFrame, int]:
    """shingle, size, number (64-bit hash) of the different shingles; another seed if two of them share a number."""
    names, seed = settle(shingles.select("shingle", "size").distinct()), 0
    while True:
        numbered = names.withColumn("number", F.xxhash64(F.lit(seed), "shingle"))
        n, different = numbered.agg(F.count(F.lit(1)), F.countDistinct("number")).first()
        if n == different:
            return numbered, n
        seed += 1


def _occurrences(docs: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """row, n_words, place, number for each place of a document where a benchmark shingle stands.

    Each row of docs also gives one record with number NULL and place = n_words, so that the texts are
    read and cut into words once. The join compares the shingles' own words, not only their hash.
    """
    sizes = sorted(r["size"] for r in names.select("size").distinct().collect())  # at most SHINGLE different ones
    words = docs.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words"))
    longest = max(sizes, default=1)
    # one place more than there are words: the record of the document itself; array j holds the words from j on
    padded = F.concat(F.col("words"), F.array(F.lit(None).cast("string")))
    shifted = [padded] + [F.slice(F.col("words"), j + 1, F.greatest(F.col("n_words") - j, F.lit(0))) for j in range(1, longest)]
    spread = words.select("row", "doc_id", "n_words", F.posexplode(F.arrays_zip(*[s.alias(f"w{j}") for j, s in enumerate(shifted)])).alias("place", "z"))
    whole = {size: F.when(F.col(f"z.w{size - 1}").isNotNull(), F.concat_ws(" ", *[F.col(f"z.w{j}") for j in range(size)])) for size in sizes}
    if len(sizes) == 1:
        spread = spread.withColumn("text_shingle", whole[sizes[0]])
    elif sizes:
        parts = F.array(*[whole[size] for size in sizes])
        last = F.col("place") == F.col("n_words")
        spread = spread.withColumn("text_shingle", F.explode(F.when(last, F.array(F.lit(None).cast("string"))).otherwise(F.filter(parts, lambda x: x.isNotNull()))))
    else:
        spread = spread.withColumn("text_shingle", F.lit(None).cast("string"))
    known = names.select("shingle", "number")
    known = F.broadcast(known) if n <= MOST_BROADCAST else known
    found = spread.join(known, F.col("text_shingle") == F.col("shingle"), "left")
    own = F.col("place") == F.col("n_words")
    return (found.filter(own | F.col("number").isNotNull())
            .select("row", F.when(own, F.col("doc_id")).alias("doc_id"), F.col("n_words").cast("long").alias("n_words"),
                    F.col("place").cast("long").alias("place"), "number"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, n_words, n_hit, items (sorted list of item ids as strings) for every row of docs.

    A window (WINDOW words of an item, or all words of a shorter one) is a set of shingles that a document
    must contain whole, so any one of them is a sufficient prefix: the rarest in the documents is joined.
    An occurrence at a place proposes one start (positional bound), which must lie inside the document
    (length bound). The window stands there exactly if its other shingles stand at their places: those that
    cover all its words are looked up by (row, place).

    The places of benchmark shingles are written once; their counts, the join and the check read only them.
    n_hit is the length of the union of a row's windows; one window function over a row's own windows.

    Defined results: NULL, empty and wordless texts have no words and no hits; items without words have no
    window; equal items are all reported; rows are kept apart however often an id or a text is repeated
    (``row`` numbers them); an empty table on either side gives no hits; other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    windows = settle(windows_of(benchmark))
    shingles = shingles_of(windows)
    names, n = _numbered(shingles)
    names = settle(names)
    places = settle(_occurrences(rows, names, n))
    hits = places.filter("number IS NOT NULL").select("row", "n_words", "place", "number")
    parts = settle(shingles.join(names.select(F.col("shingle").alias("s"), "number"), F.col("shingle") == F.col("s"))
                   .select(F.xxhash64("window", "length").alias("key"), "window", "length", "offset", "size", "number"))
    rarity = hits.groupBy("number").agg(F.count(F.lit(1)).alias("n")).select(F.col("number").alias("of"), "n")
    # the prefix: the rarest shingle; a window with a shingle that stands nowhere is nowhere
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "number", "offset")
    prefix = (parts.join(rarity, F.col("number") == F.col("of"), "left").groupBy("window", "length")
              .agg(F.min(order).alias("p")).filter("p.n > 0")
              .select(F.col("window").alias("of_window"), "length", F.col("p.number").alias("p_number"), F.col("p.offset").alias("p_offset")))
    # what covers all words of a window: shingles at 0, SHINGLE, ... and the last one
    step = F.pmod("offset", F.lit(SHINGLE)) == 0
    cover = parts.filter(step | (F.col("offset") == F.col("length") - F.col("size"))).select("window", "offset", F.col("number").alias("c_number"))
    covers = cover.groupBy("window").agg(F.count(F.lit(1)).alias("needed"), F.collect_list(F.struct("offset", "c_number")).alias("cover"))
    plan = settle(prefix.join(covers, F.col("of_window") == F.col("window")).drop("of_window"))
    size = plan.count()
    plan = F.broadcast(plan) if size <= MOST_BROADCAST // 4 else plan
    start = F.col("place") - F.col("p_offset")
    wanted = (hits.join(plan, F.col("number") == F.col("p_number")).withColumn("start", start)
              .filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n_words")))
              .select("row", "start", "window", "length", "needed", F.explode("cover").alias("c"))
              .select("row", "start", "window", "length", "needed", (F.col("start") + F.col("c.offset")).alias("at"), F.col("c.c_number").alias("c_number")))
    there = hits.select(F.col("row").alias("r"), F.col("place").alias("p"), F.col("number").alias("k"))
    met = (wanted.join(there, (F.col("row") == F.col("r")) & (F.col("at") == F.col("p")) & (F.col("c_number") == F.col("k")))
           .groupBy("row", "start", "window", "length").agg(F.count(F.lit(1)).alias("n"), F.first("needed").alias("needed"))
           .filter("n = needed"))
    met = settle(met.select("row", "start", "window", "length"))
    ends = F.col("start") + F.col("length")
    before = F.max(F.col("start") + F.col("length")).over(Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    spans = met.select("row", "start", "length").distinct()
    fresh = F.greatest(F.lit(0), ends - F.greatest(F.coalesce("before", F.lit(0)), F.col("start")))
    hit = (spans.withColumn("before", before).withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
           .select(F.col("row").alias("h_row"), "n_hit"))
    owners = windows.select(F.col("window").alias("w"), "item_id")
    items = (met.select("row", "window").distinct().join(owners, F.col("window") == F.col("w"))
             .groupBy("row").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
             .select(F.col("row").alias("i_row"), "items"))
    texts = places.filter("number IS NULL").select("row", "doc_id", "n_words")
    return (texts.join(hit, F.col("row") == F.col("h_row"), "left").join(items, F.col("row") == F.col("i_row"), "left")
            .select("row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def without_benchmark(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs in which no window of a benchmark item occurs; all columns stay as they are.

    Whether a row goes depends on its text alone, so rows go by the MD5 of their text. Defined results: as in
    contamination(); NULL and empty texts stay; equal rows share their fate; an empty table gives an empty result.
    """
    key, bad_text = F.md5(F.coalesce(F.col(text), F.lit(""))), unused(docs, "bad_text")
    found = contamination(docs.select(key.alias("text_key"), F.col(text).alias("text")), benchmark, "text_key", "text")
    bad = found.filter("n_hit > 0").select(F.col("doc_id").alias(bad_text)).distinct()
    return docs.join(bad, key == F.col(bad_text), "left_anti")
