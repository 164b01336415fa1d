"""Benchmark decontamination, with DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words. A window is ``size`` consecutive words of a benchmark item; an item of
fewer words, but not none, is one window. A window's hash comes from the hashes of its words, by doubling. The distinct hashes of
all windows, counted once they are written, are broadcast as a hash set as long as there are at most ``SET_ROWS``, and
documents' windows are looked up in it where they are made; with more of them, the same look-up is a shuffled join of hashes, in
which no row has text or words; texts come to what was found by one shuffle. Only windows found are then verified, word by word, in a join with the benchmark's windows, which is left to the
planner: it broadcasts them only if their written size is small.

Null or wordless texts have no windows: 0 words, no hits. Repeated rows are reported like any other; items that are
equal count as one if they share an id. Columns of any name pass: they are carried in one struct. Window lengths are 1 to
``size``, so the work for one text is in proportion to it. A text's words are looked at in runs of ``RUN``, so of a very long text only its
words, not the hashes of its windows, are in memory at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doubled, scratch, window_hash

#: Most hashes of windows that are broadcast; some 16 bytes each.
SET_ROWS = 2_000_000
#: Words of a text whose windows are looked at together: arrays of hashes are as long at most, however long the text.
RUN = 1 << 16
#: Fixed value: what separates words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: Column) -> Column:
    """A-Z to a-z; a text of ASCII characters only needs no look at each character."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BETWEEN), "")


def hashed(df: DataFrame, size: int) -> DataFrame:
    """df: words. Adds hashes, those of the words, and those of windows that ``window_hash`` needs."""
    return doubled(df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w))), "hashes", size)


def item_windows(benchmark: DataFrame, size: int, item: str, text: str) -> DataFrame:
    """Distinct (h, w, len, item_id): a window's hash and words, for each item that it is in; written to the shared folder."""
    items = benchmark.select(F.col(item).cast("string").alias("item_id"), words_of(F.col(text)).alias("words")).where(F.size("words") > 0)
    items = hashed(items.withColumn("len", F.least(F.size("words"), F.lit(size))), size)
    of_length = F.coalesce(*(F.when(F.col("len") == n, window_hash("hashes", n)) for n in range(1, size + 1)))
    at = items.select("item_id", "len", "words", F.posexplode(of_length).alias("i", "h"))
    made = scratch(benchmark.sparkSession, "windows")
    at.select("h", F.slice("words", F.col("i") + 1, F.col("len")).alias("w"), "len", "item_id").distinct().write.parquet(made)
    return benchmark.sparkSession.read.parquet(made)


def hits(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10, set_rows: int = SET_ROWS, run: int = RUN) -> DataFrame:
    """row, key, text_hash, n_words, and i, len, item_id of each verified occurrence of a window; one row with nulls in these
    last three for every document besides."""
    windows = item_windows(benchmark, size, item, item_text)
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # at most ``size`` rows
    known = windows.select(F.col("h").alias("known")).distinct()
    small = known.count() <= set_rows
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"), words_of(F.col(text)).alias("words"))
    find = _in_set if known.count() <= set_rows else _by_shuffle
    rows = find(base, known, lengths, run)
    theirs = windows.select(F.col("h").alias("bh"), F.col("w").alias("bw"), "item_id")
    joined = rows.join(theirs, (F.col("h") == F.col("bh")) & (F.col("w") == F.col("bw")), "left")
    sure = F.col("bh").isNotNull()
    return joined.select("row", "key", "text_hash", "n_words", F.when(sure, F.col("i")).alias("i"), F.when(sure, F.col("len")).alias("len"), "item_id")


def _windows(base: DataFrame, lengths: list[int], run: int, own: bool, *carried: str) -> DataFrame:
    """The carried columns, n_words, and k, at, h, w: the place in ``lengths`` (from 1), the place in the text (from 0), the hash and the
    run's words of each window; ``from`` is the run's first place. own: also a row for each text, at k 0, with a hash that spreads."""
    longest = max(lengths, default=1)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(run))
    runs = F.transform(starts, lambda s: F.struct(s.alias("from"), F.slice("words", s + 1, run + longest - 1).alias("words")))
    parts = base.select(*carried, F.size("words").cast("bigint").alias("n_words"), F.explode(runs).alias("part")).select(*carried, "n_words", "part.from", "part.words")
    first = F.when(F.col("from") == 0, F.array(F.xxhash64(F.lit("row"), F.col("row")))).otherwise(F.array().cast("array<bigint>"))
    # a window that begins after the run is one of the next run, too
    arrays = F.array(*[first] * own, *(F.slice(window_hash("hashes", n), 1, run) for n in lengths))
    made = hashed(parts, longest).select(*carried, "n_words", "from", "words", F.posexplode(arrays).alias("k", "of"))
    keep = ["words"] if own else []
    return made.select(*carried, "n_words", "from", *keep, (F.col("k") + (0 if own else 1)).alias("k"), F.posexplode("of").alias("at", "h"))


def _length(lengths: list[int], k: Column) -> Column:
    return F.element_at(F.array(F.lit(0), *map(F.lit, lengths)), k + 1)


def _in_set(base: DataFrame, known: DataFrame, lengths: list[int], run: int) -> DataFrame:
    """Windows found where they are made, in a broadcast set of hashes: row, key, text_hash, n_words, i, len, h, w; one row more for
    each document itself, with a len of 0."""
    made = _windows(base, lengths, run, True, "row", "key", "text_hash")
    found = made.join(F.broadcast(known), F.col("h") == F.col("known"), "left").where("k = 0 or known is not null")
    len_ = _length(lengths, F.col("k"))
    return found.select("row", "key", "text_hash", "n_words", (F.col("from") + F.col("at") + 1).alias("i"), len_.alias("len"), "h", F.slice("words", F.col("at") + 1, len_).alias("w"))


def _by_shuffle(base: DataFrame, known: DataFrame, lengths: list[int], run: int) -> DataFrame:
    """The same rows with hashes too many for a set: windows are shuffled as (key, text_hash, k, at, h); the places found come back to
    their texts, which go through one shuffle, once each, and only there are cut into words again."""
    slim = _windows(base.drop("text"), lengths, run, False, "key", "text_hash").select("key", "text_hash", "k", (F.col("from") + F.col("at")).alias("at"), "h")
    found = slim.join(known.hint("shuffle_merge"), F.col("h") == F.col("known"), "left_semi").groupBy("key", "text_hash").agg(F.collect_set(F.struct("k", "at", "h")).alias("found"))
    found = found.select(F.col("key").alias("found_key"), F.col("text_hash").alias("found_hash"), "found")
    slices = F.transform("found", lambda c: F.struct((c["at"] + 1).alias("i"), _length(lengths, c["k"]).alias("len"), c["h"].alias("h"), F.slice("words", c["at"] + 1, _length(lengths, c["k"])).alias("w")))
    texts = base.select("row", "key", "text_hash", "text", F.size("words").cast("bigint").alias("n_words"))
    both = texts.join(found, F.col("key").eqNullSafe(F.col("found_key")) & (F.col("text_hash") == F.col("found_hash")), "left")
    at = both.withColumn("words", F.when(F.col("found").isNotNull(), words_of(F.col("text")))).select("row", "key", "text_hash", "n_words", F.explode_outer(slices).alias("c"))
    own = F.xxhash64(F.lit("row"), F.col("row"))
    return at.select("row", "key", "text_hash", "n_words", F.coalesce("c.i", F.lit(1)).alias("i"), F.coalesce("c.len", F.lit(0)).alias("len"), F.coalesce("c.h", own).alias("h"), F.coalesce("c.w", F.array().cast("array<string>")).alias("w"))


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """key, text_hash, n_words, n_hit, n_items, items_sha256, contaminated for each document, and ``hit``, the sorted
    1-based places of its hit words."""
    found = hits(docs, benchmark, **options)
    places = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("i").isNotNull(), F.sequence(F.col("i"), F.col("i") + F.col("len") - 1))))))
    by = found.groupBy("row", "key", "text_hash").agg(F.max("n_words").alias("n_words"), places.alias("hit"), F.sort_array(F.collect_set("item_id")).alias("items"))
    return by.select(
        F.col("key").alias(options.get("key", "doc_id")), "text_hash", "n_words", F.size("hit").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"), "hit",
    )


def remove(docs: DataFrame, benchmark: DataFrame, *, spans: bool = False, **options) -> DataFrame:
    """The documents, without contaminated ones; with ``spans`` these stay and lose their hit words instead, each with what
    follows it up to the next word. All columns of ``docs`` stay as they are. Text is shuffled for the join with what was
    found, which may be any share of the documents."""
    key, text = options.get("key", "doc_id"), options.get("text", "text")
    bad = report(docs, benchmark, **options).where("contaminated").select(F.col(key).alias("bad_key"), F.col("text_hash").alias("bad_hash"), F.col("hit").alias("bad_hit")).dropDuplicates(["bad_key", "bad_hash"])
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    same = F.col("k").eqNullSafe(F.col("bad_key")) & (F.col("h") == F.col("bad_hash"))
    if not spans:
        return rows.drop("t").join(bad.drop("bad_hit"), same, "left_anti").select("row.*")
    inside = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # as BETWEEN, but for a text whose capitals are still there
    parts = F.regexp_extract_all("t", F.lit(f"[^{inside}]+[{inside}]*"), F.lit(0))
    lead = F.regexp_extract("t", f"^[{inside}]*", 0)
    kept = F.concat(lead, F.array_join(F.filter(parts, lambda p, i: ~F.array_contains(F.col("bad_hit"), i + 1)), ""))
    kept = F.when(F.col("bad_hash").isNotNull(), kept).otherwise(F.col("t"))
    return rows.join(bad, same, "left").select(*((kept if c == text else F.col("row")[c]).alias(c) for c in docs.columns))
