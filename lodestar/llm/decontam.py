"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Texts become templates: numbers, capitalised words inside a sentence and units after a number turn into
typed placeholders, all else into lower-case words without punctuation. Windows of a document's template
are joined by hash with the windows of the benchmark items. A matching window carries the values that
stood in its placeholders. An item is found in a document where enough of its windows match and each
item value always meets one document value (the same question with other numbers or names), or where
enough windows match with equal values (the same question). The first is tested in the document as a whole
and in each alignment of item and document, alone and with its neighbours (for words put in or left out),
so that other variants or stray windows in the document do not hide one. Windows of which placeholders
are more than half match by their words alone, so an item of little else is found only with equal values.

Edges: a null or empty text has no windows; a very long text is compared in all its windows; an item of fewer
than LEAST_WORDS words is too short to tell and never matches; an item shorter than a window is one window of
its own length; rows of one key are parts of one document, so repeated rows count once, texts under one id are
judged together, and those under a null id as the document of the null id (clean() judges by the text instead);
an empty benchmark or table gives no rows; further columns are ignored (contaminated) or stay (clean).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.shared import checkpointed

#: Words of a window, least words of an item, least share of literal words in a window that may match with other values, share of an item's windows.
WINDOW, LEAST_WORDS, LITERAL, COVERAGE = 8, 5, 0.5, 0.25
#: Benchmark windows that may be broadcast: 64 bytes each at most, beyond it the join shuffles.
BROADCAST_WINDOWS = 500_000
#: Keys of texts found (64 characters each) that may be broadcast.
BROADCAST_KEYS = 500_000

# Unit words.
UNITS = "kg g mg lb lbs oz km m cm mm mi ft yd in l ml gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years mph kph percent % usd eur dollars dollar euros euro cents cent degrees degree hz khz mhz ghz kb mb gb tb w kw v a n j".split()

#: Capitalised words after a word or comma and a blank are taken as names.
_NAME = r"(\p{Lu}(?<=[\p{L}\p{N},;)]\x20\p{Lu})\p{Ll}+)"
_NOISE = r"[^\p{L}\p{N}\x01.,%]+|[.,](?!\p{N})|(?<!\p{N})[.,]|(?<!\p{N})%"


def tokens(text: Column) -> Column:
    """Lower-case words; a name starts with the character 1."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), _NAME, "\u0001$1")
    plain = F.lower(F.regexp_replace(marked, _NOISE, " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _digit(w: Column) -> Column:
    return F.ascii(w).between(48, 57)


def _placeholder(w: Column) -> Column:
    return (F.ascii(w) == 1) | _digit(w)


def template(words: Column, plain: Column) -> tuple[Column, Column]:
    """Hashes of the template's words, and the values of its placeholders (null for a literal word).

    A text without names and numbers has no placeholders, as units follow numbers; its words are hashed as they are.
    """

    def unit(w: Column, i: Column) -> Column:
        return w.isin(UNITS) & (i > 0) & F.coalesce(_digit(F.get(words, i - 1)), F.lit(False))

    def key(w: Column, i: Column) -> Column:
        return F.xxhash64(F.when(F.ascii(w) == 1, "\u0001name").when(_digit(w), "\u0001number").when(unit(w, i), "\u0001unit").otherwise(w))

    def slot(w: Column, i: Column) -> Column:
        return F.when(_placeholder(w) | unit(w, i), w)

    keys = F.when(plain, F.transform(words, lambda w: F.xxhash64(w))).otherwise(F.transform(words, key))
    return keys, F.when(~plain, F.transform(words, slot))


def windows(df: DataFrame, keys: list[str], text: str, sizes: list[int]) -> DataFrame:
    """One row a window: keys, n (words), size, pos, hash, slots, heavy.

    A heavy window has more than half of its words in placeholders; its template says little, so its hash is that of its words.
    """
    base = df.select(*keys, tokens(F.col(text)).alias("w"))
    base = base.select(*keys, "w", F.size("w").alias("n"), (~F.exists("w", _placeholder)).alias("plain"))
    k, s = template(F.col("w"), F.col("plain"))
    base = base.select(*keys, "n", "plain", "w", k.alias("k"), s.alias("s"))
    none = F.array().cast("array<string>")

    def of(size: int) -> Column:
        def one(i: Column) -> Column:
            slots = F.when(F.col("plain"), none).otherwise(F.filter(F.slice("s", i, size), lambda v: v.isNotNull()))
            return F.struct(F.lit(size).alias("size"), i.alias("pos"), F.xxhash64(F.lit(size), F.slice("k", i, size)).alias("hash"), slots.alias("slots"), F.lit(False).alias("heavy"))

        def with_heavy(x: Column) -> Column:
            heavy = size - F.size(x["slots"]) < LITERAL * size
            words = F.transform(F.slice("w", x["pos"], size), lambda w: F.xxhash64(F.ltrim(w, F.lit("\u0001"))))
            return F.struct(x["size"].alias("size"), x["pos"].alias("pos"), F.when(heavy, F.xxhash64(F.lit(size), words)).otherwise(x["hash"]).alias("hash"), x["slots"].alias("slots"), heavy.alias("heavy"))

        made = F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), one)
        kept = F.when(F.col("plain"), made).otherwise(F.transform(made, with_heavy))
        return F.when(F.col("n") >= size, kept).otherwise(F.array().cast("array<struct<size:int,pos:int,hash:bigint,slots:array<string>,heavy:boolean>>"))

    rows = base.select(*keys, "n", F.explode(F.concat(*[of(s) for s in sizes]) if len(sizes) > 1 else of(sizes[0])).alias("x"))
    return rows.select(*keys, "n", "x.size", "x.pos", "x.hash", "x.slots", "x.heavy")


def _groups(window: int) -> Column:
    """Groups (kind, at) of matches that may be one occurrence of the item: all of the document, those of one
    alignment, and two bands of near alignments, so that matches up to half a band apart share one of them."""
    at = F.col("pos") - F.col("item_pos")
    band = F.greatest(F.lit(window), F.expr("item_n div 2").cast("int"))
    step = F.expr(f"greatest({window}, item_n div 2) div 2").cast("int")
    kinds = [F.lit(0), at, F.floor(at / band), F.floor((at + step) / band)]
    return F.array(*(F.struct(F.lit(k).alias("kind"), v.cast("long").alias("at")) for k, v in enumerate(kinds)))


def contaminated(df: DataFrame, benchmark: DataFrame, keys: list[str] | None = None, text: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """Rows of (keys, item_id) found: windows, matched, exact (longs), coverage (double), reparameterised (boolean)."""
    keys = keys or ["doc_id"]
    spark = df.sparkSession
    items = benchmark.select("item_id", F.col("text").alias("item_text")).filter(F.size(tokens(F.col("item_text"))) >= LEAST_WORDS)
    # Window sizes are at most `window` numbers: its own and those of shorter items.
    sizes = sorted({r[0] for r in items.select(F.least(F.size(tokens(F.col("item_text"))), F.lit(window)).alias("n")).distinct().collect()})
    if not sizes:
        return spark.createDataFrame([], df.select(*keys).schema.add("item_id", "long").add("windows", "long").add("matched", "long").add("exact", "long").add("coverage", "double").add("reparameterised", "boolean"))
    # A window of another size than the item's own would only repeat what its own windows say.
    own = windows(items, ["item_id"], "item_text", sizes).filter(F.col("size") == F.least("n", F.lit(window))).select("item_id", F.col("n").alias("item_n"), F.col("pos").alias("item_pos"), F.col("hash"), F.col("slots").alias("item_slots"), F.col("heavy").alias("item_heavy"))
    own = own.groupBy("item_id", "item_n", "item_pos", "hash", "item_heavy").agg(F.first("item_slots").alias("item_slots"))
    count = own.count()
    total = own.groupBy("item_id").agg(F.countDistinct("item_pos").alias("windows"), F.countDistinct(F.when(~F.col("item_heavy"), F.col("item_pos"))).alias("light"))
    seen = windows(df, keys, text, sizes).drop("n", "size")
    small = count <= BROADCAST_WINDOWS
    hit = seen.join(F.broadcast(own) if small else own, "hash")
    # Pairs of values are few: at most a window's words, and equal windows of a group merge here.
    words = F.col("item_heavy") | F.col("heavy")
    pairs = F.arrays_zip(F.col("item_slots").alias("a"), F.when(words, F.col("item_slots")).otherwise(F.col("slots")).alias("b"))
    same = (words | (F.col("slots") == F.col("item_slots"))).cast("int")
    hit = hit.select(*keys, "item_id", "item_pos", pairs.alias("pairs"), same.alias("same"), (~F.col("item_heavy")).cast("int").alias("light"), F.explode(_groups(window)).alias("group"))
    met = hit.groupBy(*keys, "item_id", "group", "item_pos").agg(F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.max("same").alias("same"), F.max("light").alias("light"))
    found = met.groupBy(*keys, "item_id", "group").agg(F.count("*").alias("matched"), F.sum("same").alias("exact"), F.sum("light").alias("met_light"), F.sum(F.col("same") * F.col("light")).alias("exact_light"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    one_to_one = F.size(F.array_distinct(F.transform("pairs", lambda p: p["a"]))) == F.size("pairs")
    found = found.join(F.broadcast(total) if small else total, "item_id")
    # Heavy windows match with equal values only, so they are left out where other values may stand.
    light = F.col("light") > 0
    varied = one_to_one & light & (F.try_divide("met_light", "light") >= coverage)
    equal = (F.col("exact") / F.col("windows") >= coverage) | (light & (F.try_divide("exact_light", "light") >= coverage))
    # The counts are those of the whole document, the group in which all matches are.
    whole = F.col("group.kind") == 0
    found = found.groupBy(*keys, "item_id", "windows").agg(F.max(F.when(whole, F.col("matched"))).alias("matched"), F.max(F.when(whole, F.col("exact"))).alias("exact"), F.max(varied).alias("varied"), F.max(F.when(whole, equal)).alias("equal"))
    share = F.col("matched") / F.col("windows")
    kept = found.filter(F.col("equal") | F.col("varied"))
    return kept.select(*keys, F.col("item_id").cast("long"), "windows", "matched", F.col("exact").cast("long"), share.alias("coverage"), (~F.col("equal")).alias("reparameterised"))


def clean(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Rows of df in which no item is found; columns and repeated rows stay. Equal texts share their verdict.

    The keys of the texts found are a table of its own; up to BROADCAST_KEYS are broadcast, so that no text moves.
    """
    key = "\u0001text"
    marked = df.withColumn(key, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    bad = checkpointed(contaminated(marked.select(key, text), benchmark, [key], text).select(key).distinct(), "decontam")
    small = bad.count() <= BROADCAST_KEYS
    return marked.join(F.broadcast(bad) if small else bad, key, "left_anti").select(*df.columns)
