"""Secret scans with DataFrame functions only: fixed patterns, and two character Markov models.

The models hold log transition probabilities of random strings and of ordinary identifiers. A long
token is a secret when the log-likelihood ratio of its characters, random against ordinary, reaches a
threshold. Both are counted from labelled samples: random strings made from digests of numbers in the
alphabets that keys use, and ordinary identifiers made of the words of a bounded sample of the corpus.

Edges: a null or empty text has no spans; a very long text or token is scanned whole, in time linear in its
characters; a null or repeated id passes through; an empty corpus leaves the smoothed model of the random
strings against a flat one, and an empty table gives no rows; repeated rows are scanned each; further columns,
of whatever names, stay (scan, redact) or are ignored (digests), and a column named as `into` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Characters of the models' transitions; another character counts as index 0.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-="
#: Tokens the models judge.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Documents whose words serve as ordinary identifiers, and random strings of each alphabet.
SAMPLE_DOCS, SAMPLE_STRINGS = 500, 1500
#: Matches of a block of a fold.
BLOCK = 64
#: Least log-likelihood ratio, in nats, in all and for each transition.
LEAST_TOTAL, LEAST_EACH = 12.0, 0.5


def _with(value: Column, body) -> Column:
    """The body over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _folded(rows: Column, total, join, state, step) -> Column:
    """A fold over rows that appends to its state's array `out`, in blocks, so that no array grows by more than BLOCK copies.

    A block's fold starts from state(x), x the join of total() of all blocks before.
    """

    def run(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda b: F.slice(rows, b * BLOCK + 1, BLOCK))
        return _with(blocks, lambda blocks: _with(F.transform(blocks, total), lambda totals: F.flatten(F.transform(blocks, lambda x, b: F.aggregate(x, state(F.aggregate(F.slice(totals, 1, b), F.lit(0), join)), step, lambda acc: acc["out"])))))

    return _with(rows, run)


def _spans(text: Column, pattern: str, kind: str, order: int, least: int = 0) -> Column:
    """All matches as structs of start, order, end, kind, value: lengths of the pieces between matches give the places."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if least else hits
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["hit"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        keep = F.char_length(x["value"]) >= least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), value.alias("value"))
    # The piece after the last match has none; matches are never empty.
    rows = F.filter(rows, lambda x: x["hit"].isNotNull())
    rows = F.transform(rows, lambda x: F.struct(F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), x["value"].alias("value")))
    whole = lambda x: F.aggregate(x, F.lit(0), lambda acc, r: acc + r["gap"] + r["hit"])
    found = _folded(rows, whole, lambda x, y: x + y, lambda at: F.struct(at.alias("at"), empty.alias("out")), step)
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(empty)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns, by start and then kind as listed."""
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("key")
    none = F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,value:string>>")
    assign = F.when(named, _spans(text, ASSIGN, "assign", 0, ASSIGN_LEAST)).otherwise(none)
    access = F.when(text.contains("AKIA"), _spans(text, ACCESS, "access", 1)).otherwise(none)
    return F.array_sort(F.concat(assign, access, _spans(text, HEX, "hex", 2)))


def labelled_strings(df: DataFrame, text: str = "text", docs: int = SAMPLE_DOCS, strings: int = SAMPLE_STRINGS) -> DataFrame:
    """Labelled training strings: is_random, value. Ordinary ones come from `docs` rows, chosen by a hash of the id."""
    spark = df.sparkSession
    n = F.col("id").cast("string")
    digest = F.sha2(n, 256)
    raw = F.unhex(digest)
    solid = F.regexp_replace(F.base64(raw), r"[^A-Za-z0-9]", "")
    random = spark.range(strings).select(
        F.explode(
            F.array(
                digest,
                F.md5(n),
                F.base64(raw),
                F.translate(F.base64(raw), "+/=", "-_"),
                F.upper(solid),
                F.lower(solid),
                solid,
            )
        ).alias("value")
    )
    ids = df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(docs).distinct()
    # At most `docs` ids are broadcast.
    picked = df.join(F.broadcast(ids), "doc_id", "left_semi").select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = F.filter(F.regexp_extract_all(F.col("text"), F.lit(r"[A-Za-z0-9]+"), F.lit(0)), lambda w: (F.char_length(w) < 24) & ~F.rlike(w, F.lit(r"^[0-9a-f]*[0-9][0-9a-f]*$")))
    words = picked.select(words.alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.slice("w", i, 3))
    shaped = words.filter(F.size("w") > 0).select(F.explode(pairs).alias("p"))
    ordinary = shaped.select(
        F.explode(
            F.array(
                F.array_join("p", "_"),
                F.array_join("p", "-"),
                F.array_join("p", "/"),
                F.array_join(F.transform("p", F.initcap), ""),
                F.upper(F.array_join("p", "_")),
                F.lower(F.array_join("p", "")),
                F.concat(F.element_at("p", 1), F.lit("="), F.element_at("p", -1)),
                F.concat(F.lit("2"), F.lpad((F.abs(F.xxhash64("p")) % 1000).cast("string"), 3, "0"), F.lit("-"), F.lpad((F.abs(F.hash("p")) % 100).cast("string"), 2, "0"), F.lit("-"), F.element_at("p", 1)),
            )
        ).alias("value")
    )
    return random.select(F.lit(True).alias("is_random"), "value").unionByName(ordinary.select(F.lit(False).alias("is_random"), "value"))


def train(samples: DataFrame) -> list[float]:
    """Log-ratio of each transition, row-major over ALPHABET with index 0 for others: (len+1)**2 numbers, smoothed by one count."""
    size = len(ALPHABET) + 1
    at = F.sequence(F.lit(1), F.char_length("value") - 1)
    pair = samples.filter(F.char_length("value") >= 2).select("is_random", F.explode(F.transform(at, lambda i: F.substring("value", i, 2))).alias("p"))
    # The result has at most two rows a transition, whatever the sample.
    place = F.expr(f"locate(substring(p, 1, 1), '{ALPHABET}') * {size} + locate(substring(p, 2, 1), '{ALPHABET}')")
    rows = pair.groupBy("is_random", place.alias("cell")).count().collect()
    counts = [[1.0] * (size * size), [1.0] * (size * size)]
    for r in rows:
        counts[int(r.is_random)][r.cell] += r["count"]
    import math

    sums = [[sum(c[k * size : (k + 1) * size]) for k in range(size)] for c in counts]
    return [round(math.log(counts[1][i] / sums[1][i // size]) - math.log(counts[0][i] / sums[0][i // size]), 4) for i in range(size * size)]


def markov_spans(text: Column, ratios: list[float]) -> Column:
    """Spans of long tokens that the model of random strings explains better."""
    size = len(ALPHABET) + 1
    # One constant, as the optimiser evaluates it; a sum of its parts would be made anew for each character.
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")

    def ratio(value: Column) -> Column:
        codes = F.transform(F.split(value, ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)))
        state = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total"))
        more = lambda acc, c: F.when(acc["last"] < 0, 0.0).otherwise(F.get(table, acc["last"] * size + c))
        return F.aggregate(codes, state, lambda acc, c: F.struct(c.alias("last"), (acc["total"] + more(acc, c)).alias("total")), lambda acc: acc["total"])

    def secret(x: Column) -> Column:
        total = ratio(x["value"])
        return total >= F.greatest(F.lit(LEAST_TOTAL), F.lit(LEAST_EACH) * (F.char_length(x["value"]) - 1))

    return F.filter(_spans(text, CANDIDATE, "markov", 3), secret)


def scan(df: DataFrame, ratios: list[float], text: str = "text", into: str = "secrets") -> DataFrame:
    """Adds the array of spans (start, ord, end, kind, value), sorted; a model span that touches a base span is left out."""
    own = F.coalesce(F.col(text), F.lit(""))
    kept = df.drop(into) if into in df.columns else df
    found = kept.withColumn(into, F.struct(base_spans(own).alias("base"), markov_spans(own, ratios).alias("more")))
    base, more = F.col(into)["base"], F.col(into)["more"]
    free = F.when(F.size(more) == 0, more).otherwise(F.filter(more, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"]))))
    return found.withColumn(into, F.array_sort(F.concat(base, free)))


def redact(df: DataFrame, spans: str = "secrets", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces every span, merged where they overlap, by a mark. A row without spans keeps its text."""
    own = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast("array<struct<keep:int,from:int>>")

    def step(acc: Column, s: Column) -> Column:
        piece = F.struct(s["start"].alias("keep"), acc["at"].alias("from"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.array(piece))).alias("out"))

    last = lambda x: F.aggregate(x, F.lit(0), lambda acc, s: F.greatest(acc, s["end"]))
    pieces = _folded(F.col(spans), last, lambda x, y: F.greatest(x, y), lambda at: F.struct(at.alias("at"), none.alias("out")), step)
    kept = F.transform(pieces, lambda x: F.concat(F.substr(own, x["from"] + 1, x["keep"] - x["from"]), F.lit(mark)))
    clean = F.concat(F.array_join(kept, ""), F.substr(own, last(F.col(spans)) + 1))
    return df.withColumn(text, F.when(F.size(spans) > 0, clean).otherwise(F.col(text)))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(found: DataFrame, spans: str = "secrets") -> DataFrame:
    """The counts, digest and text of all spans of each row of scan()."""
    own = F.col(spans)
    count = lambda kind: F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(F.filter(own, lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        joined(own).alias("spans"),
        count("markov").alias("n_markov"),
    )
