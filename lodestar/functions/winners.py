"""Which of up to three sides a page's result names as the winner: native array expressions over one row a page.

The steps, in order, with the method they report: a side that the result names as a target ("anti-", "against"), by the
place of its first mention in the sides' cells; marks of the allied powers; the side whose names alone occur in the result; the
actor of the title, for a bare "victory" or "defeat"; signs of a coalition. A row without an answer keeps a null side
and `unresolved`.

Columns read: title, page_type, result, kind, and bel_a, com_a to bel_c, com_c (belligerents and commanders of each side).
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.curation import ALIASES, ALLIED, COALITION, NEUTRAL, PHRASES, STOPWORDS

# Words of titles that name no side, page types and forms of titles that name an actor.
NO_SIDE = "world first second third fourth fifth civil independence campaign operation war wars conflict revolt rebellion revolution uprising coup offensive insurgency occupation expedition battle siege front the and of against during east west north south eastern western northern southern spring mandatory border battalion kingdom republic states state long area forces army united".split()
ACTOR_PAGES = ["battle_article", "war_conflict_article", "campaign_article", "operation_article"]
ACTOR_FORMS = [
    r"^(.+?) intervention in .+$",
    r"^(.+?) offensives?(?: \(.+\))?(?: into .+| in .+)?$",
    r"^(?!\d{3,4}\b)(.+?) campaigns? against .+$",
    r"^(?!\d{3,4}\b)(.+?) expedition(?:s)? to .+$",
    r"^(?!\d{3,4}\b)(.+?) invasion of .+$",
    r"^(?!\d{3,4}\b)(.+?) occupation of .+$",
    r"^(?!\d{3,4}\b)(.+?) landing at .+$",
]
TARGET = r"(?:anti[-\s]+|against\s+)([a-z][a-z\s-]{2,60})"
TARGET_END = r"\b(coalition|allied|allies|alliance|victory|defeat|forces?|troops?|campaign|war)\b"

#: Words and phrases by which a result may call an entity, and the reverse index: the entities that a word stands for.
BY_WORD = {k: sorted(v) for k, v in ALIASES.items()}
BY_PHRASE = {k: sorted(v) for k, v in PHRASES.items()}
BY_ALIAS = {a: sorted(k for k, v in ALIASES.items() if a in v) for a in sorted({a for v in ALIASES.values() for a in v})}
#: The entities that a word stands for, or is.
BY_NAME = {w: sorted(k for k, v in ALIASES.items() if w in [k, *v]) for w in sorted({*ALIASES, *BY_ALIAS})}
#: A name that lies this many characters before the next side's is the target, however often either occurs.
CLEAR = 20


def _words(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def _table(index: dict[str, list[str]]) -> Column:
    return F.create_map(*(x for k, v in index.items() for x in (F.lit(k), _words(v))))


def _known(index: dict[str, list[str]], w: Column) -> Column:
    """What the index has for a word; nothing for others."""
    return F.coalesce(F.try_element_at(_table(index), w), F.array().cast("array<string>"))


def space(c: Column) -> Column:
    """Without footnote marks, blanks of any kind as single spaces."""
    plain = F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\[\d+\]", ""), F.lit("\xa0"), F.lit(" "))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def _hyphens(c: Column) -> Column:
    return reduce(lambda x, dash: F.replace(x, F.lit(dash), F.lit("-")), "–—−", c)


def _unless_plain(c: Column, plain: Column, other: Column) -> Column:
    """Of a name of letters and digits with single blanks or hyphens, as most are, what it becomes without any pattern."""
    return F.when(F.rlike(c, F.lit(r"^[A-Za-z0-9]+(?:[ -][A-Za-z0-9]+)*\z")), plain).otherwise(other)


def title_form(c: Column) -> Column:
    return _hyphens(space(c))


def _members(c: Column) -> Column:
    """The pieces of a cell, cleaned, with the key by which they are alike; stop words go."""
    # Each lambda names what the one before has made, as it would be worked out anew for each name.
    image = lambda p: F.when(F.contains(F.lower(p), F.lit(".svg")) | F.contains(F.lower(p), F.lit("px")), F.regexp_replace(p, r"(?i)\b\w+\.svg\b|\b\d+px\b", "")).otherwise(p)
    bare = lambda p: space(F.regexp_replace(p, r"\([^)]*\)|['\"“”‘’]", ""))
    key = lambda e: F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(title_form(e), r"[^\p{L}\p{N}_\s-]", "")), r"[-\s]+", "-"), "^-+|-+$", "")
    pieces = F.filter(F.split(F.coalesce(c, F.lit("")), r"[\n|;/]+"), lambda p: p != "")
    shown = F.transform(F.transform(pieces, lambda p: _unless_plain(p, p, title_form(p))), image)
    clean = F.filter(F.transform(shown, lambda p: _unless_plain(p, p, bare(p))), lambda e: e != "")
    keyed = F.transform(clean, lambda e: F.struct(e.alias("name"), _unless_plain(e, F.replace(F.lower(e), F.lit(" "), F.lit("-")), key(e)).alias("key")))
    return F.filter(keyed, lambda x: (x["key"] != "") & ~x["key"].isin(STOPWORDS))


def _firsts(members: str) -> Column:
    """Of members alike the first one's name."""
    keys = F.col(members)["key"]
    return F.transform(F.filter(members, lambda x, i: F.array_position(keys, x["key"]) == i + 1), lambda x: x["name"])


def _plain(e: Column) -> Column:
    return _unless_plain(e, F.lower(e), F.trim(F.regexp_replace(F.regexp_replace(F.lower(e), r"[^a-z0-9\s-]", " "), r"\s+", " ")))


def _long(flat: Column) -> Column:
    return F.filter(F.split(flat, r"\s+"), lambda w: (F.length(w) >= 4) & ~w.isin(STOPWORDS))


def with_tokens(df: DataFrame, cells: dict[str, str]) -> DataFrame:
    """Adds, for each cell (name: column), its entities \1e<name> and all words and phrases of four letters or more by which a result may call them, \1k<name>.

    Made in steps, as an expression inside a lambda is worked out anew each time that it is named.
    """
    none = F.array().cast("array<string>")
    df = df.withColumns({f"\1m{n}": _members(F.col(c)) for n, c in cells.items()})
    df = df.withColumns({f"\1e{n}": _firsts(f"\1m{n}") for n in cells})
    df = df.withColumns({f"\1l{n}": F.transform(f"\1e{n}", _plain) for n in cells})
    df = df.withColumns({f"\1w{n}": F.transform(f"\1l{n}", lambda low: F.replace(low, F.lit("-"), F.lit(" "))) for n in cells})
    # A phrase stands in one of the names if it does in their lines, as neither holds a line's end.
    df = df.withColumns({f"\1o{n}": F.flatten(F.transform(f"\1w{n}", _long)) for n in cells} | {f"\1j{n}": F.array_join(f"\1w{n}", "\n") for n in cells})

    def every(n: str) -> Column:
        flat, own = F.col(f"\1w{n}"), F.col(f"\1o{n}")
        has = lambda k: F.contains(f"\1j{n}", F.lit(k))
        phrases = [F.when(has(k), _words(v)).otherwise(none) for k, v in BY_PHRASE.items()]
        both = F.when(has("denmark") & has("norway") & F.exists(flat, lambda x: F.array_contains(F.split(x, " "), "denmark") & F.array_contains(F.split(x, " "), "norway")), _words(BY_PHRASE["denmark norway"])).otherwise(none)
        found = F.concat(f"\1l{n}", F.transform(flat, lambda x: F.trim(F.when(F.contains(x, F.lit("  ")), F.regexp_replace(x, " +", " ")).otherwise(x))), own, *phrases, both, F.flatten(F.transform(own, lambda w: _known(BY_WORD, w))))
        return F.array_distinct(F.filter(found, lambda t: F.length(t) >= 4))

    return df.withColumns({f"\1k{n}": every(n) for n in cells})


def targets(result: Column) -> Column:
    """What a result names after "anti-" or "against", with the words and aliases of it."""

    phrase_of = lambda m: space(F.regexp_replace(F.regexp_replace(m, TARGET_END + ".*$", ""), "^[ -]+|[ -]+$", ""))
    words_of = lambda phrase: F.filter(F.split(phrase, r"[\s-]+"), lambda w: (F.length(w) >= 3) & ~w.isin(STOPWORDS))

    def of(x: Column) -> Column:
        phrase, own = x["phrase"], x["own"]
        phrases = F.flatten(F.array(*(F.when(F.contains(phrase, F.lit(k)), _words(v)).otherwise(F.array().cast("array<string>")) for k, v in BY_PHRASE.items())))
        return F.concat(F.array(phrase), own, phrases, F.flatten(F.transform(own, lambda w: _known(BY_WORD, w))))

    # In steps, as in with_tokens.
    found = F.filter(F.transform(F.regexp_extract_all(result, F.lit(TARGET), F.lit(1)), phrase_of), lambda p: p != "")
    named = F.transform(found, lambda p: F.struct(p.alias("phrase"), words_of(p).alias("own")))
    return F.array_distinct(F.filter(F.flatten(F.transform(named, of)), lambda t: F.length(t) >= 3))


def place(text: Column, token: Column) -> Column:
    """Where a token first stands in a text, from 0, between characters that are no letters or digits; null if nowhere."""
    at = F.regexp_instr(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit("[^a-z0-9]"), token, F.lit("[^a-z0-9]")))
    # A pattern is made only where the token occurs at all.
    return F.when(F.contains(text, token), F.nullif(at, F.lit(0)) - 1)


def stands(text: Column, token: Column) -> Column:
    """Whether place() finds the token."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return F.when(F.contains(text, token), F.regexp_like(padded, F.concat(F.lit("[^a-z0-9]"), token, F.lit("[^a-z0-9]")))).otherwise(False)


def _count(text: Column, words: list[str]) -> Column:
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def _sides(f) -> Column:
    return F.array(*(f(s) for s in "abc"))


def _only(sides: Column) -> Column:
    """The one side of an array; null where there are none or several."""
    return F.when(F.size(sides) == 1, F.get(sides, F.lit(0)))


def actor(title: Column) -> Column:
    """The actor of a title, in title_form(), that tells what someone did, without a year before it; empty where no form fits."""
    low, out = F.lower(title), F.lit("")
    for form in reversed(ACTOR_FORMS):
        # Each form is tried on titles with its word only.
        word = re.search(" ([a-z]+)", form)[0].rstrip("s")
        got = F.when(F.contains(low, F.lit(word)), F.regexp_extract(title, "(?i)" + form, 1)).otherwise("")
        out = F.when(got != "", got).otherwise(out)
    return space(F.regexp_replace(out, r"^\d{3,4}\s+", ""))


def winners(df: DataFrame) -> DataFrame:
    """Adds win_side (side_a, side_b, side_c or null) and method. Nulls count as empty cells."""
    held = df.columns
    low = lambda c: F.lower(space(F.col(c)))
    one = df.withColumns({"\1r": low("result"), "\1title": title_form(F.col("title"))} | {f"\1{c}": low(c) for s in "abc" for c in (f"bel_{s}", f"com_{s}")})
    # The words of a side's cell, between blanks.
    words = {f"\1v{s}": F.concat(F.lit(" "), F.regexp_replace(f"\1bel_{s}", "[^a-z0-9]", " "), F.lit(" ")) for s in "abc"}
    one = one.withColumns({"\1actor": F.lower(title_form(actor(F.col("\1title")))), "\1t": targets(F.col("\1r"))} | words)
    one = with_tokens(one, {c: c for s in "abc" for c in (f"bel_{s}", f"com_{s}")})
    # How many of the known names stand in a side's cell, under any of their words.
    standing = F.lit(f" ({'|'.join(BY_NAME)})(?= )")
    one = one.withColumns({f"\1n{s}": F.size(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(f"\1v{s}", standing, F.lit(1)), lambda w: _known(BY_NAME, w))))) for s in "abc"})
    one = one.withColumns({f"\1every{s}": F.concat(f"\1kbel_{s}", f"\1kcom_{s}") for s in "abc"} | {"\1doer": F.filter(F.split("\1actor", "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~w.rlike(r"^\d+$") & ~w.isin(NO_SIDE))})
    r = F.col("\1r")

    def facts(s: str) -> Column:
        bel, com, every, ents, canon = F.col(f"\1bel_{s}"), F.col(f"\1com_{s}"), f"\1every{s}", F.size(f"\1ebel_{s}"), F.col(f"\1n{s}")
        places = F.filter(F.flatten(F.transform("\1t", lambda t: F.array(place(bel, t), place(com, t)))), lambda p: p.isNotNull())
        exact = (F.col("\1actor") != "") & F.contains(_hyphens(bel), F.col("\1actor")) & (bel != "")
        loose = exact | ((bel != "") & F.exists("\1doer", lambda w: F.arrays_overlap(_known(BY_ALIAS, w), F.col(f"\1kbel_{s}"))))
        return F.struct(
            F.lit(f"side_{s}").alias("side"), (bel != "").alias("there"), F.array_min(places).alias("at"), F.size(places).alias("hits"), F.exists(every, lambda t: stands(r, t)).alias("met"),
            F.exists(every, lambda t: F.when(F.contains(r, t), F.regexp_like(F.concat(r, F.lit(" ")), F.concat(F.lit(r"(anti[-\s]+|against\s+)"), t, F.lit("[^a-z0-9]")))).otherwise(False)).alias("negated"),
            (ents + canon + 4 * _count(bel, COALITION)).alias("strength"), ((ents >= 2) | (canon >= 2) | F.contains(bel, F.lit("*")) | (_count(bel, COALITION) > 0)).alias("coalition"),
            (_count(bel, COALITION) > 0).alias("label"), _count(bel, ALLIED).alias("allied"), exact.alias("exact"), loose.alias("loose"),
        )

    one = one.withColumn("\1s", _sides(facts))
    names = lambda keep: F.transform(F.filter("\1s", keep), lambda x: x["side"])
    there = names(lambda x: x["there"])
    hit = F.sort_array(F.transform(F.filter("\1s", lambda x: x["hits"] > 0), lambda x: F.struct(x["at"].alias("at"), (-x["hits"]).alias("minus"), x["side"].alias("side"))))
    first, second = F.get(hit, F.lit(0)), F.get(hit, F.lit(1))
    clear = (F.size(hit) == 1) | (first["at"] + CLEAR <= second["at"]) | ((first["at"] < second["at"]) & (first["minus"] <= second["minus"]))
    one = one.withColumns({"\1loser": F.when(clear, first["side"]), "\1there": there, "\1negated": names(lambda x: x["negated"]), "\1met": names(lambda x: x["met"])})
    but = lambda sides, gone: F.filter(sides, lambda x: x != gone)
    loser, negated = F.col("\1loser"), _only(F.col("\1negated"))
    coalitions = lambda gone: names(lambda x: x["there"] & x["coalition"] & (x["side"] != gone))
    by_target = F.coalesce(_only(but(F.col("\1there"), loser)), _only(coalitions(loser)))
    allied = F.sort_array(F.transform(F.filter("\1s", lambda x: x["there"]), lambda x: F.struct((-x["allied"]).alias("minus"), x["side"].alias("side"))))
    by_allied = F.when(F.contains(r, F.lit("allied")) | F.contains(r, F.lit("coalition")), F.when((F.get(allied, F.lit(0))["minus"] < 0) & (F.coalesce(F.get(allied, F.lit(1))["minus"], F.lit(0)) == 0), F.get(allied, F.lit(0))["side"]))
    by_negation = F.coalesce(_only(but(F.col("\1there"), negated)), _only(but(F.col("\1met"), negated)), _only(coalitions(negated)))
    exact = names(lambda x: x["exact"])
    acted = _only(F.when(F.size(exact) == 1, exact).otherwise(names(lambda x: x["loose"])))
    by_actor = F.when(F.col("page_type").isin(ACTOR_PAGES) & (F.col("\1actor") != ""), F.when(r == "victory", acted).when((r == "defeat") & acted.isNotNull(), _only(but(F.col("\1there"), acted))))
    strong = F.sort_array(F.transform(F.filter("\1s", lambda x: x["there"]), lambda x: F.struct((-x["strength"]).alias("minus"), x["side"].alias("side"))))
    lead = F.when(F.size(strong) >= 2, F.get(strong, F.lit(0))["minus"] + 2 <= F.get(strong, F.lit(1))["minus"]).otherwise(F.get(strong, F.lit(0))["minus"] < 0)
    hinted = lambda v: F.when(_count(r, COALITION) > 0, v)
    steps = [
        ("negated_target_match", by_target), ("allied_marker_match", by_allied), ("negated_target_match", F.when(negated.isNotNull(), F.coalesce(by_negation, F.lit("none")))), ("unique_belligerent_match", _only(F.col("\1met"))), ("generic_actor_title_match", by_actor),
        ("coalition_label_match", hinted(_only(names(lambda x: x["there"] & x["label"])))), ("coalition_side_heuristic", hinted(_only(names(lambda x: x["there"] & x["coalition"])))), ("coalition_strength_heuristic", hinted(F.when(lead, F.get(strong, F.lit(0))["side"]))),
    ]
    idle = (r == "") | F.coalesce(F.col("kind"), F.lit("")).isin("", "unknown", *NEUTRAL)
    found = F.when(~idle, F.coalesce(*(F.when(side.isNotNull(), F.struct(side.alias("side"), F.lit(m).alias("method"))) for m, side in steps)))
    one = one.withColumn("\1found", found)
    # A single negated side without an answer ends the search.
    real = F.col("\1found.side") != "none"
    return one.select(*held, F.when(real, F.col("\1found.side")).alias("win_side"), F.when(real, F.col("\1found.method")).otherwise("unresolved").alias("method"))
