"""Text functions: native column expressions, and Arrow UDFs where Spark has no built-in."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns of results, first match wins.
RESULTS = [
    ("pyrrhic_victory", r"(?i)\bpyrrhic victory\b"),
    ("decisive_victory", r"(?i)\bdecisive .*victory\b|\bdecisive victory\b"),
    ("tactical_victory", r"(?i)\btactical .*victory\b|\btactical victory\b"),
    ("draw", r"(?i)\bdraw\b"),
    ("stalemate", r"(?i)\bstalemate\b"),
    ("indecisive", r"(?i)\bindecisive\b"),
    ("disputed", r"(?i)\bdisputed\b|\bdispute\b"),
    ("victory", r"(?i)\bvictory\b"),
    ("defeat", r"(?i)\bdefeat\b|\bdefeated\b"),
]
DASHES = "‐‑‒–—−"


def clean_space(c: Column) -> Column:
    """Without [n] references; every run of white space, no-break spaces too, is one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", ""), r"(?U)\s+", " "))


def slug(c: Column) -> Column:
    """Lower-case words joined by underscores."""
    kept = F.regexp_replace(F.lower(F.trim(c)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(kept, r"(?U)[\s-]+", "_")


def person_name(c: Column) -> Column:
    """Without parentheses, brackets, daggers and a leading rank."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\([^)]*\)|\[[^\]]*\]", ""), r"[†‡#*?]+|\b(c\.|ca\.)(?=\s|$)", "")
    return clean_space(F.regexp_replace(F.trim(bare), r"(?i)^(general|admiral|colonel|captain|sir|lord|king)\s+", ""))


def split_names(c: Column) -> Column:
    """Names of a cell: cut at bullets, semicolons, slashes and 'and', at commas if that is all; distinct in order, ignoring case."""
    first = F.split(c, r"[•;]| / | and ")
    parts = F.when((F.size(first) == 1) & F.contains(c, F.lit(",")), F.split(c, ",")).otherwise(first)
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def result_type(c: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern in reversed(RESULTS):
        out = F.when(F.rlike(c, F.lit(pattern)), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def result_label(kind: Column) -> Column:
    return F.when(kind.endswith("victory"), "Victory").when(kind == "defeat", "Defeat").when(kind == "unknown", "Unknown").otherwise(F.initcap(kind))


def number_range(c: Column) -> Column:
    """struct(lo, hi, mid, confidence) of the whole numbers in a text; mid rounds halves to even."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\b\d[\d,]*\b"), F.lit(0)), lambda x: F.regexp_replace(x, ",", "").cast("long"))
    n = F.size(found)
    lo, hi = F.array_min(found), F.array_max(found)
    mid = F.when(n >= 2, F.bround((lo + hi) / 2).cast("long")).otherwise(lo)
    return F.struct(lo.alias("lo"), hi.alias("hi"), mid.alias("mid"), F.when(n == 0, 0.0).when(n <= 2, 0.8).otherwise(0.55).alias("confidence"))


def key_values(c: Column, pair: str = "; ", eq: str = "=") -> Column:
    return F.str_to_map(c, F.lit(pair), F.lit(eq))


def short_id(c: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(c), 1, 12))


def title_link(title: Column) -> Column:
    """The page link of a title. Characters that links keep as they are come back from the encoder's escapes."""
    out = F.url_encode(F.replace(F.trim(title), F.lit(" "), F.lit("_")))
    for mark in "(),:'!~":
        out = F.replace(out, F.lit(f"%{ord(mark):02X}"), F.lit(mark))
    return F.concat(F.lit("https://en.wikipedia.org/wiki/"), out)


def link_title(url: Column) -> Column:
    """The title of a page link, without query and fragment; empty for other links."""
    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*/wiki/([^?#]*)", 1)
    # The decoder would take a plus sign for a blank.
    return F.trim(F.replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), F.lit("_"), F.lit(" ")))


def balanced(text: str, at: int, open_: str = "{{", close: str = "}}") -> str:
    """The block that opens at a position, up to its own close; empty if it never closes."""
    depth, i = 0, at
    while i < len(text):
        if text.startswith(open_, i):
            depth, i = depth + 1, i + len(open_)
        elif text.startswith(close, i):
            depth, i = depth - 1, i + len(close)
            if not depth:
                return text[at:i]
        else:
            i += 1
    return ""


def split_top(text: str, sep: str = "|") -> list[str]:
    """Cut at separators outside {{}} and [[]]."""
    out, depth, last = [], 0, 0
    i = 0
    while i < len(text):
        two = text[i : i + 2]
        if two in ("{{", "[["):
            depth, i = depth + 1, i + 2
        elif two in ("}}", "]]"):
            depth, i = max(0, depth - 1), i + 2
        else:
            if text[i] == sep and not depth:
                out.append(text[last:i])
                last = i + 1
            i += 1
    return [*out, text[last:]]


def template_params(block: str) -> dict[str, str]:
    """Parameters of a {{template|a=b|c}} block; those without a name are numbered from 1."""
    fields = split_top(block[2:-2])[1:] if block.startswith("{{") else []
    out: dict[str, str] = {}
    n = 0
    for f in fields:
        name, eq, value = f.partition("=")
        if not eq:
            n += 1
            name, value = str(n), f
        out[name.strip()] = value.strip()
    return out


def render(text: str, passes: int = 12) -> str:
    """Inner templates replaced until nothing changes: lists by their items, links and flags by their last positional field, others by their first."""

    def one(m: re.Match) -> str:
        name, *fields = (f.strip() for f in split_top(m.group(1)))
        own = [f for f in fields if "=" not in f and f]
        if name.lower() in ("plainlist", "ubl", "unbulleted list", "flatlist", "hlist"):
            return "<br>".join(x.strip() for f in own for x in re.split(r"(?:^|\n)\s*\*", f) if x.strip())
        return (own[-1] if name.lower() in ("flag", "flagicon", "ill", "lang", "small", "nowrap") else own[0]) if own else ""

    for _ in range(passes):
        done = re.sub(r"\{\{([^{}]*)\}\}", one, text)
        if done == text:
            break
        text = done
    return text


def without_notes(text: str) -> str:
    """Wiki text without comments and references."""
    return re.sub(r"<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "", text, flags=re.DOTALL)


def strip_markup(text: str) -> str:
    """Wiki text as plain text."""
    text = re.sub(r"<br\s*/?>", " ", without_notes(text))
    text = re.sub(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", r"\1", render(text))
    return re.sub(r"\s+", " ", re.sub(r"'{2,}|<[^>]+>", "", text)).strip()


def links_of(text: str) -> list[dict[str, str]]:
    """Distinct links of wiki text in order, each with title and label."""
    found = (m.group(1).split("|") for m in re.finditer(r"\[\[([^\[\]]+)\]\]", text))
    return [{"title": t, "label": n} for t, n in dict.fromkeys((x[0].strip(), x[-1].strip()) for x in found)]


def lead_of(text: str) -> str:
    """The first paragraph after leading templates and before the first heading, as plain text."""
    body = text
    while (body := body.lstrip()).startswith("{{") and (block := balanced(body, 0)):
        body = body[len(block) :]
    body = re.split(r"(?m)^==", body, maxsplit=1)[0]
    return next((p for x in body.split("\n\n") if (p := strip_markup(x))), "")


def parse_infobox(text: str | None) -> dict[str, object]:
    """The infobox of a conflict: result, and for each side its cell as text, segments and links; the rest of the page's lead."""
    text = without_notes(text or "")
    at = re.search(r"\{\{\s*infobox", text, re.IGNORECASE)
    params = template_params(balanced(text, at.start())) if at else {}
    sides = []
    for k, side in ((1, "side_a"), (2, "side_b"), (3, "side_c")):
        cell, lead = params.get(f"commander{k}", ""), params.get(f"combatant{k}", "")
        parts = [strip_markup(x) for x in re.split(r"<br\s*/?>|\n\*|\n", render(cell))]
        if cell or lead:
            sides.append({"side": side, "belligerent": strip_markup(lead), "segments": [x for x in parts if x], "links": links_of(cell)})
    return {"result": strip_markup(params.get("result", "")), "sides": sides, "lead": lead_of(text)}


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of `a`."""
    place: dict[str, int] = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        met = row & place.get(y, 0)
        row = ((row + met) | (row - met)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 x (1 - insertions and deletions / both lengths) of the words in sorted order."""
    a, b = (" ".join(sorted(x.split())) for x in (a, b))
    if not a and not b:
        return 100.0
    return 200.0 * common_length(a, b) / (len(a) + len(b))


class _Page(HTMLParser):
    """Text, links and paragraphs of a page."""

    def __init__(self) -> None:
        super().__init__()
        self.text: list[str] = []
        self.links: list[tuple[str, str]] = []
        self.paragraphs: list[str] = []
        self.skip = 0
        self.href: str | None = None
        self.label: list[str] = []
        self.para: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        if tag == "a":
            self.href, self.label = dict(attrs).get("href") or "", []
        if tag == "p":
            self.para = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "a" and self.href is not None:
            self.links.append((self.href, " ".join("".join(self.label).split())))
            self.href = None
        if tag == "p" and self.para is not None:
            self.paragraphs.append(" ".join("".join(self.para).split()))
            self.para = None

    def handle_data(self, data):
        if self.skip:
            return
        self.text.append(data)
        if self.href is not None:
            self.label.append(data)
        if self.para is not None:
            self.para.append(data)


def parse_page(html: str | None) -> dict[str, object]:
    p = _Page()
    p.feed(html or "")
    p.close()
    return {"text": " ".join(" ".join(p.text).split()), "links": [{"href": h, "label": t} for h, t in p.links], "lead": next((x for x in p.paragraphs if x), "")}


@F.pandas_udf(T.StringType())
def composed(s: pd.Series) -> pd.Series:
    """NFKC, which Spark lacks."""
    return s.str.normalize("NFKC")


def fold_title(c: Column) -> Column:
    """NFKC, dashes folded, blanks collapsed."""
    return F.trim(F.regexp_replace(F.translate(composed(c), DASHES, "-" * len(DASHES)), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def percent_text(s: pd.Series) -> pd.Series:
    """One decimal of the exact binary value, where Java's formatter rounds the shortest decimal; for small reports."""
    return s.map("{:.1f}%".format, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


_LINK = T.StructType([T.StructField("href", T.StringType()), T.StructField("label", T.StringType())])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(_LINK)), T.StructField("lead", T.StringType())]))
def page_parts(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_page(x) for x in s], columns=["text", "links", "lead"])


_SIDE = T.StructType([T.StructField("side", T.StringType()), T.StructField("belligerent", T.StringType()), T.StructField("segments", T.ArrayType(T.StringType())), T.StructField("links", T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("label", T.StringType())])))])
_BOX = T.StructType([T.StructField("result", T.StringType()), T.StructField("sides", T.ArrayType(_SIDE)), T.StructField("lead", T.StringType())])


@F.pandas_udf(_BOX)
def infobox(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_infobox(x) for x in s], columns=["result", "sides", "lead"])


class _Box(HTMLParser):
    """The rows of the first infobox table: header cells open a section, later rows of two or three cells are its sides."""

    # Headings of an infobox.
    NAMES = {"belligerents": "belligerents", "commanders and leaders": "commanders", "commanders": "commanders", "strength": "strength", "casualties and losses": "casualties", "casualties": "casualties"}

    def __init__(self) -> None:
        super().__init__()
        self.depth = 0
        self.rows: list[tuple[bool, list[dict]]] = []
        self.cell: dict | None = None
        self.link: dict | None = None
        self.heads = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table" and (self.depth or "infobox" in (a.get("class") or "")):
            self.depth += 1
        if not self.depth:
            return
        if tag == "tr":
            self.rows.append((False, []))
        if tag in ("th", "td") and self.rows:
            self.cell = {"text": [""], "links": []}
            self.rows[-1] = (tag == "th", [*self.rows[-1][1], self.cell])
        if tag in ("br", "li") and self.cell is not None:
            self.cell["text"].append("")
        if tag == "a" and self.cell is not None:
            self.link = {"title": a.get("title") or "", "label": ""}
            self.cell["links"].append(self.link)

    def handle_endtag(self, tag):
        if tag == "table" and self.depth:
            self.depth -= 1
        if tag in ("th", "td"):
            self.cell = None
        if tag == "a":
            self.link = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"][-1] += data
        if self.link is not None:
            self.link["label"] += data


def parse_html_infobox(html: str | None) -> dict[str, object]:
    """The sides of an HTML infobox, as parse_infobox() has them from wiki text, and its result."""
    p = _Box()
    p.feed(html or "")
    p.close()
    found: dict[str, list[dict]] = {}
    result, section = "", ""
    for head, cells in p.rows:
        words = [[" ".join(x.split()) for x in c["text"] if x.strip()] for c in cells]
        if head and len(cells) == 1:
            section = _Box.NAMES.get(" ".join(words[0]).lower(), "")
        elif len(cells) == 2 and head is False and words[0] == ["Result"]:
            result = " ".join(words[1])
        elif section and section not in found:
            found[section] = [{"segments": w, "links": c["links"]} for w, c in zip(words, cells, strict=True)]
    sides = []
    for k, side in enumerate(("side_a", "side_b", "side_c")):
        at = lambda name: found.get(name, [])[k] if k < len(found.get(name, [])) else None  # noqa: B023, E731
        lead, cell = at("belligerents"), at("commanders")
        if lead or cell:
            sides.append({"side": side, "belligerent": " ".join(lead["segments"]) if lead else "", "segments": cell["segments"] if cell else [], "links": [{"title": x["title"], "label": " ".join(x["label"].split())} for x in (cell or {"links": []})["links"]]})
    return {"result": result, "sides": sides, "lead": ""}


@F.pandas_udf(_BOX)
def html_infobox(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_html_infobox(x) for x in s], columns=["result", "sides", "lead"])
