"""Rules of page curation as SQL expressions, rendered for Spark or for the comparison's language.

Each rule is one expression text over named columns; a dialect fills in the few functions whose names differ.
The word lists are fixed values.
"""

from __future__ import annotations

import re

# Words of titles and categories.
META = ["Talk:", "User:", "User talk:", "Wikipedia:", "Wikipedia talk:", "File:", "File talk:", "MediaWiki:", "Template:", "Help:", "Category:", "Portal:", "Draft:", "Book:", "Education Program:", "TimedText:", "Module:", "Gadget:", "Special:"]
LISTS = ["list", "lists", "timeline", "chronology", "outline", "index"]
LIST_TITLES = ["list of battles", "lists of battles", "battles of ", "timeline of ", "chronology of ", "military history of ", "battles in ", "battles by "]
CONTEXT = ["battle", "siege", "military operation", "engagement", "warfare", "conflict", "war"]
BATTLE_TITLE = ["battle", "siege", "operation", "skirmish", "raid", "campaign", "engagement", "massacre", "assault", "expedition", "landing", "offensive", "uprising", "rebellion", "mutiny", "combat"]
EXPLICIT_BATTLE = ["battle", "siege", "skirmish", "raid", "massacre", "engagement", "assault", "landing", "combat"]
WAR_TITLE = ["war", "conflict", "insurgency", "insurgencies", "rebellion"]
CAMPAIGN_TITLE = ["campaign", "operation", "offensive", "expedition", "theater", "theatre", "front"]
BATTLE_CATEGORY = ["battles", "sieges", "military operations", "naval battles", "conflicts", "campaigns", "engagements"]
WAR_CATEGORY = ["wars", "conflicts", "insurgencies", "rebellions", "civil wars"]
CAMPAIGN_CATEGORY = ["campaigns", "operations", "offensives", "military operations"]
BIOGRAPHY = ["births", "deaths", "people", "biographies"]
NON_BATTLE = ["division", "regiment", "corps", "army", "personnel", "biography", "military history", "aviation"]
SUPPORT = ["bibliography", "order of battle", "orders of battle", "casualties of", "combatants of", "prisoner of war", "prisoners of war", "military casualties", "military equipment", "uniforms", "awards", "medals", "aftermath", "veterans", "demobilization", "reparations"]
CATEGORY_ASKED = ["battle", "siege", "war", "conflict", "campaign", "operation", "raid", "rebellion", "uprising", "massacre", "insurgency", "insurgencies", "theatre", "theater", "front"]
CATEGORY_REFUSED = ["lists", "bibliography", "casualties", "combatants", "military units", "weapons", "equipment", "uniforms", "films", "novels", "games", "video games", "songs", "albums", "people", "biographies"]
FAMILIES = {
    "period_based": ["ancient", "classical", "medieval", "early modern", "modern", "contemporary", "century"],
    "war_conflict_based": [" war", " conflict", " rebellion", " insurgency", " insurgencies"],
    "region_based": ["in africa", "in asia", "in europe", "in the americas", "in the middle east", "of africa", "of asia", "of europe", "by geographic area"],
    "participant_based": ["involving", "by participant", "by country", "by empire", "by state"],
    "battle_type_based": ["siege", "naval", "operation", "raid", "massacre", "casualty", "commander"],
}
# Words of results.
RESULT_WORDS = ["victory", "defeat", "stalemate", "indecisive", "draw", "repulsed", "repelled", "captured", "suppressed", "overran"]
SUSPICIOUS_RESULT = ["although", "however", "according to", "some authors", "see ", "aftermath", "citation needed", "claimed by"]
SUSPICIOUS_DATE = ["fm ", "field manual", "manual", "isbn", "edition", "chapter", "outline"]
NEUTRAL_PREFIXES = {"inconclusive": "indecisive", "status quo ante bellum": "stalemate", "ceasefire": "indecisive", "truce": "indecisive"}
FACTIONS = {
    "union": ["union", "federal", "american", "usa", "united", "states"], "confederate": ["confederate", "confederacy"], "axis": ["axis", "german", "japanese", "italian"], "ottoman": ["ottoman", "turkish", "turco"],
    "habsburg": ["habsburg", "austrian", "austria"], "soviet": ["soviet", "russian", "ussr"], "french": ["french", "france"], "muslim": ["muslim", "rashidun", "caliphate", "islamic"],
    "parliamentarian": ["parliamentarian", "parliament"], "royalist": ["royalist", "royalists"], "crusader": ["crusader", "crusaders"], "macedonian": ["macedonian", "macedon"],
    "communist": ["communist", "communists"], "nationalist": ["nationalist", "nationalists", "kuomintang"], "rebel": ["rebel", "rebels"], "cossack": ["cossack", "cossacks"],
    "carthaginian": ["carthaginian", "carthage"], "sasanian": ["sasanian", "persian", "iranian"], "jin": ["jin"], "saudi": ["saudi", "arabia"], "serbian": ["serbian", "serbia"],
    "afghan": ["afghan", "afghanistan", "durrani"], "syrian": ["syrian", "syria"], "bulgarian": ["bulgarian", "bulgaria"], "sikh": ["sikh", "sikhs"], "mongol": ["mongol", "mongols"],
    "japanese": ["japanese", "japan"], "albanian": ["albanian", "albania"], "russian": ["russian", "russia"], "bolshevik": ["bolshevik", "bolsheviks"], "u.s.": ["american", "usa", "united", "states"],
}
ALIASES = {
    "austria": ["austrian", "austro"], "britain": ["british", "anglo"], "china": ["chinese"], "denmark": ["danish", "dano"], "england": ["english", "anglo"], "france": ["french", "franco"], "germany": ["german"],
    "greece": ["greek"], "hungary": ["hungarian"], "india": ["indian"], "iran": ["iranian", "persian"], "ireland": ["irish"], "italy": ["italian", "italo"], "japan": ["japanese"], "mongolia": ["mongolian"],
    "netherlands": ["dutch"], "norway": ["norwegian"], "ottoman": ["turkish", "turco"], "persia": ["persian", "iranian"], "poland": ["polish", "polono"], "prussia": ["prussian", "prusso"], "rome": ["roman"],
    "russia": ["russian", "russo", "soviet"], "saxony": ["saxon", "saxo"], "serbia": ["serbian"], "sparta": ["spartan"], "spain": ["spanish"], "sweden": ["swedish"], "syria": ["syrian"], "turkey": ["turkish", "turco"],
    "ukraine": ["ukrainian"], "union": ["union"], "america": ["american"],
}
PHRASES = {
    "allied powers": ["allied", "allies"], "allied forces": ["allied", "allies"], "anti spartan": ["spartan"], "denmark norway": ["dano-norwegian", "dano norwegian", "danish-norwegian"], "first french empire": ["french"],
    "first french republic": ["french"], "great britain": ["british", "anglo-british", "anglo british"], "habsburg monarchy": ["austrian", "austro", "habsburg", "imperial"], "nazi germany": ["german", "nazi"],
    "ottoman empire": ["ottoman", "turkish", "turco"], "soviet union": ["soviet", "russian"], "swedish empire": ["swedish"], "tsardom of russia": ["russian", "russo"], "united kingdom": ["british", "anglo"], "united states": ["american"],
}
STOPWORDS = ["and", "the", "of", "for", "in", "on", "at", "by", "with", "army", "armies", "force", "forces", "fleet", "fleets", "division", "divisions", "corps", "command", "front", "fronts", "coalition", "allies", "allied", "rebels", "insurgents", "government"]
COALITION = ["coalition", "allied", "allies", "alliance", "combined"]
ALLIED = ["united states", "united kingdom", "british", "commonwealth", "australia", "canada", "new zealand", "soviet", "ussr", "nato", "poland", "free french"]
NEUTRAL = ["indecisive", "draw", "stalemate", "disputed"]
DETAILED = ["decisive_victory", "tactical_victory", "pyrrhic_victory"]
# Words of names.
GENERIC_TOKENS = ["unknown", "none", "n/a", "various", "multiple commanders", "several commanders", "commander", "commanders", "leaders", "pow", "kia", "mia", "wia", "detailed list", "cubicularius"]
NON_PERSON = ["division", "regiment", "corps", "army", "fleet", "force", "police", "committee", "council", "government", "battalion", "brigade", "squad", "air commodore", "general officer commanding", "officer commanding", "high commissioners", "killed in action", "admiral", "commander", "military"]
FLANKS = ["list", "left flank", "right flank", "centre", "center", "other command", "wia", "attacker", "defender"]
RANKS_ONLY = ["admiral", "brigadier", "brigadier general", "captain", "colonel", "colonel general", "commander", "general", "general officer", "lieutenant", "lieutenant colonel", "lieutenant general", "major", "major general", "marshal", "officer"]
SUSPICIOUS_NAME = ["according to", "not reliable", "via social media", "currently no confirmed information", "later ruled", "although", "overall", "captured", "killed during", "unknown", "see ]", "see also", "citation needed", "probably none", "former flag"]
GENERIC_NAMES = ["unknown", "various", "multiple commanders", "several commanders", "general", "major", "brigadier", "colonel", "lieutenant", "captain", "commander", "admiral"]
LANGUAGES = ["ar", "cs", "da", "de", "el", "es", "fa", "fi", "fr", "he", "hu", "it", "ja", "ko", "nl", "pl", "pt", "ro", "ru", "sv", "tr", "uk", "ur", "vi", "zh"]
PERSON_CATEGORY = ["births", "deaths", "people", "biographies", "military personnel", "generals", "admirals", "marshals", "officers", "commanders", "monarchs", "kings", "queens", "princes", "dukes", "earls", "counts", "barons", "nobility", "rulers", "sultans", "khans", "pashas", "emperors", "pharaohs", "chieftains", "viziers", "statesmen", "consuls", "censors", "magistri", "senators", "patricians", "nobles", "politicians"]
NON_PERSON_CATEGORY = ["flags", "emblems", "military units", "regiments", "brigades", "battalions", "divisions", "corps", "armies", "fleets", "navies", "ships", "aircraft", "weapons", "battles", "wars", "campaigns", "operations", "conflicts", "massacres", "sieges", "organizations", "political parties", "political movements", "governments", "states", "countries", "kingdoms", "empires", "republics", "insurgent groups", "observer missions", "geography", "villages", "castles", "districts", "neighborhoods", "newspapers", "websites", "treaties"]
NON_PERSON_TITLE = ["flag", ".svg", "naval flag", "army", "corps", "division", "brigade", "regiment", "battalion", "fleet", "forces", "front", "movement", "government", "kingdom", "empire", "republic", "state", "operation", "campaign", "war", "battle", "siege", "conflict", "observer force", "sultanate", "despotate", "sanjak", "treaty", "press", "media group", "reliefweb", "politico", "castle"]
RANK_PREFIX = r"^(general|gen\.?|lt\. gen\.?|major general|brigadier|brig\.?|admiral|rear admiral|vice admiral|marshal|field marshal|colonel|col\.?|captain|capt\.?)\s+"
FALSE_TITLES = ["air assault", "principles of war", "united nations disengagement observer force", "zhang xiu (warlord)", "popular front for the liberation of palestine - general command", "popular front for the liberation of palestine – general command"]
FALSE_CATEGORY = ["strategy", "tactics", "doctrine", "manual", "observer mission", "observer force", "military unit", "political party", "political movement", "organization", "infantry", "airborne warfare", "aerial warfare"]


class Dialect:
    """The functions whose names or arguments differ between the two languages."""

    def __init__(self, spark: bool):
        self.spark = spark

    def text(self, pattern: str) -> str:
        return f"r'{pattern}'" if self.spark else f"'{pattern}'"

    def like(self, c: str, pattern: str) -> str:
        return f"rlike({c}, {self.text(pattern)})" if self.spark else f"regexp_matches({c}, {self.text(pattern)})"

    def any(self, c: str, words) -> str:
        """Whether any of the words is part of the text."""
        return self.like(c, "|".join(re.escape(w).replace(r"\ ", " ").replace(r"\-", "-") for w in words))

    def hits(self, c: str, words) -> str:
        """How many of the words are parts of the text."""
        return "(" + " + ".join(f"cast(contains({c}, '{w}') as int)" for w in words) + ")"

    def sub(self, c: str, pattern: str, to: str = "") -> str:
        return f"regexp_replace({c}, {self.text(pattern)}, {self.text(to) if to else repr('')}" + (")" if self.spark else ", 'g')")

    def extract(self, c: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({c}, {self.text(pattern)}, {group})"

    def split(self, c: str, pattern: str) -> str:
        return f"split({c}, {self.text(pattern)}, -1)" if self.spark else f"regexp_split_to_array({c}, {self.text(pattern)})"

    def fn(self, spark: str, other: str) -> str:
        return spark if self.spark else other

    def list(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def none(self) -> str:
        return "cast(array() as array<string>)" if self.spark else "[]::varchar[]"

    def filter(self, a: str, x: str, cond: str) -> str:
        return f"filter({a}, {x} -> {cond})" if self.spark else f"list_filter({a}, lambda {x}: {cond})"

    def map(self, a: str, x: str, value: str) -> str:
        return f"transform({a}, {x} -> {value})" if self.spark else f"list_transform({a}, lambda {x}: {value})"

    def set(self, conds) -> str:
        """Names of the conditions that hold, in order."""
        return self.filter(self.list(*(f"case when {c} then '{n}' end" for n, c in conds.items())), "x", "x is not null")

    def size(self, a: str) -> str:
        return f"size({a})" if self.spark else f"len({a})"

    def join(self, a: str, sep: str = " | ") -> str:
        return f"array_join({a}, '{sep}')" if self.spark else f"array_to_string({a}, '{sep}')"

    def unique(self, a: str) -> str:
        """Sorted distinct values."""
        return f"array_sort(array_distinct({a}))" if self.spark else f"list_sort(list_distinct({a}))"

    def flat(self, a: str) -> str:
        return f"flatten({a})" if self.spark else f"flatten({a})"

    def concat(self, *lists: str) -> str:
        return f"concat({', '.join(lists)})" if self.spark else f"list_concat({', '.join(lists)})"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})" if self.spark else f"list_contains({a}, {x})"

    def exists(self, a: str, x: str, cond: str) -> str:
        return f"exists({a}, {x} -> {cond})" if self.spark else f"(len(list_filter({a}, lambda {x}: {cond})) > 0)"

    def least(self, a: str) -> str:
        return f"array_min({a})" if self.spark else f"list_min({a})"

    def at(self, word: str, text: str) -> str:
        """The place of a word in a text, 0 if it is not there."""
        return f"locate({word}, {text})" if self.spark else f"instr({text}, {word})"

    def lookup(self, key: str, values: dict[str, list[str]]) -> str:
        """The list of a key, empty if unknown."""
        return "case " + key + " " + " ".join(f"when '{k}' then {self.list(*(repr(x) for x in v))}" for k, v in values.items()) + f" else {self.none()} end"

    def space(self, c: str) -> str:
        """White space collapsed, references dropped."""
        return f"trim({self.sub(self.sub(c, r'\[[^\]]*\]'), r'\s+', ' ')})"

    def words(self, c: str) -> str:
        """Lower-case letters and digits with a blank on either side of each word."""
        return f"concat(' ', trim({self.sub(f'lower({c})', '[^a-z0-9]+', ' ')}), ' ')"


SPARK, OTHER = Dialect(True), Dialect(False)


# --- pages -------------------------------------------------------------------------------------------


def is_list(d: Dialect, t: str = "t", c: str = "cats", links: str = "n_links") -> str:
    """A page of links to engagements, by title, categories or number of links."""
    return f"({d.any(t, LIST_TITLES)} or ({d.any(t, LISTS)} and ({d.any(t, CONTEXT)} or {d.any(c, CONTEXT)})) or {d.any(c, ['lists of battles', 'battle-related lists', 'military history lists'])} or (starts_with_list and {d.any(t, ['military', 'war', 'battle', 'siege', 'conflict'])}) or ({d.any(t, CONTEXT)} and {links} >= 30))".replace("starts_with_list", d.like(t, "^list of "))


def scores(d: Dialect) -> dict[str, str]:
    """The six additive scores over lower-case t (title) and cats, box (battle infobox), kind (other infobox), n_links."""
    one = lambda cond, n: f"case when {cond} then {n} else 0 end"
    return {
        "list_score": one(is_list(d), 4),
        "battle_score": " + ".join([one(d.any("t", BATTLE_TITLE), 2), one(d.any("cats", BATTLE_CATEGORY), 3), one("box", 4)]),
        "campaign_score": one(f"{d.any('t', CAMPAIGN_TITLE)} or {d.any('cats', CAMPAIGN_CATEGORY)}", 3),
        "war_score": " + ".join([one(d.any("t", WAR_TITLE), 3), one(f"{d.any('cats', WAR_CATEGORY)} and not box", 2)]),
        "person_score": " + ".join([one(d.any("cats", BIOGRAPHY), 4), one("kind = 'person'", 5)]),
        "other_score": " + ".join([one(d.any("t", SUPPORT), 6), one(f"{d.any('t', NON_BATTLE)} and not box", 3), one("kind = 'military unit'", 4)]),
    }


def page_type(d: Dialect) -> str:
    """The first rule that holds over the scores."""
    battle, war = d.any("t", EXPLICIT_BATTLE), d.any("t", WAR_TITLE)
    operation, campaign = d.any("t", ["operation", "offensive"]), d.any("t", ["campaign", "expedition", "theater", "theatre", "front"])
    return f"""case when list_score >= greatest(battle_score, campaign_score, war_score, person_score, other_score) then 'list_page' when person_score >= greatest(battle_score, campaign_score, war_score, other_score) then 'biography_page'
      when other_score >= greatest(battle_score, campaign_score, war_score) then 'non_battle_military_page' when {war} and not {battle} then 'war_conflict_article' when {operation} and not {battle} then 'operation_article' when {campaign} and not {battle} then 'campaign_article'
      when ({operation} or {d.any('cats', ['operations', 'offensives'])}) and campaign_score >= greatest(battle_score, war_score, 2) then 'operation_article' when box or {battle} or battle_score >= greatest(campaign_score, war_score, 3) then 'battle_article'
      when campaign_score >= greatest(battle_score, war_score, 2) then 'campaign_article' when war_score >= 2 then 'war_conflict_article' else 'uncertain_military_page' end"""


def page_reasons(d: Dialect) -> str:
    return d.set({
        "list-page signals": is_list(d), "battle-like title": d.any("t", BATTLE_TITLE), "battle categories": d.any("cats", BATTLE_CATEGORY), "battle infobox structure": "box", "support page": d.any("t", SUPPORT),
        "campaign signals": f"{d.any('t', CAMPAIGN_TITLE)} or {d.any('cats', CAMPAIGN_CATEGORY)}", "war title": d.any("t", WAR_TITLE), "biography categories": d.any("cats", BIOGRAPHY),
    })


def metadata_type(d: Dialect) -> str:
    """The type from title and categories alone: support pages leave, what the classifier (column page) refuses may pass by its title."""
    return f"""case when {d.any('t', SUPPORT)} then 'non_battle_military_page' when page like '%\\_article' escape '\\' then page when {d.any('t', ['battle', 'siege', 'skirmish', 'raid', 'massacre'])} then 'battle_article' when {d.any('t', ['war', 'conflict', 'insurgency', 'rebellion'])} then 'war_conflict_article'
      when {d.any('t', ['operation', 'offensive'])} then 'operation_article' when {d.any('t', ['campaign', 'expedition'])} then 'campaign_article' else page end""".replace("\\_article' escape '\\'", "_article'")


def battle_type(d: Dialect) -> str:
    return f"""case when contains(t, 'siege') or contains(cats, 'siege') then 'siege' when contains(t, 'naval battle') or contains(cats, 'naval') or (contains(t, 'sea') and contains(t, 'battle')) then 'naval_battle' when {d.any('t', ['operation', 'offensive'])} then 'operation'
      when {d.any('t', ['campaign', 'theater', 'theatre', 'front', 'expedition'])} then 'campaign_like_engagement' when {d.any("concat(t, ' ', cats)", ['raid'])} then 'raid' when {d.any("concat(t, ' ', cats)", ['rebellion', 'revolt', 'uprising'])} then 'uprising' when {d.any("concat(t, ' ', cats)", ['skirmish'])} then 'skirmish'
      when {d.any("concat(t, ' ', cats)", ['massacre'])} then 'massacre' when {d.any('t', ['battle', 'engagement', 'landing', 'assault', 'combat'])} then 'land_battle' when {d.any("concat(' ', t)", [' war', 'wars', 'conflict', 'insurgency'])} then 'war_conflict' else 'land_battle' end"""


def source_family(d: Dialect) -> str:
    dated = d.like("t", r"\b(before|after)\s+\d{2,4}\b") + " or " + d.like("t", r"\b\d{2,4}\s*[–-]\s*\d{2,4}\b")
    return f"case when {dated} then 'period_based' " + " ".join(f"when {d.any('t', w)} then '{k}'" for k, w in FAMILIES.items()) + f" when {d.any('t', LISTS)} then 'list_misc' else 'general_military' end"


def link_score(d: Dialect) -> str:
    """The additive score of a candidate link (title, anchor); 0 for pages that can be no engagement."""
    broad = sorted({*BATTLE_TITLE, *WAR_TITLE, *CAMPAIGN_TITLE})
    refused = f"{d.like('title', '^(' + '|'.join(META) + ')')} or {d.any('t', LISTS)} or {d.any('t', SUPPORT)} or {d.like('t', r'^\d{3,4}(\s*bc|\s*bce|\s*ce)?$')}"
    named = f"contains(t, ' of ') and {d.any('t', ['battle', 'siege', 'raid', 'skirmish', 'operation', 'war', 'campaign', 'conflict'])}"
    parts = [f"case when {d.any('t', broad)} then 3 else 0 end", f"case when {named} then 2 else 0 end", f"case when {d.any('lower(anchor)', broad)} then 1 else 0 end", f"case when {d.like('t', r'\bwar\b|\bcampaign\b|\bconflict\b|\boffensive\b')} then 1 else 0 end"]
    total = " + ".join(parts)
    return f"case when {refused} then 0 when {total} = 0 and {d.like('title', r'^\d{3,4}')} then 1 else {total} end"


def fetch_error(d: Dialect, c: str) -> str:
    return f"case when {d.any(c, ['429', 'rate limit', 'too many requests'])} then 'rate_limit' when {d.any(c, ['403', 'protected', 'permission'])} then 'protection' when {d.any(c, ['missingtitle', 'unable to parse page', '404'])} then 'missing_or_unavailable' else 'fetch_error' end"


# --- results -----------------------------------------------------------------------------------------


def repaired(d: Dialect, c: str) -> str:
    """Text that a citation ran into, cut apart where case or digits change."""
    out = d.sub(d.sub(d.sub(c, "([a-z])([A-Z])", d.fn("$1 $2", r"\1 \2")), "([A-Za-z])([0-9])", d.fn("$1 $2", r"\1 \2")), "([0-9])([A-Za-z])", d.fn("$1 $2", r"\1 \2"))
    return f"trim({d.sub(out, r'\s+', ' ')})"


def result_type(d: Dialect, c: str, patterns) -> str:
    return "case " + " ".join(f"when {d.like(c, p)} then '{n}'" for n, p in patterns) + " else 'unknown' end"


def scoring_result(d: Dialect, patterns) -> tuple[str, str]:
    """Type and source: the stored type, what the repaired text says, a few phrases, else unknown. Columns: result, stored, fixed (repaired result)."""
    found = result_type(d, "fixed", patterns)
    phrase = d.any("lower(fixed)", ["allied operational success", "allied partial success", "allied occupation"])
    kind = f"case when stored not in ('', 'unknown') then stored when {found} <> 'unknown' then {found} when {phrase} then 'tactical_victory' when stored <> '' then stored when result <> '' then 'unknown' else '' end"
    source = f"case when stored not in ('', 'unknown') then 'stored' when {found} <> 'unknown' then 'sanitized_result_raw' when {phrase} then 'scoring_specific_override' else 'stored_unknown' end"
    return kind, source


def clean_result(d: Dialect) -> str:
    """The text of a result, or its type's label where the text tells a story. Columns: result, kind."""
    labels = "case kind when 'unknown' then '' else concat(upper(substr(kind, 1, 1)), replace(substr(kind, 2), '_', ' ')) end"
    return f"case when {d.any('lower(result)', SUSPICIOUS_RESULT)} or length(result) > 120 then {labels} else result end"


def entities(d: Dialect, c: str) -> str:
    """The belligerents of a cell, cleaned; repeated ones and stop words go."""
    part = d.sub(d.sub(d.sub(d.sub("p", r"(?i)\b\w+\.svg\b"), r"(?i)\b\d+px\b"), r"\([^)]*\)"), "[\"“”‘’]")
    clean = d.map(d.split(c, r"[\n|;/]+"), "p", d.space(part))
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    kept = d.filter(clean, "e", f"e <> '' and lower(e) not in ({stop})")
    return f"array_distinct({kept})" if d.spark else f"list_filter({kept}, lambda e, i: list_position({kept}, e) = i)"


def tokens(d: Dialect, names: str) -> str:
    """All that a result may call these entities: names, their longer words, and aliases of words and phrases; sorted."""
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    plain = d.map(names, "e", f"trim({d.words('e')})")
    longer = lambda e: d.filter(d.split(e, " "), "w", f"length(w) >= 4 and w not in ({stop})")
    known = lambda e: d.flat(d.map(longer(e), "w", d.lookup("w", ALIASES)))
    phrases = lambda e: d.flat(d.list(*(f"case when contains({e}, '{k}') then {d.list(*(repr(x) for x in v))} else {d.none()} end" for k, v in PHRASES.items())))
    every = d.flat(d.map(plain, "e", d.concat(d.list("e"), longer("e"), known("e"), phrases("e"))))
    return d.unique(d.filter(every, "x", "length(x) >= 4"))


def coalition(d: Dialect, raw: str, names: str) -> str:
    return f"({d.size(names)} >= 2 or contains({raw}, '*') or {d.any(f'lower({raw})', COALITION)})"


def winner(d: Dialect) -> tuple[str, str]:
    """Side and method. Columns: r (words of the result), kind, raw_a, raw_b, ents_a, ents_b, tok_a, tok_b (tokens)."""
    lost = lambda s: d.exists(f"tok_{s}", "x", f"contains(r, concat(' anti ', x, ' ')) or contains(r, concat(' against ', x, ' '))")
    met = lambda s: d.exists(f"tok_{s}", "x", "contains(r, concat(' ', x, ' '))")
    allied = lambda s: d.any(f"lower(raw_{s})", ALLIED)
    marks = "(contains(r, ' allied ') or contains(r, ' coalition '))"
    hint = d.any("r", COALITION)
    label = lambda s: d.any(f"lower(raw_{s})", COALITION)
    col = lambda s: coalition(d, f"raw_{s}", f"ents_{s}")
    idle = f"trim(r) = '' or kind in ('', 'unknown', {', '.join(repr(x) for x in NEUTRAL)})"
    rules = [
        (idle, None, "unresolved"),
        (f"{lost('a')} and not {lost('b')}", "side_b", "negated_target_match"),
        (f"{lost('b')} and not {lost('a')}", "side_a", "negated_target_match"),
        (f"{marks} and {allied('a')} and not {allied('b')}", "side_a", "allied_marker_match"),
        (f"{marks} and {allied('b')} and not {allied('a')}", "side_b", "allied_marker_match"),
        (f"{met('a')} and not {met('b')}", "side_a", "unique_belligerent_match"),
        (f"{met('b')} and not {met('a')}", "side_b", "unique_belligerent_match"),
        (f"{hint} and {label('a')} and not {label('b')}", "side_a", "coalition_label_match"),
        (f"{hint} and {label('b')} and not {label('a')}", "side_b", "coalition_label_match"),
        (f"{hint} and {col('a')} and not {col('b')}", "side_a", "coalition_side_heuristic"),
        (f"{hint} and {col('b')} and not {col('a')}", "side_b", "coalition_side_heuristic"),
        (f"{hint} and {d.size('ents_a')} >= {d.size('ents_b')} + 2", "side_a", "coalition_strength_heuristic"),
        (f"{hint} and {d.size('ents_b')} >= {d.size('ents_a')} + 2", "side_b", "coalition_strength_heuristic"),
    ]
    side = "case " + " ".join(f"when {c} then {repr(s) if s else 'null'}" for c, s, _ in rules) + " end"
    method = "case " + " ".join(f"when {c} then '{m}'" for c, _, m in rules) + " else 'unresolved' end"
    return side, method


def outcome() -> tuple[str, str]:
    """Category and how sure. Columns: explicit, kind, side, win_side."""
    neutral, detailed = (", ".join(f"'{x}'" for x in w) for w in (NEUTRAL, DETAILED))
    rules = [
        (f"explicit in ({neutral})", "explicit", "high"), (f"explicit = 'victory' and kind in ({detailed})", "kind", "high"), ("explicit = 'victory'", "'victory'", "high"), ("explicit = 'defeat' and kind = 'decisive_victory'", "'major_defeat'", "high"), ("explicit = 'defeat'", "'defeat'", "high"),
        (f"kind in ({neutral})", "kind", "high"), (f"win_side = side and kind in ({detailed})", "kind", "medium"), ("win_side = side", "'victory'", "medium"), ("win_side is not null and kind = 'decisive_victory'", "'major_defeat'", "medium"), ("win_side is not null", "'defeat'", "medium"),
    ]
    return ("case " + " ".join(f"when {c} then {v}" for c, v, _ in rules) + " else 'unknown' end", "case " + " ".join(f"when {c} then '{s}'" for c, _, s in rules) + " else 'low' end")


def conservative_outcome(d: Dialect) -> str:
    """What a result says on its face: a neutral beginning, or the one victory of a faction that stands on one side only. Columns: result, side, raw_a, raw_b; null where it says nothing."""
    low = "lower(trim(result))"
    neutral = " ".join(f"when {d.like(low, '^' + p)} then '{o}'" for p, o in NEUTRAL_PREFIXES.items())
    count = f"({d.size(d.split(low, ' victory'))} + {d.size(d.split(low, ' operational success'))} - 2)"
    won = []
    for label, alias in FACTIONS.items():
        on = {s: "(" + " or ".join(f"contains({d.words(f'raw_{s}')}, ' {x} ')" for x in alias) + ")" for s in "ab"}
        won.append(f"when {d.like(low, '^' + label.replace('.', '[.]') + ' (victory|operational success)')} then case when {on['a']} = {on['b']} then null when {on['a']} = (side = 'side_a') then 'victory' else 'defeat' end")
    return f"case when side = 'multiple_sides' or {low} = '' then null {neutral} when {count} <> 1 or contains({low}, ' first ') or contains({low}, ' second ') then null {' '.join(won)} end"


def admissible(old: str, new: str) -> str:
    """Whether an inferred outcome may replace a stored one: it must be more careful."""
    return f"coalesce({new} <> {old} and ({old} = 'unknown' or ({old} = 'victory' and {new} = 'defeat') or ({old} in ('indecisive', 'stalemate') and {new} = 'defeat')), false)"


# --- names -------------------------------------------------------------------------------------------


def clean_name(d: Dialect, raw: str, belligerent: str) -> str:
    """A commander's name without brackets, pictures, quotes, rank, belligerent and language marks."""
    bare = d.sub(d.sub(d.sub(d.sub(d.sub(raw, r"\[[^\]]*\]"), r"\([^)]*\)"), r"(?i)\b\d+px\b"), r"(?i)\.svg\b"), "[“”\"]")
    ranked = d.sub(f"trim({d.sub(bare, r'\s+', ' ')})", "(?i)" + RANK_PREFIX)
    own = f"case when {belligerent} <> '' and {d.fn('startswith', 'starts_with')}(lower({ranked}), concat(lower({belligerent}), ' ')) then substr({ranked}, length({belligerent}) + 2) else {ranked} end"
    marks = "|".join(LANGUAGES)
    edges = d.sub(d.sub(own, rf"(?i)^(({marks})(\s+|$))+"), rf"(?i)((^|\s+)({marks}))+$")
    return f"trim({d.sub(d.sub(edges, r'\s+', ' '), r'^[ ,;:/|-]+|[ ,;:/|-]+$')})"


def is_generic(d: Dialect, name: str) -> str:
    """Values that name no person."""
    low = f"lower({name})"
    words = ", ".join(f"'{w}'" for w in [*GENERIC_TOKENS, *FLANKS])
    return f"(length({d.sub(low, '[^a-zà-öø-ÿ]')}) < 2 or {low} in ({words}) or {d.any(low, NON_PERSON)} or {d.like(low, ':$')} or ({d.like(low, '[0-9]')} and not {d.like(low, r'\b(i|ii|iii|iv|v|vi|vii|viii|ix|x)\b')}))"


def name_blockers(d: Dialect, raw: str, name: str, linked: str) -> str:
    low, rlow = f"lower({name})", f"lower({raw})"
    ranks = ", ".join(f"'{w}'" for w in RANKS_ONLY)
    picture = rf"\.(svg|png)|\b\d+px\b|\bflag\b"
    found = d.set({
        "generic_commander_value": is_generic(d, name), "generic_rank_only_name": f"{low} in ({ranks})", "graphic_artifact": f"{d.like(rlow, picture)} or {d.like(low, picture)}", "name_too_long": f"length({name}) > 80",
        "narrative_text_artifact": f"{d.any(rlow, SUSPICIOUS_NAME)} or {d.any(low, SUSPICIOUS_NAME)}", "quoted_single_token_alias": f"contains({raw}, '\"') and not contains({name}, ' ')", "title_only_short_name": f"not {linked} and not contains({name}, ' ') and {d.like(rlow, '^colonel ')}",
        "too_many_tokens": f"length({name}) - length(replace({name}, ' ', '')) >= 10", "unbroken_multi_value_name": f"contains({name}, '|')",
    })
    return f"case when {name} = '' then {d.list(repr('empty_name'))} else {found} end"


def page_class(d: Dialect, title: str, cats: str) -> str:
    """person, nonperson or uncertain, by a linked page's title and categories."""
    t = f"lower({title})"
    p, n = d.hits(cats, PERSON_CATEGORY), d.hits(cats, NON_PERSON_CATEGORY)
    return f"case when {d.like(t, '^:|^[a-z]{2,5}:')} or {d.any(t, NON_PERSON_TITLE)} then 'nonperson' when {p} > 0 and {p} >= {n} then 'person' when {n} = 1 and {p} = 0 then 'uncertain' when {n} > 0 then 'nonperson' else 'uncertain' end"


def conflicts(d: Dialect, title: str, belligerent: str) -> str:
    """Whether a link's title is the belligerent itself."""
    t, b = f"lower({title})", f"lower({belligerent})"
    return f"({t} <> '' and {b} <> '' and (contains({b}, {t}) or contains({t}, {b})))"


def suspect_identity(d: Dialect, name: str) -> str:
    low = f"lower({name})"
    return f"({low} = '' or length({low}) > 90 or {d.any(low, ['.svg', 'flag of', 'naval jack'])} or {low} in ({', '.join(repr(w) for w in GENERIC_NAMES)}) or length({low}) - length(replace({low}, ',', '')) > 5)"


def name_match(d: Dialect, raw: str, candidate: str) -> str:
    """Equal, or one word of six letters that is the candidate's last."""
    last = d.sub(f"lower({candidate})", "^.* ")
    return f"({raw} <> '' and {candidate} <> '' and (lower({raw}) = lower({candidate}) or (not contains({raw}, ' ') and contains({candidate}, ' ') and length({raw}) >= 6 and lower({raw}) = {last})))"


# --- rows --------------------------------------------------------------------------------------------


def row_blockers(d: Dialect, patterns) -> str:
    """What keeps a page's row out of the main table. Columns: title, t, cats, kind, page, date_raw, result, raw_a, raw_b, place, box, year."""
    evidence = " + ".join(f"cast({c} as int)" for c in ("(raw_a <> '' and raw_b <> '')", "(cell <> '')", "(place <> '')", "(war <> '')", "(kind <> 'unknown')", "box"))
    false = ", ".join(f"'{w}'" for w in FALSE_TITLES)
    found = result_type(d, "result", patterns)
    return d.set({
        "disallowed_page_type": "page not in ('battle_article', 'war_conflict_article', 'campaign_article', 'operation_article')", "known_false_positive": f"t in ({false})", "generic_category_signal": d.any("cats", FALSE_CATEGORY),
        "no_event_specific_fields": "not box and concat(date_raw, result, raw_a, raw_b, cell, place, war) = ''", "biography_title_signal": "contains(t, '(warlord)')", "missing_date": "trim(date_raw) = ''", "suspicious_date_text": d.any("lower(date_raw)", SUSPICIOUS_DATE),
        "unparsed_year": "trim(date_raw) <> '' and year is null", "year_out_of_range": "trim(date_raw) <> '' and (year < 1 or year > 2100)", "unsupported_result_text": f"kind <> 'unknown' and {found} = 'unknown'", "result_type_mismatch": f"kind <> 'unknown' and {found} <> kind",
        "insufficient_source_evidence": f"{evidence} < 2", "no_infobox_and_no_result": "not box and kind = 'unknown'",
    })


STRONG = ["known_false_positive", "no_event_specific_fields", "biography_title_signal"]
GENERIC = [*STRONG, "generic_category_signal"]

# Pages that are no persons, and broad titles.
NON_PERSON_PAGES = ["Manner of death", "Al-Masdar News", "Wounded in action", "Battle group", "Newsweek", "Kommersant"]
NON_PERSON_LINKS = r"^list_of_|(^|_)(ministry|news|news_agency|media|mission|organization|commission|commissioner|agency|group|trust|times)(_|$)|^tass$"


def non_person_link(d: Dialect, name: str, link: str) -> str:
    """Whether a name or its link leads to no person."""
    low = f"lower(replace({link}, ' ', '_'))"
    return f"({name} in ({', '.join(repr(x) for x in NON_PERSON_PAGES)}) or {link} in ({', '.join(repr(x) for x in NON_PERSON_PAGES)}) or {d.like(f'lower({name})', '^commissioner ')} or {d.like(low, NON_PERSON_LINKS)})"


def mentions(d: Dialect, title: str, name: str) -> str:
    """Whether a title names an entity: whole, or by one of its first three words, of five letters or more."""
    t, n = f"lower({title})", f"lower({name})"
    words = d.filter(d.split(n, "[^a-z0-9]+"), "w", "w not in ('', 'the', 'of', 'and')")
    first = f"slice({words}, 1, 3)" if d.spark else f"({words})[1:3]"
    return f"({t} <> '' and {n} <> '' and (contains({t}, {n}) or {d.exists(first, 'w', f'length(w) >= 5 and contains({t}, w)')}))"


def evidence_score() -> str:
    """0 to 10: how much a row says. Columns: box, date_raw, kind, raw_a, raw_b, cell, place, war."""
    parts = {"box": 2, "trim(date_raw) <> ''": 2, "kind <> 'unknown'": 1, "raw_a <> '' and raw_b <> ''": 2, "cell <> ''": 1, "place <> ''": 1, "war <> ''": 1}
    return " + ".join(f"case when {c} then {n} else 0 end" for c, n in parts.items())


def side_result(d: Dialect) -> str:
    """A side's own result: neutral kinds as they are, else by the first side of which a part stands in the result. Columns: side, kind, result, raw_a, raw_b."""
    part = lambda s: d.exists(d.map(d.split(f"raw_{s}", "[,/|]"), "p", "lower(trim(p))"), "x", "length(x) > 3 and contains(lower(result), x)")
    neutral = ", ".join(f"'{x}'" for x in NEUTRAL)
    return f"case when kind in ('', 'unknown') then 'unknown' when kind in ({neutral}) then kind when {part('a')} then case when side = 'side_a' then 'victory' else 'defeat' end when {part('b')} then case when side = 'side_b' then 'victory' else 'defeat' end else 'unknown' end"
