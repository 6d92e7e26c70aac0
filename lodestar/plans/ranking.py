"""Ranking models over the engagement fact: one pass computes all metric sets, one window per component ranks all models."""

from __future__ import annotations

import hashlib
import inspect
import sys
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions import scores
from lodestar.functions.scores import ERAS, OUTCOME_SCORES, OVERLAP_PENALTY, PAGE_WEIGHTS, SHRINK, cap_factor, ladder, mapped, ratio, score_tier, steady
from lodestar.operators import windows
from lodestar.operators.relational import join_flags
from lodestar.operators.tables import kept_table, shared_table
from lodestar.operators.windows import any_over, ordered_ranks, percentile_ranks, top_by
from lodestar.plans import binding
from lodestar.plans.binding import FACT, engagements, table
from lodestar.plans.registry import query

BATTLE, OPERATION, CAMPAIGN, WAR = PAGE_WEIGHTS
#: Metric sets: row weight, outcome scores, presence factor, outcome credit.
SETS = {"a": ("battle_only", "conservative", "full", "split"), "b": ("strict", "balanced", "full", "split"), "c": ("strict", "balanced", "full", "full"), "d": ("strict", "balanced", "split", "split"), "e": ("balanced", "balanced", "full", "split")}
#: Gates whose rows are summed apart.
GATES = ("strict", "balanced")
#: Models: metric set and cohort rule.
MODELS = {
    "baseline_conservative": ("a", "baseline"),
    "battle_only_baseline": ("a", "battle_only"),
    "hierarchical_weighted": ("b", "hierarchical"),
    "hierarchical_trust_v2": ("b", "trust"),
    "hierarchical_full_credit": ("c", "hierarchical"),
    "hierarchical_equal_split": ("d", "hierarchical"),
    "hierarchical_broader_eligibility": ("e", "hierarchical"),
}
#: Component weights by cohort rule.
WEIGHTS = {
    "baseline": {"outcome": 0.60, "depth": 0.25, "reliability": 0.15},
    "battle_only": {"outcome": 0.75, "depth": 0.25},
    "hierarchical": {"outcome": 0.45, "scope": 0.20, "temporal": 0.15, "centrality": 0.10, "higher": 0.06, "evidence": 0.04},
    "trust": {"outcome": 0.32, "sustained": 0.18, "scope": 0.18, "temporal": 0.12, "centrality": 0.10, "higher": 0.06, "evidence": 0.04},
}
TRUSTED = [m for m in MODELS if m != "hierarchical_full_credit"]


def _code() -> str:
    """A digest of the code that the kept fact comes from, so that another version makes its own."""
    return hashlib.sha256("".join(inspect.getsource(m) for m in (scores, windows, binding, sys.modules[__name__])).encode()).hexdigest()


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engagements with group sizes by side, as a table kept for all that reads the same sources.

    It is written as it lies by commander and conflict, so what groups by them finds their rows together.
    """

    def made() -> DataFrame:
        side = Window.partitionBy("page_id", "side")
        sized = engagements(spark, sf_dir).withColumns({"side_n": F.count("*").over(side), "known_n": F.count_if(F.col("outcome") != "unknown").over(side)})
        return sized.repartition("commander_id", "conflict")

    return kept_table(spark, "fact", [f"{sf_dir}/{t}.parquet" for t in binding.SOURCES], _code(), made)


def _rows_of(gate: str) -> str:
    """The gate whose sums serve this one: battles alone are strict rows."""
    return "strict" if gate == "battle_only" else gate


def _typed(rows: DataFrame) -> DataFrame:
    """The fact's rows with presence, credit and outcome scores."""
    rows = rows.withColumns({"valid": F.col("side") != "multiple_sides", "known": F.col("outcome") != "unknown"})
    valid, known = F.col("valid"), F.col("valid") & F.col("known")
    return rows.withColumns(
        {
            "presence_full": F.when(valid, 1.0).otherwise(0.0),
            "presence_split": F.when(valid, 1.0 / F.col("side_n")).otherwise(0.0),
            "credit_full": F.when(known, 1.0).otherwise(0.0),
            "credit_split": F.when(known, 1.0 / F.sqrt(F.col("known_n").cast("double"))).otherwise(0.0),
            **{f"score_{k}": mapped(F.col("outcome"), v) for k, v in OUTCOME_SCORES.items()},
        }
    )


def weight_of(gate: str) -> Column:
    """The weight of the rows that pass the gate: their kind's, less where the conflict has a battle of the same commander."""
    kind = F.col("page_type")
    return mapped(kind, PAGE_WEIGHTS) * F.when((kind != BATTLE) & F.col(f"anchor_{gate}"), OVERLAP_PENALTY).otherwise(1.0)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed fact: group sizes by side, battle anchors, page weights with overlap penalties, outcome scores."""
    battle = F.col("page_type") == BATTLE
    rows = fact(spark, sf_dir).withColumns({f"anchor_{g}": any_over(F.col(g) & battle, "commander_id", "conflict") for g in GATES})
    weights = {"weight_battle_only": F.when(F.col("strict") & battle, 1.0).otherwise(0.0), **{f"weight_{g}": F.when(F.col(g), weight_of(g)).otherwise(0.0) for g in GATES}}
    return _typed(rows).withColumns(weights)


def _marks(value: Column, names: list[str]) -> Column:
    """One bit for each of a few known names; bits of a group are or-ed and counted, which says how many it has."""
    return mapped(value, {name: 1 << k for k, name in enumerate(names)}, 0)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the rows of a commander, conflict and kind of page, kept for all that sums by commander.

    A weight is the same for all rows of a cell that pass its gate, so sums are kept without it. Of a conflict's cells with rows
    the first is its head, by which conflicts are counted.
    """
    kind, strict = F.col("page_type"), F.col("strict")
    kinds = {"coalition": F.col("known_n") >= 4, "split": F.col("known_n") >= 3, "siege": F.col("page_id") % 7 == 0, "corrected": F.col("n_lines") > 1}
    bit = _marks(F.col("era"), [*ERAS, "contemporary"])
    sums: dict[str, Column] = {}
    for g in GATES:
        on = F.col(g)
        year, inner = F.when(on, F.col("year")), F.when(on & strict & (kind != WAR), F.col("year"))
        sums |= {f"n_{g}": F.count_if(on), f"k_{g}": F.count_if(on & F.col("known")), f"fy_{g}": F.min(year), f"ly_{g}": F.max(year), f"lo_{g}": F.min(inner), f"hi_{g}": F.max(inner)}
    for gate, outcome, presence, credit in SETS.values():
        g = _rows_of(gate)
        of = lambda v: F.sum(F.when(F.col(g), v).otherwise(0.0))  # noqa: B023, E731
        sums |= {f"p_{g}_{presence}": of(F.col(f"presence_{presence}")), f"o_{g}_{credit}": of(F.col(f"credit_{credit}")), f"v_{g}_{credit}_{outcome}": of(F.col(f"credit_{credit}") * F.col(f"score_{outcome}"))}
    v = F.abs(F.col("credit_split") * F.col("score_balanced"))
    sums["e_balanced"] = F.bit_or(F.when(F.col("balanced"), bit))  # of strict rows eras are counted
    sums["signal"] = F.sum(F.when(strict, F.when(v > 0, v).otherwise(0.15 * F.col("presence_full"))).otherwise(0.0))
    sums |= {f"n_{k}": F.count_if(strict & c) for k, c in kinds.items()} | {f"e_{e}": F.count_if(strict & (F.col("era") == e)) for e in [*ERAS, "contemporary", "unknown"]}

    def made() -> DataFrame:
        rows = _typed(fact(spark, sf_dir).filter("strict or balanced")).groupBy("commander_id", "conflict", "page_type").agg(*(v.alias(k) for k, v in sums.items()))
        own = Window.partitionBy("commander_id", "conflict")
        marks = {f"anchor_{g}": F.coalesce(F.max(F.when(kind == BATTLE, F.col(f"n_{g}"))).over(own), F.lit(0)) > 0 for g in GATES}
        return rows.withColumns(marks | {f"head_{g}": F.col("conflict").isNotNull() & (F.col(f"n_{g}") > 0) & (kind == F.min(F.when(F.col(f"n_{g}") > 0, kind)).over(own)) for g in GATES})

    return kept_table(spark, "cells", [f"{sf_dir}/{t}.parquet" for t in binding.SOURCES], _code(), made)


def _eras(gate: str) -> Column:
    """A bit for each era of a cell's rows."""
    names = [*ERAS, "contemporary"]
    return F.col("e_balanced") if gate == "balanced" else sum((F.when(F.col(f"e_{e}") > 0, 1 << k).otherwise(0) for k, e in enumerate(names)), F.lit(0))


def metrics(rows: DataFrame, sets: list[str]) -> DataFrame:
    """The given metric sets from the cells: sums of all sets lie side by side in one grouping by commander, and only its rows are exploded to sets."""
    made: dict[str, Column] = {}

    def part(name: str, value: Column) -> Column:
        made[name] = value
        return F.col(name)

    kind = F.col("page_type")
    structs = []
    for name in sets:
        gate, outcome, presence, credit = SETS[name]
        g = _rows_of(gate)
        in_ = (kind == BATTLE) if gate == "battle_only" else kind.isin(*PAGE_WEIGHTS)
        w = weight_of(g)
        of = lambda c, cond=in_: F.when(cond, F.col(c) if isinstance(c, str) else c)
        total = lambda v: F.coalesce(F.sum(v), F.lit(0))
        p, o, v = f"p_{g}_{presence}", f"o_{g}_{credit}", f"v_{g}_{credit}_{outcome}"
        n = {k: part(f"n_{gate}_{k}", total(of(f"n_{g}", in_ & (kind == k)))) for k in PAGE_WEIGHTS}
        own = {
            "engagements": part(f"n_{gate}", total(of(f"n_{g}"))), "battles": n[BATTLE], "operations": n[OPERATION], "campaigns": n[CAMPAIGN], "wars": n[WAR],
            "known": part(f"k_{gate}", total(of(f"k_{g}"))), "known_battles": part(f"kb_{gate}", total(of(f"k_{g}", kind == BATTLE))),
            "presence": part(f"{gate}_{p}", total(of(w * F.col(p)))), "nonbattle": part(f"{gate}_{p}_far", total(of(w * F.col(p), in_ & (kind != BATTLE)))),
            "outcome_weight": part(f"{gate}_{o}", total(of(w * F.col(o)))), "outcome_value": part(f"{gate}_{v}", total(of(w * F.col(v)))),
            "conflicts": part(f"c_{gate}", F.count_if(in_ & (F.col("conflict").isNotNull() & (F.col(f"n_{g}") > 0) if gate == "battle_only" else F.col(f"head_{g}")))),
            "first_year": part(f"fy_{gate}", F.min(of(f"fy_{g}"))), "lo": part(f"lo_{gate}", F.min(of(f"lo_{g}"))), "last_year": part(f"ly_{gate}", F.max(of(f"ly_{g}"))), "hi": part(f"hi_{gate}", F.max(of(f"hi_{g}"))),
            "page_types": sum(((c > 0).cast("int") for c in n.values()), F.lit(0)), "eras": F.bit_count(part(f"e_{gate}", F.bit_or(of(_eras(g))))),
        }
        structs.append(F.struct(F.lit(name).alias("set"), *(v.alias(k) for k, v in own.items())))
    out = rows.groupBy("commander_id").agg(*(v.alias(k) for k, v in made.items()))
    out = out.select("commander_id", F.explode(F.array(*structs)).alias("s")).filter("s.engagements > 0").select("commander_id", "s.*")
    n = F.col("engagements")
    return out.withColumns(
        {
            "outcome_mean": ratio(F.col("outcome_value"), F.col("outcome_weight")),
            "higher_share": steady(ratio(F.col("nonbattle"), F.col("presence"))),
            "known_share": F.col("known") / n,
            "known_battle_share": ratio(F.col("known_battles"), F.col("battles")),
            "span": F.coalesce(F.col("hi") - F.col("lo"), F.col("last_year") - F.col("first_year")),
            **{f"{k}_share": F.col(f"{k}s") / n for k in ("battle", "operation", "campaign", "war")},
        }
    )


def guardrail(trust: Column) -> Column:
    """The least of the factors whose condition holds; two more apply to the trust model."""
    high, share, known, kb, b = (F.col(c) for c in ("higher_share", "known_share", "known", "known_battles", "battles"))
    rules = [((high >= 0.5) & (share < 0.4), 0.95), ((known < 8) & (share < 0.5) & (high >= 0.35), 0.95), ((high >= 0.5) & (kb < 2) & (b < 4), 0.92), (trust & (known < 8) & (b < 8), 0.97), (trust & ((known < 6) | (kb < 3)), 0.94)]
    return F.least(F.lit(1.0), *(F.when(c, f).otherwise(1.0) for c, f in rules))


def profile_class() -> Column:
    battle, operation, broad = F.col("battle_share"), F.col("operation_share"), F.col("campaign_share") + F.col("war_share")
    return F.when(battle >= 0.7, "battle_dominant").when((broad >= 0.5) & (broad > battle), "war_campaign_heavy").when(operation >= 0.4, "operation_heavy").otherwise("mixed_profile")


#: Components of each weight that is itself a mean.
PARTS = {"scope": ["scope_conflict", "scope_type", "scope_era"]}


def ranked(spark: SparkSession, sf_dir: str, models: list[str] | None = None) -> DataFrame:
    """The ranking of the given models, or of all, in long form. Components are percentile ranks inside the model's own cohort.

    Only the metric sets and components of these models are made. The cohorts, a row a model and commander, are written
    once, as they are read for the components, their ranks and the scores.
    """
    models = models or list(MODELS)
    used = sorted({MODELS[m][0] for m in models})
    config = spark.createDataFrame([(m, *MODELS[m]) for m in models], "model string, set string, rule string")
    supp = table(spark, sf_dir, "supplier").filter((F.col("s_acctbal") >= -500) & (F.col("s_acctbal") <= 9900)).select(F.col("s_suppkey").alias("commander_id"), F.col("s_name").alias("name"))
    frame = metrics(cells(spark, sf_dir), used).join(supp, "commander_id").join(F.broadcast(config), "set")
    if any(MODELS[m][1] == "trust" for m in models):
        # Opponents of strict pages: distinct pairs first, so that no frequent one is held by a task.
        met = fact(spark, sf_dir).filter("strict").select("commander_id", "opponent").distinct().groupBy("commander_id").agg(F.count("opponent").alias("opponents"))
        frame = frame.join(met, "commander_id", "left").fillna({"opponents": 0})
    else:
        frame = frame.withColumn("opponents", F.lit(0).cast("long"))
    rule = F.col("rule")
    n, kb, b = F.col("known"), F.col("known_battles"), F.col("battles")
    cohort = F.when(rule == "baseline", (b >= 5) & (kb >= 3)).when(rule == "battle_only", (b >= 3) & (kb >= 1)).otherwise((F.col("engagements") >= 5) & (n >= 3))
    narrow = rule.isin("baseline", "battle_only")
    frame = frame.filter(cohort).withColumn("m", F.when(narrow, kb).otherwise(n))
    raw = {
        "outcome": F.col("outcome_mean") * F.col("m") / (F.col("m") + SHRINK),
        "depth": F.log1p(b),
        "reliability": 0.7 * F.col("known_battle_share") + 0.3 * F.least(kb, F.lit(10)) / 10.0,
        "scope_conflict": F.log1p("conflicts"),
        "scope_type": F.col("page_types").cast("double"),
        "scope_era": F.col("eras").cast("double"),
        "temporal": F.log1p(F.least("span", F.lit(60))),
        "centrality": F.log1p("presence"),
        "higher": F.log1p("nonbattle"),
        "evidence": 0.6 * F.col("known_share") + 0.4 * F.col("known_battle_share"),
        "sustained": 0.45 * F.log1p(n) + 0.2 * F.log1p("conflicts") + 0.2 * F.log1p("opponents") + 0.15 * F.log1p(b + F.col("campaigns")),
    }
    factor = F.when(narrow, 1.0).otherwise(guardrail(rule == "trust"))
    frame = shared_table(frame.withColumns({f"r_{k}": F.coalesce(steady(v), F.lit(0.0)) for k, v in raw.items()} | {"factor": factor}), "cohorts")
    weights = {r: {c: w / len(PARTS.get(k, [k])) for k, w in ws.items() for c in PARTS.get(k, [k])} for r, ws in WEIGHTS.items()}
    own = [r for r in weights if any(MODELS[m][1] == r for m in models)]
    parts = [F.struct(F.lit(k).alias("part"), F.col(f"r_{k}").alias("v"), reduce(lambda x, r: F.when(rule == r, F.lit(weights[r][k])).otherwise(x), (r for r in own if k in weights[r]), F.lit(None).cast("double")).alias("w")) for k in raw if any(k in weights[r] for r in own)]
    long = frame.select("model", "commander_id", F.explode(F.filter(F.array(*parts), lambda x: x["w"].isNotNull())).alias("x")).select("model", "commander_id", "x.*")
    score = percentile_ranks(long, ["model", "part"], "v", "pct").groupBy("model", "commander_id").agg(F.sum(F.col("w") * F.col("pct")).alias("sum"))
    scored = frame.join(score, ["model", "commander_id"]).withColumn("score", steady(F.col("sum") * F.col("factor"))).drop("sum")
    order = [F.desc("score"), F.desc("r_outcome"), F.desc("engagements"), F.asc("name")]
    return ordered_ranks(scored, ["model"], order, "rank").withColumns({"profile": profile_class(), "tier": score_tier(F.col("score"))})


def _sum_sql(values: dict[str, float], key: str) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v}::double" for k, v in values.items()) + " else 0::double end"


def _set_sql(name: str) -> str:
    gate, scores, presence, credit = SETS[name]
    return f"select '{name}' as set, commander_id, page_type, known, conflict, era, opponent, year, strict, w_{gate} as w, w_{gate} * p_{presence} as p, w_{gate} * k_{credit} as o, w_{gate} * k_{credit} * {_sum_sql(OUTCOME_SCORES[scores], 'outcome')} as v from prep where w_{gate} > 0"


def _pct(c: str) -> str:
    return f"100::double * (rank() over (partition by model order by {c}) + (count(*) over (partition by model, {c}) - 1) / 2.0) / count(*) over (partition by model) as {c.replace('r_', 'c_', 1)}"


RANKED = f"""{FACT},
base as (select *, side <> 'multiple_sides' as valid, outcome <> 'unknown' as known, count(*) over (partition by page_id, side) as side_n, count_if(outcome <> 'unknown') over (partition by page_id, side) as known_n,
  coalesce(bool_or(strict and page_type = 'battle_article') over (partition by commander_id, conflict), false) as anchor_s, coalesce(bool_or(balanced and page_type = 'battle_article') over (partition by commander_id, conflict), false) as anchor_b,
  {_sum_sql(PAGE_WEIGHTS, 'page_type')} as pw from fact),
prep as (select *, case when strict and page_type = 'battle_article' then 1::double else 0 end as w_battle_only,
  case when strict then pw * case when page_type <> 'battle_article' and anchor_s then 0.5::double else 1::double end else 0::double end as w_strict,
  case when balanced then pw * case when page_type <> 'battle_article' and anchor_b then 0.5::double else 1::double end else 0::double end as w_balanced,
  case when valid then 1::double else 0 end as p_full, case when valid then 1::double / side_n else 0 end as p_split,
  case when valid and known then 1::double else 0 end as k_full, case when valid and known then 1::double / sqrt(known_n) else 0 end as k_split from base),
masses as ({" union all ".join(_set_sql(s) for s in SETS)}),
metric as (select set, commander_id, count(*) as engagements, count_if(page_type = 'battle_article') as battles, count_if(page_type = 'operation_article') as operations, count_if(page_type = 'campaign_article') as campaigns, count_if(page_type = 'war_conflict_article') as wars,
  count_if(known) as known, count_if(known and page_type = 'battle_article') as known_battles, sum(p) as presence, sum(case when page_type <> 'battle_article' then p else 0 end) as nonbattle, sum(o) as ow, sum(v) as ov,
  count(distinct conflict) as conflicts, count(distinct page_type) as page_types, count(distinct case when era <> 'unknown' then era end) as eras, min(year) as fy, max(year) as ly, count(distinct case when strict then opponent end) as opponents,
  min(case when strict and page_type <> 'war_conflict_article' then year end) as lo, max(case when strict and page_type <> 'war_conflict_article' then year end) as hi from masses group by 1, 2),
metric2 as (select *, case when ow = 0 then 0 else ov / ow end as outcome_mean, round(case when presence = 0 then 0 else nonbattle / presence end, 9) as higher_share, known / engagements::double as known_share,
  case when battles = 0 then 0 else known_battles / battles::double end as known_battle_share, coalesce(hi - lo, ly - fy) as span, battles / engagements::double as battle_share, operations / engagements::double as operation_share,
  campaigns / engagements::double as campaign_share, wars / engagements::double as war_share from metric),
models as (select unnest([{", ".join(f"'{m}'" for m in MODELS)}]) as model, unnest([{", ".join(f"'{s}'" for s, _ in MODELS.values())}]) as set, unnest([{", ".join(f"'{r}'" for _, r in MODELS.values())}]) as rule),
cohort as (select *, case when rule in ('baseline', 'battle_only') then known_battles else known end as m from metric2 join models using (set) join (select s_suppkey as commander_id, s_name as name from supplier where s_acctbal between -500 and 9900) using (commander_id)
  where case rule when 'baseline' then battles >= 5 and known_battles >= 3 when 'battle_only' then battles >= 3 and known_battles >= 1 else engagements >= 5 and known >= 3 end),
raws as (select *, round(outcome_mean * m / (m + 5.0::double), 9) as r_outcome, round(ln(1 + battles), 9) as r_depth, round(0.7::double * known_battle_share + 0.3::double * least(known_battles, 10) / 10.0::double, 9) as r_reliability,
  round(ln(1 + conflicts), 9) as r_scope_conflict, page_types::double as r_scope_type, eras::double as r_scope_era, round(ln(1 + least(span, 60)), 9) as r_temporal, round(ln(1 + presence), 9) as r_centrality, round(ln(1 + nonbattle), 9) as r_higher,
  round(0.6::double * known_share + 0.4::double * known_battle_share, 9) as r_evidence, round(0.45::double * ln(1 + known) + 0.2::double * ln(1 + conflicts) + 0.2::double * ln(1 + opponents) + 0.15::double * ln(1 + battles + campaigns), 9) as r_sustained from cohort),
parts as (select *, {", ".join(_pct("r_" + c) for c in ("outcome", "depth", "reliability", "scope_conflict", "scope_type", "scope_era", "temporal", "centrality", "higher", "evidence", "sustained"))} from raws),
scored as (select * exclude (c_scope_conflict, c_scope_type, c_scope_era), (c_scope_conflict + c_scope_type + c_scope_era) / 3.0::double as c_scope,
  case when rule in ('baseline', 'battle_only') then 1::double else least(1::double, case when higher_share >= 0.5 and known_share < 0.4 then 0.95::double else 1 end, case when known < 8 and known_share < 0.5 and higher_share >= 0.35 then 0.95::double else 1 end,
    case when higher_share >= 0.5 and known_battles < 2 and battles < 4 then 0.92::double else 1 end, case when rule = 'trust' and known < 8 and battles < 8 then 0.97::double else 1 end, case when rule = 'trust' and (known < 6 or known_battles < 3) then 0.94::double else 1 end) end as factor from parts),
final as (select *, round(factor * case rule {" ".join(f"when '{r}' then " + " + ".join(f"{w}::double * c_{k}" for k, w in ws.items()) for r, ws in WEIGHTS.items())} end, 9) as score,
  case when battle_share >= 0.7 then 'battle_dominant' when campaign_share + war_share >= 0.5 and campaign_share + war_share > battle_share then 'war_campaign_heavy' when operation_share >= 0.4 then 'operation_heavy' else 'mixed_profile' end as profile from scored),
ranked as (select *, row_number() over (partition by model order by score desc, r_outcome desc, engagements desc, name)::int as rank,
  case when score >= 90 then 'elite' when score >= 80 then 'very_strong' when score >= 70 then 'strong' when score >= 60 then 'solid' else 'qualified' end as tier from final)"""


@query(f"with {RANKED} select rank, commander_id, name, battles, known_battles, round(r_outcome, 6) as outcome, round(score, 6) as score, tier from ranked where model = 'baseline_conservative'")
def rank_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conservative baseline ranking."""
    r = ranked(spark, sf_dir, ["baseline_conservative"])
    return r.select("rank", "commander_id", "name", "battles", "known_battles", F.round("r_outcome", 6).alias("outcome"), F.round("score", 6).alias("score"), "tier")


@query(f"with {RANKED} select model, rank, commander_id, engagements, known, round(factor, 6) as factor, round(score, 6) as score, tier, profile, array_to_string(list_filter([case when higher_share >= 0.5 then 'higher_level_dependent' end, case when higher_share >= 0.5 and known_share < 0.4 then 'higher_level_low_evidence_combo' end, case when known < 8 and known_share < 0.5 and higher_share >= 0.35 then 'sparse_higher_level_evidence' end, case when higher_share >= 0.5 and known_battles < 2 and battles < 4 then 'thin_battle_anchor' end], lambda x: x is not null), ' | ') as flags from ranked")
def rank_all_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven models with guardrails, profiles and caution flags."""
    high, share, known, kb, b = (F.col(c) for c in ("higher_share", "known_share", "known", "known_battles", "battles"))
    flags = join_flags(F.when(high >= 0.5, "higher_level_dependent"), F.when((high >= 0.5) & (share < 0.4), "higher_level_low_evidence_combo"), F.when((known < 8) & (share < 0.5) & (high >= 0.35), "sparse_higher_level_evidence"), F.when((high >= 0.5) & (kb < 2) & (b < 4), "thin_battle_anchor"))
    return ranked(spark, sf_dir).select("model", "rank", "commander_id", "engagements", "known", F.round("factor", 6).alias("factor"), F.round("score", 6).alias("score"), "tier", "profile", flags.alias("flags"))


def sensitivity(r: DataFrame) -> DataFrame:
    """Spread of each commander's ranks over the trusted models, all in one aggregation of the long table."""
    own = F.when(F.col("model").isin(TRUSTED), F.col("rank"))
    trust = lambda c: F.max(F.when(F.col("model") == "hierarchical_trust_v2", F.col(c)))
    q = F.percentile(own.cast("double"), F.array(F.lit(0.25), F.lit(0.75)))
    return r.groupBy("commander_id", "name").agg(
        F.count(own).alias("models"), F.min(own).alias("best"), F.max(own).alias("worst"), (F.max(own) - F.min(own)).alias("spread"), F.avg(own).alias("mean"), F.median(own).alias("mid"), F.stddev_pop(own).alias("sd"), (q[1] - q[0]).alias("iqr"),
        *(F.count_if(own <= k).alias(f"top{k}") for k in (10, 25, 50, 100)), trust("rank").alias("trust_rank"), trust("score").alias("trust_score"), trust("known").alias("known"), trust("battles").alias("battles"), trust("higher_share").alias("higher_share"),
        trust("known_share").alias("known_share"), trust("campaigns").alias("campaigns"), trust("wars").alias("wars"), trust("engagements").alias("engagements"), F.max(F.when(F.col("model") == "battle_only_baseline", F.col("rank"))).alias("battle_rank"), F.max(F.when(F.col("model") == "hierarchical_trust_v2", F.col("profile"))).alias("profile"),
    ).filter("models > 0")


SENSITIVITY = RANKED + f""", own as (select *, case when model in ({", ".join(f"'{m}'" for m in TRUSTED)}) then rank end as k, model = 'hierarchical_trust_v2' as t from ranked),
sens as (select commander_id, name, count(k) as models, min(k) as best, max(k) as worst, max(k) - min(k) as spread, avg(k) as mean, median(k) as mid, stddev_pop(k) as sd, quantile_cont(k, 0.75) - quantile_cont(k, 0.25) as iqr,
  count_if(k <= 10) as top10, count_if(k <= 25) as top25, count_if(k <= 50) as top50, count_if(k <= 100) as top100, max(case when t then rank end) as trust_rank, max(case when t then score end) as trust_score, max(case when t then known end) as known,
  max(case when t then battles end) as battles, max(case when t then higher_share end) as higher_share, max(case when t then known_share end) as known_share, max(case when t then campaigns end) as campaigns, max(case when t then wars end) as wars, max(case when t then engagements end) as engagements,
  max(case when model = 'battle_only_baseline' then rank end) as battle_rank, max(case when t then profile end) as profile from own group by 1, 2 having count(k) > 0)"""

#: Trusted models, band weights and limits of the stability score.
STABILITY = [(82.0, "very_stable"), (68.0, "stable"), (52.0, "moderately_sensitive"), (35.0, "highly_sensitive")]


def stability(s: DataFrame) -> DataFrame:
    n = float(len(TRUSTED))
    band = 0.45 * F.col("top10") / n + 0.30 * F.col("top25") / n + 0.15 * F.col("top50") / n + 0.10 * F.col("top100") / n
    falling = lambda c: 1.0 / (1.0 + F.col(c) / 50.0)
    score = 100.0 * (0.40 * F.col("models") / n + 0.25 * band + 0.20 * falling("sd") + 0.15 * falling("iqr"))
    return s.withColumn("stability", F.round(score, 6)).withColumn("category", ladder(F.col("stability"), STABILITY, "too_sparse"))


def _ladder_sql(c: str, steps, below: str) -> str:
    return "case " + " ".join(f"when {c} >= {x} then '{y}'" for x, y in steps) + f" else '{below}' end"


STABLE = SENSITIVITY + f""", stable0 as (select *, round(100 * (0.40::double * models / 6 + 0.25::double * (0.45::double * top10 / 6 + 0.30::double * top25 / 6 + 0.15::double * top50 / 6 + 0.10::double * top100 / 6) + 0.20::double / (1 + sd / 50) + 0.15::double / (1 + iqr / 50)), 6) as stability from sens),
stable as (select *, {_ladder_sql('stability', STABILITY, 'too_sparse')} as category from stable0)"""


@query(f"with {STABLE} select commander_id, models, best, worst, spread, round(mean, 6) as mean, round(mid, 6) as mid, round(sd, 6) as sd, round(iqr, 6) as iqr, top10::bigint as top10, top25::bigint as top25, top50::bigint as top50, top100::bigint as top100, stability, category from stable")
def rank_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank spread across the trusted models and the stability score."""
    s = stability(sensitivity(ranked(spark, sf_dir, TRUSTED)))
    return s.select("commander_id", "models", "best", "worst", "spread", *(F.round(c, 6).alias(c) for c in ("mean", "mid", "sd", "iqr")), "top10", "top25", "top50", "top100", "stability", "category")


def confidence(spread: Column) -> Column:
    """Trust in a rank; a spread of 0 counts as unknown (999)."""
    high, known, b = F.col("higher_share"), F.col("known"), F.col("battles")
    wide = F.when(spread == 0, F.lit(999)).otherwise(spread)
    poor = (high >= 0.5) | (wide >= 60) | (b < 5)
    return F.when(poor, "caution").when((known >= 24) & (b >= 15) & (wide <= 12) & (high <= 0.55), "very_high").when((known >= 16) & (b >= 10) & (wide <= 24), "high").when((known >= 8) & (b >= 6) & (wide <= 45), "moderate").otherwise("caution")


def trust_tier(label: Column) -> Column:
    rank = F.col("trust_rank")
    sure = label.isin("very_high", "high")
    return F.when(sure & (rank <= 12) & (F.col("top25") >= 4) & (F.col("spread") <= 24) & (F.col("spread") > 0), "robust_elite_core").when(sure & (rank <= 25), "strong_upper_tier").when(label.isin("very_high", "high", "moderate") & (rank <= 50), "high_confidence_upper_band").when(rank <= 100, "model_sensitive_band").otherwise("outside_trust_headline")


TRUST = STABLE + """, conf as (select *, case when higher_share >= 0.5 or case when spread = 0 then 999 else spread end >= 60 or battles < 5 then 'caution' when known >= 24 and battles >= 15 and case when spread = 0 then 999 else spread end <= 12 and higher_share <= 0.55 then 'very_high'
  when known >= 16 and battles >= 10 and case when spread = 0 then 999 else spread end <= 24 then 'high' when known >= 8 and battles >= 6 and case when spread = 0 then 999 else spread end <= 45 then 'moderate' else 'caution' end as label from stable where trust_rank is not null),
trust as (select *, case when label in ('very_high', 'high') and trust_rank <= 12 and top25 >= 4 and spread <= 24 and spread > 0 then 'robust_elite_core' when label in ('very_high', 'high') and trust_rank <= 25 then 'strong_upper_tier' when label in ('very_high', 'high', 'moderate') and trust_rank <= 50 then 'high_confidence_upper_band' when trust_rank <= 100 then 'model_sensitive_band' else 'outside_trust_headline' end as trust_tier from conf)"""


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stability(sensitivity(ranked(spark, sf_dir, TRUSTED))).filter(F.col("trust_rank").isNotNull())
    return s.withColumn("label", confidence(F.col("spread"))).withColumn("trust_tier", trust_tier(F.col("label")))


@query(f"with {TRUST} select commander_id, trust_rank, label, trust_tier, case when models >= 4 and spread <= 10 then 'core_stable' when models >= 4 and spread <= 20 then 'stable' when models >= 3 and spread > 40 then 'highly_model_sensitive' when models >= 2 and spread > 20 then 'model_sensitive' else 'limited_comparison' end as steadiness from trust")
def rank_trust_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence labels and trust tiers."""
    m, w = F.col("models"), F.col("spread")
    steadiness = F.when((m >= 4) & (w <= 10), "core_stable").when((m >= 4) & (w <= 20), "stable").when((m >= 3) & (w > 40), "highly_model_sensitive").when((m >= 2) & (w > 20), "model_sensitive").otherwise("limited_comparison")
    return trusted(spark, sf_dir).select("commander_id", "trust_rank", "label", "trust_tier", steadiness.alias("steadiness"))


TIER_SQL = """case when siege_rows >= 0.35 then 'd' when trust_rank <= 25 and stability >= 68 and known >= 10 and known_share >= 0.6 and higher_share <= 0.35 then 'a' when trust_rank <= 50 and stability >= 52 then 'b' when trust_rank <= 100 and (known >= 5 or known_share >= 0.5) then 'c'
  when battle_rank <= 100 and (battles >= 5 or contains(profile, 'battle')) then 'd' when trust_rank <= 150 or campaigns + wars > battles then 'e' else 'unclassified' end"""


def page_tier() -> Column:
    """Tiers A to E of a trusted row with its share of sieges, first rule that holds."""
    r, k, s = F.col("trust_rank"), F.col("known"), F.col("known_share")
    return (
        F.when(F.col("siege_rows") >= 0.35, "d")
        .when((r <= 25) & (F.col("stability") >= 68) & (k >= 10) & (s >= 0.6) & (F.col("higher_share") <= 0.35), "a")
        .when((r <= 50) & (F.col("stability") >= 52), "b")
        .when((r <= 100) & ((k >= 5) | (s >= 0.5)), "c")
        .when((F.col("battle_rank") <= 100) & ((F.col("battles") >= 5) | F.contains("profile", F.lit("battle"))), "d")
        .when((r <= 150) | (F.col("campaigns") + F.col("wars") > F.col("battles")), "e")
        .otherwise("unclassified")
    )


@query(f"""with {RANKED}, t as (select *, least(1, case when higher_share <= 0.4 then 1 else greatest(0, 1 - higher_share + least(higher_share, 0.4::double / 0.6::double * (1 - higher_share))) end) as cap from ranked where model = 'hierarchical_trust_v2')
  select commander_id, rank, round(cap, 6) as cap, round(score * cap, 6) as capped, row_number() over (order by round(score * cap, 9) desc, score desc, rank)::int as capped_rank, row_number() over (order by round(score * cap, 9) desc, score desc, rank)::int - rank as moved from t""")
def rank_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trust ranking with broad evidence capped, and how ranks move."""
    t = ranked(spark, sf_dir, ["hierarchical_trust_v2"]).withColumn("cap", cap_factor(F.col("higher_share")))
    t = ordered_ranks(t.withColumn("c", steady(F.col("score") * F.col("cap"))), ["model"], [F.desc("c"), F.desc("score"), F.asc("rank")], "capped_rank")
    return t.select("commander_id", "rank", F.round("cap", 6).alias("cap"), F.round(F.col("score") * F.col("cap"), 6).alias("capped"), "capped_rank", (F.col("capped_rank") - F.col("rank")).alias("moved"))


@query(f"""with {RANKED}, k as (select unnest([25, 50, 100])::int as k) select k, model, profile, count(*) as n, round(avg(score), 6) as mean_score from ranked join k on rank <= k group by 1, 2, 3""")
def rank_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles among the top 25, 50 and 100 of each model."""
    sizes = F.array(F.lit(25), F.lit(50), F.lit(100))
    rows = ranked(spark, sf_dir).filter("rank <= 100").select("model", "profile", "score", F.explode(F.filter(sizes, lambda k: k >= F.col("rank"))).alias("k"))
    return rows.groupBy("k", "model", "profile").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))


@query(f"""with {RANKED}, e as (select commander_id, era, row_number() over (partition by commander_id order by count(*) desc, era) as rn from fact group by 1, 2)
  select model, era, commander_id, place from (select model, era, commander_id, row_number() over (partition by model, era order by score desc, rank)::int as place from ranked join (select commander_id, era from e where rn = 1) using (commander_id)) where place <= 5""")
def rank_by_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best of each model and primary era."""
    n = fact(spark, sf_dir).groupBy("commander_id", "era").agg(F.count("*").alias("n"))
    era = n.groupBy("commander_id").agg(F.min_by("era", F.struct(-F.col("n"), F.col("era"))).alias("era"))
    r = ranked(spark, sf_dir).select("model", "commander_id", "score", "rank").join(era, "commander_id")
    return top_by(r, ["model", "era"], [F.desc("score"), F.asc("rank")], 5).select("model", "era", "commander_id", F.col("rn").alias("place"))


@query(f"""with {RANKED}, wide as (select commander_id, {", ".join(f"max(case when model = '{m}' then rank end) as {m}" for m in MODELS)} from ranked group by 1) select * from wide""")
def rank_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of all models, a column each."""
    return ranked(spark, sf_dir).groupBy("commander_id").pivot("model", list(MODELS)).agg(F.max("rank"))


@query(f"""with {RANKED}, s as (select commander_id, page_type, sum(case when abs(v) > 0 then abs(v) else 0.15::double * p end) as c from masses where set = 'b' group by 1, 2),
  x as (select *, sum(c) over (partition by commander_id) as total from s), y as (select commander_id, page_type, round(case when total = 0 then 0 else c / total end, 6) as share, row_number() over (partition by commander_id order by round(c, 9) desc, page_type) as rn from x)
  select commander_id, page_type, share, rn = 1 as dominant from y""")
def rank_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page type's share of a commander's signal: absolute weighted outcomes, else a small part of presence."""
    f = prepared(spark, sf_dir).filter("weight_strict > 0")
    v = F.abs(F.col("weight_strict") * F.col("credit_split") * F.col("score_balanced"))
    signal = F.when(v > 0, v).otherwise(0.15 * F.col("weight_strict") * F.col("presence_full"))
    s = f.groupBy("commander_id", "page_type").agg(F.sum(signal).alias("c"))
    w = Window.partitionBy("commander_id")
    s = s.withColumns({"total": F.sum("c").over(w), "rn": F.row_number().over(w.orderBy(F.desc(steady(F.col("c"))), F.asc("page_type")))})
    return s.select("commander_id", "page_type", F.round(ratio(F.col("c"), F.col("total")), 6).alias("share"), (F.col("rn") == 1).alias("dominant"))
