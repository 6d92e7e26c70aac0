"""The later passes over the trust ranking: eligibility, capped and filtered ranks, bootstrap confidence, roles, synthesis.

Stand-ins of the binding: a page whose number divides by 7 is a siege, a commander of negative balance has a
suspect identity, and an engagement of several lines counts as corrected. Curated tables are parameters; those given
here name a few commanders of the binding.
"""

from __future__ import annotations

import hashlib
import inspect
import sys
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import scores
from lodestar.functions.rules import DIRECT, ROLES
from lodestar.functions.scores import ERAS, SHRINK, cap_factor, mapped, ratio, steady
from lodestar.operators import resample, windows
from lodestar.operators.resample import draws_sql, packed_draws, percentiles, summed
from lodestar.operators.tables import kept_table, shared_table
from lodestar.operators.windows import ordered_ranks, percentile_ranks, unique_rank
from lodestar.plans import binding, ranking
from lodestar.plans.binding import table
from lodestar.plans.ranking import BATTLE, CAMPAIGN, OPERATION, TIER_SQL, TRUST, WAR, cells, page_tier, prepared, ranked, trusted, weight_of
from lodestar.plans.registry import query

HEADLINE = "hierarchical_trust_v2"
CAPPED, FILTERED = f"{HEADLINE}_high_level_capped", f"{HEADLINE}_eligibility_filtered"
#: Curated eligibility: name, role category, eligibility, whether it leaves the headline.
ELIGIBILITY = [("Supplier#000000003", "political_leader", "political_or_nominal_only", True), ("Supplier#000000005", "modern_officeholder_or_staff_leader", "staff_or_planning_only", True), ("Supplier#000000007", "ambiguous_or_hybrid_political_military_leader", "ambiguous_requires_review", False)]
#: Curated roles: name, role, confidence.
CURATED = [("Supplier#000000002", "overall_commander", 0.95), ("Supplier#000000004", "coalition_commander", 0.75), ("Supplier#000000006", "siege_engineer_or_specialist", 0.95), ("Supplier#000000008", "naval_commander", 0.95)]
# Limits of the cap, of weak support, of width bands; weights of the bootstrap's models.
WEAK, BROAD_LIMIT = 0.35, 0.40
BANDS = [(10, "narrow"), (30, "moderate"), (100, "wide")]
PROXIES = {
    "baseline_conservative": {"outcome_battle": 0.75, "scale_battle": 0.25},
    "battle_only_baseline": {"outcome_battle": 0.75, "scale_battle": 0.25},
    "hierarchical_weighted": {"outcome": 0.45, "scope": 0.20, "temporal": 0.15, "centrality": 0.10, "evidence": 0.10},
    **{m: {"outcome": 0.32, "known": 0.18, "scope": 0.18, "temporal": 0.12, "centrality": 0.10, "evidence": 0.10} for m in (HEADLINE, CAPPED, FILTERED)},
}
#: Models that rank battles alone; commanders up to which a resample is ranked as one group (some hundred bytes each).
NARROW, COHORT = ("baseline_conservative", "battle_only_baseline"), 500_000
ITERATIONS = 200
_ERAS = [*ERAS, "contemporary", "unknown"]

# --- eligibility -----------------------------------------------------------------------------------


def rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a commander's strict engagements say, in one aggregation: shares of the scoring signal by page type, and of kinds of rows."""
    c = cells(spark, sf_dir).filter("n_strict > 0").withColumn("signal", weight_of("strict") * F.col("signal"))
    kinds = {"battle": BATTLE, "operation": OPERATION, "campaign": CAMPAIGN, "war": WAR}
    rows = ("coalition", "split", "siege", "corrected")
    out = c.groupBy("commander_id").agg(
        F.sum("signal").alias("signal"), F.sum("n_strict").alias("strict_rows"), *(F.sum(F.when(F.col("page_type") == p, F.col("signal")).otherwise(0.0)).alias(f"s_{k}") for k, p in kinds.items()), *(F.sum(f"n_{k}").alias(f"n_{k}") for k in rows),
        *(F.sum(f"e_{e}").alias(f"e_{e}") for e in _ERAS),
    )
    share = {f"{k}_part": F.round(ratio(F.col(f"s_{k}"), F.col("signal")), 9) for k in kinds}
    share |= {f"{k}_rows": F.col(f"n_{k}") / F.col("strict_rows") for k in rows}
    share["first_era"] = F.array_min(F.array(*(F.struct((-F.col(f"e_{e}")).alias("n"), F.lit(e).alias("era")) for e in _ERAS)))["era"]
    return out.withColumns(share).drop(*(f"e_{e}" for e in _ERAS)).withColumn("broad", F.round(F.col("operation_part") + F.col("campaign_part") + F.col("war_part"), 9))


_V = "abs(w_strict * k_split * case outcome when 'decisive_victory' then 1.0::double when 'victory' then 0.8::double when 'defeat' then -0.8::double when 'major_defeat' then -1.0::double else 0::double end)"
ROLL = TRUST + f""", sig as (select *, {_V} as v0, case when {_V} > 0 then {_V} else 0.15::double * w_strict * p_full end as c from prep where strict),
roll0 as (select commander_id, count(*) as strict_rows, sum(c) as signal, {", ".join(f"sum(case when page_type = '{p}' then c else 0 end) as s_{k}" for k, p in (("battle", "battle_article"), ("operation", "operation_article"), ("campaign", "campaign_article"), ("war", "war_conflict_article")))},
  count_if(known_n >= 4) as n_coalition, count_if(known_n >= 3) as n_split, count_if(page_id % 7 = 0) as n_siege, count_if(n_lines > 1) as n_corrected from sig group by 1),
roll1 as (select *, {", ".join(f"round(case when signal = 0 then 0 else s_{k} / signal end, 9) as {k}_part" for k in ("battle", "operation", "campaign", "war"))}, {", ".join(f"n_{k} / strict_rows::double as {k}_rows" for k in ("coalition", "split", "siege", "corrected"))} from roll0),
fe as (select commander_id, era as first_era, row_number() over (partition by commander_id order by count(*) desc, era) as rn from prep where strict group by 1, 2),
roll as (select *, round(operation_part + campaign_part + war_part, 9) as broad from roll1 join (select commander_id, first_era from fe where rn = 1) using (commander_id))"""


def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trust ranking with roll-ups, role category, eligibility, exclusion and what to do."""
    curated = spark.createDataFrame(ELIGIBILITY, "name string, c_role string, c_eligibility string, c_excluded boolean")
    t = trusted(spark, sf_dir).join(rollups(spark, sf_dir), "commander_id", "left").join(F.broadcast(curated), "name", "left").fillna(0.0, ["broad", "battle_part", "siege_rows", "operation_part", "campaign_part", "war_part", "coalition_rows", "split_rows", "corrected_rows"])
    broad, near, siege = F.col("broad"), F.col("battle_part"), F.col("siege_rows")

    def ladder(siege_: str, only: str, mostly: str, field: str, mixed: str) -> Column:
        return F.when(siege >= 0.35, siege_).when((broad >= 0.999) & (near <= 0.001), only).when((broad > 0.70) & (near < 0.30), mostly).when((F.col("battles") >= 5) & (F.col("known") >= 3), field).when(broad > 0.40, mixed).otherwise(field)

    role = ladder("genuine_siege_or_engineering_commander", "ambiguous_high_level_only_case", "high_level_operational_case", "genuine_field_commander", "high_level_mixed_case")
    strict = ladder("eligible_siege_or_engineering_commander", "ambiguous_requires_review", "eligible_operational_commander", "eligible_field_commander", "ambiguous_requires_review")
    t = t.withColumns({"role_category": F.coalesce("c_role", role), "eligibility": F.coalesce("c_eligibility", strict), "excluded": F.coalesce("c_excluded", F.lit(False)), "weak": near < WEAK}).drop("c_role", "c_eligibility", "c_excluded")
    action = F.when(F.col("excluded"), "exclude_from_headline_ranking").when(broad >= 0.999, "role_review_before_headline_use").when(broad > BROAD_LIMIT, "add_high_level_page_caveat").when(F.col("weak") & (F.col("trust_rank") <= 100), "add_weak_battle_siege_support_caveat").otherwise("retain")
    return t.withColumn("action", action)


def _ladder_sql(*out: str) -> str:
    return "case when siege_rows >= 0.35 then '{}' when broad >= 0.999 and battle_part <= 0.001 then '{}' when broad > 0.7 and battle_part < 0.3 then '{}' when battles >= 5 and known >= 3 then '{}' when broad > 0.4 then '{}' else '{}' end".format(*out, out[3])


ELIGIBLE = ROLL + f""", curated(name, c_role, c_eligibility, c_excluded) as (values {", ".join(f"('{n}', '{r}', '{e}', {str(x).lower()})" for n, r, e, x in ELIGIBILITY)}),
elig0 as (select trust.*, coalesce(broad, 0) as broad, coalesce(battle_part, 0) as battle_part, coalesce(operation_part, 0) as operation_part, coalesce(campaign_part, 0) as campaign_part, coalesce(war_part, 0) as war_part, coalesce(siege_rows, 0) as siege_rows, coalesce(coalition_rows, 0) as coalition_rows, coalesce(split_rows, 0) as split_rows, coalesce(corrected_rows, 0) as corrected_rows,
  first_era, c_role, c_eligibility, c_excluded from trust left join roll using (commander_id) left join curated using (name)),
elig1 as (select *, coalesce(c_role, {_ladder_sql("genuine_siege_or_engineering_commander", "ambiguous_high_level_only_case", "high_level_operational_case", "genuine_field_commander", "high_level_mixed_case")}) as role_category,
  coalesce(c_eligibility, {_ladder_sql("eligible_siege_or_engineering_commander", "ambiguous_requires_review", "eligible_operational_commander", "eligible_field_commander", "ambiguous_requires_review")}) as eligibility, coalesce(c_excluded, false) as excluded, battle_part < 0.35 as weak from elig0),
elig as (select * exclude (c_role, c_eligibility, c_excluded), case when excluded then 'exclude_from_headline_ranking' when broad >= 0.999 then 'role_review_before_headline_use' when broad > 0.4 then 'add_high_level_page_caveat' when weak and trust_rank <= 100 then 'add_weak_battle_siege_support_caveat' else 'retain' end as action from elig1)"""


@query(f"""with {ELIGIBLE} select commander_id, trust_rank, role_category, eligibility, excluded, weak, action, round(broad, 6) as broad, round(battle_part, 6) as battle_part, round(siege_rows, 6) as siege_rows,
  trust_rank <= 100 and broad > 0.4 as broad_top100, broad >= 0.999 as only_broad, trust_rank <= 150 and weak as weak_top150 from elig""")
def rank_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eligibility audit, and which of its reports each commander stands in."""
    rank, broad = F.col("trust_rank"), F.col("broad")
    return eligibility(spark, sf_dir).select(
        "commander_id", "trust_rank", "role_category", "eligibility", "excluded", "weak", "action", *(F.round(c, 6).alias(c) for c in ("broad", "battle_part", "siege_rows")),
        ((rank <= 100) & (broad > BROAD_LIMIT)).alias("broad_top100"), (broad >= 0.999).alias("only_broad"), ((rank <= 150) & F.col("weak")).alias("weak_top150"),
    )


@query(f"with {ELIGIBLE} select commander_id, {TIER_SQL} as tier from elig")
def rank_tier_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers A to E, first rule that holds; many sieges make a narrow category first of all."""
    return eligibility(spark, sf_dir).select("commander_id", page_tier().alias("tier"))


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility with the ranks of the capped scores, and of the commanders who are not excluded; from two global orders."""
    e = eligibility(spark, sf_dir).withColumn("cap", cap_factor(F.col("broad"))).withColumns({"capped_score": steady(F.col("trust_score") * F.col("cap"))})
    e = ordered_ranks(e, [], [F.desc("capped_score"), F.desc("trust_score"), F.asc("trust_rank")], "capped_rank")
    f = ordered_ranks(e.filter("not excluded").select("commander_id", "trust_score", "trust_rank"), [], [F.desc("trust_score"), F.asc("trust_rank")], "filtered_rank")
    return e.join(f.select("commander_id", "filtered_rank"), "commander_id", "left")


FILTER = ELIGIBLE + """, capx as (select *, round(trust_score * least(1, case when broad <= 0.4 then 1 else greatest(0, 1 - broad + least(broad, 0.4::double / 0.6::double * (1 - broad))) end), 9) as capped_score from elig),
fr as (select commander_id, row_number() over (order by trust_score desc, trust_rank)::int as filtered_rank from elig where not excluded),
filt as (select capx.*, row_number() over (order by capped_score desc, trust_score desc, trust_rank)::int as capped_rank, filtered_rank from capx left join fr using (commander_id))"""


@query(f"with {FILTER} select commander_id, trust_rank, round(capped_score, 6) as capped_score, capped_rank, capped_rank - trust_rank as moved_capped, filtered_rank, filtered_rank - trust_rank as moved_filtered, action from filt")
def rank_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The capped and the eligibility-filtered ranking beside the trust ranking."""
    t = F.col("trust_rank")
    return filtered(spark, sf_dir).select("commander_id", "trust_rank", F.round("capped_score", 6).alias("capped_score"), "capped_rank", (F.col("capped_rank") - t).alias("moved_capped"), "filtered_rank", (F.col("filtered_rank") - t).alias("moved_filtered"), "action")


# --- audit flags -------------------------------------------------------------------------------------


def audit_flags(spark: SparkSession, sf_dir: str, e: DataFrame, top: int = 100) -> DataFrame:
    """commander_id and the array of flags of the best-ranked commanders."""
    c = F.col
    suspect = table(spark, sf_dir, "supplier").select(c("s_suppkey").alias("commander_id"), (c("s_acctbal") < 0).alias("suspect"))
    rules = {
        "high_rank_low_known_rows": (c("trust_rank") <= 100) & (c("known") < 8),
        "high_rank_many_high_level_pages": c("broad") > 0.40,
        "high_rank_low_battle_only_score": (c("trust_rank") <= 50) & (F.coalesce("battle_rank", F.lit(999999)) > 100),
        "large_model_rank_variance": (c("spread") > 50) | c("category").isin("model_sensitive", "highly_model_sensitive"),
        "coalition_credit_heavy": c("coalition_rows") > 0.30,
        "nominal_leader_risk": (c("broad") > 0.45) & (c("battles") < 5),
        "unclear_role_heavy": F.lit(False),
        "siege_engineering_specialist": c("siege_rows") > 0.35,
        "campaign_page_sensitive": c("campaign_part") > 0.25,
        "war_page_sensitive": c("war_part") > 0.25,
        "low_evidence_quality": (c("known") < 8) | (c("known_share") < 0.60),
        "region_or_era_source_density_risk": c("first_era").isin("ancient", "medieval") & (c("known") < 10),
        "identity_merge_risk": F.coalesce("suspect", F.lit(False)),
        "outcome_override_sensitive": c("corrected_rows") > 0.20,
        "split_credit_sensitive": c("split_rows") > 0.30,
    }
    rows = e.filter(c("trust_rank") <= top).join(suspect, "commander_id", "left")
    return rows.select("commander_id", F.array_sort(F.filter(F.array(*(F.when(v, k) for k, v in rules.items())), lambda x: x.isNotNull())).alias("flags"))


FLAGS = FILTER + """, flags as (select commander_id, list_sort(list_filter([case when known < 8 then 'high_rank_low_known_rows' end, case when broad > 0.4 then 'high_rank_many_high_level_pages' end, case when trust_rank <= 50 and coalesce(battle_rank, 999999) > 100 then 'high_rank_low_battle_only_score' end,
  case when spread > 50 then 'large_model_rank_variance' end, case when coalition_rows > 0.3 then 'coalition_credit_heavy' end, case when broad > 0.45 and battles < 5 then 'nominal_leader_risk' end, case when siege_rows > 0.35 then 'siege_engineering_specialist' end, case when campaign_part > 0.25 then 'campaign_page_sensitive' end,
  case when war_part > 0.25 then 'war_page_sensitive' end, case when known < 8 or known_share < 0.6 then 'low_evidence_quality' end, case when first_era in ('ancient', 'medieval') and known < 10 then 'region_or_era_source_density_risk' end, case when s_acctbal < 0 then 'identity_merge_risk' end,
  case when corrected_rows > 0.2 then 'outcome_override_sensitive' end, case when split_rows > 0.3 then 'split_credit_sensitive' end], lambda x: x is not null)) as flags from filt join supplier on s_suppkey = commander_id where trust_rank <= 100)"""


@query(f"with {FLAGS} select commander_id, unnest(flags) as flag from flags")
def rank_audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifteen audit rules over the hundred best ranked, a row a flag."""
    return audit_flags(spark, sf_dir, eligibility(spark, sf_dir)).select("commander_id", F.explode("flags").alias("flag"))


@query(f"""with {FLAGS}, tiers as (select commander_id, trust_rank, sd, {TIER_SQL} as tier from filt), t as (select 'tier' as part, tier as name, count(*) as n from tiers where trust_rank <= 100 group by 2), f as (select 'flag' as part, flag as name, count(*) as n from (select unnest(flags) as flag from flags) group by 2),
  b as (select 'broad' as part, commander_id::varchar as name, round(broad * 1000)::bigint as n from filt order by broad desc, commander_id limit 12), s as (select 'sensitive' as part, commander_id::varchar as name, round(sd * 1000)::bigint as n from tiers where trust_rank <= 50 order by round(sd, 9) desc, commander_id limit 12)
  select * from t union all select * from f union all (select * from b) union all (select * from s)""")
def report_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tier and flag counts, and the twelve most broad and most model-sensitive commanders."""
    e = shared_table(eligibility(spark, sf_dir).withColumn("tier", page_tier()), "eligibility")
    t = e.filter("trust_rank <= 100").groupBy(F.lit("tier").alias("part"), F.col("tier").alias("name")).agg(F.count("*").alias("n"))
    f = audit_flags(spark, sf_dir, e).select(F.explode("flags").alias("name")).groupBy(F.lit("flag").alias("part"), "name").agg(F.count("*").alias("n"))
    pick = lambda part, c: (F.lit(part).alias("part"), F.col("commander_id").cast("string").alias("name"), F.round(F.col(c) * 1000).cast("long").alias("n"))
    b = e.orderBy(F.desc("broad"), "commander_id").limit(12).select(*pick("broad", "broad"))
    s = e.filter("trust_rank <= 50").withColumn("k", F.round("sd", 9)).orderBy(F.desc("k"), "commander_id").limit(12).select(*pick("sensitive", "sd"))
    return t.unionByName(f).unionByName(b).unionByName(s)


# --- bootstrap ---------------------------------------------------------------------------------------


def originals(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    """(model, commander_id, name, original_rank) of the six models that are resampled."""
    r = ranked(spark, sf_dir, ["baseline_conservative", "battle_only_baseline", "hierarchical_weighted"]).select("model", "commander_id", "name", F.col("rank").alias("original_rank"))
    for model, rank in ((HEADLINE, "trust_rank"), (CAPPED, "capped_rank"), (FILTERED, "filtered_rank")):
        r = r.unionByName(e.filter(F.col(rank).isNotNull()).select(F.lit(model).alias("model"), "commander_id", "name", F.col(rank).alias("original_rank")))
    return r


#: Sums of a resample: mentions, battles, known ones, presence, broad presence, outcome weights and values.
SUMS = {"m": "1", "mb": "b", "known": "k", "known_b": "k * b", "p": "w", "nb": "w * (1 - b)", "ow": "w * c", "ov": "w * c * vs", "obw": "b * c", "obv": "b * c * vc"}


def resampled(spark: SparkSession, sf_dir: str, original: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(i, model, commander_id, rank, score) of each resample of the pages: as many draws as there are pages, with replacement.

    The draws of all resamples lie beside a page as one row of bits; the fact meets them at the page and is summed as
    vectors over all resamples, a row a commander. What is summed is made of a few columns once the rows have moved. Models that rank the same commanders by the same parts share them, as the
    headline model and the capped one do.
    """
    f = prepared(spark, sf_dir).filter("strict")
    battle = (F.col("page_type") == BATTLE).cast("double")
    base = f.select("commander_id", "page_id", F.col("conflict").cast("string").alias("conflict"), "year", battle.alias("b"), F.col("known").cast("double").alias("k"), F.col("weight_strict").alias("w"), F.col("credit_split").alias("c"), F.col("score_balanced").alias("vs"), F.col("score_conservative").alias("vc"))
    base = shared_table(base, "strict")
    rows = base.join(packed_draws(base.select("page_id").distinct(), iterations), "page_id").drop("page_id")
    g = summed(rows, "commander_id", "conflict", "year", SUMS, iterations, bits=True)
    shrunk = lambda v, o, k: steady(ratio(F.col(v), F.col(o)) * F.col(k) / (F.col(k) + SHRINK))
    raw = {
        "outcome": shrunk("ov", "ow", "known"), "outcome_battle": shrunk("obv", "obw", "known_b"), "scale_battle": steady(F.log1p("mb")), "known": steady(F.log1p("known")), "scope": steady(F.log1p("parts")),
        "temporal": steady(F.log1p(F.least(F.greatest(F.col("high") - F.col("low"), F.lit(0)), F.lit(60)))), "centrality": steady(F.log1p("p")), "evidence": steady(F.col("known") / F.greatest("m", F.lit(1.0))),
    }
    g = shared_table(g.select("i", "commander_id", "m", "mb", steady(cap_factor(steady(ratio(F.col("nb"), F.col("p"))))).alias("cap"), *(v.alias(f"r_{k}") for k, v in raw.items())), "resamples")
    few = original.select("commander_id").distinct().count() <= COHORT
    return (ranked_together if few else ranked_in_ranges)(g, original)


def ranked_together(g: DataFrame, original: DataFrame) -> DataFrame:
    """The ranks inside each resample, whose rows are one group: for counted commanders, up to COHORT of them.

    A part is sorted once for all cohorts; ties are told from equal neighbours, and a cohort's ranks are running counts of its members.
    """
    models = [m for m in PROXIES if m != CAPPED]
    who = original.groupBy("commander_id", "name").agg(F.bit_or(mapped(F.col("model"), {m: 1 << k for k, m in enumerate(PROXIES)}, 0)).alias("member"))
    who = ordered_ranks(who, [], [F.asc("name"), F.asc("commander_id")], "place").drop("name")
    raw = [c for c in g.columns if c.startswith("r_")]
    nine = lambda x: np.floor(x * 1e9 + 0.5) / 1e9

    def one(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in table.column_names}
        n, sorts, out = table.num_rows, {}, []
        for c in raw:
            order = np.argsort(col[c], kind="stable")
            x = col[c][order]
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            sorts[c] = order, first, np.repeat(np.arange(len(first)), np.diff(first, append=n))
        for model in models:
            narrow = model in NARROW
            of = (col["member"] >> list(PROXIES).index(model) & 1).astype(bool) & ((col["mb"] > 0) | (not narrow))
            own = np.flatnonzero(of)
            if not len(own):
                continue
            total = np.zeros(n)
            for part, weight in PROXIES[model].items():
                order, first, group = sorts[f"r_{part}"]
                tied = np.add.reduceat(of[order].astype(np.int64), first)
                total[order] += weight * (100.0 * (np.cumsum(tied) - tied + (tied + 1) / 2.0) / len(own))[group]
            for name, score in [(model, nine(total[own])), *([(CAPPED, nine(total[own] * col["cap"][own]))] if model == HEADLINE else [])]:
                ahead = np.lexsort((col["place"][own], -col["mb" if narrow else "m"][own], -col["r_outcome_battle" if narrow else "r_outcome"][own], -score))
                rank = np.empty(len(own), np.int32)
                rank[ahead] = np.arange(1, len(own) + 1)
                out.append(pa.table({"i": col["i"][own], "model": pa.repeat(name, len(own)), "commander_id": col["commander_id"][own], "score": score, "rank": rank}))
        return pa.concat_tables(out) if out else pa.schema([("i", pa.int64()), ("model", pa.string()), ("commander_id", pa.int64()), ("score", pa.float64()), ("rank", pa.int32())]).empty_table()

    return g.join(F.broadcast(who), "commander_id").groupBy("i").applyInArrow(one, "i long, model string, commander_id long, score double, rank int")


def ranked_in_ranges(g: DataFrame, original: DataFrame) -> DataFrame:
    """The same ranks for any number of commanders, by counts of distinct values and by sampled ranges."""
    raw = [c.removeprefix("r_") for c in g.columns if c.startswith("r_")]
    # The headline model's cohort serves the capped one as well; every other model has its own.
    shared = F.when(F.col("model") == CAPPED, HEADLINE).otherwise(F.col("model"))
    members = original.filter(F.col("model") != CAPPED).select(F.col("model").alias("cohort"), "commander_id")
    narrow = F.col("cohort").isin(*NARROW)
    met = g.join(members, "commander_id").filter(~narrow | (F.col("mb") > 0))
    weight = lambda k: mapped(F.col("cohort"), {m: ws[k] for m, ws in PROXIES.items() if k in ws})
    parts = F.filter(F.array(*(F.struct(F.lit(k).alias("part"), F.col(f"r_{k}").alias("x"), weight(k).alias("weight")) for k in raw)), lambda s: s["weight"] > 0)
    long = met.select("i", "cohort", "commander_id", F.explode(parts).alias("s")).select("i", "cohort", "commander_id", "s.*")
    pct = percentile_ranks(shared_table(long, "parts"), ["i", "cohort", "part"], "x", "pct")
    sums = pct.groupBy("i", "cohort", "commander_id").agg(F.sum(F.col("weight") * F.col("pct")).alias("s"))
    narrow = F.col("model").isin(*NARROW)
    first = F.when(narrow, F.col("r_outcome_battle")).otherwise(F.col("r_outcome"))
    size = F.when(narrow, F.col("mb")).otherwise(F.col("m"))
    score = steady(F.col("s") * F.when(F.col("model") == CAPPED, F.col("cap")).otherwise(1.0))
    scored = sums.join(original.select("model", shared.alias("cohort"), "commander_id", "name"), ["cohort", "commander_id"]).join(g, ["i", "commander_id"])
    scored = scored.select("i", "model", "commander_id", "name", score.alias("score"), first.alias("first"), size.alias("size"))
    return ordered_ranks(scored, ["i", "model"], [F.desc("score"), F.desc("first"), F.desc("size"), F.asc("name")], "rank").select("i", "model", "commander_id", "score", "rank")


def intervals(drawn: DataFrame, original: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """Rank and score percentiles of each model and commander, widths, presence, category and top-10 frequency."""
    at = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)
    g = percentiles(drawn, ["commander_id", "model"], {"rank": list(at), "score": [0.05, 0.5, 0.95]}, ("rank", 10)).withColumnRenamed("top", "top10")
    names = ["p05", "p10", "p25", "p50", "p75", "p90", "p95"]
    g = g.select("model", "commander_id", *(F.round(f"rank_{k}", 6).alias(c) for k, c in enumerate(names)), *(F.round(f"score_{k}", 6).alias(c) for k, c in enumerate(("s05", "s50", "s95"))), (F.col("n") / iterations).alias("presence"), "top10")
    g = g.withColumns({"width80": F.round(F.col("p90") - F.col("p10"), 6), "width90": F.round(F.col("p95") - F.col("p05"), 6)})
    band = F.lit("very_wide")
    for limit, name in reversed(BANDS):
        band = F.when(F.col("width80") <= limit, name).otherwise(band)
    return g.withColumn("confidence", band).join(original, ["model", "commander_id"])


BOOT = FLAGS + f""", orig as (select model, commander_id, name, rank as original_rank from ranked where model in ('baseline_conservative', 'battle_only_baseline', 'hierarchical_weighted') union all select '{HEADLINE}', commander_id, name, trust_rank from filt union all select '{CAPPED}', commander_id, name, capped_rank from filt union all select '{FILTERED}', commander_id, name, filtered_rank from filt where filtered_rank is not null),
{draws_sql("select distinct page_id from prep where strict", ITERATIONS)},
bs as (select commander_id, page_id, conflict, year, (page_type = 'battle_article')::int::double as b, known::int::double as k, w_strict as w, w_strict * k_split as o, w_strict * k_split * {{BAL}} as v, (page_type = 'battle_article')::int * k_split as ob, (page_type = 'battle_article')::int * k_split * {{CON}} as vb from prep where strict),
b1 as (select i, commander_id, conflict, sum(n)::double as m, sum(n * b) as mb, sum(n * k) as known, sum(n * k * b) as known_b, sum(n * w) as p, sum(n * w * (1 - b)) as nb, sum(n * o) as ow, sum(n * v) as ov, sum(n * ob) as obw, sum(n * vb) as obv, min(year) as lo, max(year) as hi from bs join drawn using (page_id) group by 1, 2, 3),
b2 as (select i, commander_id, sum(m) as m, sum(mb) as mb, sum(known) as known, sum(known_b) as known_b, sum(p) as p, sum(nb) as nb, sum(ow) as ow, sum(ov) as ov, sum(obw) as obw, sum(obv) as obv, count(conflict) as conflicts, min(lo) as lo, max(hi) as hi from b1 group by 1, 2),
b3 as (select i, commander_id, m, mb, round(case when p = 0 then 0 else nb / p end, 9) as hs, round(case when ow = 0 then 0 else ov / ow end * known / (known + 5.0::double), 9) as r_outcome, round(case when obw = 0 then 0 else obv / obw end * known_b / (known_b + 5.0::double), 9) as r_outcome_battle, round(ln(1 + mb), 9) as r_scale_battle, round(ln(1 + known), 9) as r_known,
  round(ln(1 + conflicts), 9) as r_scope, round(ln(1 + least(greatest(hi - lo, 0), 60)), 9) as r_temporal, round(ln(1 + p), 9) as r_centrality, round(known / greatest(m, 1), 9) as r_evidence from b2),
b4 as (select b3.*, model, name, model in ('baseline_conservative', 'battle_only_baseline') as narrow, case when model = '{CAPPED}' then round(least(1, case when hs <= 0.4 then 1 else greatest(0, 1 - hs + least(hs, 0.4::double / 0.6::double * (1 - hs))) end), 9) else 1::double end as cap from b3 join orig using (commander_id) where mb > 0 or model not in ('baseline_conservative', 'battle_only_baseline')),
b5 as (select *, {", ".join(f"100::double * (rank() over (partition by i, model order by r_{c}) + (count(*) over (partition by i, model, r_{c}) - 1) / 2.0) / count(*) over (partition by i, model) as c_{c}" for c in ("outcome", "outcome_battle", "scale_battle", "known", "scope", "temporal", "centrality", "evidence"))} from b4),
b6 as (select *, round(cap * case model {" ".join(f"when '{m}' then " + " + ".join(f"{w}::double * c_{k}" for k, w in ws.items()) for m, ws in PROXIES.items())} end, 9) as score from b5),
boot as (select i, model, commander_id, score, row_number() over (partition by i, model order by score desc, case when narrow then r_outcome_battle else r_outcome end desc, case when narrow then mb else m end desc, name) as rank from b6),
iv0 as (select model, commander_id, {", ".join(f"round(quantile_cont(rank::double, {x}), 6) as p{int(x * 100 + 0.5):02d}" for x in (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95))}, {", ".join(f"round(quantile_cont(score, {x}), 6) as s{int(x * 100 + 0.5):02d}" for x in (0.05, 0.5, 0.95))}, count(*) / {ITERATIONS}::double as presence, count_if(rank <= 10) as top10 from boot group by 1, 2),
iv1 as (select *, round(p90 - p10, 6) as width80, round(p95 - p05, 6) as width90 from iv0),
iv as materialized (select iv1.*, case when width80 <= 10 then 'narrow' when width80 <= 30 then 'moderate' when width80 <= 100 then 'wide' else 'very_wide' end as confidence, name, original_rank from iv1 join orig using (model, commander_id))""".replace("{BAL}", "case outcome when 'decisive_victory' then 1.0::double when 'victory' then 0.8::double when 'defeat' then -0.8::double when 'major_defeat' then -1.0::double else 0::double end").replace("{CON}", "case outcome when 'decisive_victory' then 1.0::double when 'victory' then 0.75::double when 'defeat' then -0.75::double when 'major_defeat' then -1.0::double else 0::double end")

_P = ("p05", "p10", "p25", "p50", "p75", "p90", "p95", "s05", "s50", "s95", "width80", "width90")


def _code() -> str:
    """A digest of the code that the kept tables come from, so that another version makes its own."""
    own = [scores, resample, windows, binding, ranking, sys.modules[__name__]]
    return hashlib.sha256("".join(inspect.getsource(m) for m in own).encode()).hexdigest()


def confident(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The filtered ranking, and the intervals of all six models: tables kept for all queries that read the same sources."""
    sources = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "orders", "supplier", "customer", "part", "nation", "region")]
    e = kept_table(spark, "filtered", sources, _code(), lambda: filtered(spark, sf_dir))

    def made() -> DataFrame:
        o = shared_table(originals(spark, sf_dir, e), "originals")
        return intervals(resampled(spark, sf_dir, o), o)

    return e, kept_table(spark, "intervals", sources, (ITERATIONS, _code()), made)


@query(f"with {BOOT} select model, commander_id, original_rank, {', '.join(_P)}, presence, confidence, top10::bigint as top10, model = '{HEADLINE}' and original_rank > 10 and top10 > 0 as late_riser from iv")
def rank_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank and score intervals of six models over 200 resamples of the pages, and who reaches the top ten only there."""
    _, iv = confident(spark, sf_dir)
    late = (F.col("model") == HEADLINE) & (F.col("original_rank") > 10) & (F.col("top10") > 0)
    return iv.select("model", "commander_id", "original_rank", *_P, "presence", "confidence", "top10", late.alias("late_riser"))


# --- confidence tiers --------------------------------------------------------------------------------


def confidence_tiers(e: DataFrame, iv: DataFrame) -> DataFrame:
    """The headline model's intervals with tiers adjusted for them."""
    own = iv.filter(F.col("model") == HEADLINE).select("commander_id", "p05", "p10", "p50", "p90", "p95", "width80", "width90", "confidence", "presence")
    t = e.withColumn("tier", page_tier()).join(own, "commander_id")
    rank, width, conf, broad, known, tier = (F.col(c) for c in ("trust_rank", "width80", "confidence", "broad", "known", "tier"))
    sure, loose = conf.isin("narrow", "moderate"), conf.isin("wide", "very_wide")
    key = (
        F.when(F.col("eligibility").isin("political_or_nominal_only", "staff_or_planning_only"), "excluded_headline_confidence")
        .when((rank <= 25) & (tier == "a") & sure & (broad <= 0.40) & (known >= 10), "tier_a_confidence_supported_robust_elite")
        .when((rank <= 50) & F.col("category").isin("very_stable", "stable") & (width <= 100) & (known >= 8), "tier_b_confidence_supported_elite")
        .when((rank <= 100) & loose, "tier_c_high_rank_confidence_limited")
        .when(broad > 0.40, "tier_d_page_type_sensitive")
        .when(tier == "d", "tier_d_category_specific_confidence")
        .otherwise("tier_e_confidence_limited")
    )
    reading = F.when(F.col("excluded"), "diagnostic_only").when(sure & (tier == "a"), "robust_elite").when(loose & (rank <= 25), "high_but_limited").when(sure, "constrained").otherwise("wide_uncertainty")
    between = lambda a, b: F.concat_ws("-", F.bround(a).cast("int").cast("string"), F.bround(b).cast("int").cast("string"))
    return t.withColumns({"adjusted_tier": key, "reading": reading, "interval80": between("p10", "p90"), "interval90": between("p05", "p95")})


CONFIDENT = BOOT + f""", ct0 as (select filt.*, {TIER_SQL} as tier, p05, p10, p50, p90, p95, width80, width90, confidence, presence from filt join (select commander_id, p05, p10, p50, p90, p95, width80, width90, confidence, presence from iv where model = '{HEADLINE}') iv using (commander_id)),
ct as (select *, case when eligibility in ('political_or_nominal_only', 'staff_or_planning_only') then 'excluded_headline_confidence' when trust_rank <= 25 and tier = 'a' and confidence in ('narrow', 'moderate') and broad <= 0.4 and known >= 10 then 'tier_a_confidence_supported_robust_elite'
  when trust_rank <= 50 and category in ('very_stable', 'stable') and width80 <= 100 and known >= 8 then 'tier_b_confidence_supported_elite' when trust_rank <= 100 and confidence in ('wide', 'very_wide') then 'tier_c_high_rank_confidence_limited' when broad > 0.4 then 'tier_d_page_type_sensitive' when tier = 'd' then 'tier_d_category_specific_confidence' else 'tier_e_confidence_limited' end as adjusted_tier,
  case when excluded then 'diagnostic_only' when confidence in ('narrow', 'moderate') and tier = 'a' then 'robust_elite' when confidence in ('wide', 'very_wide') and trust_rank <= 25 then 'high_but_limited' when confidence in ('narrow', 'moderate') then 'constrained' else 'wide_uncertainty' end as reading,
  round_even(p10, 0)::int || '-' || round_even(p90, 0)::int as interval80, round_even(p05, 0)::int || '-' || round_even(p95, 0)::int as interval90 from ct0)"""


@query(f"""with {CONFIDENT}, p as (select *, row_number() over (order by case when trust_rank <= 100 then 0 else 1 end, width80 desc, trust_rank) as fragile from ct)
  select commander_id, trust_rank, p50, interval80, interval90, width80, confidence, category, tier, adjusted_tier, reading, width80 <= 10 as exact_rank_holds, trust_rank <= 100 and fragile <= 25 as most_fragile, adjusted_tier in ('tier_a_confidence_supported_robust_elite', 'tier_b_confidence_supported_elite') as tier_holds from p""")
def rank_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence summary, adjusted tiers and the report lists each commander stands in."""
    t = shared_table(confidence_tiers(*confident(spark, sf_dir)), "confidence")
    fragile = t.filter("trust_rank <= 100").orderBy(F.desc("width80"), F.asc("trust_rank")).limit(25).select("commander_id", F.lit(True).alias("most_fragile"))
    t = t.join(F.broadcast(fragile), "commander_id", "left").fillna({"most_fragile": False})
    return t.select("commander_id", "trust_rank", "p50", "interval80", "interval90", "width80", "confidence", "category", "tier", "adjusted_tier", "reading", (F.col("width80") <= 10).alias("exact_rank_holds"), "most_fragile", F.col("adjusted_tier").isin("tier_a_confidence_supported_robust_elite", "tier_b_confidence_supported_elite").alias("tier_holds"))


# --- curation scope and roles ------------------------------------------------------------------------


def scope(t: DataFrame) -> DataFrame:
    """Why each commander is in the scope of curation: the union of seven top-k sets, each a bounded top-k; t is a written table."""
    sets = {
        "by_rank": (100, [F.asc("trust_rank")]), "unstable": (50, [F.desc(F.round("sd", 9)), F.desc(F.round("iqr", 9)), F.asc("commander_id")]), "broad": (50, [F.desc("broad"), F.asc("commander_id")]), "uncertain": (50, [F.desc("width80"), F.asc("commander_id")]),
        "headline": (10, [F.asc("trust_rank")]), "capped": (10, [F.asc("capped_rank")]), "filtered": (10, [F.asc_nulls_last("filtered_rank")]),
    }
    rows = [t.filter("filtered_rank is not null" if name == "filtered" else "true").orderBy(*order).limit(k).select("commander_id", F.lit(name).alias("why")) for name, (k, order) in sets.items()]
    return reduce(DataFrame.unionByName, rows).groupBy("commander_id").agg(F.array_join(F.array_sort(F.collect_set("why")), " | ").alias("why"))


SCOPE = CONFIDENT + """, sc0 as (select commander_id, trust_rank, capped_rank, filtered_rank, row_number() over (order by round(sd, 9) desc, round(iqr, 9) desc, commander_id) as a, row_number() over (order by broad desc, commander_id) as b, row_number() over (order by width80 desc, commander_id) as c, row_number() over (order by trust_rank) as r, row_number() over (order by filtered_rank nulls last) as f from ct),
scope as (select commander_id, array_to_string(list_sort(list_filter([case when r <= 100 then 'by_rank' end, case when a <= 50 then 'unstable' end, case when b <= 50 then 'broad' end, case when c <= 50 then 'uncertain' end, case when r <= 10 then 'headline' end, case when capped_rank <= 10 then 'capped' end, case when f <= 10 and filtered_rank is not null then 'filtered' end], lambda x: x is not null)), ' | ') as why from sc0),
scoped as (select * from scope where why <> '')"""


@query(f"with {SCOPE} select commander_id, why from scoped")
def curation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of seven top-k sets, with the sets each commander is in."""
    return scope(shared_table(confidence_tiers(*confident(spark, sf_dir)), "confidence"))


def role_of(scoped: Column, excluded: Column, curated: Column, curated_confidence: Column) -> tuple[Column, Column]:
    """Role and confidence of an engagement: curated, then by exclusion, page type and how many known commanders stood on the side."""
    kind, many = F.col("page_type"), F.col("known_n") >= 4
    role = (
        F.when(curated.isNotNull(), F.when((curated == "siege_engineer_or_specialist") & (kind == "naval_battle_article"), "naval_commander").otherwise(curated))
        .when(excluded, "nominal_or_political_leader")
        .when(kind == "naval_battle_article", "naval_commander")
        .when(kind == "siege_article", "siege_engineer_or_specialist")
        .when(kind == BATTLE, F.when(many, "wing_or_corps_commander").otherwise("principal_field_commander"))
        .when(kind.isin(OPERATION, CAMPAIGN, "invasion_article", "conquest_article"), F.when(many, "coalition_commander").when(scoped, "overall_commander").otherwise("unclear_role"))
        .when(kind.isin(WAR, "uprising_or_revolt_article", "broad_conflict_article"), F.when(many & scoped, "coalition_commander").otherwise("unclear_role"))
        .otherwise("unclear_role")
    )
    confidence = (
        F.when(curated.isNotNull(), F.when((curated == "siege_engineer_or_specialist") & (kind == "naval_battle_article"), 0.80).otherwise(curated_confidence))
        .when(excluded, 0.65)
        .when(kind == "naval_battle_article", 0.70)
        .when(kind == "siege_article", 0.65)
        .when(kind == BATTLE, F.when(many, 0.55).otherwise(0.65))
        .when(kind.isin(OPERATION, CAMPAIGN, "invasion_article", "conquest_article"), F.when(many | scoped, 0.50).otherwise(0.35))
        .when(kind.isin(WAR, "uprising_or_revolt_article", "broad_conflict_article"), F.when(scoped, 0.45).otherwise(0.30))
        .otherwise(0.30)
    )
    return role, confidence


def role_contributions(spark: SparkSession, sf_dir: str, t: DataFrame, scoped: DataFrame) -> DataFrame:
    """Each commander's signal by role: dominant role, shares, weighted share and mean confidence."""
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("commander_id"), F.col("s_name").alias("name"))
    curated = spark.createDataFrame(CURATED, "name string, c_role string, c_confidence double")
    who = names.join(F.broadcast(curated), "name", "left").join(scoped.select("commander_id", F.lit(True).alias("scoped")), "commander_id", "left").join(t.select("commander_id", "excluded"), "commander_id", "left").fillna({"scoped": False, "excluded": False})
    f = prepared(spark, sf_dir).join(who, "commander_id")
    role, confidence = role_of(F.col("scoped"), F.col("excluded"), F.col("c_role"), F.col("c_confidence"))
    v = F.abs(F.col("weight_strict") * F.col("credit_split") * F.col("score_balanced"))
    f = f.select("commander_id", role.alias("role"), confidence.alias("confidence"), F.when(v > 0, v).otherwise(0.15 * F.col("weight_strict")).alias("signal"))
    s = f.groupBy("commander_id", "role").agg(F.sum("signal").alias("signal"), F.sum("confidence").alias("sure"), F.count("*").alias("n"))
    part = lambda *r: F.round(ratio(F.sum(F.when(F.col("role").isin(*r), F.col("signal")).otherwise(0.0)), F.sum("signal")), 9)
    weighted = F.sum(F.col("signal") * mapped(F.col("role"), ROLES, ROLES["unclear_role"]))
    return s.groupBy("commander_id").agg(
        F.min_by("role", F.struct(-F.round("signal", 9), F.col("role"))).alias("dominant"), part(*DIRECT).alias("direct"), part("unclear_role").alias("unclear"), part("nominal_or_political_leader").alias("nominal"),
        F.round(F.when(F.sum("signal") > 0, weighted / F.sum("signal")).otherwise(ROLES["unclear_role"]), 9).alias("adjustment"), F.round(F.sum("sure") / F.sum("n"), 9).alias("sureness"),
    )


def role_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence table with roles, the role-weighted rank, and how the four rankings differ."""
    t = shared_table(confidence_tiers(*confident(spark, sf_dir)), "confidence")
    t = t.join(role_contributions(spark, sf_dir, t, scope(t)), "commander_id", "left")
    factor = F.col("adjustment") * (0.75 + 0.25 * F.col("sureness")) * F.when(F.col("excluded"), 0.25).otherwise(1.0)
    t = t.withColumn("role_score", steady(F.col("trust_score") * factor))
    t = ordered_ranks(t, [], [F.desc("role_score"), F.desc("trust_score"), F.asc("trust_rank")], "role_rank")
    four = [F.col(c) for c in ("trust_rank", "capped_rank", "filtered_rank", "role_rank")]
    t = t.withColumns({"best": F.least(*four), "worst": F.greatest(*four), "moved": F.col("role_rank") - F.col("trust_rank")}).withColumn("range", F.col("worst") - F.col("best"))
    nominal, unclear, broad, moved, role = (F.col(c) for c in ("nominal", "unclear", "broad", "moved", "dominant"))
    status = F.when((nominal >= 0.30) | (moved >= 80), "fragile").when(role.isin("siege_engineer_or_specialist", "naval_commander", "coalition_commander"), "qualified").when((unclear >= 0.40) | (broad >= 0.40) | (moved >= 20), "qualified").otherwise("robust")
    caveat = F.when(nominal >= 0.30, "nominal_role").when(unclear >= 0.40, "unclear_role").when(broad >= 0.40, "broad_pages").when(role == "siege_engineer_or_specialist", "category_specific").when(moved >= 20, "weakened_by_role").otherwise("none")
    return t.withColumns({"status": status, "caveat": caveat})


_ROLE_SQL = f"""case when c_role is not null then c_role when excluded then 'nominal_or_political_leader' when page_type = 'battle_article' then case when known_n >= 4 then 'wing_or_corps_commander' else 'principal_field_commander' end
  when page_type in ('operation_article', 'campaign_article') then case when known_n >= 4 then 'coalition_commander' when scoped then 'overall_commander' else 'unclear_role' end when known_n >= 4 and scoped then 'coalition_commander' else 'unclear_role' end"""
_SURE_SQL = """case when c_role is not null then c_confidence when excluded then 0.65 when page_type = 'battle_article' then case when known_n >= 4 then 0.55 else 0.65 end
  when page_type in ('operation_article', 'campaign_article') then case when known_n >= 4 or scoped then 0.5 else 0.35 end when scoped then 0.45 else 0.3 end"""
ROLED = SCOPE + f""", hand(name, c_role, c_confidence) as (values {", ".join(f"('{n}', '{r}', {c}::double)" for n, r, c in CURATED)}),
who as (select s_suppkey as commander_id, c_role, c_confidence, scoped.commander_id is not null as scoped, coalesce(ct.excluded, false) as excluded from supplier left join hand on s_name = hand.name left join scoped on scoped.commander_id = s_suppkey left join ct on ct.commander_id = s_suppkey),
rr as (select commander_id, {_ROLE_SQL} as role, ({_SURE_SQL})::double as sure, case when {_V} > 0 then {_V} else 0.15::double * w_strict end as signal from prep join who using (commander_id)),
rs as (select commander_id, role, sum(signal) as signal, sum(sure) as sure, count(*) as n from rr group by 1, 2),
rd as (select commander_id, role as dominant, row_number() over (partition by commander_id order by round(signal, 9) desc, role) as rn from rs),
rc as (select commander_id, {", ".join(f"round(case when sum(signal) = 0 then 0 else sum(case when role in ({r}) then signal else 0 end) / sum(signal) end, 9) as {k}" for k, r in (("direct", ", ".join(f"'{d}'" for d in DIRECT)), ("unclear", "'unclear_role'"), ("nominal", "'nominal_or_political_leader'")))},
  round(case when sum(signal) > 0 then sum(signal * case role {" ".join(f"when '{k}' then {v}::double" for k, v in ROLES.items())} end) / sum(signal) else 0.4 end, 9) as adjustment, round(sum(sure) / sum(n), 9) as sureness from rs group by 1),
rw0 as (select ct.*, dominant, direct, unclear, nominal, adjustment, sureness, round(trust_score * adjustment * (0.75::double + 0.25::double * sureness) * case when excluded then 0.25::double else 1::double end, 9) as role_score from ct left join rc using (commander_id) left join (select * from rd where rn = 1) rd using (commander_id)),
rw1 as (select *, row_number() over (order by role_score desc, trust_score desc, trust_rank)::int as role_rank from rw0),
rw2 as (select *, least(trust_rank, capped_rank, filtered_rank, role_rank) as best_of, greatest(trust_rank, capped_rank, filtered_rank, role_rank) as worst_of, role_rank - trust_rank as moved from rw1),
rw as (select *, worst_of - best_of as range_of, case when nominal >= 0.3 or moved >= 80 then 'fragile' when dominant in ('siege_engineer_or_specialist', 'naval_commander', 'coalition_commander') then 'qualified' when unclear >= 0.4 or broad >= 0.4 or moved >= 20 then 'qualified' else 'robust' end as status,
  case when nominal >= 0.3 then 'nominal_role' when unclear >= 0.4 then 'unclear_role' when broad >= 0.4 then 'broad_pages' when dominant = 'siege_engineer_or_specialist' then 'category_specific' when moved >= 20 then 'weakened_by_role' else 'none' end as caveat from rw2)"""


@query(f"with {ROLED} select commander_id, trust_rank, role_rank, moved, dominant, round(direct, 6) as direct, round(unclear, 6) as unclear, round(nominal, 6) as nominal, round(adjustment, 6) as adjustment, round(sureness, 6) as sureness, round(role_score, 6) as role_score, best_of as best, worst_of as worst, range_of as range, status, caveat from rw")
def rank_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles, the role-weighted ranking, and its place among four rankings."""
    return role_weighted(spark, sf_dir).select("commander_id", "trust_rank", "role_rank", "moved", "dominant", *(F.round(c, 6).alias(c) for c in ("direct", "unclear", "nominal", "adjustment", "sureness", "role_score")), "best", "worst", "range", "status", "caveat")


# --- synthesis ---------------------------------------------------------------------------------------


def synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last table: tier A to F and what to make of it."""
    t = shared_table(role_weighted(spark, sf_dir), "synthesis")
    t = t.join(audit_flags(spark, sf_dir, t), "commander_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))
    rank, conf, role, broad, direct, unclear, known = (F.col(c) for c in ("trust_rank", "confidence", "dominant", "broad", "direct", "unclear", "known"))
    moved, wide = F.abs("moved"), conf.isin("wide", "very_wide")
    tier = (
        F.when((F.col("nominal") >= 0.20) | F.array_contains("flags", "nominal_leader_risk"), "f")
        .when(role.isin("siege_engineer_or_specialist", "naval_commander", "coalition_commander", "staff_or_planning_role"), "d")
        .when((rank <= 25) & F.col("category").isin("very_stable", "stable") & conf.isin("narrow", "moderate") & (direct >= 0.70) & (broad < 0.40) & (unclear < 0.30) & (moved <= 20) & (known >= 8), "a")
        .when((rank <= 50) & (direct >= 0.60) & (conf != "very_wide") & (moved <= 50), "b")
        .when((rank <= 100) & (wide | (broad >= 0.40) | (unclear >= 0.30) | (known < 8)), "c")
        .when((rank <= 200) | (moved > 75), "e")
        .otherwise("c")
    )
    why = F.concat_ws(", ", F.when(wide, "wide bootstrap interval"), F.when(broad >= 0.40, "high broad-page dependency"), F.when(unclear >= 0.30, "high unclear-role share"), F.when(moved >= 20, "large role-weighted movement"), F.when(role.isin("siege_engineer_or_specialist", "naval_commander", "coalition_commander"), F.concat(F.lit("best read as "), F.translate(role, "_", " "))))
    t = t.withColumn("synthesis_tier", tier)
    said = F.when(F.col("synthesis_tier") == "a", "Robust elite placement").when(F.col("synthesis_tier") == "f", "Not suitable for headline comparison").when(why != "", F.concat(F.lit("Qualified by "), why)).otherwise("Usable evidence")
    return t.withColumn("recommendation", said)


SYNTHESIS = ROLED + """, sy0 as (select rw.*, coalesce(flags.flags, []) as flags, abs(moved) as far, confidence in ('wide', 'very_wide') as loose from rw left join flags using (commander_id)),
sy1 as (select *, case when nominal >= 0.2 or list_contains(flags, 'nominal_leader_risk') then 'f' when dominant in ('siege_engineer_or_specialist', 'naval_commander', 'coalition_commander', 'staff_or_planning_role') then 'd'
  when trust_rank <= 25 and category in ('very_stable', 'stable') and confidence in ('narrow', 'moderate') and direct >= 0.7 and broad < 0.4 and unclear < 0.3 and far <= 20 and known >= 8 then 'a' when trust_rank <= 50 and direct >= 0.6 and confidence <> 'very_wide' and far <= 50 then 'b'
  when trust_rank <= 100 and (loose or broad >= 0.4 or unclear >= 0.3 or known < 8) then 'c' when trust_rank <= 200 or far > 75 then 'e' else 'c' end as synthesis_tier,
  concat_ws(', ', case when loose then 'wide bootstrap interval' end, case when broad >= 0.4 then 'high broad-page dependency' end, case when unclear >= 0.3 then 'high unclear-role share' end, case when far >= 20 then 'large role-weighted movement' end, case when dominant in ('siege_engineer_or_specialist', 'naval_commander', 'coalition_commander') then 'best read as ' || replace(dominant, '_', ' ') end) as reasons from sy0),
syn as (select *, case when synthesis_tier = 'a' then 'Robust elite placement' when synthesis_tier = 'f' then 'Not suitable for headline comparison' when reasons <> '' then 'Qualified by ' || reasons else 'Usable evidence' end as recommendation from sy1)"""


@query(f"""with {SYNTHESIS} select commander_id, trust_rank, synthesis_tier, adjusted_tier, category, confidence, interval80, role_rank, capped_rank, filtered_rank, battle_rank, round(broad, 6) as broad, dominant, array_to_string(flags, ' | ') as flags, recommendation, case when synthesis_tier = 'a' then role_rank - trust_rank end as core_moved from syn""")
def rank_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks, confidence, roles and flags in one table, with synthesis tiers and recommendations; the robust core has its movement."""
    t = synthesis(spark, sf_dir)
    return t.select("commander_id", "trust_rank", "synthesis_tier", "adjusted_tier", "category", "confidence", "interval80", "role_rank", "capped_rank", "filtered_rank", "battle_rank", F.round("broad", 6).alias("broad"), "dominant", F.array_join("flags", " | ").alias("flags"), "recommendation", F.when(F.col("synthesis_tier") == "a", F.col("role_rank") - F.col("trust_rank")).alias("core_moved"))


@query(f"""with {SYNTHESIS}, g as (select commander_id, trust_rank, unnest(list_filter([case when broad >= 0.4 and trust_rank <= 150 then 'broad_page_sensitive' end, case when abs(role_rank - trust_rank) >= 20 and trust_rank <= 150 then 'role_sensitive' end, case when dominant = 'coalition_commander' and trust_rank <= 200 then 'coalition_sensitive' end, case when loose and trust_rank <= 100 then 'confidence_limited' end,
  case when dominant in ('siege_engineer_or_specialist', 'naval_commander', 'staff_or_planning_role') and trust_rank <= 250 then 'category_specific' end, case when known < 8 and trust_rank <= 150 then 'evidence_limited' end, case when synthesis_tier = 'f' then 'nominal_or_political_risk' end], lambda x: x is not null)) as caveat from syn),
  r as (select *, row_number() over (partition by caveat order by trust_rank) as place from g) select caveat, commander_id, place::int as place from r where place <= 40""")
def report_caveat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven overlapping caveat groups, the 40 best ranked of each."""
    c = F.col
    rank, role = c("trust_rank"), c("dominant")
    groups = {
        "broad_page_sensitive": (c("broad") >= 0.40) & (rank <= 150),
        "role_sensitive": (F.abs("moved") >= 20) & (rank <= 150),
        "coalition_sensitive": (role == "coalition_commander") & (rank <= 200),
        "confidence_limited": c("confidence").isin("wide", "very_wide") & (rank <= 100),
        "category_specific": role.isin("siege_engineer_or_specialist", "naval_commander", "staff_or_planning_role") & (rank <= 250),
        "evidence_limited": (c("known") < 8) & (rank <= 150),
        "nominal_or_political_risk": c("synthesis_tier") == "f",
    }
    g = synthesis(spark, sf_dir).select("commander_id", "trust_rank", F.explode(F.filter(F.array(*(F.when(v, k) for k, v in groups.items())), lambda x: x.isNotNull())).alias("caveat"))
    return g.withColumn("place", unique_rank(["caveat"], [F.asc("trust_rank")])).filter("place <= 40").select("caveat", "commander_id", "place")
