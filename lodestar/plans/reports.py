"""Report queries: interpretation, risk, snapshot checks, unresolved results, changes, recovery, quality, lookups, the dashboard.

The set of rows under the broader gate stands for the snapshot before verification, the strict gate for the one after.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.curation import OTHER, SPARK
from lodestar.functions.scores import OUTCOME_SCORES, ratio, steady
from lodestar.functions.text import percent_text
from lodestar.operators.snapshots import field_changes
from lodestar.operators.tables import shared_table
from lodestar.operators.windows import top_by
from lodestar.plans.binding import FACT, engagements, table
from lodestar.plans.curation import _STATUS, audited, built, chain, results
from lodestar.plans.ranking import _sum_sql, MODELS, RANKED, TRUST, TRUSTED, confidence, fact, prepared, ranked, sensitivity, stability, trust_tier
from lodestar.plans.registry import query

# Interpretive eras and how many of each a shortlist holds; letters of the rank signature.
ERA_OF = {"ancient": "ancient", "medieval": "medieval", "early_modern": "early_modern", "revolutionary_napoleonic": "modern", "long_nineteenth_century": "modern", "world_wars": "modern", "cold_war": "modern", "contemporary": "contemporary"}
SLOTS = {"ancient": 4, "medieval": 5, "early_modern": 6, "modern": 8, "contemporary": 4}
LETTERS = {"B0": "baseline_conservative", "B1": "battle_only_baseline", "HT": "hierarchical_trust_v2", "H": "hierarchical_weighted", "HF": "hierarchical_full_credit", "HE": "hierarchical_equal_split", "HB": "hierarchical_broader_eligibility"}
BANDS = {"robust_elite_core": 1, "strong_upper_tier": 2, "model_sensitive_band": 3, "high_confidence_upper_band": 4}


def _case(c: str, values: dict[str, object], other: str) -> str:
    return f"case {c} " + " ".join(f"when '{k}' then {v!r}" for k, v in values.items()) + f" else {other} end"


def _main_era(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fact(spark, sf_dir).groupBy("commander_id", "era").agg(F.count("*").alias("n"))
    return n.groupBy("commander_id").agg(F.min_by("era", F.struct(-F.col("n"), F.col("era"))).alias("era"))


_DRIVER = """case when n_drivers = 1 and higher then 'higher_level_page_dependency' when n_drivers = 1 and battle then 'battle_specialist_profile' when n_drivers = 1 then 'credit_rule_dependency' else 'mixed_model_sensitivity' end"""
_WIDE = {
    "battle_gap": "battle_only_baseline - hierarchical_weighted", "base_gap": "baseline_conservative - hierarchical_weighted", "credit_gain": "hierarchical_weighted - hierarchical_full_credit", "split_gain": "hierarchical_weighted - hierarchical_equal_split",
}
_FLAGS = {
    "higher": "coalesce(higher_share >= 0.5 or battle_gap >= 100 or base_gap >= 75, false) or coalesce(battle_gap >= 100, false) or coalesce(base_gap >= 75, false) or coalesce(higher_share >= 0.5, false)",
    "battle": "coalesce(battle_gap <= -50, false) or coalesce(base_gap <= -50, false)", "credit": "coalesce(abs(credit_gain) >= 50, false)",
}
_AUDIT = "best <= 100 and (coalesce(spread >= 50, false) or coalesce(abs(credit_gain) >= 50, false) or coalesce(abs(battle_gap) >= 80, false) or coalesce(abs(base_gap) >= 80, false) or coalesce(higher_share >= 0.5, false) or (best <= 5 and coalesce(spread >= 30, false)) or coalesce(trust_tier = 'model_sensitive_band', false))"
_SIGN = "concat(" + ", ', ', ".join(f"'{k}=', coalesce(cast({m} as varchar), 'NA')" for k, m in LETTERS.items()) + ")"

_INTERPRET = TRUST + f""", wide as (select commander_id, {", ".join(f"max(case when model = '{m}' then rank end) as {m}" for m in MODELS)} from ranked group by 1),
me as (select commander_id, era, row_number() over (partition by commander_id order by count(*) desc, era) as rn from fact group by 1, 2),
i0 as (select stable.*, trust_tier, {", ".join(MODELS)}, {_case("era", ERA_OF, "'modern'")} as ie from stable left join (select commander_id, trust_tier from trust) using (commander_id) join wide using (commander_id) join (select commander_id, era from me where rn = 1) using (commander_id)),
i1 as (select *, {", ".join(f"{v} as {k}" for k, v in _WIDE.items())} from i0), i2 as (select *, {", ".join(f"{v} as {k}" for k, v in _FLAGS.items())} from i1), i3 as (select *, higher::int + battle::int + credit::int as n_drivers from i2),
i4 as (select *, {_DRIVER} as driver, {_SIGN} as signature, {_AUDIT} as audited, coalesce(trust_tier, 'outside_trust_headline') as grp from i3),
ia as (select commander_id, row_number() over (order by best, round(mean, 9), name) as audit_place from i4 where audited),
b0 as (select *, {_case("grp", BANDS, "null")} as band from i4), b1 as (select *, case when band = 1 then round(mean, 9) else best end as k1, case band when 1 then best when 2 then -top25 else round(mean, 9) end as k2, case when band = 2 then round(mean, 9) else 0 end as k3 from b0 where band is not null and (band <> 3 or best <= 100)),
b2 as (select *, row_number() over (partition by ie, case when band > 2 then 3 else band end order by band, k1, k2, k3, commander_id) as rn, count_if(band = 1) over (partition by ie) as robust, count_if(band = 2) over (partition by ie) as strong, {_case("ie", SLOTS, "0")} as slots from b1),
b3 as (select *, least(robust, slots) + least(strong, greatest(slots - robust, 0)) as chosen from b2),
short as (select commander_id from b3 where case when band = 1 then rn <= slots when band = 2 then rn <= greatest(slots - robust, 0) else rn <= slots - chosen end)"""


@query(f"with {_INTERPRET} select i4.commander_id, battle_gap, base_gap, credit_gain, split_gain, driver, signature, grp, ie as era, case when audit_place <= 20 then audit_place::int end as audit_place, short.commander_id is not null as shortlisted from i4 left join ia using (commander_id) left join short on short.commander_id = i4.commander_id")
def report_interpretation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank gaps, what drives them, the signature of all ranks, the audit's first twenty and each era's shortlist."""
    r = shared_table(ranked(spark, sf_dir), "ranked")
    wide = r.groupBy("commander_id").pivot("model", list(MODELS)).agg(F.max("rank"))
    s = stability(sensitivity(r)).withColumn("label", F.when(F.col("trust_rank").isNotNull(), confidence(F.col("spread"))))
    s = s.withColumn("trust_tier", F.when(F.col("trust_rank").isNotNull(), trust_tier(F.col("label"))))
    i = s.join(wide, "commander_id").join(_main_era(spark, sf_dir), "commander_id").withColumn("ie", F.expr(_case("era", ERA_OF, "'modern'")))
    i = i.withColumns({k: F.expr(v) for k, v in _WIDE.items()}).withColumns({k: F.expr(v) for k, v in _FLAGS.items()})
    i = i.withColumn("n_drivers", F.col("higher").cast("int") + F.col("battle").cast("int") + F.col("credit").cast("int"))
    i = i.withColumns({"driver": F.expr(_DRIVER), "signature": F.expr(_SIGN.replace("varchar", "string")), "audited": F.expr(_AUDIT), "grp": F.coalesce("trust_tier", F.lit("outside_trust_headline")), "m9": F.round("mean", 9)})
    i = shared_table(i.drop("label"), "interpretation")
    # The first twenty of the audit, and at most eight of a band and era, are bounded top-k results.
    audit = i.filter("audited").orderBy("best", "m9", "name").limit(20)
    audit = audit.selectExpr("commander_id", "cast(row_number() over (order by best, m9, name) as int) as audit_place")
    b = i.withColumn("band", F.expr(_case("grp", BANDS, "null"))).filter("band is not null and (band <> 3 or best <= 100)")
    b = b.withColumns({"k1": F.expr("case when band = 1 then m9 else best end"), "k2": F.expr("case band when 1 then best when 2 then -top25 else m9 end"), "k3": F.expr("case when band = 2 then m9 else 0 end"), "pile": F.least("band", F.lit(3))})
    sizes = b.groupBy("ie").agg(F.count_if(F.col("band") == 1).alias("robust"), F.count_if(F.col("band") == 2).alias("strong"))
    best = top_by(b, ["ie", "pile"], [F.asc(k) for k in ("band", "k1", "k2", "k3", "commander_id")], max(SLOTS.values())).join(F.broadcast(sizes), "ie").withColumn("slots", F.expr(_case("ie", SLOTS, "0")))
    best = best.withColumn("chosen", F.expr("least(robust, slots) + least(strong, greatest(slots - robust, 0))")).filter("case when band = 1 then rn <= slots when band = 2 then rn <= greatest(slots - robust, 0) else rn <= slots - chosen end")
    out = i.join(F.broadcast(audit), "commander_id", "left").join(F.broadcast(best.select("commander_id", F.lit(True).alias("shortlisted"))), "commander_id", "left")
    return out.select("commander_id", *_WIDE, "driver", "signature", "grp", F.col("ie").alias("era"), "audit_place", F.coalesce("shortlisted", F.lit(False)).alias("shortlisted"))


# --- risk --------------------------------------------------------------------------------------------

_RISK = {
    "suspect_share": "suspect / greatest(total, engagements_now, 1) * 1.0", "broad_share": "broad / greatest(total, engagements_now, 1) * 1.0", "trust_delta": "rank_now - rank_before", "weighted_delta": "weighted_now - rank_before", "drop_rows": "greatest(engagements_before - engagements_now, 0)", "drop_known": "greatest(known_before - known_now, 0)",
    "drop_wars": "greatest(wars_before - wars_now, 0)", "drop_campaigns": "greatest(campaigns_before - campaigns_now, 0)", "drop_wins": "greatest(wins_before - wins_now, 0)",
}
_FAR = "greatest(abs(trust_delta), abs(weighted_delta))"
_OUTCOME_FLAGS = ["losses_now = 0 and open_now >= 3 and rank_now <= 50", "drop_wins >= 3", "drop_known >= 3", "open_battles >= 3 and rank_now <= 50", "label in ('moderate', 'caution') and rank_now <= 25"]
_STRUCTURE_FLAGS = ["suspect > 0", "broad > 0", "drop_wars > 0", "drop_campaigns > 0", "drop_rows >= 3", f"{_FAR} >= 5"]
# Weights and bands of the audit.
_SCORE = f"cast(round(suspect_share * 50) as int) + cast(round(broad_share * 20) as int) + least(drop_rows, 8) + least(drop_known, 6) + least(drop_wins, 6) + case when {_FAR} >= 10 then 5 when {_FAR} >= 5 then 3 else 0 end + case when rank_now <= 10 then 3 when rank_now <= 25 then 2 else 0 end + case when losses_now = 0 and open_now >= 3 then 3 else 0 end + case when tier not in ('robust_elite_core', 'strong_upper_tier') and rank_now <= 25 then 3 else 0 end"
_BAND = f"""case when (rank_now <= 25 and (suspect_share >= 0.20 or drop_rows >= 8)) or (rank_now <= 15 and suspect >= 5) or (rank_now <= 25 and n_outcome >= 2 and suspect >= 2) or (rank_now <= 50 and label in ('moderate', 'caution') and n_outcome >= 2) then 'high_priority_manual_audit'
  when suspect = 0 and broad <= 2 and drop_rows <= 3 and drop_known <= 2 and {_FAR} <= 5 and n_outcome <= 1 then 'structurally_clean' when suspect <= 3 and suspect_share < 0.15 and broad_share < 0.30 and drop_rows <= 5 and n_outcome <= 2 and {_FAR} < 10 then 'mildly_inflated' else 'materially_inflated' end"""
_SENSITIVE = f"case when {_FAR} >= 10 or drop_rows >= 8 then 'high' when {_FAR} >= 4 or drop_rows >= 3 or broad > 0 then 'moderate' else 'stable' end"
_COUNT = lambda flags: " + ".join(f"cast(({f}) as int)" for f in flags)
_ROWS = {
    "total": "true", "suspect": f"{_STATUS} = 'structurally_suspect'", "broad": f"{_STATUS} = 'verified_broad' and page_type = 'war_conflict_article'", "wins_now": "strict and outcome in ('victory', 'decisive_victory')", "wins_before": "balanced and outcome in ('victory', 'decisive_victory')",
    "losses_now": "strict and outcome in ('defeat', 'major_defeat')", "open_now": "strict and outcome = 'unknown'", "open_battles": "strict and outcome = 'unknown' and page_type = 'battle_article'",
}
_PER_MODEL = {"now": "hierarchical_trust_v2", "before": "hierarchical_broader_eligibility"}

_RISK_SQL = TRUST + f""", k as (select commander_id, {", ".join(f"count_if({v}) as {n}" for n, v in _ROWS.items())} from fact group by 1),
m as (select commander_id, {", ".join(f"max(case when model = '{m}' then {c} end) as {c}_{t}" for t, m in _PER_MODEL.items() for c in ("rank", "engagements", "known", "wars", "campaigns"))}, max(case when model = 'hierarchical_weighted' then rank end) as weighted_now from ranked group by 1),
r0 as (select k.*, m.* exclude (commander_id), label, trust_tier as tier from k join m using (commander_id) join trust using (commander_id) where rank_now is not null), r1 as (select *, {", ".join(f"{v} as {n}" for n, v in _RISK.items())} from r0),
r2 as (select *, {_COUNT(_OUTCOME_FLAGS)} as n_outcome, {_COUNT(_STRUCTURE_FLAGS)} as n_structure from r1), r3 as (select *, {_SCORE} as risk, {_BAND} as band, {_SENSITIVE} as sensitivity from r2)"""


@query(f"with {_RISK_SQL}, q as (select *, band = 'high_priority_manual_audit' or n_outcome >= 2 as manual from r3), f as (select commander_id, row_number() over (order by risk desc, rank_now) as rn from q where manual) select commander_id, risk::bigint as risk, band, sensitivity, n_outcome::int as outcome_flags, n_structure::int as structure_flags, manual, manual or band in ('materially_inflated', 'high_priority_manual_audit') as priority, coalesce(rn <= 25, false) or commander_id in (1, 2) as audited from q left join f using (commander_id)")
def rule_inflation_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk score with its band, flags and sensitivity; the review queue, and the audited set: its first 25 and two that are always audited."""
    r = shared_table(ranked(spark, sf_dir, sorted({*TRUSTED, *_PER_MODEL.values()})), "ranked")
    pick = lambda m, col: F.max(F.when(F.col("model") == m, F.col(col)))
    m = r.groupBy("commander_id").agg(*(pick(m, c).alias(f"{c}_{t}") for t, m in _PER_MODEL.items() for c in ("rank", "engagements", "known", "wars", "campaigns")), pick("hierarchical_weighted", "rank").alias("weighted_now"))
    s = stability(sensitivity(r)).filter("trust_rank is not null").withColumn("label", confidence(F.col("spread")))
    s = s.select("commander_id", "label", trust_tier(F.col("label")).alias("tier"))
    k = fact(spark, sf_dir).groupBy("commander_id").agg(*(F.count_if(F.expr(v)).alias(n) for n, v in _ROWS.items()))
    q = k.join(m, "commander_id").join(s, "commander_id").filter("rank_now is not null").withColumns({n: F.expr(v) for n, v in _RISK.items()})
    q = q.withColumns({"n_outcome": F.expr(_COUNT(_OUTCOME_FLAGS)), "n_structure": F.expr(_COUNT(_STRUCTURE_FLAGS))}).withColumns({"risk": F.expr(_SCORE), "band": F.expr(_BAND), "sensitivity": F.expr(_SENSITIVE)})
    q = shared_table(q.withColumn("manual", F.expr("band = 'high_priority_manual_audit' or n_outcome >= 2")), "risk")
    first = q.filter("manual").orderBy(F.desc("risk"), "rank_now").limit(25).select("commander_id").union(spark.createDataFrame([(1,), (2,)], "commander_id long")).distinct().withColumn("audited", F.lit(True))
    out = q.join(F.broadcast(first), "commander_id", "left")
    return out.select("commander_id", F.col("risk").cast("long").alias("risk"), "band", "sensitivity", F.col("n_outcome").alias("outcome_flags"), F.col("n_structure").alias("structure_flags"), "manual", (F.col("manual") | F.col("band").isin("materially_inflated", "high_priority_manual_audit")).alias("priority"), F.coalesce("audited", F.lit(False)).alias("audited"))


# --- checks of a snapshot ----------------------------------------------------------------------------

_NON_PERSON = "(army|corps|division|brigade|regiment|fleet|forces|government)"


@query(f"""with {TRUST}, h as (select commander_id, rank, name, score from ranked where model = 'hierarchical_trust_v2'), t10 as (select array_agg(name order by rank) as a, array_agg(name order by score desc, r_outcome desc, engagements desc, name) as b from ranked where model = 'hierarchical_trust_v2' and rank <= 10),
  credit as (select count_if(case when valid and known then abs(k_split - 1 / sqrt(known_n)) >= 1e-5 else k_split <> 0 end) as bad from prep), both_ as (select count(*) as n from (select commander_id from h where rank <= 10 intersect select commander_id from ranked where model = 'hierarchical_weighted' and rank <= 10))
  select 'credit_is_split' as check_name, bad::bigint as value, bad = 0 as passed from credit union all select 'tops_match_metrics', len(a), a = b from t10 union all select 'stability_covers_top', count(*), count(*) = 0 from h where rank <= 100 and commander_id not in (select commander_id from stable)
  union all select 'contributions_cover_top', count(*), count(*) = 0 from h where rank <= 100 and commander_id not in (select commander_id from masses where set = 'b') union all select 'tiers_in_domain', count(*), count(*) = 0 from trust where trust_tier not in ('robust_elite_core', 'strong_upper_tier', 'high_confidence_upper_band', 'model_sensitive_band', 'outside_trust_headline')
  union all select 'strict_pages_kept', count(distinct page_id), count(distinct page_id) >= 11640 from fact where strict union all select 'no_non_person_names', count(*), count(*) = 0 from h where regexp_matches(lower(name), '{_NON_PERSON}') union all select 'top10_overlap', n, n >= 6 from both_
  union all select 'core_is_not_fragile', count(*), count(*) = 0 from trust where trust_tier = 'robust_elite_core' and (higher_share >= 0.5 or battles < 4)""")
def verify_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine checks of a finished snapshot: invariants, coverage, domains, tops against exported metrics, regression gates."""
    r = shared_table(ranked(spark, sf_dir, TRUSTED), "ranked")
    h = r.filter(F.col("model") == "hierarchical_trust_v2")
    top = h.filter("rank <= 100").select("commander_id")
    s = stability(sensitivity(r)).filter("trust_rank is not null").withColumn("label", confidence(F.col("spread")))
    t = shared_table(s.withColumn("trust_tier", trust_tier(F.col("label"))), "trust")
    p = prepared(spark, sf_dir)
    bad = F.when(F.col("valid") & F.col("known"), F.abs(F.col("credit_split") - 1 / F.sqrt("known_n")) >= 1e-5).otherwise(F.col("credit_split") != 0)
    ten = h.filter("rank <= 10")
    # The metrics go out as JSON text and are read back before they are compared.
    exported = ten.agg(F.to_json(F.array_sort(F.collect_list(F.struct(-F.col("score"), -F.col("r_outcome"), -F.col("engagements"), "name")))["name"]).alias("j")).select(F.from_json("j", "array<string>").alias("b"))
    both = ten.select("commander_id").intersect(r.filter((F.col("model") == "hierarchical_weighted") & (F.col("rank") <= 10)).select("commander_id"))
    tiers = ["robust_elite_core", "strong_upper_tier", "high_confidence_upper_band", "model_sensitive_band", "outside_trust_headline"]
    rows = fact(spark, sf_dir)

    def check(name: str, df: DataFrame, value: Column, passed) -> DataFrame:
        return df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("check_name"), "value", passed(F.col("value")).alias("passed"))

    none = lambda v: v == 0
    made = ten.agg(F.array_sort(F.collect_list(F.struct("rank", "name")))["name"].alias("a")).join(exported, how="cross").select(F.lit("tops_match_metrics").alias("check_name"), F.size("a").cast("long").alias("value"), (F.col("a") == F.col("b")).alias("passed"))
    checks = [
        check("credit_is_split", p, F.count_if(bad), none), made, check("stability_covers_top", top.join(s, "commander_id", "left_anti"), F.count("*"), none),
        check("contributions_cover_top", top.join(rows.filter("strict"), "commander_id", "left_anti"), F.count("*"), none), check("tiers_in_domain", t, F.count_if(~F.col("trust_tier").isin(tiers)), none),
        check("strict_pages_kept", rows.filter("strict"), F.countDistinct("page_id"), lambda v: v >= 11640), check("no_non_person_names", h, F.count_if(F.rlike(F.lower("name"), F.lit(_NON_PERSON))), none), check("top10_overlap", both, F.count("*"), lambda v: v >= 6),
        check("core_is_not_fragile", t, F.count_if((F.col("trust_tier") == "robust_elite_core") & ((F.col("higher_share") >= 0.5) | (F.col("battles") < 4))), none),
    ]
    return reduce(DataFrame.unionByName, checks)


_NAMED = ["Supplier#000000001", "Supplier#000000004", "Supplier#000000009", "000000006", "Nobody"]


@query(f"""with {RANKED}, a as (select name, rank, score from ranked where model = 'hierarchical_broader_eligibility'), b as (select name, rank, score from ranked where model = 'hierarchical_trust_v2'), w as (select unnest({_NAMED!r}) as wanted),
  m as (select wanted, name, row_number() over (partition by wanted order by (name = wanted)::int desc, rank, name) as rn from w left join (select name, min(rank) as rank from (select name, rank from a union all select name, rank from b) group by 1) n on name = wanted or contains(lower(name), lower(wanted)))
  select wanted, m.name, a.rank as rank_before, b.rank as rank_after, round(b.score - a.score, 6) as score_change, case when m.name is null then 'missing' when m.name = wanted then 'exact' else 'contains' end as found from m left join a on a.name = m.name left join b on b.name = m.name where rn = 1""")
def verify_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named entities before and after: looked up exactly, else as a part of a name, the best ranked first."""
    r = shared_table(ranked(spark, sf_dir, ["hierarchical_broader_eligibility", "hierarchical_trust_v2"]).select("model", "name", "rank", "score"), "named")
    wanted = spark.createDataFrame([(n,) for n in _NAMED], "wanted string")
    pick = lambda m, c: F.max(F.when(F.col("model") == m, F.col(c)))
    n = r.groupBy("name").agg(F.min("rank").alias("rank"), *(pick(m, c).alias(f"{c}_{t}") for t, m in (("before", "hierarchical_broader_eligibility"), ("after", "hierarchical_trust_v2")) for c in ("rank", "score")))
    # A handful of wanted names is broadcast against all.
    met = n.join(F.broadcast(wanted), (n.name == wanted.wanted) | F.contains(F.lower("name"), F.lower("wanted")))
    best = met.groupBy("wanted").agg(F.min_by(F.struct("name", "rank_before", "rank_after", "score_before", "score_after"), F.struct((F.col("name") != F.col("wanted")).alias("part"), F.col("rank"), F.col("name"))).alias("x"))
    out = wanted.join(best, "wanted", "left").select("wanted", "x.*")
    found = F.when(F.col("name").isNull(), "missing").when(F.col("name") == F.col("wanted"), "exact").otherwise("contains")
    return out.select("wanted", "name", "rank_before", "rank_after", F.round(F.col("score_after") - F.col("score_before"), 6).alias("score_change"), found.alias("found"))


# --- results, changes, recovery, quality -------------------------------------------------------------

_GENERIC = "lower(trim(result)) in ('victory', 'defeat')"


@query(f"""with {chain(OTHER, results(OTHER))}, r as (select *, stored in ('', 'unknown') as before, kind in ('', 'unknown') as after from l3)
  select raw_a as side, count(*) as rows, count_if(before) as unknown_before, count_if(after) as unknown_after, count_if(source = 'sanitized_result_raw') as repaired, count(distinct case when source = 'sanitized_result_raw' then p_partkey end) as repaired_pages, count_if({_GENERIC} and before) as generic_unknown,
    count_if(contains(lower(result), 'victory')) as says_victory, coalesce(string_agg(distinct fixed, '; ' order by fixed) filter (after and fixed <> ''), '') as unresolved, count_if(after and fixed <> '') as n_unresolved from r group by 1""")
def report_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown results before and after repair, pattern counts, and what stays unresolved on each side."""
    r = built(spark, sf_dir, results(SPARK)).selectExpr("*", "stored in ('', 'unknown') as before", "kind in ('', 'unknown') as after")
    n = lambda cond: F.count_if(F.expr(cond))
    fixed = F.collect_set(F.expr("case when after and fixed <> '' then fixed end"))
    # A row of the table is one page, so repaired rows and pages are alike in number.
    return r.groupBy(F.col("raw_a").alias("side")).agg(
        F.count("*").alias("rows"), n("before").alias("unknown_before"), n("after").alias("unknown_after"), n("source = 'sanitized_result_raw'").alias("repaired"), F.countDistinct(F.expr("case when source = 'sanitized_result_raw' then p_partkey end")).alias("repaired_pages"),
        n(f"{_GENERIC} and before").alias("generic_unknown"), n("contains(lower(result), 'victory')").alias("says_victory"), F.array_join(F.array_sort(fixed), "; ").alias("unresolved"), n("after and fixed <> ''").alias("n_unresolved"),
    )


_AFTER = "case when n_lines > 1 and outcome in ('victory', 'decisive_victory') then 'unknown' else outcome end"


@query(f"""with {FACT}, x as (select *, {_AFTER} as after from fact), p as (select page_id, count(*) as rows, count_if(outcome <> after) as changed, string_agg(distinct outcome || ' > ' || after, '; ' order by outcome || ' > ' || after) filter (outcome <> after) as moves from x group by 1 having count_if(outcome <> after) > 0),
  r as (select *, row_number() over (order by changed desc, rows desc, page_id) as place from p) select page_id, rows, changed, moves, place::int as place from r where place <= 12""")
def report_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve pages whose rows changed most between two snapshots, and how."""
    x = engagements(spark, sf_dir).withColumn("after", F.expr(_AFTER))
    changed = F.col("outcome") != F.col("after")
    p = x.groupBy("page_id").agg(F.count("*").alias("rows"), F.count_if(changed).alias("changed"), F.array_join(F.array_sort(F.collect_set(F.when(changed, F.concat("outcome", F.lit(" > "), "after")))), "; ").alias("moves")).filter("changed > 0")
    top = p.orderBy(F.desc("changed"), F.desc("rows"), "page_id").limit(12)
    return top.selectExpr("page_id", "rows", "changed", "moves", "cast(row_number() over (order by changed desc, rows desc, page_id) as int) as place")


@query(f"""with {FACT}, k as (select commander_id, count_if(outcome in ('victory', 'decisive_victory')) / count(*)::double as a, count_if({_AFTER} in ('victory', 'decisive_victory')) / count(*)::double as b from fact group by 1),
  t as (select commander_id, case when a >= 0.3 then 'upper' when a >= 0.25 then 'middle' else 'lower' end as before, case when b >= 0.3 then 'upper' when b >= 0.25 then 'middle' else 'lower' end as after from k)
  select before as tier, 'left' as way, count(*) as n, string_agg(commander_id::varchar, ' | ' order by commander_id) as members from t where before <> after group by 1 union all select after, 'entered', count(*), string_agg(commander_id::varchar, ' | ' order by commander_id) from t where before <> after group by 1""")
def report_tier_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who left and who entered each tier between two snapshots, as set differences."""
    wins = lambda c: F.count_if(F.expr(f"{c} in ('victory', 'decisive_victory')")) / F.count("*")
    k = engagements(spark, sf_dir).groupBy("commander_id").agg(wins("outcome").alias("a"), wins(_AFTER).alias("b"))
    tier = lambda c: F.when(F.col(c) >= 0.3, "upper").when(F.col(c) >= 0.25, "middle").otherwise("lower")
    t = k.select("commander_id", tier("a").alias("before"), tier("b").alias("after")).filter("before <> after")
    moves = t.select("commander_id", F.explode(F.array(F.struct(F.col("before").alias("tier"), F.lit("left").alias("way")), F.struct(F.col("after").alias("tier"), F.lit("entered").alias("way")))).alias("m"))
    ids = F.transform(F.array_sort(F.collect_list("commander_id")), lambda x: x.cast("string"))
    return moves.groupBy("m.tier", "m.way").agg(F.count("*").alias("n"), F.array_join(ids, " | ").alias("members"))


_FETCH, _BUILD = "(event_id * 7 % 400)", "(event_id * 13 % 300)"
_RECOVERY = {
    "size": "case when event_id * 997 % 500000 < 25000 then 'small' when event_id * 997 % 500000 < 100000 then 'medium' when event_id * 997 % 500000 < 400000 then 'large' else 'very_large' end",
    "bottleneck": f"case when {_FETCH} <= 0 and {_BUILD} <= 0 then 'timeout_no_result' when {_FETCH} > {_BUILD} * 1.5 then 'network_bound' when {_BUILD} > {_FETCH} * 1.5 then 'parsing_bound' else 'mixed' end",
    "error": "case event_id % 7 when 0 then 'fetch_error' when 1 then 'worker_exit' when 2 then 'task_timeout' when 3 then 'rate_limit' else '' end",
}
_RETRY = "case when error = '' then 'recovered_full' when error in ('fetch_error', 'worker_exit', 'task_timeout', 'missing_or_unavailable') then case when event_id % 5 = 0 then concat('failed_', error) else 'recovered_fallback' end else concat('failed_', error) end"


@query(f"with e as (select event_id, event_type, {', '.join(f'{v} as {k}' for k, v in _RECOVERY.items())} from events), s as (select *, {_RETRY} as state from e) select event_type, size, bottleneck, state, count(*) as n, (grouping(event_type) * 8 + grouping(size) * 4 + grouping(bottleneck) * 2 + grouping(state))::bigint as level from s group by grouping sets ((event_type), (size), (bottleneck), (state), (bottleneck, state))")
def report_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts by bottleneck, size, source and final state: a full attempt that fails for a passing reason is tried once more in the fallback mode."""
    s = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", *(f"{v} as {k}" for k, v in _RECOVERY.items())).withColumn("state", F.expr(_RETRY))
    t, z, b, w = (F.col(c) for c in ("event_type", "size", "bottleneck", "state"))
    return s.groupingSets([[t], [z], [b], [w], [b, w]], t, z, b, w).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query(f"""with {chain(OTHER, audited(OTHER))}, i as (select p_partkey, unnest(flags) as issue from l4), n as (select count(*) as rows, count_if(len(flags) > 0) as touched from l4),
  k as (select issue, count(*) as n, min(p_partkey) as example from i group by 1) select issue, k.n, example, round(100.0 * k.n / rows, 6) as percent, format('{{:.1f}}%', 100.0 * k.n / rows) as shown, row_number() over (order by k.n desc, issue)::int as place, touched from k, n""")
def report_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of the row audit by frequency, with shares and an example, and how many rows have any."""
    rows = built(spark, sf_dir, audited(SPARK)).select("p_partkey", "flags")
    k = rows.select("p_partkey", F.explode("flags").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"), F.min("p_partkey").alias("example"))
    total = rows.agg(F.count("*").alias("rows"), F.count_if(F.size("flags") > 0).alias("touched"))
    out = k.join(F.broadcast(total), how="cross")
    share = 100.0 * F.col("n") / F.col("rows")
    # One row an issue: the order runs over a dozen rows.
    return out.select("issue", "n", "example", F.round(share, 6).alias("percent"), percent_text(share).alias("shown"), F.expr("cast(row_number() over (order by n desc, issue) as int)").alias("place"), "touched")


# --- dashboard ---------------------------------------------------------------------------------------


@query(f"""with {RANKED}, m as (select commander_id, name, list({{'model': model, 'rank': rank, 'score': round(score, 4)}} order by model) as models from ranked group by 1, 2), c as (select commander_id, era, count(*) as n from fact group by 1, 2), e as (select commander_id, list({{'era': era, 'n': n}} order by era) as eras from c group by 1)
  select commander_id, to_json({{'commander_id': commander_id, 'name': name, 'models': models, 'eras': eras}})::varchar as json from m left join e using (commander_id)""")
def report_dashboard_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON record a commander: models and eras."""
    r = ranked(spark, sf_dir).groupBy("commander_id", "name").agg(F.array_sort(F.collect_list(F.struct("model", "rank", F.round("score", 4).alias("score")))).alias("models"))
    e = fact(spark, sf_dir).groupBy("commander_id", "era").agg(F.count("*").alias("n")).groupBy("commander_id").agg(F.array_sort(F.collect_list(F.struct("era", "n"))).alias("eras"))
    return r.join(e, "commander_id", "left").select("commander_id", F.to_json(F.struct("commander_id", "name", "models", "eras")).alias("json"))


@query("""with o as (select c_custkey, c_name, c_acctbal, c_mktsegment, c_nationkey from customer where c_custkey % 11 <> 0), n as (select c_custkey, case when c_custkey % 5 = 0 then lower(c_name) else c_name end as c_name, case when c_custkey % 7 = 0 then c_acctbal + 1 when c_custkey % 7 = 1 then null else c_acctbal end as c_acctbal,
    case when c_custkey % 6 = 0 then c_nationkey + 1 else c_nationkey end as c_nationkey, case when c_custkey % 4 <> 0 then c_custkey % 3 end as grade from customer where c_custkey % 13 <> 0), b as (select o.*, n.c_name as n_name, n.c_acctbal as n_bal, n.c_nationkey as n_nation, grade from o join n using (c_custkey))
  select c_custkey, null::varchar as field, 'row_added' as change, null::varchar as old, null::varchar as new from n where c_custkey not in (select c_custkey from o) union all select c_custkey, null, 'row_lost', null, null from o where c_custkey not in (select c_custkey from n)
  union all select c_custkey, 'c_name', 'value', c_name, n_name from b where c_name <> n_name union all select c_custkey, 'c_acctbal', 'value', printf('%.2f', c_acctbal), printf('%.2f', n_bal) from b where c_acctbal is distinct from n_bal
  union all select c_custkey, 'c_nationkey', 'value', c_nationkey::varchar, n_nation::varchar from b where c_nationkey <> n_nation union all select c_custkey, 'c_mktsegment', 'field_lost', c_mktsegment, null from b where c_mktsegment is not null
  union all select c_custkey, 'grade', 'field_added', null, grade::varchar from b where grade is not null""")
def report_field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes between two written snapshots of the customers, by field: rows and fields added and lost, a type and values changed."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    old = shared_table(c.filter(key % 11 != 0).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey"), "before")
    new = c.filter(key % 13 != 0).select(
        "c_custkey", F.when(key % 5 == 0, F.lower("c_name")).otherwise(F.col("c_name")).alias("c_name"), F.when(key % 7 == 0, F.col("c_acctbal") + 1).when(key % 7 != 1, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(key % 6 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).cast("string").alias("c_nationkey"), F.when(key % 4 != 0, key % 3).cast("int").alias("grade"),
    )
    found = field_changes(old, shared_table(new, "after"), ["c_custkey"])
    # Two digits as text, as the languages write doubles differently.
    money = lambda c: F.when(F.col("field") == "c_acctbal", F.format_string("%.2f", F.col(c).try_cast("double"))).otherwise(F.col(c))
    return found.select("c_custkey", "field", "change", F.when(F.col("old").isNotNull(), money("old")).alias("old"), F.when(F.col("new").isNotNull(), money("new")).alias("new"))


#: Pages of a record.
TOP_PAGES = 5


@query(f"""with {RANKED}, sig as (select commander_id, page_id, page_type, outcome, case when abs(v) > 0 then abs(v) else 0.15::double * p end as c from (select *, w_strict * k_split * {_sum_sql(OUTCOME_SCORES["balanced"], "outcome")} as v, w_strict * p_full as p from prep where w_strict > 0)),
  top as (select commander_id, list({{'page_id': page_id, 'page_type': page_type, 'outcome': outcome, 'millionths': round(c * 1000000)::bigint}} order by rn) as pages from (select *, row_number() over (partition by commander_id order by round(c, 9) desc, page_id) as rn from sig) where rn <= {TOP_PAGES} group by 1),
  kinds as (select commander_id, list({{'page_type': page_type, 'pages': n, 'millionths': round(case when total = 0 then 0 else c / total end * 1000000)::bigint}} order by page_type) as contributions from (select *, sum(c) over (partition by commander_id) as total from (select commander_id, page_type, count(*) as n, sum(c) as c from sig group by 1, 2)) group by 1),
  m as (select commander_id, name, list({{'model': model, 'rank': rank, 'tier': tier}} order by model) as models, max(case when model = 'hierarchical_trust_v2' then profile end) as profile,
    list_filter([case when max(case when model = 'hierarchical_trust_v2' then higher_share end) >= 0.5 then 'higher_level_dependent' end, case when max(case when model = 'hierarchical_trust_v2' then known_share end) < 0.4 then 'low_evidence' end, case when max(case when model = 'hierarchical_trust_v2' then known end) < 8 then 'sparse' end], lambda x: x is not null) as flags from ranked group by 1, 2),
  e as (select commander_id, list({{'era': era, 'n': n}} order by era) as eras from (select commander_id, era, count(*) as n from fact group by 1, 2) group by 1)
  select commander_id, to_json({{'commander_id': commander_id, 'name': name, 'profile': coalesce(profile, ''), 'flags': flags, 'models': models, 'contributions': coalesce(contributions, []), 'pages': coalesce(pages, []), 'eras': coalesce(eras, [])}})::varchar as json from m left join kinds using (commander_id) left join top using (commander_id) left join e using (commander_id)""")
def report_dashboard_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested record a commander: models, profile, flags, shares of page types, eras, and the pages that count most.

    The pages are ranked with a limit that each task applies before the shuffle, so a commander's pages never meet in one place.
    """
    f = prepared(spark, sf_dir).filter("weight_strict > 0")
    v = F.abs(F.col("weight_strict") * F.col("credit_split") * F.col("score_balanced"))
    signal = F.when(v > 0, v).otherwise(0.15 * F.col("weight_strict") * F.col("presence_full"))
    s = f.select("commander_id", "page_id", "page_type", "outcome", signal.alias("c"))
    millionths = lambda c: F.round(c * 1_000_000).cast("long").alias("millionths")
    listed = lambda *cols: F.array_sort(F.collect_list(F.struct(*cols)))
    top = top_by(s, ["commander_id"], [F.desc(steady(F.col("c"))), F.asc("page_id")], TOP_PAGES)
    top = top.groupBy("commander_id").agg(F.transform(listed("rn", "page_id", "page_type", "outcome", millionths(F.col("c"))), lambda x: F.struct(x["page_id"].alias("page_id"), x["page_type"].alias("page_type"), x["outcome"].alias("outcome"), x["millionths"].alias("millionths"))).alias("pages"))
    kinds = s.groupBy("commander_id", "page_type").agg(F.count("*").alias("pages"), F.sum("c").alias("c")).withColumn("total", F.sum("c").over(Window.partitionBy("commander_id")))  # four page types
    kinds = kinds.groupBy("commander_id").agg(listed("page_type", "pages", millionths(ratio(F.col("c"), F.col("total")))).alias("contributions"))
    r = ranked(spark, sf_dir)
    trust = lambda c: F.max(F.when(F.col("model") == "hierarchical_trust_v2", F.col(c)))
    flags = F.array_compact(F.array(F.when(trust("higher_share") >= 0.5, "higher_level_dependent"), F.when(trust("known_share") < 0.4, "low_evidence"), F.when(trust("known") < 8, "sparse")))
    m = r.groupBy("commander_id", "name").agg(listed("model", "rank", "tier").alias("models"), F.coalesce(trust("profile"), F.lit("")).alias("profile"), flags.alias("flags"))
    e = fact(spark, sf_dir).groupBy("commander_id", "era").agg(F.count("*").alias("n")).groupBy("commander_id").agg(listed("era", "n").alias("eras"))
    for part in (kinds, top, e):
        m = m.join(part, "commander_id", "left")
    none = {c: F.coalesce(c, F.array().cast(k)).alias(c) for c, k in (("contributions", "array<struct<page_type:string,pages:bigint,millionths:bigint>>"), ("pages", "array<struct<page_id:bigint,page_type:string,outcome:string,millionths:bigint>>"), ("eras", "array<struct<era:string,n:bigint>>"))}
    return m.select("commander_id", F.to_json(F.struct("commander_id", "name", "profile", "flags", "models", *none.values())).alias("json"))


@query(f"""with {TRUST}, me as (select commander_id, era, row_number() over (partition by commander_id order by count(*) desc, era) as rn from fact group by 1, 2), t as (select trust.*, era from trust join me using (commander_id) where rn = 1)
  select 'era' as facet, era as value, count(*) as n from t group by 2 union all select 'profile', profile, count(*) from t group by 2 union all select 'robustness', category, count(*) from t group by 2 union all select 'confidence', label, count(*) from t group by 2
  union all select 'engagements', case when engagements >= 100 then '100+' when engagements >= 50 then '50+' else 'below 50' end, count(*) from t group by 2""")
def report_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each facet of the table view, all facets in one pass over the exploded rows."""
    s = stability(sensitivity(ranked(spark, sf_dir, TRUSTED))).filter("trust_rank is not null").withColumn("label", confidence(F.col("spread")))
    t = s.join(_main_era(spark, sf_dir), "commander_id")
    size = F.when(F.col("engagements") >= 100, "100+").when(F.col("engagements") >= 50, "50+").otherwise("below 50")
    facets = {"era": F.col("era"), "profile": F.col("profile"), "robustness": F.col("category"), "confidence": F.col("label"), "engagements": size}
    rows = t.select(F.explode(F.array(*(F.struct(F.lit(k).alias("facet"), v.alias("value")) for k, v in facets.items()))).alias("x"))
    return rows.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))
