"""The rules document and what it decides: crawl keep rule, quote classes, target filter."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewell.functions import columns as P


@dataclass(frozen=True)
class Trim:
    """One density's cleaning plan; a method that is None is not run."""

    zscore: float | None = None
    fence: float | None = None
    tail: bool = False
    gap_floor: int = 0
    gap_ratio: float = 0.0


@dataclass(frozen=True)
class Rules:
    """Everything the market operators are told. `defaults.json` holds the values for the phone market."""

    history_days: int = 3
    per_group_limit: int = 10
    out_of_stock: tuple[str, ...] = ()
    global_exclude: tuple[str, ...] = ()
    strict_brand_keywords: tuple[str, ...] = ()
    strict_allow: tuple[str, ...] = ()
    strict_exclude: tuple[str, ...] = ()
    open_exclude: tuple[str, ...] = ()
    strict_brand: str = ""
    target_keywords: tuple[str, ...] = ()
    special_model: tuple[str, ...] = ()
    positive: tuple[tuple[str, str], ...] = ()
    negative: tuple[tuple[str, str], ...] = ()
    sale: tuple[tuple[str, str], ...] = ()
    hard_negative: tuple[str, ...] = ()
    noise: tuple[str, ...] = ()
    day_min_samples: int = 1
    day_max_labels: int = 1
    sparse_keep: int = 4
    sparse_trim: int = 1
    balanced_keep: int = 4
    balanced_ratio: float = 0.65
    dense_keep: int = 5
    dense_ratio: float = 0.45
    balanced: Trim = Trim(4.0, 2.4, False, 140, 0.02)
    dense: Trim = Trim(3.5, 2.0, True, 120, 0.018)
    minmax_most: int = 3
    iqr_least: int = 4
    padding_floor: int = 0
    padding_ratio: float = 0.0
    padded: bool = False
    count_weight: float = 14.0
    spread_divisor: float = 18.0
    reference_divisor: float = 45.0
    reference_cap: int = 2000
    single_penalty: float = 14.0
    pair_penalty: float = 6.0
    #: (exact status, weight), then (contained keyword, weight), for the strict brand; the rest by whether there is a status.
    status_exact: tuple[tuple[str, int], ...] = ()
    status_contains: tuple[tuple[str, int], ...] = ()
    status_other: int = 0
    status_some: int = 10
    status_none: int = 6

    def is_strict(self, brand: Column) -> Column:
        return P.any_of(F.lower(P.plain(brand)), [k.lower() for k in self.strict_brand_keywords])


def from_document(document: dict) -> Rules:
    """Compiles a JSON rules document; the two top-level parts it cannot do without are checked."""
    for part in ("crawler", "cleaning"):
        if part not in document:
            raise ValueError(f"rules lack {part}")
    known, flat = {f for f in Rules.__dataclass_fields__}, {}
    for part in document.values():
        if not isinstance(part, dict):
            raise ValueError("each part of the rules must be an object")
        flat |= part
    if unknown := set(flat) - known:
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    freeze = lambda v: tuple(freeze(x) for x in v) if isinstance(v, list) else v
    made = {k: Trim(**v) if k in ("balanced", "dense") else freeze(v) for k, v in flat.items()}
    return Rules(**made)


def load(path: str | Path | None = None) -> Rules:
    path = Path(path) if path else Path(__file__).with_name("defaults.json")
    return from_document(json.loads(path.read_text(encoding="utf-8-sig")))


def keep_reason(rules: Rules, allowed_labels: Column) -> Column:
    """Why the crawl drops an item: the first reason that holds, null where the item is kept."""
    gprice, status = P.plain("gprice"), P.plain("dstatus")
    label = F.regexp_extract(gprice, r"([0-9]{2}-[0-9]{2})", 1)
    strict = rules.is_strict(F.col("brand_title"))
    not_allowed = ~P.any_of(status, rules.strict_allow) if rules.strict_allow else F.lit(False)
    return (
        F.when((label == "") | ~F.array_contains(allowed_labels, label), "drop_by_date")
        .when(P.any_of(gprice, rules.out_of_stock), "drop_out_of_stock")
        .when(P.plain("activation") != "", "drop_by_activation_field")
        .when(P.any_of(status, rules.global_exclude), "drop_by_global_dstatus")
        .when(strict & (not_allowed | P.any_of(status, rules.strict_exclude)), "drop_by_strict_dstatus")
        .when(~strict & P.any_of(status, rules.open_exclude), "drop_by_open_dstatus")
    )


def classify(df: DataFrame, rules: Rules) -> DataFrame:
    """Adds condition_bucket, is_target_price, needs_review, tags, clean_scope, exclude_reason.

    The tags are known when the plan is made: each is one boolean column, which the branches ask and the texts join."""
    status, dated = P.plain("dstatus"), "activation_date_present"
    text = F.col("_text")
    df = df.withColumn("_text", P.join_text("series_title", "model_title", "group_title", "dstatus"))
    made = {"positive": P.tag_flags(text, rules.positive), "negative": P.tag_flags(text, rules.negative), "sale": P.tag_flags(text, rules.sale)}
    made["negative"][dated] = made["negative"].get(dated, F.lit(False)) | (P.plain("activation") != "")
    names = {(kind, t): f"_{kind}_{k}" for kind, flags in made.items() for k, t in enumerate(sorted(flags))}
    own = {"_strict": P.plain("brand_title") == rules.strict_brand, "_special": P.any_of(text, rules.special_model), "_target": P.any_of(status, rules.target_keywords), "_open_hit": P.any_of(status, rules.open_exclude)}
    df = df.withColumns(own | {name: made[kind][t] for (kind, t), name in names.items()})
    flags = {kind: {t: F.col(names[kind, t]) for t in sorted(made[kind])} for kind in made}
    either = lambda kind, *tags: reduce(or_, [flags[kind][t] for t in tags if t in flags[kind]], F.lit(False))
    some = lambda kind: either(kind, *flags[kind])
    df = df.withColumns({"_flagged": some("negative"), "_hard": either("negative", *rules.hard_negative), "_sealed": either("positive", "factory_sealed"), "matched_positive_tags": P.flagged(flags["positive"]), "matched_negative_tags": P.flagged(flags["negative"]), "matched_sale_tags": P.flagged(flags["sale"])})
    joined, sealed, flagged = F.col("matched_negative_tags"), F.col("_sealed"), F.col("_flagged")
    branches = [  # (condition, bucket, reason); the first that holds decides
        (F.col("_special"), "strict_special_model_non_target", F.lit("special_model_tag")),
        (F.col("_target") & ~flagged, "strict_target", F.lit("")),
        (F.col("_target"), "strict_target_but_excluded", joined),
        (sealed & flagged, "strict_sealed_but_excluded", joined),
        (sealed, "strict_other_sealed_non_target", F.lit("not_target_sealed")),
        (either("negative", "opened_not_activated"), "strict_opened_not_activated", F.lit("opened_not_activated")),
        (either("negative", "opened", "activated", dated), "strict_opened_or_activated", joined),
        (either("positive", "pure_original"), "strict_pure_original_non_target", F.lit("pure_original_without_clean_sealed_status")),
        (flagged, "strict_flagged_non_target", joined),
        (some("sale"), "strict_condition_unspecified_non_target", F.lit("condition_unspecified")),
    ]
    bucket, reason = F.lit("strict_unknown_review"), F.lit("unknown_strict_condition")
    for condition, name, why in reversed(branches):
        bucket, reason = F.when(condition, name).otherwise(bucket), F.when(condition, why).otherwise(reason)
    open_bucket = F.when(F.col("_hard"), "open_hard_excluded").when(F.col("_open_hit"), "open_excluded").otherwise("open_allowed")
    hard = {t: flags["negative"][t] for t in sorted(rules.hard_negative) if t in flags["negative"]}
    open_reason = P.flagged(hard | {"open_dstatus_keyword": F.col("_open_hit") | hard.get("open_dstatus_keyword", F.lit(False))})
    strict = F.col("_strict")
    df = df.withColumns({"condition_bucket": F.when(strict, bucket).otherwise(open_bucket), "exclude_reason": F.when(strict, reason).otherwise(open_reason), "clean_scope": F.when(strict, "strict").otherwise("guarded")})
    df = df.withColumns({
        "is_target_price": F.when(strict, F.col("condition_bucket") == "strict_target").otherwise(~(F.col("_hard") | F.col("_open_hit"))).cast("int"),
        "needs_review": (F.col("condition_bucket") == "strict_unknown_review").cast("int"),
    })
    return df.drop("_text", "_flagged", "_hard", "_sealed", *own, *names.values())


def noise_keywords(rules: Rules, strict: bool) -> list[str]:
    """Ordered distinct union of the global, noise and brand-dependent lists."""
    return list(dict.fromkeys(k for k in (*rules.global_exclude, *rules.noise, *(rules.strict_exclude if strict else rules.open_exclude)) if k))


def reject_reason(rules: Rules, with_activation: bool = True) -> Column:
    """Why a classified row is no target: activation, then noise keyword, then not target; null where it is one."""
    status = P.plain("dstatus")
    noisy = F.when(rules.is_strict(F.col("brand_title")), P.any_of(status, noise_keywords(rules, True))).otherwise(P.any_of(status, noise_keywords(rules, False)))
    activation = (P.plain("activation") != "") if with_activation else F.lit(False)
    return F.when(activation, "activation_field_present").when(noisy, "status_noise_keyword").when(F.col("is_target_price") != 1, "condition_not_target")


def noise_hits(rules: Rules) -> Column:
    status = P.plain("dstatus")
    return F.when(rules.is_strict(F.col("brand_title")), P.keywords_hit(status, noise_keywords(rules, True))).otherwise(P.keywords_hit(status, noise_keywords(rules, False)))
