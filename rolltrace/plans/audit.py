"""The whole audit over consecutive snapshots, and its repair."""

from __future__ import annotations

import json
import logging
import time
from dataclasses import fields, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.adjust import adjust_dups, adjust_fn, assert_adjusted
from ..operators.changes import changes_extract, changes_report
from ..operators.evaluate import performance as evaluate
from ..operators.linkage import link
from ..operators.match import ConservationError, Interim, Match, assert_inter, exact_match, id_match, random_sample
from ..sources.snapshots import clean_import

log = logging.getLogger(__name__)
PARTS = [f.name for f in fields(Match)]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def staged(match: Match, path: str) -> Match:
    """The buckets written once beside their place, to be checked before they count as saved."""
    spark = match.exact.sparkSession
    for k in PARTS:
        getattr(match, k).write.mode("overwrite").parquet(f"{path}/staged/{k}")
    return Match(**{k: spark.read.parquet(f"{path}/staged/{k}") for k in PARTS})


def save_match(match: Match, path: str, about: dict) -> Match:
    """Each bucket as Parquet, what made it as JSON; the match as read back."""
    spark = match.exact.sparkSession
    for k in PARTS:
        getattr(match, k).write.mode("overwrite").parquet(f"{path}/{k}")
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/args")
    return load_match(spark, path)


def load_match(spark: SparkSession, path: str) -> Match:
    return Match(**{k: spark.read.parquet(f"{path}/{k}") for k in PARTS})


def with_rids(df: DataFrame, start: int = 0) -> DataFrame:
    return df.withColumn("_rid", F.monotonically_increasing_id() + start)


def match_none(inter: Interim) -> Match:
    pairs = inter.id_pairs if inter.id_pairs is not None else no_pairs(inter.mismatch_a, inter.mismatch_b)
    return Match(inter.exact, pairs, no_pairs(inter.mismatch_a, inter.mismatch_b), inter.mismatch_a, inter.mismatch_b)


def no_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    whole = lambda df, s: df.limit(0).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias(s), F.lit(1).alias("_k"))
    return whole(a, "a").join(whole(b, "b"), "_k").select("a", "b")


def match_linked(inter: Interim, links: DataFrame) -> Match:
    """Buckets of linked pairs; those that touch a sampled row are left out."""
    strip = lambda s: F.col(s).dropFields("_rid", "_sampled").alias(s)
    links = links.filter("NOT a._sampled AND NOT b._sampled")
    rest = lambda df, key: df.join(links.select(F.col(key).alias("_rid")).distinct(), "_rid", "left_anti").drop("_rid", "_sampled")
    base = match_none(replace(inter, mismatch_a=inter.mismatch_a.drop("_rid", "_sampled"), mismatch_b=inter.mismatch_b.drop("_rid", "_sampled")))
    return replace(base, changed=links.select(strip("a"), strip("b")), only_a=rest(inter.mismatch_a, "_rid_a"), only_b=rest(inter.mismatch_b, "_rid_b"))


def match_pair(
    a: DataFrame, b: DataFrame, path: str, varnames: list[str], varnames_str: list[str], varnames_num=None, varnames_id=None, partial=None,
    exact_exclude: bool = True, sample_exact: bool = False, sample_id: bool = False, sample_size=None, sample_perc=None, block: list[list[str]] | None = None,
    seed: int = 123, on_unbalanced: str = "error", **link_options,
) -> tuple[Match, dict]:
    """Exact, id and probabilistic matching of two snapshots; intermediate results are kept under
    ``path``, since several later steps read each of them."""
    spark = a.sparkSession
    began = time.time()

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/interim/{name}")
        return spark.read.parquet(f"{path}/interim/{name}")

    inter = exact_match(a, b, exact_exclude)
    inter = Interim(kept(inter.exact, "exact"), kept(inter.mismatch_a, "mismatch_a"), kept(inter.mismatch_b, "mismatch_b"))
    inter = id_match(inter, varnames_id, on_unbalanced=on_unbalanced)
    if inter.id_pairs is not None:
        inter = replace(inter, id_pairs=kept(inter.id_pairs, "id_pairs"))
    sample_a, sample_b = random_sample(inter, sample_exact, sample_id, exact_exclude, varnames_id, sample_size, sample_perc, seed)
    marked = lambda df, more: df.withColumn("_sampled", F.lit(False)).unionByName(more.withColumn("_sampled", F.lit(True)))
    # row ids are written before they are used: they differ from one evaluation to the next
    in_a, in_b = kept(with_rids(marked(inter.mismatch_a, sample_a)), "link_a"), kept(with_rids(marked(inter.mismatch_b, sample_b)), "link_b")
    inter = replace(inter, mismatch_a=in_a.filter("NOT _sampled").drop("_sampled"), mismatch_b=in_b.filter("NOT _sampled").drop("_sampled"))
    counts = assert_inter(inter, a, b)
    about = {"status": "too few rows to link", "counts": counts}
    plain = replace(inter, mismatch_a=inter.mismatch_a.drop("_rid"), mismatch_b=inter.mismatch_b.drop("_rid"))
    match = match_none(plain)
    if in_a.count() > 2 and in_b.count() > 2:
        try:
            links, fit = link(in_a, in_b, varnames, varnames_str, partial, varnames_num, block, **link_options)
            match = match_linked(inter, kept(links, "links"))
            about |= {"status": "linked", "share": fit.share, "iterations": fit.iterations, "pairs": fit.pairs}
        except (np.linalg.LinAlgError, FloatingPointError, ZeroDivisionError) as e:  # no estimate from these data; the rows stay unmatched
            log.warning("linkage failed: %s", e)
            about["status"] = f"failed: {type(e).__name__}"
    about["runtime"] = time.time() - began
    return match, about


def assert_match(match: Match, a: DataFrame) -> dict[str, int]:
    """Side A only: ties may pair one B row several times until they are repaired. No bucket has a row of nulls."""
    n = match.counts()
    if n["exact"] + n["id_pairs"] + n["changed"] + n["only_a"] != a.count():
        raise ConservationError(str(n))
    whole = {"exact": match.exact, "only_a": match.only_a, "only_b": match.only_b}
    whole |= {f"{k}.{s}": getattr(match, k).select(f"{s}.*") for k in ("id_pairs", "changed") for s in "ab"}
    for k, df in whole.items():
        if df.filter(reduce(lambda p, q: p & q, (F.col(f"`{c}`").isNull() for c in df.columns))).limit(1).count():
            raise ConservationError(f"{k} has a row of nulls only")
    return n


def _labels(date_df: DataFrame, date_label: str) -> list[str]:
    labels = [r[0] for r in date_df.orderBy("date" if "date" in date_df.columns else date_label).select(date_label).collect()]  # one per snapshot
    if len(labels) < 2:
        raise ValueError("at least two snapshots are needed")
    return labels


def vrmatch(
    date_df: DataFrame, varnames: list[str], varnames_str: list[str], varnames_num=None, varnames_id=None, partial=None, varnames_block=None,
    vars_change=None, exact_exclude: bool = True, sample_exact: bool = False, sample_id: bool = False, sample_size=None, sample_perc=None,
    path_clean: str = "clean_df", path_changes: str = "changes", path_reports: str = "reports", path_matches: str = "matches",
    clean_prefix: str = "df_cleaned_", clean_suffix: str = "", exist_files: bool = False, date_label: str = "date_label", nrow: str = "nrow",
    seed: int = 123, null_changes: str = "reference", **options,
) -> DataFrame:
    """Match, changes and report of every consecutive pair of snapshots; the stacked reports."""
    spark = date_df.sparkSession
    labels, reports = _labels(date_df, date_label), []
    for day1, day2 in zip(labels, labels[1:]):
        name = f"{day1}_{day2}"
        target = f"{path_matches}/match_{name}"
        if exist_files and exists(spark, f"{target}/args/_SUCCESS"):
            match = load_match(spark, target)
        else:
            a, b = clean_import(spark, path_clean, clean_prefix, clean_suffix, day1, day2)
            match, about = match_pair(
                a, b, target, varnames, varnames_str, varnames_num, varnames_id, partial, exact_exclude, sample_exact, sample_id, sample_size, sample_perc, varnames_block, seed, **options
            )
            match = staged(match, target)
            assert_match(match, a)
            match = save_match(match, target, about | {"varnames": varnames, "varnames_id": varnames_id, "seed": seed})
        reports.append(_report(match, name, day2, vars_change, nrow, null_changes, path_changes, path_reports))
    return _stack(reports)


def _report(match: Match, name: str, day2: str, vars_change, nrow: str, null_changes: str, path_changes: str, path_reports: str) -> DataFrame:
    spark = match.exact.sparkSession
    changes_extract(match, vars_change, nrow, null_changes).write.mode("overwrite").parquet(f"{path_changes}/change_{name}")
    path = f"{path_reports}/table_{name}"
    changes_report(match, vars_change, null_changes, day2).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _stack(reports: list[DataFrame]) -> DataFrame:
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def performance(date_df: DataFrame, path_matches: str = "matches", date_label: str = "date_label", ids: list[str] = ("lVoterUniqueID", "sAffNumber"), cond: str = "or") -> DataFrame:
    """:func:`rolltrace.operators.evaluate.performance` of every saved match, stacked."""
    labels = _labels(date_df, date_label)
    return _stack([evaluate(load_match(date_df.sparkSession, f"{path_matches}/match_{x}_{y}"), ids, cond, y) for x, y in zip(labels, labels[1:])])


def adjust_vrmatch(
    date_df: DataFrame, fn_ids: list[str], dedup_ids: list[str], vars_change=None, path_clean: str = "clean_df", path_changes: str = "changes",
    path_reports: str = "reports", path_matches: str = "matches", clean_prefix: str = "df_cleaned_", clean_suffix: str = "", adj_prefix: str = "adj",
    adj_suffix: str = "", date_label: str = "date_label", nrow: str = "nrow", null_changes: str = "reference", compat: str = "intent",
) -> DataFrame:
    """Repair every saved match and report again; the stacked reports."""
    spark = date_df.sparkSession
    prefix = f"{adj_prefix.strip('_')}_" if adj_prefix else ""
    suffix = f"_{adj_suffix.strip('_')}" if adj_suffix else ""
    labels, reports = _labels(date_df, date_label), []
    for day1, day2 in zip(labels, labels[1:]):
        name = f"{day1}_{day2}"
        a, b = clean_import(spark, path_clean, clean_prefix, clean_suffix, day1, day2)
        match = load_match(spark, f"{path_matches}/match_{name}")
        match = adjust_dups(adjust_fn(match, fn_ids), dedup_ids, compat)
        target = f"{path_matches}/{prefix}match_{name}{suffix}"
        match = staged(match, target)
        assert_adjusted(match, a, b, dedup_ids)
        match = save_match(match, target, {"fn_ids": list(fn_ids), "dedup_ids": list(dedup_ids)})
        reports.append(_report(match, f"{name}{suffix}", day2, vars_change, nrow, null_changes, f"{path_changes}/{prefix}changes", f"{path_reports}/{prefix}reports"))
    return _stack(reports)
