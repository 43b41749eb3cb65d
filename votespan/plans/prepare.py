"""The two dataset preparations, from raw rows to labelled and tokenised ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from votespan.functions.columns import category_columns, empty_map
from votespan.functions.text import detokenize
from votespan.operators.joins import left_join_features
from votespan.operators.sampling import SPLITS, with_split
from votespan.operators.stats import dataset_stats
from votespan.operators.tokenizer import tokenize, tokenize_aligned
from votespan.operators.votes import (
    dedupe_mean, is_label, majority, names_label, nested_consensus, nested_label_share, nested_target_share,
    vote_shares,
)
from votespan.sources.datasets import Catalog, no_stats, read_dataset, read_input, write_splits, write_stats

ROUNDED = ("target", "label", "rationale")


def label_votes(votes: DataFrame, key: str, cats: Mapping[str, Sequence[str]], rounded: Sequence[str] = ROUNDED) -> DataFrame:
    """Votes in long form (key, label, targets) to label and target columns, in one grouping."""
    shares = vote_shares(votes, key, {
        "label": (is_label("label"), cats["label"]),
        "target": (names_label("targets"), cats["target"]),
    })
    return majority(shares, [c for g in ("label", "target") if g in rounded for c in category_columns(cats[g], g)])


def label_posts(posts: DataFrame, cats: Mapping[str, Sequence[str]], rounded: Sequence[str] = ROUNDED) -> DataFrame:
    """The same for posts that carry their votes in ``annotators``: no shuffle at all."""
    share = {"label": lambda c: nested_label_share(F.col("annotators"), "label", c),
             "target": lambda c: nested_target_share(F.col("annotators"), "target", c)}
    out = posts.withColumns({
        name: share[g](cat) for g in ("label", "target")
        for cat, name in zip(cats[g], category_columns(cats[g], g))})
    return majority(out, [c for g in ("label", "target") if g in rounded for c in category_columns(cats[g], g)])


def prepare_annotated(
    posts: DataFrame, vocab: DataFrame | dict[str, int], cats: Mapping[str, Sequence[str]],
    rounded: Sequence[str] = ROUNDED, max_length: int | None = None, strip_accents: bool = True,
    denominator: str = "nonzero", skip_empty: bool = False, tail_plus_one: bool = False, longest_word: int | None = None,
) -> DataFrame:
    """Annotated posts to (post_id, label_*, target_*, tokens, mask, rationale).

    Input columns are post_id, annotators, rationales and post_tokens; ``cats`` names the
    categories of ``label`` and ``target``.  ``max_length`` cuts texts.  Each output row
    comes from its own input row, so the plan has no shuffle; tokens, the places of words and
    the marks of tokens come from one step in Python, which a filter on the output leaves where it is.
    """
    columns = [c for g in ("label", "target") for c in category_columns(cats[g], g)]
    marks = nested_consensus(F.col("rationales"), denominator)
    if "rationale" in rounded:
        marks = F.transform_values(marks, lambda _, v: F.round(v))
    labelled = label_posts(posts, cats, rounded).select(
        "post_id", *columns, "post_tokens",
        F.coalesce(marks, empty_map("int", "double")).alias("rationale"),
        detokenize(F.col("post_tokens")).alias("text"))
    tokenized = tokenize_aligned(
        labelled, "post_tokens", "text", vocab, max_length, strip_accents, tail_plus_one, longest_word,
        values="rationale", skip_empty=skip_empty)
    return tokenized.select("post_id", *columns, "tokens", "mask", "rationale")


def prepare_scored(
    comments: DataFrame, vocab: DataFrame | dict[str, int], key: str = "comment_id", score: str = "score",
    max_length: int | None = None, strip_accents: bool = True, tail_plus_one: bool = False, longest_word: int | None = None,
) -> DataFrame:
    """Scored comments to (key, score, tokens, mask, offsets), one row per comment."""
    once = dedupe_mean(comments, key, score)
    return tokenize(once, "text", vocab, max_length, strip_accents, tail_plus_one, keep=[key, "score"], longest_word=longest_word)


def join_labelled(posts: DataFrame, labels: DataFrame, rationale: DataFrame, key: str) -> DataFrame:
    """Long-form features next to their posts, a missing rationale as an empty map."""
    joined = left_join_features(posts, labels, rationale, key=key)
    return joined.withColumn("rationale", F.coalesce("rationale", empty_map("int", "double")))


@dataclass(frozen=True)
class Preparation:
    """What ``run_prepare`` does: ``kind`` annotated (options need ``cats``) or scored."""

    kind: str
    key: str
    options: dict = field(default_factory=dict)


def run_prepare(
    spark: SparkSession, catalog: Catalog, name: str, vocab: DataFrame | dict[str, int],
    preparation: Preparation, weights: Mapping[str, float] = SPLITS, seed=None,
) -> DataFrame:
    """Reads a dataset's input, prepares it, writes its splits and statistics.

    The prepared rows are written once; statistics are taken from what was written.
    """
    plan = preparation
    if plan.kind not in ("annotated", "scored"):
        raise ValueError(plan.kind)
    raw = read_input(spark, catalog, name)
    if plan.kind == "annotated":
        ready = prepare_annotated(raw, vocab, **plan.options)
    else:
        ready = prepare_scored(raw, vocab, plan.key, **plan.options)
    write_splits(with_split(ready, [plan.key], weights, seed), catalog, name)
    written = read_dataset(spark, catalog, name)
    if plan.kind == "annotated":
        cats = plan.options["cats"]
        write_stats(dataset_stats(
            written, category_columns(cats["label"], "label"), category_columns(cats["target"], "target")),
            catalog, name)
    else:
        write_stats(no_stats(spark), catalog, name)
    return written
