"""Words and the spellings next to them, found by rotations of the words.

A word ends in a mark that no word holds; its rotations are all the ways to begin somewhere in
it and go round past the mark.  Take the rotation that ends in the character at some place and
skip that character: what is left is a prefix shared by all words that differ there only, and
it is the whole rotation of the word that lacks the character.  So all prefixes and all whole
rotations are sorted together; one key holds at most one word for each character and one word
without it, and a scan over the sorted keys meets every pair of words at distance one.  A pair
with a character too many in a run of it is met at the run's first place only.

Forms: a word's form is its near word of largest count (ties: the smaller in code-point order)
if that count is at least ``ratio`` times its own.  Counts grow along forms, so chains end; their
ends are found by doubling the steps.

Cases: null and empty texts have no words, a null id is written as nothing in front of the colon;
repeated rows count each time; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from votespan.llm.common import finish, shuffle_partitions, stash

#: Ends a word; below every letter.
MARK = "$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUNS = "[A-Za-zÀ-ÿ]+"


def runs(text: Column, pattern: str = RUNS) -> Column:
    """All runs of letters, A to Z lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)),
                       lambda w: F.when(w.rlike("[A-Z]"), F.translate(w, UPPER, LOWER)).otherwise(w))


def slipped(id_col: Column, run: Column, one_in: int) -> Column:
    """``run`` without one code point in about one of ``one_in`` cases, by a checksum of id and run."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run).cast("long")).cast("int")
    without = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(F.pmod(h, F.lit(one_in)) == 0, without).otherwise(run)


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 97, least_length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): runs after slips, of ``least_length`` code points and ``least`` occurrences at least."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(runs(F.col(text_col))).alias("run"))
    words = words.where(F.char_length("run") >= least_length).select(slipped(F.col("id"), F.col("run"), one_in).alias("word"))
    return words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def rotations(words: DataFrame) -> DataFrame:
    """(key, whole, c, word, n): whole rotations, and rotations without the character ``c`` at their end."""
    length = F.char_length("word")
    turned = lambda i, skip: F.concat(
        F.substring("word", i + 1 + skip, length), F.lit(MARK), F.substring("word", F.lit(1), i))
    whole = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        turned(i, 0).alias("key"), F.lit(True).alias("whole"), F.lit("").alias("c")))
    cut = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        turned(i, 1).alias("key"), F.lit(False).alias("whole"), F.substring("word", i + 1, F.lit(1)).alias("c")))
    return words.select("word", "n", F.explode(F.concat(whole, cut)).alias("r")).select("r.*", "word", "n")


NEAR = "word string, k long, near_n long, near string"


def _scan(batches):
    """Rows sorted by (key, whole, n falling, word) to (word, how many near words, the first of them)."""
    held = None
    try:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = held["key"]
            if key[0].as_py() == key[-1].as_py():
                continue
            # The last key may go on in the next batch.
            stop = pc.index(key, key[-1]).as_py()
            done, held = held.slice(0, stop), held.slice(stop)
            yield from _neighbours(done)
        if held is not None:
            yield from _neighbours(held)
    finally:
        finish()


def _neighbours(rows: pa.Table):
    rows = rows.combine_chunks()
    if rows.num_rows < 2:
        return
    key, word = rows["key"].combine_chunks(), rows["word"].combine_chunks()
    n, whole = rows["n"].to_numpy(), rows["whole"].to_numpy()
    new = np.ones(len(key), bool)
    new[1:] = pc.not_equal(key.slice(1), key.slice(0, len(key) - 1)).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    cut_rows = np.bincount(group[~whole], minlength=len(first))
    has_whole = np.bincount(group[whole], minlength=len(first)) > 0
    # The character before the skipped one is the last of the key: a run's first place differs from it.
    opens = pc.not_equal(rows["c"].combine_chunks(), pc.utf8_slice_codeunits(key, -1)).to_numpy(zero_copy_only=False)
    at = np.arange(len(key))
    out = []

    def tell(which, k, near):
        out.append((at[which], k, near))

    # Words with another character in that place: the most frequent one, for itself the second.
    cut = ~whole & (cut_rows[group] > 1)
    mine = group[cut]
    tell(cut, cut_rows[mine] - 1, first[mine] + (at[cut] == first[mine]))
    # The word without the character, for those with it.
    more = ~whole & has_whole[group] & opens
    tell(more, np.ones(int(more.sum()), np.int64), first[group[more]] + cut_rows[group[more]])
    # Those with it, for the word without.
    bare = np.flatnonzero(whole & (cut_rows[group] > 0))
    heads = first[group[bare]]
    k = np.bincount(group[~whole & opens], minlength=len(first))[group[bare]]
    some = k > 0
    tell(bare[some], k[some], heads[some] + ~opens[heads[some]])
    rows_at, ks, near = (np.concatenate(x) for x in zip(*out))
    if len(rows_at):
        yield pa.RecordBatch.from_arrays(
            [word.take(pa.array(rows_at)), pa.array(ks.astype(np.int64)), pa.array(n[near]), word.take(pa.array(near))],
            names=["word", "k", "near_n", "near"])


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, near, near_n): the number of words at distance one and the most frequent of them."""
    sorted_keys = rotations(words).repartitionByRange(shuffle_partitions(words.sparkSession), "key").sortWithinPartitions(
        "key", "whole", F.desc("n"), "word")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    return sorted_keys.mapInArrow(_scan, NEAR).groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select(
        "word", "n_near", F.col("b.near").alias("near"), (-F.col("b.m")).alias("near_n"))


def spelling_forms(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for a table (word, n) of distinct words without the mark."""
    words = stash(words.select("word", F.col("n").cast("long").alias("n")), "words")
    is_form = F.col("near_n") >= ratio * F.col("n")
    forms = stash(words.join(neighbours(words), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("near")).alias("form"),
        F.when(is_form, F.col("near_n")).alias("form_n")), "forms")
    steps = forms.where("form is not null").select("word", F.col("form").alias("root"))
    # Counts double along a chain, so it has under 63 steps: six doublings at most.
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        steps = stash(steps.select("word", "root").join(on, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        if steps.where("moved").isEmpty():
            break
    return forms.join(steps.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))
