"""votespan: crowd-annotated text corpora on Spark.

Votes, rationales and spans become labelled, tokenised, split and batched tables;
predictions become confusion counts, F1 tables and reports.  Every operator takes
and returns a DataFrame (or a Column) and leaves the physical plan to Catalyst.
"""
