"""Projections, filters, indicator columns, arrays and maps."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from votespan.functions.arrays import (
    arr_to_pairs, densify, explode_rows, keep_empty, map_to_pairs, pad, pairs_to_map, render_spans, runs_of_true,
    span, span_width, spans_to_mask,
)
from votespan.functions.columns import (
    above, apply_cols, argmax, category_columns, coalesce_map, decode_above, decode_top, drop_cols, extract_groups,
    flatten_struct, gated, harden, keep_matching, multihot, onehot, prefix_cols, slice_number, with_key,
)
from votespan.functions.text import align_words
from votespan.operators.joins import align_by_position, inner_join_features, left_join_features
from votespan.operators.metrics import multilabel_f1
from votespan.operators.votes import is_label, names_label, nested_consensus, rationale_consensus, vote_share, vote_shares
from votespan.sources.results import wide_to_long
from workload.registry import query, table
from workload.tables import (
    CELLS, ENTRIES_SQL, FLAGS, FLAG_TARGETS, MARKS, PRED, TARGETS, VOTES, WORDS, entries_of, f1_sql, posts, predictions, rationales, votes, word_lists,
)

_onehot = ", ".join(f"case when label = '{c}' then 1.0::double else 0.0::double end as {{p}}{c}" for c in FLAGS)
_multihot = ", ".join(f"cast(list_contains(targets, '{c}') as int)::double as {c}" for c in FLAG_TARGETS)


@query("p1_prefix_cols", f"with {VOTES} select post_id, annotator_id, {_onehot.format(p='label_')} from votes")
def p1(spark, sf):
    return prefix_cols(onehot(votes(spark, sf), ["post_id", "annotator_id"], "label", FLAGS), FLAGS, "label_")


@query("p2_apply_cols", """select l_orderkey, l_linenumber, round(l_quantity / 10) as l_quantity, round(l_tax / 10) as l_tax
  from lineitem""")
def p2(spark, sf):
    return apply_cols(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_tax"],
                      lambda c: F.round(c / 10))


@query("p3_category_columns", f"""with {VOTES} select sum("A") as label_A, sum("N") as label_N, sum("R") as label_R
  from (select {_onehot.format(p='')} from votes)""")
def p3(spark, sf):
    hot = prefix_cols(onehot(votes(spark, sf), "post_id", "label", FLAGS), FLAGS, "label_")
    return hot.agg(*[F.sum(c).alias(c) for c in category_columns(FLAGS, "label")])


@query("p4_drop_cols", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders")
def p4(spark, sf):
    return drop_cols(table(spark, sf, "orders"), "o_orderdate", "o_orderpriority", "no_such_column")


@query("p5_flatten_struct", "select l_orderkey, l_linenumber as annotator_id, l_returnflag as label from lineitem")
def p5(spark, sf):
    nested = table(spark, sf, "lineitem").select(
        "l_orderkey", F.struct(F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("annotator_id"),
                               F.col("l_tax").alias("tax")).alias("annotator"))
    return flatten_struct(nested, "annotator", ["label", "annotator_id"])


@query("p6_onehot", f"with {VOTES} select post_id, annotator_id, {_onehot.format(p='')} from votes")
def p6(spark, sf):
    return onehot(votes(spark, sf), ["post_id", "annotator_id"], "label", FLAGS)


@query("p7_multihot", f"with {VOTES} select post_id, annotator_id, {_multihot} from votes")
def p7(spark, sf):
    return multihot(votes(spark, sf), ["post_id", "annotator_id"], "targets", FLAG_TARGETS)


@query("p8_sparse_filter", f"""with {MARKS} select doc_id, annotator, count(*) as n, cast(sum(pos) as bigint) as pos_sum
  from marks where flag <> 0 group by all""")
def p8(spark, sf):
    pairs = arr_to_pairs(rationales(spark, sf), ["doc_id", "annotator"], "flags", sparse=True)
    return pairs.groupBy("doc_id", "annotator").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("pos_sum"))


@query("p9_with_key", """select doc_id, source, n_chars, count(*) over same as copies, min(doc_id) over same as first_id
  from (select doc_id, source, n_chars from documents union all select doc_id, source, n_chars from documents where doc_id % 3 = 0) window same as (partition by doc_id, source, n_chars)""")
def p9(spark, sf):
    """Every row with the rows of its key: equal keys are equal rows."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    rows = with_key(docs.unionByName(docs.where("doc_id % 3 = 0")), ["doc_id", "source", "n_chars"])
    same = Window.partitionBy("row_key")
    return rows.select(
        "doc_id", "source", "n_chars", F.count(F.lit(1)).over(same).alias("copies"), F.min("doc_id").over(same).alias("first_id"))


def _consensus(spark, sf):
    return rationale_consensus(rationales(spark, sf), "doc_id")


@query("p10_coalesce_map", f"""with {MARKS}, {ENTRIES_SQL} select d.doc_id, coalesce(entries, '') as entries
  from documents d left join marked m on d.doc_id = m.doc_id""")
def p10(spark, sf):
    maps = pairs_to_map(_consensus(spark, sf), "doc_id", "pos", "value", "rationale")
    rows = left_join_features(table(spark, sf, "documents").select("doc_id"), maps, key="doc_id")
    return coalesce_map(rows, "rationale").select("doc_id", entries_of("rationale").alias("entries"))


@query("p11_label_slice", f"""with {PRED} select item, case when item < 3 then 1 when item < 6 then 2 when item < 9 then 3 else 4 end as part,
  count(*) as n, sum(truth) as positives from pred group by all""")
def p11(spark, sf):
    rows = predictions(spark, sf).withColumn("part", slice_number(F.col("item"), len(TARGETS), 4))
    return rows.groupBy("item", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("truth").alias("positives"))


@query("p12_harden", f"with {PRED} select vec_id, item, logit > 0 as pred, truth > 0.5 as hard from pred")
def p12(spark, sf):
    return harden(predictions(spark, sf)).select("vec_id", "item", "pred", "hard")


@query("p13_argmax", "select vec_id, cast(list_position(embedding, list_max(embedding)) - 1 as int) as best from embeddings")
def p13(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("best"))


@query("p14_gate_tokens", """select vec_id, cast(k - 1 as int) as pos,
  embedding[k]::double > (-0.1)::double and (embedding[51] > 0 or embedding[52] > 0) as counted from embeddings, range(1, 65) r(k) where k not in (51, 52)""")
def p14(spark, sf):
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding")[50].alias("label_0"), F.col("embedding")[51].alias("label_1"),
        F.posexplode(F.transform("embedding", lambda x: x.cast("double") > F.lit(-0.1))).alias("pos", "mask"))
    # The two label scores are no tokens.
    return rows.where("pos not in (50, 51)").select("vec_id", "pos", gated(F.col("mask"), [F.col("label_0"), F.col("label_1")]).alias("counted"))


_names = "[" + ", ".join(f"'{t}'" for t in TARGETS) + "]"


@query("p15_decode", f"""select vec_id, best_name, round(best_prob, 6) as best_prob, {_names}[i] as name, round(p[i], 6) as prob from (
  select vec_id, p, {_names}[list_position(p, list_max(p))] as best_name, list_max(p) as best_prob from (
    select vec_id, list_transform(embedding[1:11], lambda x: x::double + 0.5::double) as p from embeddings)), range(1, 12) r(i)
  where p[i] > 0.55::double""")
def p15(spark, sf):
    probs = F.transform(F.slice("embedding", 1, 11), lambda x: x.cast("double") + F.lit(0.5))
    rows = table(spark, sf, "embeddings").select("vec_id", probs.alias("p"))
    rows = rows.select("vec_id", decode_top(F.col("p"), TARGETS).alias("best"), F.inline(decode_above(F.col("p"), TARGETS, 0.55)))
    return rows.select(
        "vec_id", F.col("best.name").alias("best_name"), F.round("best.prob", 6).alias("best_prob"), "name", F.round("prob", 6).alias("prob"))


@query("p16_keep_matching", r"""select doc_id, lang from documents where regexp_matches(text, '[0-9]{3}') and source is not null""")
def p16(spark, sf):
    return keep_matching(table(spark, sf, "documents"), "text", "[0-9]{3}", "source").select("doc_id", "lang")


# ---- joins of features

_shares = ", ".join(f"round(avg(case when label = '{c}' then 1.0::double else 0.0::double end), 6) as label_{c}" for c in FLAGS)
_targets = ", ".join(f"round(avg(cast(list_contains(targets, '{c}') as int)::double), 6) as target_{c}" for c in FLAG_TARGETS)


def _rounded(df, keys):
    return df.select(*keys, *[F.round(c, 6).alias(c) for c in df.columns if c not in keys])


@query("j1_left_join_features", f"""with {VOTES} select o_orderkey as post_id, l.* exclude (post_id), t.* exclude (post_id) from orders
  left join (select post_id, {_shares} from votes group by 1) l on o_orderkey = l.post_id
  left join (select post_id, {_targets} from votes group by 1) t on o_orderkey = t.post_id""")
def j1(spark, sf):
    v = votes(spark, sf)
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("post_id"))
    # Labels and targets in one grouping.
    shares = vote_shares(v, "post_id", {"label": (is_label("label"), FLAGS), "target": (names_label("targets"), FLAG_TARGETS)})
    return _rounded(left_join_features(base, shares, key="post_id"), ["post_id"])


@query("j2_inner_join_features", f"""with {VOTES} select o_orderkey as post_id, o_custkey, l.* exclude (post_id) from orders
  join (select post_id, {_shares} from votes group by 1) l on o_orderkey = l.post_id""")
def j2(spark, sf):
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("post_id"), "o_custkey")
    joined = inner_join_features(base, vote_share(votes(spark, sf), "post_id", "label", FLAGS), "post_id")
    return _rounded(joined, ["post_id", "o_custkey"])


@query("j3_keep_empty", f"""with {MARKS} select d.doc_id, m.pos from documents d
  left join (select distinct doc_id, pos from marks where flag <> 0) m on d.doc_id = m.doc_id""")
def j3(spark, sf):
    return keep_empty(table(spark, sf, "documents"), "doc_id", _consensus(spark, sf)).select("doc_id", "pos")


@query("j5_align_by_position", """with c as (select row_number() over (order by c_custkey) - 1 as pos, c_custkey, c_name from customer),
  s as (select row_number() over (order by s_acctbal, s_suppkey) - 1 as pos, s_suppkey, s_acctbal from supplier),
  n as (select row_number() over (order by n_name) - 1 as pos, n_name from nation)
  select pos, c_custkey, c_name, s_suppkey, s_acctbal, n_name from c full join s using (pos) full join n using (pos)""")
def j5(spark, sf):
    """Customers, suppliers by balance and nations by name, side by side."""
    return align_by_position([
        (table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"]),
        (table(spark, sf, "supplier").select("s_suppkey", "s_acctbal"), ["s_acctbal", "s_suppkey"]),
        (table(spark, sf, "nation").select("n_name"), ["n_name"])])


# ---- arrays and maps

@query("x3_arr_to_pairs", f"with {WORDS} select doc_id, cast(i - 1 as int) as pos, words[i] as value from (select doc_id, words, unnest(range(1, len(words) + 1)) as i from docs)")
def x3(spark, sf):
    return arr_to_pairs(word_lists(spark, sf), "doc_id", "words")


@query("x4_explode_rows", f"with {WORDS} select w as value, count(*) as n, count(distinct doc_id) as n_docs from (select doc_id, unnest(words) as w from docs) group by 1")
def x4(spark, sf):
    per_doc = explode_rows(word_lists(spark, sf), "doc_id", "words").groupBy("value", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per_doc.groupBy("value").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("n_docs"))


@query("x5_map_to_pairs", """select vec_id, cast(k - 1 as int) as k, round(embedding[k]::double, 6) as v from embeddings, range(1, 65) r(k) where embedding[k] > 0.2::double
  union all select vec_id, null, null from embeddings where list_max(embedding) <= 0.2::double""")
def x5(spark, sf):
    big = F.filter(F.transform("embedding", lambda x, i: F.struct(i.alias("k"), x.cast("double").alias("v"))), lambda e: e["v"] > F.lit(0.2))
    rows = table(spark, sf, "embeddings").select("vec_id", F.map_from_entries(big).alias("m"))
    return map_to_pairs(rows, "vec_id", "m", keep_empty=True).withColumn("v", F.round("v", 6))


@query("x6_span_width", f"with {WORDS} select doc_id, cast(sum(len(w)) as bigint) as widths, max(len(w)) as widest from (select doc_id, unnest(words) as w from docs) group by 1")
def x6(spark, sf):
    spans = explode_rows(
        word_lists(spark, sf).select("doc_id", F.transform("words", lambda w: span(F.lit(2), F.length(w) + 2)).alias("spans")),
        "doc_id", "spans", "s")
    width = span_width(F.col("s")).cast("bigint")
    return spans.groupBy("doc_id").agg(F.sum(width).alias("widths"), F.max(width).alias("widest"))


@query("x7_extract_groups", r"""select page_id, case when regexp_matches(url, '^https?://([^/]+)/([a-z]+)/') then regexp_extract(url, '^https?://([^/]+)/([a-z]+)/', 1) end as host,
  case when regexp_matches(url, '^https?://([^/]+)/([a-z]+)/') then regexp_extract(url, '^https?://([^/]+)/([a-z]+)/', 2) end as lang from pages""")
def x7(spark, sf):
    return extract_groups(table(spark, sf, "pages").select("page_id", "url"), "url", r"^https?://([^/]+)/([a-z]+)/", ["host", "lang"]).drop("url")


@query("x8_wide_to_long", """select l_orderkey, l_linenumber, name, value from (
  select l_orderkey, l_linenumber, l_quantity, l_discount, l_tax from lineitem) unpivot (value for name in (l_quantity, l_discount, l_tax))""")
def x8(spark, sf):
    wide = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return wide_to_long(wide, ["l_orderkey", "l_linenumber"])


def _digest(arr):
    return F.md5(F.array_join(F.transform(arr, lambda x: x.cast("string")), ","))


@query("x9_pad", f"""with {WORDS}, lens as (select doc_id, list_transform(words, lambda w: len(w)) as a from docs)
  select doc_id, md5(array_to_string(list_resize(a, cast(ceil(len(a) / 64.0) * 64 as bigint), 0), ',')) as padded from lens""")
def x9(spark, sf):
    lens = word_lists(spark, sf).select("doc_id", F.transform("words", F.length).alias("a"))
    full = (F.ceil(F.size("a") / 64) * 64).cast("int")
    return lens.select("doc_id", _digest(pad(F.col("a"), full)).alias("padded"))


@query("x10_densify", f"""with {MARKS} select doc_id, md5(string_agg(cast(hit as varchar), ',' order by pos)) as dense from (
  select doc_id, pos, max(flag) as hit from marks group by 1, 2) group by 1""")
def x10(spark, sf):
    rows = posts(spark, sf).select(
        F.col("post_id").cast("bigint").alias("doc_id"), F.size("post_tokens").alias("n"), nested_consensus(F.col("rationales")).alias("m"))
    return rows.select("doc_id", _digest(F.transform(densify(F.col("m"), F.col("n")), lambda x: x.cast("int"))).alias("dense"))


@query("x10_spans_to_mask", f"""with {WORDS} select doc_id, md5(string_agg(case when len(w) > 4 then 'true' else 'false' end, ',' order by i)) as flags from (
  select doc_id, unnest(words) as w, unnest(range(1, len(words) + 1)) as i from docs) group by 1""")
def x10_mask(spark, sf):
    rows = word_lists(spark, sf).select("doc_id", F.size("words").alias("n"), runs_of_true(F.transform("words", lambda w: F.length(w) > 4)).alias("runs"))
    return rows.select("doc_id", _digest(spans_to_mask(F.col("runs"), F.col("n"))).alias("flags"))


@query("x11_render_spans", f"""with {WORDS} select doc_id, md5(string_agg(repeat(case when len(w) > 4 then 'X' else ' ' end, len(w)), '' order by i)) as line,
  cast(sum(len(w)) as bigint) as width from (
  select doc_id, unnest(words) as w, unnest(range(1, len(words) + 1)) as i from docs) group by 1""")
def x11(spark, sf):
    # Words laid end to end: a running total of their lengths gives the spans.
    words = word_lists(spark, sf)
    glued = words.select("doc_id", "words", align_words(F.col("words"), F.array_join("words", "")).alias("spans"))
    line = render_spans(F.transform("words", lambda w: F.length(w) > 4), F.col("spans"))
    return glued.select("doc_id", line.alias("t")).select("doc_id", F.md5("t").alias("line"), F.length("t").cast("bigint").alias("width"))


@query("x12_float_threshold", """select vec_id, array_to_string(list_transform(embedding, lambda x: case when x::double > (0.1 - 1e-7)::double then '1' else '0' end), '') as flags from embeddings""")
def x12(spark, sf):
    flags = above(F.transform("embedding", lambda x: x.cast("double")), 0.1)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.array_join(F.transform(flags, lambda b: F.when(b, "1").otherwise("0")), "").alias("flags"))
