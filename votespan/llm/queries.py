"""The operators over the whole given tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from votespan.llm.bpe import decimal_digest, decode, encode
from votespan.llm.common import plain_id
from votespan.llm.exact import exact_classes
from votespan.llm.knn import top_k
from votespan.llm.jaccard import link_classes
from votespan.llm.license_texts import NOTICES
from votespan.llm.licenses import license_matches
from votespan.llm.lines import line_digests
from votespan.llm.packing import pack, token_pieces
from votespan.llm.piece_counts import count_pieces
from votespan.llm.quality import expected_grade, fit, good, graded, rate
from votespan.llm.spelling import counted_words, spelling_forms
from votespan.llm.substring import substring_digests
from votespan.llm.token_store import read_store, write_store
from votespan.llm.whitening import fit_whitening, scaled, whiten
from votespan.sources.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_token_store")
def op1(spark, sf):
    """Writes the store and reads it back."""
    path = scratch_path(spark, "token-store")
    write_store(table(spark, sf, "documents"), path, byte_bpe(), end_id=2)
    return read_store(spark, path).select(
        plain_id(), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_substring_dedup", r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
windows as (select doc_id, i, md5(array_to_string(list_slice(ws, i, i + 19), ' ')) as h
  from w, unnest(range(1, len(ws) - 18)) as t(i)),
again as (select doc_id, i, row_number() over (partition by h order by doc_id, i) as nth from windows),
gone as (select distinct doc_id, i + k as pos from again, range(0, 20) as r(k) where nth > 1),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
kept as (select words.doc_id, count(*) filter (gone.pos is not null) as n_removed,
  string_agg(word, ' ' order by words.pos) filter (gone.pos is null) as kept
  from words left join gone on words.doc_id = gone.doc_id and words.pos = gone.pos group by words.doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
  sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)""")
def op2(spark, sf):
    return substring_digests(table(spark, sf, "documents"))


_VALUES = ", ".join("('{}', '{}')".format(*(x.replace("'", "''").replace("\n", " ") for x in notice)) for notice in sorted(NOTICES))


@query("op3_license_scan", rf"""
with notices as (select name, row_number() over () as nth, regexp_extract_all(translate(body,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+') as ws
  from (values {_VALUES}) as v(name, body)),
templates as (select name, nth, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as grams from notices),
lines as (select doc_id, unnest(string_split(text, chr(10))) as body, unnest(range(0, len(string_split(text, chr(10))))) as line
  from documents where text is not null),
worded as (select doc_id, line, regexp_extract_all(translate(body,
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:[0-9a-z]|[^\x00-\x7F])+') as ws from lines),
parted as (select *, sum((len(ws) = 0)::int) over (partition by doc_id order by line) as part from worded),
passages as (select doc_id, 'line' as passage, line, ws from parted where len(ws) > 0
  union all select doc_id, 'paragraph', min(line), flatten(list(ws order by line)) from parted where len(ws) > 0 group by doc_id, part
  union all select doc_id, 'text', min(line), flatten(list(ws order by line)) from parted where len(ws) > 0 group by doc_id),
sets as (select doc_id, passage, line, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) as grams
  from passages where len(ws) > 1),
near as (select * from sets where list_has_any(grams, (select flatten(list(grams)) from templates))),
scored as (select doc_id, passage, line, name, nth,
  2 * len(list_intersect(n.grams, t.grams)) / (len(n.grams) + len(t.grams))::double as dice from near n, templates t),
best as (select *, row_number() over (partition by doc_id, passage, line order by dice desc, nth) as place from scored)
select doc_id, passage, line::bigint as line, name as license, dice from best where place = 1 and dice >= 0.8""")
def op3(spark, sf):
    return license_matches(table(spark, sf, "documents"), NOTICES).select(
        plain_id(), "passage", "line", "license", "dice")


@query("op4_quality_classifier")
def op4(spark, sf):
    """Fits on the rated documents, scores every document."""
    docs = table(spark, sf, "documents")
    model = fit(docs, table(spark, sf, "labels"), graded(), 3)
    return rate(docs.select("doc_id", "text"), model).select(
        "doc_id", expected_grade("tails").alias("expected_grade"), F.element_at("tails", -1).alias("p_good"),
        good("tails").alias("kept"))


@query("op5_line_dedup", r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
keys as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
marked as (select *, length(k) >= 10 and min(doc_id) over (partition by k) <> doc_id as gone from keys)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id""")
def op5(spark, sf):
    return line_digests(table(spark, sf, "documents"))


@query("op6_jaccard_join", r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
shingles as (select distinct doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) as g
  from w, unnest(range(1, greatest(len(ws) - 3, 2))) as t(i) where len(ws) > 0),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c)),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
classes as (select a, least(a, min(b)) as class_id from reach group by a),
counts as (select a, count(*) as n_links from links group by a)
select doc_id, coalesce(class_id, doc_id) as class_id, coalesce(n_links, 0)::bigint as n_links
from documents left join classes on classes.a = doc_id left join counts on counts.a = doc_id""")
def op6(spark, sf):
    return link_classes(table(spark, sf, "documents"))


@query("op7_byte_bpe")
def op7(spark, sf):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)
    return decode(ids, ranks).select(
        plain_id(), F.size("ids").cast("long").alias("n_tokens"), decimal_digest("ids").alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op8_top_k", """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 20""")
def op8(spark, sf):
    return top_k(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_best_fit_packing")
def op9(spark, sf):
    pieces = token_pieces(table(spark, sf, "documents"), byte_bpe(), end_id=0, most=2048)
    return pack(pieces, 2048).select(
        plain_id(), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op10_exact_dedup", r"""
with t as (select doc_id, length(coalesce(text, '')) as n,
  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as h from documents)
select doc_id, first_value(doc_id) over best as keep_id, (count(*) over (partition by h))::bigint as group_size,
  doc_id = first_value(doc_id) over best as kept, h as text_sha256
from t window best as (partition by h order by n desc, doc_id)""")
def op10(spark, sf):
    return exact_classes(table(spark, sf, "documents"))


@query("op11_token_counts")
def op11(spark, sf):
    counts = count_pieces(table(spark, sf, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.select(plain_id(), "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"))


@query("op12_spelling_variants")
def op12(spark, sf):
    return spelling_forms(counted_words(table(spark, sf, "documents"))).select(
        "word", "form", "root", "n", "n_near", "form_n")


@query("op13_whitening")
def op13(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", scaled(F.col("embedding"), 1024, 100_000).alias("x"))
    return whiten(vectors, "vec_id", "x", fit_whitening(vectors, "x", 8))
