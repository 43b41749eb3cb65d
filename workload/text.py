"""De-tokenising, tokenising and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from votespan.functions.text import AFTER_STRIP, CONTRACTIONS, ENDING_QUOTES, detokenize
from votespan.operators.tokenizer import build_vocab, map_batches, tokenize, vocab_dict, word_counts, wordpiece_udf
from workload.registry import query, table
from workload.tables import WORDS, documents, word_lists


def _chain(sql: str, rules) -> str:
    for pattern, to in rules:
        quoted = pattern.replace("'", "''")
        target = to.replace("$", "\\").replace("'", "''")
        sql = f"regexp_replace({sql}, '{quoted}', '{target}', 'g')"
    return sql


_blanks = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
DETOKENIZED = _chain("(' ' || array_to_string(words, ' ') || ' ')", CONTRACTIONS + ENDING_QUOTES)
DETOKENIZED = f"trim({_chain(f'trim({DETOKENIZED}, {_blanks})', AFTER_STRIP)}, {_blanks})"


@query("x1_detokenize", f"with {WORDS} select doc_id, {DETOKENIZED} as text from docs")
def x1(spark, sf):
    return word_lists(spark, sf).select("doc_id", detokenize(F.col("words")).alias("text"))


@query("x2b_word_counts", r"""select word, count(*) as n from (
  select unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\r])')) as word from documents) group by 1""")
def x2b_counts(spark, sf):
    return word_counts(documents(spark, sf))


def vocab_sql(source: str, size: int = 20_000) -> str:
    """CTEs up to ``vocab`` (token, id) of a table's texts."""
    return rf"""counts as (select word, count(*) as n from (
    select unnest(regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}} \t\n\r])')) as word from {source}) group by 1),
  chars as (select c, cast(sum(n) as bigint) as n from (select unnest(string_split(word, '')) as c, n from counts) where c <> '' group by 1),
  top as (select word as token, n from counts where len(word) > 1 order by n desc, word limit {size}),
  every as (select '[PAD]' as token, 0 as part, 0 as n union all select '[UNK]', 0, -1 union all select '[CLS]', 0, -2
    union all select '[SEP]', 0, -3 union all select '[MASK]', 0, -4
    union all select c, 1, n from chars union all select '##' || c, 1, n from chars union all select token, 2, n from top),
  vocab as (select token, cast(row_number() over (order by part, n desc, token) - 1 as int) as id from every)"""


def wordpiece_sql(keys: str) -> str:
    """CTEs from ``src`` (keys, text) and ``vocab`` to ``pieces`` (keys, i, place, ids, starts, ends: a
    word's ids, where its pieces lie in it and where it lies in the text) and ``tokenized`` (keys,
    n, ids, offsets: MD5 of both lists): the longest piece at each place of each distinct word,
    then the chain of them from its start."""
    sign = r"!-/:-@\[-`{-~\p{P}"
    token = rf"[^ \t\n\r{sign}]+|[{sign}]"
    return rf"""lists as (select {keys}, regexp_extract_all(lower(text), '{token}') as ws,
      regexp_extract_all(lower(text), '([ \t\n\r]*)({token})', 1) as gaps from src),
  toks as (select {keys}, unnest(ws) as word, unnest(gaps) as gap, unnest(range(1, len(ws) + 1)) as i from lists),
  at_text as (select {keys}, word, i, sum(len(gap) + len(word)) over (partition by {keys} order by i) - len(word) as place from toks),
  words as (select distinct word from toks),
  places as (select word, unnest(range(0, len(word))) as pos from words where len(word) <= 100),
  cuts as (select word, pos, unnest(range(1, least(len(word) - pos, (select max(len(token)) from vocab)) + 1)) as l from places),
  longest as (select word, pos, max(l) as l, arg_max(id, l) as id from cuts
    join vocab on token = case when pos = 0 then '' else '##' end || substr(word, pos + 1, l) group by 1, 2),
  chain as (select word, cast(0 as bigint) as pos, []::int[] as ids, []::bigint[] as starts from words
    union all select c.word, c.pos + g.l, list_append(c.ids, g.id), list_append(c.starts, c.pos)
    from chain c join longest g on c.word = g.word and c.pos = g.pos),
  whole as (select w.word, coalesce(c.ids, [1]) as ids, coalesce(c.starts, [0::bigint]) as starts,
    list_append(coalesce(c.starts, [0::bigint])[2:], len(w.word)) as ends from words w left join chain c on w.word = c.word and c.pos = len(w.word)),
  pieces as (select {keys}, i, place, ids, starts, ends from at_text join whole using (word)),
  flat as (select {keys}, list(ids order by i) as ids, list(list_transform(range(1, len(ids) + 1),
    lambda k: cast(place + starts[k] as bigint) || '-' || cast(place + ends[k] as bigint)) order by i) as offs from pieces group by all),
  tokenized as (select {keys}, cast(len(flatten(coalesce(ids, []))) + 2 as int) as n,
    md5(array_to_string(list_concat([2], flatten(coalesce(ids, [])), [3]), ',')) as ids,
    md5(array_to_string(list_concat(['0-0'], flatten(coalesce(offs, [])), ['0-0']), ',')) as offsets
    from (select {keys} from src) left join flat using ({keys}))"""


def ids_digest(tokens: str = "tokens"):
    return F.md5(F.array_join(F.col(tokens).cast("array<string>"), ","))


def spans_digest(spans):
    """MD5 of all spans in order."""
    return F.md5(F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ","))


@query("x2b_build_vocab", f"with {vocab_sql('documents')} select * from vocab")
def x2b(spark, sf):
    return build_vocab(documents(spark, sf), size=20_000)


def corpus_vocab(spark, sf) -> dict[str, int]:
    return vocab_dict(build_vocab(documents(spark, sf), size=20_000))


@query("x2_tokenize", f"""with recursive {vocab_sql('documents')}, src as (select doc_id, text from documents), {wordpiece_sql('doc_id')}
  select doc_id, n, n as valid, ids, offsets from tokenized""")
def x2(spark, sf):
    rows = tokenize(documents(spark, sf), "text", corpus_vocab(spark, sf), strip_accents=False, keep=["doc_id"])
    return rows.select(
        "doc_id", F.size("tokens").alias("n"), F.element_at("mask", 1)["end"].alias("valid"),
        ids_digest().alias("ids"), spans_digest(F.col("offsets")).alias("offsets"))


@query("f4_map_batches", f"""with recursive {vocab_sql('conversations')}, src as (select conv_id, turn, text from conversations), {wordpiece_sql('conv_id, turn')}
  select conv_id, turn, n, ids, offsets from tokenized""")
def f4(spark, sf):
    """The struct UDF in Arrow batches next to the key, on conversations."""
    talk = table(spark, sf, "conversations")
    udf = wordpiece_udf(vocab_dict(build_vocab(talk, size=20_000)), strip_accents=False, broadcast=spark.sparkContext.broadcast)
    rows = map_batches(talk, udf, ["conv_id", "turn"], ["text"])
    return rows.select("conv_id", "turn", F.size("tokens").alias("n"), ids_digest().alias("ids"), spans_digest(F.col("offsets")).alias("offsets"))
