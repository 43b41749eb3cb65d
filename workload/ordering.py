"""Order, positions, batches, splits, sampling and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from votespan.functions.columns import row_hash
from votespan.operators.batches import bucketed_batches, complete_batches, pad_length, padding_share
from votespan.operators.permutation import PRIME, ROUNDS, shuffled
from votespan.operators.positions import assign_batches, beyond_n_latest, newest, offset_index, ordered_index, sort_by, source_index
from votespan.operators.sampling import (
    append_rows, balanced_draws, balanced_sample, combine_sources, sample_n, shuffle, source_sizes, with_split,
)
from workload.registry import query, table
from workload.tables import doc_sources, hash_sql, runs, split_sql

LANGS = ["de", "en", "es", "fr"]


@query("w1_beyond_n_latest", """select run_id, experiment, owner from (
  select event_id as run_id, event_type as experiment, user_id as owner, row_number() over (partition by event_type order by ts desc, event_id) as rn from events)
  where rn > 35""")
def w1(spark, sf):
    old = beyond_n_latest(runs(spark, sf), ["experiment"], [F.desc("start_time"), F.col("run_id")], "run_id", 35)
    return old.select("run_id", "experiment", "owner")


@query("w1_newest", """select event_id as run_id, user_id as owner from (
  select *, row_number() over (partition by user_id order by ts desc, event_id) as rn from events) where rn <= 5""")
def w1_newest(spark, sf):
    return newest(runs(spark, sf), ["owner"], [F.desc("start_time"), F.col("run_id")], "run_id", 5).select("run_id", "owner")


def batch_sql(size: int, drop_last: bool) -> str:
    keep = f"where i < n - n % {size}" if drop_last else ""
    return f"""select * exclude (i, n), cast(i // {size} as bigint) as batch from (
      select doc_id, lang, len(text) as n_text, row_number() over (order by {hash_sql(7, 'doc_id')}, doc_id) - 1 as i, count(*) over () as n from documents) {keep}"""


def _batched(spark, sf, drop_last=False):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").cast("bigint").alias("n_text"))
    return assign_batches(docs, ["doc_id"], 64, seed=7, drop_last=drop_last)


@query("w2_assign_batches", batch_sql(64, True))
def w2(spark, sf):
    return _batched(spark, sf, drop_last=True)


@query("w3_pad_length", f"select *, max(n_text) over (partition by batch) as length from ({batch_sql(64, False)})")
def w3(spark, sf):
    rows = _batched(spark, sf).withColumn("tokens", F.array_repeat(F.lit(1), F.col("n_text").cast("int")))
    return pad_length(rows, "batch").drop("tokens").withColumn("length", F.col("length").cast("bigint"))


@query("w9_skewed_positions", """select event_id, event_type, squeezed, row_number() over (partition by event_type order by squeezed, event_id) - 1 as pos,
  count(*) over (partition by event_type) as n from (select event_id, event_type,
  case when event_id % 3 = 0 then 0 else cast(epoch_us(ts) - 1704067200000000 as bigint) // 1000 end as squeezed from events)""")
def w9_skewed(spark, sf):
    """A third of the events stand at one time: cuts go through it."""
    micros = F.unix_micros(F.col("ts").cast("timestamp_ltz")) - 1704067200000000
    events = table(spark, sf, "events").select(
        "event_id", "event_type", F.when(F.col("event_id") % 3 == 0, F.lit(0).cast("long")).otherwise(F.floor(micros / 1000)).alias("squeezed"))
    return ordered_index(events, ["event_type"], ["squeezed", "event_id"], "pos", total="n")


@query("w6_shuffle", f"select doc_id, lang, {hash_sql(3, 'doc_id')} as hashed from documents order by hashed")
def w6(spark, sf):
    return shuffle(table(spark, sf, "documents").select("doc_id", "lang"), ["doc_id"], 3).withColumn("hashed", row_hash(3, "doc_id"))


@query("w7_split", f"select doc_id, {split_sql('doc_id')} as split from documents")
def w7(spark, sf):
    return with_split(table(spark, sf, "documents").select("doc_id"), ["doc_id"])


@query("w8_sort_by", """select lang, count(*) as n, row_number() over (order by case lang when 'en' then 1 when 'de' then 2 else 0 end, lang) - 1 as place
  from documents group by lang""")
def w8(spark, sf):
    """A report of the languages, the two largest at its end."""
    report = sort_by(table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", last=["en", "de"])
    # Places of a handful of sorted rows.
    return report.coalesce(1).withColumn("place", F.monotonically_increasing_id())


def permutation_sql(x: str, n: str, source: str, seed: int) -> str:
    """Recursive CTE ``walk`` (x, n, p, done): every position's place, stirred until it is below n."""
    def mixed(digit, turn):
        y = f"((({digit}) + {(seed * 7919 + turn * 104729 + 12345) % PRIME}) * 48271) % {PRIME}"
        return f"(({y}) * ({y}) + ({y}) * {turn + 3}) % {PRIME}"

    def stirred(of):
        sql = f"select x, n, a, b, {of} // b as h, {of} % b as l from"
        # The first round stands innermost.
        layers = []
        for turn in range(ROUNDS):
            h, lo = ("h", f"(l + ({mixed('h', turn)}) % b) % b") if turn % 2 else (f"(h + ({mixed('l', turn)}) % a) % a", "l")
            layers.append(f"select x, n, a, b, {h} as h, {lo} as l from (")
        return f"select x, n, a, b, h * b + l as p from ({''.join(reversed(layers))}{sql} " + "{}" + ")" * ROUNDS + ")"

    first = stirred("x").format(f"(select {x} as x, {n} as n, cast(greatest(ceil(sqrt({n})), 1) as bigint) as a, "
                                f"cast(ceil({n} / greatest(ceil(sqrt({n})), 1)) as bigint) as b from {source})")
    return f"walk as ({first} union all {stirred('p').format('(select * from walk where p >= n)')})"


@query("w6_shuffle_position", "with recursive " + permutation_sql("i", "total", "(select row_number() over (order by doc_id) - 1 as i, count(*) over () as total from documents)", 3)
       + ", rows as (select doc_id, row_number() over (order by doc_id) - 1 as i from documents) select doc_id, p as place from rows join walk on x = i where p < n")
def w6_position(spark, sf):
    """Each document's place in a shuffle, computed from its position."""
    docs = table(spark, sf, "documents").select("doc_id")
    placed = offset_index(docs, [], F.floor(F.col("doc_id") / 1000), [F.col("doc_id")], "pos", total="n")
    return placed.select("doc_id", shuffled(F.col("pos"), F.col("n"), 3).alias("place"))


def buckets_sql(size: int, per: int, seed: int) -> str:
    return f"""numbered as (select doc_id, lang, n_chars, row_number() over (order by n_chars, {hash_sql(seed, 'doc_id')}, doc_id) - 1 as i, count(*) over () as total from documents),
      dealt as (select *, i // {size * per} as bucket, {hash_sql(f'{seed}:batch', 'doc_id')} as h from numbered),
      filled as (select *, bucket * {per} + (row_number() over (partition by bucket order by h, doc_id) - 1) // {size} as number, (total + {size - 1}) // {size} as batches from dealt),
      {permutation_sql('number', 'batches', '(select distinct number, batches from filled)', seed)}"""


@query("w3_bucketed_batches", f"with recursive {buckets_sql(16, 8, 2)} select doc_id, lang, p as batch from filled join walk on x = number where p < n")
def w3_buckets(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return bucketed_batches(docs, ["doc_id"], "n_chars", 16, per_bucket=8, seed=2).drop("n_chars")


@query("w3_padding_share", f"""with recursive {buckets_sql(16, 8, 2)}, per as (select number, count(*) as c, max(n_chars) as m, sum(n_chars) as s from filled group by 1)
  select cast(sum(c) as bigint) as rows, cast(sum(c * m) as bigint) as cells, round((sum(c * m) - sum(s))::double / sum(c * m), 6) as padding from per""")
def w3_padding(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    batches = bucketed_batches(docs, ["doc_id"], "n_chars", 16, per_bucket=8, seed=2)
    return padding_share(batches, "batch", "n_chars").withColumn("padding", F.round("padding", 6))


@query("w9_source_index", f"""with local as (select doc_id, lang as source, row_number() over (partition by lang order by {hash_sql(0, 'doc_id')}, doc_id) - 1 as local_idx from documents),
  sizes as (select lang, sum(count(*)) over (order by lang) - count(*) as off from documents group by 1)
  select doc_id, source, local_idx, cast(local_idx + off as bigint) as global_idx from local join sizes on source = lang""")
def w9(spark, sf):
    return source_index(doc_sources(spark, sf).drop("n_chars"), "source", ["doc_id"])


@query("p17_complete_batches", f"""with b as ({batch_sql(16, False)}) select * from b where batch in (
  select batch from b group by 1 having count(distinct lang) = 4)""")
def p17(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.length("text").cast("bigint").alias("n_text"))
    return complete_batches(assign_batches(docs, ["doc_id"], 16, seed=7), "batch", "lang", LANGS)


UNION = """every as (select 'documents' as source, cast(doc_id as varchar) as key, n_chars, cast(null as varchar) as role from documents
  union all select 'conversations', conv_id || '-' || turn, null, role from conversations
  union all select 'pages', cast(page_id as varchar), null, null from pages)"""


def _union(spark, sf):
    return combine_sources({
        "documents": table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("key"), "n_chars"),
        "conversations": table(spark, sf, "conversations").select(
            F.concat_ws("-", "conv_id", "turn").alias("key"), "role"),
        "pages": table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("key")),
    })


@query("u1_combine_sources", f"with {UNION} select * from every")
def u1(spark, sf):
    return _union(spark, sf)


@query("u1_source_sizes", f"with {UNION} select source, count(*) as size from every group by 1")
def u1_sizes(spark, sf):
    return source_sizes(_union(spark, sf))


@query("u2_append_rows", """select source, n, total from (select source, count(*) as n, cast(sum(n_chars) as bigint) as total from documents group by 1)
  union all select 'all', count(*), cast(sum(n_chars) as bigint) from documents""")
def u2(spark, sf):
    per = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total"))
    everything = per.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).withColumn("source", F.lit("all"))
    return append_rows(per, everything, ["source", "n", "total"])


@query("u3_balanced_sample", f"""with {UNION}, sizes as (select source, count(*) as c, row_number() over (order by source) - 1 as nth from every group by 1),
  quota as (select source, (select min(c) from sizes) // 3 + case when nth < (select min(c) from sizes) % 3 then 1 else 0 end as q from sizes),
  ranked as (select source, key, row_number() over (partition by source order by {hash_sql(5, 'key')}, key) as rn from every)
  select r.source, key from ranked r join quota t on r.source = t.source where rn <= q""")
def u3(spark, sf):
    return balanced_sample(_union(spark, sf), "source", ["key"], seed=5).select("source", "key")


@query("u3_balanced_per_source", f"""with {UNION}, ranked as (select source, key, row_number() over (partition by source order by {hash_sql(5, 'key')}, key) as rn from every)
  select source, key from ranked where rn <= (select min(c) from (select count(*) as c from every group by source))""")
def u3_per_source(spark, sf):
    return balanced_sample(_union(spark, sf), "source", ["key"], seed=5, per_source=True).select("source", "key")


def draw_sql(what: str, draw: str, modulus: str) -> str:
    return f"(('0x' || substr(md5('9:{what}:' || {draw}), 1, 15))::bigint % {modulus})"


@query("u3_balanced_draws", f"""with {UNION}, sizes as (select source, count(*) as c, row_number() over (order by source) - 1 as nth from every group by 1),
  ranked as (select source, key, row_number() over (partition by source order by {hash_sql(9, 'key')}, key) - 1 as at from every),
  draws as (select unnest(range(0, (select min(c) from sizes))) as draw),
  aimed as (select draw, source, {draw_sql('row', 'draw', 'c')} as at from draws join sizes on nth = {draw_sql('source', 'draw', '3')})
  select draw, r.source, key from aimed a join ranked r on a.source = r.source and a.at = r.at""")
def u3_draws(spark, sf):
    return balanced_draws(_union(spark, sf), "source", ["key"], seed=9).select("draw", "source", "key")


@query("u4_sample_n", f"select doc_id, lang from documents order by {hash_sql(11, 'doc_id')}, doc_id limit 25")
def u4(spark, sf):
    return sample_n(table(spark, sf, "documents").select("doc_id", "lang"), 25, ["doc_id"], 11)
