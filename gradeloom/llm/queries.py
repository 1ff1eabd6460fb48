"""The operators over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm import (ann, bpe, collocations, exact_dedup, language_id, minhash, mixing, substring_dedup, suffix_dedup,
                           token_counts, turn_repair, warc, word_table)
from gradeloom.llm.common import shared_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


RANK_FILE = "byte_bpe_multi_50k.tiktoken"

MIX_SQL = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, md5('mix:' || coalesce(doc_id::varchar, 'null')) as o
  from documents),
s as (select source, sum(size)::bigint as n, 1 + (row_number() over (order by source nulls last) - 1) % 3 as w from d group by source),
c as (select *, 3 * n as cap, 3.0::double * n / w as ratio, sum(n) over () as total, sum(w) over () as weights from s),
l as (select *, (total - coalesce(sum(cap) over p, 0))::double / (weights - coalesce(sum(w) over p, 0))::double as level from c
      window p as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
t as (select source, n, least(cap::double, (select min_by(level, (ratio, source)) from l where level <= ratio) * w) as target from l),
p as (select d.*, t.n, t.target, round_even(t.target, 0)::bigint as q,
        2 * sum(size) over (partition by d.source order by o, size rows unbounded preceding) - size as mid
      from d join t on d.source is not distinct from t.source)
select doc_id, size, n as source_size, target,
  (size * ((mid < 2 * q)::int + (mid + 2 * n < 2 * q)::int + (mid + 4 * n < 2 * q)::int))::bigint as taken
from p"""


@query("op1_source_mixing", MIX_SQL)
def source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix_by_source(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", F.col("mix_taken").alias("taken"))


@query("op2_byte_bpe")
def byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path(RANK_FILE)
    done = bpe.round_trip(table(spark, sf, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_exact_dedup", r"""
with d as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as n from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by n) as group_size, row_number() over w = 1 as kept, sha256(n) as text_sha256
from d window w as (partition by n order by length(t) desc, doc_id)""")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf, "documents")).drop("points")


@query("op4_token_counts")
def flat_file_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A row per document of the token files that are written first: the file's number and the document's in it."""
    path = shared_path(spark, "flat-tokens")
    token_counts.write_flat(table(spark, sf, "documents"), path, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    return token_counts.token_counts(spark, path).select(
        F.regexp_extract("file", r"part-(\d+)", 1).cast("int").alias("file_no"), "doc_no", "n_tokens", "ended")


@query("op5_language_id")
def languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    sample = language_id.learn(docs.where(language_id.fold_number() != 0))
    rows = docs.select("doc_id", F.coalesce(language_id.fold_number() == 0, F.lit(False)).alias("held_out"), "text")
    return language_id.identify(rows, sample).drop("text")


def _cut_report(done: DataFrame) -> DataFrame:
    removed = F.aggregate("runs", F.lit(0).cast("bigint"), lambda n, r: n + r["end"] - r["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("runs").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_chunk_dedup")
def repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    return _cut_report(substring_dedup.remove_repeats(table(spark, sf, "documents")))


@query("op7_multi_index")
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(table(spark, sf, "embeddings"), F.col("id") % 100 == 0)


@query("op8_warc_index")
def archived_pages(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    history = warc.capture_history(warc.merged_index(warc.read_archives(spark, path)))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "date")


@query("op9_prob_minhash")
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_classes(table(spark, sf, "documents"))


@query("op10_bwt_merge")
def repeated_substrings(spark: SparkSession, sf: str) -> DataFrame:
    return _cut_report(suffix_dedup.remove_repeats(table(spark, sf, "documents")))


WORD_FILE = "byte_bpe_50k.json"


@query("op11_word_table_bpe")
def word_table_bpe(spark: SparkSession, sf: str) -> DataFrame:
    done = word_table.encode(table(spark, sf, "documents").select("doc_id", "text"), public_tokenizers.path(WORD_FILE))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_hat_trie_collocations", r"""with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from p),
g as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
s as (select lang, w, i, unnest(range(1, 6)) as m from g),
f as (select lang, m, array_to_string(list_slice(w, i, i + m - 1), ' ') as phrase, count(*)::bigint as f from s where i + m - 1 <= len(w) group by all),
q as (select lang, sum(f)::bigint as n from f where m = 1 group by lang),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1 and f >= 100),
h as (select distinct x.lang, x.phrase from c x join c y on x.lang = y.lang and y.m > x.m and contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') and y.a >= x.a),
k as (select c.*, unnest(range(1, m)) as k from c anti join h on c.lang = h.lang and c.phrase = h.phrase),
u as (select k.lang, k.phrase, k.a, k.k, l.f as l, r.f as r, q.n, ((1000::hugeint * k.a * q.n) // (l.f::hugeint * r.f))::bigint as score from k
      join f l on l.lang = k.lang and l.phrase = array_to_string(list_slice(k.w, 1, k.k), ' ')
      join f r on r.lang = k.lang and r.phrase = array_to_string(list_slice(k.w, k.k + 1, k.m), ' ')
      join q on q.lang = k.lang),
b as (select * from u qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from b)
select * from o where rank <= 2000""")
def hat_trie_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.top_collocations(collocations.collocations(table(spark, sf, "documents")))


@query("op12_turn_alignment", r"""with recursive b as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as s from conversations),
z as (
  select *, xor(4294967295::bigint, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(0, 8 * len(s)), lambda i: case when i % 8 = 0 then ascii(substr(s, (i // 8)::int + 1, 1)) else 0 end::bigint)),
    lambda v, x: xor(xor(v, x) >> 1, 3988292384::bigint * (xor(v, x) & 1)))) % 20 as k
  from b),
d as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case when k = 1 then '' when k = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(range(0, case when k = 3 then 2 else 1 end)) as copy
  from z where k <> 0),
f as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as r,
    case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b'
      when row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 then 'd'
      when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 't' else 'f' end as fault
  from d),
-- an inserted turn (5) is never cheapest: deleting its partner (2), and a system turn left alone (2), costs less
m as (
  select * from (values ('D', null, -1, -1, 2), ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
    ('R', 'u', 0, 2, 1), ('R', 'u', 1, 2, 1), ('R', 'u', 3, 2, 1), ('R', 'a', 2, 3, 1)) t(edit, to_role, state, next_state, price)),
p as (
  select distinct conv_id, 0::bigint as r, 0 as state, 0::bigint as cost, '' as audit from f
  union all
  select p.conv_id, f.r, case when m.edit = 'D' then p.state else m.next_state end as state,
    min(p.cost + m.price + case when m.edit <> 'D' and f.fault = 't' then 5 else 0 end)::bigint as cost,
    arg_min(p.audit || m.edit, row(p.cost + m.price + case when m.edit <> 'D' and f.fault = 't' then 5 else 0 end, p.audit || m.edit)) as audit
  from p join f on f.conv_id is not distinct from p.conv_id and f.r = p.r + 1
  join m on (m.edit = 'D' or (m.state = p.state and f.fault in ('t', 'f') and (m.edit = 'K') = (left(f.role, 1) = m.to_role)))
  group by p.conv_id, f.r, case when m.edit = 'D' then p.state else m.next_state end),
n as (
  select conv_id, count(*) as rows, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count_if(fault = 'b')::bigint as blank,
    count_if(fault = 'd')::bigint as duplicate, count_if(fault = 't')::bigint as truncated
  from f group by conv_id),
i as (
  select conv_id, count_if(pair is not null and pair not in ('su', 'ua', 'au'))::bigint as illegal
  from (select conv_id, lag(left(role, 1)) over (partition by conv_id order by r) || left(role, 1) as pair from f) group by conv_id),
e as (
  select n.conv_id, min(p.cost) as cost, arg_min(p.audit, row(p.cost, p.audit)) as audit
  from n join p on p.conv_id is not distinct from n.conv_id and p.r = n.rows and p.state in (0, 3) group by n.conv_id),
k as (
  select f.conv_id, f.r, f.role, f.text, substr(e.audit, f.r::int, 1) as edit, len(replace(e.audit, 'D', '')) % 2 as odd,
    count_if(substr(e.audit, f.r::int, 1) <> 'D') over (partition by f.conv_id order by f.r) as place
  from f join e on e.conv_id is not distinct from f.conv_id),
t as (
  select conv_id, string_agg(case when edit = 'K' then role when (place - odd) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by r) as whole
  from k where edit <> 'D' group by conv_id),
c as (select distinct conv_id from conversations)
select c.conv_id, coalesce(n.gaps, 0) as gaps, coalesce(n.blank, 0) as blank, coalesce(n.duplicate, 0) as duplicate, coalesce(n.truncated, 0) as truncated,
  coalesce(i.illegal, 0) as illegal, coalesce(e.cost, 0) as cost, coalesce(e.audit, '') as audit, sha256(coalesce(t.whole, '')) as repaired_sha256
from c left join n on n.conv_id is not distinct from c.conv_id left join i on i.conv_id is not distinct from c.conv_id
  left join e on e.conv_id is not distinct from c.conv_id left join t on t.conv_id is not distinct from c.conv_id""")
def turn_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf, "conversations")))
