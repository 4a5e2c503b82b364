"""The queries of this subpackage over whole tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language import identify_languages
from .line_dedup import dedup_lines
from .minhash import near_duplicates
from .mixing import plan_mixture
from .packing import encode_pieces, pack
from .quality import quality_table
from .sharding import assign_shards
from .substrings import drop_repeated_passages
from .token_counts import count_tokens
from .vectors import near_vectors

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), width=5, threshold=0.8, weights="count")
    return found.select("doc_id", "class_id", "kept", "n_shingles")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = encode_pieces(documents(spark, sf_dir), tokenizer_path(WORD_BPE), with_ids=False)
    return pack(pieces, order=["doc_id", "piece"], capacity=2048)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), limit=512)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    rows = documents(spark, sf_dir).select(
        "doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    )
    placed = assign_shards(rows, shards=24, order=["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = identify_languages(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return tagged.select("doc_id", "held_out", "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mixture(documents(spark, sf_dir))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)
    return found.select("vec_id", "n_links", "component_id", "kept")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_passages(documents(spark, sf_dir), width=13)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_table(documents(spark, sf_dir)).drop("source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_packing": op2_packing,
    "op3_token_counts": op3_token_counts,
    "op4_sharding": op4_sharding,
    "op5_language": op5_language,
    "op6_mixing": op6_mixing,
    "op7_vectors": op7_vectors,
    "op8_line_dedup": op8_line_dedup,
    "op9_substrings": op9_substrings,
    "op10_quality": op10_quality,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_minhash": rf"""
with recursive d as (select doc_id, {_WORDS} w from documents),
g as (select doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) s from d where len(w) > 0),
c as (select doc_id, s, count(*) n from g group by all),
z as (select doc_id, sum(n) total, count(*) n_shingles from c group by all),
m as (select a.doc_id a, b.doc_id b, sum(least(a.n, b.n)) common from c a join c b using (s) where a.doc_id <> b.doc_id group by all),
l as (select a, b from m join z x on x.doc_id = a join z y on y.doc_id = b where common >= 0.8 * (x.total + y.total - common) - 1e-9),
r as (select doc_id a, doc_id b from d union select r.a, l.b from r join l on r.b = l.a),
k as (select a doc_id, min(b) class_id from r group by all)
select doc_id, class_id, doc_id = class_id kept, coalesce(n_shingles, 0)::bigint n_shingles from k left join z using (doc_id)""",
    "op4_sharding": r"""
with steps as (select list(v order by i) t from (select i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end) v from (select unnest(range(256)) i))),
bytes as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
crcs as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::bigint, 2))::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295)::bigint crc from bytes, steps),
n as (select count(*) n from documents),
keyed as (select doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 size, md5('shard:' || coalesce(doc_id::varchar, '')) k from documents),
placed as (select *, (row_number() over (partition by source order by k, doc_id) - 0.5::double) / count(*) over (partition by source) frac from keyed),
ordered as (select *, row_number() over (order by frac, source is null, source, k, doc_id) - 1 p from placed),
cut as (select *, n // 24 e, n % 24 m from ordered, n),
dealt as (select *, case when p < m * (e + 1) then p // (e + 1) else m + (p - m * (e + 1)) // e end s from cut)
select d.doc_id, d.size::bigint size, c.crc text_crc32, 'rows' law, s::int shard, (p - (s * e + least(s, m)))::bigint slot, null::int grown_shard
from dealt d join crcs c using (doc_id)""",
    "op6_mixing": rf"""
with d as (select doc_id, source, len({_WORDS})::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
w as (select *, [5.0, 2.0, 1.0][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double w, source_size * 3.0::double cap from s),
o as (select *, sum(source_size) over () - coalesce(sum(cap) over q, 0) room, sum(w) over () - coalesce(sum(w) over q, 0) w_room
      from w window q as (order by cap / w, source is null, source rows between unbounded preceding and 1 preceding)),
c as (select *, cap * w_room < w * room capped from o),
t as (select source, source_size, case when capped then cap else least(cap, max(case when not capped then room / w_room end) over () * w) end target from c),
r as (select d.doc_id, d.size, t.source_size, t.target, case when t.source_size > 0 then least(t.target / t.source_size, 3.0) else 0.0 end rate,
        ('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double / 4503599627370496.0 u
      from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target::double target, (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end)::int copies,
  (size * (floor(rate) + case when u < rate - floor(rate) then 1 else 0 end))::bigint taken from r""",
    "op7_vectors": r"""
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e, list_dot_product(list_transform(embedding, lambda x: x::double), list_transform(embedding, lambda x: x::double)) q from embeddings),
ok as (select * from v where label is not null and q > 0 and isfinite(q)),
l as (select a.vec_id a, b.vec_id b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
      where list_dot_product(a.e, b.e) / sqrt(a.q) / sqrt(b.q) >= 0.98),
r as (select vec_id a, vec_id b from v union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) m from r group by a),
n as (select a, count(*) n from l group by a)
select c.a vec_id, coalesce(n.n, 0)::bigint n_links, c.m component_id, c.a = c.m kept from c left join n using (a)""",
    "op9_substrings": rf"""
with d as (select doc_id, {_WORDS} w from documents),
g as (select doc_id, unnest(range(1, len(w) - 11)) p, unnest(list_transform(range(1, len(w) - 11), lambda i: md5(array_to_string(w[i:i + 12], ' ')))) s from d where len(w) >= 13),
f as (select s, min(doc_id) m from g group by s having count(distinct doc_id) > 1),
c as (select distinct doc_id, unnest(range(p, p + 13)) k from g join f using (s) where doc_id > m),
x as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) k from d),
r as (select x.doc_id, count(c.k) n_removed, string_agg(case when c.k is null then word end, ' ' order by x.k) kept
      from x left join c on x.doc_id = c.doc_id and x.k = c.k group by x.doc_id)
select d.doc_id, len(d.w)::bigint n_words, coalesce(r.n_removed, 0)::bigint n_removed, sha256(coalesce(r.kept, '')) kept_sha256 from d left join r using (doc_id)""",
    "op10_quality": rf"""
with d as (select doc_id, source, coalesce(text, '') text, {_WORDS} w from documents),
l as (select doc_id, source, unnest(string_split(text, chr(10))) line from d),
m as (select doc_id, source, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') lw from l),
k as (select doc_id, source, line, array_to_string(list_transform(lw, lambda x: lower(x)), ' ') norm, len(lw) n from m where len(lw) > 0),
b as (select source, norm from k group by source, norm having count(distinct doc_id) > 20),
y as (select k.doc_id, count(*) n_lines, count(distinct line) n_distinct, sum(case when b.norm is not null then n else 0 end) gone, count(b.norm) gone_lines
      from k left join b on k.source is not distinct from b.source and k.norm = b.norm group by k.doc_id),
p as (select doc_id, unnest(range(1, len(w) - 6)) i, unnest(list_transform(range(1, len(w) - 6), lambda i: md5(array_to_string(w[i:i + 7], ' ')))) s from d where len(w) >= 8),
q as (select doc_id, i, count(*) over (partition by doc_id, s) c from p),
u as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + 8)) j from q where c > 1) group by doc_id),
a as (select d.doc_id, len(d.w)::bigint n_words, length(array_to_string(d.w, ''))::bigint word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
        coalesce(y.n_lines - y.n_distinct, 0)::bigint n_dup_lines, coalesce(u.n, 0)::bigint n_repeat_words, coalesce(y.gone_lines, 0)::bigint n_removed_lines, coalesce(y.gone, 0)::bigint n_removed_words
      from d left join y using (doc_id) left join u using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - n_removed_words >= 0.5 * n_words kept from a""",
}
