"""The registered queries of this subpackage and, where SQL can say it, their oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tabulary.llm import (
    attention,
    caps,
    chat,
    html_blocks,
    minhash,
    packing,
    partenum,
    pieces,
    ppm,
    product_codes,
    resampling,
    secrets,
    wordpiece,
)

#: Vocabulary files; the paths are parameters of the operators.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


def _table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Smallest id that can be reached by the links (u, v) from each id of ``nodes``.
_REACH = """
sides as (select u, v from links union all select v, u from links),
reach as (
  select id, id as root from nodes
  union
  select s.v, r.root from reach r join sides s on s.u = r.id
),
least as (select id, min(root) as component_id from reach group by id)
"""


@_query()
def op1_document_fingerprints(spark: SparkSession, base: str) -> DataFrame:
    return minhash.edited_fingerprints(_table(spark, base, "documents"), _parts(spark))


@_query(
    rf"""
with recursive
words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') as w
  from documents
),
sets as (
  select doc_id, case
    when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
  end as g
  from words
),
items as (select doc_id, unnest(g) as t from sets),
nodes as (select doc_id as id, len(g) as n from sets),
pairs as (
  select a.doc_id as u, b.doc_id as v, count(*) as c
  from items a join items b on a.t = b.t and a.doc_id < b.doc_id group by 1, 2
),
links as (
  select u, v from pairs join nodes a on a.id = u join nodes b on b.id = v
  where 100 * c >= 75 * (a.n + b.n - c)
),
{_REACH}
select id as doc_id, n as n_shingles, component_id from nodes join least using (id)
"""
)
def op2_ngram_jaccard_join(spark: SparkSession, base: str) -> DataFrame:
    found = partenum.jaccard_components(_table(spark, base, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@_query(
    f"""
with recursive
usable as (
  select vec_id as id, label, embedding::double[] as x from embeddings
  where label is not null and len(embedding) > 0 and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda c: not isfinite(c))) = 0
    and len(list_filter(embedding, lambda c: c <> 0)) > 0
),
links as (
  select a.id as u, b.id as v from usable a join usable b on a.label = b.label and a.id < b.id
  where list_cosine_similarity(a.x, b.x) >= 0.93
),
nodes as (select vec_id as id from embeddings),
{_REACH},
counted as (select u as id, count(*) as n from sides group by u)
select id as vec_id, coalesce(n, 0)::bigint as n_links, component_id, id = component_id as kept
from nodes join least using (id) left join counted using (id)
"""
)
def op3_embedding_near_dedup(spark: SparkSession, base: str) -> DataFrame:
    return caps.near_vectors(_table(spark, base, "embeddings"))


@_query()
def op4_token_counts(spark: SparkSession, base: str) -> DataFrame:
    docs = _table(spark, base, "documents").select("doc_id", "text")
    return wordpiece.token_counts(docs, PIECES)


@_query()
def op5_language_id(spark: SparkSession, base: str) -> DataFrame:
    docs = _table(spark, base, "documents")
    found = ppm.identify(docs.select("doc_id", "text"), ppm.fold_model(docs))
    return found.select("doc_id", ppm.held_out().alias("held_out"), "lang_pred", "score", F.length("text").alias("n_chars"))


def _escapes_in(column: str) -> str:
    """SQL: how many backslashes escaping puts into a column."""
    patterns = (c[0] + r"\\*" + re.sub(r"([|\[\]])", r"\\\1", c[1:]) for c in chat.CONTROL)
    pattern = "|".join(p if p[0] != "[" else "\\" + p for p in patterns)
    return f"len(regexp_extract_all({column}, '{pattern}'))"


@_query(
    f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
talks as (
  select conv_id, count(*) as n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '') as loss,
    sum({len(chat.START + chat.SEPARATOR + chat.END)} + length(role) + length(text)
      + {_escapes_in("role")} + {_escapes_in("text")})::bigint as formatted_chars
  from turns group by conv_id
)
select conv_id, n_turns, turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from talks
"""
)
def op6_chat_formatting(spark: SparkSession, base: str) -> DataFrame:
    rows = _table(spark, base, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"select * from values (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') "
        "as t(conv_id, turn, role, text)"
    )
    made = chat.format_conversations(rows.unionByName(extra), BYTE_BPE)
    return made.select(
        "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"
    )


@_query()
def op7_sentencepiece(spark: SparkSession, base: str) -> DataFrame:
    docs = _table(spark, base, "documents").select("doc_id", "text")
    coded = pieces.decode_column(pieces.encode_column(docs, PIECES), PIECES)
    return coded.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@_query()
def op8_packing(spark: SparkSession, base: str) -> DataFrame:
    return packing.pack(_table(spark, base, "documents"), BYTE_BPE)


@_query()
def op9_html_extraction(spark: SparkSession, base: str) -> DataFrame:
    pages = _table(spark, base, "pages").select("page_id", "url", "html")
    return html_blocks.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


@_query()
def op10_secret_scans(spark: SparkSession, base: str) -> DataFrame:
    docs = _table(spark, base, "documents").select("doc_id", "text")
    chains = secrets.train(secrets.labelled_samples(docs))
    found = secrets.scan(docs, chains).withColumn("base", secrets.base_spans(F.col("secrets")))
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"),
    )


#: CRC-32 of the text column f, byte by byte through a table made from the polynomial.
_CRC = """
crc_steps as (
  select b, b as c, 0 as k from range(256) r(b)
  union all
  select b, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k + 1 from crc_steps where k < 8
),
crc_table as (select list(c order by b) as tab from crc_steps where k = 8),
"""
_CRC_OF_F = """
xor(list_reduce(
  list_transform(range(octet_length(encode(f))),
    lambda i: (strpos('0123456789ABCDEF', substr(hex(encode(f)), 2 * i + 1, 1)) - 1) * 16
      + strpos('0123456789ABCDEF', substr(hex(encode(f)), 2 * i + 2, 1)) - 1),
  lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]),
  4294967295), 4294967295)
"""


@_query(
    rf"""
with recursive {_CRC}
texts as (
  select 0 as side, row_number() over () as n, doc_id, text from documents
  union all select 1, -row_number() over (), null, text from benchmark
),
words as (
  select side, n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from texts
),
features as (
  select side, n, unnest(list_concat(list_concat(w,
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) as f
  from words
),
buckets as (
  select f, {_CRC_OF_F} % {resampling.BUCKETS} as bucket from (select distinct f from features), crc_table
),
placed as (select side, n, bucket, count(*) as c from features join buckets using (f) group by all),
sizes as (
  select bucket, sum(c) filter (side = 0) as s, coalesce(sum(c) filter (side = 1), 0) as t
  from placed group by bucket
),
whole as (
  select coalesce(sum(c) filter (side = 0), 0) as s_all, coalesce(sum(c) filter (side = 1), 0) as t_all from placed
),
gains as (
  select bucket, floor(1000 * ln(((t + 1) * (s_all + {resampling.BUCKETS}))::double
    / ((s + 1) * (t_all + {resampling.BUCKETS}))::double))::bigint as gain
  from sizes, whole
),
weights as (
  select n, sum(c)::bigint as n_features, sum(c * gain)::bigint as weight
  from placed join gains using (bucket) where side = 0 group by n
),
scores as (
  select n, doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features,
    coalesce(weight, 0)::bigint as weight,
    coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((
      ('0x' || substr(sha256('{resampling.SEED}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5
    ) / 4294967296.0::double)))::bigint as score
  from words left join weights using (n) where side = 0
),
drawn as (
  select n, row_number() over (order by score desc, doc_id nulls last, n) as rank
  from scores where n_words >= {resampling.LEAST_WORDS}
)
select doc_id, n_features, weight, score,
  case when rank <= ({resampling.PERCENT} * (select count(*) from drawn)) // 100 then rank end::bigint as rank
from scores left join drawn using (n)
"""
)
def op11_importance_resampling(spark: SparkSession, base: str) -> DataFrame:
    return resampling.resample(_table(spark, base, "documents"), _table(spark, base, "benchmark"))


def _codes_sql() -> str:
    """One round after another: the nearest entry of every part, then the entries' floored means."""
    nearest = """
near{r} as (
  select id, k, least_entry.e as e, least_entry.d as d from (
    select p.id, p.k, min({{'d': list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'e': b.e}}) as least_entry
    from parts p join books{r} b on p.k = b.k group by 1, 2
  )
),"""
    moved = """
sums{r} as (
  select k, e, i, sum(v) as s, count(*) as n from (
    select p.k, n.e, unnest(p.x) as v, unnest(range(len(p.x))) as i from parts p join near{r} n using (id, k)
  ) group by all
),
books{s} as (
  select b.k, b.e, coalesce(m.x, b.x) as x from books{r} b left join (
    select k, e, list(((s - (((s % n) + n) % n)) // n)::bigint order by i) as x from sums{r} group by k, e
  ) m using (k, e)
),"""
    rounds = product_codes.ROUNDS
    steps = "".join(nearest.format(r=r) + (moved.format(r=r, s=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
with usable as (
  select row_number() over (order by vec_id nulls last, embedding) as id, vec_id, label,
    list_transform(embedding, lambda c: floor({product_codes.SCALE} * c::double)::bigint) as x
  from embeddings
  where embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda c: not isfinite(c))) = 0
),
parts as (
  select id, k, x[k * len(x) // {product_codes.PARTS} + 1:(k + 1) * len(x) // {product_codes.PARTS}] as x
  from usable, range({product_codes.PARTS}) t(k)
),
books0 as (select k, id - 1 as e, x from parts where id <= {product_codes.ENTRIES}),
{steps}
codes as (
  select id, string_agg(lower(printf('%02x', e)), '' order by k) as code, sum(d)::bigint as error
  from near{rounds} group by id
),
digest as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by k, e)) as codebooks_sha256 from books{rounds}
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256
from usable join codes using (id), digest
"""


@_query(_codes_sql())
def op12_vector_codes(spark: SparkSession, base: str) -> DataFrame:
    return product_codes.compress(_table(spark, base, "embeddings"))


@_query()
def op13_quality_classifier(spark: SparkSession, base: str) -> DataFrame:
    docs = _table(spark, base, "documents").select("doc_id", "text")
    labels = _table(spark, base, "labels").select("doc_id", F.col("quality").alias("label"))
    model = attention.train(docs, labels.filter(~attention.held_out()))
    return attention.score(docs, model).select(
        "doc_id",
        attention.held_out().alias("held_out"),
        "score",
        (F.col("score") >= attention.LEAST).cast("int").alias("predicted"),
        "n_passages",
    )
