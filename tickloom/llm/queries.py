"""One registered query per operator over the whole table it is meant for, and its SQL where SQL can express it.

Each query derives the digest columns of its contract from the operator's own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    backoff_lm,
    chat,
    decontaminate,
    hilbert_shards,
    langid,
    ngram_join,
    order_minhash,
    pieces,
    pii,
    rlz_dedup,
    token_align,
    url_filter,
    whitening,
)
from tickloom.llm.columns import id_and_text, table
from tickloom.session import cut

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
BYTES = "/opt/tokenizers/byte_bpe_50k.json"
ALPHA = 0.5
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
ODD_CONVERSATION = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text, and the digest of what they decode to."""
    v = pieces.load(PIECES, ALPHA)
    encoded = pieces.encode(table(spark, sf_dir, "documents"), v, seed=20)
    return pieces.round_trip(encoded, v)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), size=4, percent=85)


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.with_neighbour(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz_dedup.digest(rlz_dedup.deduplicate(table(spark, sf_dir, "documents"), window=20))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_frame(spark, RULES)).select("page_id", "_judged.*")


def op7_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = backoff_lm.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_score", 6).alias("mean_score"), "n_unigram")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame(ODD_CONVERSATION, "conv_id long, turn long, role string, text string"))
    return chat.digest(chat.convert(chat.records_of_turns(turns), "conv_id", "record"))


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.predict(id_and_text(docs), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty shards along the curve through source, language, length and id."""
    docs = table(spark, sf_dir, "documents").withColumns(hilbert_shards.size_and_checksum())
    docs = cut(docs.select("doc_id", "size", "text_crc32", "source", "lang", "n_chars"))  # texts are read once
    layout = hilbert_shards.fit(docs, ["source", "lang", "n_chars", "doc_id"], bits=4)
    return hilbert_shards.assign(docs, layout, 40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "_shard.shard", "_shard.slot", F.lit(None).cast("int").alias("grown_shard"), "_shard.curve")


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per usable vector and leading component."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    m = whitening.fit(vectors, "embedding", k=8, scale=1024.0, shift=100_000)
    error = whitening.identity_error(vectors, m, "embedding")
    explained = F.array(*[F.lit(float(e / m.trace)) for e in m.variances]).cast("array<double>")
    white = whitening.transform(vectors, m, "embedding").select(F.col("vec_id").cast("long"), "_white.deviation", F.posexplode("_white.values").alias("at", "whitened"))
    return white.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(m.n).cast("long").alias("n"), "deviation", "whitened",
                        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))


def op13_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.summary(table(spark, sf_dir, "documents"), token_align.load(BYTES, PIECES))


QUERIES = {f.__name__: f for f in (op1_pii, op2_sentencepiece, op3_ngram_jaccard, op4_order_minhash, op5_substring_dedup, op6_url_filter,
                                   op7_stupid_backoff, op8_chat_format, op9_language_id, op10_decontamination,
                                   op11_hilbert_shards, op12_embedding_whitening, op13_token_align)}

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACED = r"'[^\x20\x09-\x0D]+'"
ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

SQL = {
    "op3_ngram_jaccard": f"""
with recursive w as (select doc_id, coalesce(regexp_extract_all({LOWER}, {SPACED}), []) ws from documents),
n as (select doc_id, ws, len(ws) n from w),
g as (
  select distinct doc_id, array_to_string(ws[i:i+3], ' ') s from (select doc_id, ws, unnest(range(1, n - 2)) i from n where n >= 4)
  union select doc_id, array_to_string(ws, ' ') from n where n between 1 and 3),
k as (select doc_id, count(*) c from g group by 1),
x as (select a.doc_id a, b.doc_id b, count(*) o from g a join g b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from x join k p on p.doc_id = a join k q on q.doc_id = b where 100 * o >= 85 * (p.c + q.c - o)),
r(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.other)
select d.doc_id, coalesce(c, 0) n_shingles, component_id, coalesce(l, 0) n_links
from documents d left join k on k.doc_id = d.doc_id
join (select doc_id, min(other) component_id from r group by 1) m on m.doc_id = d.doc_id
left join (select a, count(*) l from e group by 1) e on e.a = d.doc_id""",
    "op5_substring_dedup": f"""
with w as (select doc_id, coalesce(regexp_extract_all(text, {SPACED}), []) ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) + 1)) i from w),
s as (select doc_id, i, ws[i] word, case when i + 19 <= len(ws) then array_to_string(ws[i:i+19], ' ') end seq from p),
f as (select doc_id, i, word, seq is not null and row_number() over (partition by seq order by doc_id, i) > 1 dup from s),
c as (select doc_id, i, word, bool_or(dup) over (partition by doc_id order by i rows between 19 preceding and current row) gone from f)
select w.doc_id, len(w.ws) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256
from w left join (
  select doc_id, count(*) filter (gone) n_removed, string_agg(word, ' ' order by i) filter (not gone) kept from c group by 1) k on k.doc_id = w.doc_id""",
    "op6_url_filter": r"""
with p as (select page_id, url, case when contains(url, '://') then substring(url, instr(url, '://') + 3) else '' end rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from p),
r(action, rhost, rpath) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
m as (select page_id, max_by(rhost || rpath, length(rhost || rpath)) rule, max_by(action, length(rhost || rpath)) action
      from h join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath) group by 1)
select h.page_id, host, path, rule, coalesce(action, 'allow') verdict from h left join m on m.page_id = h.page_id""",
    "op7_stupid_backoff": f"""
with w as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i
           from (select doc_id, regexp_extract_all({LOWER}, {SPACED}) ws from documents where text is not null)),
g as (select doc_id, i, w, lag(w) over d v, lag(w, 2) over d u from w window d as (partition by doc_id order by i)),
g2 as (select *, v || ' ' || w b, u || ' ' || v || ' ' || w t, u || ' ' || v bc from g),
c1 as (select w k, count(*) n from w group by 1), c2 as (select b k, count(*) n from g2 where v is not null group by 1),
c3 as (select t k, count(*) n from g2 where u is not null group by 1),
o1 as (select doc_id, w k, count(*) n from w group by 1, 2), o2 as (select doc_id, b k, count(*) n from g2 where v is not null group by 1, 2),
o3 as (select doc_id, t k, count(*) n from g2 where u is not null group by 1, 2),
q as (
  select g.doc_id, i, (select count(*) from w) - count(*) over (partition by g.doc_id) big,
    case when u is not null then 2 when v is not null then 1 else 0 end top,
    a3.n - b3.n n3, ac2.n - bc2.n n2c, a2.n - b2.n n2, av.n - bv.n n1c, a1.n - b1.n n1
  from g2 g join c1 a1 on a1.k = g.w join o1 b1 on b1.k = g.w and b1.doc_id = g.doc_id
  left join c2 a2 on a2.k = g.b left join o2 b2 on b2.k = g.b and b2.doc_id = g.doc_id
  left join c1 av on av.k = g.v left join o1 bv on bv.k = g.v and bv.doc_id = g.doc_id
  left join c3 a3 on a3.k = g.t left join o3 b3 on b3.k = g.t and b3.doc_id = g.doc_id
  left join c2 ac2 on ac2.k = g.bc left join o2 bc2 on bc2.k = g.bc and bc2.doc_id = g.doc_id),
s as (select doc_id, n3 > 0 or n2 > 0 is true higher,
    case when n3 > 0 then ln(n3::double / n2c) when n2 > 0 then ln(n2::double / n1c) + (top - 1) * ln(0.4)
         when n1 > 0 then ln(n1::double / greatest(big, 1)) + top * ln(0.4) else ln(1.0 / greatest(big, 1)) + (top + 1) * ln(0.4) end x from q)
select d.doc_id, coalesce(n, 0) n_words, round(coalesce(x, 0), 4) log_score, round(x / n, 6) mean_score, coalesce(uni, 0) n_unigram
from documents d left join (select doc_id, count(*) n, sum(x) x, count(*) filter (not coalesce(higher, false)) uni from s group by 1) t on t.doc_id = d.doc_id""",
    "op8_chat_format": r"""
with c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
           union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e as (select *, replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\lturn>'), '</turn>', '\l/turn>'), chr(10), '\n') r,
             replace(replace(replace(text, '\', '\\'), '<turn>', '\lturn>'), '</turn>', '\l/turn>') t from c)
select conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256,
  sum(6 + length(r) + 1 + length(t) + 8)::bigint formatted_chars
from e group by 1""",
    "op10_decontamination": f"""
with d as (select doc_id, coalesce(regexp_extract_all({LOWER}, {ALNUM}), []) ws from documents),
b as (select item_id, regexp_extract_all({LOWER}, {ALNUM}) ws from benchmark where text is not null),
bw as (select distinct item_id, least(len(ws), 13) m, array_to_string(ws[i:i+least(len(ws), 13)-1], ' ') s
       from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) i from b where len(ws) > 0)),
dw as (select doc_id, i, m, array_to_string(ws[i:i+m-1], ' ') s
       from (select doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) i from d, (select distinct m from bw))),
h as (select doc_id, i, dw.m, item_id from dw join bw on bw.s = dw.s and bw.m = dw.m),
hit as (select doc_id, count(distinct j) n from (select doc_id, unnest(range(i, i + m)) j from h) group by 1),
it as (select doc_id, count(*) n, string_agg(item_id::varchar, ',' order by item_id::varchar) ids from (select distinct doc_id, item_id from h) group by 1)
select d.doc_id, len(ws) n_words, coalesce(hit.n, 0) n_hit, coalesce(it.n, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(hit.n, 0) > 0 and 20 * coalesce(hit.n, 0) >= len(ws) contaminated
from d left join hit on hit.doc_id = d.doc_id left join it on it.doc_id = d.doc_id""",
}
