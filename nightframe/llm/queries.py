"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file (never part of this repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the rank array and decoded from its ids."""
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op7_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document; a crossing token goes to the line with most of its characters."""
    from .token_counts import section_tokens

    return section_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op8_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written as framed records in id order and read back."""
    from . import scratch
    from .token_files import read, write

    folder = scratch.new_folder(spark, "records")
    manifest = write(table(spark, sf_dir, "documents"), folder, tokenizer("word_bpe_49k.json"), end_id=2)
    return read(manifest, digest=True).withColumnRenamed("key", "doc_id")


@query
def op1_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored in a transport-stream column, parsed and reassembled."""
    from .transport import mux, parse

    return parse(mux(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"], digest=True)


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules and by the listing of crawled spam URLs."""
    from .url_filter import judge, listing, rules_frame

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, listing(pages), rules_frame(spark)).drop("url")


ORACLES["op3_url_filter"] = r"""
with parts as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
rules(r_host, r_path, r_verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits as (
  select host, path, r_host || r_path as rule, r_verdict, row_number() over (partition by host, path order by length(r_host || r_path) desc, length(r_host) desc) as k
  from (select distinct host, path from parts) join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path))
select p.page_id, p.host, p.path, f.rule,
       coalesce(f.r_verdict, case when list_has_any(string_split(p.host, '.'), ['ads-track', 'spam-farm', 'casino-win', 'adult-x', 'cheap-pills', 'free-bets']) then 'block' else 'allow' end) as verdict
from parts p left join fits f on f.host = p.host and f.path = p.path and f.k = 1
"""


@query
def op10_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to deduplicated archives and read back with its revisits resolved."""
    from . import scratch
    from .warc import decide, read, resolve, write

    manifest = write(decide(table(spark, sf_dir, "pages")), scratch.new_folder(spark, "warc"))
    return resolve(read(manifest)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op10_warc_revisits"] = """
with p as (select page_id, encode(coalesce(html, '')) as body from pages),
d as (select page_id, octet_length(body)::bigint as payload_bytes, sha256(body) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 group by 1)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when d.page_id > f.first then 'revisit' else 'response' end as record_type,
       case when d.page_id > f.first then f.first end as refers_to
from d left join f on d.payload_digest = f.payload_digest and d.payload_bytes >= 100
"""


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word sequences that begin in a smaller document."""
    from .substring_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"), digest=True)


@query
def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shingle count and its component of near copies."""
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's category probabilities by the chain trained on the labels, and whether it is rejected."""
    from .toxicity import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items it holds."""
    from .decontaminate import matches

    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", found["cover"] > 0)


ORACLES["op9_substring_dedup"] = r"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as l from documents),
g as (select r, doc_id, i, array_to_string(l[i:i + 12], ' ') as k from (select *, unnest(range(1, len(l) - 11)) as i from w where len(l) >= 13)),
f as (select k, min(doc_id) as first from g group by 1),
m as (select distinct r, unnest(range(i, i + 13)) as i from g join f using (k) where g.doc_id > f.first),
x as (select r, i, l[i] as word from (select *, unnest(range(1, len(l) + 1)) as i from w)),
kept as (select x.r, string_agg(word, ' ' order by x.i) filter (m.i is null) as t, count(m.i) as gone from x left join m on m.r = x.r and m.i = x.i group by 1)
select w.doc_id, cast(len(l) as bigint) as n_words, cast(coalesce(gone, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (r)
"""

ORACLES["op4_jaccard_components"] = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as l from documents),
s as (select distinct doc_id, k from (
  select doc_id, array_to_string(l[i:i + 4], ' ') as k from (select *, unnest(range(1, len(l) - 3)) as i from w where len(l) >= 5)
  union all select doc_id, array_to_string(l, ' ') from w where len(l) between 1 and 4)),
n as (select doc_id, count(*) as c from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.k = b.k and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * p.c >= 75 * (x.c + y.c - p.c)),
reach as (select doc_id as a, doc_id as b from w union select reach.a, e.b from reach join e on e.a = reach.b),
least_of as (select a, min(b) as component_id from reach group by 1)
select w.doc_id, cast(coalesce(n.c, 0) as bigint) as n_shingles, component_id from w left join n using (doc_id) join least_of on least_of.a = w.doc_id
"""


@query
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound vector's product code, from Lloyd rounds over cover trees."""
    from .product_codes import product_codes

    return product_codes(table(spark, sf_dir, "embeddings"))


def _vector_sql() -> str:
    """The six rounds written out one after the other."""
    nearest = "select r, part, min(d * 16 + entry) % 16 as entry, min(d * 16 + entry) // 16 as d from (select c.r, c.part, b.entry, sum((c.x - b.e) * (c.x - b.e)) as d from c join b{k} b using (part, i) group by 1, 2, 3) group by 1, 2"
    sql = [
        "with k as (select row_number() over (order by vec_id, embedding) - 1 as r, vec_id, label, embedding from embeddings where embedding is not null and len(embedding) = len(list_filter(embedding, lambda x: x is not null and isfinite(x))))",
        "c as (select r, (j - 1) // n as part, (j - 1) % n as i, cast(floor(4096 * cast(x as double)) as bigint) as x from (select r, unnest(embedding) as x, unnest(range(1, len(embedding) + 1)) as j, len(embedding) // 8 as n from k))",
        "b0 as (select part, r as entry, i, x as e from c where r < 16)",
    ]
    for k in range(6):
        sql += [f"a{k} as ({nearest.format(k=k)})", f"b{k + 1} as (select b.part, b.entry, b.i, coalesce(m.e, b.e) as e from b{k} b left join (select part, entry, i, cast(floor(sum(c.x) / count(*)) as bigint) as e from c join a{k} using (r, part) group by 1, 2, 3) m using (part, entry, i))"]
    sql += [f"f as ({nearest.format(k=6)})", "v as (select r, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(d) as bigint) as error from f group by 1)"]
    return ",\n".join(sql) + "\nselect vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, (select sha256(string_agg(cast(e as varchar), ',' order by part, entry, i)) from b6) as codebooks_sha256 from v join k using (r)"


ORACLES["op11_vector_codes"] = _vector_sql()


@query
def op12_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, whole, in one of forty shards of equal counts, uniformly shuffled."""
    from pyspark.sql import functions as F

    from .shards import shuffle

    out = shuffle(table(spark, sf_dir, "documents"), 40)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language, in all orders."""
    from .filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
with recursive d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as l, min(doc_id) over (partition by t) as first from d),
m as (select w.part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
  (case when len(l) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(l)) < 50 * len(l) then 2 else 0 end)
  + (case when 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) then 4 else 0 end)
  + (case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end) + (case when w.doc_id > first then 16 else 0 end) as mask
  from w left join labels using (doc_id)),
c as (select part, mask, good, toxic, count(*) as n from m group by all),
orders(o) as (select '' union all select o || x from orders, (values ('A'), ('B'), ('C'), ('D'), ('E')) v(x) where instr(o, x) = 0),
s as (select o as filter_order, step, 1 << (ascii(o[step]) - 65) as bit, list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(o[i]) - 65))) as earlier
  from (select o, unnest(range(1, 6)) as step from orders where len(o) = 5)),
x as (select c.*, filter_order, step, mask & bit <> 0 as fails, mask & coalesce(earlier, 0) <> 0 as gone, mask = bit as alone, s.bit from c, s),
steps as (select part, filter_order, cast(step as int) as step, bit, cast(coalesce(sum(n) filter (not fails and not gone), 0) as bigint) as kept, cast(coalesce(sum(n) filter (fails and not gone), 0) as bigint) as removed,
  cast(coalesce(sum(n) filter (fails and gone), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (alone), 0) as bigint) as unique_fails,
  cast(coalesce(sum(n) filter (fails and not gone and good), 0) as bigint) as good_lost, cast(coalesce(sum(n) filter (fails and not gone and toxic), 0) as bigint) as toxic_lost from x group by all)
select * exclude (bit), cast(sum(removed) over (partition by part, bit) as bigint) as shapley from steps
"""
