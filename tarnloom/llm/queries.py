"""The registered queries of this folder: each applies one operator with production parameters to its whole table.

All of them read whole texts of any length, treat repeated rows as rows of their own, ignore columns that they don't name,
and give no rows for an empty table; each operator's docstring states the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embeddings, fingerprint, langid, minhash, mixing, packing, quality, secrets, spelling, tokens, toxicity, warc
from .common import held_out, table

#: Target weights of the tree domain, language, source: parts among siblings; names that aren't listed count 100.
DOMAIN_WEIGHTS = {"web": 300, "books": 100}
LANG_WEIGHTS = {"en": 400, "de": 250, "fr": 200, "es": 150}
SOURCE_WEIGHTS = {"src0": 200}


def source_tree() -> dict:
    """Levels of the documents' tree. Sources numbered below 10 stand for the web, the others for books."""
    number = F.regexp_extract("source", r"^src(\d+)$", 1).try_cast("int")
    domain = F.when(number < 10, "web").when(number.isNotNull(), "books").otherwise("unknown")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of documents in one bin. A text without tokens has a row without a bin; long ones are cut into pieces. See packing.pack."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row of documents; null and empty texts have that of zero features. See quality.score_quality."""
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), at=0.3)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of each row's whole text; null counts as empty and has the digest of an empty list. See secrets.scan."""
    docs = table(spark, sf_dir, "documents")
    ratios = secrets.fit_ratios(secrets.corpus_samples(docs).union(secrets.rule_samples(docs)))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    base = F.sha2(secrets.listed(secrets.KINDS[:3]), 256).alias("base_sha256")
    return secrets.scan(docs, ratios).select("doc_id", *counts, base, secrets.listed(secrets.KINDS).alias("spans"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document gives to the mixture in each epoch. Those without tokens give nothing; null levels are `unknown`. See mixing.mix."""
    return mixing.mix(table(spark, sf_dir, "documents"), source_tree(), [DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS])


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a page, as read back from the archives; a null html is an empty response. See warc.round_trip."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for each row of documents, learned outside the held-out fold; `und` where there is no letter. See langid.identify."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs.filter(~held_out())))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of each row of documents by two-word shingles; texts without words stand alone. See minhash.near_duplicates."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for each row of documents; null and empty texts have the base score. See toxicity.score_toxicity."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and its edited text; null counts as empty. See fingerprint.fingerprint_edits."""
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of each vector; null, zero and non-finite ones and those without a label stand alone. See embeddings.near_vectors."""
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of each row's whole text; null counts as empty. See tokens.count_tokens."""
    import public_tokenizers

    return tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's terms are from its language's other sources, and which of its terms stand out. See divergence.divergence."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of the documents with the form that it is likely a misspelling of. See spelling.group_variants."""
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mixing": _MIXING,
        "op5_warc_round_trip": _WARC,
        "op7_minhash_dedup": _MINHASH,
        "op10_embedding_dedup": _EMBEDDINGS,
        "op12_source_divergence": _DIVERGENCE,
        "op13_spelling_variants": _SPELLING,
    }


_WARC = """
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as d from pages),
f as (select d, max(page_id) as first from p where octet_length(b) >= 1000 group by d)
select page_id, octet_length(b)::bigint as payload_bytes, p.d as payload_digest,
  case when first is null or first = page_id then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to
from p left join f on p.d = f.d and octet_length(b) >= 1000
"""

_EMBEDDINGS = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(embedding::double[], embedding::double[]) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach(id, r) as (select vec_id, vec_id from embeddings union select l.b, reach.r from reach join links l on l.a = reach.id),
c as (select id, min(r) as component_id from reach group by id),
n as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join c on c.id = vec_id left join n on n.a = vec_id
"""

_MINHASH = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
u as (select doc_id, len(s) as n, unnest(s) as h from s),
df as (select h, count(*) as f from u group by h),
o as (select doc_id, n, u.h, row_number() over (partition by doc_id order by f, u.h) as k from u join df on df.h = u.h),
pre as (select doc_id, n, h from o where k <= n - ceil(0.8 * n) + 1),
cand as (select distinct a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb from pre a join pre b on a.h = b.h and a.doc_id < b.doc_id where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
both_ as (select a, b, na, nb, count(*) as i from cand join u x on x.doc_id = a join u y on y.doc_id = b and y.h = x.h group by a, b, na, nb),
l as (select a, b from both_ where 100 * i >= 80 * (na + nb - i)),
links as (select a, b from l union all select b, a from l),
reach(id, r) as (select doc_id, doc_id from s union select links.b, reach.r from reach join links on links.a = reach.id),
c as (select id, min(r) as component_id from reach group by id)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join c on c.id = doc_id
"""


_SHARE = "(1 + (1000000000::hugeint * (n + 5)) // (total + 5 * v))::bigint"

_DIVERGENCE = rf"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from w group by lang, term having count(distinct id) >= 30),
grp as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from w join kept using (lang, term) group by lang, source, term),
v as (select lang, count(*) as v from kept group by lang),
gt as (select lang, source, sum(n) as total from c group by lang, source),
lt as (select lang, sum(n) as total from c group by lang),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, coalesce(gt.total, 0) as total, v.v
  from grp g join kept k on k.lang = g.lang join v on v.lang = g.lang
  left join c on c.lang = g.lang and c.source = g.source and c.term = k.term left join gt on gt.lang = g.lang and gt.source = g.source),
ps as (select lang, source, term, n, {_SHARE} as p from p),
q as (select lang, term, {_SHARE} as q from (select c.lang, c.term, sum(c.n) as n, any_value(lt.total) as total, any_value(v.v) as v
  from c join lt on lt.lang = c.lang join v on v.lang = c.lang group by c.lang, c.term)),
pairs as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p))::bigint as value from ps a join ps b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from grp a join grp b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select ps.lang, source, 'term', ps.term, p - q from ps join q on q.lang = ps.lang and q.term = ps.term where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every)
select * from ranked where part = 'pair' or rank <= 50
"""

_SPELLING = r"""
with recursive t as (select list(v order by i) as t from (select i, list_reduce(list_prepend(i, range(8)), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) as v from range(256) r(i))),
r as (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) as r from documents),
l as (select id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as n from r group by all),
b as (select r, n, id || ':' || r as s from l where length(r) >= 6),
h as (select r, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, strlen(s) + 1), lambda k: ('0x' || substr(hex(encode(s)), (2 * k - 1)::int, 2))::bigint)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]))) as h from b, t),
e as (select case when h % 199 = 0 then substr(r, 1, (h % length(r))::int) || substr(r, (h % length(r))::int + 2) else r end as word, n from h),
w as (select word, sum(n)::bigint as n from e where length(word) >= 6 group by word having sum(n) >= 5),
gone as (select word, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select word, unnest(range(1, length(word) + 1))::int as i from w)),
x as (select distinct a.word, b.word as near from gone a join w b on a.rest = b.word),
y as (select a.word, b.word as near from gone a join gone b on a.rest = b.rest and a.i = b.i and a.word <> b.word),
links as (select word, near from x union select near, word from x union select word, near from y),
best as (select links.word, count(*) as n_near, first(near order by w.n desc, near) as near, max(w.n) as near_n from links join w on w.word = links.near group by links.word),
f as (select w.word, case when near_n >= 5 * w.n then near end as form, w.n, coalesce(n_near, 0)::bigint as n_near, case when near_n >= 5 * w.n then near_n end as form_n
  from w left join best on best.word = w.word),
follow(word, top) as (select word, word from f union select follow.word, f.form from follow join f on f.word = follow.top where f.form is not null),
roots as (select follow.word, top as root from follow join f on f.word = follow.top where f.form is null)
select f.word, form, root, n, n_near, form_n from f join roots on roots.word = f.word
"""


def _parts(weights: dict[str, int], column: str) -> str:
    return f"case {' '.join(f'when {column} = {k!r} then {v}' for k, v in weights.items())} else 100 end::bigint"


def _poured(name: str, children: str, parent: str, child: str) -> str:
    """Water-filling of each parent's budget over its children (columns of both, capacity, weight, budget)."""
    by, order = f"partition by {parent}", f"partition by {parent} order by capacity / weight, {child}"
    return f"""
{name}_o as (select *, sum(capacity) over ({order}) - capacity as before, sum(weight) over ({by}) - sum(weight) over ({order}) + weight as open from {children}),
{name}_f as (select *, capacity::decimal(38,0) * open <= (budget - before)::decimal(38,0) * weight as is_full from {name}_o),
{name}_t as (select *, sum(case when is_full then capacity else 0 end) over ({by}) as taken, sum(case when is_full then 0 else weight end) over ({by}) as open_weight from {name}_f),
{name}_s as (select *, case when is_full then 0 else (greatest(0, budget - taken)::hugeint * weight::hugeint) // open_weight::hugeint end as part from {name}_t),
{name}_r as (select *, greatest(0, budget - taken) - sum(part) over ({by}) as odd, row_number() over ({by} order by is_full, {child}) as place from {name}_s),
{name} as (select *, (case when is_full then capacity when place <= odd then part + 1 else part end)::bigint as alloc from {name}_r)"""


def _mixing_sql(domains: dict[str, int], langs: dict[str, int], sources: dict[str, int]) -> str:
    """SQL of the mixing query for any weights of at least 0; leaves below a weight of 0 are left out of the tree."""
    weights = (_parts(domains, "domain"), _parts(langs, "lang"), _parts(sources, "source"))
    return rf"""
with t as (select doc_id, coalesce(case when regexp_full_match(source, 'src[0-9]+') then case when try_cast(source[4:] as int) < 10 then 'web' else 'books' end end, 'unknown') as domain,
    coalesce(lang, 'unknown') as lang, coalesce(source, 'unknown') as source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+'))::bigint as n_tokens, md5(coalesce(text, '')) as h from documents),
r as (select * from t where n_tokens > 0),
every as (select domain, lang, source, sum(n_tokens)::bigint as tokens from r group by all),
leaf as (select * from every where {weights[0]} > 0 and {weights[1]} > 0 and {weights[2]} > 0),
d_in as (select 0 as root, domain, (2 * sum(tokens))::bigint as capacity, {weights[0]} as weight, (select (sum(tokens) * 4 // 5)::bigint from every) as budget from leaf group by domain),
{_poured("d", "d_in", "root", "domain")},
l_in as (select x.domain, x.lang, (2 * sum(tokens))::bigint as capacity, {_parts(langs, "x.lang")} as weight, any_value(d.alloc) as budget from leaf x join d on d.domain = x.domain group by x.domain, x.lang),
{_poured("l", "l_in", "domain", "lang")},
s_in as (select x.domain, x.lang, x.source, tokens, 2 * tokens as capacity, {_parts(sources, "x.source")} as weight, l.alloc as budget from leaf x join l on l.domain = x.domain and l.lang = x.lang),
{_poured("s", "s_in", "domain, lang", "source")},
plan as (select domain, lang, source, tokens, (alloc // tokens)::int as n_full, alloc % tokens as rest from s),
e as (select r.*, n_full, rest, unnest(range(0, n_full + 1)) as epoch from r join plan using (domain, lang, source)),
k as (select *, sum(n_tokens) over (partition by domain, lang, source, epoch order by md5('11:' || epoch || ':' || coalesce(doc_id::varchar, h)), h, doc_id rows unbounded preceding) - n_tokens as before from e)
select doc_id, domain, lang, source, epoch::int as epoch, n_tokens, (case when epoch < n_full then n_tokens else least(n_tokens, rest - before) end)::bigint as taken
from k where epoch < n_full or before < rest
"""


_MIXING = _mixing_sql(DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)
