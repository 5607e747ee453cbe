"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkfen.llm import conversations, decontaminate, language_id, lexical, licenses, mixing, near_dup, packing, pii, quality, token_counts, token_store, url_filter
from sparkfen.session import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents, spread over the cores where it is one small file."""
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger over all documents."""
    return quality.digest(documents(spark, sf_dir))


#: The rules of the query over pages.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer, from the installed collection."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return pii.digest(documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    return mixing.digest(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    return language_id.digest(documents(spark, sf_dir))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in all documents."""
    return licenses.digest(documents(spark, sf_dir))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through token files and back."""
    return token_store.digest(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents, by two-word shingles."""
    return near_dup.near_duplicates(documents(spark, sf_dir), size=2)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate.digest(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return token_counts.digest(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in training sequences."""
    return packing.digest(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    return conversations.digest(table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for each benchmark item."""
    return lexical.rank_documents(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    made = (op1_quality_rules, op2_url_filter, op3_pii, op4_mixing, op5_language_id, op6_license_scan, op7_token_store, op8_near_dup, op9_decontamination, op10_token_counts, op11_packing, op12_conversation_repair, op13_lexical_search)
    return {f.__name__: f for f in made}


OP1_SQL = r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from t),
g as (select doc_id, text, w, l, case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i+4], 'string_agg', ' ')) else [] end as g from w),
p as (select doc_id, unnest(g) as gram, unnest(range(1, len(g) + 1)) as pos from g),
r as (select doc_id, pos from (select doc_id, pos, count(*) over (partition by doc_id, gram) as n from p) where n > 1),
c as (select doc_id, count(distinct pos + o) as n from r, (select unnest(range(0, 5)) as o) group by doc_id),
m as (select g.doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(l)::bigint as n_lines, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
  coalesce(c.n, 0)::bigint as n_repeat_words, (length(text) - length(replace(text, '!', '')))::bigint as n_marks from g left join c on c.doc_id = g.doc_id),
b as (select *, ((case when n_words < 10 then 1 else 0 end) + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end) + (case when 10 * n_symbols > 5 * n_words then 4 else 0 end)
  + (case when 10 * n_dup_lines > 5 * n_lines then 8 else 0 end) + (case when 10 * n_marks > 5 * n_words then 16 else 0 end) + (case when word_chars < 2 * n_words or word_chars > 20 * n_words then 32 else 0 end))::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits from b
"""



OP2_SQL = r"""
with u as (select page_id, coalesce(regexp_extract(url, '(?s)://([^/?#]*)', 1), '') as h, coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') as path from pages),
l as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
r(verdict, rhost, rpath) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f as (select page_id, rhost || rpath as rule, verdict, row_number() over (partition by page_id order by len(string_split(rhost, '.')) desc, length(rpath) desc, verdict) as k
  from l join r on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select l.page_id, host, path, f.rule, coalesce(f.verdict, 'allow') as verdict from l left join f on f.page_id = l.page_id and f.k = 1
"""

#: Marks of ends and line breaks are doubled, as each of two sentences in a row needs one of its own.
OP6_SQL = r"""
with known(id, s, gapped) as (values __KNOWN__),
t as (select doc_id, '| ' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), '|~', '  '), '[.!?:;]([\x20\x09-\x0D])', ' | \1', 'g'), '\n(?:[^a-z0-9|\n]*\n)+', ' | ', 'g'), '\n', ' ~ ', 'g'), '[^a-z0-9|~]+', ' ', 'g')) || ' |' as t from documents),
x as (select doc_id, regexp_extract_all(regexp_replace(t, '([|~])', '\1 \1', 'g'), '[|~] (__HITS__) [|~]', 1) as x from t),
s as (select doc_id, unnest(x) as hit, unnest(range(1, len(x) + 1)) as pos from x),
m as (select doc_id, pos, id from s join known on regexp_replace(hit, '[ |~]+', ' ', 'g') = s or gapped <> '' and regexp_full_match(regexp_replace(hit, '[ |~]+', ' ', 'g'), gapped)),
g as (select doc_id, count(*)::bigint as n, string_agg(id, ',' order by pos) as ids, list(id order by pos) as l from m group by doc_id),
r(k, license, fits, fails) as (values __RULES__),
h as (select doc_id, license, min(k) as k from g join r on regexp_matches(chr(10) || array_to_string(l, chr(10)) || chr(10), fits) and not regexp_matches(chr(10) || array_to_string(l, chr(10)) || chr(10), fails) group by doc_id, license),
j as (select doc_id, string_agg(license, ',' order by k) as licenses from h group by doc_id)
select d.doc_id, coalesce(g.n, 0)::bigint as n_license_sentences, coalesce(g.ids, '') as sentence_ids, coalesce(j.licenses, '') as licenses, j.licenses is not null as licensed
from documents d left join g on g.doc_id = d.doc_id left join j on j.doc_id = d.doc_id
"""

OP8_SQL = r"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from t),
n as (select doc_id, count(*)::bigint as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as both_n from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * both_n >= 80 * (x.n + y.n - both_n)),
u as (select a as src, b as dst from e union select b, a from e),
r(doc_id, root) as (select doc_id, doc_id from t union select u.dst, r.root from r join u on u.src = r.doc_id),
k as (select doc_id, min(root) as component_id from r group by doc_id)
select t.doc_id, coalesce(n.n, 0)::bigint as n_shingles, k.component_id, t.doc_id = k.component_id as kept from t left join n using (doc_id) join k using (doc_id)
"""

OP9_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from benchmark),
i as (select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda k: array_to_string(w[k:k + 9], ' '))) as g from b where len(w) > 0),
x as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as pos, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) as g from d, (select distinct n from i) where len(w) >= n),
m as (select distinct doc_id, x.n, pos, item_id from x join i on i.n = x.n and i.g = x.g),
h as (select doc_id, count(distinct p)::bigint as n_hit from (select doc_id, unnest(range(pos, pos + n)) as p from m) group by doc_id),
q as (select doc_id, count(distinct item_id)::bigint as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from m group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join q using (doc_id)
"""

OP13_SQL = r"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from documents),
g as (select count(*)::bigint as n_all, sum(len(w))::bigint as l_all from d where len(w) > 0),
i as (select row_number() over () as q, item_id, text from (select distinct item_id, text from benchmark where text is not null)),
t as (select distinct q, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) as term from i),
p as (select k, doc_id, n, term, count(*)::bigint as tf from (select k, doc_id, len(w)::bigint as n, unnest(w) as term from d) where term in (select term from t) group by all),
f as (select term, floor(1000 * ln((2 * n_all + 2)::double / (2 * df + 1)::double))::bigint as w from (select term, count(*)::bigint as df from p group by term), g),
s as (select q, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_all) // l_all))))::bigint as score from t join p using (term) join f using (term), g group by all),
r as (select q, doc_id, score, row_number() over (partition by q order by score desc, doc_id nulls first)::int as rank from s where score > 0)
select item_id, rank, doc_id, score from r join i using (q) where rank <= 50
"""


def _op6_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    every = licenses.SENTENCES | licenses.REAL_SENTENCES
    known = ", ".join(f"({quote(k)}, {quote(licenses.plain(v))}, {quote(licenses.pattern(v) if licenses.GAP.search(v) else '')})" for k, v in every.items())
    hits = "|".join(licenses.pattern(v, " ~ ~", " [|~] [|~]") for v in sorted(every.values(), key=len, reverse=True))
    row = lambda ids: r"\n" + r"\n(?:[^\n]*\n)*".join(s.replace(".", r"\.") for s in ids) + r"\n"
    fails = lambda ids: "|".join(row((i,)) for i in ids) or r"\n\n\n"
    rules = ", ".join(f"({k}, {quote(r.license)}, {quote(row(r.sentences))}, {quote(fails(r.unless))})" for k, r in enumerate(licenses.RULES + licenses.REAL_RULES))
    return OP6_SQL.replace("__KNOWN__", known).replace("__HITS__", hits).replace("__RULES__", rules)


def oracle_sql() -> dict[str, str]:
    """The SQL of those that have it."""
    return {"op1_quality_rules": OP1_SQL, "op2_url_filter": OP2_SQL, "op6_license_scan": _op6_sql(), "op8_near_dup": OP8_SQL, "op9_decontamination": OP9_SQL, "op13_lexical_search": OP13_SQL}
