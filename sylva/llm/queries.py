"""One query per operator, over whole tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sylva.llm import bpe, chat, html_text, media, mixing, ngram_join, quality, token_count, toxicity, url_filter
from sylva.llm.common import table

RULES = [
    url_filter.Rule("block", "com", "/en/"), url_filter.Rule("allow", "example.com", "/en/7"), url_filter.Rule("allow", "net", "/de/"),
    url_filter.Rule("block", "example.net", "/de/8"), url_filter.Rule("block", "org", "/es/"),
]
#: The blocklist: registered names of spam hosts under the corpus's three domains.
LISTED = [f"{name}.example.{tld}" for name in ("cheap-pills", "casino-win", "ads-track", "free-bets", "adult-x", "spam-farm") for tld in ("com", "net", "org")]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(x,) for x in LISTED], "key string")
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), listed, RULES)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.NgramJoin().fit(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.conversation_digests(rows)


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents")).drop("failed")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken, info = mixing.mix(table(spark, sf_dir, "documents"), F.array("source"))
    info = info.withColumnRenamed("source", "name")  # as many rows as sources, bounded by the planner
    out = taken.join(F.broadcast(info), F.element_at("members", 1).eqNullSafe(F.col("name")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_ngram_join, op3_token_counts, op4_media, op5_chat, op6_html_text, op7_bpe, op8_toxicity, op9_quality, op10_mixing, pipeline)}

_LISTED = ", ".join(f"'{x}'" for x in LISTED)

ORACLE_SQL = {
    "op1_url_filter": f"""
        with g as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
        u as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from g),
        h as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from u),
        l as (select unnest([{_LISTED}]) as name),
        x as (select h.*, exists (select 1 from l where h.host = l.name or ends_with(h.host, '.' || l.name)) as listed,
                     '.' || host as dotted from h),
        r as (select *, case when ends_with(dotted, '.example.com') and starts_with(path, '/en/7') then 'example.com/en/7'
                             when ends_with(dotted, '.example.net') and starts_with(path, '/de/8') then 'example.net/de/8'
                             when ends_with(dotted, '.com') and starts_with(path, '/en/') then 'com/en/'
                             when ends_with(dotted, '.net') and starts_with(path, '/de/') then 'net/de/'
                             when ends_with(dotted, '.org') and starts_with(path, '/es/') then 'org/es/' end as rule from x)
        select page_id, host, path, rule,
               case when rule in ('com/en/', 'example.net/de/8', 'org/es/') then 'block' when rule is not null then 'allow'
                    when listed then 'block' else 'allow' end as verdict, listed from r""",
    "op2_ngram_join": r"""
        with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
        s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [hash(w)] else list_transform(range(1, len(w) - 3), lambda i: hash(w[i:i + 4])) end) as s from d),
        n as (select doc_id, count(*) as n from s group by 1),
        p as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
        e as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 80 * (a.n + b.n - shared)),
        r(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, e.y from r join e on r.other = e.x)
        select doc_id, coalesce(n, 0) as n_shingles, least_id as component_id
        from (select doc_id, min(other) as least_id from r group by 1) left join n using (doc_id)""",
    "op9_quality": r"""
        with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
        n as (select *, row_number() over () as k from d),
        g as (select k, unnest(range(1, len(w) - 1)) as i, w from n where len(w) >= 3),
        t as (select k, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from g),
        rep as (select k, i from (select k, i, count(*) over (partition by k, a, b, c) as m from t) where m > 1),
        cov as (select k, count(distinct i + j) as n_repeat_words from rep, (select unnest([0, 1, 2]) as j) group by k),
        f as (select n.k, doc_id, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
                     (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
                     length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) as n_upper, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
              from n left join cov using (k)),
        v as (select *, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               not (base_failed or 100 * n_symbols > 20 * n_words or 100 * n_dup_lines > 40 * len(lines) or 100 * n_upper > 40 * word_chars
                    or word_chars < 2 * n_words or word_chars > 20 * n_words) as kept from v""",
}
