"""The operators of this package as queries over whole tables of one folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    alignment,
    fingerprints,
    impact_search,
    language_id,
    licenses,
    mixing,
    near_dedup,
    packing,
    pii,
    revisits,
    secrets,
    spelling,
    toxicity,
)
from .tables import remainder, table

PII_KEY = "surrogates-1"


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    return secrets.scan(table(spark, root, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, root: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, root, "documents"), words=2, percent=80)


def op3_warc_revisits(spark: SparkSession, root: str) -> DataFrame:
    found = revisits.resolve(captures_of(table(spark, root, "pages")))
    fields = ("etag", "date", "cache-control", "content-type", "content-length")
    named = [F.element_at("headers", f).alias(f.replace("-", "_")) for f in fields]
    return found.select("*", *named).drop("headers")


def captures_of(pages: DataFrame) -> DataFrame:
    """Every page as a full response and as one revisit, about as many steps later as page_id says.

    Some revisits come before their response, lack a tag, or have another one.
    """
    tag, nth = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"')), F.col("page_id")
    later = nth + nth % 7 - 2
    other = F.when(nth % 11 == 3, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))

    def headers(**fields: Column) -> Column:
        pairs = [x for k, v in fields.items() for x in (F.lit(k.replace("_", "-")), v.cast("string"))]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())

    first = F.struct(
        (nth * 2).alias("record_id"),
        nth.alias("captured_at"),
        F.lit("response").alias("kind"),
        headers(
            etag=tag,
            date=nth,
            cache_control=F.lit("max-age=60"),
            content_type=F.lit("text/html"),
            content_length=F.length("html"),
        ).alias("headers"),
    )
    again = F.struct(
        (nth * 2 + 1).alias("record_id"),
        later.alias("captured_at"),
        F.lit("revisit").alias("kind"),
        headers(
            etag=F.when(nth % 5 != 0, other),
            date=later,
            cache_control=F.lit("max-age=120"),
            content_length=F.lit(0),
        ).alias("headers"),
    )
    return pages.select("url", F.explode(F.array(first, again)).alias("one")).select("url", "one.*")


def op4_impact_topk(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "embeddings")
    vectors = rows.select("vec_id", impact_search.whole("embedding").alias("vector"))
    asked = vectors.filter(F.col("vec_id") % 100 == 0)
    return impact_search.search(impact_search.build(vectors), asked, k=10)


def op5_pii_surrogates(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    return pii.with_surrogates(docs, PII_KEY)


def op6_toxicity(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, root, "labels").select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.fit(docs.filter(~held_out), labels)
    return toxicity.score(docs.withColumn("held_out", held_out), model).drop("text")


def op7_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.packed(table(spark, root, "documents"), tokenizer_file(), with_ids=False)


def op8_language_id(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    model = language_id.fit(docs.filter(~held_out))
    asked = docs.select("doc_id", "text", held_out.alias("held_out"))
    return language_id.predict(asked, model).drop("text", "bits_per_byte")


def op9_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    return fingerprints.with_edits(table(spark, root, "documents"))


def op10_weighted_fair_mix(spark: SparkSession, root: str) -> DataFrame:
    return mixing.mixed(table(spark, root, "documents")).drop("source")


def op11_cross_tokenizer_alignment(spark: SparkSession, root: str) -> DataFrame:
    files = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")
    return alignment.align_texts(table(spark, root, "documents"), *files)


def op12_license_scan(spark: SparkSession, root: str) -> DataFrame:
    return licenses.scan(table(spark, root, "documents"))


def op13_spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, root, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_minhash_near_dedup,
        op3_warc_revisits,
        op4_impact_topk,
        op5_pii_surrogates,
        op6_toxicity,
        op7_packing,
        op8_language_id,
        op9_fingerprints,
        op10_weighted_fair_mix,
        op11_cross_tokenizer_alignment,
        op12_license_scan,
        op13_spelling_variants,
    )
}

_URL = r"regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"



def _values(rows: list[tuple]) -> str:
    return "values " + ", ".join(
        "(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in row) + ")"
        for row in rows
    )


def _license_sql(templates: list[licenses.Template]) -> str:
    """The scan over tables of words, postings and key phrases."""
    every = [*enumerate(templates)]
    kinds = [(k, t.label, t.base, t.slack, len(t.words), len(t.keys)) for k, t in every]
    postings = [(k, i, w) for k, t in every for i, w in enumerate(t.words)]
    keys = [
        (k, p, at + j, w, len(phrase))
        for k, t in every
        for p, (at, phrase) in enumerate(t.keys)
        for j, w in enumerate(phrase)
    ]
    return rf"""
        with kinds(tid, label, base, slack, n, phrases) as ({_values(kinds)}),
        postings(tid, i, word) as ({_values(postings)}),
        keys(tid, phrase, i, word, n) as ({_values(keys)}),
        docs as materialized (
            select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
                lambda w: w <> '') as words
            from documents
        ),
        places as (
            select rid, unnest(words) as word, generate_subscripts(words, 1) - 1 as i from docs
        ),
        present as (
            select distinct rid, word from places where word in (select word from postings)
        ),
        frequency as (select word, count(*) as n from present group by word),
        needed as (select tid, word, count(*) over (partition by tid) as n
            from (select distinct tid, word from keys)),
        alive as (
            select rid, tid from needed join present using (word)
            group by rid, tid having count(*) = any_value(n)
        ),
        anchors as (
            select rid, tid, word from (
                select rid, tid, word,
                    row_number() over (partition by rid, tid order by f.n, word) as nth
                from alive join (select distinct tid, word from postings) using (tid)
                join present using (rid, word) join frequency f using (word)
            ) where nth <= {licenses.ANCHORS}
        ),
        votes as (
            select distinct a.rid, a.tid, a.word, p.i - t.i as pos
            from anchors a join places p using (rid, word)
            join postings t on t.tid = a.tid and t.word = a.word
        ),
        candidates as (
            select rid, tid, pos from votes group by all having count(*) >= {licenses.AGREEING}
        ),
        shifts as (select tid, unnest(range(-slack, slack + 1)) as d from kinds),
        stand as (
            select c.rid, c.tid, c.pos, k.phrase, s.d
            from candidates c join keys k using (tid) join shifts s using (tid)
            join places p on p.rid = c.rid and p.i = c.pos + s.d + k.i and p.word = k.word
            group by all having count(*) = any_value(k.n)
        ),
        found as (
            select rid, tid, pos from stand join kinds using (tid) group by all
            having count(distinct phrase) = any_value(phrases)
        ),
        shares as (
            select f.rid, f.tid, f.pos, count(p.i) as there
            from found f join postings t using (tid)
            left join places p on p.rid = f.rid and p.i = f.pos + t.i and p.word = t.word
            group by all
        ),
        result as (
            select rid,
                count(*) filter (base) as n_base,
                min(pos) filter (base) as first_word,
                max(pos) filter (base) as last_word,
                array_to_string(list_sort(list_distinct(list(label) filter (base))), ',') as base_labels,
                array_to_string(list_sort(list_distinct(list(label))), ',') as labels,
                max(there / (n::double * case when base then 2 else 1 end)) as score
            from shares join kinds using (tid) group by rid
        )
        select doc_id, len(words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base,
            first_word::bigint as first_word, last_word::bigint as last_word,
            coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
            coalesce(score, 0)::double as score
        from docs left join result using (rid)
    """


SQL: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
        with recursive docs as materialized (
            select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') as words
            from documents
        ),
        shingles as materialized (
            select distinct rid, doc_id, unnest(case when len(words) < 2 then words
                else list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])
                end) as shingle
            from docs
        ),
        sizes as (select rid, any_value(doc_id) as doc_id, count(*) as n from shingles group by rid),
        pairs as (
            select a.rid as a, b.rid as b, count(*) as shared
            from shingles a join shingles b using (shingle) where a.rid < b.rid group by all
        ),
        links as materialized (
            select x.doc_id as a, y.doc_id as b
            from pairs p join sizes x on p.a = x.rid join sizes y on p.b = y.rid
            where 100 * shared >= 80 * (x.n + y.n - shared) and x.doc_id <> y.doc_id
        ),
        reach as (
            select a, b from (select a, b from links union all select b, a from links)
            union
            select r.a, l.b from reach r join (select a, b from links union all select b, a from links) l
                on r.b = l.a
        ),
        least as (select a, min(b) as b from reach group by a)
        select d.doc_id, coalesce(n, 0) as n_shingles,
            case when d.doc_id is not null then least(d.doc_id, coalesce(l.b, d.doc_id)) end as component_id,
            coalesce(d.doc_id <= coalesce(l.b, d.doc_id), true) as kept
        from docs d left join sizes s using (rid) left join least l on d.doc_id = l.a
    """,
    "op3_warc_revisits": rf"""
        with plain as (select *, {_URL} as u from pages),
        parts as (
            select *,
                regexp_replace(regexp_replace(lower(regexp_extract(u, '^([^/?]*)', 1)),
                    '^www\.', ''), ':(80|443)$', '')
                || regexp_replace(regexp_extract(u, '^[^/?]*([^?]*)', 1), '/+$', '') as place,
                array_to_string(list_sort(list_filter(
                    string_split(regexp_extract(u, '\?(.*)$', 1), '&'),
                    lambda p: p <> '' and not regexp_matches(p, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')
                )), '&') as query
            from plain
        ),
        keyed as (
            select page_id, html,
                place || case when query = '' then '' else '?' || query end as url_key
            from parts
        ),
        captures as (
            select page_id * 2 as record_id, url_key, page_id as captured_at, 'response' as kind,
                '"' || md5(html) || '"' as etag, page_id::varchar as date,
                'max-age=60' as cache_control, 'text/html' as content_type,
                length(html)::varchar as content_length
            from keyed
            union all
            select page_id * 2 + 1, url_key, page_id + page_id % 7 - 2, 'revisit',
                case when page_id % 5 = 0 then null when page_id % 11 = 3 then '"changed"'
                    else 'W/"' || md5(html) || '"' end,
                (page_id + page_id % 7 - 2)::varchar, 'max-age=120', null, '0'
            from keyed
        ),
        stored as (
            select *, last_value(case when kind = 'response' then struct_pack(
                    record_id := record_id, etag := etag, content_type := content_type,
                    content_length := content_length) end ignore nulls)
                over (partition by url_key order by captured_at, record_id
                    rows between unbounded preceding and 1 preceding) as s
            from captures
        ),
        judged as (
            select *, case when kind = 'response' then 'response'
                when url_key is null or s is null then 'orphan'
                when etag is null or s.etag is null then 'unvalidated'
                when regexp_replace(etag, '^W/', '') = s.etag then 'resolved'
                else 'mismatch' end as state
            from stored
        )
        select record_id, url_key, captured_at, kind, state,
            case when state = 'resolved' then s.record_id end as refers_to,
            etag, date, cache_control,
            case when state = 'resolved' then s.content_type else content_type end as content_type,
            case when state = 'resolved' then s.content_length else content_length end
                as content_length
        from judged
    """,
    "op4_impact_topk": """
        with whole as materialized (
            select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as v
            from embeddings
            where embedding is not null
                and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ),
        scored as (
            select q.row, q.vec_id as query_id, w.vec_id,
                list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * w.v[i]))::bigint
                    as score
            from whole q join whole w on q.vec_id <> w.vec_id
            where q.vec_id % 100 = 0
        ),
        ranked as (
            select *, row_number() over (partition by row order by score desc, vec_id)::int
                as rank
            from scored
        )
        select query_id, rank, vec_id, score from ranked where rank <= 10
    """,
    "op12_license_scan": _license_sql(licenses.TEMPLATES),
    "op13_spelling_variants": """
        with recursive crc as (
            select list(case when false then 0 else c end order by i) as t from (
                select i, list_reduce(list_prepend(i, range(8)), lambda c, k:
                    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
                from (select unnest(range(256)) as i)
            )
        ),
        runs as (
            select doc_id, run, count(*) as times from (
                select doc_id, unnest(regexp_extract_all(translate(text,
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[a-zÀ-ÿ]+')) as run
                from documents
            ) group by all
        ),
        coded as (
            select run, times, flatten(list_transform(
                string_split(coalesce(doc_id::varchar, '') || ':' || run, ''),
                lambda x: case when unicode(x) < 128 then [unicode(x)::bigint]
                    else [(192 | (unicode(x) >> 6))::bigint, (128 | (unicode(x) & 63))::bigint] end
            )) as bytes
            from runs
        ),
        hashed as (
            select run, times, xor(4294967295, list_reduce(list_prepend(4294967295, bytes),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h
            from coded, crc
        ),
        dealt as (
            select times, case when h % 97 = 0
                then substring(run, 1, (h % length(run))::bigint)
                    || substring(run, (h % length(run))::bigint + 2)
                else run end as word
            from hashed
        ),
        words as (
            select word, sum(times)::bigint as n from dealt
            where length(word) >= 5 group by word having sum(times) >= 3
        ),
        places as (select word, n, unnest(range(1, length(word) + 1)) as i from words),
        holes as (
            select word, n, substring(word, 1, i - 1) || '_' || substring(word, i + 1) as hole
            from places
        ),
        shorter as (
            select distinct word, n, substring(word, 1, i - 1) || substring(word, i + 1) as other
            from places
        ),
        less as (select s.word, s.n, other, w.n as other_n from shorter s join words w on other = w.word),
        near as (
            select a.word, a.n, b.word as other, b.n as other_n
            from holes a join holes b on a.hole = b.hole and a.word <> b.word
            union all select * from less
            union all select other, other_n, word, n from less
        ),
        best as (
            select *, count(*) over (partition by word) as n_near,
                row_number() over (partition by word order by other_n desc, other) as nth
            from near
        ),
        formed as (
            select w.word, w.n, coalesce(n_near, 0)::bigint as n_near,
                case when other_n >= 2 * w.n then other end as form,
                case when other_n >= 2 * w.n then other_n end as form_n
            from words w left join (from best where nth = 1) b on w.word = b.word
        ),
        path as (
            select word, word as at from formed
            union all select p.word, f.form from path p join formed f on p.at = f.word
            where f.form is not null
        )
        select f.word, f.form, p.at as root, f.n, f.n_near, f.form_n
        from formed f join path p on f.word = p.word
        join formed e on p.at = e.word and e.form is null
    """,
}
