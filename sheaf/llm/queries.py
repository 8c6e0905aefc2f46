"""One query per operator of this subpackage, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, exact_dedup, lm_score, mixing, near_dedup, quality, ranked_search, sharding, substring_dedup, toxicity, url_filter, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.default_rules(spark))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw_copies(_table(spark, sf_dir, "documents"))
    return drawn.selectExpr("doc_id", "size", "source_size", "target", "copies * size as taken")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(ranked_search.build_index(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


ALL = (
    op1_lm_score, op2_minhash_dedup, op3_decontamination, op4_url_filter, op5_warc, op6_exact_dedup, op7_substring_dedup,
    op8_quality, op9_sharding, op10_mixing, op11_toxicity, op12_ranked_search, op13_collocations,
)


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_minhash_dedup": r"""
            with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
            g as (select distinct doc_id, array_to_string(w[s:s + k - 1], ' ') as gram from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as s from (select doc_id, w, least(5, len(w)) as k from d where len(w) > 0))),
            n as (select doc_id, count(*) as n from g group by doc_id),
            p as (select x.doc_id as a, y.doc_id as b, count(*) as same from g x join g y on x.gram = y.gram and x.doc_id <> y.doc_id group by 1, 2),
            l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * same >= 85 * (x.n + y.n - same)),
            r as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
            c as (select a, min(b) as low from r group by a)
            select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(low, d.doc_id)) as kept
            from d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id
        """,
        "op3_decontamination": r"""
            with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
            b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
            g as (select distinct item_id, n, array_to_string(w[s:s + n - 1], ' ') as gram
                  from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s from b where len(w) > 0)),
            x as (select doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') as gram
                  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, (select distinct n from g))),
            h as (select doc_id, x.n, s, item_id from x join g on x.gram = g.gram and x.n = g.n),
            p as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + n)) as pos from h) group by doc_id),
            i as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as items from h group by doc_id)
            select d.doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
                   coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) as contaminated
            from d left join p on p.doc_id = d.doc_id left join i on i.doc_id = d.doc_id
        """,
        "op4_url_filter": r"""
            with u as (select page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                              coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
            r(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
            m as (select page_id, max_by(h || p, length(h || p)) as rule, max_by(v, length(h || p)) as v from u join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by page_id)
            select u.page_id, host, path, rule, coalesce(v, 'allow') as verdict from u left join m on m.page_id = u.page_id
        """,
        "op5_warc": """
            with p as (select page_id, coalesce(html, '') as html from pages),
            d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
            g as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by payload_digest)
            select page_id, payload_bytes, d.payload_digest, case when first_id <> page_id then 'revisit' else 'response' end as record_type,
                   case when first_id <> page_id then first_id end as refers_to
            from d left join g on g.payload_digest = d.payload_digest and payload_bytes >= 100
        """,
        "op6_exact_dedup": r"""
            with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
            g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
            select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t.norm) as text_sha256 from t join g on t.norm = g.norm
        """,
        "op7_substring_dedup": """
            with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
            w as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as m from (select doc_id, h, unnest(range(0, length(h) // 2 - 199)) as i from t where length(h) >= 400)),
            r as (select doc_id, i from w where m in (select m from w group by m having count(*) > 1)),
            g as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 200 then 0 else 1 end as fresh from r),
            s as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run from g),
            u as (select doc_id, min(i) as a, max(i) + 200 as b from s group by doc_id, run),
            p as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as f, a as e from u union all select doc_id, max(b), 1000000000000 from u group by doc_id),
            k as (select t.doc_id, string_agg(substr(h, 2 * f + 1, greatest(0, 2 * (least(e, length(h) // 2) - f))), '' order by f) as kept from p join t on t.doc_id = p.doc_id group by t.doc_id),
            n as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from u group by doc_id)
            select t.doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
            from t left join n on n.doc_id = t.doc_id left join k on k.doc_id = t.doc_id
        """,
        "op12_ranked_search": r"""
            with d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
            q as (select item_id, term, count(*) as times
                  from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
            n as (select doc_id, count(*) as n from d group by doc_id),
            c as (select count(*) as docs, cast(sum(n) as bigint) as total from n),
            tf as (select doc_id, term, count(*) as tf from d where term in (select term from q) group by all),
            w as (select term, cast(floor(1000 * ln(cast(2 * docs + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w from tf, c group by term, docs),
            m as (select doc_id, 25 + (75 * n * docs) // total as m from n, c),
            s as (select item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
                  from tf join w using (term) join m using (doc_id) join q using (term) group by item_id, doc_id),
            r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from s where score > 0)
            select item_id, cast(rank as integer) as rank, doc_id, score from r where rank <= 10
        """,
        "op13_collocations": r"""
            with t as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
            p as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from t),
            n as (select lang, cast(sum(len(w)) as bigint) as n from p group by lang),
            g as (select lang, k, array_to_string(w[s:s + k - 1], ' ') as phrase, count(*) as f
                  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as s from p, (values (1), (2), (3), (4), (5)) as x(k) where len(w) >= k) group by all having count(*) >= 100),
            c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from g where k > 1),
            x as (select lang, phrase, w, a, k, unnest(range(1, k)) as cut from c),
            y as (select x.lang, x.phrase, x.a, cut, l.f as l, r.f as r, n, cast(cast(1000 as hugeint) * x.a * n // (cast(l.f as hugeint) * r.f) as bigint) as score
                  from x join n on n.lang = x.lang join g l on l.lang = x.lang and l.phrase = array_to_string(w[1:cut], ' ')
                  join g r on r.lang = x.lang and r.phrase = array_to_string(w[cut + 1:], ' ')),
            b as (select * from y qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
            o as (select distinct c.lang, array_to_string(c.w[s:s + z.k - 1], ' ') as phrase, c.a
                  from c, (values (2), (3), (4)) as z(k), unnest(range(1, 5)) as u(s) where z.k < c.k and s + z.k - 1 <= c.k),
            v as (select distinct b.lang, b.phrase from b join o on o.lang = b.lang and o.phrase = b.phrase where 100 * o.a >= 100 * b.a),
            r as (select lang, phrase, a, l, r, n, score, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from b where (lang, phrase) not in (select lang, phrase from v))
            select lang, cast(rank as integer) as rank, phrase, a, l, r, n, score from r where rank <= 2000
        """,
    }
