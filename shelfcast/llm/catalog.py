"""The operators as queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .audit import filter_audit
from .bpe import bpe_digest
from .exact_dedup import dedup_digest
from .hosts import url_digest
from .jaccard import join_digest
from .katz import katz_digest
from .packing import packing_digest
from .quality import quality_digest
from .repair import shard_round_trip
from .secrets import secrets_digest
from .tables import read
from .toxicity import toxicity_digest
from .variants import spelling_groups
from .warc import archive_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(read(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(read(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_digest(read(spark, sf_dir, "documents"))


def op4_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_digest(read(spark, sf_dir, "documents"))


def op5_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(read(spark, sf_dir, "documents"))


def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_digest(read(spark, sf_dir, "documents"))


def op8_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_round_trip(read(spark, sf_dir, "documents"))


def op9_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(read(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(read(spark, sf_dir, "documents"))


def op13_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_digest(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_warc_dictionary, op2_byte_bpe, op3_best_fit_packing, op4_katz_backoff, op5_quality_forest, op6_content_sort_dedup, op7_chosen_path_join, op8_repair_shards, op9_toxicity_ftrl, op10_secret_scan,
    op11_filter_audit, op12_spelling_variants, op13_host_reputation)}
SQL: dict[str, str] = {
    "op1_warc_dictionary": """
        with p as (select page_id, coalesce(html, '') as html from pages),
             g as (select *, octet_length(encode(html)) as n, min(page_id) over (partition by html) as first_id,
                          count(*) over (partition by html) as copies from p),
             t as (select *, n >= 100 and copies > 1 and first_id is not null and first_id is distinct from page_id as again from g)
        select page_id, n as payload_bytes, sha256(html) as payload_digest,
               case when again then 'revisit' else 'response' end as record_type,
               case when again then first_id end as refers_to
        from t""",
    "op6_content_sort_dedup": r"""
        with t as (select doc_id, coalesce(text, '') as text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents)
        select doc_id, first_value(doc_id) over (partition by norm order by length(text) desc, doc_id nulls last
                                                 rows between unbounded preceding and unbounded following) as keep_id,
               count(*) over (partition by norm) as group_size,
               doc_id is not distinct from first_value(doc_id) over (partition by norm order by length(text) desc, doc_id nulls last
                                                 rows between unbounded preceding and unbounded following) as kept,
               sha256(norm) as text_sha256
        from t""",
    "op11_filter_audit": r"""
        with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
             w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first_id from t),
             f as (select doc_id, part, len(words) < 200 as a, 100 * len(list_distinct(words)) < 50 * len(words) as b,
                          100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text) as c, regexp_matches(text, '[#$%&*|]') as d,
                          first_id is not null and (doc_id is null or first_id < doc_id) as e from w),
             l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
             r as (select part, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end)
                          || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) as fails, count(*) as n,
                          coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by 1, 2),
             x as (select unnest(['A', 'B', 'C', 'D', 'E']) as v),
             o as (select p1.v || p2.v || p3.v || p4.v || p5.v as filter_order from x p1, x p2, x p3, x p4, x p5
                   where len(list_distinct([p1.v, p2.v, p3.v, p4.v, p5.v])) = 5),
             g as (select part, n, good, toxic, fails, filter_order, step, substr(filter_order, step, 1) as letter,
                          least(case when contains(fails, 'A') then instr(filter_order, 'A') else 6 end, case when contains(fails, 'B') then instr(filter_order, 'B') else 6 end,
                                case when contains(fails, 'C') then instr(filter_order, 'C') else 6 end, case when contains(fails, 'D') then instr(filter_order, 'D') else 6 end,
                                case when contains(fails, 'E') then instr(filter_order, 'E') else 6 end) as gone
                   from r, o, (select unnest([1, 2, 3, 4, 5])::int as step)),
             z as (select part, filter_order, step, letter, coalesce(sum(n) filter (gone > step), 0) as kept, coalesce(sum(n) filter (gone = step), 0) as removed,
                          coalesce(sum(n) filter (contains(fails, letter) and gone < step), 0) as redundant, coalesce(sum(n) filter (fails = letter), 0) as unique_fails,
                          coalesce(sum(good) filter (gone = step), 0) as good_lost, coalesce(sum(toxic) filter (gone = step), 0) as toxic_lost
                   from g group by 1, 2, 3, 4)
        select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
               good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley
        from z""",
    "op13_host_reputation": r"""
        with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
             h as (select page_id, regexp_extract(rest, '^[^/?#]*') as raw, rest from u),
             p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                          regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') as path from h),
             d as (select *, try_cast(nullif(regexp_extract(path, '/([0-9]{1,18})(\.[a-z]+)?/?\z', 1), '') as bigint) as document,
                          regexp_replace(regexp_replace(regexp_replace(host, '^[^@]*@', ''), '(:[0-9]*)?\z', ''), '\.\z', '') as name from p),
             l as (select doc_id as document, max(case when toxic = 1 or quality = 0 then 1 else 0 end) as bad from labels where doc_id is not null group by 1),
             c as (select host, any_value(name) as name, count(bad) as n, coalesce(sum(bad), 0) as x from d left join l using (document) group by host),
             s as (select *, string_split(name, '.') as parts, regexp_matches(name, '^[0-9]+(\.[0-9]+){3}\z') as ip from c),
             two as (select *, array_to_string(parts[-2:], '.') as last_two from s),
             hosts as (select host, n::double as n, x::double as x, last_two in ('co.uk', 'org.uk', 'ac.uk', 'com.au', 'co.jp', 'com.br', 'co.nz', 'co.in') as long,
                              case when ip then name when long then array_to_string(parts[-3:], '.') else last_two end as domain,
                              case when ip then '' when long then last_two else parts[-1] end as suffix from two),
             domains as (select suffix, domain, sum(n) as n, sum(x) as x from hosts group by all),
             suffixes as (select suffix, sum(n) as n, sum(x) as x from domains group by all),
             corpus as (select (coalesce(sum(x), 0) + 0.5) / (coalesce(sum(n), 0) + 1) as m from suffixes),
             members as (select 0 as level, '' as g, n, x from suffixes union all select 1, suffix, n, x from domains union all select 2, domain || ' ' || suffix, n, x from hosts),
             sums as (select level, sum(n) as al, sum(x) / sum(n) as r, sum(x) as ax, count(*) as k, sum(x * x / n) as sq, sum(n * n) as n2 from members where n > 0 group by level, g),
             rho as (select level, sum(sq - ax * r - r * (1 - r) * (k - 1)) as above, sum(r * (1 - r) * (al - n2 / al - k + 1)) as per from sums group by level),
             w as (select lv as level, case when per is null or per <= 0 then 20.0 when above <= 0 then 10000.0
                                            else least(greatest(per / above - 1, 1.0), 10000.0) end as w
                   from (select unnest([0, 1, 2]) as lv) left join rho on lv = level),
             bs as (select suffix, (x + w * m) / (n + w) as ms from suffixes, corpus, w where level = 0),
             bd as (select suffix, domain, (x + w * ms) / (n + w) as md from domains join bs using (suffix), w where level = 1),
             ab as (select host, x + w * md as a, n - x + w * (1 - md) as b from hosts join bd using (suffix, domain), w where level = 2),
             y as (select *, a + 6 as ya, b + 6 as yb from ab),
             logit as (select host,
                 (ln(ya) - 1 / (2 * ya) - 1 / (12 * ya ^ 2) + 1 / (120 * ya ^ 4) - list_sum([1 / (a + i) for i in range(0, 6)]))
                 - (ln(yb) - 1 / (2 * yb) - 1 / (12 * yb ^ 2) + 1 / (120 * yb ^ 4) - list_sum([1 / (b + i) for i in range(0, 6)])) as mean,
                 (1 / ya + 1 / (2 * ya ^ 2) + 1 / (6 * ya ^ 3) - 1 / (30 * ya ^ 5) + list_sum([1 / (a + i) ^ 2 for i in range(0, 6)]))
                 + (1 / yb + 1 / (2 * yb ^ 2) + 1 / (6 * yb ^ 3) - 1 / (30 * yb ^ 5) + list_sum([1 / (b + i) ^ 2 for i in range(0, 6)])) as var from y),
             blocked as (select host, 1 / (1 + exp(-(mean - 1.645 * sqrt(var)))) > 0.5 as blocked from logit),
             rules as (select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                             ('block', 'net', '/es/'), ('block', 'net', '/fr/')) as t(act, rh, rp)),
             hp as (select distinct host, path from p),
             fit as (select host, path, arg_max(rh || rp, length(rh || rp)) as rule, arg_max(act, length(rh || rp)) as act
                     from hp join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by host, path)
        select page_id, p.host, p.path, rule, coalesce(act, case when blocked then 'block' else 'allow' end) as verdict
        from p left join fit on p.host = fit.host and p.path = fit.path join blocked on blocked.host = p.host""",
}
