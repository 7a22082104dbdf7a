"""Queries over the corpus tables, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from . import bpe, decontaminate, kneser_ney, pii, secrets, simhash, suffix_dedup, topk, toxicity, warc
from .common import table


def op1_quality(spark, sf_dir):
    return kneser_ney.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality": op1_quality,
    "op2_secret_scan": op2_secret_scan,
    "op3_warc": op3_warc,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_personal_data": op5_personal_data,
    "op6_decontamination": op6_decontamination,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
}


def _secret_sql() -> str:
    def matches(kind):
        p = secrets.PATTERNS[kind].replace("'", "''")
        keep = {"assign": f" and length(regexp_replace(hit, '^{secrets.ASSIGN.replace(chr(39), chr(39) * 2)}', '')) >= 6", "secret": " and regexp_matches(hit, '[a-z]') and regexp_matches(hit, '[A-Z]') and regexp_matches(hit, '[0-9]')"}.get(kind, "")
        whole = f"(?s)(.*?)({p}|\\z)"
        return f"""select r, start, start + length(hit) as "end", {secrets.KINDS.index(kind)} as kind from (
            select r, hit, (sum(length(gap) + length(hit)) over (partition by r order by i)) - length(hit) as start from (
              select r, unnest(regexp_extract_all(text, '{whole}', 1)) as gap, unnest(regexp_extract_all(text, '{whole}', 2)) as hit,
                     generate_subscripts(regexp_extract_all(text, '{whole}', 1), 1) as i from t))
          where length(hit) > 0{keep}"""

    names = "['" + "','".join(secrets.KINDS) + "']"
    one = f"{names}[kind + 1] || ':' || start || ':' || \"end\""
    near = lambda what, cond: f"""(coalesce(start - max(case when {cond} then "end" end) over before <= {secrets.SCOPE}, false) or coalesce(min(case when {cond} then start end) over after - "end" <= {secrets.SCOPE}, false)) as {what}"""
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
parts as ({" union all ".join(matches(k) for k in secrets.KINDS)}),
swept as (select *, {near("by_secret", "kind in (0, 2, 4)")}, {near("by_other", "kind not in (0, 2, 4)")},
    coalesce(max(case when kind < 3 then "end" end) over before <= start, true) and coalesce(min(case when kind < 3 then start end) over after >= "end", true) as apart
  from parts window before as (partition by r order by start, kind, "end" rows between unbounded preceding and 1 preceding),
                    after as (partition by r order by start, kind, "end" rows between 1 following and unbounded following)),
kept as (select * from swept where kind < 3 or apart and case when kind = 4 then by_other else by_secret end),
sums as (select r, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as c,
    string_agg({one}, ',' order by start, kind) filter (kind < 3) as base, string_agg({one}, ',' order by start, kind) as spans from kept group by r)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from t left join sums using (r)"""


def _decontamination_sql() -> str:
    from .decontaminate import MASKS, MATCH, SHORT, SHORT_MASKS, WINDOW

    masks = [(m, "") for m in MASKS] + [(m, f"n in {SHORT} and ") for m in SHORT_MASKS]
    seeded = " or ".join(f"({only}j + {len(m)} <= n and p + {len(m)} <= dn and " + " and ".join(f"list_contains(js, j + {o})" for o, c in enumerate(m) if c == "1") + ")" for m, only in masks)
    words = lambda t: f"regexp_extract_all(lower(coalesce({t}, '')), '[\\p{{L}}\\p{{N}}]+')"
    return f"""
with d as (select row_number() over () as r, doc_id, {words("text")} as w from documents),
b as (select distinct coalesce(cast(item_id as varchar), '') as item, {words("text")} as w from benchmark),
dw as (select r, len(w) as dn, unnest(w) as word, generate_subscripts(w, 1) - 1 as p from d),
bw as (select item, len(w) as n, unnest(w) as word, generate_subscripts(w, 1) - 1 as j from b),
same as (select r, item, n, dn, p - j as diagonal, list(j order by j) as js from dw join bw using (word) group by all
         having count(*) >= ceil({MATCH} * least(n, {WINDOW}))),
hit as (select * from same where list_bool_or(list_transform(js, lambda j: {seeded.replace("p +", "j + diagonal +")}))),
best as (select r, item, least(n, {WINDOW}) as width,
           list_max(list_transform(range(0, cast(n - least(n, {WINDOW}) + 1 as bigint)), lambda s: len(list_filter(js, lambda j: j >= s and j < s + least(n, {WINDOW}))))) as matched from hit),
found as (select r, count(distinct item) as n, max(matched) as most from best where matched >= ceil({MATCH} * width) group by r)
select doc_id, cast(n is not null as integer) as contaminated, coalesce(n, 0) as n_items, cast(coalesce(most, 0) as integer) as most_matched from d left join found using (r)"""


_TOP_K_SQL = """
with v as (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as hugeint)) as x from embeddings
  where vec_id is not null and embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
p as (select q.r, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) as score
      from v q join v c on q.r <> c.r and len(q.x) = len(c.x) where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by r order by score desc, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, cast(score as bigint) as score from r where rank <= 5"""

_WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
h as (select page_id, octet_length(payload) as payload_bytes, sha256(payload) as payload_digest from p),
m as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end as first_id from h)
select page_id, payload_bytes, payload_digest, case when page_id > first_id then 'revisit' else 'response' end as record_type,
  case when page_id > first_id then first_id end as refers_to from m"""

ORACLES = {
    "op2_secret_scan": _secret_sql(),
    "op3_warc": _WARC_SQL,
    "op6_decontamination": _decontamination_sql(),
    "op7_exact_top_k": _TOP_K_SQL,
}
