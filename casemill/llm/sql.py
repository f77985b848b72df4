"""DuckDB SQL that says the same as queries of the llm problems, where SQL can."""

from __future__ import annotations

#: Ties by recursion over shared keys; only for small data, as it follows every row's whole component.
P1_FOUND = r"""
with recursive v as (
  select source_row_id, variant_id, PMID as p,
    nullif(regexp_extract(translate("PMCID", '０１２３４５６７８９', '0123456789'), '(?:^|[^0-9])0*([1-9][0-9]{7})(?:[^0-9]|$)', 1), '') as a
  from clinical_case_mask_filling4),
k as (select distinct source_row_id as s, 'a' || a as key from v where a is not null union select distinct source_row_id, 'p' || p from v where p is not null),
step as (select distinct x.key as a, y.key as b from k x join k y on x.s = y.s),
r(root, key) as (select distinct key, key from k union select r.root, step.b from r join step on r.key = step.a),
best as (select root, min(key) filter (where key like 'a%') as article from r group by root),
named as (select s, min(article) as article from k join best on k.key = best.root group by s)
select distinct v.source_row_id, v.variant_id, 'PMC' || substring(named.article, 2) as article from v left join named on v.source_row_id = named.s
""".strip()

#: What must hold of any right splits.
P1_SPLIT_CHECK = "select count(*) as n, true as near, 0::BIGINT as source_row_id_apart, 0::BIGINT as article_apart from clinical_case_mask_filling4"

ORACLE_SQL: dict[str, str] = {"p1_found": P1_FOUND, "p1_split_check": P1_SPLIT_CHECK}
