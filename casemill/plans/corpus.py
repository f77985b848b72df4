"""Queries of the general corpus problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casemill.operators.nested import MASK_NEST, flatten_nested, nested_keys, repeated_paths
from casemill.operators.packed import explode_packed
from casemill.sources.tables import table

MASKED = "clinical_case_mask_trial3"


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value packed into ``masked_tokens`` and ``mask_types`` with its slot."""
    return explode_packed(table(spark, folder, MASKED), "source_row_id", ("masked_tokens", "mask_types"), "masked_token_count")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """The keys of all masks, candidates and rejection reasons nested in ``mask_metadata``."""
    return nested_keys(table(spark, folder, MASKED), "source_row_id", "mask_metadata")


def p5_masks(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of masks."""
    return flatten_nested(table(spark, folder, MASKED), ["source_row_id", "masked_at"], "mask_metadata", MASK_NEST)["mask"]


def p5_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of candidates, each with the position of its mask."""
    return flatten_nested(table(spark, folder, MASKED), ["source_row_id", "masked_at"], "mask_metadata", MASK_NEST)["candidate"]


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Flat table of rejection reasons, each with the positions of its mask and candidate."""
    return flatten_nested(table(spark, folder, MASKED), ["source_row_id", "masked_at"], "mask_metadata", MASK_NEST)["reason"]


def p5_envelope(spark: SparkSession, folder: str) -> DataFrame:
    """What stands around the masks: one row per repeated ancestor outside them."""
    return flatten_nested(table(spark, folder, MASKED), ["source_row_id", "masked_at"], "mask_metadata", MASK_NEST)["envelope"]


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """The repeated ancestors of all layouts and their fields."""
    return repeated_paths(table(spark, folder, MASKED), "mask_metadata")


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_masks, p5_candidates, p5_reasons, p5_envelope, p5_paths)}

_TREE_SQL = f"""with recursive w as (select row_number() over () as r, source_row_id, mask_metadata as m, 0 as depth from {MASKED} where json_valid(mask_metadata)
 union all select r, source_row_id, m::JSON->>'$', depth + 1 from w where json_valid(m) and json_type(m) = 'VARCHAR'),
j as (select r, source_row_id, m from w where json_valid(m) and json_type(m) <> 'VARCHAR'),
n as (select j.r, j.source_row_id, t.id, t.parent, t.key, t.type, t.fullkey, case when t.type = 'VARCHAR' then t.value->>'$' when t.type <> 'NULL' then t.value::VARCHAR end as value from j, json_tree(j.m) t)"""
MASKS_SQL = f"""{_TREE_SQL},
masks as (select o.r, o.source_row_id, o.id, row_number() over (partition by o.r order by o.id) as mask_pos from n o where o.type = 'OBJECT' and exists (select 1 from n x where x.r = o.r and x.parent = o.id and x.key = 'mask_type'))"""
ORACLE_SQL = {
    "p5_found": f"""{MASKS_SQL},
cf as (select m.r, m.source_row_id, m.mask_pos, f.id, f.type from masks m join n f on f.r = m.r and f.parent = m.id and f.key = 'candidates'),
cands as (select cf.r, cf.source_row_id, cf.mask_pos, c.id, row_number() over (partition by cf.r, cf.id order by c.id) as candidate_pos from cf join n c on c.r = cf.r and c.parent = cf.id where cf.type = 'ARRAY'
 union all select r, source_row_id, mask_pos, id, 1 from cf where type not in ('ARRAY', 'NULL')),
rf as (select c.r, c.source_row_id, c.mask_pos, c.candidate_pos, f.id, f.type from cands c join n f on f.r = c.r and f.parent = c.id and f.key = 'rejection_reasons'),
reasons as (select rf.source_row_id, rf.mask_pos, rf.candidate_pos, row_number() over (partition by rf.r, rf.id order by x.id) as reason_pos from rf join n x on x.r = rf.r and x.parent = rf.id where rf.type = 'ARRAY'
 union all select source_row_id, mask_pos, candidate_pos, 1 from rf where type not in ('ARRAY', 'NULL'))
select distinct source_row_id, mask_pos::INTEGER as mask_pos, candidate_pos::INTEGER as candidate_pos, reason_pos::INTEGER as reason_pos from (
 select source_row_id, mask_pos, 0 as candidate_pos, 0 as reason_pos from masks union all select source_row_id, mask_pos, candidate_pos, 0 from cands union all select source_row_id, mask_pos, candidate_pos, reason_pos from reasons)""",
    "p5_paths": f"""{_TREE_SQL},
k as (select r, regexp_replace(fullkey, '\\[[0-9]+\\]', '[]', 'g') as path, fullkey, type from n where fullkey is not null),
g as (select r, regexp_extract(path, '^\\$(.*\\[\\])', 1) as a, regexp_extract(fullkey, '^(.*\\])', 1) as instance, path, type from k),
f as (select distinct r, ltrim(a, '.') as ancestor, instance, case when type in ('OBJECT', 'ARRAY') then null when length(path) = length(a) + 1 then 'value' else substring(path, length(a) + 3) end as field from g),
e as (select ancestor, field, count(*) as members from f where field is not null group by all union all
 select ancestor, null, count(*) from (select r, ancestor, instance from f group by all having bool_and(field is null)) group by all)
select ancestor, field, members from e""",
}
