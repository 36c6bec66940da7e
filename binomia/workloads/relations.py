"""Names, models and a taxonomy derived from the supplied tables.

The tables hold no organisms, so part names stand in for genus and species and are
dressed up in the ways real names are written. The texts are SQL that Spark and other
engines read alike; every row of the tables takes part.
"""

from pyspark.sql import DataFrame, SparkSession

_NAME = "concat(upper(substr(p_name, 1, 1)), substr(p_name, 2))"
_G = f"split_part({_NAME}, ' ', 1)"
_S = f"split_part({_NAME}, ' ', 2)"
_KEY = "cast(p_partkey as string)"
_BRAND = "replace(p_brand, 'Brand#', '')"

TAXA_NAME = f"""case p_size % 13
    when 0 then {_NAME}
    when 1 then concat({_NAME}, ' ATCC ', {_KEY})
    when 2 then concat('[', {_G}, '] ', {_S}, ' DSM-', {_BRAND}, ' = JCM ', {_KEY})
    when 3 then concat({_NAME}, ' subsp. ', lower(p_type), ' KACC ', {_KEY})
    when 4 then concat({_G}, ' sp. CAG-', {_KEY})
    when 5 then concat('Candidatus ', {_NAME})
    when 6 then concat('uncultured ', {_G}, ' sp. X', {_BRAND})
    when 7 then concat({_NAME}, ' O157:H', {_BRAND}, ' str. EDL', {_KEY})
    when 8 then concat('uncultured bacterium ', cast(p_size as string))
    when 9 then concat({_NAME}, ' (ex Liu et al. 20', {_BRAND}, '1)')
    when 10 then concat({_NAME}, ', strain T', {_KEY}, '/1;')
    when 11 then concat({_G}, '_', {_S}, ' ')
    else concat('primary endosymbiont of ', {_NAME})
end"""

MODEL_NAME = f"""case p_size % 7
    when 0 then concat({_G}, '_', {_S})
    when 1 then concat({_G}, '_', {_S}, '_ATCC_', {_KEY})
    when 2 then concat({_G}, '_', {_S}, '_DSM_', {_BRAND})
    when 3 then concat({_G}, '_', {_S}, '_', lower(p_type))
    when 4 then concat({_G}, '_sp_CAG_', {_KEY})
    when 5 then concat({_G}, '_', {_S}, '_O157_H', {_BRAND}, '_EDL')
    else concat({_G}, '_', {_S}, '_T', {_KEY})
end"""

TAXA = f"select p_partkey as pos, {TAXA_NAME} as taxa_name, p_retailprice as abundance from part"
MODELS = f"select p_partkey as model_pos, {MODEL_NAME} as model from part"

NODES = """
select '1' as taxid, '1' as parent, 'no rank' as rank
union all select concat('R', cast(r_regionkey as string)), '1', 'superkingdom' from region
union all select concat('N', cast(n_nationkey as string)), concat('R', cast(n_regionkey as string)), 'family' from nation
union all select concat('S', cast(s_suppkey as string)), concat('N', cast(s_nationkey as string)), 'genus' from supplier
union all select concat('C', cast(c_custkey as string)), concat('N', cast(c_nationkey as string)), 'genus' from customer
union all select cast(1000000 + o_orderkey as string), concat('C', cast(o_custkey as string)), 'species' from orders
"""

_CUST = "concat('Cust', cast(o_custkey as string))"
NAMES = f"""
select '1' as taxid, 'root' as name, 'scientific name' as name_class, 0 as line_no
union all select concat('R', cast(r_regionkey as string)), r_name, 'scientific name', 1 from region
union all select concat('N', cast(n_nationkey as string)), n_name, 'scientific name', 1 from nation
union all select concat('S', cast(s_suppkey as string)), s_name, 'scientific name', 1 from supplier
union all select concat('S', cast(s_suppkey as string)), concat('Sup ', s_name), 'genbank synonym', 2 from supplier
union all select concat('C', cast(c_custkey as string)), concat('Cust', cast(c_custkey as string)), 'scientific name', 1 from customer
union all select concat('C', cast(c_custkey as string)), concat(c_name, ' (Smith 1990)'), 'authority', 2 from customer
union all select concat('C', cast(c_custkey as string)), c_name, 'includes', 3 from customer
union all select cast(1000000 + o_orderkey as string), concat({_CUST}, ' ordo (ex Liu et al. ', cast(year(o_orderdate) as string), ')'), 'scientific name', 1 from orders
union all select cast(1000000 + o_orderkey as string), concat({_CUST}, ' ', lower(split_part(o_orderpriority, '-', 2))), 'synonym', 2 from orders
union all select cast(1000000 + o_orderkey as string), concat({_CUST}, ' ', lower(o_orderstatus)), 'equivalent name', 3 from orders
"""

MERGED = """
select cast(5000000 + o_orderkey as string) as old, cast(1000000 + o_custkey as string) as taxid, o_orderkey as line_no
from orders
"""

# Former ids that several species share.
SHARED_MERGED = """
select cast(5000000 + o_custkey % 50 as string) as old, cast(1000000 + o_orderkey as string) as taxid, o_orderkey as line_no
from orders where o_orderkey % 3 <> 0
"""

# Lines of a nodes file in which ids come again and again.
NODE_LINES = """
select cast(o_custkey as string) as taxid, cast(o_orderkey as string) as parent, o_orderpriority as rank, o_orderkey as line_no
from orders
"""

ROOTS = ["R0", "N7", "R99"]

# A taxonomy of the names in TAXA: some species as they are, some moved to another genus, some unknown.
PART_NODES = f"""
select '1' as taxid, '1' as parent, 'no rank' as rank
union all select distinct concat('G', {_G}), '1', 'genus' from part
union all select cast(2000000 + p_partkey as string), concat('G', {_G}), 'species' from part where p_size % 4 <> 3
"""
PART_NAMES = f"""
select '1' as taxid, 'root' as name, 'scientific name' as name_class, 0 as line_no
union all select distinct concat('G', {_G}), {_G}, 'scientific name', 1 from part
union all select cast(2000000 + p_partkey as string), case p_size % 4 when 0 then {_NAME} when 1 then concat('Neo', lower({_G}), ' ', {_S})
    else concat({_G}, ' sp. X', {_KEY}) end, 'scientific name', 2 from part where p_size % 4 <> 3
union all select cast(2000000 + p_partkey as string), {_NAME}, 'synonym', 3 from part where p_size % 4 = 1
union all select cast(2000000 + p_partkey as string), concat({_NAME}, ' ', lower(p_type)), 'includes', 4 from part where p_size % 8 = 0
"""
PART_MERGED = """
select cast(3000000 + p_partkey as string) as old, cast(2000000 + p_partkey as string) as taxid, p_partkey as line_no
from part where p_size % 5 = 0
"""

# Names to look up: spellings of customers and their orders.
LOOKUP_NAMES = f"""
select o_orderkey as pos, case o_orderkey % 6
    when 0 then {_CUST}
    when 1 then concat({_CUST}, ' ordo ex Liu et al 1998')
    when 2 then concat({_CUST}, ' ', lower(split_part(o_orderpriority, '-', 2)), ' strain K-12')
    when 3 then concat('Candidatus ', {_CUST}, ' (Smith 1990)')
    when 4 then concat('NAME::', {_CUST}, ' sp. TX', cast(o_orderkey as string))
    else concat('Nobody ', cast(o_orderkey as string))
end as taxon from orders
"""

# Rows with scores as the scoring step leaves them, covering every rule of the ladder.
SCORED = f"""
select p_partkey as pos,
    case p_size % 5
        when 0 then replace(replace({MODEL_NAME}, '_', ' '), '.', '')
        when 1 then concat({_NAME}, ' subsp. ', lower(p_type))
        when 2 then ''
        else {_NAME}
    end as taxon,
    case p_size % 6
        when 0 then ''
        when 1 then concat({_G}, '_', lower(p_type), '_', {_KEY})
        when 2 then concat({_G}, '_', {_S}, '.mat')
        else {MODEL_NAME}
    end as suggested_gem,
    case when p_size % 4 = 0 then concat('Other ', {_S}) else {_NAME} end as canonical_gs,
    concat('Other ', {_S}, '|', {_G}, ' ', lower(p_type), '.') as synonyms,
    case p_partkey % 3 when 0 then 'red' when 1 then 'yellow' else 'green' end as confidence,
    cast(p_partkey % 14 as int) as n_top_ties,
    case p_partkey % 6 when 0 then 0 when 1 then 20 when 2 then 60 when 3 then 75 else 100 end as top_score,
    cast(p_size % 15 as int) as n_100s,
    case when p_size % 7 = 0 then null else cast(p_size * 2 as double) end as median_score
from part
"""

# Final rows with bands, covering every status.
FINAL = f"""
select p_partkey as pos, {TAXA_NAME} as taxa_name, {_NAME} as taxon,
    case when p_size % 9 = 0 then null else p_retailprice end as abundance,
    {MODEL_NAME} as mat,
    case when p_size % 4 = 0 then null when p_size % 4 = 1 then 'no_suggestion'
        else concat({_G}, '_', {_S}) end as suggested_gem,
    concat({MODEL_NAME}, ';', {_G}, '_', {_S}, ';', {_G}, '_x') as mat_candidates_str,
    case p_size % 5 when 0 then 'auto-accept' when 1 then 'grey-zone' when 2 then 'flag'
        else 'not-accept' end as bands,
    case p_partkey % 7 when 0 then 'green' when 1 then 'yellow_green' when 2 then 'yellow'
        when 3 then 'red' when 4 then 'black' when 5 then '' else null end as final_band,
    cast(p_size as double) / 64 as j_score,
    cast(p_partkey % 1300 as int) as n_candidates,
    case when p_size % 2 = 0 then 1 else 0 end as has_code_or_cc,
    cast(p_partkey % 90 as int) as n_top_ties,
    case p_partkey % 6 when 0 then 0 when 1 then 20 when 2 then 60 when 3 then 70 when 4 then 75
        else 100 end as top_score
from part
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derive(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """Run one of the texts above on the tables of a folder."""
    for name in ("part", "region", "nation", "supplier", "customer", "orders"):
        if f"from {name}" in sql:
            table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(sql)
