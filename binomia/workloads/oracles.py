"""SQL twins of the registered queries."""

from ..functions import vocab as V
from ..operators.analytics import (
    CANDIDATE_EDGES, CANDIDATE_REST, SCORE_LEVELS, TIE_EDGES, TIE_REST,
)
from . import relations as R
from . import sql as S
from .sql import lit

NA = "case when taxa_name in ('NA', 'nan', '') then 'nan' else taxa_name end"
TAXA = (
    f"raw_t as ({R.TAXA}), taxa as (select pos, {NA} as taxa_name, abundance, "
    f"{S.clean('taxa_name')} as taxon from raw_t)"
)
MODELS = f"models as ({R.MODELS})"
FINAL = f"final_t as ({R.FINAL})"
SCORED = f"scored as ({R.SCORED})"
NODES = f"nodes as ({R.NODES})"
NAMES = f"names as ({R.NAMES})"
MERGED = f"merged as ({R.MERGED})"


def joined(x, sep="|"):
    return f"array_to_string({x}, '{sep}')"


def with_(*ctes, body, recursive=False):
    return f"with {'recursive ' if recursive else ''}{', '.join(ctes)} {body}"


def from_taxa(columns):
    return with_(TAXA, body=f"select pos, {columns} from taxa")


def from_final(body, *more):
    return with_(FINAL, *more, body=body)


# --- matching --------------------------------------------------------------

QUERY_SETS = f"""
    q0 as (select distinct taxon from taxa),
    q1 as (select taxon, {S.anchor('taxon')} as anchor, {S.tokens('taxon')} as toks from q0),
    q as (select taxon, anchor, toks, {S.plain_of('toks')} as pa, {S.codes_of('toks')} as ca,
        case when anchor is null then [] else {S.tokens('anchor')}[1:2] end as gs from q1)"""
MODEL_SETS = f"""
    m1 as (select model_pos, model, {S.tokens('model')} as toks from models),
    m as (select model_pos, model, toks, {S.plain_of('toks')} as pb, {S.codes_of('toks')} as cb from m1)"""
PAIRS = f"""
    pairs as (select taxon, anchor, model_pos, model, {S.distance('pa', 'pb', 'ca', 'cb')} as d,
        list_has_all(q.toks, gs) and list_has_all(m.toks, gs) as hit, len(gs) = 2 as two from q, m),
    near as (select *, min(d) over (partition by taxon) as d_min from pairs),
    tied as (select * from near where d - d_min <= 1e-5::double),
    picked as (select taxon, any_value(anchor) as anchor,
        coalesce(min(model_pos) filter (where hit), min(model_pos)) as pick,
        count(*) as n_candidates, any_value(two) and coalesce(bool_or(hit), false) as has_gs,
        string_agg(model, ';' order by model_pos) as cands from tied group by taxon),
    best as (select p.taxon, p.anchor, t.model as mat, 1.0::double - t.d as j_score, p.has_gs,
        p.n_candidates, p.cands from picked p join tied t on t.taxon = p.taxon and t.model_pos = p.pick),
    banded as (select *, {S.band('j_score', 'has_gs')} as bands from best)"""
MATCH = [TAXA, MODELS, QUERY_SETS.strip(), MODEL_SETS.strip(), PAIRS.strip()]

LAST = "last_a as (select taxa_name, arg_max(abundance, pos) as abundance from taxa group by taxa_name)"


def dedup(source, out, words="subspp_anchor"):
    """Most specific rows of a relation, by pairwise comparison within an anchor."""
    w = S.words("coalesce(subspp_anchor, '')")
    return f"""
    {out}_w as (select *, {w} as w from {source}),
    {out}_x as (select * from {out}_w a where not exists (select 1 from {out}_w b
        where a.anchor is not distinct from b.anchor and len(a.w) > 0 and len(b.w) > len(a.w) and b.w[1:len(a.w)] = a.w)),
    {out}_r as (select *, row_number() over (partition by anchor, subspp_anchor
        order by has_code_or_cc desc, j_score desc, n_candidates asc, pos) as rn from {out}_x),
    {out}_g as (select anchor, min(pos) as group_pos from {source} group by anchor),
    {out} as (select r.* exclude (w, rn), g.group_pos from {out}_r r
        join {out}_g g on r.anchor is not distinct from g.anchor where rn = 1)""".strip()


DEDUP_ROWS = f"""
    named as (select pos, taxa_name, {S.clean('taxa_name')} as subspp_anchor, has_code_or_cc, j_score,
        n_candidates, bands from final_t),
    drows as (select *, {S.anchor('subspp_anchor')} as anchor from named)""".strip()

MATCHED = [
    *MATCH,
    LAST,
    f"""desc_n as (select taxon, anchor, {S.subspecies('taxon', 'anchor')} as subspp_anchor,
        {S.has_code('taxon')} as has_code_or_cc from q1)""",
    f"""full_r as (select t.pos, t.taxa_name, a.abundance, t.taxon, b.anchor, b.mat, b.j_score, b.has_gs, b.bands,
        b.n_candidates, md5(b.cands) as candidates, d.subspp_anchor, d.has_code_or_cc
        from taxa t join last_a a using (taxa_name) join banded b on b.taxon = t.taxon join desc_n d on d.taxon = t.taxon)""",
    dedup("full_r", "kept"),
]

# --- taxonomy --------------------------------------------------------------

ROOTS = ", ".join(lit(r) for r in R.ROOTS)
CHAIN = """
    chain as (
        select n.taxid, n.parent as anc, 1 as depth from nodes n join nodes p on p.taxid = n.parent
        where n.parent <> n.taxid
        union all
        select c.taxid, n.parent, c.depth + 1 from chain c join nodes n on n.taxid = c.anc
        join nodes p on p.taxid = n.parent where n.parent <> n.taxid)""".strip()
SCOPE = f"""
    scope as (select taxid from nodes where taxid in ({ROOTS})
        union select taxid from chain where anc in ({ROOTS}))""".strip()
ABOVE = f"above as (select distinct anc as taxid from chain where taxid in ({ROOTS}))"
BUCKETS = """
    buckets as (select taxid,
        arg_max(name, line_no) filter (where name_class = 'scientific name') as scientific_name,
        coalesce(list(name order by line_no, name) filter (where name_class = 'synonym'), []) as Synonym,
        coalesce(list(name order by line_no, name) filter (where name_class = 'genbank synonym'), []) as GenbankSynonym,
        coalesce(list(name order by line_no, name) filter (where name_class = 'equivalent name'), []) as EquivalentName,
        coalesce(list(name order by line_no, name) filter (where name_class = 'includes'), []) as Includes,
        coalesce(list(name order by line_no, name) filter (where name_class = 'authority'), []) as Authority
        from names group by taxid)""".strip()
LINEAGE = """
    steps as (select c.taxid, c.depth, c.anc, coalesce(b.scientific_name, '') as sci, n.rank
        from chain c join nodes n on n.taxid = c.anc left join buckets b on b.taxid = c.anc where c.anc <> '1'),
    lineage as (select taxid, list(anc order by depth desc) as ids, list(sci order by depth desc) as scis,
        list(rank order by depth desc) as ranks from steps group by taxid)""".strip()
RECORDS = """
    olds as (select taxid, list(distinct old) as olds from merged group by taxid),
    recs as (select s.taxid, b.scientific_name as sci, n.parent, n.rank, b.Synonym, b.GenbankSynonym,
        b.EquivalentName, b.Includes, b.Authority, coalesce(l.scis, []) as scis, coalesce(l.ranks, []) as ranks,
        list_sort(coalesce(o.olds, [])) as olds
        from scope s join nodes n on n.taxid = s.taxid join buckets b on b.taxid = s.taxid
        left join lineage l on l.taxid = s.taxid left join olds o on o.taxid = s.taxid
        where b.scientific_name is not null and b.scientific_name <> '')""".strip()
KEYS = f"""
    alts as (select taxid, unnest(list_concat(list_concat(Synonym, GenbankSynonym), list_concat(EquivalentName, Includes))) as name from recs),
    clean_k as (select taxid, sci, {S.species_key('sci')} as ck from recs),
    all_k as (
        select concat('TAX::', sci) as key, max(taxid) as taxid, 1 as prio from recs group by sci
        union all select concat('TAX::', name), min(taxid), 2 from alts where name <> '' group by name
        union all select concat('TAX::', ck), arg_min(taxid, row(case when try_cast(taxid as hugeint) is null then 1 else 0 end,
            coalesce(try_cast(taxid as hugeint), 0), taxid)), 3
            from clean_k where ck <> sci and len({S.words('ck')}) >= 2 group by ck),
    keys as (select key, arg_min(taxid, prio) as taxid from all_k group by key
        union all select concat('IDS::', array_to_string(olds, ',')), max(taxid) from recs where len(olds) > 0 group by olds)""".strip()
TAXONOMY = [NODES, NAMES, MERGED, CHAIN, SCOPE, BUCKETS, LINEAGE, RECORDS, KEYS]


def taxonomy(body, *more):
    return with_(*TAXONOMY, *more, body=body, recursive=True)


FIND = f"""
    wanted_r as ({R.LOOKUP_NAMES}),
    wanted as (select pos, {S.plain_name('taxon')} as taxon from wanted_r),
    spelled as (select taxon, unnest(v) as variant, unnest(range(len(v))) as v_pos
        from (select taxon, {S.variants('taxon')} as v from (select distinct taxon from wanted))),
    found as (select s.taxon, arg_min(k.taxid, s.v_pos) as rec_id
        from spelled s join keys k on k.key = concat('TAX::', s.variant) group by s.taxon)""".strip()

_NAMES_OF = (
    "list_concat([sci], list_concat(list_concat(Synonym, GenbankSynonym), "
    "list_concat(list_concat(EquivalentName, Includes), Authority)))"
)


def tidy(x):
    return f"list_sort(list_distinct(list_filter({x}, lambda z_: z_ <> '')))"


POOLS = f"""
    p0 as (select taxid as rec_id, {S.binomial('sci')} as canonical, rank,
        list_sort(list_distinct(list_transform(list_filter(list_zip(ranks, scis), lambda r_: r_[1] = 'genus' and r_[2] <> ''), lambda r_: r_[2]))) as genera,
        {tidy(f"list_transform({_NAMES_OF}, lambda nm_: {S.binomial('nm_')})")} as synonyms, olds from recs),
    p1 as (select p0.*, list_concat([canonical], synonyms) as nms from p0),
    pools as (select rec_id, canonical, rank, genera, synonyms,
        {tidy("list_transform(list_concat(nms, flatten(list_transform(genera, lambda g_: list_transform(list_filter(nms, lambda e_: len(string_split(e_, ' ')) >= 2), lambda e_: concat(g_, ' ', string_split(e_, ' ')[2]))))), lambda pn_: " + S.binomial('pn_') + ")")} as pool
        from p1)""".strip()

# --- rescue ----------------------------------------------------------------

CANDS = """
    cand_rows as (select o_orderkey as pos, unnest([
        concat('Cust', o_custkey, '_ordo_', o_orderkey), concat('Cust', o_custkey, '_', lower(o_orderstatus)),
        concat('Other_', lower(o_orderstatus)), concat('Cust', o_custkey, '_sp_T1'), lower(concat('Cust', o_custkey))]) as model,
        unnest([0, 1, 2, 3, 4]) as place from orders)""".strip()
_MG, _MS = S.canonical("string_split(gs, ' ')[1]"), S.canonical("string_split(gs, ' ')[2]")
RESCUE = f"""
    canon as (select rec_id, canonical, genera, pool, synonyms,
        list_transform(pool, lambda u_: {S.canonical('u_')}) as pc, list_transform(genera, lambda u_: {S.canonical('u_')}) as gc from pools),
    r0 as (select w.pos, w.taxon, c.model, c.place, f.rec_id, k.canonical, k.pc, k.gc, k.pool, {S.model_gs('c.model')} as gs
        from wanted w join cand_rows c on c.pos = w.pos left join found f on f.taxon = w.taxon left join canon k on k.rec_id = f.rec_id),
    r1 as (select *, {_MG} as mg, {_MS} as ms from r0),
    r2 as (select *, case when gs is null then 0
        when list_contains(pc, concat(mg, ' ', ms)) and ms <> 'sp' then 100
        when ms = 'sp' and len(list_filter(pc, lambda y_: {S.placeholder('y_')} and starts_with(y_, concat(mg, ' sp')))) > 0 then 75
        when list_contains(gc, mg) then case when {S.placeholder(S.canonical('canonical'))} then 70 else 60 end
        else 20 end as score from r1 where rec_id is not null),
    r3 as (select pos, model, score, case score {' '.join(f'when {k} then {lit(v)}' for k, v in V.REASONS.items())} end as reason,
        row_number() over (partition by pos order by score desc, length(model), place) as rn,
        max(score) over (partition by pos) as top from r2),
    r4 as (select pos, string_agg(concat(model, '@@', score, '@@', reason), ';' order by rn) as ranked, max(top) as top,
        count(*) as n, count(*) filter (where score = top) as n_top, median(score) as med, count(*) filter (where score = 100) as n100,
        median(score) filter (where score < top) as med_other,
        arg_min(model, rn) as gem, arg_min(reason, rn) as why from r3 group by pos),
    scored_r as (select w.pos, w.taxon, coalesce(r4.gem, '') as gem, coalesce(k.canonical, '') as canonical, coalesce(r4.ranked, '') as ranked,
        case when r4.top is null or r4.top < 100 then 'red' when n_top = 1 then 'green' when n_top > 5 then 'red'
            when med_other is null or med_other < 75 then 'yellow' else 'red' end as tier,
        coalesce(r4.n, 6) as n_candidates, coalesce(n_top, 0) as n_top_ties, coalesce(r4.top, 0) as top_score, coalesce(n100, 0) as n_100s,
        med as median_score, coalesce(r4.why, '{V.NO_RECORD}') as why, coalesce(k.pool, []) as pool
        from wanted w left join r4 on r4.pos = w.pos left join found f on f.taxon = w.taxon left join canon k on k.rec_id = f.rec_id)""".strip()


def verdicts(source):
    """Ladder and corrections over ``pos, taxon, core, canonical_gs, pairs, confidence, ...``."""
    core_m, core_id = S.strict_parts("core"), S.strict_id("core")
    epi = r"lower(nullif(regexp_extract(taxon, '(?i)\b(subsp\.?|ssp\.?|subspecies|pv\.?|pathovar|serovar|biovar|var\.?|variant|f\.?|forma)\s+([A-Za-z0-9_.-]+)\b', 2), ''))"
    return f"""
    v0 as (select *, {S.strict_parts('taxon')} as n_p, {S.strict_parts('canonical_gs')} as c_p, {core_m} as m_p, {core_id} as m_id,
        {epi} as epi, regexp_matches(taxon, '(?i)\\b(subsp(\\.|ecies)?|ssp\\.?)\\b') as marked from {source}),
    v1 as (select *, list_concat([{{'g': c_p[1], 's': c_p[2]}}], list_filter(pairs, lambda a_: a_.g <> '' and a_.s <> '')) as cand from v0),
    v2 as (select *, case when len(n_p) < 2 or len(c_p) < 2 then 'none'
        when len(list_filter(cand, lambda a_: array_to_string(list_concat([a_.g, a_.s], n_p[3:]), '_') = m_id)) > 0 then 'full_exact'
        when len(list_filter(cand, lambda a_: m_p[1] is not distinct from a_.g and m_p[2] is not distinct from a_.s)) > 0 then 'gs_exact'
        else 'none' end as level,
        coalesce(marked and len(n_p) >= 2 and len(m_p) >= 2 and epi <> n_p[2] and m_p[1] = n_p[1] and m_p[2] = epi, false) as elevated from v1),
    v3 as (select *, case when taxon = '' or core = '' then 1 when elevated then 2 when level = 'full_exact' then 3
        when level = 'gs_exact' and n_top_ties > 10 then 4 when top_score >= 100 and n_top_ties <= 5 then 5 else 6 end as rule from v2),
    v4 as (select *, case rule when 1 then confidence when 2 then 'green' when 3 then 'green' when 4 then 'red' else 'yellow' end as c1,
        case rule when 1 then 'none' when 2 then 'full_exact' when 3 then 'full_exact' when 4 then 'gs_exact' when 5 then 'none' else 'gs_exact' end as l1,
        case rule when 1 then {lit(V.WHY_MISSING)} when 2 then {lit(V.WHY_ELEVATED)} when 3 then {lit(V.WHY_FULL)} when 4 then {lit(V.WHY_TIES)}
            when 5 then {lit(V.WHY_SOFT)} else {lit(V.WHY_GS)} end as w1,
        (median_score is null or median_score <= 20) and top_score <= 20 as lost from v3),
    v5 as (select *, c1 = 'yellow' and top_score >= 99.999 and n_top_ties = 1 as uniq from v4),
    v6 as (select *, not uniq and c1 = 'yellow' and (n_top_ties > 10 or n_100s > 10) as heavy from v5),
    verdict as (select *, case when lost then 'black' when heavy then 'red' when uniq then 'yellow_green' else c1 end as final_color,
        case when lost then 'none' else l1 end as match_level,
        case when uniq then concat(w1, {lit(V.NOTE_YELLOW_GREEN)}) when heavy then concat(w1, {lit(V.NOTE_RED)}) else w1 end as rationale_final
        from v6)""".strip()


def pairs_of(names):
    """Lower-case pairs of an array of names."""
    return (
        f"list_transform(list_filter(list_transform({names}, lambda n2_: {S.words('n2_')}), lambda w2_: len(w2_) >= 2), "
        "lambda w2_: {'g': lower(w2_[1]), 's': rtrim(lower(w2_[2]), '.')})"
    )


# --- a whole run -----------------------------------------------------------

PART_TAXONOMY = [
    f"nodes as ({R.PART_NODES})", f"names as ({R.PART_NAMES})", f"merged as ({R.PART_MERGED})",
    CHAIN, SCOPE.replace(ROOTS, "'1'"), BUCKETS, LINEAGE, RECORDS, KEYS,
]
RUN_WANTED = f"""
    wanted as (select pos, {S.plain_name('taxon')} as taxon, n_candidates as n_listed from kept where bands <> 'auto-accept'),
    {FIND[FIND.index('spelled as'):]}""".strip()
RUN_CANDS = """
    cand_rows as (select w.pos, t.model, min(t.model_pos) as place from wanted w join tied t on t.taxon = w.taxon group by w.pos, t.model)"""
RUN_RESCUE = RESCUE.replace("coalesce(r4.n, 6)", "coalesce(r4.n, w.n_listed)")

CORE = r"regexp_replace(trim(coalesce(suggested_gem, '')), '\.mat$', '', 'i')"
SCORED_V = f"sv as (select *, {CORE} as core, {pairs_of("string_split(synonyms, '|')")} as pairs from scored)"

# --- reports ---------------------------------------------------------------

_BAND = "translate(lower(coalesce(nullif(final_band, ''), nullif(bands, ''), 'red')), '-', '_')"
_STATES = [
    ("contains(b, 'green') and not contains(b, 'yellow')", "unambiguous", "1.0"),
    ("contains(b, 'auto_accept')", "unambiguous", "1.0"),
    ("contains(b, 'yellow_green')", "high_similarity", "0.95"),
    ("contains(b, 'yellow') or contains(b, 'grey_zone')", "near_tier", "greatest(j_score, 0.6::double)"),
    ("contains(b, 'black') or contains(b, 'not_found')", "no_correspondence", "0.0"),
]
_STATUS = "case " + " ".join(f"when {c} then '{s}'" for c, s, _ in _STATES) + " else 'low_similarity' end"
_CONF = "case " + " ".join(f"when {c} then {v}::double" for c, _, v in _STATES) + " else j_score end"
_SCORE = (
    "cast(printf('%.2f', case when md_ = coalesce(nullif(suggested_gem, ''), nullif(mat, '')) then "
    "(case when j_score = 0 then 0.5::double else j_score end) else 0.5::double end) as varchar)"
)
ITEMS = f"""
    it0 as (select *, {_BAND} as b from final_t),
    items as (select pos, taxa_name as query_name, abundance,
        coalesce(nullif(suggested_gem, ''), nullif(mat, ''), '') as mapped_id, {_STATUS} as status,
        {S.rounded(f'({_CONF})', 4)} as confidence_score,
        array_to_string(list_transform(string_split(mat_candidates_str, ';'), lambda md_: concat(md_, '@', {_SCORE}, '@Jaccard Similarity')), ';') as candidates
        from it0)""".strip()
_RESOLVED = "case when bands = 'auto-accept' then 'green' else coalesce(nullif(trim(final_band), ''), 'black') end"
_IN_BANDS = f"bands in ({', '.join(lit(b) for b in V.BANDS)})"


def bins(x, edges, rest):
    parts = " ".join(f"when {x} <= {e} then {lit(l)}" for e, l in edges)
    return f"case when {x} is null or {x} <= 0 then null {parts} else {lit(rest)} end"


RESCUED = """
    rescued as (select *, final_band as final_color, final_band = 'black' as is_not_found from final_t
        where final_band is not null and final_band <> '')""".strip()
_ZERO = f"case when n_top_ties = 0 then '0' else {bins('n_top_ties', CANDIDATE_EDGES, CANDIDATE_REST)} end"
_ALL_BINS = ", ".join(lit(x) for x in ["0"] + [l for _, l in CANDIDATE_EDGES] + [CANDIDATE_REST])
_ORD = lambda c: f"nullif(list_position({S.strings(V.FINAL_BANDS)}, {c}), 0)"
_TRUNC = lambda c, n: f"case when length({c}) > {n} then concat({c}[1:{n - 3}], '...') else {c} end"
COMPARED = f"""
    cmp0 as (select pos, taxa_name as taxon, suggested_gem as other_name, coalesce(final_band, 'green') as own_band,
        case when top_score = 100 then 'green' when top_score > 60 then 'yellow' when top_score > 0 then final_band end as other_band, pos % 2 = 0 as name_changed, pos % 3 = 0 as band_changed from final_t),
    cmp as (select *, case when {_ORD('other_band')} is null then 'no MetaPhlAn equivalent'
        when {_ORD('own_band')} > {_ORD('other_band')} then 'improved' when {_ORD('own_band')} < {_ORD('other_band')} then 'degraded' else 'unchanged' end as direction,
        case when name_changed then concat({_TRUNC('taxon', 26)}, chr(10), '→ ', {_TRUNC('other_name', 26)}) else {_TRUNC('taxon', 32)} end as label
        from cmp0 where other_name is not null)""".strip()

_FLAT = "translate(text, concat(chr(10), chr(9), chr(13)), '   ')"
_SIDES = f"""
    sides as (select pos, {S.tokens("concat(taxon, ' = DSM ', cast(pos % 9 as varchar))")} as own,
        {S.tokens("concat(model, '_DSM_', cast(pos % 7 as varchar))")} as other from taxa join models on pos = model_pos),
    coded as (select pos, {S.plain_of('own')} as pa, {S.plain_of('other')} as pb, {S.codes_of('own')} as ca, {S.codes_of('other')} as cb from sides)""".strip()

_EPITHET = r"nullif(regexp_extract(taxa_name, '(?i)\b(subsp\.?|ssp\.?|subspecies|pv\.?|pathovar|serovar|biovar|var\.?|variant|f\.?|forma)\s+([A-Za-z0-9_.-]+)\b', 2), '')"
_GS = S.let(S.words("taxon"), "w3_", "case when len(w3_) >= 2 then concat(w3_[1], ' ', w3_[2]) else taxon end")

_PR = "concat(mat_candidates_str, '@@', cast(top_score as varchar))"
_PR = f"case pos % 5 when 0 then 'no candidates' when 1 then concat({_PR}, '@@why') else {_PR} end"

ORACLES = {
    "clean_names": from_taxa("taxon"),
    "clean_documents": f"select doc_id, md5({S.clean('text')}) as cleaned from documents",
    "strip_authorship": from_taxa(f"{S.authorless('taxon')} as bare"),
    "tokenize_names": from_taxa(f"{joined(S.tokens('taxon'))} as tokens"),
    "tokenize_models": with_(MODELS, body=f"select model_pos, {joined(S.tokens('model'))} as tokens from models"),
    "tokenize_documents": "with d as (select doc_id, "
    + S.tokens("translate(text, concat(chr(10), chr(9), chr(13)), '   ')")
    + f" as t from documents) select doc_id, len(t) as n_tokens, md5({joined('t')}) as tokens from d",
    "choose_codes": with_(TAXA, MODELS, _SIDES, body=f"select pos, {joined('ca')} as codes, {S.choose('ca')} as preferred, {S.choose('ca', 'cb')} as preferred_shared from coded"),
    "token_distance": with_(TAXA, MODELS, _SIDES, body=f"select pos, {S.distance('pa', 'pb', 'ca', 'cb')} as d from coded"),
    "species_anchors": with_(TAXA, f"a as (select pos, {S.anchor('taxon')} as anchor from taxa)", body=f"select pos, anchor, {S.descriptive('anchor')} as descriptive from a"),
    "subspecies_anchors": with_(
        TAXA,
        f"a as (select taxon, {S.anchor('taxon')} as anchor from (select distinct taxon from taxa))",
        f"b as (select taxon, anchor, {S.subspecies('taxon', 'anchor')} as subspp_anchor from a)",
        body=f"select taxon, anchor, subspp_anchor, {S.word_count('subspp_anchor')}::bigint as anchor_tokens, "
        f"{S.word_count('anchor')}::bigint as anchor_tokens_base, ({S.has_code('taxon')})::bigint as has_code_or_cc from b",
    ),
    "code_flags": with_(TAXA, "n0 as (select taxon as name from taxa union all select s_name from supplier)", body=f"select name, ({S.has_code('name')})::bigint as has_code, count(*) as n from n0 group by all"),
    "species_keys": from_taxa(f"{S.species_key('taxa_name')} as species_key"),
    "name_forms": from_taxa(
        f"{S.plain_name('taxa_name')} as plain, {S.binomial('taxa_name')} as binomial, {S.canonical('taxa_name')} as canonical, "
        f"{S.placeholder(S.canonical('taxa_name'))} as placeholder, {_GS} as genus_species, {S.strict_id('taxa_name')} as strict, "
        r"regexp_matches(taxa_name, '(?i)\b(subsp(\.|ecies)?|ssp\.?)\b') as marked, "
        f"{_EPITHET} as epithet, {S.squish(f'translate(translate(taxa_name, {lit('[]')}, {lit('')}), {lit('_')}, {lit(' ')})')} as shown, "
        "nullif(regexp_extract(taxa_name, '^[A-Za-z]+'), '') as letters, "
        f"{_TRUNC('taxa_name', 18)} as short, "
        + joined("list_filter(list_transform(" + S.words("taxa_name") + r", lambda e_: regexp_replace(e_, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), lambda e_: e_ <> '')")
        + " as edge_words, "
        + S.let("string_split(taxon, ' ')", "y_", r"rtrim(coalesce(list_sort(list_transform(list_filter(y_, lambda t_: regexp_matches(t_, '\d') and regexp_matches(t_, '[A-Za-z]')), lambda t_: {'n': -length(t_), 't': t_}))[1].t, list_filter(y_, lambda t_: regexp_matches(t_, '\d'))[-1]), '._/-')")
        + " as digit_token"
    ),
    "model_forms": with_(MODELS, body=f"select model_pos, {joined(S.id_parts('model'))} as parts, {S.model_gs('model')} as gs from models"),
    "lookup_spellings": from_taxa(f"{joined(S.variants('taxa_name'))} as variants"),
    "best_match": with_(*MATCH, body="select taxon, mat, j_score, has_gs, bands, n_candidates from banded"),
    "tie_members": with_(*MATCH, body="select taxon, model_pos, model from tied where d < 1"),
    "match_candidates": with_(*MATCH, body="select taxon, n_candidates, md5(cands) as candidates from banded"),
    "match_documents": with_(
        f"dq as (select distinct {_FLAT} as taxon from documents)",
        f"dt as (select taxon, {S.tokens('taxon')} as toks from dq)",
        f"ds as (select taxon, {S.plain_of('toks')} as pa, {S.codes_of('toks')} as ca from dt)",
        f"mt as (select item_id, {S.tokens(_FLAT)} as toks from benchmark)",
        f"ms as (select item_id, {S.plain_of('toks')} as pb, {S.codes_of('toks')} as cb from mt)",
        f"pr as (select taxon, {S.distance('pa', 'pb', 'ca', 'cb')} as d from ds, ms)",
        body="""select md5(taxon) as doc, 1.0::double - min(d) as j_score, count(*) filter (where d - d_min <= 1e-5::double) as n_candidates
        from (select *, min(d) over (partition by taxon) as d_min from pr) group by taxon""",
    ),
    "last_abundance": with_(TAXA, LAST, body="select * from last_a"),
    "matched_rows": with_(
        *MATCHED,
        body=f"""select pos, group_pos, taxa_name, abundance, taxon, anchor, mat, j_score, has_gs, bands, n_candidates, candidates, subspp_anchor,
        {S.word_count('subspp_anchor')}::bigint as anchor_tokens, has_code_or_cc::bigint as has_code_or_cc from kept""",
    ),
    "drop_extended": from_final("select pos, anchor, subspp_anchor from k_x", DEDUP_ROWS, dedup("drows", "k")),
    "best_per_subspecies": from_final("""select pos, anchor, subspp_anchor from (select *, row_number() over (partition by anchor, subspp_anchor
        order by has_code_or_cc desc, j_score desc, n_candidates asc, pos) as rn from drows) where rn = 1""", DEDUP_ROWS),
    "most_specific_order": from_final("select pos, anchor, subspp_anchor, group_pos from k", DEDUP_ROWS, dedup("drows", "k")),
    "needs_rescue": from_final("select pos, bands from final_t where bands <> 'auto-accept'"),
    "filtering_totals": from_final(f"""select count(*) as total_taxa, count(*) filter (where bands = 'auto-accept') as auto_accepted,
        count(*) filter (where bands <> 'auto-accept') as need_rescue,
        {S.percent("count(*) filter (where bands <> 'auto-accept')", 'count(*)')} as need_rescue_pct from final_t"""),
    "band_breakdown": from_final("select bands, count(*) as n from final_t where bands <> 'auto-accept' group by bands"),
    "merge_rescued": from_final("""select f.pos, f.taxon, coalesce(l.mat, f.mat) as mat, coalesce(l.bands, f.bands) as bands,
        case when l.taxon is not null then 0.5::double else f.j_score end as j_score, l.final_band, l.top_score::bigint as top_score
        from final_t f left join last_r l on l.taxon = f.taxon""",
        "last_r as (select * from final_t r where bands <> 'auto-accept' and pos = (select max(pos) from final_t x where x.taxon = r.taxon and x.bands <> 'auto-accept'))"),
    "taxonomy_scope": with_(NODES, CHAIN, SCOPE, body="select taxid from scope", recursive=True),
    "taxonomy_above_roots": with_(NODES, CHAIN, ABOVE, body="select taxid from above", recursive=True),
    "taxonomy_lineage": with_(NODES, NAMES, CHAIN, BUCKETS, LINEAGE, body=f"""select n.taxid, coalesce({joined('l.ids')}, '') as ids,
        coalesce({joined('l.scis')}, '') as names, coalesce({joined('l.ranks')}, '') as ranks from nodes n left join lineage l on l.taxid = n.taxid""", recursive=True),
    "taxonomy_names": with_(NAMES, BUCKETS, body="select taxid, scientific_name, " + ", ".join(f"{joined(c)} as {c}" for c in ["Synonym", "GenbankSynonym", "EquivalentName", "Includes", "Authority"]) + " from buckets"),
    "taxonomy_merged": with_(MERGED, body="select taxid, string_agg(old, '|' order by line_no) as merged from merged group by taxid"),
    "taxonomy_keys": taxonomy("select key, taxid from keys"),
    "taxonomy_records": taxonomy(f"""select taxid, sci as name, parent, rank, {joined("list_filter(scis, lambda z_: z_ <> '')", '; ')} as lineage,
        {joined('Synonym')} as synonyms, {joined('olds')} as merged from recs"""),
    "taxonomy_totals": taxonomy("""select (select count(*) from scope) as in_scope, (select count(*) from recs) as records,
        (select count(*) from keys where starts_with(key, 'TAX::')) as tax_keys,
        (select count(*) from keys where starts_with(key, 'TAX::')) - (select count(distinct sci) from recs) as synonym_keys,
        (select count(*) from keys where starts_with(key, 'IDS::')) as ids_keys"""),
    "find_records": taxonomy("select taxon, rec_id from found", FIND),
    "merged_synonyms": with_(NODES, NAMES, f"merged as ({R.SHARED_MERGED})", *TAXONOMY[3:], POOLS,
        """own_k as (select taxid as rec_id, case when len(olds) > 0 then concat('IDS::', array_to_string(olds, ',')) end as ids_key from recs),
        taken as (select o.rec_id, p.synonyms as more from own_k o join keys k on k.key = o.ids_key and k.taxid <> o.rec_id join pools p on p.rec_id = k.taxid)""",
        body=f"""select p.rec_id, o.ids_key, {joined("list_sort(list_distinct(list_concat(p.synonyms, coalesce(t.more, []))))")} as synonyms
        from pools p join own_k o using (rec_id) left join taken t using (rec_id)""", recursive=True),
    "dump_fields": f"select taxid, arg_max(parent, line_no) as parent, arg_max(rank, line_no) as rank from ({R.NODE_LINES}) group by taxid",
    "csv_round_trip": with_(TAXA, LAST, body="select * from last_a"),
    "lookup_round_trip": taxonomy("select taxon, rec_id as taxid from found", FIND),
    "record_pools": taxonomy(f"""select rec_id, canonical, rank, string_split(canonical, ' ')[1] as genus,
        coalesce(string_split(canonical, ' ')[2], '') as species_epithet, {joined('genera')} as genera, {joined('synonyms')} as synonyms,
        {joined('pool')} as pool from pools""", POOLS),
    "rescue_scores": taxonomy("""select pos, taxon, gem as suggested_gem, canonical, ranked as ranked_candidates, tier, n_candidates, n_top_ties,
        top_score::bigint as top_score, n_100s, median_score, why as rationale_scoring from scored_r""", FIND, POOLS, CANDS, RESCUE),
    "rescue_names": taxonomy("""select pos, taxon, case when lost then 'no_suggestion' else core end as suggested_gem, final_color as final_band, match_level, rationale_final,
        lost as is_not_found from verdict""", FIND, POOLS, CANDS, RESCUE,
        f"sv as (select *, gem as core, tier as confidence, {_GS.replace('taxon', 'canonical')} as canonical_gs, {pairs_of('pool')} as pairs from scored_r)", verdicts("sv")),
    "report_candidate_rows": with_(*MATCH, body=f"""select pos, score, count(*) as n, min(model) as first_model, sum(model_pos)::bigint as places from (
        select x.pos, t.model, t.model_pos, case when t.model = b.mat then {S.rounded('b.j_score', 2)} else 0.5::double end as score
        from taxa x join banded b on b.taxon = x.taxon and b.j_score > 0 join tied t on t.taxon = x.taxon) group by pos, score"""),
    "pipeline_final": with_(*MATCHED, *PART_TAXONOMY, RUN_WANTED, POOLS, RUN_CANDS.strip(), RUN_RESCUE,
        f"sv as (select *, gem as core, tier as confidence, {_GS.replace('taxon', 'canonical')} as canonical_gs, {pairs_of('pool')} as pairs from scored_r)",
        verdicts("sv"),
        f"""joined_r as (select k.pos, k.taxon, k.mat, k.bands, k.j_score, case when v.lost then 'no_suggestion' else v.gem end as suggested_gem,
            v.canonical, v.final_color as final_band, v.match_level, v.rationale_final, v.median_score,
            coalesce(v.n_candidates, k.n_candidates)::bigint as n_candidates, v.n_top_ties::bigint as n_top_ties, v.top_score::bigint as top_score,
            v.n_100s::bigint as n_100s from kept k left join verdict v on v.pos = k.pos),
        graded as (select *, {_BAND} as b from joined_r)""",
        body=f"""select pos, taxon, mat, bands, j_score, suggested_gem, canonical, final_band, match_level, rationale_final, median_score, n_candidates,
        n_top_ties, top_score, n_100s, {_STATUS} as status, {S.rounded(f'({_CONF})', 4)} as confidence_score,
        coalesce(nullif(suggested_gem, ''), nullif(mat, ''), '') as mapped_id from graded""", recursive=True),
    "score_summaries": """with s0 as (select o_custkey, [0, 20, 60, 70, 75, 100][(o_orderkey % 6) + 1] as score from orders),
        s1 as (select *, max(score) over (partition by o_custkey) as top from s0),
        s2 as (select o_custkey, max(top) as top_score, count(*) filter (where score = top) as n_top, median(score) filter (where score < top) as median_other,
            median(score) as median_score, count(*) filter (where score = 100) as n_100s from s1 group by o_custkey)
        select o_custkey, case when top_score < 100 then 'red' when n_top = 1 then 'green' when n_top > 5 then 'red'
            when median_other is null or median_other < 75 then 'yellow' else 'red' end as tier,
            n_top, top_score::bigint as top_score, median_other, median_score, n_100s from s2""",
    "match_levels": with_(SCORED, SCORED_V, verdicts("sv"), body="select pos, level, elevated from verdict"),
    "reclassified": with_(SCORED, SCORED_V, verdicts("sv"), body="""select pos, final_color, match_level, rationale_final, lost as is_not_found,
        case when lost then 'no_suggestion' else suggested_gem end as suggested_gem, case when lost then 'no candidates' else 'r' end as ranked_candidates,
        final_color as final_band from verdict"""),
    "report_items": from_final("select pos, query_name, abundance, mapped_id, status, confidence_score, candidates from items", ITEMS),
    "status_summary": from_final("select s.name, s.status, count(i.status) as n, "
        + S.percent("count(i.status)", "(select count(*) from items)")
        + " as pct, floor(count(i.status) / (select count(*) from items)::double * 100 / 5)::bigint as bar from (values "
        + ", ".join(f"({lit(n)}, {lit(v)})" for n, v in V.STATES)
        + ") as s(name, status) left join items i on i.status = s.status group by s.name, s.status", ITEMS),
    "status_table": from_final(f"select status, count(*) as n, {S.percent('count(*)', '(select count(*) from items)')} as pct from items group by status", ITEMS),
    "outcome_counts": from_final("select final_band, count(*) as n from final_t group by final_band"),
    "flow_links": from_final(f"""select 'All Taxa' as source, bands as target, count(*) as value from final_t where {_IN_BANDS} group by bands
        union all select bands, fin, count(*) from (select bands, {_RESOLVED} as fin from final_t where {_IN_BANDS})
        where fin in ({', '.join(lit(b) for b in V.FINAL_BANDS)}) group by bands, fin"""),
    "dedup_audit": from_final("""select i.pos, i.taxa_name, i.subspp_anchor as taxon, i.taxa_name not in (select taxa_name from k) as dropped,
        case when i.taxa_name not in (select taxa_name from k) then h.heir end as merged_into
        from drows i left join heirs h on h.anchor is not distinct from i.anchor""", DEDUP_ROWS, dedup("drows", "k"),
        """heirs as (select anchor, taxa_name as heir from (select *, row_number() over (partition by anchor
        order by has_code_or_cc asc, j_score asc, n_candidates desc, pos desc) as rn from k) where rn = 1)"""),
    "parse_ranked": from_final(f"""select pos, place, case when len(p) in (2, 3) then p[1] else x end as model,
        case when len(p) in (2, 3) then p[2] else '?' end as score, case when len(p) = 3 then p[3] else '' end as reason
        from (select pos, place, x, string_split(x, '@@') as p from (select pos, unnest(xs) as x, unnest(range(len(xs))) as place
        from (select pos, string_split(t, ';') as xs from (select pos, {_PR} as t from final_t) where t <> 'no candidates')))"""),
    "detail_records": from_final("""select f.pos, l.status, l.confidence_score, case when l.mapped_id in ('no_suggestion', '') then '' else l.mapped_id end as mapped_id,
        3::bigint as n_shown from final_t f
        join (select query_name, arg_max(status, pos) as status, arg_max(confidence_score, pos) as confidence_score, arg_max(mapped_id, pos) as mapped_id
        from items group by query_name) l on l.query_name = f.taxa_name""", ITEMS),
    "input_types": from_final(r"""select case when has_code_or_cc = 1 then 'CAG / unculture' when regexp_matches(taxa_name, '(?i)\bbacterium\b') then 'Higher-rank label'
        when j_score = 0 then 'Absent from reference' else 'Canonical binomial' end as input_type, count(*) as n from final_t group by 1"""),
    "tie_bins": from_final(f"""select pos, {bins('n_top_ties', TIE_EDGES, TIE_REST)} as tie_bin, {bins('n_candidates', CANDIDATE_EDGES, CANDIDATE_REST)} as candidate_bin,
        case when n_candidates = 0 then '0' else {bins('n_candidates', CANDIDATE_EDGES, CANDIDATE_REST)} end as zero_bin,
        (round_even(top_score / 25.0::double, 0) * 25)::double as score_bin from final_t"""),
    "score_histogram": from_final("select floor(j_score / 0.0625)::bigint as bin, bands, count(*) as n from final_t group by 1, 2"),
    "score_histogram_fine": from_final("select floor(j_score / 0.05::double)::bigint as bin, bands, count(*) as n from final_t group by 1, 2"),
    "detail_rescued": from_final("""select f.pos, r.final_band as rescue_band, r.top_score::bigint as rescue_score, r.bands as rescue_level,
        case when r.pos is not null then 1 + (r.suggested_gem is not null)::bigint end as n_ranked,
        case when r.pos is not null then case when r.suggested_gem is null or r.suggested_gem = 'no_suggestion' then '' else r.suggested_gem end end as preferred,
        r.mat as first_model from final_t f left join (select * from (select *, row_number() over (partition by taxon order by pos desc) as rn
        from final_t where final_band is not null and final_band <> '') where rn = 1) r on r.taxon = f.taxon"""),
    "multiplicity": from_final(f"select candidates_bin, bands, count(*) as n from (select {bins('n_candidates', CANDIDATE_EDGES, CANDIDATE_REST)} as candidates_bin, bands from final_t) where candidates_bin is not null group by 1, 2"),
    "heat_tiles": from_final(f"""select final_band, score_bin, tie_bin, n, tier_n from (select final_band, (round_even(top_score / 25.0::double, 0) * 25)::double as score_bin,
        {bins('n_top_ties', TIE_EDGES, TIE_REST)} as tie_bin, count(*) as n from rescued where not is_not_found group by 1, 2, 3)
        join (select final_band, count(*) as tier_n from rescued where not is_not_found group by 1) using (final_band) where tie_bin is not null""", RESCUED),
    "heat_grid": from_final(f"""select g.final_color, g.top_score, g.ties_bin, coalesce(c.n, 0) as n, max(coalesce(c.n, 0)) over w as n_max,
        (sum(coalesce(c.n, 0)) over w)::bigint as tier_n,
        case when max(coalesce(c.n, 0)) over w > 0 then coalesce(c.n, 0) / (max(coalesce(c.n, 0)) over w)::double else 0 end as intensity
        from (select * from (select distinct final_color from rescued), (select unnest([{', '.join(map(str, SCORE_LEVELS))}])::bigint as top_score),
        (select unnest([{_ALL_BINS}]) as ties_bin)) g
        left join (select final_color, top_score, {_ZERO} as ties_bin, count(*) as n from rescued group by 1, 2, 3) c using (final_color, top_score, ties_bin)
        window w as (partition by g.final_color)""", RESCUED),
    "rescue_flow": from_final("""select 'All Taxa' as source, bands as target, count(*) as value from final_t group by bands
        union all select 'auto-accept', 'green', count(*) from final_t where bands = 'auto-accept'
        union all select f.bands, r.final_color, count(*) from final_t f join rescued r on r.taxon = f.taxon where f.bands <> 'auto-accept' group by 1, 2 """.replace("group by 1, 2", "group by f.bands, r.final_color"), RESCUED),
    "compare_panels": from_final("select pos, direction, label from cmp", COMPARED),
    "panel_points": from_final(f"""select source, band, direction, count(*) as n from (select 'DIABLO name' as source, own_band as band, direction from cmp
        union all select 'MetaPhlAn name', other_band, direction from cmp) where band in ({', '.join(lit(b) for b in V.FINAL_BANDS)}) group by 1, 2, 3""", COMPARED),
    "changed_segments": from_final("select own_band, other_band, direction, count(*) as n from cmp where band_changed group by 1, 2, 3", COMPARED),
    "comparable_groups": from_final("""select p.l as "left", p.r as "right" from (values ('flag', 'grey-zone'), ('flag', 'none'), ('none', 'other')) as p(l, r)
        left join (select bands, stddev_samp(j_score) as sd from final_t group by bands) a on a.bands = p.l
        left join (select bands, stddev_samp(j_score) as sd from final_t group by bands) b on b.bands = p.r where coalesce(a.sd, 0) > 0 or coalesce(b.sd, 0) > 0"""),
    "typed_mapping": from_final("""select pos, j_score, case when pos % 3 = 0 then null else n_candidates::bigint end as n_candidates, pos % 2 = 0 as has_gs,
        top_score::double as top_score from final_t"""),
}
