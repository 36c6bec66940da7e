"""SQL fragments for checking the operators in another engine.

They state the same rules in plain SQL with list functions. The engine's regular
expressions have no look-around, so boundaries are matched and left out of the group.
"""

from ..functions import vocab as V

CC = "|".join(V.COLLECTION_PREFIXES)


def lit(text):
    return "'" + text.replace("'", "''") + "'"


def strings(values):
    return "[" + ", ".join(lit(v) for v in values) + "]"


def in_list(x, values):
    return f"{x} in ({', '.join(lit(v) for v in values)})"


def let(value, name, body):
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def sub(x, pattern, to, flags="g"):
    return f"regexp_replace({x}, {lit(pattern)}, {lit(to)}, {lit(flags)})"


def squish(x):
    return f"trim({sub(x, r'\s+', ' ')})"


def words(x):
    return f"list_filter(string_split({squish(x)}, ' '), lambda w_: w_ <> '')"


def clean(x):
    s = sub(x, r"^\[([^\]]+)\]", r"\1", "")
    s = sub(s, r"\b([A-Za-z]{1,4})-([0-9]+)\b", r"\1 \2")
    return squish(sub(s, "[,;]+", ""))


def authorless(x):
    s = sub(x, r"\([^()]*\b(ex|et\s+al\.?)\b[^()]*\d{4}[^()]*\)", "", "gi")
    return sub(s, r"\bex\s+[A-Z][a-z]+(?:\s+et\s+al\.?)?\s+\d{4}\b", "", "gi")


def tokens(x):
    text = authorless(sub(x, r"\[([^\]]+)\]", r"\1"))
    flat = sub(sub("translate(text_, ' :-./+()=', '_________')", "substr_|str_|subsp_", ""), "_{2,}", "_")
    written = (
        rf"list_transform(regexp_extract_all(text_, '(?i)\b(?:{CC})\s*[-/]?[A-Z]*\s*\d+[A-Za-z0-9-]*\b'), "
        "lambda c_: regexp_replace(c_, '[^A-Za-z0-9]+', '_', 'g'))"
    )
    under = rf"regexp_extract_all(flat_, '(?i)(?:^|[^A-Za-z0-9])((?:{CC})(?:_[A-Z]+)?_\d+[A-Za-z0-9-]*)', 1)"
    compact = rf"regexp_extract_all(flat_, '(?i)(?:^|[^A-Za-z0-9])((?:{CC})[A-Z]*\d+[A-Za-z0-9-]*)', 1)"
    codes = f"list_distinct(list_concat(list_concat({written}, {under}), {compact}))"
    body = (
        "list_sort(list_distinct(list_concat(list_filter(string_split(flat_, '_'), "
        "lambda p_: p_ <> '' and not list_contains(flatten(list_transform(codes_, "
        "lambda k_: string_split(k_, '_'))), p_)), codes_)))"
    )
    return let(text, "text_", let(flat, "flat_", let(codes, "codes_", body)))


def is_code(t):
    return f"regexp_matches({t}, '(?i)^({CC})_[A-Za-z0-9-]+$')"


def codes_of(toks):
    return f"list_filter({toks}, lambda t_: {is_code('t_')})"


def plain_of(toks):
    return f"list_filter({toks}, lambda t_: not {is_code('t_')})"


def choose(codes, shared=None):
    pool = codes
    if shared:
        both = f"list_intersect({codes}, {shared})"
        pool = f"case when len({both}) > 0 then {both} else {codes} end"
    rank = f"coalesce(nullif(list_position({strings(V.COLLECTION_PREFIXES)}, regexp_extract(t_, '^([A-Z]+)_.*$', 1)), 0), 99)"
    ranked = f"list_sort(list_transform({pool}, lambda t_: {{'r': {rank}, 't': t_}}))"
    return f"{ranked}[1].t"


def distance(pa, pb, ca, cb):
    """Distance from plain tokens and codes of both sides."""
    hit = f"(case when len(list_intersect({ca}, {cb})) > 0 then 1 else 0 end)"
    inter = f"(len(list_intersect({pa}, {pb})) + {hit})"
    size = lambda p, c: f"(len({p}) + case when len({c}) > 0 then 1 else 0 end)"
    union = f"({size(pa, ca)} + {size(pb, cb)} - {inter})"
    return f"case when {union} = 0 then 1.0::double else 1.0::double - {inter}::double / {union}::double end"


def anchor(x):
    opened = sub(squish(x), r"\[([A-Za-z][^\]]*)\]", r"\1")
    c = lambda i: f"rtrim(coalesce(w_a[{i}], ''), '.,;')"
    low = lambda i: f"lower({c(i)})"
    join = lambda *p: "concat_ws(' ', " + ", ".join(p) + ")"
    n = "len(w_a)"

    def blocked(i, short=True):
        test = (
            rf"(regexp_matches({c(i)}, '\d') or (regexp_matches({c(i)}, '[A-Z]') and not regexp_matches({c(i)}, '[a-z]'))"
            f" or {in_list(low(i), V.CONTEXT_STOPS)}"
        )
        return test + (f" or length({c(i)}) <= 2)" if short else ")")

    heads = lambda i: in_list(low(i), V.HEADS)
    sp = lambda i: in_list(low(i), V.PLACEHOLDERS)
    up = lambda i: f"regexp_matches(w_a[{i}], '^[A-Z]')"
    ep = lambda i: f"regexp_matches({c(i)}, '^[a-z][a-z-]*$')"
    cand = f"{n} >= 3 and {in_list(low(1), ['candidatus', chr(34) + 'candidatus' + chr(34)])} and {up(2)}"
    described = f"""case when {n} < 2 then {c(1)}
        when {low(2)} = 'bacterial' and {n} >= 3 and {heads(3)} then {join(c(1), "'bacterial'", c(3))}
        when {blocked(2)} then {c(1)}
        when {in_list(low(2), V.DESCRIPTIVE_ENDS)} or {n} < 3 then {join(c(1), c(2))}
        when {low(3)} = 'bacterial' and {n} >= 4 and {heads(4)} then {join(c(1), c(2), "'bacterial'")}
        when {blocked(3)} then {join(c(1), c(2))}
        else {join(c(1), c(2), c(3))} end"""
    body = f"""case when {n} = 0 then null
        when {cand} and {sp(3)} then {join(c(2), low(3))}
        when {cand} and {ep(3)} then {join(c(2), c(3))}
        when {n} >= 2 and {up(1)} and {sp(2)} then {join('w_a[1]', low(2))}
        when {n} >= 2 and {up(1)} and {ep(2)} then {join('w_a[1]', c(2))}
        when {n} >= 2 and {in_list(low(1), V.MODIFIERS)} and {heads(2)} then {join(c(1), c(2))}
        when {low(1)} = 'uncultured' and {n} >= 3 and {up(2)} and {sp(3)} then {join("'uncultured'", c(2), low(3))}
        when {low(1)} = 'uncultured' and {n} >= 2 and {up(2)} then {join("'uncultured'", c(2), "'sp'")}
        when {in_list(low(1), V.DESCRIPTIVE_STARTS)} then {described}
        when {n} >= 3 and {in_list(low(2), V.MODIFIERS)} and {heads(3)} then {join(c(1), c(2), c(3))}
        when {n} >= 3 and {low(2)} = 'bacterial' and {heads(3)} then {join(c(1), "'bacterial'", c(3))}
        when {n} >= 2 and {in_list(low(2), V.HEADS + ['bacterial'])} then
            case when {n} >= 3 and not {blocked(3, False)} then {join(c(1), c(2), c(3))} else {join(c(1), c(2))} end
        when {n} >= 2 then {join(c(1), c(2))}
        else {c(1)} end"""
    return let(words(opened), "w_a", body)


def descriptive(x):
    return let(
        f"list_transform({words(x)}, lambda w_: lower(w_))",
        "d_",
        f"coalesce({in_list('d_[1]', V.DESCRIPTIVE_STARTS)} or ({in_list('d_[1]', V.MODIFIERS)} and {in_list('d_[2]', V.HEADS)}), false)",
    )


def rest_after(s, pattern_sql):
    return f"regexp_replace({s}, concat('(?is)^.*?(?:', {pattern_sql}, ')'), '')"


def filled(x):
    return f"nullif({x}, '')"


def code_pair(text):
    fits = (
        "(" + rf"((regexp_matches(q_.a, '^[A-Za-z][A-Za-z0-9]{{0,6}}$') and not {in_list('lower(q_.a)', V.CONTEXT_NOUNS)})"
        r" or regexp_matches(q_.a, '^[A-Za-z][A-Za-z0-9]{0,6}[-_./]$'))"
        r" and regexp_matches(q_.b, '^\d+[A-Za-z0-9-]*$') and lower(q_.a) not in ('et', 'al', 'ex')"
        r" and not regexp_matches(q_.b, '^(19|20)\d{2}$'))"
    )
    pairs = "list_transform(range(1, len(z_)), lambda i_: {'a': z_[i_], 'b': z_[i_ + 1]})"
    body = let(
        f"list_filter({pairs}, lambda q_: {fits})[1]",
        "f_",
        "case when f_.b is null then null else concat(rtrim(f_.a, '-_./'), ' ', f_.b) end",
    )
    return let(rf"regexp_extract_all({text}, '[A-Za-z0-9\-_/]+')", "z_", body)


def digit_token(text):
    digits = r"list_filter(y_, lambda t_: regexp_matches(t_, '\d'))"
    mixed = rf"list_filter(y_, lambda t_: regexp_matches(t_, '\d') and regexp_matches(t_, '[A-Za-z]'))"
    longest = f"list_sort(list_transform({mixed}, lambda t_: {{'n': -length(t_), 't': t_}}))[1].t"
    body = f"nullif(rtrim(coalesce({longest}, {digits}[-1]), '._/-'), '')"
    return let(r"regexp_extract_all(" + text + r", '[A-Za-z0-9._/-]+')", "y_", body)


def subspecies(name, anc):
    s = sub(squish(name), r"\[([A-Za-z][^\]]*)\]", r"\1")
    lead = (
        rf"""case when regexp_matches(s_, '(?i)^\s*"?candidatus"?\s+') and not starts_with(lower({anc}), 'candidatus ') then 'Candidatus ' else '' end"""
    )
    infra = r"\b(?:subsp(?:\.|ecies)?|pv\.?|pathovar|var\.?|variety|biovar|serovar)\s+([A-Za-z][A-Za-z0-9-]*)\b"
    plain = f"case when lead_ = '' then {anc} else trim(concat(lead_, {anc})) end"
    out = "concat(lead_, g_[1], ' ', g_[2])"
    gs = r"concat('\b\Q', g_[1], '\E\s+\Q', g_[2], '\E')"
    tail = rest_after("s_", rf"concat({gs}, '\b')")
    epithet = filled(f"regexp_extract(tail_, {lit('(?i)' + infra)}, 1)")
    code = filled(
        rf"trim(regexp_replace(regexp_extract(post_, '(?i)\b(?:{CC})\s*[-_/]?\s*[A-Z]*\s*\d+[A-Za-z0-9-]*\b'), '[\s/_-]+', ' ', 'g'))"
    )
    more = let(
        rest_after("tail_", lit(infra)), "post_",
        f"coalesce({code}, {code_pair('post_')}, {digit_token('post_')})",
    )
    below = f"case when {epithet} is not null then concat_ws(' ', {out}, {epithet}, {more}) end"
    pair_rx = r"(?i)\b(O\d+[A-Za-z]?)\s*[:\-_ ]\s*((?:H|K)\d+[A-Za-z]?)\b"
    pair = (
        f"case when regexp_matches(tail_, {lit(pair_rx)}) then concat(upper(regexp_extract(tail_, {lit(pair_rx)}, 1)), ':', "
        f"upper(regexp_extract(tail_, {lit(pair_rx)}, 2))) end"
    )
    lone = filled(r"upper(regexp_extract(tail_, '(?i)\b(O\d+[A-Za-z]?)\b', 1))")
    grid = filled(squish(r"regexp_extract(tail_, '(?i)\b(?:\d+(?:\s+\d+)+)\s+([A-Za-z]*[A-Za-z]\d[A-Za-z0-9-]*)\b')"))
    rank = f"coalesce(nullif(list_position({strings([p.upper() for p in V.COLLECTION_PREFIXES])}, upper(string_split(t_, '_')[1])), 0), 999)"
    ranked = f"translate(list_sort(list_transform({codes_of(tokens('s_'))}, lambda t_: {{'r': {rank}, 't': t_}}))[1].t, '_', ' ')"
    implied = let(
        filled(rf"regexp_extract(s_, concat('(?i)', {gs}, '\s+([a-z][a-z0-9-]*)\b'), 1)"), "u_",
        f"case when not {in_list('lower(u_)', V.CONTEXT_STOPS)} and not regexp_matches(u_, {lit(V.ADMIN_WORD)})"
        f" and not {in_list('upper(u_)', V.COLLECTION_PREFIXES)}"
        r" and not regexp_matches(u_, '(?i)^O\d+[A-Za-z]?$') and not regexp_matches(u_, '(?i)^(H|K)\d+[A-Za-z]?$') then u_ end",
    )
    extra = f"coalesce({pair}, {lone}, {grid}, {ranked}, {code_pair('tail_')}, {implied}, {digit_token('tail_')})"
    beside = let(extra, "x_", f"case when x_ is not null then concat({out}, ' ', x_) end")
    full = let(tail, "tail_", f"coalesce({below}, {beside}, {plain})")
    body = let(
        lead, "lead_",
        let(words(anc), "g_", f"case when len(g_) < 2 or lower(g_[2]) in ('sp', 'spp') then {plain} else {full} end"),
    )
    return f"case when {anc} is null or {anc} = '' or {descriptive(anc)} then {anc} else {let(s, 's_', body)} end"


def word_count(a):
    u = sub("t_w", r"\b(O\d+[A-Za-z]?)[:\-_ ]((?:H|K)\d+[A-Za-z]?)\b", r"\1:\2", "gi")
    u = sub(u, rf"\b({CC})\s+([A-Za-z0-9-]+)\b", r"\1_\2", "gi")
    u = sub(u, r"\bet\s+al\b", " ", "gi")
    u = sub(u, r"\b(?:al|ex)\b", " ", "gi")
    u = sub(u, r"\b(18|19|20)\d{2}\b", " ")
    bare = sub(squish(a), r'^\s*"?candidatus"?\s+', "", "i")
    return (
        f"case when {a} is null or {squish(a)} = '' then 0 else "
        + let(bare, "t_w", f"case when {descriptive('t_w')} then 2 else len({words(u)}) end")
        + " end"
    )


def has_code(x):
    rx = (
        rf"(?i)\b(?:{CC})\s*[-_/]?[A-Z]*\s*\d+[A-Za-z0-9-]*\b|"
        r"\b[A-Za-z][A-Za-z0-9]{1,6}[-_./]?\s*\d+[A-Za-z0-9-]*\b"
    )
    return f"case when regexp_matches({x}, {lit(rx)}) then 1 else 0 end"


def species_key(x):
    s = sub(squish(x), r"\s*\([^)]*\)\s*", " ")
    s = sub(s, r"\s+\bex\b\s+.*$", "", "i")
    s = sub(s, r"^\s*Candidatus\s+", "", "i")
    s = sub(s, V.INFRASPECIFIC + ".*$", "", "is")
    return squish(sub(s, V.LOOSE_PUNCT, " "))


def plain_name(x):
    return squish(sub(x, "^NAME::", "", ""))


def binomial(x):
    opened = sub(squish(x), r"^\[([^\]]+)\]\s*", r"\1 ", "")
    return let(
        opened, "o_",
        let(words("o_"), "b_", "case when len(b_) >= 2 then concat(b_[1], ' ', b_[2]) else o_ end"),
    )


def canonical(x):
    return f"lower({squish(f'translate({x}, {lit('/_-.')}, {lit('    ')})')})"


def placeholder(c):
    return rf"regexp_matches({c}, '^\w+\s+sp(\s|$)')"


def id_parts(x):
    return f"list_filter(string_split(translate({x}, '=:-./+()', '________'), '_'), lambda t_: t_ <> '')"


def model_gs(x):
    return let(
        id_parts(x), "m_",
        "case when len(m_) >= 2 and regexp_matches(m_[1], '^[A-Z]') then concat(m_[1], ' ', m_[2]) end",
    )


def strict_id(x):
    return f"lower(trim({sub(x, r'[^A-Za-z0-9]+', '_')}, '_'))"


def strict_parts(x):
    return f"list_filter(string_split({strict_id(x)}, '_'), lambda t_: t_ <> '')"


def strain_token(x):
    toks = f"list_transform({words(x)}, lambda r_: regexp_replace(r_, '[^A-Za-z0-9_.-]', '', 'g'))"
    return f"list_filter({toks}, lambda t_: not {in_list('lower(t_)', V.STRAIN_STOPS)} and regexp_matches(t_, {lit(V.STRAIN_TOKEN)}))[-1]"


def variants(x):
    def first(*xs):
        return "coalesce(" + ", ".join(filled(v) for v in xs) + ")"

    bare = f"trim({sub('n_', r'\s*\([^)]*\)\s*', ' ')})"
    flat = squish(sub(first("bare_", "n_"), V.LOOSE_PUNCT, " "))
    cand = squish(sub(first("flat_v", "bare_", "n_"), r"^\s*Candidatus\s+", "", "i"))
    cut = squish(sub(first("cand_", "flat_v", "bare_", "n_"), V.INFRASPECIFIC + ".*$", "", "is"))
    infra = squish(sub(cut, r"\bsp\.?\s+\S.*$", "sp.", "i"))
    base = first("infra_", "cand_", "flat_v", "bare_", "n_")
    lst = (
        f"[n_, bare_, flat_v, cand_, infra_, {species_key('n_')}, tk_, "
        "case when tk_ is not null and ge_ is not null then concat(ge_, ' ', tk_) end, ge_]"
    )
    ordered = (
        f"list_filter({lst}, lambda v_, i_: v_ is not null and v_ <> '' and list_position({lst}, v_) = i_)"
    )
    body = let(strain_token(base), "tk_", let(f"{words(base)}[1]", "ge_", ordered))
    return let(squish(x), "n_", let(bare, "bare_", let(flat, "flat_v", let(cand, "cand_", let(infra, "infra_", body)))))


def percent(part, whole):
    return f"case when {whole} = 0 then 0.0 else cast(printf('%.1f', ({part})::double / ({whole})::double * 100) as double) end"


def rounded(x, digits):
    return f"cast(printf('%.{digits}f', {x}) as double)"


def band(j, gs):
    return (
        f"case when {j} >= 0.9::double and {gs} then 'auto-accept' when {j} >= 0.3::double and {gs} then 'grey-zone' "
        f"when {j} >= 0.3::double then 'flag' else 'not-accept' end"
    )
