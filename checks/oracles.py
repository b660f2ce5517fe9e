"""The same queries as SQL text for an independent engine, one statement per key.

Small text builders hold what several statements share. Nothing here imports the library.
"""

from __future__ import annotations

WORDS = (
    r"list_transform(list_slice(list_sort(list_transform(list_distinct(list_filter("
    r"string_split(regexp_replace(text, '[^\p{L}]+', ' ', 'g'), ' '), lambda x: x <> '')), "
    r"lambda x: struct_pack(n := -length(x), w := x))), 1, 6), lambda k: k.w)"
)
DOCW = rf"docw AS (SELECT doc_id, lang, source, n_chars, {WORDS} AS w FROM documents WHERE regexp_matches(text, '\p{{L}}'))"


def norm(x: str) -> str:
    stripped = rf"regexp_replace(strip_accents(replace({x}, 'ß', 'ss')), '\p{{Mn}}+', '', 'g')"
    return rf"coalesce(trim(upper(regexp_replace({stripped}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))), '')"


def key(x: str) -> str:
    return f"array_to_string(list_sort(string_split({norm(x)}, ' ')), ' ')"


def docnorm(x: str) -> str:
    return rf"coalesce(upper(regexp_replace({x}, '[\s\-.,/]+', '', 'g')), '')"


def rowid(table: str, *parts: str) -> str:
    return f"sha256(concat_ws('|', '{table}', {', '.join(f"coalesce('=' || {p}, '-')" for p in parts)}))"


def pick(k: str, values: list) -> str:
    parts = [f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'") for i, v in enumerate(values)]
    return f"CASE {k} % {len(values)} {' '.join(parts)} END"


ENT = f"""ent0 AS (SELECT doc_id, cast(doc_id AS VARCHAR) entity_id,
  {pick("cast(substr(source, 4) AS INT)", ["OFAC", "UN", "EU", "UK", "OTHER"])} source,
  CASE lang WHEN 'en' THEN 'individual' WHEN 'de' THEN 'entity' WHEN 'fr' THEN 'vessel' ELSE 'aircraft' END entity_type,
  array_to_string(list_slice(w, 1, 2), ' ') primary_name, nullif(array_to_string(list_slice(w, 3, 4), ' '), '') alias_name,
  w[1] first_name, w[2] last_name, cast(1940 + doc_id % 60 AS VARCHAR) || '-01-15' date_of_birth,
  {pick("doc_id", ["Panama", "Russia", "Iran", "Cuba", "Germany"])} nationality,
  {pick("doc_id", [None, None, "Iran", None, None, "Cuba", None])} citizenship,
  'PA-' || cast(doc_id // 2 AS VARCHAR) || '-0' document_number,
  {pick("doc_id", ["Passport", "National ID", "Passport"])} document_type,
  CASE WHEN lang = 'fr' THEN 'IMO ' || cast(9000000 + doc_id AS VARCHAR) END vessel_imo,
  'PRG-' || cast(n_chars % 9 AS VARCHAR) program, doc_id % 40 = 0 is_deleted
  FROM docw),
ent AS (SELECT *, list_distinct_ordered(primary_name, alias_name) all_names FROM ent0)"""
# both names, the second only if it is there and another
ENT = ENT.replace(
    "list_distinct_ordered(primary_name, alias_name)",
    "CASE WHEN alias_name IS NULL OR alias_name = primary_name THEN [primary_name] ELSE [primary_name, alias_name] END",
)
REQ = f"""req AS (SELECT doc_id request_id,
  CASE doc_id % 5 WHEN 0 THEN lower(concat_ws(' ', w[2], w[1])) WHEN 1 THEN array_to_string(list_slice(w, 1, 2), ' ') || 'e'
   WHEN 2 THEN array_to_string(list_slice(w, 1, 1), ' ') WHEN 3 THEN concat_ws(', ', w[3], w[2])
   ELSE array_to_string(list_slice(w, 5, 6), ' ') END AS name,
  CASE doc_id % 4 WHEN 1 THEN 'pa ' || cast(doc_id // 2 AS VARCHAR) || ' 0' WHEN 3 THEN 'ZZ.' || cast(doc_id // 2 AS VARCHAR) END document_number,
  {pick("doc_id", [None, "passport", "NATIONAL ID"])} document_type,
  CASE WHEN doc_id % 2 = 1 THEN cast(1940 + doc_id % 60 + doc_id % 3 AS VARCHAR) END date_of_birth,
  {pick("doc_id", ["PANAMA", "Rus", "Iran", None, None])} nationality,
  {pick("doc_id", [None, None, "Federal Germany"])} country, lang
  FROM docw)"""
NAMES = f"nm AS (SELECT source, entity_id, pos, name, {key('name')} k FROM (SELECT source, entity_id, unnest(all_names) name, generate_subscripts(all_names, 1) pos FROM ent))"
# the same table without the requests that input validation refuses
VREQ = REQ.replace("req AS (", "req0 AS (") + r""", req AS (SELECT * FROM req0 WHERE length(trim(name)) >= 2 AND length(name) <= 200
  AND NOT regexp_matches(name, '[<>{}\[\]|\\;`$\p{C}]'))"""
RKEYS = f"rk AS (SELECT *, {key('name')} k FROM req)"


def scores(left: str, right: str, pairs: str | None = None, minimum: float = 60) -> str:
    """CTEs up to sc(ak, bk, s): common subsequence by bit vectors over all pairs of two key sets."""
    every = f"(SELECT k FROM {left} WHERE k <> '' UNION SELECT k FROM {right} WHERE k <> '')"
    source = (
        f"(SELECT DISTINCT ak, bk FROM {pairs}) p JOIN mm a ON a.k = p.ak JOIN cl b ON b.k = p.bk"
        if pairs
        else f"(SELECT mm.* FROM mm WHERE k IN (SELECT k FROM {left})) a JOIN (SELECT cl.* FROM cl WHERE k IN (SELECT k FROM {right})) b "
        f"ON 200 * least(la, lb) >= {minimum} * (la + lb)"
    )
    return f"""chars AS (SELECT k, i, substr(k, i, 1) c FROM (SELECT k, unnest(range(1, length(k) + 1))::INT i FROM {every})),
ab AS (SELECT c, row_number() OVER (ORDER BY c) code FROM (SELECT DISTINCT c FROM chars)),
bits AS (SELECT k, code, sum(1::HUGEINT << (i - 1))::HUGEINT b FROM chars JOIN ab USING (c) GROUP BY 1, 2),
mm AS (SELECT k, (1::HUGEINT << length(k)::INT) - 1 msk, length(k) la, list(coalesce(b, 0::HUGEINT) ORDER BY code) mp
  FROM (SELECT q.k, ab.code FROM {every} q, ab) LEFT JOIN bits USING (k, code) GROUP BY k),
cl AS (SELECT k, length(k) lb, list(code::HUGEINT ORDER BY i) cs FROM chars JOIN ab USING (c) GROUP BY k),
sc AS (SELECT a.k ak, b.k bk, 200::DOUBLE * (la - bit_count(list_reduce(list_prepend(msk, cs),
  lambda v, c: ((v + (v & mp[c::BIGINT])) | (v & ~mp[c::BIGINT])) & msk))) / (la + lb) s FROM {source})"""


def year(x: str) -> str:
    return rf"try_cast(nullif(regexp_extract({x}, '(\d{{4}})', 1), '') AS INT)"


def short(x: str) -> str:
    words = rf"list_filter(string_split(regexp_replace({x}, '\s+', ' ', 'g'), ' '), lambda q: q <> '')"
    return f"((len({words}) <= 2 AND length({x}) < 10) OR len(list_filter({words}, lambda q: length(q) <= 2)) > 0)"


def wanted(nat: str, country: str) -> str:
    return f"list_filter([upper({nat}), upper({country})], lambda q: q IS NOT NULL)"


def listed(*columns: str) -> str:
    return f"list_distinct(list_filter([{', '.join(f'upper({c})' for c in columns)}], lambda q: q IS NOT NULL))"


NATFLAG = """CASE WHEN len(list_filter(wanted, lambda a: list_contains(listed, a))) > 0 THEN 'NATIONALITY_EXACT_MATCH_INFO'
 WHEN len(list_filter(wanted, lambda a: len(list_filter(listed, lambda b: least(length(a), length(b)) >= 4
  AND (starts_with(b, a) OR ends_with(b, a) OR starts_with(a, b) OR ends_with(a, b)))) > 0)) > 0 THEN 'NATIONALITY_SUBSTRING_MATCH_INFO' END"""


def dob(a: str, b: str) -> str:
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN greatest(0::DOUBLE, 100 - 20 * abs({a} - {b}))::DOUBLE ELSE 0::DOUBLE END"


# All matches of every request: exact documents, then names, then the best ten.
SCREEN = f"""{DOCW}, {ENT}, {VREQ}, {NAMES}, {RKEYS}, {scores('rk', 'nm')},
rq AS (SELECT *, nullif({docnorm('document_number')}, '') dk, {year('date_of_birth')} ry, {short('name')} is_short, {wanted('nationality', 'country')} wanted FROM rk),
en AS (SELECT *, {docnorm('document_number')} edk, {docnorm('vessel_imo')} imok, {year('date_of_birth')} ey, {listed('nationality', 'citizenship')} listed FROM ent),
exact AS (SELECT request_id, e.source, e.entity_id, e.entity_type, e.primary_name matched_name,
  CASE WHEN dk = edk AND (r.document_type IS NULL OR upper(r.document_type) = upper(e.document_type)) THEN e.document_number ELSE e.vessel_imo END matched_document,
  100::DOUBLE overall, 100::DOUBLE name_score, 100::DOUBLE document_score, 0::DOUBLE dob_score, 1 match_layer, 'DOCUMENT_EXACT_MATCH' flags, 'AUTO_ESCALATE' recommendation
  FROM rq r JOIN en e ON (dk = edk AND (r.document_type IS NULL OR upper(r.document_type) = upper(e.document_type))) OR dk = imok),
best AS (SELECT r.request_id, n.source, n.entity_id, max(s) name_score, arg_max(n.name, s * 1000 - n.pos * 1e-6) matched_name
  FROM rq r JOIN sc ON sc.ak = r.k JOIN nm n ON n.k = sc.bk WHERE s >= 60 GROUP BY ALL),
fuzzy AS (SELECT b.*, e.entity_type, r.is_short, r.document_number IS NOT NULL has_document,
  CASE WHEN dk = edk THEN 100::DOUBLE ELSE 0::DOUBLE END document_score, CASE WHEN dk = edk THEN e.document_number END matched_document,
  {dob('ry', 'ey')} dob_score, {NATFLAG} nat_flag
  FROM best b JOIN rq r USING (request_id) JOIN en e USING (source, entity_id)
  WHERE NOT EXISTS (SELECT 1 FROM exact x WHERE x.request_id = b.request_id AND x.source = b.source AND x.entity_id = b.entity_id)),
decided AS (SELECT request_id, source, entity_id, entity_type, matched_name, matched_document, name_score overall, name_score, document_score, dob_score,
  CASE WHEN document_score = 100 THEN 1 WHEN name_score >= 85 AND (nat_flag IS NOT NULL OR dob_score >= 60) THEN 2 WHEN name_score >= 70 THEN 3 ELSE 4 END match_layer,
  concat_ws('|', CASE WHEN document_score = 100 THEN 'DOCUMENT_MATCH' END, CASE WHEN is_short THEN 'SHORT_NAME_QUERY' END, nat_flag,
   CASE WHEN document_score = 0 AND has_document THEN 'NO_DOCUMENT_MATCH' END, CASE WHEN entity_type = 'entity' THEN 'ENTITY_MATCH' END) flags,
  CASE WHEN name_score >= 95 THEN 'AUTO_ESCALATE' WHEN name_score >= 85 THEN 'MANUAL_REVIEW' WHEN name_score >= 60 THEN 'LOW_CONFIDENCE_REVIEW' ELSE 'AUTO_CLEAR' END recommendation
  FROM fuzzy WHERE name_score >= 75 OR document_score = 100),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY overall DESC, match_layer, source, entity_id)::INT match_rank
  FROM (SELECT * FROM exact UNION ALL BY NAME SELECT * FROM decided)),
mt AS (SELECT request_id, match_rank, source, entity_id, entity_type, matched_name, matched_document, round(overall, 2) overall, round(name_score, 2) name_score,
  round(document_score, 2) document_score, round(dob_score, 2) dob_score, match_layer, recommendation, flags FROM ranked WHERE match_rank <= 10),
res AS (SELECT r.request_id, r.name, r.document_number, r.country, r.lang, n IS NOT NULL is_hit, coalesce(n, 0) hit_count, coalesce(top, 0::DOUBLE) max_confidence, recommendation, matches
  FROM req r LEFT JOIN (SELECT request_id, count(*) n, max(overall) top, arg_min(recommendation, match_rank) recommendation,
   string_agg(source || '/' || entity_id, '|' ORDER BY match_rank) matches FROM mt GROUP BY 1) USING (request_id))"""

# The same with overall scores of name, document and birth year, and 70 as the threshold.
SCREENW = SCREEN.replace("name_score overall, name_score, document_score, dob_score,\n", "ov overall, name_score, document_score, dob_score,\n")
SCREENW = SCREENW.replace("CASE WHEN name_score >= 95 THEN 'AUTO_ESCALATE' WHEN name_score >= 85 THEN 'MANUAL_REVIEW' WHEN name_score >= 60", "CASE WHEN ov >= 95 THEN 'AUTO_ESCALATE' WHEN ov >= 85 THEN 'MANUAL_REVIEW' WHEN ov >= 60")
SCREENW = SCREENW.replace(
    "FROM fuzzy WHERE name_score >= 75 OR document_score = 100",
    "FROM (SELECT *, least(100, greatest(0, name_score * 0.7::DOUBLE + document_score * 0.1::DOUBLE + dob_score * 0.2::DOUBLE)) ov FROM fuzzy) WHERE ov >= 70 OR document_score = 100",
)

PAIR = f"""{DOCW}, {ENT}, {REQ},
own0 AS (SELECT r.*, e.entity_id, e.entity_type, e.primary_name, e.date_of_birth entity_dob, e.document_number entity_document,
  {wanted('r.nationality', 'r.country')} wanted, {listed('e.nationality', 'e.citizenship')} listed
  FROM req r JOIN ent e ON e.doc_id IN (r.request_id, r.request_id + 1)),
own AS (SELECT *, {key('name')} ak, {key('primary_name')} bk,
  CASE WHEN {docnorm('document_number')} = {docnorm('entity_document')} THEN 100::DOUBLE ELSE 0::DOUBLE END document_score,
  {dob(year('date_of_birth'), year('entity_dob'))} dob_score, {NATFLAG} nat_flag FROM own0)"""
PAIRSCORE = PAIR + ", lk AS (SELECT ak k FROM own UNION SELECT bk FROM own), " + scores("lk", "lk", "own") + (
    ", scored AS (SELECT own.*, coalesce(s, 0::DOUBLE) name_score FROM own LEFT JOIN sc USING (ak, bk))"
)

# What the XML text of each entity holds, selected straight from the view.
OFACV = f"""{DOCW}, {ENT},
ox AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN 'entity' ELSE entity_type END xtype FROM ent WHERE doc_id % 50 <> 0),
oxnames AS (SELECT entity_id, xtype, primary_name, unnest(all_names) name, generate_subscripts(all_names, 1) - 1 position FROM ox)"""
UNV = f"""{DOCW}, {ENT},
ux AS (SELECT *, {pick("doc_id", ["QDi.", "TAi.", "KPe.", "bad-", "IRi."])} || cast(doc_id AS VARCHAR) ref,
  {pick("doc_id", ["Al-Qaida", "Taliban", "DPRK"])} committee,
  CASE WHEN doc_id % 3 = 0 THEN coalesce(alias_name, '') ELSE '' END third FROM ent),
uy AS (SELECT *, concat_ws(' ', nullif(first_name, ''), nullif(coalesce(last_name, ''), ''), nullif(third, '')) full_name,
  CASE WHEN doc_id % 5 <> 3 THEN substr(ref, 1, 2) END code, CASE WHEN doc_id % 5 <> 3 THEN substr(ref, 1, 3) END list_type FROM ux)"""

TOKENS = rf"""tk0 AS (SELECT source, entity_id, unnest([struct_pack(t := primary_name, w := 'A'), struct_pack(t := {norm('primary_name')}, w := 'A'),
  struct_pack(t := first_name, w := 'B'), struct_pack(t := last_name, w := 'B'), struct_pack(t := nationality, w := 'C'), struct_pack(t := date_of_birth, w := 'D')]) q FROM ent),
tk AS (SELECT DISTINCT source, entity_id, token, weight FROM (SELECT source, entity_id, unnest(string_split(regexp_replace(lower(coalesce(q.t, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')) token, q.w weight FROM tk0) WHERE token <> '')"""

CONV = rf"""cr AS (SELECT cast(conv_id AS VARCHAR) || '-' || cast(turn AS VARCHAR) request_id,
  CASE conv_id % 4 WHEN 0 THEN replace(text, chr(10), ' ') WHEN 1 THEN '<' || text WHEN 2 THEN string_split(text, ' ')[-1] ELSE text END AS name,
  {pick("conv_id", [None, "12-34.5", "a/b", None, "x" * 60])} document_number, {pick("turn", ["1980", "1980-01", "01/02/1980", None])} date_of_birth FROM conversations),
cv AS (SELECT *, CASE WHEN length(trim(name, E' \t\n\r\f\v')) < 2 THEN 'NAME_TOO_SHORT' WHEN length(name) > 200 THEN 'NAME_TOO_LONG'
  WHEN regexp_matches(name, '[<>{{}}\[\]|\;`$]') THEN 'BLOCKED_CHARACTERS' WHEN regexp_matches(name, '\p{{C}}') THEN 'CONTROL_CHARACTER'
  WHEN date_of_birth IS NOT NULL AND NOT regexp_full_match(date_of_birth, '\d{{4}}(-\d{{2}}(-\d{{2}})?)?') THEN 'INVALID_DOB_FORMAT'
  WHEN length(document_number) > 50 THEN 'DOCUMENT_TOO_LONG'
  WHEN document_number IS NOT NULL AND NOT regexp_full_match(document_number, '[A-Za-z0-9\-\s.]{{1,50}}') THEN 'INVALID_DOCUMENT_FORMAT' END error_code FROM cr)"""
FIELD = "CASE WHEN error_code IN ('NAME_TOO_SHORT','NAME_TOO_LONG','BLOCKED_CHARACTERS','CONTROL_CHARACTER') THEN 'name' WHEN error_code = 'INVALID_DOB_FORMAT' THEN 'date_of_birth' WHEN error_code IS NOT NULL THEN 'document_number' END"


def sanitized(x: str) -> str:
    s = rf"regexp_replace({x}, '[\x00-\x1f\x7f-\x{{9f}}]', ' ', 'g')"
    s = rf"regexp_replace({s}, '[\x{{200B}}-\x{{200F}}\x{{2028}}\x{{2029}}\x{{FEFF}}]', '', 'g')"
    return rf"substr(trim(regexp_replace({s}, '[\s\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')), 1, 500)"


def cut(x: str, n: int) -> str:
    return f"CASE WHEN length({sanitized(x)}) > {n} THEN substr({sanitized(x)}, 1, {n}) || '...(truncated)' ELSE {sanitized(x)} END"


def script(x: str) -> str:
    n = lambda cls: rf"length(regexp_replace({x}, '[^{cls}]+', '', 'g'))"
    ch, ar, cy = r"\x{4E00}-\x{9FFF}", r"\x{0600}-\x{06FF}", r"\x{0400}-\x{04FF}"
    rest = rf"length(regexp_replace(regexp_replace({x}, '[^\p{{L}}]+', '', 'g'), '[{ch}{ar}{cy}]+', '', 'g'))"
    total = f"({n(ch)} + {n(ar)} + {n(cy)} + {rest})"
    return (
        f"CASE WHEN {total} = 0 THEN 'latin' WHEN {n(ch)} * 2 > {total} THEN 'chinese' WHEN {n(ar)} * 2 > {total} THEN 'arabic' "
        f"WHEN {n(cy)} * 2 > {total} THEN 'cyrillic' WHEN {rest} * 2 > {total} THEN 'latin' ELSE 'mixed' END"
    )


EACHWORD = r"ew AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(regexp_replace(text, '[^\p{L}.]+', ' ', 'g'), ' ')) word FROM documents) WHERE word <> '')"


def initials(x: str) -> str:
    c = f"replace(replace({x}, '.', ''), ' ', '')"
    return rf"(length({c}) <= 4 AND regexp_full_match({c}, '\p{{L}}+') AND upper({c}) = {c} AND lower({c}) <> {c})"


def trigrams(x: str) -> str:
    words = rf"list_filter(string_split(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda q: q <> '')"
    return f"list_distinct(flatten(list_transform({words}, lambda q: list_transform(range(1, length(q) + 2), lambda i: substr('  ' || q || ' ', i::INT, 3)))))"


def similarity(a: str, b: str) -> str:
    shared = f"len(list_intersect({a}, {b}))"
    return f"({shared}::DOUBLE / (len({a}) + len({b}) - {shared}))"


BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
HIST = "hist AS (" + " UNION ALL ".join(
    f"SELECT event_type operation, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END status, '{b}' le, "
    f"count(*) FILTER ({'true' if b == '+Inf' else f'value * 4 / 1000 <= {b}'}) observations FROM events GROUP BY ALL"
    for b in [*BUCKETS, "+Inf"]
) + ")"
STATEMENTS = """st AS (SELECT (CASE WHEN event_type = 'view' THEN 'UPDATE' ELSE 'SELECT' END) || ' * FROM t_' || cast(user_id AS VARCHAR) || ' -- ' || event_type query, value FROM events),
sg AS (SELECT query, count(*) calls, sum(value) total FROM st GROUP BY 1)"""
NEWLIST = """old AS (SELECT source, entity_id, primary_name, nationality FROM ent),
new AS (SELECT source, entity_id, primary_name, CASE WHEN entity_type = 'vessel' THEN 'Nauru' ELSE nationality END nationality FROM ent WHERE entity_type <> 'aircraft'
  UNION ALL SELECT 'UN', 'P' || cast(page_id AS VARCHAR), url, 'Chad' FROM pages),
diff AS (SELECT * FROM (SELECT coalesce(o.source, n.source) source, coalesce(o.entity_id, n.entity_id) entity_id,
  CASE WHEN o.entity_id IS NULL THEN 'added' WHEN n.entity_id IS NULL THEN 'removed'
   WHEN o.primary_name <> n.primary_name OR o.nationality <> n.nationality THEN 'updated' END change
  FROM old o FULL JOIN new n ON o.source = n.source AND o.entity_id = n.entity_id) WHERE change IS NOT NULL)"""
SEEDS = "('SDGT','Specially Designated Global Terrorist','OFAC'),('SDNTK','Specially Designated Narcotics Trafficker Kingpin Act','OFAC'),('SDN','Specially Designated Nationals and Blocked Persons','OFAC'),('CYBER2','Malicious Cyber-Enabled Activities','OFAC'),('IRAN','Iran Sanctions','OFAC'),('RUSSIA','Russia Sanctions','OFAC'),('SYRIA','Syria Sanctions','OFAC'),('VENEZUELA','Venezuela Sanctions','OFAC'),('CUBA','Cuba Sanctions','OFAC'),('DPRK','North Korea Sanctions','OFAC'),('UN-CONSOLIDATED','UN Consolidated Sanctions','UN'),('UN-TALIBAN','UN Taliban Sanctions','UN'),('UN-ISIL','UN ISIL/Da''esh Sanctions','UN')"
FMT = "'%Y-%m-%d %H:%M:%S'"
MATCHCOLS = "request_id, match_rank, source, entity_id, entity_type, matched_name, matched_document, overall, name_score, document_score, dob_score, match_layer, recommendation, flags"
ERRWIN = """SELECT strftime(s, '%Y-%m-%d %H:%M:%S') window_start, strftime(s + INTERVAL 5 MINUTE, '%Y-%m-%d %H:%M:%S') window_end, count(*) calls,
  count(*) FILTER (event_type = 'error') errors, round(count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*), 6) error_percent,
  count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*) > 1 alert
  FROM (SELECT *, unnest([date_trunc('minute', ts) - to_minutes(i) FOR i IN range(0, 5)]) s FROM events) GROUP BY s"""

ORACLES: dict[str, str] = {
    "xml_ofac_entities": f"""WITH {OFACV} SELECT 'OFAC' source, entity_id, xtype entity_type, primary_name, array_to_string(all_names, '|') all_names,
  array_to_string(all_names[2:], '|') aliases, date_of_birth, nationality place_of_birth, nationality, coalesce(citizenship, '') citizenship, vessel_imo,
  entity_id crypto, program || CASE WHEN doc_id % 2 = 0 THEN '; SDN' ELSE '' END program, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END documents FROM ox""",
    "xml_un_entities": f"""WITH {UNV} SELECT 'UN' source, entity_id, 'individual' entity_type, full_name primary_name,
  array_to_string(list_filter([full_name, alias_name, first_name], lambda q: q IS NOT NULL), '|') all_names, date_of_birth, nationality, list_type un_list_type,
  code un_country_code, committee un_committee, array_to_string(list_sort(list_distinct(list_filter([nationality, citizenship], lambda q: q IS NOT NULL))), '|') countries, 1 documents FROM uy""",
    "entity_names": f"WITH {OFACV} SELECT entity_id, xtype entity_type, primary_name, position::INT position, name FROM oxnames",
    "entity_first_last": f"""WITH {OFACV} SELECT entity_id, CASE WHEN xtype = 'individual' THEN first_name END first_name,
  CASE WHEN xtype = 'individual' THEN coalesce(last_name, CASE WHEN alias_name IS NOT NULL THEN 'x' WHEN doc_id % 3 = 0 THEN 'z' END) END last_name FROM ox""",
    "entity_documents": f"""WITH {OFACV} SELECT entity_id, document_type AS type, document_number number, nationality issuing_country FROM ox
  UNION ALL SELECT entity_id, 'Unknown', 'ID ' || entity_id, NULL FROM ox WHERE doc_id % 4 = 0""",
    "entity_features": f"""WITH {OFACV} SELECT entity_id, 'Date of Birth' AS type, '1900-01-01' AS value, '8' type_id FROM ox UNION ALL SELECT entity_id, 'DOB', date_of_birth, '8' FROM ox
  UNION ALL SELECT entity_id, 'Place of Birth', nationality, '9' FROM ox UNION ALL SELECT entity_id, 'Nationality Country', nationality, '10' FROM ox
  UNION ALL SELECT entity_id, 'Citizenship Country', coalesce(citizenship, ''), '11' FROM ox UNION ALL SELECT entity_id, 'IMO Number', vessel_imo, '12' FROM ox WHERE vessel_imo IS NOT NULL
  UNION ALL SELECT entity_id, 'Digital Currency Address', entity_id, '13' FROM ox""",
    "feature_pivot": f"WITH {OFACV} SELECT entity_id, date_of_birth, nationality place_of_birth, nationality, coalesce(citizenship, '') citizenship, vessel_imo FROM ox",
    "relationships": f"WITH {OFACV} SELECT entity_id, cast(doc_id + 4 AS VARCHAR) related_entity_id, CASE WHEN doc_id % 2 = 0 THEN 'Associate' ELSE 'Unknown' END relationship_type FROM ox",
    "related_entities": f"""WITH {OFACV} SELECT a.entity_id, cast(a.doc_id + 4 AS VARCHAR) related_entity_id, CASE WHEN a.doc_id % 2 = 0 THEN 'Associate' ELSE 'Unknown' END relationship_type,
  b.primary_name related_name FROM ox a LEFT JOIN ox b ON b.doc_id = a.doc_id + 4""",
    "entity_addresses": f"WITH {OFACV} SELECT entity_id, 'City ' || cast(doc_id % 10 AS VARCHAR) city, nationality country FROM ox",
    "entity_countries": f"WITH {OFACV} SELECT entity_id, array_to_string(list_sort(list_distinct(list_filter([nationality, citizenship], lambda q: q IS NOT NULL))), '|') countries FROM ox",
    "entity_programs_text": f"WITH {OFACV} SELECT entity_id, program || CASE WHEN doc_id % 2 = 0 THEN '; SDN' ELSE '' END program FROM ox",
    "un_names": f"""WITH {UNV} SELECT entity_id, full_name primary_name, coalesce(first_name, '') first_name, coalesce(nullif(third, ''), last_name, '') last_name,
  array_to_string(list_filter([alias_name, first_name], lambda q: q IS NOT NULL), '|') aliases FROM uy""",
    "un_reference": f"WITH {UNV} SELECT entity_id, ref un_reference_number, list_type un_list_type, code un_country_code, committee un_committee FROM uy",
    "un_discovered": f"WITH {UNV} SELECT DISTINCT 'country_code' kind, code FROM uy WHERE code IS NOT NULL UNION ALL SELECT DISTINCT 'list_type', committee FROM uy",
    "all_entities": f"""WITH {OFACV}, {UNV.split(ENT + ',')[1].strip()} SELECT 'OFAC' source, entity_id, xtype entity_type, primary_name, NULL::VARCHAR un_committee FROM ox
  UNION ALL SELECT 'UN', entity_id, 'individual', full_name, committee FROM uy""",
    "search_tokens": f"WITH {DOCW}, {ENT}, {TOKENS} SELECT source, entity_id, token, weight FROM tk",
    "token_search": rf"""WITH {DOCW}, {ENT}, {REQ}, {TOKENS},
  sv AS (SELECT DISTINCT request_id search_id, unnest(string_split(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')) token FROM req),
  best AS (SELECT source, entity_id, token, max(CASE weight WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.4::DOUBLE WHEN 'C' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END) v FROM tk GROUP BY ALL)
  SELECT search_id, source, entity_id, round(sum(v), 6) AS rank, count(*) matched_tokens FROM best JOIN sv USING (token) GROUP BY 1, 2, 3""",
    "token_search_best": rf"""WITH {DOCW}, {ENT}, {REQ}, {TOKENS},
  sv AS (SELECT DISTINCT request_id search_id, unnest(string_split(regexp_replace(lower(name), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')) token FROM req),
  best AS (SELECT source, entity_id, token, max(CASE weight WHEN 'A' THEN 1.0::DOUBLE WHEN 'B' THEN 0.4::DOUBLE WHEN 'C' THEN 0.2::DOUBLE ELSE 0.1::DOUBLE END) v FROM tk GROUP BY ALL)
  SELECT search_id, source, entity_id, rank, matched_tokens FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY rank DESC, source, entity_id) n FROM
  (SELECT search_id, source, entity_id, round(sum(v), 6) AS rank, count(*) matched_tokens FROM best JOIN sv USING (token) GROUP BY 1, 2, 3)) WHERE n <= 3""",
    "csv_requests": f"WITH {DOCW}, {REQ} SELECT trim(name) AS name, trim(document_number) document_number, country FROM req WHERE trim(name) <> ''",
    "jsonl_audit": "SELECT cast(event_id AS VARCHAR) screening_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, event_type AS name, props document, event_type <> 'error' is_hit, value top_score FROM events",
    "hash_verify": """SELECT cast(doc_id AS VARCHAR) file_name, sha256(text) sha256, CASE WHEN n_chars <= 500 THEN 'new' WHEN lang = 'en' OR upper(text) = text THEN 'ok' ELSE 'mismatch' END status,
  n_chars <= 500 OR lang = 'en' OR upper(text) = text is_valid FROM documents""",
    "csv_line_breaks": r"SELECT doc_id, sha256(trim(text)) name_hash FROM documents WHERE trim(text) <> ''",
    "list_metadata": f"WITH {DOCW}, {ENT} SELECT source, count(*) record_count, true has_size, 64 hash_length, true has_date FROM ent GROUP BY 1",
    "seed_programs": f"""WITH have AS (SELECT DISTINCT upper(p_type) code FROM part UNION ALL SELECT CASE WHEN n_nationkey = 0 THEN 'IRAN' ELSE upper(n_name) END FROM nation),
  seed(code, name, authority) AS (VALUES {SEEDS})
  SELECT code, lower(code) AS name, NULL::VARCHAR authority, NULL::BOOLEAN is_active FROM have UNION ALL SELECT code, name, authority, true FROM seed WHERE code NOT IN (SELECT code FROM have)""",
    "active_entities": f"WITH {DOCW}, {ENT} SELECT source, entity_id, entity_type, primary_name FROM ent WHERE NOT is_deleted",
    "normalize_name": f"SELECT doc_id, {norm('text')} normalized FROM documents",
    "normalize_document": f"SELECT c_custkey, {docnorm('x')} normalized FROM (SELECT c_custkey, concat_ws('-', c_name, cast(cast(c_acctbal AS DECIMAL(12,2)) AS VARCHAR), c_mktsegment) x FROM customer)",
    "name_script": f"SELECT doc_id, {script('mixed')} script, {script('text')} plain_script FROM (SELECT doc_id, text, translate(text, 'aeiou', 'аеио中') mixed FROM documents)",
    "latin_initials": f"WITH {EACHWORD} SELECT word, {initials("upper(replace(word, 'ß', 'ss'))")} upper_form, {initials('word')} initials FROM ew",
    "short_name": f"""SELECT doc_id, line_no::INT line_no, {short('line')} is_short FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 line_no FROM documents)""",
    "common_name": rf"""WITH l AS (SELECT string_split(trim(regexp_replace(text, '[^\p{{L}}]+', ' ', 'g')), ' ') w FROM documents),
  p AS (SELECT unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) AS name FROM l WHERE len(w) > 1)
  SELECT upper(name) AS name, count(*) n FROM p WHERE {norm('name')} IN ('IS AND', 'THE THE', 'ET LA', 'DER DIE', 'OF THE', 'THE OF', 'AND THE') GROUP BY 1""",
    "adaptive_threshold": f"""WITH {EACHWORD}, v AS (SELECT word, CASE WHEN length(word) > 4 THEN translate(word, 'aeiou', 'аеио中') ELSE upper(replace(word, 'ß', 'ss')) END AS name FROM ew),
  s AS (SELECT word, name, {initials('name')} ini, {script('name')} scr FROM v)
  SELECT word, CASE WHEN ini THEN 98 WHEN scr = 'chinese' THEN 85 WHEN scr IN ('arabic', 'cyrillic') THEN 90 ELSE 95 END::DOUBLE threshold,
  CASE WHEN ini THEN 'latin_initials' WHEN scr IN ('chinese', 'arabic', 'cyrillic') THEN scr || '_name' ELSE 'latin_default' END reason FROM s""",
    "dob_year": f"SELECT event_id, {year('x')} AS year FROM (SELECT event_id, concat_ws('/', props, strftime(ts, '%m/%d/%Y'), cast(user_id AS VARCHAR)) x FROM events)",
    "sanitize_text": f"SELECT doc_id, {sanitized('text')} clean, {cut('text', 50)} short_form FROM documents",
    "sanitize_context": f"SELECT conv_id, turn, {cut('role', 200)} AS role, {cut('text', 200)} AS text, true has_unknown FROM conversations",
    "sanitize_nested": f"""SELECT conv_id, turn, {cut('role', 200)} AS role, {cut('text', 200)} AS text,
  array_to_string(list_transform(string_split(text, chr(10)), lambda q: {cut('q', 200)}), '|') tags, turn % 2 = 1 odd, turn number FROM conversations""",
    "report_name": rf"""WITH {DOCW}, {REQ} SELECT request_id, 'constancia_' || trim(regexp_replace(name || '/*' || coalesce(document_number, '') || '?', '[^\p{{L}}\p{{N}} _-]', '', 'g')) || '_20240203_040506' file_name FROM req""",
    "validate_requests": f"""WITH {CONV} SELECT request_id, error_code, {FIELD} error_field, CASE error_code WHEN 'NAME_TOO_SHORT' THEN 'Provide a name with at least 2 characters'
  WHEN 'NAME_TOO_LONG' THEN 'Shorten the name to 200 characters or less' WHEN 'BLOCKED_CHARACTERS' THEN 'Remove special characters like < > {{ }} [ ] | \\ ; ` $'
  WHEN 'CONTROL_CHARACTER' THEN 'Remove invisible or control characters from the name' WHEN 'INVALID_DOB_FORMAT' THEN 'Use format YYYY, YYYY-MM, or YYYY-MM-DD'
  WHEN 'DOCUMENT_TOO_LONG' THEN 'Shorten to 50 characters or less' WHEN 'INVALID_DOCUMENT_FORMAT' THEN 'Use only alphanumeric characters, spaces, hyphens, and periods' END suggestion FROM cv""".replace("\\\\", "\\"),
    "security_events": f"""WITH {CONV} SELECT request_id, 'VALIDATION_FAILED' event_type, 'WARNING' severity, field_name, error_code, {cut('bad', 50)} sanitized_input, 'screening' source
  FROM (SELECT *, {FIELD} field_name, CASE {FIELD} WHEN 'name' THEN name WHEN 'date_of_birth' THEN date_of_birth ELSE document_number END bad FROM cv WHERE error_code IS NOT NULL)""",
    "malformation_rate": f"""WITH {DOCW}, {ENT} SELECT count(*) entity_count, count(*) FILTER (doc_id % 50 = 0) malformed_count,
  round(count(*) FILTER (doc_id % 50 = 0) * 100.0::DOUBLE / count(*), 6) malformed_percent, count(*) FILTER (doc_id % 50 = 0) * 100.0 / count(*) > 1 is_error FROM ent""",
    "xsd_severity": """WITH s AS (SELECT CASE WHEN event_type IN ('error', 'view') THEN 'CRITICAL' WHEN event_type IN ('click', 'purchase') THEN 'WARNING' ELSE 'INFO' END severity FROM events)
  SELECT severity, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'info' END outcome, count(*) messages,
  (SELECT count(*) FROM s WHERE severity = 'CRITICAL') errors, (SELECT count(*) FROM s WHERE severity = 'WARNING') warnings FROM s GROUP BY 1""",
    "report_validation": """WITH m AS (SELECT l_orderkey k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount > 0.02 THEN l_returnflag ELSE '' END,
    CASE WHEN l_tax > 0.01 THEN l_linestatus END NULLS FIRST, l_returnflag <> 'N') i,
    l_discount <= 0.02 empty_name, l_tax <= 0.01 no_id, l_returnflag = 'N' no_breakdown FROM lineitem),
  g AS (SELECT k, count(*) FILTER (empty_name) e, min(i) FILTER (empty_name) fe, count(*) FILTER (no_id) ni, min(i) FILTER (no_id) fi, count(*) FILTER (no_breakdown) nb, min(i) FILTER (no_breakdown) fb FROM m GROUP BY 1)
  SELECT o_orderkey request_id, o_orderstatus <> 'P' AND coalesce(e, 0) = 0 is_valid, ((o_orderstatus = 'P')::INT + coalesce(e, 0))::INT n_errors,
  ((o_custkey % 2 <> 0)::INT + coalesce(ni, 0) + coalesce(nb, 0))::INT n_warnings,
  CASE WHEN o_orderstatus = 'P' THEN 'Missing required field: input_name' WHEN e > 0 THEN 'Match ' || cast(fe AS VARCHAR) || ' has empty matched_name' END first_error,
  CASE WHEN o_custkey % 2 <> 0 THEN 'No screening_id provided, generating one' WHEN nb > 0 THEN 'Match ' || cast(fb AS VARCHAR) || ' missing confidence breakdown'
   WHEN ni > 0 THEN 'Match ' || cast(fi AS VARCHAR) || ' has no entity_id' END first_warning FROM orders LEFT JOIN g ON k = o_orderkey""",
    "stale_sources": """SELECT o_custkey source, (epoch(TIMESTAMP '2000-06-30 12:00:00') - epoch(max(o_orderdate)))::BIGINT // 86400 days_old FROM orders GROUP BY 1
  HAVING max(o_orderdate) < TIMESTAMP '2000-06-30 12:00:00' - INTERVAL 90 DAY""",
    "constraint_violations": f"""WITH {DOCW}, {ENT} SELECT 'confidence_range' AS rule, count(*) FILTER (l_quantity * 2 > 90) violations FROM lineitem
  UNION ALL SELECT 'request_not_null', count(*) FILTER (l_orderkey IS NULL) FROM lineitem UNION ALL SELECT 'entity_type_allowed', 0 UNION ALL SELECT 'source_allowed', count(*) FILTER (source IN ('UK', 'OTHER')) FROM ent
  UNION ALL SELECT 'name_length', count(*) FILTER (length(primary_name) > 30) FROM ent UNION ALL SELECT 'status_allowed', count(*) FILTER (o_orderstatus = 'P') FROM orders
  UNION ALL SELECT 'result_unique', count(*) - count(DISTINCT (l_orderkey, l_linenumber)) FROM lineitem UNION ALL SELECT 'entity_unique', count(*) - count(DISTINCT (source, entity_id)) FROM ent""",
    "fk_orphans": """SELECT 'results.request_id' foreign_key, count(*) orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'requests.analyst', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'results.supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'labels.doc_id', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'events.user_id', count(*) FROM events WHERE user_id NOT IN (SELECT s_suppkey FROM supplier)
  UNION ALL SELECT 'parts.size', count(*) FROM part WHERE p_size NOT IN (SELECT n_nationkey FROM nation)""",
    "table_counts": " UNION ALL ".join(f"SELECT '{t}' table_name, count(*) AS rows FROM {t}" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()),
    "screen_document": f"""WITH {DOCW}, {ENT}, {REQ}, r AS (SELECT request_id, nullif({docnorm('document_number')}, '') dk, document_type dt FROM req),
  e AS (SELECT *, {docnorm('document_number')} edk, {docnorm('vessel_imo')} imok FROM ent)
  SELECT request_id, source, entity_id, primary_name matched_name, CASE WHEN dk = edk AND (dt IS NULL OR upper(dt) = upper(document_type)) THEN document_number ELSE vessel_imo END matched_document,
  100::DOUBLE overall, 1 match_layer, 'DOCUMENT_EXACT_MATCH' flags, 'AUTO_ESCALATE' recommendation
  FROM r JOIN e ON (dk = edk AND (dt IS NULL OR upper(dt) = upper(document_type))) OR dk = imok""",
    "screen_document_best": f"""WITH {DOCW}, {ENT}, {REQ}, r AS (SELECT request_id, 'PA' || cast(request_id % 5 AS VARCHAR) dk, document_type dt FROM req),
  e AS (SELECT *, 'PA' || cast(doc_id % 7 AS VARCHAR) edk, 'PA-' || cast(doc_id % 7 AS VARCHAR) number FROM ent),
  m AS (SELECT request_id, source, entity_id, number, row_number() OVER (PARTITION BY request_id ORDER BY source, entity_id) n FROM r JOIN e ON dk = edk AND (dt IS NULL OR upper(dt) = upper(document_type)))
  SELECT request_id, source, entity_id, number matched_document FROM m WHERE n <= 3""",
    "repo_document_best": f"""WITH {DOCW}, {ENT}, {REQ}, m AS (SELECT request_id search_id, e.source, e.entity_id, e.primary_name, row_number() OVER (PARTITION BY request_id ORDER BY e.source, e.entity_id) n
  FROM req r JOIN ent e ON request_id % 13 = doc_id % 11 WHERE NOT is_deleted AND (request_id % 3 <> 1 OR e.document_type = 'Passport'))
  SELECT search_id, source, entity_id, primary_name FROM m WHERE n <= 2""",
    "fuzzy_name_pairs": f"WITH {DOCW}, {ENT}, {REQ}, {NAMES}, {RKEYS}, {scores('rk', 'nm')} SELECT ak request_key, bk list_key, round(s, 6) score FROM sc WHERE s >= 60",
    "fuzzy_name_pairs_75": f"WITH {DOCW}, {ENT}, {REQ}, {NAMES}, {RKEYS}, {scores('rk', 'nm', None, 75)} SELECT ak request_key, bk list_key, round(s, 6) score FROM sc WHERE s >= 75",
    "best_alias": f"""WITH {DOCW}, {ENT}, {REQ}, {NAMES}, {RKEYS}, {scores('rk', 'nm', None, 75)} SELECT ak request_key, source, entity_id, round(max(s), 6) name_score,
  arg_max(name, s * 1000 - pos * 1e-6) matched_name FROM sc JOIN nm ON nm.k = bk WHERE s >= 75 GROUP BY 1, 2, 3""",
    "token_sort_ratio": f"WITH {PAIRSCORE} SELECT request_id, entity_id, round(name_score, 6) score FROM scored",
    "trigram_similarity": f"""WITH {DOCW}, {ENT}, {REQ}, a AS (SELECT t, {trigrams('t')} g FROM (SELECT DISTINCT {norm('name')} t FROM req)), b AS (SELECT t, {trigrams('t')} g FROM (SELECT DISTINCT {norm('primary_name')} t FROM ent))
  SELECT a.t left_text, b.t right_text, round({similarity('a.g', 'b.g')}, 6) similarity FROM a, b WHERE len(a.g) > 0 AND len(b.g) > 0 AND {similarity('a.g', 'b.g')} > 0.3""",
    "repo_name_search": f"""WITH {DOCW}, {ENT}, e AS (SELECT source, entity_id, primary_name, {trigrams(norm('primary_name'))} g, {trigrams(norm("'Oferonren enllementaux'"))} q FROM ent WHERE NOT is_deleted)
  SELECT source, entity_id, primary_name, round({similarity('g', 'q')}, 6) similarity FROM e WHERE {similarity('g', 'q')} > 0.05 ORDER BY {similarity('g', 'q')} DESC, source, entity_id LIMIT 100""",
    "repo_name_search_bulk": f"""WITH {DOCW}, {ENT}, {REQ}, a AS (SELECT request_id search_id, {trigrams(norm('name'))} g FROM req), b AS (SELECT source, entity_id, {trigrams(norm('primary_name'))} g FROM ent WHERE NOT is_deleted),
  p AS (SELECT search_id, source, entity_id, {similarity('a.g', 'b.g')} s FROM a, b WHERE len(a.g) > 0)
  SELECT search_id, source, entity_id, round(s, 6) similarity, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY s DESC, source, entity_id) r FROM p WHERE s > 0.3) WHERE r <= 5""",
    "repo_document_search": f"""WITH {DOCW}, {ENT}, {REQ} SELECT request_id search_id, e.source, e.entity_id, e.primary_name FROM req r JOIN ent e ON {docnorm('r.document_number')} = {docnorm('e.document_number')}
  WHERE NOT is_deleted AND (request_id % 3 <> 1 OR e.document_type = 'Passport')""",
    "nationality_flag": f"WITH {PAIR} SELECT request_id, entity_id, nat_flag flag FROM own",
    "doc_score": f"WITH {PAIR} SELECT request_id, entity_id, document_score, CASE WHEN document_score = 100 THEN entity_document END matched_document FROM own",
    "dob_score": f"WITH {PAIR} SELECT request_id, entity_id, dob_score FROM own",
    "overall_score": f"WITH {PAIRSCORE} SELECT request_id, entity_id, round(least(100, greatest(0, name_score * 0.4::DOUBLE + document_score * 0.3::DOUBLE + dob_score * 0.15::DOUBLE)), 6) overall FROM scored",
    "match_layer": f"""WITH {PAIRSCORE} SELECT request_id, entity_id, CASE WHEN document_score = 100 THEN 1 WHEN name_score >= 85 AND (nat_flag IS NOT NULL OR dob_score >= 60) THEN 2 WHEN name_score >= 70 THEN 3 ELSE 4 END match_layer FROM scored""",
    "match_flags": f"""WITH {PAIR} SELECT request_id, entity_id, concat_ws('|', CASE WHEN document_score = 100 THEN 'DOCUMENT_MATCH' END, CASE WHEN {short('name')} THEN 'SHORT_NAME_QUERY|ADAPTIVE_THRESHOLD_CYRILLIC_NAME' END,
  CASE WHEN request_id % 6 = 0 THEN 'COMMON_NAME' END, nat_flag, CASE WHEN document_score = 0 AND document_number IS NOT NULL THEN 'NO_DOCUMENT_MATCH' END, CASE WHEN entity_type = 'entity' THEN 'ENTITY_MATCH' END,
  CASE WHEN request_id % 6 = 0 AND document_score = 0 THEN 'COMMON_NAME_REQUIRES_SECONDARY_VALIDATION' END) flags FROM own""",
    "recommendation": f"""WITH {PAIRSCORE} SELECT request_id, entity_id, CASE WHEN name_score >= 95 AND NOT (request_id % 6 = 0 AND document_score = 0) THEN 'AUTO_ESCALATE' WHEN name_score >= 85 THEN 'MANUAL_REVIEW'
  WHEN name_score >= 60 THEN 'LOW_CONFIDENCE_REVIEW' ELSE 'AUTO_CLEAR' END recommendation FROM scored""",
    "confidence_band": """SELECT CASE WHEN c >= 90 THEN 'high' WHEN c >= 70 THEN 'medium' ELSE 'low' END band, CASE WHEN c >= 80 THEN 'high' WHEN c >= 50 THEN 'medium' ELSE 'low' END sub_band, count(*) n
  FROM (SELECT l_quantity * 2 c FROM lineitem) GROUP BY 1, 2""",
    "screen_full": f"WITH {SCREEN} SELECT {MATCHCOLS} FROM mt",
    "screen_delta": f"WITH {SCREEN} SELECT {MATCHCOLS} FROM mt",
    "screen_delta_no_reserve": f"WITH {SCREEN} SELECT {MATCHCOLS} FROM mt",
    "stream_screen": f"WITH {SCREEN} SELECT {MATCHCOLS} FROM mt",
    "screen_full_weighted": f"WITH {SCREENW} SELECT {MATCHCOLS} FROM mt",
    "screen_small": f"WITH {SCREEN} SELECT {MATCHCOLS} FROM mt WHERE request_id IN (SELECT request_id FROM req0 ORDER BY length(name), request_id LIMIT 100)",
    "screen_results": f"""WITH {SCREEN} SELECT request_id, is_hit, hit_count, max_confidence, recommendation, '2.0.0' algorithm_version, 75::DOUBLE threshold_name, 75::DOUBLE threshold_short_name, matches FROM res""",
    "screen_repeated_rows": f"WITH {SCREEN} SELECT request_id, is_hit, hit_count, max_confidence FROM res UNION ALL SELECT request_id, is_hit, hit_count, max_confidence FROM res",
    "bulk_summary": f"WITH {SCREEN} SELECT count(*) total_screened, count(*) FILTER (is_hit) total_hits, printf('%.2f%%', count(*) FILTER (is_hit) * 100.0::DOUBLE / count(*)) hit_rate FROM res",
    "export_rows": f"""WITH {SCREEN} SELECT coalesce(name, '') nombre, coalesce(document_number, '') documento, coalesce(country, '') pais, CASE WHEN is_hit THEN 'COINCIDENCIA' ELSE 'LIMPIO' END resultado,
  hit_count coincidencias, coalesce(recommendation, 'APPROVE') recomendacion FROM res""",
    "audit_entries": f"""WITH {SCREEN} SELECT cast(request_id AS VARCHAR) screening_id, '2024-01-01T00:00:00' AS timestamp, name, document_number document,
  CASE request_id % 3 WHEN 0 THEN 'op' || cast(request_id AS VARCHAR) WHEN 1 THEN lang ELSE 'system' END AS operator, is_hit, hit_count match_count, max_confidence top_score, recommendation decision FROM res""",
    "report_json": f"""WITH {SCREEN} SELECT r.request_id, r.name input_name, hit_count match_count, matched_name first_name, e.date_of_birth first_dob, e.program first_program, '2.0.0' algorithm_version
  FROM res r LEFT JOIN mt m ON m.request_id = r.request_id AND match_rank = 1 LEFT JOIN ent e ON e.source = m.source AND e.entity_id = m.entity_id""",
    "entity_nested": f"""WITH {DOCW}, {ENT}, {TOKENS} SELECT source, entity_id, primary_name, array_to_string(all_names, '|') aliases, document_number documents, n::INT tokens
  FROM ent JOIN (SELECT source, entity_id, count(*) n FROM tk GROUP BY 1, 2) USING (source, entity_id) WHERE NOT is_deleted""",
    "request_nested": """SELECT o_orderkey request_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END status, coalesce(n, 0)::INT results, coalesce(s, 0)::BIGINT entity_key_sum
  FROM orders LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_linenumber) n, sum(l_partkey) s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "screening_stats": """WITH o AS (SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'), l AS (SELECT l_returnflag = 'R' hit FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o))
  SELECT (SELECT count(*) FROM o) total_requests, count(*) total_results, count(*) FILTER (hit) total_hits, round(count(*) FILTER (hit) * 100.0::DOUBLE / count(*), 2) hit_rate_percent FROM l""",
    "status_breakdown": """SELECT CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END status, count(*) n FROM orders
  WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31' GROUP BY 1""",
    "program_members": """SELECT r_name program, count(s_suppkey) members FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 0 WHERE r_name <> 'ASIA' GROUP BY 1""",
    "count_by_source": f"WITH {DOCW}, {ENT} SELECT source, entity_type, count(*) n FROM ent WHERE NOT is_deleted GROUP BY 1, 2",
    "entity_rollup": f"WITH {DOCW}, {ENT} SELECT source, entity_type, count(*) n, grouping(source, entity_type)::INT AS level FROM ent WHERE NOT is_deleted GROUP BY ROLLUP (source, entity_type)",
    "list_by_source": f"""WITH {DOCW}, {ENT}, c AS (SELECT entity_id, primary_name, count(*) OVER () total FROM ent WHERE NOT is_deleted AND source = 'UN' AND entity_type = 'individual')
  SELECT entity_id, primary_name, total FROM c ORDER BY primary_name, entity_id LIMIT 25 OFFSET 3""",
    "page_past_end": f"WITH {DOCW}, {ENT} SELECT NULL::VARCHAR entity_id, NULL::VARCHAR primary_name, count(*) total FROM ent WHERE NOT is_deleted AND source = 'UN'",
    "page_after_key": "SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (10, 200) ORDER BY 1, 2 LIMIT 50",
    "query_stats": f"""SELECT event_type operation, count(*) calls, round(sum(value * 4), 2) total_time_ms, round(avg(value * 4), 2) avg_time_ms, round(min(value * 4), 2) min_time_ms, round(max(value * 4), 2) max_time_ms,
  count(*) FILTER (event_type = 'error') errors, count(*) FILTER (value * 4 > 1000) slow_queries, strftime(max(ts), {FMT}) last_executed FROM events GROUP BY 1""",
    "slow_operations": "SELECT event_type operation, count(*) slow_queries FROM events WHERE value * 4 > 1000 GROUP BY 1",
    "latency_histogram": f"WITH {HIST} SELECT operation, status, le, observations FROM hist",
    "latency_p95": "SELECT event_type operation, round(quantile_cont(value * 4, 0.95), 6) p95_ms, count(*) n FROM events GROUP BY 1",
    "latency_p95_sketch": "SELECT event_type operation, user_id, round(quantile_disc(value * 4, 0.95), 6) p95_ms, count(*) n FROM events GROUP BY 1, 2",
    "latency_quantile": f"""WITH {HIST}, b AS (SELECT operation, status, CASE WHEN le = '+Inf' THEN 'inf'::DOUBLE ELSE le::DOUBLE END le, observations n FROM hist),
  c AS (SELECT *, max(n) OVER (PARTITION BY operation, status) * 0.95::DOUBLE r, coalesce(lag(n) OVER w, 0) pn, coalesce(lag(le) OVER w, 0) ple FROM b WINDOW w AS (PARTITION BY operation, status ORDER BY le))
  SELECT operation, status, round(CASE WHEN le = 'inf'::DOUBLE THEN ple ELSE ple + (le - ple) * (r - pn) / (n - pn) END, 6) quantile_seconds FROM c WHERE n >= r AND pn < r""",
    "top_statements": f"WITH {STATEMENTS} SELECT calls, round(total, 2) total_ms, round(total / calls, 2) avg_ms, substr(query, 1, 100) query_preview FROM sg ORDER BY calls DESC, query LIMIT 10",
    "nplus1": f"WITH {STATEMENTS.replace('sum(value)', 'sum(value / 8)')} SELECT calls, round(total / calls, 2) avg_ms, substr(query, 1, 80) query_pattern FROM sg WHERE calls > 10 AND total / calls < 10 AND query LIKE '%SELECT%' ORDER BY calls DESC, query LIMIT 10",
    "hash_history": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) n FROM orders) WHERE n <= 10",
    "last_events": "SELECT event_id log_id, event_type AS action FROM events ORDER BY ts DESC, event_id DESC LIMIT 100",
    "latest_update": f"SELECT event_type AS action, strftime(max(ts), {FMT}) latest, strftime(min(ts), {FMT}) oldest FROM events GROUP BY 1",
    "active_sources": "SELECT s_name code FROM supplier WHERE s_acctbal > 5000 ORDER BY 1",
    "dedup_requests": f"""WITH b AS (SELECT event_id id, ts, event_type, props, user_id FROM events UNION ALL SELECT -event_id - 1, ts + INTERVAL 400 MILLISECOND, event_type, props, user_id FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY event_type, props, user_id, date_trunc('second', ts) ORDER BY ts, id) k FROM b)
  SELECT id log_id, event_type AS action, user_id actor_id, strftime(date_trunc('second', ts), {FMT}) AS second FROM n WHERE k = 1""",
    "upsert_insert": r"""WITH o AS (SELECT regexp_extract(s_name, '(\d+)$', 1)::BIGINT code FROM supplier), n0 AS (SELECT regexp_extract(c_name, '(\d+)$', 1)::BIGINT c, c_custkey id FROM customer), n AS (SELECT c - c % 3 code, id FROM n0)
  SELECT code, id, row_number() OVER (PARTITION BY code ORDER BY id) = 1 AND code NOT IN (SELECT code FROM o) accepted FROM n""",
    "apply_updates": f"""WITH {DOCW}, {ENT}, v AS (SELECT *, NOT is_deleted AND entity_type <> 'aircraft' ch, CASE WHEN NOT is_deleted AND entity_type = 'individual' THEN primary_name || ' é' ELSE primary_name END pn FROM ent)
  SELECT source, entity_id, pn primary_name, {norm('pn')} normalized_name,
  CASE WHEN NOT ch THEN nationality WHEN entity_type = 'vessel' THEN NULL WHEN entity_type = 'individual' THEN lower(nationality) ELSE upper(nationality) END nationality,
  CASE WHEN NOT ch THEN 1 WHEN entity_type IN ('vessel', 'individual') THEN 3 ELSE 2 END AS version, ch touched FROM v""",
    "soft_delete": f"WITH {DOCW}, {ENT} SELECT source, entity_id, is_deleted OR entity_type = 'vessel' is_deleted, NOT is_deleted AND entity_type = 'vessel' deleted_now FROM ent",
    "request_completion": """SELECT event_id request_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'completed' END status,
  CASE event_type WHEN 'error' THEN NULL WHEN 'purchase' THEN 7 ELSE floor(value)::BIGINT END processing_time_ms, CASE event_type WHEN 'error' THEN 'FAILED' END error_code,
  CASE event_type WHEN 'error' THEN props WHEN 'purchase' THEN 'old' END error_message, CASE WHEN event_type NOT IN ('error', 'purchase') THEN '2.0.0' END algorithm_version,
  strftime(ts + to_milliseconds(CASE event_type WHEN 'purchase' THEN 7 ELSE floor(value)::BIGINT END), '%H:%M:%S.%g') ended FROM events""",
    "source_status": """WITH u AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) n FROM orders WHERE o_orderstatus <> 'P')
  SELECT c_custkey code, c_name AS name, strftime(o_orderdate, '%Y-%m-%d') last_update, o_orderstatus last_update_status, o_totalprice last_entity_count FROM customer LEFT JOIN u ON o_custkey = c_custkey AND n = 1""",
    "list_diff": f"WITH {DOCW}, {ENT}, {NEWLIST} SELECT source, entity_id, change FROM diff",
    "list_diff_counts": f"""WITH {DOCW}, {ENT}, {NEWLIST} SELECT source, count(*) FILTER (change = 'added') entities_added, count(*) FILTER (change = 'updated') entities_updated, count(*) FILTER (change = 'removed') entities_removed FROM diff GROUP BY 1""",
    "cascade_delete": """SELECT l_orderkey request_id, count(*) results, count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)) linked FROM lineitem
  WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1""",
    "persist_entities": f"""WITH {DOCW}, {ENT} SELECT {rowid("sanctioned_entities", "entity_id", "source")} id, entity_id external_id, source, entity_type, primary_name,
  {norm('primary_name')} normalized_name, vessel_imo, is_deleted, 1 AS version, '2024-01-02' updated FROM ent""",
    "persist_aliases": f"""WITH {DOCW}, {ENT}, a AS (SELECT {rowid("sanctioned_entities", "entity_id", "source")} e, unnest(all_names) AS name, generate_subscripts(all_names, 1) = 1 p FROM ent)
  SELECT {rowid("entity_aliases", "e", "name")} id, e entity_id, name alias_name, {norm('name')} normalized_alias, p is_primary FROM a""",
    "persist_documents": f"""WITH {DOCW}, {ENT}, a AS (SELECT {rowid("sanctioned_entities", "entity_id", "source")} e, document_type, document_number FROM ent)
  SELECT {rowid("identity_documents", "e", "document_type", "document_number")} id, e entity_id, document_type, {docnorm('document_number')} normalized_number, NULL::VARCHAR issuing_country FROM a""",
    "persist_requests": f"""SELECT {rowid("screening_requests", "cast(o_orderkey AS VARCHAR)")} id, cast(o_orderkey AS VARCHAR) request_key,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'processing' ELSE 'completed' END status, cast(o_custkey AS VARCHAR) analyst_id, strftime(o_orderdate, '%Y-%m-%d') started, NULL::VARCHAR error_code FROM orders""",
    "persist_results": """SELECT o_orderkey request_no, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INT result_no, l_returnflag = 'R' is_hit, l_quantity * 2 max_confidence
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "persist_audit": f"""SELECT {rowid("audit_logs", "cast(event_id AS VARCHAR)")} id, cast(event_id AS VARCHAR) log_key, event_type AS action, cast(user_id AS VARCHAR) actor_id, props details,
  event_type <> 'error' success, strftime(ts, {FMT}) AS at FROM events""",
    "persist_sources": f"""WITH s AS (SELECT s_name code, s_name AS name, NULL::VARCHAR source_type, NULL::VARCHAR file_format, s_acctbal > 0 is_active, NULL::INT update_frequency_days, NULL::BOOLEAN validate_xsd FROM supplier
  UNION ALL VALUES ('OFAC', 'OFAC SDN Enhanced List', 'OFAC', 'xml', true, 1, true), ('UN', 'UN Consolidated List', 'UN', 'xml', true, 1, true),
   ('EU', 'EU Consolidated List', 'EU', 'xml', false, 7, NULL), ('UK', 'UK Consolidated List', 'UK', 'xml', false, 7, NULL))
  SELECT {rowid("data_sources", "code")} id, * FROM s""",
    "reload_report": f"""WITH {OFACV}, {UNV.split(ENT + ',')[1].strip()} SELECT 'OFAC' source, true success, 0 errors, 1 warnings, count(*) total_entities, count(*) FILTER (xtype = 'individual') individuals,
  count(*) entities_added, 0::BIGINT entities_updated, 0::BIGINT entities_removed FROM ox UNION ALL SELECT 'UN', true, 0, 0, count(*), count(*), count(*), 0, 0 FROM uy""",
    "audit_search": """WITH c AS (SELECT event_id log_id, user_id actor_id, ts, count(*) OVER () total FROM events WHERE event_type = 'click' AND value <= 50 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25')
  SELECT log_id, actor_id, total FROM c ORDER BY ts DESC, log_id DESC LIMIT 50 OFFSET 5""",
    "audit_by_id": "SELECT 'S77' screening_id, CASE WHEN value > 50 THEN 'entity' ELSE 'request' END decision FROM events WHERE event_id = 77",
    "audit_by_range": "SELECT 'S' || cast(event_id AS VARCHAR) screening_id, CASE WHEN value > 50 THEN 'entity' ELSE 'request' END decision FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'",
    "audit_table": f"""SELECT strftime(ts, {FMT}) AS timestamp, 'S' || cast(event_id AS VARCHAR) screening_id, event_type AS name, props document, '' country, event_type <> 'error' is_hit,
  CASE WHEN value > 50 THEN 'entity' ELSE 'request' END decision FROM events""",
    "audit_changes": """SELECT o_orderkey, concat_ws('|', CASE WHEN o_orderpriority LIKE '%LOW%' THEN 'priority' END, CASE WHEN o_orderstatus <> 'F' THEN 'status' END, 'v', 'w') changed FROM orders""",
    "request_pairs": """SELECT o_orderkey request_id, CASE WHEN c > 6 THEN 'ERROR' WHEN c IS NOT NULL THEN 'RESPONSE' END outcome, c status_code, date_diff('day', o_orderdate, f)::INT AS days
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linenumber) c, max(l_shipdate) f FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
    "error_rate_5m": ERRWIN,
    "p95_5m": f"""SELECT strftime(s, {FMT}) window_start, strftime(s + INTERVAL 5 MINUTE, {FMT}) window_end, count(*) calls, round(quantile_disc(value * 4, 0.95), 6) p95_ms, quantile_disc(value * 4, 0.95) > 500 alert
  FROM (SELECT *, time_bucket(INTERVAL 5 MINUTE, ts) s FROM events) GROUP BY s""",
}

# Runs of breached evaluations (rule, operation, w, v, most) by gaps and islands.
RUNS = "runs AS (SELECT rule, operation, w, v, w - to_minutes(row_number() OVER (PARTITION BY rule, operation ORDER BY w)) g FROM ev WHERE v > most)"
EPISODE = f"""strftime(min(w), {FMT}) pending_at, strftime(CASE WHEN max(w) - min(w) >= INTERVAL 5 MINUTE THEN min(w) + INTERVAL 5 MINUTE END, {FMT}) firing_at,
  strftime(max(w) + INTERVAL 1 MINUTE, {FMT}) resolved_at, count(*) evaluations, round(max(v), 6) peak"""
SLID = "sw AS (SELECT event_type operation, value, s + INTERVAL 5 MINUTE w FROM (SELECT *, unnest([date_trunc('minute', ts) - to_minutes(i) FOR i IN range(0, 5)]) s FROM events))"
FAILED = "count(*) FILTER (operation = 'error') * 100.0::DOUBLE / count(*)"
SCRAPED = """c AS (SELECT event_type operation, date_trunc('minute', ts) + INTERVAL 1 MINUTE t, b.le, count(*) FILTER (value * 4 / 1000 <= b.le) n
  FROM events, (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, 'inf'::DOUBLE]) le) b GROUP BY ALL),
samples AS (SELECT operation, t, le, sum(n) OVER (PARTITION BY operation, le, date_trunc('day', t) ORDER BY t)::BIGINT AS v FROM c),
steps AS (SELECT *, lag(v) OVER (PARTITION BY operation, le ORDER BY t) earlier FROM samples),
grown AS (SELECT operation, le, time_bucket(INTERVAL 5 MINUTE, t - INTERVAL 1 MICROSECOND, TIMESTAMP '2000-01-01') w, sum(CASE WHEN v < earlier THEN v ELSE v - earlier END)::BIGINT n
  FROM steps WHERE earlier IS NOT NULL GROUP BY ALL)"""
SPAN = f"strftime(w, {FMT}) window_start, strftime(w + INTERVAL 5 MINUTE, {FMT}) window_end"
PAIRSWITHIN = """WITH f AS (SELECT l_orderkey k, max(l_shipdate) f, max(l_linenumber) c FROM lineitem GROUP BY 1)
  SELECT o_orderkey request_id, CASE WHEN c > 6 THEN 'ERROR' WHEN c IS NOT NULL THEN 'RESPONSE' ELSE 'TIMEOUT' END outcome, c status_code, date_diff('day', o_orderdate, f)::INT AS days
  FROM orders LEFT JOIN f ON k = o_orderkey AND f BETWEEN o_orderdate AND o_orderdate + INTERVAL 60 DAY"""
FINGERPRINTS = r"""raw AS (SELECT CASE o_orderstatus WHEN 'O' THEN 'SELECT * FROM entities WHERE id = ' || o_custkey || ' AND priority = ''' || o_orderpriority || ''''
    WHEN 'F' THEN 'SELECT  name FROM t_2' || chr(10) || ' WHERE id IN (' || o_custkey || ', ' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ', 7 )' ELSE ')' END || ' -- order ' || o_custkey
    ELSE 'UPDATE requests SET total = ' || CAST(o_totalprice AS DECIMAL(12, 2)) || ' WHERE note = ''it''''s ' || o_custkey || '''' END q, (o_orderkey % 16)::DOUBLE ms FROM orders),
fp AS (SELECT trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '--[^\n]*', ' ', 'g'), '''(?:[^'']|'''')*''', '?', 'g'),
  '\b\d+(?:\.\d+)?\b', '?', 'g'), '\s+', ' ', 'g'), '\( ?\?(?: ?, ?\?)* ?\)', '(?)', 'g')) query, ms FROM raw),
sg AS (SELECT query, count(*) calls, sum(ms) total FROM fp GROUP BY 1)"""

ORACLES |= {
    "alert_episodes": f"""WITH {SLID},
  ev AS (SELECT 'error_rate' AS rule, operation, w, {FAILED} v, 0::DOUBLE most FROM sw GROUP BY operation, w
    UNION ALL SELECT 'latency', operation, w, quantile_disc(value * 4, 0.95), 500 FROM sw GROUP BY operation, w), {RUNS}
  SELECT rule, operation, {EPISODE} FROM runs GROUP BY rule, operation, g""",
    "alert_episodes_stream": f"""WITH {SLID}, ev AS (SELECT 'error_rate' AS rule, 'all' AS operation, w, {FAILED} v, 1 most FROM sw GROUP BY w), {RUNS}
  SELECT rule, {EPISODE} FROM runs GROUP BY rule, g""",
    "alert_firing": f"""WITH {SLID}, b AS (SELECT w FROM sw GROUP BY w HAVING {FAILED} > 1)
  SELECT strftime(w, {FMT}) firing_at FROM (SELECT w, lag(w, 5) OVER (ORDER BY w) first FROM b) WHERE w - first = INTERVAL 5 MINUTE""",
    "rate_quantile_5m": f"""WITH {SCRAPED},
  q AS (SELECT operation, w, list(struct_pack(le := le, n := n) ORDER BY le) b FROM grown GROUP BY ALL),
  i AS (SELECT *, b[-1].n * 0.95::DOUBLE AS r, list_position(list_transform(b, lambda x: x.n >= b[-1].n * 0.95::DOUBLE), true) k FROM q),
  e AS (SELECT *, CASE WHEN k > 1 THEN b[k - 1].le ELSE 0 END low, CASE WHEN k > 1 THEN b[k - 1].n ELSE 0 END below FROM i)
  SELECT operation, {SPAN}, round(CASE WHEN b[k].le = 'inf'::DOUBLE THEN low ELSE low + (b[k].le - low) * (r - below) / nullif(b[k].n - below, 0) END, 9) quantile_seconds FROM e""",
    "counter_rates_5m": f"WITH {SCRAPED} SELECT operation, {SPAN}, n increase, round(n / 300::DOUBLE, 9) per_second FROM grown WHERE le = 'inf'::DOUBLE",
    "request_pairs_within": PAIRSWITHIN,
    "request_pairs_stream": PAIRSWITHIN,
    "nplus1_literals": f"WITH {FINGERPRINTS} SELECT calls, round(total / calls, 2) avg_ms, substr(query, 1, 80) query_pattern FROM sg WHERE calls > 10 AND total / calls < 10 AND query LIKE '%SELECT%' ORDER BY calls DESC, query LIMIT 10",
    "top_fingerprints": f"WITH {FINGERPRINTS} SELECT calls, round(total, 2) total_ms, round(total / calls, 2) avg_ms, substr(query, 1, 100) query_preview FROM sg ORDER BY calls DESC, query LIMIT 10",
    "frequent_statements": f"WITH {FINGERPRINTS} SELECT query, calls FROM sg ORDER BY calls DESC, query LIMIT 10",
}
ORACLES |= {
    "token_search_topk": ORACLES["token_search_best"],
    "token_search_merged": ORACLES["token_search_best"],
    "repo_name_search_indexed": ORACLES["repo_name_search"],
}
ORACLES |= {
    "page_by_rank": """WITH r AS (SELECT l_extendedprice, l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) n, count(*) OVER () total FROM lineitem)
  SELECT l_extendedprice, l_orderkey, l_linenumber, 'middle' AS part FROM r WHERE n > total // 2 AND n <= total // 2 + 250
  UNION ALL SELECT l_extendedprice, l_orderkey, l_linenumber, 'end' FROM r WHERE n > total - 7""",
    "entity_nested_colocated": ORACLES["entity_nested"],
    "request_nested_colocated": ORACLES["request_nested"],
}
