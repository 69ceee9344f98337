"""Pieces of oracle SQL (DuckDB, RE2 patterns) for the shared text expressions."""

from __future__ import annotations

from tallyspark import constants as K


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(w)})" for w in words) + ")"


def in_list(words: list[str]) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def squeeze(c: str) -> str:
    return strip(rf"regexp_replace({c}, '\s+', ' ', 'g')")


def first_group(c: str, patterns: list[str], group: int = 1) -> str:
    parts = [f"nullif(regexp_extract({c}, {lit(p)}, {group}), '')" for p in patterns]
    return "coalesce(" + ", ".join(parts) + ")"


def strip_noise(c: str) -> str:
    s = strip(c)
    s = strip(f"regexp_replace({s}, {lit('(?i)^(' + '|'.join(K.NOISE_PREFIXES) + ')')}, '')")
    s = f"regexp_replace({s}, {lit(K.NOISE_DATE)}, '')"
    s = f"regexp_replace({s}, {lit(K.NOISE_STARS)}, ' ', 'g')"
    s = strip(f"regexp_replace({s}, {lit(K.NOISE_PROCESSOR)}, '')")
    s = f"regexp_replace({s}, {lit(K.NOISE_PHONE)}, ' ', 'g')"
    s = f"regexp_replace({s}, {lit(K.NOISE_CARD_STATE)}, ' ', 'g')"
    s = f"regexp_replace({s}, {lit(K.NOISE_CARD)}, ' ', 'g')"
    return f"coalesce({strip(s)}, '')"


def drop_zeros(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL THEN NULL WHEN ltrim({c}, '0') = '' THEN '0' ELSE ltrim({c}, '0') END)"


def check_key(c: str) -> str:
    s = f"replace({strip(c)}, ' ', '')"
    return drop_zeros(rf"regexp_replace({s}, '\.0$', '')")


def check_number(c: str) -> str:
    return drop_zeros(first_group(c, K.CHECK_NUMBER_PATTERNS))


def is_check_like(c: str) -> str:
    d = f"lower({strip(c)})"
    return (
        f"coalesce({first_group(c, K.CHECK_NUMBER_PATTERNS)} IS NOT NULL OR contains({d}, 'check') OR starts_with({d}, 'chk ') "
        f"OR contains({d}, ' chk ') OR ends_with({d}, ' chk'), false)"
    )


def is_ach(c: str) -> str:
    d = f"upper(coalesce({c}, ''))"
    return f"({any_of(d, K.ACH_WORDS)} AND {any_of(d, K.ACH_PAYMENT_HINTS)})"


def vendor_code(c: str) -> str:
    d = f"upper({c})"
    fallback = f"CASE WHEN {any_of(d, K.ACH_WORDS)} THEN nullif(regexp_extract({d}, {lit(K.FOUR_DIGITS)}, 1), '') END"
    parts = [f"nullif(regexp_extract({d}, {lit(p)}, 1), '')" for p in K.VENDOR_CODE_PATTERNS]
    return "coalesce(" + ", ".join(parts + [fallback]) + ")"


def ach_code(c: str) -> str:
    return f"(CASE WHEN {is_ach(c)} THEN {vendor_code(c)} END)"


def signed(credit: str, debit: str) -> str:
    return (
        f"CAST(CASE WHEN coalesce({credit}, 0) <> 0 THEN {credit} WHEN coalesce({debit}, 0) <> 0 THEN -{debit} ELSE 0 END "
        "AS DECIMAL(18,2))"
    )


def fingerprint(date: str, desc: str, credit: str, debit: str, bank: str, account: str) -> str:
    def text(c):
        return f"upper({strip(f'coalesce({c}, chr(32))')})"

    return (
        f"substr(sha256(concat_ws('|', coalesce(CAST({date} AS VARCHAR), ''), {text(desc)}, "
        f"CAST({signed(credit, debit)} AS VARCHAR), {text(bank)}, {text(account)})), 1, 24)"
    )


def is_generic(c: str) -> str:
    t = f"upper({strip(c)})"
    compact = squeeze(f"regexp_replace({t}, '[^A-Z0-9 ]', ' ', 'g')")
    starts = " OR ".join(f"starts_with({compact}, {lit(p + ' ')})" for p in K.GENERIC_PAYMENT_PHRASES)
    return (
        f"(NOT regexp_matches({t}, {lit(K.FOUR_DIGITS)}) AND ({compact} IN {in_list(K.GENERIC_PAYMENT_PHRASES)} OR {starts}))"
    )


def description_key(c: str) -> str:
    return squeeze(f"translate(lower(coalesce({c}, '')), '#-_', '   ')")


def check_memo_key(c: str) -> str:
    s = f"lower({strip(f'replace(replace(coalesce({c}, {lit(str())}), {lit(chr(35))}, {lit(str())}), {lit(2 * chr(32))}, {lit(chr(32))})')})"
    for p in ["check", "chk", "ch"]:
        s = f"(CASE WHEN starts_with({s}, '{p} ') THEN {strip(f'substr({s}, {len(p) + 1})')} ELSE {s} END)"
    return s


def account_id_core(c: str) -> str:
    prefixes = "|".join(p.rstrip("-") for p in K.ACCOUNT_ID_PREFIXES)
    return f"coalesce(regexp_replace({c}, '(?i)^({prefixes})-', ''), '')"


def lenient(c: str) -> str:
    return f"TRY_CAST(nullif({strip(f'regexp_replace({c}, {lit(chr(91) + chr(44) + chr(36) + chr(93))}, {lit(str())}, {lit(chr(103))})')}, '') AS DECIMAL(18,2))"


def ledger_amount(c: str) -> str:
    return f"coalesce(TRY_CAST(nullif({strip(f'regexp_replace({c}, {lit(chr(91) + chr(44) + chr(36) + chr(40) + chr(41) + chr(93))}, {lit(str())}, {lit(chr(103))})')}, '') AS DECIMAL(18,2)), 0.00)"


_DATE_FORMS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "%m/%d/%Y"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "%d/%m/%Y"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "%Y-%m-%d"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "%m/%d/%y"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "%d/%m/%y"),
]


def parse_date(c: str) -> str:
    s = strip(c)
    return "CAST(coalesce(" + ", ".join(
        f"CASE WHEN regexp_matches({s}, {lit(p)}) THEN try_strptime({s}, '{f}') END" for p, f in _DATE_FORMS
    ) + ") AS DATE)"


def percent(part: str, whole: str) -> str:
    return f"coalesce(CAST((CAST({part} AS BIGINT) * 20000 + {whole}) // nullif(CAST({whole} AS BIGINT) * 2, 0) AS DOUBLE) / 100, 0.0)"


def review_reason(source: str, account: str, conf: str, trigger: str, reason: str) -> str:
    t = strip(f"coalesce({trigger}, '')")
    return f"""CASE WHEN {strip(f"coalesce({account}, '')")} = '{K.DEFAULT_CATEGORY}' THEN coalesce(nullif({reason}, ''), '{K.REASON_NO_RULE}')
      WHEN {source} = 'AI' AND coalesce({conf}, 0) < 0.80 THEN '{K.REASON_MODEL_LOW}'
      WHEN {source} = 'Rule' AND {t} <> '' AND length({t}) <= 3 THEN '{K.REASON_SHORT_TRIGGER}' ELSE {reason} END"""


def search_text(desc: str, payee: str) -> str:
    d, p = f"coalesce({desc}, '')", f"coalesce({payee}, '')"
    return f"upper({strip(f'concat_ws({lit(chr(32))}, {strip_noise(d)}, {d}, {p})')})"


# triggers of all rules with positions and the parts of the predicate
TRIGGERS = f"""
flagged_rules AS (SELECT *, len(trigger_payee_contains) > 0 AND len([x for x in trigger_payee_contains if NOT {is_generic('x')}]) = 0 AS generic_only FROM rules),
rule_owner AS (SELECT client_id AS own_client, bool_and(generic_only) AS client_all_generic FROM flagged_rules GROUP BY client_id),
triggers AS (
  SELECT client_id AS t_client, rule_pos, rule_id, account_id, account_name, category_type, vendor_code, trigger_payee_contains,
    coalesce(ach_vendor_only, false) AS ach_only, generic_only AND NOT client_all_generic AS dropped, i - 1 AS trigger_pos,
    trigger_payee_contains[i] AS trigger, upper(trim(trigger_payee_contains[i])) AS t,
    replace(upper(trim(trigger_payee_contains[i])), ' ', '') AS tn,
    [w for w in regexp_split_to_array(upper(trim(trigger_payee_contains[i])), '\\s+') if length(w) > 2] AS ws
  FROM (SELECT *, unnest(range(1, len(trigger_payee_contains) + 1)) AS i FROM flagged_rules) r JOIN rule_owner ON client_id = own_client
  WHERE upper(trim(trigger_payee_contains[i])) <> '')"""


def predicate(s: str = "s", sn: str = "sn") -> str:
    """Trigger predicate over columns t, tn, ws and the search text."""
    return f"""({s} <> '' AND (contains({s}, t)
   OR (length(tn) >= 3 AND (contains({sn}, tn) OR (length(tn) >= 5 AND contains({sn}, left(tn, length(tn) - 1)))
       OR (length({sn}) >= 5 AND contains(tn, {sn})) OR (length({sn}) >= 4 AND contains(tn, {sn}) AND length({sn}) * 10 >= length(tn) * 6)))
   OR (len(ws) >= 2 AND (len([w for w in ws if contains({s}, w)]) * 10 >= len(ws) * 8
       OR (contains({s}, ws[1]) AND length(ws[1]) >= 5 AND starts_with({sn}, ws[1]))
       OR (len(ws) = 2 AND contains({s}, ws[1]) AND (contains({sn}, ws[2]) OR (length(ws[2]) >= 4 AND contains({sn}, left(ws[2], length(ws[2]) - 1)))))))))"""
