"""Shared pieces of the checking SQL."""

from ..functions import fixed_values as fx
from ..operators.dims import LATEST, rule_rows, values_sql
from ..operators.rulebook import rationale_of


def words(items) -> str:
    return ", ".join("'" + s.replace("'", "''") + "'" for s in items)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def band_case(score: str, version: str = LATEST) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {lo} THEN '{b}'" for b, lo, _ in reversed(fx.BANDS[version])) + " END"


def bucket_case(band: str, version: str = LATEST) -> str:
    return f"CASE {band} " + " ".join(f"WHEN '{b}' THEN '{k}'" for b, _, k in fx.BANDS[version]) + " END"


def map_case(col: str, mapping: dict, pick=lambda v: v) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {lit(pick(v))}" for k, v in mapping.items()) + " END"


def verdict_ctes(version: str = LATEST, p: str = "", evidence: str = "d_evidence", all_cases: bool = False, rules: str | None = None) -> str:
    """CTEs ``{p}best``, ``{p}keep`` and ``{p}verdict`` computed the plain way."""
    why = rationale_of()
    rows = [(s, w, lab, why[s]) for v, s, w, _, lab in rule_rows() if v == version]
    rules = rules or f"SELECT * FROM {values_sql(rows, 't(signal, weight, label, rationale)')}"
    credits = fx.IDENTITY_CREDITS[version] or ["-"]
    ident = fx.IDENTITY_SUPPRESSORS[version] or ["-"]
    cases = "SELECT case_id FROM d_cases" if all_cases else f"SELECT DISTINCT case_id FROM {evidence}"
    return f"""
{p}r AS ({rules}),
{p}t AS (SELECT e.case_id, e.pos, e.analyzer, e.signal, e.confidence, e.detail, r.weight, r.label, r.rationale, r.weight * e.confidence AS points
  FROM {evidence} e JOIN {p}r r ON r.signal = e.signal WHERE e.status = 'TRIGGERED'),
{p}sup AS (SELECT case_id, string_agg(DISTINCT signal, ',' ORDER BY signal) AS names FROM {evidence}
  WHERE status = 'TRIGGERED' AND signal IN ({words(fx.GENERAL_SUPPRESSORS[version])}) GROUP BY case_id),
{p}idn AS (SELECT DISTINCT case_id FROM {evidence} WHERE status = 'TRIGGERED' AND signal IN ({words(ident)})),
{p}best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id, signal ORDER BY abs(points) DESC, pos) AS rn FROM {p}t) WHERE rn = 1),
{p}flag AS (SELECT b.*, b.weight < 0 AND CASE WHEN b.signal IN ({words(credits)}) THEN i.case_id IS NOT NULL ELSE s.case_id IS NOT NULL END AS blocked
  FROM {p}best b LEFT JOIN {p}sup s ON s.case_id = b.case_id LEFT JOIN {p}idn i ON i.case_id = b.case_id),
{p}keep AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY abs(floor(points * 100 + 0.5) / 100) DESC, pos) AS rank FROM {p}flag WHERE NOT blocked),
{p}una AS (SELECT case_id, count(DISTINCT analyzer) AS n, string_agg(DISTINCT analyzer, ', ' ORDER BY analyzer) AS lanes FROM {evidence}
  WHERE status = 'UNAVAILABLE' GROUP BY case_id),
{p}verdict0 AS (SELECT c.case_id, CAST(greatest(0, least(100, round_even(coalesce(k.total, 0), 0))) AS INT) AS score,
    greatest(0, 100 - {fx.UNAVAILABLE_PENALTY_PERCENT} * coalesce(u.n, 0)) / 100.0 AS confidence, coalesce(u.lanes, '') AS lanes, coalesce(u.n, 0) AS n_lanes,
    coalesce(k.n, 0) AS n_kept, k.top AS top, coalesce(b.names, '') AS withheld, coalesce(s.names, '') AS suppressed_by
  FROM ({cases}) c
  LEFT JOIN (SELECT case_id, sum(points) AS total, count(*) AS n,
      string_agg(label, '; ' ORDER BY rank) FILTER (pr <= 3 AND points > 0) AS top
    FROM (SELECT *, row_number() OVER (PARTITION BY case_id, points > 0 ORDER BY rank) AS pr FROM {p}keep) GROUP BY case_id) k ON k.case_id = c.case_id
  LEFT JOIN {p}una u ON u.case_id = c.case_id
  LEFT JOIN (SELECT case_id, string_agg(signal, ',' ORDER BY pos) AS names FROM {p}flag WHERE blocked GROUP BY case_id) b ON b.case_id = c.case_id
  LEFT JOIN {p}sup s ON s.case_id = c.case_id),
{p}verdict AS (SELECT *, {band_case('score', version)} AS band FROM {p}verdict0)"""


#: The public-suffix rules of the checking SQL, by shape; the view d_suffix_rules has them as a table.
EXACT_SUFFIXES = ["co.in", "gov.in", "org.in", "net.in", "edu.in", "co.uk", "ac.uk", "com.mx", "co.za", "com.sg", "co.jp"]
TENANT_SUFFIXES = ["herokuapp.com", "github.io", "web.app"]


def org(h: str, private: bool = True) -> str:
    """Registrable domain of a host expression: the number of labels of its public suffix, and one more."""
    c = f"lower(trim({h}, '. '))"
    parts = f"string_split({c}, '.')"
    tail = lambda k: f"array_to_string({parts}[-{k}:], '.')"
    n = (f"CASE WHEN {tail(3)} = 'city.kawasaki.jp' THEN 2 WHEN {tail(2)} = 'www.ck' THEN 1 WHEN {tail(2)} = 'kawasaki.jp' AND len({parts}) > 2 THEN 3 "
         f"WHEN {parts}[-1] = 'ck' AND len({parts}) > 1 THEN 2 WHEN {tail(2)} IN ({words(EXACT_SUFFIXES + (TENANT_SUFFIXES if private else []))}) THEN 2 ELSE 1 END")
    return f"CASE WHEN regexp_matches({c}, '^[0-9.]+$') OR contains({c}, ':') THEN NULL WHEN len({parts}) > {n} THEN array_to_string({parts}[-({n}) - 1:], '.') END"


def dom(a: str) -> str:
    return f"CASE WHEN {a} LIKE '%@%' THEN lower(trim(string_split({a}, '@')[-1])) END"


def same(a: str, b: str) -> str:
    return f"coalesce(lower({a}) = lower({b}) OR ({org(a)}) = ({org(b)}), false)"


def num(ip: str) -> str:
    """Number of an address text (IPv6 with or without ::), 128 bits unsigned; NULL when it cannot be read."""
    p = lambda i: f"TRY_CAST(string_split({ip}, '.')[{i}] AS UHUGEINT)"
    v4 = f"({p(1)} * 16777216::UHUGEINT + {p(2)} * 65536::UHUGEINT + {p(3)} * 256::UHUGEINT + CASE WHEN {p(4)} <= 255 THEN {p(4)} END)"
    some = lambda i: f"list_filter(string_split(split_part({ip}, '::', {i}), ':'), lambda g: g <> '')"
    gap = f"list_transform(range(8 - len({some(1)}) - len({some(2)})), lambda z: '0')"
    groups = f"CASE WHEN contains({ip}, '::') THEN list_concat(list_concat({some(1)}, {gap}), {some(2)}) ELSE string_split({ip}, ':') END"
    g = lambda i: f"TRY_CAST(TRY_CAST('0x' || ({groups})[{i + 1}] AS UBIGINT) AS UHUGEINT) * {65536 ** (7 - i)}::UHUGEINT"
    return f"(CASE WHEN contains({ip}, ':') THEN {' + '.join(g(i) for i in range(8))} ELSE {v4} END)"


def six(ip: str) -> str:
    return f"contains({ip}, ':')"


def in_cidrs(ip: str, cidrs) -> str:
    from ..functions.net import cidr_bounds
    within = lambda c: f"({six(ip)} = {str(':' in c).lower()} AND {num(ip)} BETWEEN '{cidr_bounds(c)[0]}'::UHUGEINT AND '{cidr_bounds(c)[1]}'::UHUGEINT)"
    return "(" + " OR ".join(map(within, cidrs)) + ")"


def bad_ip(ip: str) -> str:
    v4 = in_cidrs(ip, fx.UNROUTABLE_V4)
    return f"coalesce(CASE WHEN {six(ip)} THEN regexp_matches({ip}, '^(f[cd]|fe[89ab])') ELSE {v4} END, false)"


def hop_ctes(cidrs: str = "") -> str:
    """CTEs ``hx`` (hops with trust walk) and ``b`` (boundary per case)."""
    return f"""
hh AS (SELECT *, {bad_ip('from_ip')} AS bad, from_ip IS NOT NULL AND NOT {bad_ip('from_ip')} AS pub,
    CASE WHEN lower(by_host) = 'mx.example.ac.in' {cidrs} THEN 1 ELSE 0 END AS ours FROM d_hops),
walk AS (SELECT *, min(ours) OVER (PARTITION BY case_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS run FROM hh),
b AS (SELECT case_id, min(seq) FILTER (run = 1) AS boundary_seq FROM walk GROUP BY case_id),
hx AS (SELECT w.*, b.boundary_seq, CASE WHEN seq > b.boundary_seq THEN 'TRUSTED' WHEN seq = b.boundary_seq THEN 'BOUNDARY' ELSE 'UNVERIFIED' END AS trust,
    coalesce(w.seq < b.boundary_seq, false) AND w.bad AS forged FROM walk w JOIN b ON b.case_id = w.case_id),
origin AS (SELECT case_id, coalesce(max(from_ip) FILTER (trust = 'BOUNDARY' AND pub), arg_min(from_ip, seq) FILTER (pub)) AS origin_ip,
    coalesce(max(seq) FILTER (trust = 'BOUNDARY' AND pub), min(seq) FILTER (pub)) AS origin_seq, count(*) FILTER (pub) AS routable,
    max(boundary_seq) AS boundary_seq, max(from_ip) FILTER (trust = 'BOUNDARY') AS boundary_ip FROM hx GROUP BY case_id)"""
