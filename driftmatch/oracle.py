"""SQL for DuckDB that finds the same matches by a recursive walk over alignments of short distinct ASCII strings.

Costs are integers in units of 1e-4. One state is (pattern, text, start, pattern place, text place, end, counts, cost).
"""

from __future__ import annotations

from dataclasses import dataclass

from driftmatch.plans.spec import Limits, Pattern, Penalties, Similarity


@dataclass(frozen=True)
class Case:
    """A search over one string column of one table."""

    table: str
    key: str
    column: str
    patterns: tuple
    threshold: float
    limits: Limits | None = None
    penalties: Penalties = Penalties()
    similarity: Similarity | None = None
    case_insensitive: bool = False
    mappings: tuple = ()
    floor: float = 0.0
    suffix_outputs: bool = False
    beam: int | None = None

    def settings(self) -> dict:
        return {"limits": self.limits, "penalties": self.penalties, "similarity": self.similarity, "case_insensitive": self.case_insensitive, "mappings": self.mappings, "floor": self.floor, "suffix_outputs": self.suffix_outputs, "beam": self.beam}


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _units(x: float) -> int:
    return round(x * 10000)


def best_sql(case: Case) -> str:
    """CTEs up to ``best(t, pid, pattern, s, e, pen, ins, del, sub, swp, edits, sim, blen, uid)``, after WITH RECURSIVE."""
    fold = (lambda x: f"lower({x})") if case.case_insensitive else (lambda x: x)
    pats = [Pattern.of(p) for p in case.patterns]
    given = [p.limits.final() for p in pats if p.limits]
    if case.limits:
        shared = case.limits.final()
    elif given:
        top = lambda n: None if any(getattr(x, n) is None for x in given) else max(getattr(x, n) for x in given)
        edits = [x.edits for x in given if x.edits is not None]
        shared = Limits(top("insertions"), top("deletions"), top("substitutions"), top("swaps"), max(edits) if edits else None)
    else:
        shared = Limits().final()
    rows = []
    for k, p in enumerate(pats):
        lim = p.limits.final() if p.limits else shared
        caps = [255 if x is None else x for x in (lim.insertions, lim.deletions, lim.substitutions, lim.swaps, lim.edits)]
        n = len(p.text)
        budget = int(n * 10000 * (1 - case.threshold / p.weight) + 1e-6)
        uid = 2 * p.custom_unique_id + 1 if p.custom_unique_id is not None else 2 * k
        whole = p.text.lower() if case.case_insensitive else p.text
        units = [whole]
        if case.suffix_outputs:
            units += sorted({x.text[:i] for x in pats for i in range(len(whole) + 1, len(x.text) + 1) if x.text[:i].endswith(whole)})
        for u in units:
            rows.append(f"({len(rows)}, {k}, {quote(p.text)}, {quote(u)}, {n}, {len(u)}, {p.weight}::DOUBLE, {', '.join(map(str, caps))}, {budget}, {uid})")
    like = {k: v for k, v in (case.similarity or Similarity()).table.items() if k[0] != k[1]}
    sims = ", ".join(f"({quote(a)}, {quote(b)}, {v})" for (a, b), v in sorted(like.items())) or "('', '', 0.0)"
    p = case.penalties
    moves = ["('m', 1, 1, '', '', 0)", "('x', 1, 1, '', '', 0)", f"('w', 2, 2, '', '', {_units(p.swap)})", f"('i', 0, 1, '', '', {_units(p.insertion)})", f"('d', 1, 0, '', '', {_units(p.deletion)})"]
    for a, b, *rest in case.mappings:
        score = rest[0] if rest else 1.0
        for x, y in {(a, b), (b, a)}:
            x, y = (x.lower(), y.lower()) if case.case_insensitive else (x, y)
            moves.append(f"('b', {len(x)}, {len(y)}, {quote(x)}, {quote(y)}, {_units(p.substitution * (1 - score))})")
    head = tail = ""
    if case.beam:  # a turn of the recursion is a step of the sweep: of each start's distinct states the cheapest go on
        head = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY cid, t, s ORDER BY pen, i, j, e, ins, del, sub, swp) AS k FROM (SELECT cid, t, f, s, i, j, e, ins, del, sub, swp, min(pen)::INT AS pen FROM ("
        tail = f") GROUP BY ALL)) WHERE k <= {case.beam}"
    return f"""
pats(cid, pid, pattern, u, n, lu, w, ci, cd, cs, cw, ce, budget, uid) AS (VALUES {', '.join(rows)}),
sims(a, b, v) AS (VALUES {sims}),
mv(k, di, dj, a, b, c) AS (VALUES {', '.join(moves)}),
src AS (SELECT DISTINCT {case.column} AS t, {fold(case.column)} AS f FROM {case.table} WHERE {case.column} IS NOT NULL),
st AS (
  SELECT cid, t, f, s, 0 AS i, s AS j, s AS e, 0 AS ins, 0 AS del, 0 AS sub, 0 AS swp, 0 AS pen
  FROM pats, (SELECT t, f, unnest(range(0, length(f))) AS s FROM src) WHERE budget >= 0
  UNION {'ALL' * bool(case.beam)}
  {head}SELECT * EXCLUDE (ce, ci, cd, cs, cw, budget) FROM (
    SELECT q.cid, q.t, q.f, q.s, (q.i + m.di)::INT AS i, (q.j + m.dj)::BIGINT AS j,
      (CASE WHEN m.k IN ('i', 'd') THEN q.e ELSE q.j + m.dj END)::BIGINT AS e,
      q.ins + (m.k = 'i')::INT AS ins, q.del + (m.k = 'd')::INT AS del, q.sub + (m.k IN ('x', 'b'))::INT AS sub, q.swp + (m.k = 'w')::INT AS swp,
      (q.pen + CASE WHEN m.k = 'x' THEN round({_units(p.substitution)} * (1 - coalesce(z.v, 0)))::INT ELSE m.c END)::INT AS pen,
      p.ce, p.ci, p.cd, p.cs, p.cw, p.budget
    FROM st q JOIN pats p USING (cid) CROSS JOIN mv m
    LEFT JOIN sims z ON z.a = substr(p.u, q.i + 1, 1) AND z.b = substr(q.f, (q.j + 1)::INT, 1)
    WHERE q.i < p.lu AND (
      (m.k = 'm' AND q.j < length(q.f) AND substr(p.u, q.i + 1, 1) = substr(q.f, (q.j + 1)::INT, 1))
      OR (m.k = 'x' AND q.j < length(q.f) AND substr(p.u, q.i + 1, 1) <> substr(q.f, (q.j + 1)::INT, 1) AND coalesce(z.v, 0) >= {case.floor})
      OR (m.k = 'w' AND q.i + 1 < p.lu AND q.j + 1 < length(q.f) AND substr(p.u, q.i + 1, 1) = substr(q.f, (q.j + 2)::INT, 1) AND substr(p.u, q.i + 2, 1) = substr(q.f, (q.j + 1)::INT, 1) AND substr(p.u, q.i + 1, 1) <> substr(p.u, q.i + 2, 1))
      OR (m.k = 'i' AND q.j < length(q.f) AND q.e > q.s)
      OR m.k = 'd'
      OR (m.k = 'b' AND substr(p.u, q.i + 1, m.di) = m.a AND substr(q.f, (q.j + 1)::INT, m.dj) = m.b)))
  WHERE ins <= ci AND del <= cd AND sub <= cs AND swp <= cw AND ins + del + sub + swp <= ce AND pen <= budget{tail}
),
best AS (
  SELECT t, p.pid, p.pattern, s, e, pen, ins, del, sub, swp, ins + del + sub + swp AS edits, round((p.n - pen / 10000.0) / p.n * p.w, 4) AS sim, strlen(p.pattern) AS blen, p.uid
  FROM st JOIN pats p USING (cid) WHERE i = p.lu AND (p.n - pen / 10000.0) / p.n * p.w >= {case.threshold}
  QUALIFY row_number() OVER (PARTITION BY t, p.pid, s, e ORDER BY pen, ins + del + sub + swp, ins, del, sub, swp) = 1
)"""


RANKS = {
    "default": "sim DESC, blen DESC, e - s DESC, s, e, pid",
    "greedy": "blen DESC, sim DESC, s, e, pid",
    "coverage_weighted": "sim * sim * blen DESC, sim DESC, s, e, pid",
}


def resolved_sql(case: Case, order: str = "default", unique: bool = False) -> str:
    """... and ``kept``, the matches that are left without overlaps."""
    same = " OR a.uid = r.m.uid" if unique else ""
    return f"""{best_sql(case)},
ranked AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY {RANKS[order]}) AS k, {{'pid': pid, 'pattern': pattern, 's': s, 'e': e, 'sim': sim, 'uid': uid}} AS m FROM best),
fold AS (
  SELECT t, 1 AS k, [m] AS acc FROM ranked WHERE k = 1
  UNION ALL
  SELECT f.t, f.k + 1, CASE WHEN len(list_filter(f.acc, lambda a: (a.s < r.m.s AND a.e > r.m.s) OR (a.s >= r.m.s AND a.s < r.m.e){same})) > 0 THEN f.acc ELSE list_append(f.acc, r.m) END
  FROM fold f JOIN ranked r ON r.t = f.t AND r.k = f.k + 1
),
kept AS (SELECT t, unnest(acc) AS m FROM fold QUALIFY k = max(k) OVER (PARTITION BY t))"""


def rows_sql(case: Case, keep: str = "") -> str:
    """Every match of every row of the table."""
    return f"WITH RECURSIVE {best_sql(case)} SELECT d.{case.key}, b.pattern, b.s AS m_start, b.e AS m_end, b.sim, b.ins, b.del, b.sub, b.swp, b.edits FROM {case.table} d JOIN best b ON b.t = d.{case.column}"


def ranked_sql(case: Case, order: str) -> str:
    return f"WITH RECURSIVE {best_sql(case)}, ranked AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY {RANKS[order]}) - 1 AS place FROM best) SELECT d.{case.key}, r.place, r.pattern, r.s AS m_start, r.e AS m_end, r.sim FROM {case.table} d JOIN ranked r ON r.t = d.{case.column}"


def kept_sql(case: Case, order: str = "default", unique: bool = False) -> str:
    return f"WITH RECURSIVE {resolved_sql(case, order, unique)} SELECT d.{case.key}, k.m.pattern AS pattern, k.m.s AS m_start, k.m.e AS m_end, k.m.sim AS sim FROM {case.table} d JOIN kept k ON k.t = d.{case.column}"


def pieces_sql(case: Case) -> str:
    """... and ``seg(t, seq, matched, s, e, x)``: matches and the gaps between them."""
    return f"""{resolved_sql(case)},
edges AS (SELECT t, m.s AS s, m.e AS e, coalesce(lag(m.e) OVER (PARTITION BY t ORDER BY m.s, m.e), 0) AS before FROM kept),
cuts AS (
  SELECT t, true AS matched, s, e FROM edges
  UNION ALL SELECT t, false, before, s FROM edges WHERE s > before
  UNION ALL SELECT t, false, max(e), length(t) FROM edges GROUP BY t HAVING length(t) > max(e)
  UNION ALL SELECT t, false, 0, length(t) FROM src WHERE length(t) > 0 AND t NOT IN (SELECT t FROM edges)
),
seg AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY s, e) AS seq, matched, s, e, substr(t, (s + 1)::INT, (e - s)::INT) AS x FROM cuts)"""
