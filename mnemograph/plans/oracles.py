"""DuckDB SQL for the registered queries, written apart from the Spark plans.

Every statement is assembled from named CTEs; ``sql`` adds the ones a
statement needs, in order.
"""

from __future__ import annotations

import re

from mnemograph import params as P
from mnemograph.plans.queries import LANE, QUERY, TEXT_QUERY
from mnemograph.sources.tables import NOUNS, TYPE_BANDS, VERBS

NOW = "1706659200000000"  # 2024-01-31 00:00:00 UTC in microseconds


def strings(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def rnd(x: str, digits: int = 4) -> str:
    scale = f"1e{digits}"
    return f"(floor(({x}) * {scale} + 0.500001::DOUBLE) / {scale})"


def evt(n: str) -> str:
    return f"(CASE WHEN {n} >= 1 THEN 'evt_' || CAST({n} AS VARCHAR) END)"


def compact(*items: str) -> str:
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def pick(words, index: str) -> str:
    return f"([{strings(words)}])[{index} + 1]"


def of(*types: str) -> str:
    return f"type IN ({strings(types)})"


def recency(ts: str) -> str:
    return (f"pow(0.5, greatest(0.0, coalesce(({NOW} - epoch_us({ts})) / 86400000000.0, 0.0)) "
            f"/ {P.HALF_LIFE_DAYS})")


def importance(ty: str) -> str:
    rows = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in P.IMPORTANCE.items())
    return f"(CASE {ty} {rows} ELSE {P.DEFAULT_IMPORTANCE}::DOUBLE END)"


def base_activation() -> str:
    return rnd(f"0.5::DOUBLE * importance + 0.3::DOUBLE * {recency('ts')} + 0.2::DOUBLE * "
               f"(CASE WHEN unresolved = 1 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END) + "
               f"least(0.3::DOUBLE, 0.06::DOUBLE * reinforced)")


def salience(imp: str, rel: str = "0.0::DOUBLE") -> str:
    return rnd(f"0.3::DOUBLE * {imp} + 0.2::DOUBLE * {recency('ts')} + 0.25::DOUBLE * {rel} + "
               f"0.15::DOUBLE * unresolved + 0.1::DOUBLE * (1.0 - exp(-linked / 5.0::DOUBLE))")


def type_case() -> str:
    out = []
    for ev, bands in TYPE_BANDS.items():
        for high, name in bands:
            out.append(f"WHEN ev = '{ev}' AND k >= 0 AND k < {high} THEN '{name}'")
    return "CASE " + " ".join(out) + " ELSE ev END"


def layer(ty: str) -> str:
    return (f"CASE WHEN {ty} IN ({strings(P.COGNITIVE_TYPES)}) THEN 'cognitive' "
            f"WHEN {ty} IN ({strings(P.EXECUTION_TYPES)}) THEN 'execution' ELSE 'meta' END")


def tokens(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(regexp_replace(lower({text}), "
            f"'[^a-z0-9\\s_-]', ' ', 'g'), '\\s+'), lambda w: length(w) > 1 AND "
            f"w NOT IN ({strings(P.TOKEN_STOPS)}))")


def term_list(text: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '[a-z][a-z0-9_-]{{2,}}'), "
            f"lambda w: w NOT IN ({strings(P.TERM_STOPS)}))")


def lead(text: str) -> str:
    return f"coalesce(({term_list(text)})[1], '')"


def slug(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', '-', 'g'), '-')"


def fts(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(strip_accents(lower({text})), "
            f"'[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')")


BODY = ("coalesce(nullif(concat_ws(' ', nullif(msg, ''), nullif(title, ''), nullif(path, ''), "
        "nullif(reason, ''), nullif(resolution, '')), ''), type)")
SEARCH_BODY = ("concat_ws(' ', type, msg, path, reason, resolution, branch, project, session, id, "
               "nullif(array_to_string(topics, ' '), ''), nullif(array_to_string(links, ' '), ''))")

CTES: dict[str, str] = {}

VERB, NOUN = pick(VERBS, "k % 8"), pick(NOUNS, "u % 9")
CTES["ev"] = """
 SELECT event_id + 1 AS seq, date_trunc('second', ts) AS ts, user_id AS u, event_type AS ev,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"""
CTES["typed"] = f"""
 SELECT *, {type_case()} AS type,
  CAST(floor((epoch_us(ts) - 1704067200000000) / 604800000000.0) AS BIGINT) AS week FROM ev"""
CTES["log"] = f"""
 SELECT seq, ts, type, {evt('seq')} AS event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS t,
  CASE WHEN type = 'session_start' THEN 's' || u || '_' || week
       WHEN type = 'session_end' AND k % 2 = 0 THEN NULL
       WHEN k % 11 = 0 THEN 's' || u || '_' || week END AS session,
  CASE WHEN type = 'session_start' AND k % 2 = 0 THEN 'proj' || (u % 5) END AS project,
  CASE WHEN type = 'session_end' AND k % 3 = 0 THEN 'done' END AS status,
  CASE WHEN type = 'branch_merge' THEN CASE WHEN k = 30 THEN 'exp1' ELSE 'exp3' END
       WHEN type = 'branch_open' THEN 'exp' || (k % 4)
       WHEN k % 5 = 0 AND type <> 'session_start' THEN 'exp' || (k % 4) END AS branch,
  CASE WHEN type = 'branch_open' AND k % 2 = 0 THEN 'exp1' END AS base,
  ([NULL, 'memory', 'coder', 'planner', 'researcher'])[k % 5 + 1] AS agent,
  CASE WHEN {of('open_loop', 'loop_closed')} AND k % 29 <> 0 THEN u || ':' || (k % 7) END AS id,
  CASE WHEN NOT {of('session_start', 'session_end', 'artifact', 'attended', 'checkpoint',
                    'thread_open', 'thread_merge', 'thread_split')}
       THEN {VERB} || ' ' || {NOUN} || ' k' || k END AS msg,
  CASE WHEN type = 'thread_open' THEN {NOUN} || ' work' END AS title,
  CASE WHEN type = 'artifact' THEN 'src/' || {NOUN} || '_' || (u % 30) || '.py' END AS path,
  CASE WHEN type = 'artifact' AND k % 2 = 0 THEN 'edited' END AS action,
  CASE WHEN type = 'checkpoint' THEN 'idle' END AS reason,
  CASE WHEN type = 'loop_closed' AND k % 3 = 0 THEN 'done' END AS resolution,
  CASE WHEN type = 'proc_executed' AND k % 3 = 0 THEN 'Failure'
       WHEN type = 'proc_executed' AND k % 3 = 1 THEN 'success' END AS outcome,
  CASE WHEN {of('thread_open', 'thread_merge', 'thread_split')}
       THEN 'thr_u' || u || '_w' || week END AS thread_id,
  CASE WHEN type = 'thread_merge' THEN 'thr_k' || (k % 10) END AS into_,
  CASE WHEN type = 'thread_split' THEN 'thr_k' || (k % 10) END AS spawn,
  CASE WHEN type = 'attended' THEN {evt('(seq - 1 - k % 5)')} END AS target,
  CASE WHEN NOT {of('session_start', 'session_end', 'attended', 'snapshot', 'checkpoint')}
       THEN {compact("'thr_u' || u || '_w' || week",
                     "CASE WHEN k % 3 = 0 THEN 'thr_k' || (k % 10) END")} END AS thread_ids,
  CASE WHEN type <> 'attended' THEN {compact(
      evt('(seq - 1 - k % 3)'),
      "CASE WHEN k % 4 = 1 THEN " + evt('(seq - 1 - (seq - 1) % 16)') + " END")} END AS causes,
  CASE WHEN type = 'contradiction' AND k % 2 = 0
       THEN {compact(evt('(seq - 1)'), evt('(seq - 2)'))} END AS between_,
  CASE WHEN {of('concept_formed', 'concept_retired')} THEN 'cpt_' || (u % 97) END AS concept_id,
  CASE WHEN {of('proc_executed', 'procedure_learned', 'procedure_retired', 'pattern_promoted')}
       THEN 'prc_' || (u % 20) END AS procedure_id,
  CASE WHEN type = 'pattern_detected' THEN 'pat_success_' || (u % 15)
       WHEN type = 'pattern_promoted' THEN 'pat_success_' || (u % 2) END AS pattern_id,
  CASE WHEN type = 'pattern_detected' THEN
       CASE k % 3 WHEN 0 THEN 'failure' WHEN 1 THEN 'success' END END AS kind,
  CASE WHEN type = 'pattern_detected'
       THEN 'successful path: ' || {NOUN} || ' → ' || {VERB} END AS label,
  CASE WHEN {of('concept_formed', 'procedure_learned', 'pattern_detected')} THEN {compact(
      evt('(seq - 1)'), evt('(seq - 1 - k % 7)'), evt('(seq - 10 - k)'),
      "CASE WHEN type = 'pattern_detected' THEN 'thr_u' || u || '_w' || week END")}
       END AS evidence,
  CASE WHEN type = 'procedure_learned' AND k % 2 = 0 THEN [{VERB}, {NOUN}] END AS trigger_,
  CASE WHEN type = 'procedure_learned' THEN ['first ' || {VERB}, 'then ' || {NOUN}] END AS steps,
  CASE WHEN type = 'pattern_detected' AND k % 2 = 0 THEN ['guard ' || {NOUN}] END AS recommended,
  CASE WHEN type = 'concept_formed' AND k % 7 = 0 THEN k % 5 + 1 END AS support,
  CASE WHEN type = 'concept_formed' AND k % 6 = 0 THEN (k % 12) / 20.0::DOUBLE END AS salience,
  CASE WHEN type = 'pattern_detected' AND k % 2 = 0 THEN (k % 30) / 40.0::DOUBLE + 0.25::DOUBLE
       WHEN type = 'pattern_promoted' THEN 0.8::DOUBLE END AS confidence,
  CASE WHEN type = 'pattern_detected' AND k % 5 = 0 THEN k % 4 + 1 END AS frequency,
  CASE WHEN type = 'procedure_learned' AND k = 21 THEN 0.4::DOUBLE END AS outcome_score,
  CASE WHEN type = 'snapshot' THEN seq - 1 END AS snapshot_seq,
  CASE WHEN {of('observation', 'decision')}
       THEN [{NOUN}, {pick(NOUNS, 'k % 9')}] END AS topics,
  CASE WHEN type = 'decision' AND k % 4 = 0 THEN ['artifact:' || {NOUN}] END AS links
 FROM typed"""
CTES["merged"] = """
 SELECT DISTINCT coalesce(branch, base) AS branch FROM log WHERE type = 'branch_merge'"""
CTES["main"] = """
 SELECT * FROM log WHERE branch IS NULL OR branch IN (SELECT branch FROM merged)"""
CTES["closed"] = "SELECT DISTINCT id FROM main WHERE type = 'loop_closed'"
CTES["closed_all"] = "SELECT DISTINCT id FROM log WHERE type = 'loop_closed'"
CTES["sess"] = """
 SELECT *, last_value(CASE WHEN type = 'session_start' THEN session END IGNORE NULLS) OVER (
   ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS current_session FROM log"""
CTES["ins"] = "SELECT *, coalesce(session, current_session) AS in_session FROM sess"

# -- graph ------------------------------------------------------------------------
CTES["reinforced"] = """
 SELECT target AS event_id, count(*) AS reinforced FROM main
 WHERE type = 'attended' AND target IS NOT NULL GROUP BY 1"""
CTES["events_n"] = f"""
 SELECT m.event_id, seq, t, ts, type, {layer('type')} AS layer, {BODY} AS body,
  {importance('type')} AS importance,
  CASE WHEN type = 'open_loop' AND NOT EXISTS (
    SELECT 1 FROM closed c WHERE c.id IS NOT DISTINCT FROM m.id) THEN 1 ELSE 0 END AS unresolved,
  CAST(coalesce(r.reinforced, 0) AS INTEGER) AS reinforced
 FROM main m LEFT JOIN reinforced r ON m.event_id = r.event_id"""
CTES["mem"] = "SELECT event_id, unnest(list_distinct(thread_ids)) AS thread_id FROM main"
CTES["pairs"] = """
 SELECT a.thread_id AS a, b.thread_id AS b, count(*) AS shared FROM mem a JOIN mem b
 ON a.event_id = b.event_id AND a.thread_id < b.thread_id GROUP BY 1, 2"""
CTES["causal"] = "SELECT unnest(causes) AS src, event_id AS dst FROM main"
CTES["rivals"] = """
 SELECT p[1] AS src, p[2] AS dst FROM (
  SELECT CASE WHEN len(coalesce(between_, [])) > 0 THEN between_ ELSE causes END AS p
  FROM main WHERE type = 'contradiction') WHERE len(p) >= 2"""
CTES["life"] = """
 SELECT thread_id AS src, coalesce(into_, spawn) AS dst FROM main
 WHERE type IN ('thread_merge', 'thread_split') AND coalesce(into_, spawn) IS NOT NULL"""
CTES["thr_ids"] = """
 SELECT thread_id FROM mem UNION SELECT thread_id FROM main
  WHERE type IN ('thread_open', 'thread_merge')
 UNION SELECT spawn FROM main WHERE type = 'thread_split' AND spawn IS NOT NULL"""
CTES["thr_mem"] = """
 SELECT mem.thread_id, count(*) AS n_events, max(ts) AS last_ts, max(t) AS last_activity_t
 FROM mem JOIN main USING (event_id) GROUP BY 1"""
CTES["thr"] = f"""
 SELECT i.thread_id, coalesce(o.title, i.thread_id) AS title, o.opened_t, m.last_activity_t,
  m.last_ts, CASE WHEN g.thread_id IS NOT NULL THEN 'merged'
   WHEN m.last_ts IS NULL OR ({NOW} - epoch_us(m.last_ts)) / 86400000000.0 > 14 THEN 'dormant'
   ELSE 'active' END AS status, g.merged_into, coalesce(m.n_events, 0) AS n_events
 FROM thr_ids i LEFT JOIN thr_mem m ON i.thread_id = m.thread_id
 LEFT JOIN (SELECT thread_id, arg_max(title, seq) AS title, arg_max(t, seq) AS opened_t
   FROM main WHERE type = 'thread_open' GROUP BY 1) o ON i.thread_id = o.thread_id
 LEFT JOIN (SELECT thread_id, arg_max(into_, seq) AS merged_into FROM main
   WHERE type = 'thread_merge' GROUP BY 1) g ON i.thread_id = g.thread_id"""
CTES["active_ev"] = """
 SELECT DISTINCT event_id FROM mem JOIN thr USING (thread_id) WHERE status = 'active'"""
CTES["snap"] = """
 SELECT coalesce(max(snapshot_seq), 0) AS s FROM main WHERE type = 'snapshot'"""

# -- memory folds -------------------------------------------------------------------
CTES["c_ev"] = """
 SELECT concept_id, seq, t, type, msg, support, salience, evidence,
  row_number() OVER (PARTITION BY concept_id, type ORDER BY seq) AS j,
  arg_max(type, seq) OVER (PARTITION BY concept_id) AS last_type
 FROM main WHERE type IN ('concept_formed', 'concept_retired')"""
CTES["c_cum"] = """
 SELECT *, len(list_distinct(flatten(list(evidence) OVER (PARTITION BY concept_id ORDER BY seq
   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)))) AS e
 FROM c_ev WHERE type = 'concept_formed' AND last_type = 'concept_formed'"""
CTES["c_fold"] = """
 SELECT concept_id, j, coalesce(support, greatest(e, 1)) AS s FROM c_cum WHERE j = 1
 UNION ALL
 SELECT c.concept_id, c.j, coalesce(c.support, greatest(c.e, f.s + 1)) AS s
 FROM c_fold f JOIN c_cum c ON c.concept_id = f.concept_id AND c.j = f.j + 1"""
CTES["conc_ev"] = """
 SELECT DISTINCT concept_id, unnest(evidence) AS event_id FROM c_cum"""
CTES["conc"] = f"""
 SELECT h.concept_id, h.summary,
  coalesce(nullif(h.explicit, 0), {rnd(
      "least(0.9::DOUBLE, 0.4::DOUBLE + 0.1::DOUBLE * f.s) * (0.5::DOUBLE + 0.5::DOUBLE * "
      + recency('e.ts') + ")")}) AS salience,
  CAST(f.s AS BIGINT) AS support, h.formed_t
 FROM (SELECT concept_id, arg_max(msg, seq) AS summary, arg_max(salience, seq) AS explicit,
         arg_min(t, seq) AS formed_t, max(j) AS n
       FROM c_cum GROUP BY 1) h
 JOIN c_fold f ON f.concept_id = h.concept_id AND f.j = h.n
 LEFT JOIN (SELECT v.concept_id, max(n.ts) AS ts FROM conc_ev v JOIN events_n n
   ON n.event_id = v.event_id GROUP BY 1) e ON e.concept_id = h.concept_id"""
CTES["p_ev"] = """
 SELECT procedure_id AS pid, seq, t, type, msg, label, trigger_, steps, confidence, outcome_score,
  evidence, CASE WHEN lower(coalesce(outcome, 'success')) IN ('failure', 'fail', 'error', '0')
   THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS target,
  min(CASE WHEN type IN ('procedure_learned', 'pattern_promoted') THEN seq END)
   OVER (PARTITION BY procedure_id) AS first_seq
 FROM main WHERE procedure_id IS NOT NULL"""
CTES["p_step"] = """
 SELECT *, row_number() OVER (PARTITION BY pid ORDER BY seq) AS j
 FROM p_ev WHERE seq >= first_seq AND type <> 'procedure_retired'"""
CTES["p_fold"] = """
 SELECT pid, j, CASE WHEN outcome_score IS NOT NULL THEN outcome_score
   WHEN type = 'pattern_promoted' THEN confidence END AS score FROM p_step WHERE j = 1
 UNION ALL
 SELECT s.pid, s.j, CASE
   WHEN s.type = 'proc_executed' THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE,
     coalesce(f.score, 0.5::DOUBLE) + 0.25::DOUBLE * (s.target - coalesce(f.score, 0.5::DOUBLE))))
   WHEN s.outcome_score IS NOT NULL THEN s.outcome_score
   WHEN s.type = 'pattern_promoted' AND f.score IS NULL THEN s.confidence
   ELSE f.score END
 FROM p_fold f JOIN p_step s ON s.pid = f.pid AND s.j = f.j + 1"""
CTES["p_retired"] = """
 SELECT pid FROM p_ev WHERE type <> 'proc_executed' GROUP BY 1
 HAVING arg_max(type, seq) = 'procedure_retired'"""
CTES["proc"] = f"""
 SELECT h.pid AS procedure_id, h.label, h.steps, h.trigger_,
  coalesce(f.score, {rnd('least(0.9::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (h.uses - 1))')})
   AS outcome_score, h.uses, h.last_used_t
 FROM (SELECT pid, max(j) AS n, arg_max(t, seq) AS last_used_t,
   arg_max(coalesce(label, msg), seq) FILTER (type <> 'proc_executed') AS label,
   coalesce(array_to_string(arg_max(steps, seq) FILTER (steps IS NOT NULL), chr(10)), '') AS steps,
   coalesce(array_to_string(arg_max(trigger_, seq) FILTER (trigger_ IS NOT NULL), ','), '')
    AS trigger_,
   count(*) FILTER (type <> 'pattern_promoted') AS uses FROM p_step GROUP BY 1) h
 JOIN p_fold f ON f.pid = h.pid AND f.j = h.n
 WHERE h.pid NOT IN (SELECT pid FROM p_retired)"""
CTES["proc_ev"] = """
 SELECT DISTINCT pid AS procedure_id, unnest(evidence) AS event_id FROM p_step
 WHERE type IN ('procedure_learned', 'pattern_promoted')
  AND pid IN (SELECT procedure_id FROM proc)"""
CTES["t_step"] = """
 SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY seq) AS j
 FROM main WHERE type = 'pattern_detected'"""
CTES["t_fold"] = """
 SELECT pattern_id, j, coalesce(frequency, 1) AS freq FROM t_step WHERE j = 1
 UNION ALL
 SELECT s.pattern_id, s.j, coalesce(s.frequency, f.freq + 1) FROM t_fold f
 JOIN t_step s ON s.pattern_id = f.pattern_id AND s.j = f.j + 1"""
CTES["pat"] = f"""
 SELECT h.pattern_id, h.kind, h.label,
  coalesce(nullif(h.conf, 0), {rnd('least(0.95::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (f.freq - 1))')})
   AS confidence, f.freq AS frequency, h.recommended, h.last_seen_t
 FROM (SELECT pattern_id, max(j) AS n,
   coalesce(arg_max(kind, seq) FILTER (kind IS NOT NULL), 'reasoning') AS kind,
   arg_max(label, seq) AS label, arg_max(confidence, seq) FILTER (confidence IS NOT NULL) AS conf,
   coalesce(array_to_string(arg_max(recommended, seq) FILTER (recommended IS NOT NULL), ','), '')
    AS recommended, arg_max(t, seq) AS last_seen_t FROM t_step GROUP BY 1) h
 JOIN t_fold f ON f.pattern_id = h.pattern_id AND f.j = h.n"""
CTES["pat_ev"] = """
 SELECT pattern_id, CASE WHEN ref_id LIKE 'thr\\_%' ESCAPE '\\' THEN 'thread'
   WHEN ref_id LIKE 'cpt\\_%' ESCAPE '\\' THEN 'concept'
   WHEN ref_id LIKE 'prc\\_%' ESCAPE '\\' THEN 'procedure' ELSE 'event' END AS ref_kind,
  ref_id, min(seq) AS first_seq
 FROM (SELECT pattern_id, seq, unnest(evidence) AS ref_id FROM t_step) GROUP BY 1, 2, 3"""
CTES["c_thr"] = """
 SELECT DISTINCT concept_id, thread_id FROM conc_ev JOIN mem USING (event_id)"""
CTES["c_pairs"] = """
 SELECT a.concept_id AS a, b.concept_id AS b, count(*) AS shared FROM c_thr a JOIN c_thr b
 ON a.thread_id = b.thread_id AND a.concept_id < b.concept_id GROUP BY 1, 2 HAVING count(*) >= 2"""
CTES["reson"] = f"""
 SELECT DISTINCT a AS src, b AS dst, shared,
  {rnd('0.5::DOUBLE * least(1.0::DOUBLE, shared / 4.0::DOUBLE)')} AS weight
 FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY shared DESC, other DESC) AS r
  FROM (SELECT a AS c, b AS other, a, b, shared FROM c_pairs
   UNION ALL SELECT b, a, a, b, shared FROM c_pairs)) WHERE r <= 6"""
CTES["nodes_all"] = """
 SELECT event_id, seq, ts, type, layer, body, importance, unresolved, reinforced FROM events_n
 UNION ALL SELECT concept_id, NULL, CAST(substr(formed_t, 1, 19) AS TIMESTAMP), 'concept',
  'semantic', summary, salience, 0, 0 FROM conc
 UNION ALL SELECT procedure_id, NULL, CAST(substr(last_used_t, 1, 19) AS TIMESTAMP), 'procedure',
  'procedural', label, outcome_score, 0, 0 FROM proc
 UNION ALL SELECT pattern_id, NULL, CAST(substr(last_seen_t, 1, 19) AS TIMESTAMP), 'pattern',
  'pattern', label, confidence, 0, 0 FROM pat"""
CTES["nodes"] = """
 SELECT n.*, CASE WHEN seq IS NOT NULL AND seq <= s AND s > 0 AND unresolved = 0
   AND a.event_id IS NULL THEN 1 ELSE 0 END AS cold
 FROM nodes_all n LEFT JOIN active_ev a ON n.event_id = a.event_id, snap"""
CTES["edges"] = """
 SELECT event_id AS src, thread_id AS dst, 'membership' AS kind, 0.7::DOUBLE AS weight FROM mem
 UNION ALL SELECT src, dst, 'causal', 1.0::DOUBLE FROM causal
 UNION ALL SELECT src, dst, 'thread_rel', 1.0::DOUBLE FROM life
 UNION ALL SELECT a, b, 'thread_rel', 0.4::DOUBLE * shared FROM pairs
 UNION ALL SELECT concept_id, event_id, 'concept', 0.6::DOUBLE FROM conc_ev
 UNION ALL SELECT procedure_id, event_id, 'procedure', 0.6::DOUBLE FROM proc_ev
 UNION ALL SELECT pattern_id, ref_id, 'pattern', 0.55::DOUBLE FROM pat_ev
 UNION ALL SELECT src, dst, 'resonance', weight FROM reson"""

# -- attention ----------------------------------------------------------------------
CTES["adj"] = """
 SELECT src AS v, dst AS u, weight AS w FROM edges
 UNION ALL SELECT dst, src, CASE WHEN kind = 'causal' THEN 0.6::DOUBLE * weight ELSE weight END
 FROM edges"""
CTES["fired"] = """
 SELECT DISTINCT procedure_id, outcome_score FROM
  (SELECT procedure_id, outcome_score, lower(trim(unnest(string_split(trigger_, ',')))) AS term
   FROM proc WHERE trigger_ <> '') p
 JOIN (SELECT DISTINCT lower(body) AS hay FROM nodes WHERE unresolved = 1) h
  ON contains(h.hay, p.term)"""
CTES["floors"] = """
 SELECT event_id, max(f) AS f FROM (
  SELECT event_id, 0.9::DOUBLE AS f FROM nodes WHERE unresolved = 1
  UNION ALL SELECT event_id, 0.5::DOUBLE FROM active_ev
  UNION ALL SELECT concept_id, 0.55::DOUBLE * salience FROM conc
  UNION ALL SELECT procedure_id, 0.6::DOUBLE * outcome_score FROM fired
  UNION ALL SELECT pattern_id, 0.5::DOUBLE * confidence FROM pat) GROUP BY 1"""
CTES["seeded"] = f"""
 SELECT n.event_id, {base_activation()} AS base,
  CASE WHEN cold = 1 THEN 0.0::DOUBLE ELSE coalesce(f, 0.0::DOUBLE) END AS seed
 FROM nodes n LEFT JOIN floors USING (event_id)"""
CTES["act0"] = "SELECT event_id, base + seed AS act FROM seeded"
for _i in (1, 2):
    CTES[f"act{_i}"] = f"""
 SELECT s.event_id, 0.6::DOUBLE * base + 0.3::DOUBLE * coalesce(r.x, 0.0) + seed AS act
 FROM seeded s LEFT JOIN (SELECT v, sum(w * act) AS x FROM adj JOIN act{_i - 1} a
  ON a.event_id = adj.u GROUP BY 1) r ON r.v = s.event_id"""
CTES["riv"] = """
 SELECT r.* FROM rivals r WHERE src IN (SELECT event_id FROM nodes)
  AND dst IN (SELECT event_id FROM nodes)"""
CTES["riv2"] = "SELECT src AS a, dst AS b FROM riv UNION ALL SELECT dst, src FROM riv"


def inhibit_from(first: str, prefix: str) -> None:
    last = first
    for i in range(1, 5):
        CTES[f"{prefix}{i}"] = f"""
 SELECT n.event_id, greatest(0.0::DOUBLE, n.act - 0.35::DOUBLE * coalesce(r.x, 0.0)) AS act
 FROM {last} n LEFT JOIN (SELECT a, sum(act) AS x FROM riv2 JOIN {last} p ON p.event_id = riv2.b
  GROUP BY 1) r ON r.a = n.event_id"""
        last = f"{prefix}{i}"


inhibit_from("act2", "inh")
CTES["base_act"] = f"SELECT event_id, {base_activation()} AS act FROM nodes"
inhibit_from("base_act", "binh")
CTES["tens"] = f"""
 SELECT src, dst, {rnd('a.act')} AS src_score, {rnd('b.act')} AS dst_score FROM riv
 JOIN inh4 a ON a.event_id = src JOIN inh4 b ON b.event_id = dst"""
CTES["peaks"] = """
 SELECT thread_id, max(act) AS peak FROM mem JOIN inh4 USING (event_id) GROUP BY 1"""
CTES["thr_act"] = f"""
 SELECT thread_id, status, CAST(status = 'dormant' AND coalesce(peak, 0) > 0.4 AS INTEGER)
   AS resurfaced, {rnd("coalesce(peak, 0.0) + CASE WHEN status = 'dormant' AND "
                       "coalesce(peak, 0) > 0.4 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END")}
   AS activation
 FROM thr LEFT JOIN peaks USING (thread_id)"""
CTES["acted"] = f"""
 SELECT i.event_id, s.base, {rnd('s.seed')} AS seed,
  {rnd('i.act + 0.125::DOUBLE * coalesce(l.n, 0)')} AS activation
 FROM inh4 i JOIN seeded s USING (event_id) LEFT JOIN (SELECT event_id, count(*) AS n FROM mem
  JOIN thr_act USING (thread_id) WHERE resurfaced = 1 GROUP BY 1) l USING (event_id)"""
CTES["degree"] = """
 SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges)
 GROUP BY 1"""
CTES["inc0"] = """
 SELECT m.event_id, 0.3::DOUBLE * (1.0::DOUBLE - exp(-coalesce(max(degree), 0) / 5.0::DOUBLE)) AS a
 FROM mem m JOIN thr USING (thread_id) LEFT JOIN degree d ON d.id = m.event_id
 WHERE status = 'dormant' GROUP BY m.event_id, degree"""
CTES["adj_sym"] = """
 SELECT src AS v, dst AS u, weight AS w FROM edges
 UNION ALL SELECT dst, src, weight FROM edges"""
for _i in (1, 2):
    CTES[f"inc{_i}"] = f"""
 SELECT n.event_id, 0.25::DOUBLE * coalesce(r.x, 0.0) + coalesce(s.a, 0.0) AS a
 FROM nodes n LEFT JOIN (SELECT v, sum(w * a) AS x FROM adj_sym JOIN inc{_i - 1} i
  ON i.event_id = adj_sym.u GROUP BY 1) r ON r.v = n.event_id
 LEFT JOIN inc0 s ON s.event_id = n.event_id"""
CTES["lifts"] = f"SELECT event_id, {rnd('a')} AS lift FROM inc2 WHERE a > 0.01"
CTES["core"] = """
 SELECT event_id AS id FROM acted JOIN nodes USING (event_id)
 ORDER BY activation DESC, seq NULLS LAST, event_id LIMIT 8"""
CTES["both_ways"] = "SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges"
CTES["hop1"] = "SELECT id FROM core UNION SELECT b FROM both_ways JOIN core ON id = a"
CTES["hop2"] = "SELECT id FROM hop1 UNION SELECT b FROM both_ways JOIN hop1 ON id = a"

# -- text -----------------------------------------------------------------------------
CTES["d_tok"] = f"SELECT doc_id, unnest({tokens('text')}) AS token FROM documents"
CTES["d_tf"] = "SELECT doc_id, token, count(*) AS tf FROM d_tok GROUP BY 1, 2"
CTES["d_len"] = "SELECT doc_id, sum(tf) AS total FROM d_tf GROUP BY 1"
CTES["d_df"] = "SELECT token, count(*) AS df FROM d_tf GROUP BY 1"
CTES["d_n"] = "SELECT count(*)::DOUBLE AS n FROM documents"
CTES["d_raw"] = """
 SELECT doc_id, token, tf / total::DOUBLE * (ln(n / (df + 1)) + 1) AS raw
 FROM d_tf JOIN d_len USING (doc_id) JOIN d_df USING (token), d_n"""
CTES["d_vec"] = f"""
 SELECT r.doc_id, token, {rnd('raw / norm', 6)} AS weight FROM d_raw r JOIN (
  SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM d_raw GROUP BY 1) q USING (doc_id)
 WHERE norm > 0"""
CTES["q_tok"] = f"""
 SELECT token, count(*) AS c FROM (SELECT unnest({tokens("'" + TEXT_QUERY + "'")}) AS token)
 GROUP BY 1"""
CTES["q_raw"] = """
 SELECT token, c * (ln(n / (df + 1)) + 1) AS raw FROM q_tok JOIN d_df USING (token), d_n"""


def bm25(source: str, key: str, text: str, query: str, alias: str) -> None:
    """CTEs ``alias`` (key, rank) from first principles over exploded tokens."""
    CTES[f"{alias}_tok"] = f"SELECT {key}, unnest({fts(text)}) AS tok FROM {source}"
    CTES[f"{alias}_len"] = f"""
 SELECT s.{key}, count(tok) AS len FROM (SELECT {key} FROM {source}) s
 LEFT JOIN {alias}_tok t ON t.{key} = s.{key} GROUP BY 1"""
    words = [w for w in query.lower().split()]
    CTES[f"{alias}_q"] = "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, '{w}')" for i, w in enumerate(words)) + ") v(i, prefix)"
    CTES[f"{alias}_f"] = f"""
 SELECT {key}, i, count(*) AS f FROM {alias}_tok JOIN {alias}_q ON starts_with(tok, prefix)
 GROUP BY 1, 2"""
    CTES[f"{alias}_idf"] = f"""
 SELECT i, CASE WHEN x <= 0 THEN 1e-6 ELSE x END AS w FROM (
  SELECT i, ln(((SELECT count(*) FROM {source}) - count(*) + 0.5::DOUBLE)
   / (count(*) + 0.5::DOUBLE)) AS x FROM {alias}_f GROUP BY 1)"""
    CTES[alias] = f"""
 SELECT {key}, {rnd(f"-sum(w * (f * 2.2::DOUBLE) / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE"
                    f" * len / (SELECT avg(len) FROM {alias}_len))))", 6)} AS rank
 FROM {alias}_f JOIN {alias}_idf USING (i) JOIN {alias}_len USING ({key}) GROUP BY 1"""


bm25("documents", "doc_id", "text", TEXT_QUERY, "bm")
CTES["log_text"] = f"SELECT *, {SEARCH_BODY} AS text FROM log"
bm25("log_text", "seq", "text", QUERY, "ebm")
CTES["art_sess"] = """
 SELECT DISTINCT path, in_session AS session FROM ins
 WHERE type = 'artifact' AND path IS NOT NULL AND in_session IS NOT NULL"""
CTES["linked"] = """
 SELECT l.seq, CASE WHEN s.n IS NOT NULL THEN s.n ELSE p.n END AS linked FROM log l
 LEFT JOIN (SELECT session, count(*) AS n FROM art_sess GROUP BY 1) s ON s.session = l.session
 LEFT JOIN (SELECT path, count(*) AS n FROM art_sess GROUP BY 1) p
  ON p.path = l.path AND l.type = 'artifact'
 WHERE coalesce(s.n, p.n) IS NOT NULL"""
CTES["scored_log"] = """
 SELECT l.*, coalesce(k.linked, 0) AS linked, CASE WHEN l.type = 'open_loop' AND NOT EXISTS (
   SELECT 1 FROM closed_all c WHERE c.id IS NOT DISTINCT FROM l.id) THEN 1 ELSE 0 END AS unresolved
 FROM log l LEFT JOIN linked k ON k.seq = l.seq"""


def drift_ctes(prefix: str, log: str) -> None:
    """CTE ``prefix``_drift: drift of the end of one log."""
    skip = strings(P.DRIFT_SKIP_TYPES)
    CTES[f"{prefix}_cur"] = f"""
 SELECT arg_max(session, seq) AS cur FROM {log} WHERE type = 'session_start'"""
    CTES[f"{prefix}_mine"] = f"""
 SELECT * FROM {log}, {prefix}_cur WHERE (cur IS NULL OR session = cur) AND type NOT IN ({skip})"""
    CTES[f"{prefix}_scope"] = f"""
 SELECT seq, {SEARCH_BODY} AS text FROM {prefix}_mine
  WHERE (SELECT count(*) FROM {prefix}_mine) > 5
 UNION ALL SELECT seq, {SEARCH_BODY} FROM {log}
  WHERE (SELECT count(*) FROM {prefix}_mine) <= 5"""
    CTES[f"{prefix}_rows"] = f"""
 SELECT text, row_number() OVER (ORDER BY seq DESC) AS place FROM {prefix}_scope"""
    CTES[f"{prefix}_bag"] = f"""
 SELECT token, sum(CASE WHEN place <= 5 THEN 1 ELSE 0 END)::DOUBLE AS a,
  sum(CASE WHEN place > 5 THEN 1 ELSE 0 END)::DOUBLE AS b
 FROM (SELECT place, unnest({tokens('text')}) AS token FROM {prefix}_rows WHERE place <= 15)
 GROUP BY 1"""
    CTES[f"{prefix}_drift"] = f"""
 SELECT {rnd("1.0 - CASE WHEN sqrt(sum(a * a)) * sqrt(sum(b * b)) > 0 THEN sum(a * b) / "
             "(sqrt(sum(a * a)) * sqrt(sum(b * b))) ELSE 0.0 END")} AS drift
 FROM {prefix}_bag"""


drift_ctes("g", "log")
drift_ctes("m", "main")

# -- mining -------------------------------------------------------------------------
CTES["member_ev"] = """
 SELECT n.event_id, n.seq, n.type, n.body, n.unresolved, m.thread_id FROM events_n n
 JOIN mem m ON m.event_id = n.event_id"""
CTES["won"] = "SELECT DISTINCT thread_id FROM member_ev WHERE type = 'loop_closed'"
CTES["grams"] = f"""
 SELECT DISTINCT thread_id, a || ' → ' || b || ' → ' || c AS gram,
  a || '-' || b || '-' || c AS dashed FROM (
  SELECT thread_id, lag(type, 2) OVER w AS a, lag(type, 1) OVER w AS b, type AS c FROM member_ev
  WHERE type IN ({strings(P.REASON_TYPES)}) WINDOW w AS (PARTITION BY thread_id ORDER BY seq))
 WHERE a IS NOT NULL"""
CTES["fails"] = f"""
 SELECT {lead('body')} AS term, thread_id, event_id FROM member_ev
 WHERE (type IN ({strings(P.FAILURE_TYPES)}) OR (type = 'open_loop' AND unresolved = 1))"""
CTES["paths"] = f"""
 SELECT path, dashed, first_term, count(*) AS support, min(thread_id) AS thread_id FROM (
  SELECT thread_id, string_agg(term, ' → ' ORDER BY seq) AS path,
   string_agg(term, '-' ORDER BY seq) AS dashed, arg_min(term, seq) AS first_term,
   count(*) AS n, count(*) FILTER (term = '') AS blank
  FROM (SELECT thread_id, seq, {lead('body')} AS term FROM member_ev
   WHERE type IN ({strings(P.PROC_STEP_TYPES)}) AND thread_id IN (SELECT thread_id FROM won))
  GROUP BY 1) WHERE n >= 2 AND blank = 0 GROUP BY 1, 2, 3 HAVING count(*) >= 2"""
CTES["path_thr"] = f"""
 SELECT thread_id, string_agg(term, ' → ' ORDER BY seq) AS path,
  string_agg(type || ': ' || substr(body, 1, 80), chr(10) ORDER BY seq) AS steps
 FROM (SELECT thread_id, seq, type, body, {lead('body')} AS term FROM member_ev
  WHERE type IN ({strings(P.PROC_STEP_TYPES)}) AND thread_id IN (SELECT thread_id FROM won))
 GROUP BY 1"""
CTES["stops"] = """
 SELECT m.event_id, m.seq, m.body, d.deps, min(m.thread_id) AS thread_id FROM member_ev m
 JOIN (SELECT src, count(*) AS deps FROM causal GROUP BY 1 HAVING count(*) >= 3) d
  ON d.src = m.event_id
 WHERE m.thread_id IN (SELECT thread_id FROM member_ev WHERE unresolved = 1) GROUP BY 1, 2, 3, 4"""


def _needs(text: str) -> set[str]:
    """Names the text reads after FROM, JOIN or a comma between tables."""
    read = re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text)
    listed = re.findall(r",\s*(\w+)(?=\s*(?:$|WHERE\b|\)))", text)
    return {w for w in read + listed if w in CTES}


def sql(select: str) -> str:
    """``select`` behind the CTEs it reads, directly or through others."""
    order: list[str] = []

    def visit(name: str, path: tuple[str, ...] = ()) -> None:
        if name in order or name in path:
            return
        for dep in sorted(_needs(CTES[name]) - {name}):
            visit(dep, (*path, name))
        order.append(name)

    for name in sorted(_needs(select)):
        visit(name)
    if not order:
        return select
    recursive = {"c_fold", "p_fold", "t_fold", "lab_fold", "x_fold"}
    parts = [f"{n} AS {'' if n in recursive else 'MATERIALIZED '}({CTES[n]})" for n in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + select


# -- statements ---------------------------------------------------------------------
_SELECTS: dict[str, str] = {
    "log_layer_importance": f"""SELECT type, {layer('type')} AS layer,
 {importance('type')} AS importance, count(*) AS n FROM log GROUP BY 1, 2, 3""",
    "log_bodies": f"""SELECT seq, {BODY} AS body, {SEARCH_BODY} AS search_body,
 coalesce(msg, path, reason, type) AS title FROM log""",
    "log_state_fold": """SELECT
 arg_max(project, seq) FILTER (type = 'session_start' AND project IS NOT NULL) AS project,
 arg_max(branch, seq) FILTER (type = 'session_start' AND branch IS NOT NULL) AS branch,
 arg_max(session, seq) FILTER (type = 'session_start') AS session,
 coalesce(arg_max(CASE WHEN type = 'session_start' THEN 'active' ELSE coalesce(status, 'paused')
  END, seq) FILTER (type IN ('session_start', 'session_end')), 'unknown') AS status,
 arg_max(msg, seq) FILTER (type = 'objective') AS objective,
 count(*) FILTER (type = 'decision') AS decisions,
 count(*) FILTER (type = 'artifact') AS artifacts,
 count(*) FILTER (type = 'checkpoint') AS checkpoints,
 count(*) AS event_count, arg_max(t, seq) AS last_event_t FROM log""",
    "log_tail": "SELECT seq, t, type, event_id, msg FROM log ORDER BY seq DESC LIMIT 10",
    "session_carry_forward": "SELECT seq, current_session, in_session FROM ins",
    "session_rollup": """SELECT s.session, s.project, s.branch, s.started,
 arg_max(i.t, i.seq) FILTER (i.type = 'session_end') AS ended,
 CASE WHEN count(*) FILTER (i.type = 'session_end') = 0 THEN 'active' ELSE
  coalesce(arg_max(coalesce(i.status, 'paused'), i.seq) FILTER (i.type = 'session_end'), 'paused')
  END AS status, count(*) AS n_events
FROM (SELECT session, min(seq) AS first_seq, arg_min(t, seq) AS started,
  arg_min(coalesce(project, ''), seq) AS p, nullif(p, '') AS project,
  NULL::VARCHAR AS branch FROM log WHERE type = 'session_start' GROUP BY 1) s
JOIN ins i ON i.in_session = s.session AND i.seq >= s.first_seq GROUP BY 1, 2, 3, 4""",
    "decisions_projection": """SELECT seq, t, in_session AS session, msg,
 coalesce(array_to_string(links, ','), '') AS links FROM ins WHERE type = 'decision'""",
    "artifacts_newest": """SELECT seq, t, in_session AS session, path,
 coalesce(action, 'touched') AS action FROM ins WHERE type = 'artifact'
 ORDER BY t DESC, seq DESC LIMIT 10""",
    "loops_fold_order": """SELECT o.id, o.t AS opened_t, o.in_session AS session, o.msg,
 CASE WHEN c.seq IS NULL THEN 0 ELSE 1 END AS resolved, c.t AS resolved_t, c.resolution
FROM (SELECT *, coalesce(id, 'loop-' || seq) AS lid FROM ins WHERE type = 'open_loop') b
JOIN (SELECT coalesce(id, 'loop-' || seq) AS id, seq, t, in_session, msg FROM ins
  WHERE type = 'open_loop' QUALIFY row_number() OVER (
   PARTITION BY coalesce(id, 'loop-' || seq) ORDER BY seq DESC) = 1) o
 ON o.id = b.lid AND o.seq = b.seq
LEFT JOIN (SELECT id, seq, t, resolution FROM log WHERE type = 'loop_closed'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) c
 ON c.id = o.id AND c.seq > o.seq""",
    "loops_set_semantics": """SELECT seq, event_id, id FROM log l WHERE type = 'open_loop'
 AND NOT EXISTS (SELECT 1 FROM closed_all c WHERE c.id IS NOT DISTINCT FROM l.id)""",
    "loops_ranked": f"""SELECT seq, id, coalesce(msg, path, reason, type) AS msg, t,
 {salience(importance('type'))} AS salience FROM scored_log WHERE unresolved = 1""",
    "branch_listing": """SELECT b.branch, CASE WHEN b.branch = 'main' THEN 'main'
  WHEN b.branch IN (SELECT branch FROM merged) THEN 'merged' ELSE 'open' END AS status,
 coalesce(c.n, 0) AS events, coalesce(o.base, 'main') AS base
FROM (SELECT DISTINCT coalesce(branch, 'main') AS branch FROM log UNION SELECT branch FROM merged
  UNION SELECT 'main') b
LEFT JOIN (SELECT coalesce(branch, 'main') AS branch, count(*) AS n FROM log GROUP BY 1) c
 ON c.branch = b.branch
LEFT JOIN (SELECT branch, arg_max(coalesce(base, 'main'), seq) AS base FROM log
  WHERE type = 'branch_open' GROUP BY 1) o ON o.branch = b.branch""",
    "branch_projection_counts": "SELECT type, count(*) AS n FROM main GROUP BY 1",
    "branch_diff": """SELECT type, count(*) AS events,
 count(*) FILTER (branch = 'exp2' AND branch NOT IN (SELECT branch FROM merged)) AS added
FROM log WHERE branch IS NULL OR branch = 'exp2' OR branch IN (SELECT branch FROM merged)
GROUP BY 1""",
    "arbitration_audit": f"""SELECT event_id, type, agent FROM log
 WHERE type IN ({strings(P.CURATOR_TYPES)}) AND agent IS NOT NULL AND agent <> 'memory'""",
    "topic_shift_churn": f"""SELECT shifts, events,
 {rnd('least(1.0, shifts / greatest(1.0, events / 10.0))')} AS instability FROM (
 SELECT count(*) FILTER (type = 'topic_shift') AS shifts, count(*) AS events FROM (
  SELECT type FROM log ORDER BY seq DESC LIMIT 40))""",
    "event_nodes": """SELECT event_id, seq, type, layer, body, importance, unresolved, reinforced
 FROM events_n""",
    "membership_edges": "SELECT event_id, thread_id FROM mem",
    "causal_edges": "SELECT src, dst FROM causal",
    "causal_out_degree": "SELECT src, count(*) AS dependents FROM causal GROUP BY 1",
    "contradiction_edges": "SELECT src, dst FROM rivals",
    "thread_lifecycle_edges": "SELECT src, dst FROM life",
    "thread_rollup_status": """SELECT thread_id, title, opened_t, last_activity_t, status,
 merged_into, n_events FROM thr""",
    "thread_cooccurrence": "SELECT a, b, shared FROM pairs",
    "reinforcement_counts": "SELECT event_id, reinforced FROM reinforced",
    "compaction_cold": "SELECT event_id, seq FROM nodes WHERE cold = 1",
    "concept_fold": "SELECT concept_id, summary, salience, support, formed_t FROM conc",
    "concept_evidence": "SELECT concept_id, event_id FROM conc_ev",
    "procedure_fold": f"""SELECT procedure_id, label, steps, trigger_ AS trigger,
 {rnd('outcome_score')} AS outcome_score, uses, last_used_t FROM proc""",
    "pattern_fold": f"""SELECT pattern_id, kind, label, {rnd('confidence')} AS confidence,
 CAST(frequency AS BIGINT) AS frequency, recommended, last_seen_t FROM pat""",
    "pattern_evidence": "SELECT pattern_id, ref_kind, ref_id, first_seq FROM pat_ev",
    "resonance_edges": "SELECT src, dst, shared, weight FROM reson",
    "graph_summary": """SELECT (SELECT count(*) FROM nodes) AS nodes,
 (SELECT count(*) FROM nodes WHERE cold = 1) AS cold, (SELECT count(*) FROM thr) AS threads,
 (SELECT count(*) FROM edges) + (SELECT count(*) FROM rivals) AS edges,
 (SELECT count(*) FROM conc) AS concepts, (SELECT count(*) FROM proc) AS procedures,
 (SELECT count(*) FROM pat) AS patterns""",
    "graph_build": f"""SELECT kind, count(*) AS n, {rnd('sum(weight)')} AS weight FROM edges
 GROUP BY 1""",
    "pattern_list": f"""SELECT pattern_id, kind, {rnd('confidence')} AS confidence,
 CAST(frequency AS BIGINT) AS frequency FROM pat
 ORDER BY pat.confidence DESC, pat.frequency DESC, pattern_id LIMIT 10""",
    "node_degree": "SELECT id, degree FROM degree",
    "base_activation": "SELECT event_id, act AS base FROM base_act",
    "seed_vector": f"SELECT event_id, base, {rnd('seed')} AS seed FROM seeded",
    "seed_vector_role": f"""SELECT event_id, {rnd("""coalesce(greatest(
  CASE WHEN cold = 0 THEN CASE WHEN f IS NULL AND b IS NULL THEN NULL
   ELSE coalesce(f, 0.0) + coalesce(b, 0.0) END END, 0.5::DOUBLE * lift), 0.0)""")} AS seed
FROM (SELECT n.event_id, n.cold, f.f, l.lift, CASE WHEN r.x IS NULL AND m.n IS NULL THEN NULL
   ELSE coalesce(r.x, 0.0) + 0.65::DOUBLE * coalesce(m.n, 0) END AS b
 FROM nodes n LEFT JOIN floors f ON f.event_id = n.event_id
 LEFT JOIN lifts l ON l.event_id = n.event_id
 LEFT JOIN (SELECT event_id, 0.55::DOUBLE AS x FROM nodes
   WHERE type IN ({strings(P.ROLE_TYPES['coder'])})) r ON r.event_id = n.event_id
 LEFT JOIN (SELECT event_id, count(*) AS n FROM mem WHERE thread_id IN ({strings(LANE)})
   GROUP BY 1) m ON m.event_id = n.event_id)""",
    "triggered_procedures": f"""SELECT procedure_id, {rnd('outcome_score')} AS outcome_score
 FROM fired""",
    "spread_1hop": f"SELECT event_id, {rnd('act')} AS activation FROM act1",
    "spread_2hop": f"SELECT event_id, {rnd('act')} AS activation FROM act2",
    "inhibition_4rounds": f"SELECT event_id, {rnd('act')} AS activation FROM binh4",
    "contradiction_scores": "SELECT src, dst, src_score, dst_score FROM tens",
    "attend_nodes": "SELECT event_id, base, seed, activation FROM acted",
    "thread_activation_resurfaced": """SELECT thread_id, status, resurfaced, activation
 FROM thr_act""",
    "persistence_blend": f"""SELECT b.event_id,
 {rnd('0.7::DOUBLE * b.act + (1 - 0.7::DOUBLE) * coalesce(a.activation, 0.0)')} AS activation
 FROM base_act b LEFT JOIN acted a ON a.event_id = b.event_id""",
    "oscillation": f"""SELECT a.event_id, {rnd("""
  a.activation * CASE WHEN w.event_id IS NOT NULL THEN 1 - 0.25::DOUBLE ELSE 1.0::DOUBLE END
  + CASE WHEN r.event_id IS NOT NULL THEN 0.2::DOUBLE * top ELSE 0.0::DOUBLE END""")} AS activation
FROM acted a
LEFT JOIN (SELECT event_id FROM mem WHERE thread_id = (SELECT thread_id FROM (
   SELECT thread_id, max(activation) AS p FROM mem JOIN acted USING (event_id) GROUP BY 1)
   ORDER BY p DESC, thread_id LIMIT 1)) w ON w.event_id = a.event_id
LEFT JOIN (SELECT event_id FROM mem WHERE thread_id = (SELECT thread_id FROM (
   SELECT thread_id, max(activation) AS p FROM mem JOIN acted USING (event_id) GROUP BY 1)
   ORDER BY p DESC, thread_id LIMIT 1 OFFSET 1)) r ON r.event_id = a.event_id,
(SELECT max(activation) AS top FROM mem JOIN acted USING (event_id))""",
    "top_active_nodes": """SELECT event_id, type, activation FROM acted JOIN nodes USING (event_id)
 ORDER BY activation DESC, seq NULLS LAST, event_id LIMIT 8""",
    "active_subgraph_2hop": """SELECT n.event_id, n.type, n.layer, a.activation FROM nodes n
 JOIN acted a ON a.event_id = n.event_id WHERE n.event_id IN (SELECT id FROM hop2)""",
    "incubation": "SELECT event_id, lift FROM lifts",
    "agent_lane": """SELECT thread_id FROM thr_act ORDER BY activation DESC, thread_id LIMIT 4""",
    "resolve_contradictions": """SELECT CASE WHEN NOT decided THEN 'undecided'
  WHEN l.type = 'open_loop' THEN 'loop_closed' ELSE 'assumption_invalidated' END AS type,
 winner, loser, src_score, dst_score,
 CASE WHEN decided AND l.type = 'open_loop' THEN coalesce(m.id, loser) END AS id,
 CASE WHEN decided THEN CASE WHEN l.type = 'open_loop' THEN 'superseded by '
   ELSE 'resolved in favor of ' END || winner || ': ' || substr(coalesce(w.body, winner), 1, 80)
  END AS msg
FROM (SELECT *, abs(src_score - dst_score) >= 0.15::DOUBLE AS decided,
  CASE WHEN src_score >= dst_score THEN src ELSE dst END AS winner,
  CASE WHEN src_score >= dst_score THEN dst ELSE src END AS loser FROM tens) x
LEFT JOIN nodes l ON l.event_id = loser LEFT JOIN nodes w ON w.event_id = winner
LEFT JOIN (SELECT event_id, id FROM main WHERE type = 'open_loop') m ON m.event_id = loser""",
    "tokenize_bag": "SELECT token, count(*) AS n FROM d_tok GROUP BY 1",
    "df_terms": f"""SELECT term, count(*) AS df FROM (
 SELECT unnest(list_distinct({term_list('text')})) AS term FROM documents) GROUP BY 1""",
    "lead_terms": f"""SELECT doc_id, {lead('text')} AS lead, {slug(lead('text'))} AS slug
 FROM documents""",
    "tfidf_vectors": f"""SELECT doc_id, count(*) AS terms, {rnd('sum(weight)', 3)} AS weight_sum,
 {rnd('max(weight)', 5)} AS weight_max FROM d_vec GROUP BY 1""",
    "tfidf_search": f"""SELECT doc_id, similarity FROM (
 SELECT doc_id, {rnd('least(1.0, greatest(0.0, sum(weight * raw / norm)))')} AS similarity
 FROM d_vec JOIN q_raw USING (token), (SELECT sqrt(sum(raw * raw)) AS norm FROM q_raw)
 GROUP BY 1) WHERE similarity > 0 ORDER BY similarity DESC, doc_id LIMIT 8""",
    "fact_tfidf_search": f"""SELECT doc_id, {rnd('sum(c * r.raw)')} AS score FROM d_raw r
 JOIN q_tok USING (token) GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 5""",
    "bm25_search": "SELECT doc_id, rank FROM bm ORDER BY rank, doc_id LIMIT 25",
    "event_search": f"""SELECT seq, type, t, coalesce(msg, path, reason, type) AS title,
 {rnd('rank', 3)} AS bm25, {rnd('rel')} AS relevance,
 {salience(importance('type'), 'rel')} AS salience
FROM (SELECT s.*, c.rank, 1.0 - (c.rank - c.lo) / CASE WHEN c.hi = c.lo THEN 1.0
   ELSE c.hi - c.lo END AS rel
 FROM (SELECT *, min(rank) OVER () AS lo, max(rank) OVER () AS hi FROM (
   SELECT seq, rank FROM ebm ORDER BY rank, seq LIMIT 30)) c
 JOIN scored_log s ON s.seq = c.seq WHERE s.type NOT IN ({strings(P.GATED_TYPES)}))
ORDER BY salience DESC, seq LIMIT 6""",
    "dense_topk": f"""SELECT vec_id, {rnd("""least(1.0, greatest(0.0, (list_inner_product(
  embedding::DOUBLE[], q) / ((sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))
  + 1e-9) * (sqrt(list_inner_product(q, q)) + 1e-9)) + 1.0) / 2.0))""")} AS similarity
FROM embeddings, (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)
ORDER BY similarity DESC, vec_id LIMIT 10""",
    "drift_global": "SELECT drift, CAST(drift >= 0.82 AS INTEGER) AS drifted FROM g_drift",
    "drift_per_session": f"""SELECT session, drift, CAST(drift >= 0.82 AS INTEGER) AS drifted FROM (
 SELECT session, {rnd("1.0 - CASE WHEN sqrt(sum(a * a)) * sqrt(sum(b * b)) > 0 THEN sum(a * b) / "
                      "(sqrt(sum(a * a)) * sqrt(sum(b * b))) ELSE 0.0 END")} AS drift
 FROM (SELECT session, token, sum(CASE WHEN place <= 5 THEN 1 ELSE 0 END)::DOUBLE AS a,
   sum(CASE WHEN place > 5 THEN 1 ELSE 0 END)::DOUBLE AS b
  FROM (SELECT session, place, unnest({tokens("typ || ' ' || body || ' ' || session")}) AS token
   FROM (SELECT 'c' || conv_id AS session, text AS body,
      CASE WHEN role = 'user' THEN 'objective' ELSE 'observation' END AS typ,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place,
      count(*) OVER (PARTITION BY conv_id) AS turns FROM conversations)
   WHERE place <= 15 AND turns > 5) GROUP BY 1, 2) GROUP BY 1)""",
    "recency_salience": f"""SELECT seq, {salience(importance('type'))} AS salience
 FROM scored_log""",
    "artifact_sessions": "SELECT path, session FROM art_sess",
    "link_rows": """SELECT src, dst, kind, count(*) AS n FROM (
 SELECT coalesce(in_session, '?') AS src, path AS dst, 'session->artifact' AS kind FROM ins
  WHERE type = 'artifact' AND path IS NOT NULL
 UNION ALL SELECT coalesce(in_session, '?'), unnest(links), 'explicit' FROM ins) GROUP BY 1, 2, 3""",
    "topic_cooccurrence": """SELECT a, b, count(*) AS n FROM (
 SELECT a, unnest(topics) AS b FROM (SELECT topics, unnest(topics) AS a FROM log)) WHERE a <> b
 GROUP BY 1, 2""",
    "linked_degree": "SELECT seq, linked FROM linked",
    "reasoning_motifs": """SELECT gram, count(*) AS support FROM grams GROUP BY 1
 HAVING count(*) >= 2""",
    "failure_modes": """SELECT term, count(DISTINCT thread_id) AS support,
 count(DISTINCT event_id) AS events FROM fails WHERE term <> '' GROUP BY 1
 HAVING count(DISTINCT thread_id) >= 2""",
    "success_paths": "SELECT path, support, thread_id FROM paths",
    "bottlenecks": "SELECT event_id, seq, body, deps, thread_id FROM stops",
    "prune_concepts": """SELECT concept_id, 'stale: all ' || n ||
  ' evidence episodes cold, no active citation' AS reason FROM (
 SELECT v.concept_id, count(*) AS n, min(coalesce(n.cold, 0)) AS cold, count(a.event_id) AS cited
 FROM conc_ev v LEFT JOIN nodes n ON n.event_id = v.event_id
 LEFT JOIN active_ev a ON a.event_id = v.event_id GROUP BY 1)
WHERE cold = 1 AND cited = 0 ORDER BY concept_id LIMIT 8""",
    "retire_candidates": """SELECT procedure_id FROM proc WHERE uses >= 3 AND outcome_score < 0.25
 ORDER BY procedure_id LIMIT 10""",
    "table_counts": """SELECT count(*) FILTER (type = 'decision') AS decisions,
 count(*) FILTER (type = 'artifact') AS artifacts,
 count(DISTINCT session) FILTER (type = 'session_start') AS sessions,
 (SELECT count(DISTINCT coalesce(id, 'loop-' || seq)) FROM log WHERE type = 'open_loop') AS loops,
 (SELECT count(*) FROM (SELECT coalesce(id, 'loop-' || seq) AS lid, max(seq) AS s FROM log
   WHERE type = 'open_loop' GROUP BY 1) o WHERE NOT EXISTS (SELECT 1 FROM log c
   WHERE c.type = 'loop_closed' AND c.id = o.lid AND c.seq > o.s)) AS open_loops
FROM log""",
    "reflect_counts": f"""SELECT count(*) AS threads,
 count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'dormant') AS dormant,
 count(*) FILTER (status <> 'merged' AND ({NOW} - epoch_us(last_ts)) / 86400000000.0 > 14) AS stale,
 (SELECT count(*) FROM nodes WHERE type = 'open_loop' AND unresolved = 1) AS open_loops,
 (SELECT count(*) FROM nodes WHERE type = 'open_loop' AND unresolved = 1
   AND ({NOW} - epoch_us(ts)) / 86400000000.0 > 7) AS aging_loops,
 (SELECT count(*) FROM rivals) AS tensions FROM thr""",
}


def _loop_names() -> str:
    """Loops of the state fold; an id-less loop takes the next free number."""
    return """
 SELECT seq, t, msg, CASE WHEN id IS NOT NULL THEN id ELSE 'loop-' || n END AS lid FROM (
  SELECT *, sum(CASE WHEN id IS NULL OR first THEN 1 ELSE 0 END) OVER (ORDER BY seq) AS n FROM (
   SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) = 1 AS first FROM log
   WHERE type = 'open_loop'))"""


CTES["state_opens"] = _loop_names()
CTES["state_loops"] = """
 SELECT o.lid AS id, o.msg, o.t, CASE WHEN c.seq IS NULL THEN 0 ELSE 1 END AS resolved,
  c.resolution
 FROM (SELECT * FROM state_opens QUALIFY row_number() OVER (
   PARTITION BY lid ORDER BY seq DESC) = 1) o
 LEFT JOIN (SELECT id, seq, resolution FROM log WHERE type = 'loop_closed'
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) c
  ON c.id = o.lid AND c.seq > o.seq"""
_SELECTS["loops_state_fold"] = "SELECT id, msg, t, resolved, resolution FROM state_loops"
_SELECTS["loops_by_recency"] = f"""SELECT id, msg, t,
 {rnd('1.0 - (r - 1) / (n + 1)::DOUBLE', 2)} AS salience FROM (
 SELECT *, row_number() OVER (ORDER BY t DESC, id) AS r, count(*) OVER () AS n
 FROM state_loops WHERE resolved = 0) WHERE r <= 10"""

# Labels fold: recursion over each procedure's outcomes in order.
CTES["lab"] = """
 SELECT doc_id % 20 AS p, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY doc_id) AS j,
  CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS target FROM labels"""
CTES["lab_fold"] = """
 SELECT p, j, 0.5::DOUBLE + 0.25::DOUBLE * (target - 0.5::DOUBLE) AS s FROM lab WHERE j = 1
 UNION ALL
 SELECT l.p, l.j, f.s + 0.25::DOUBLE * (l.target - f.s) FROM lab_fold f
 JOIN lab l ON l.p = f.p AND l.j = f.j + 1"""
_SELECTS["outcome_ema_labels"] = f"""SELECT 'prc_' || p AS procedure_id,
 {rnd('arg_max(s, j)')} AS outcome_score, max(j) + 1 AS uses FROM lab_fold GROUP BY p"""

# Concepts from documents.
CTES["d_terms"] = f"""
 SELECT doc_id, unnest(list_distinct({term_list('text')})) AS term FROM documents"""
CTES["d_cands"] = f"""
 SELECT 'cpt_' || {slug('term')} AS concept_id, term, support,
  {rnd('support * ln(n / support)')} AS score
 FROM (SELECT term, count(*) AS support FROM d_terms GROUP BY 1 HAVING count(*) >= 3), d_n
 WHERE support / n <= 0.6 ORDER BY score DESC, term LIMIT 12"""
_SELECTS["abstract_concepts"] = """SELECT concept_id, term, support, score,
 term || ' — recurring concept across ' || support || ' episodes' AS summary FROM d_cands"""
_SELECTS["abstract_evidence"] = """SELECT concept_id, doc_id FROM d_terms
 JOIN d_cands USING (term)"""
CTES["episodes"] = f"""
 SELECT event_id, unnest(list_distinct({term_list('body')})) AS term FROM events_n
 WHERE type IN ({strings(P.ABSTRACT_TYPES)})"""
_SELECTS["abstract_episodes"] = f"""SELECT concept_id, term, support, score,
 term || ' — recurring concept across ' || support || ' episodes' AS summary FROM (
 SELECT 'cpt_' || {slug('term')} AS concept_id, term, support,
  {rnd('support * ln(n / support)')} AS score
 FROM (SELECT term, count(*) AS support FROM episodes GROUP BY 1 HAVING count(*) >= 3),
  (SELECT count(*)::DOUBLE AS n FROM events_n WHERE type IN ({strings(P.ABSTRACT_TYPES)}))
 WHERE support / n <= 0.6)
WHERE concept_id NOT IN (SELECT concept_id FROM conc) ORDER BY score DESC, term LIMIT 12"""

# Procedures and patterns.
CTES["cue_terms"] = f"""
 SELECT DISTINCT p.path, c.term FROM path_thr p JOIN (
  SELECT thread_id, unnest({term_list('body')}) AS term FROM member_ev
  WHERE type IN ({strings(P.PROC_TRIGGER_TYPES)})) c ON c.thread_id = p.thread_id"""
_SELECTS["learn_procedures"] = f"""SELECT 'prc_' || {slug('dashed')} AS procedure_id,
 'workflow: ' || p.path AS label, coalesce(q.cues, first_term) AS trigger, t.steps, p.support
FROM paths p JOIN path_thr t ON t.thread_id = p.thread_id
LEFT JOIN (SELECT path, string_agg(term, ',' ORDER BY term) AS cues FROM cue_terms GROUP BY 1) q
 ON q.path = p.path
WHERE 'prc_' || {slug('dashed')} NOT IN (SELECT procedure_id FROM proc)
ORDER BY p.support DESC, p.path LIMIT 8"""
CTES["props"] = f"""
 SELECT 'pat_reason_' || {slug('dashed')} AS pattern_id, 'reasoning' AS kind,
  'reasoning structure: ' || gram AS label, count(*) AS support, 1 AS place, gram AS o2,
  0 AS o0, 'recurring reasoning path ' || gram || ' — reuse or examine it' AS advice
 FROM grams GROUP BY gram, dashed HAVING count(*) >= 2
 UNION ALL
 SELECT 'pat_fail_' || {slug('term')}, 'failure', 'recurring failure mode: ''' || term || '''',
  count(DISTINCT thread_id), 2, term, 0,
  '''' || term || ''' recurs as a failure — add a guard / check earlier'
 FROM fails WHERE term <> '' GROUP BY term HAVING count(DISTINCT thread_id) >= 2
 UNION ALL
 SELECT 'pat_success_' || {slug('dashed')}, 'success', 'successful path: ' || path, support, 3,
  path, 0, 'recurring successful execution path — promote to a procedure' FROM paths
 UNION ALL
 SELECT 'pat_bottleneck_' || {slug('event_id')}, 'bottleneck', 'bottleneck: ' || substr(body, 1, 60),
  deps, 4, thread_id, seq,
  deps || ' causal dependents and the thread is unresolved — unblock first' FROM stops"""
_SELECTS["mine_patterns"] = f"""SELECT pattern_id, kind, label,
 {rnd('least(0.95::DOUBLE, 0.5::DOUBLE + 0.1::DOUBLE * (support - 1))')} AS confidence,
 support AS frequency, advice AS recommended
FROM (SELECT * FROM props WHERE pattern_id NOT IN (SELECT pattern_id FROM pat)
 QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY place,
  CASE WHEN place < 4 THEN -support ELSE 0 END, o2, o0) = 1)
ORDER BY place, CASE WHEN place < 4 THEN -support ELSE 0 END, o2, o0 LIMIT 10"""
CTES["promo"] = """
 SELECT pattern_id, label, confidence FROM pat WHERE kind = 'success' AND confidence >= 0.7
 AND pattern_id NOT IN (SELECT pattern_id FROM main WHERE type = 'pattern_promoted')
 ORDER BY confidence DESC, pattern_id LIMIT 8"""
CTES["promo_cues"] = f"""
 SELECT pattern_id, string_agg(term, ',' ORDER BY term) AS cues FROM (
  SELECT DISTINCT e.pattern_id, m.term FROM pat_ev e JOIN (
   SELECT thread_id, unnest({term_list('body')}) AS term FROM member_ev
   WHERE type IN ({strings(P.PROC_TRIGGER_TYPES)})) m
  ON m.thread_id = e.ref_id WHERE e.ref_kind = 'thread') GROUP BY 1"""
_SELECTS["promote_patterns"] = f"""SELECT p.pattern_id,
 'prc_' || {slug("regexp_replace(p.pattern_id, '^pat_success_', '')")} AS procedure_id,
 replace(p.label, 'successful path:', 'promoted workflow:') AS label,
 array_to_string(list_transform(string_split(replace(p.label, 'successful path:', ''), '→'),
  lambda s: trim(s)), ',') AS steps, q.cues AS trigger, {rnd('p.confidence')} AS confidence
FROM promo p LEFT JOIN promo_cues q ON q.pattern_id = p.pattern_id"""
_SELECTS["introspect_metrics"] = f"""
SELECT e AS retrieval_effectiveness, p AS procedural_success, d AS cognitive_drift,
 c AS context_pollution, i AS attention_instability,
 {rnd('(e + p + (1 - least(1.0, d)) + (1 - c) + (1 - i)) / 5')} AS confidence,
 array_to_string(list_filter([CASE WHEN e < 0.34 THEN 'widen_retrieval' END,
  CASE WHEN p < 0.4 THEN 'review_procedures' END, CASE WHEN d >= 0.82 THEN 'rerun_retrieval' END,
  CASE WHEN c >= 0.6 THEN 'trigger_compaction' END,
  CASE WHEN i >= 0.34 THEN 'enable_incubation' END], lambda x: x IS NOT NULL), ',') AS nudges
FROM (SELECT
 {rnd("count(*) FILTER (base > 0 AND reinforced > 0) / (count(*) FILTER (base > 0))::DOUBLE")} AS e,
 {rnd("count(*) FILTER (activation > 0 AND (cold = 1 OR activation <= 0.05)) / "
      "(count(*) FILTER (activation > 0))::DOUBLE")} AS c
 FROM acted JOIN nodes USING (event_id)),
(SELECT {rnd('avg(outcome_score)')} AS p FROM proc WHERE uses >= 1),
(SELECT drift AS d FROM m_drift),
(SELECT {rnd("least(1.0, count(*) FILTER (type = 'topic_shift') / greatest(1.0, count(*) / 10.0))")}
  AS i FROM (SELECT type FROM main ORDER BY seq DESC LIMIT 40))"""
_SELECTS["thread_digest_lines"] = """
SELECT thread_id, section, CASE WHEN type = 'loop_closed' THEN 1125899906842624 ELSE 0 END + seq
  AS place, CASE
  WHEN type = 'decision' THEN '- (' || event_id || ') ' || body
  WHEN type IN ('hypothesis', 'contradiction') THEN '- [' || type || '] ' || body
  WHEN type = 'open_loop' THEN '- [open] ' || body
  WHEN type = 'loop_closed' THEN '- [closed] ' || body
  WHEN type = 'reflection' THEN '- ' || substr(body, 1, 160) ELSE '- ' || body END AS line
FROM (SELECT *, CASE type WHEN 'objective' THEN 1 WHEN 'decision' THEN 2 WHEN 'hypothesis' THEN 3
   WHEN 'contradiction' THEN 3 WHEN 'open_loop' THEN 4 WHEN 'loop_closed' THEN 4
   WHEN 'artifact' THEN 5 WHEN 'reflection' THEN 6 END AS section,
  row_number() OVER (PARTITION BY thread_id, type ORDER BY seq DESC) AS newest FROM member_ev)
WHERE section IS NOT NULL AND (type <> 'open_loop' OR unresolved = 1)
 AND (type <> 'reflection' OR newest <= 3)"""


# Streaming results equal the batch results over the whole log.
CTES["log_tok"] = f"SELECT seq, unnest({fts('text')}) AS term FROM log_text"
_SELECTS["streaming_incremental_index"] = """SELECT term, count(DISTINCT seq) AS df,
 count(*) AS tf FROM log_tok GROUP BY 1"""
_SELECTS["streaming_late_close"] = """SELECT id, max(seq) AS last_open FROM log
 WHERE type = 'open_loop' AND id IS NOT NULL
 AND id NOT IN (SELECT id FROM log WHERE type = 'loop_closed' AND id IS NOT NULL) GROUP BY 1"""
_SELECTS["streaming_thread_activity"] = f"""SELECT thread_id, count(*) AS n_events,
 CASE WHEN ({NOW} - epoch_us(max(ts))) / 86400000000.0 > 14 THEN 'dormant' ELSE 'active' END
  AS status
FROM (SELECT ts, unnest(list_distinct(thread_ids)) AS thread_id FROM log) GROUP BY 1"""
CTES["x_run"] = """
 SELECT procedure_id AS pid, row_number() OVER (PARTITION BY procedure_id ORDER BY seq) AS j,
  CASE WHEN lower(coalesce(outcome, 'success')) IN ('failure', 'fail', 'error', '0')
   THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS target FROM log WHERE type = 'proc_executed'"""
CTES["x_fold"] = """
 SELECT pid, j, 0.5::DOUBLE + 0.25::DOUBLE * (target - 0.5::DOUBLE) AS s FROM x_run WHERE j = 1
 UNION ALL
 SELECT l.pid, l.j, f.s + 0.25::DOUBLE * (l.target - f.s) FROM x_fold f
 JOIN x_run l ON l.pid = f.pid AND l.j = f.j + 1"""
_SELECTS["streaming_ema"] = f"""SELECT pid AS procedure_id, {rnd('arg_max(s, j)')} AS score,
 max(j) AS uses FROM x_fold GROUP BY 1"""
_SELECTS["streaming_procedures"] = f"""SELECT procedure_id, {rnd('outcome_score')} AS outcome_score,
 uses, last_used_t FROM proc"""
_SELECTS["streaming_dormancy"] = """SELECT thread_id, count(*) AS n_events,
 CASE WHEN (SELECT max(epoch_ms(ts)) FROM log) - max(epoch_ms(ts)) > 14 * 86400000
  THEN 'dormant' ELSE 'active' END AS status
FROM (SELECT ts, unnest(list_distinct(thread_ids)) AS thread_id FROM log) GROUP BY 1"""
_SELECTS["streaming_drift"] = _SELECTS["drift_per_session"]


# Query hits over node bodies, and the full window of one agent built on them.
CTES["n_tok"] = f"SELECT event_id, unnest({tokens('body')}) AS token FROM nodes"
CTES["n_tf"] = "SELECT event_id, token, count(*) AS tf FROM n_tok GROUP BY 1, 2"
CTES["n_df"] = "SELECT token, count(*) AS df FROM n_tf GROUP BY 1"
CTES["n_n"] = "SELECT count(*)::DOUBLE AS n FROM nodes"
CTES["n_raw"] = """
 SELECT f.event_id, token, tf / total::DOUBLE * (ln(n / (df + 1)) + 1) AS raw FROM n_tf f
 JOIN (SELECT event_id, sum(tf) AS total FROM n_tf GROUP BY 1) l ON l.event_id = f.event_id
 JOIN n_df USING (token), n_n"""
CTES["n_vec"] = f"""
 SELECT r.event_id, token, {rnd('raw / norm', 6)} AS weight FROM n_raw r JOIN (
  SELECT event_id, sqrt(sum(raw * raw)) AS norm FROM n_raw GROUP BY 1) q
 ON q.event_id = r.event_id WHERE norm > 0"""
CTES["nq_raw"] = f"""
 SELECT token, c * (ln(n / (df + 1)) + 1) AS raw FROM (SELECT token, count(*) AS c FROM (
  SELECT unnest({tokens("'" + QUERY + "'")}) AS token) GROUP BY 1) JOIN n_df USING (token), n_n"""
CTES["n_hits"] = f"""
 SELECT event_id, 0.6::DOUBLE + 0.4::DOUBLE * similarity AS q FROM (
  SELECT event_id, {rnd('least(1.0, greatest(0.0, sum(weight * raw / norm)))')} AS similarity
  FROM n_vec JOIN nq_raw USING (token), (SELECT sqrt(sum(raw * raw)) AS norm FROM nq_raw)
  GROUP BY 1) WHERE similarity > 0 ORDER BY similarity DESC, event_id LIMIT 8"""
_SELECTS["seed_query_hits"] = f"SELECT event_id, {rnd('q')} AS q FROM n_hits"
CTES["w_fired"] = f"""
 SELECT DISTINCT procedure_id, outcome_score FROM
  (SELECT procedure_id, outcome_score, lower(trim(unnest(string_split(trigger_, ',')))) AS term
   FROM proc WHERE trigger_ <> '') p
 JOIN (SELECT DISTINCT lower(body) AS hay FROM nodes WHERE unresolved = 1
   UNION SELECT lower('{QUERY}')) h ON contains(h.hay, p.term)"""
CTES["w_seeded"] = f"""
 SELECT n.event_id, b.act AS base, coalesce(greatest(CASE WHEN n.cold = 0 THEN greatest(
   CASE WHEN p.f IS NULL AND r.x IS NULL AND m.n IS NULL THEN NULL
    ELSE coalesce(p.f, 0.0) + coalesce(r.x, 0.0) + 0.65::DOUBLE * coalesce(m.n, 0) END, h.q) END,
   0.5::DOUBLE * l.lift), 0.0) AS seed
 FROM nodes n JOIN base_act b ON b.event_id = n.event_id
 LEFT JOIN (SELECT event_id, max(f) AS f FROM (SELECT event_id, f FROM floors
   UNION ALL SELECT procedure_id, 0.6::DOUBLE * outcome_score FROM w_fired) GROUP BY 1) p
  ON p.event_id = n.event_id
 LEFT JOIN n_hits h ON h.event_id = n.event_id LEFT JOIN lifts l ON l.event_id = n.event_id
 LEFT JOIN (SELECT event_id, 0.55::DOUBLE AS x FROM nodes
   WHERE type IN ({strings(P.ROLE_TYPES['coder'])})) r ON r.event_id = n.event_id
 LEFT JOIN (SELECT event_id, count(*) AS n FROM mem WHERE thread_id IN ({strings(LANE)})
   GROUP BY 1) m ON m.event_id = n.event_id"""
CTES["w0"] = "SELECT event_id, base + seed AS act FROM w_seeded"
for _i in (1, 2):
    CTES[f"w{_i}"] = f"""
 SELECT s.event_id, 0.6::DOUBLE * base + 0.3::DOUBLE * coalesce(r.x, 0.0) + seed AS act
 FROM w_seeded s LEFT JOIN (SELECT v, sum(w * act) AS x FROM adj JOIN w{_i - 1} a
  ON a.event_id = adj.u GROUP BY 1) r ON r.v = s.event_id"""
inhibit_from("w2", "winh")
CTES["w_mix"] = """
 SELECT i.event_id, 0.7::DOUBLE * i.act + (1 - 0.7::DOUBLE) * coalesce(a.activation, 0.0) AS act
 FROM winh4 i LEFT JOIN acted a ON a.event_id = i.event_id"""
CTES["w_peaks"] = "SELECT thread_id, max(act) AS p FROM mem JOIN w_mix USING (event_id) GROUP BY 1"
CTES["w_first"] = "SELECT thread_id, p FROM w_peaks ORDER BY p DESC, thread_id LIMIT 1"
CTES["w_second"] = "SELECT thread_id FROM w_peaks ORDER BY p DESC, thread_id LIMIT 1 OFFSET 1"
CTES["w_osc"] = """
 SELECT x.event_id, x.act * CASE WHEN w.event_id IS NULL THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END
  + CASE WHEN r.event_id IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE * f.p END AS act
 FROM w_mix x LEFT JOIN (SELECT event_id FROM mem JOIN w_first USING (thread_id)) w
  ON w.event_id = x.event_id
 LEFT JOIN (SELECT event_id FROM mem JOIN w_second USING (thread_id)) r
  ON r.event_id = x.event_id
 CROSS JOIN (SELECT p FROM w_first) f"""
CTES["w_woken"] = """
 SELECT thread_id FROM mem JOIN w_osc USING (event_id) JOIN thr USING (thread_id)
 WHERE status = 'dormant' GROUP BY 1 HAVING max(act) > 0.4"""
_SELECTS["attend_agent_window"] = f"""SELECT o.event_id, s.base, {rnd('s.seed')} AS seed,
 {rnd('o.act + 0.125::DOUBLE * coalesce(u.n, 0)')} AS activation
FROM w_osc o JOIN w_seeded s ON s.event_id = o.event_id
LEFT JOIN (SELECT event_id, count(*) AS n FROM mem JOIN w_woken USING (thread_id) GROUP BY 1) u
 ON u.event_id = o.event_id"""


# What the digest reads of an event, in order; fields the events never have are empty.
DIGEST_FIELDS = {
    "text": ["t", "type", "event_id", "", "session", "project", "branch", "base", "", "agent", "id",
             "status", "action", "msg", "title", "path", "reason", "resolution", "", "", "label",
             "kind", "outcome", "thread_id", "into_", "spawn", "target", "concept_id",
             "procedure_id", "pattern_id"],
    "list": ["thread_ids", "causes", "between_", "evidence", "trigger_", "steps", "recommended",
             "links", "topics", "", ""],
    "whole": ["support", "frequency", "snapshot_seq", ""],
    "real": ["salience", "confidence", "outcome_score", "", ""],
    "rest": [""],
}


def digest_text() -> str:
    form = {"text": "{}", "list": "array_to_string({}, ',')", "whole": "CAST({} AS VARCHAR)",
            "real": "CAST(CAST(round({} * 1000000) AS BIGINT) AS VARCHAR)", "rest": "{}"}
    parts = ["CAST(seq AS VARCHAR)", "CAST(epoch_us(ts) AS VARCHAR)"]
    for kind, names in DIGEST_FIELDS.items():
        parts += [f"coalesce({form[kind].format(n)}, '')" if n else "''" for n in names]
    return " || '|' || ".join(parts)


_SELECTS["log_content_digest"] = f"""SELECT count(*) AS events, CAST(coalesce(sum(CAST(
 '0x' || substr(md5({digest_text()}), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS digest FROM log"""
_SELECTS["jsonl_round_trip"] = """SELECT seq, t, type, event_id, session, branch, id, msg, path,
 CAST(support AS BIGINT) AS support, CAST(frequency AS BIGINT) AS frequency, confidence,
 array_to_string(thread_ids, ',') AS thread_ids, array_to_string(causes, ',') AS causes,
 array_to_string(evidence, ',') AS evidence, array_to_string(steps, ',') AS steps,
 array_to_string(topics, ',') AS topics FROM log"""
_SELECTS["fts_tokens"] = f"""SELECT doc_id, token, count(*) AS n FROM (
 SELECT doc_id, unnest({fts('text')}) AS token FROM documents) GROUP BY ALL"""


_SELECTS["jsonl_ingest"] = _SELECTS["jsonl_round_trip"]
_SELECTS["bm25_scan"] = _SELECTS["bm25_search"]
_SELECTS["index_in_steps"] = f"""
SELECT 'bm25' AS search, doc_id, rank AS score FROM ({_SELECTS['bm25_search']})
UNION ALL SELECT 'fact', doc_id, score FROM ({_SELECTS['fact_tfidf_search']})
UNION ALL SELECT 'tfidf', doc_id, similarity FROM ({_SELECTS['tfidf_search']})"""
_SELECTS["query_hits_bm25"] = f"""SELECT n.event_id, {rnd('0.6::DOUBLE + 0.4::DOUBLE * relevance')} AS q FROM (
 SELECT seq, {rnd('rel')} AS relevance
 FROM (SELECT s.* REPLACE (0 AS linked), 1.0 - (c.rank - c.lo) / CASE WHEN c.hi = c.lo THEN 1.0
    ELSE c.hi - c.lo END AS rel
  FROM (SELECT *, min(rank) OVER () AS lo, max(rank) OVER () AS hi FROM (
    SELECT seq, rank FROM ebm ORDER BY rank, seq LIMIT 40)) c
  JOIN scored_log s ON s.seq = c.seq WHERE s.type NOT IN ({strings(P.GATED_TYPES)}))
 ORDER BY {salience(importance('type'), 'rel')} DESC, seq LIMIT 8) h JOIN nodes n ON n.seq = h.seq"""
_SELECTS["incremental_graph_build"] = f"""{_SELECTS['graph_build']}
UNION ALL SELECT 'nodes', count(*), sum(cold + 2 * unresolved + 4 * reinforced)::DOUBLE FROM nodes
UNION ALL SELECT 'threads ' || status, count(*), sum(n_events)::DOUBLE FROM thr GROUP BY 1"""
_SELECTS["query_hits_substring"] = f"""SELECT event_id, {P.SUBSTRING_SEED}::DOUBLE AS q FROM nodes
WHERE contains(lower(body), 'deploy')"""


def statements() -> dict[str, str]:
    return {name: sql(text) for name, text in _SELECTS.items()}
